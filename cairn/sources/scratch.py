"""A place that the driver and all executors share, for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder (``spark.checkpoint.dir``).

    Only where none is set on one machine (a ``local`` master, as in tests) it becomes a temporary one, which goes with the
    process; on a cluster, whose executors would not see it, that is an error.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="cairn-checkpoints-")
        atexit.register(shutil.rmtree, folder, True)
        root = f"file://{folder}"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return context.getCheckpointDir() or root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Cuts the lineage through the shared folder, so that a lost executor costs only its own tasks and later steps don't compute the rows again.

    The rows are counted while they are written; :func:`stored_rows` tells how many.
    """
    shared_root(df.sparkSession)
    seen = Observation()
    out = df.observe(seen, F.count(F.lit(1)).alias("rows")).checkpoint(eager=True)
    out._stored_rows = seen.get["rows"]
    return out


def stored_rows(df: DataFrame) -> int:
    """The rows of a frame; without a job where :func:`materialise` made it."""
    known = getattr(df, "_stored_rows", None)
    return df.count() if known is None else known


def forget_sizes(df: DataFrame) -> DataFrame:
    """A stored frame without the optimizer's guess of its size.

    A checkpoint keeps the guess of the plan that made it, and a join's guess is the product of its sides', so over many rounds of
    joins the number itself would fill the driver's memory.
    """
    spark = df.sparkSession
    plain = spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False)
    out = DataFrame(plain, spark)
    out._stored_rows = stored_rows(df)
    return out
