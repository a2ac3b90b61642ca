"""Change logs as streams: the newest version per key, and replication by pulling.

Changes may arrive out of order; ``seq`` decides, not arrival.  Both streams take
a checkpoint of their own, so every replica has its own place in the log.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cairn.operators import lww


def latest_stream(changes: DataFrame) -> DataFrame:
    """The streaming form of :func:`cairn.operators.lww.latest`: state holds one version a key."""
    newest = changes.groupBy("key").agg(F.max(F.struct("seq", "deleted", "value")).alias("v"))
    return newest.select("key", "v.seq", "v.value", "v.deleted")


def write_latest(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Keeps ``path`` as a table of (batch, key, seq, value, deleted): the keys that each micro-batch changed.

    A batch that runs again after a failure overwrites its own folder, so each counts once; :func:`read_latest` merges them.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return latest_stream(changes).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start()


def _parts(spark: SparkSession, path: str) -> tuple[int, list[str]]:
    """The number of the last merged batch (-1 without one) and the folders that hold what :func:`write_latest` wrote."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    number = lambda kind: sorted(int(n.split("=")[1]) for n in names if n.startswith(f"{kind}="))
    merged = max(number("merged"), default=-1)
    return merged, [f"{path}/merged={merged}"] * (merged >= 0) + [f"{path}/batch={n}" for n in number("batch") if n > merged]


def _newest(spark: SparkSession, parts: list[str]) -> DataFrame:
    return spark.read.schema(lww.CHANGE).parquet(*parts) if parts else spark.createDataFrame([], lww.CHANGE)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    """The live rows of a table that :func:`write_latest` keeps: the merged batches and those after them."""
    return lww.live(_newest(spark, _parts(spark, path)[1]))


def merge_batches(spark: SparkSession, path: str) -> None:
    """Merges all batches so far into one folder, tombstones too, so that reads don't grow with the stream's age.

    Call it between runs of the stream.  The old folders go once the new one is named; a merge that fails before leaves everything as it was.
    """
    merged, parts = _parts(spark, path)
    last = max((int(p.rsplit("=", 1)[1]) for p in parts), default=-1)
    if len(parts) < 2:
        return
    temp = f"{path}/.merging-{uuid.uuid4().hex}"
    lww.latest(_newest(spark, parts)).write.parquet(temp)
    at = spark._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.rename(at(temp), at(f"{path}/merged={last}")):
        raise RuntimeError(f"{path} has been merged by another")
    for p in parts:
        fs.delete(at(p), True)


def replicate(puts: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Applies a stream of queued puts to a replica: each micro-batch is coalesced to the newest put of a key and stored; the checkpoint is the acknowledgement.

    Delivery is at least once and applying a put again changes nothing.  Without ``every`` all that is there is applied and the stream ends.
    """

    def apply(batch: DataFrame, number: int) -> None:
        lww.latest(batch.where(~F.col("deleted"))).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = puts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
