"""Connected components of a graph of links, without gathering it anywhere."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import materialise, stored_rows
from cairn.shipping import ship
from cairn.sources.scratch import forget_sizes

#: Edges that one task contracts; bounds its memory.
EDGES_AT_ONCE = 200_000


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: (u, v) for every id u that is not the smallest, v, of its component among these edges."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate(c) for c in zip(*parts, strict=True))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for end in (label[a], label[b], a, b):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = np.flatnonzero(label != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(ids[label[other]])], ["u", "v"])


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) -> (id, component): every id (a BIGINT) of an edge with the smallest id that it can reach.

    Each task first contracts the edges that it has, at most about ``EDGES_AT_ONCE``.  Where one task has them all,
    that is the result; else the large-star and small-star steps alternate until no edge changes.  Each step is a
    partial aggregation and a join, so an id with very many links is split like any skewed key.  No edges give no rows.
    """
    ship(edges.sparkSession)
    now = forget_sizes(materialise(edges.select(F.greatest("a", "b").cast("bigint").alias("u"), F.least("a", "b").cast("bigint").alias("v")).where("u <> v").distinct()))
    tasks = max(1, math.ceil(stored_rows(now) / EDGES_AT_ONCE))
    now = forget_sizes(materialise(now.coalesce(tasks).mapInArrow(_contracted, "u long, v long")))
    before = None
    while tasks > 1:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # now every edge goes from the greater to the smaller id
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        now = forget_sizes(materialise(small.where("u <> v").distinct()))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
