"""Exact top-k search by distributed histogram selection.

Vectors become integers, floor(scale * x), and every query is scored against
every candidate by the inner product.  The scores are never gathered: each
task gives a histogram of its scores, the sums of the histograms tell in which bin
a query's kth score lies, and the next pass divides that bin anew until it is
one value wide.  A last pass keeps the scores above that value and, of those
equal to it, the smallest ids.

A task never reports more than its own k best scores or rows for a query: the
kth best score of all candidates is never below the kth best of one task, so
nothing that could matter is left out.

Queries meet candidates in blocks of at most about ``VALUES_AT_ONCE`` components, whatever the
data's size: a block and what is known of it (two numbers a query) is broadcast, and
the candidates stay where they are read.  Nothing but histograms and results is shuffled.

Edge cases: rows whose id or vector is null, or whose vector is empty or holds
null or non-finite components, take no part; vectors of different lengths are
not compared; rows that repeat an id count once, with the smallest vector; a
query never finds its own id; equal scores go to the smaller id; a query
without candidates gives no row; empty tables give an empty result; other columns are ignored,
whatever their names.  Scores must be within 2**61 on either side, and scaled components be 64-bit integers.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import materialise, named
from cairn.shipping import ship

#: Components of the queries that are broadcast at once; bounds memory only.
VALUES_AT_ONCE = 1 << 22
#: Scores that are held at once, as queries by rows.
QUERIES_IN_TILE, ROWS_IN_TILE = 256, 4096
BINS = 4096
_EXACT_DOUBLE = float(1 << 53)
#: Scores are within this on either side.
LARGEST = 1 << 61
#: Stands for "no score".
NONE = np.iinfo(np.int64).min


def usable(vector: Column) -> Column:
    """True for vectors that are not null or empty and hold finite components only."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad, F.lit(False))


def _whole(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as integers; integers are scaled already."""
    return values if values.dtype == np.int64 else np.floor(scale * values.astype(np.float64)).astype(np.int64)


def _vectors(batch: pa.RecordBatch, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of a batch's vectors of ``dim`` components that take part."""
    column, ids = batch.column(1), batch.column(0)
    rows = np.flatnonzero(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False) == dim)
    picked = column.take(pa.array(rows)).flatten()
    good = ~ids.is_null().to_numpy(zero_copy_only=False)[rows]
    if picked.null_count:
        good &= ~picked.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(axis=1)
        picked = picked.fill_null(0)
    values = picked.to_numpy(zero_copy_only=False).reshape(-1, dim)
    if values.dtype != np.int64:
        good &= np.isfinite(values).all(axis=1)
        values = np.where(good[:, None], values, 0)
    return ids.take(pa.array(rows[good])).to_numpy(), _whole(values[good], scale)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products as int64: by doubles where these hold every partial sum, else by integers."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    if most < _EXACT_DOUBLE:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _tiles(batches: Iterator[pa.RecordBatch], ids: np.ndarray, matrix: np.ndarray, scale: float) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(queries, other ids, scores) in tiles; a query's own id scores ``NONE``."""
    for batch in batches:
        other_ids, others = _vectors(batch, matrix.shape[1], scale)
        for begin in range(0, len(other_ids), ROWS_IN_TILE):
            part_ids, part = other_ids[begin : begin + ROWS_IN_TILE], others[begin : begin + ROWS_IN_TILE]
            for first in range(0, len(ids), QUERIES_IN_TILE):
                some = slice(first, min(first + QUERIES_IN_TILE, len(ids)))
                scores = _scores(matrix[some], part)
                scores[ids[some][:, None] == part_ids[None, :]] = NONE
                yield some, part_ids, scores


def _histogram(batches, block, k: int, scale: float, width: int, span: int) -> Iterator[pa.RecordBatch]:
    """Of the scores in [low, low + span), each query's k best of this task, counted by bins: (id, bin, n)."""
    ids, matrix, low, _ = block
    best = np.full((len(ids), k), NONE)
    for some, _, scores in _tiles(batches, ids, matrix, scale):
        base = low[some][:, None]
        scores[(scores < base) | (scores >= base + span)] = NONE
        both = np.concatenate([best[some], scores], axis=1)
        best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
    q, at = np.nonzero(best != NONE)
    code, n = np.unique(q * BINS + (best[q, at] - low[q]) // width, return_counts=True)
    if len(code):
        yield pa.RecordBatch.from_arrays([pa.array(ids[code // BINS]), pa.array(code % BINS), pa.array(n)], ["id", "bin", "n"])


def _kept(batches, block, k: int, scale: float) -> Iterator[pa.RecordBatch]:
    """The scores from the kth one on, of each query the k first of this task: (query_id, id, score)."""
    ids, matrix, low, _ = block
    held = np.zeros((3, 0), np.int64)  # query, other id, score

    def first(rows: np.ndarray) -> np.ndarray:
        rows = rows[:, np.lexsort((rows[1], -rows[2], rows[0]))]
        return rows[:, np.arange(rows.shape[1]) - np.searchsorted(rows[0], rows[0]) < k]

    for some, part_ids, scores in _tiles(batches, ids, matrix, scale):
        q, at = np.nonzero((scores >= low[some][:, None]) & (scores != NONE))
        held = np.concatenate([held, np.stack([q + some.start, part_ids[at], scores[q, at]])], axis=1)
        if held.shape[1] > 4 * k * len(ids):
            held = first(held)
    held = first(held)
    if held.shape[1]:
        yield pa.RecordBatch.from_arrays([pa.array(ids[held[0]]), pa.array(held[1]), pa.array(held[2])], ["query_id", "id", "score"])


def _following(state: DataFrame, bins: DataFrame, k: int, bound: int, width: int) -> DataFrame:
    """Where each query's kth score lies after a pass: (id, low, above), ``above`` being how many better ones lie beyond."""
    # a query's bins from above, few as each task reports k scores at most; the first whose running sum reaches k
    ranked = bins.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("bin", "n")), asc=False).alias("bins"))
    walked = state.join(ranked, "id", "left").select(
        "id",
        "low",
        F.aggregate(
            F.coalesce("bins", F.array().cast("array<struct<bin:bigint,n:bigint>>")),
            F.struct(F.col("above").alias("above"), F.lit(None).cast("long").alias("bin")),
            lambda acc, b: F.when(acc["bin"].isNotNull(), acc)
            .when(acc["above"] + b["n"] >= k, F.struct(acc["above"].alias("above"), b["bin"].alias("bin")))
            .otherwise(F.struct((acc["above"] + b["n"]).alias("above"), F.lit(None).cast("long").alias("bin"))),
        ).alias("at"),
    )
    # fewer than k candidates: everything is kept
    low = F.when(F.col("at.bin").isNull(), F.lit(-bound)).otherwise(F.col("low") + F.col("at.bin") * width)
    return walked.select("id", low.cast("long").alias("low"), F.when(F.col("at.bin").isNull(), F.lit(0)).otherwise(F.col("at.above")).cast("long").alias("above"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The ``k`` best other rows of every row that ``is_query`` (a condition on ``id``) selects: query_id, rank, the key, score."""
    spark = vectors.sparkSession
    ship(spark)
    rows = vectors.select(named(key).cast("long").alias("id"), named(vector).alias("vector"))
    good = rows.where(F.col("id").isNotNull() & usable(F.col("vector")))
    if not good.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        ints = F.transform("vector", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))
        rows = good = materialise(good.select("id", ints.alias("vector")).groupBy("id").agg(F.min("vector").alias("vector")))
    sizes = good.groupBy(F.size("vector").alias("dim")).agg(F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high"), F.count(F.when(is_query, 1)).alias("queries"))
    found = []
    for r in sizes.where("queries > 0").orderBy("dim").collect():  # one row for each length of vectors
        ends = _whole(np.array([r["low"], r["high"]]), float(scale)).tolist()
        bound = min(max(abs(ends[0]), abs(ends[1])) ** 2 * r["dim"], LARGEST)
        blocks = math.ceil(r["queries"] * r["dim"] / VALUES_AT_ONCE)
        for number in range(blocks):
            block = good.where(is_query & (F.size("vector") == r["dim"]) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == number))
            if (one := _block(rows, block, r["dim"], bound, k, float(scale))) is not None:
                found.append(one)
    if not found:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")
    kept = reduce(DataFrame.unionByName, found)
    best = kept.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id"))).alias("all"))
    return best.select("query_id", F.posexplode(F.slice("all", 1, k))).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.id").alias(key), (-F.col("col.minus")).alias("score"))


def _block(rows: DataFrame, queries: DataFrame, dim: int, bound: int, k: int, scale: float) -> DataFrame | None:
    """The rows from each kth score on for one block of queries, which is gathered: ``VALUES_AT_ONCE`` components or about as many."""
    spark = rows.sparkSession
    table = queries.select("id", "vector").orderBy("id").toArrow().combine_chunks()
    if not table.num_rows:
        return None
    ids, matrix = _vectors(table.to_batches()[0], dim, scale)

    def over(low: np.ndarray, above: np.ndarray, work: Callable, schema: str, **options) -> DataFrame:
        shared = spark.sparkContext.broadcast((ids, matrix, low, above))
        return rows.mapInArrow(lambda batches: work(batches, shared.value, k, scale, **options), schema)

    # each query's kth score lies in [low, low + span); beyond are the `above` better ones
    span = 2 * bound + 1
    width = max(1, math.ceil(span / BINS))
    low, above = np.full(len(ids), -bound), np.zeros(len(ids), np.int64)
    while True:
        bins = over(low, above, _histogram, "id long, bin long, n long", width=width, span=span).groupBy("id", "bin").agg(F.sum("n").alias("n"))
        state = spark.createDataFrame(pa.table({"id": ids, "low": low, "above": above}))
        at = _following(state, bins, k, bound, width).orderBy("id").toArrow()
        low, above = at["low"].to_numpy().copy(), at["above"].to_numpy().copy()
        if width == 1:
            break
        span, width = width, max(1, math.ceil(width / BINS))
    return over(low, above, _kept, "query_id long, id long, score long")
