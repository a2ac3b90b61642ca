import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import topk


def brute(rows, k, is_query):
    ints = {}
    for i, v in rows:
        if i is None or not v or any(x is None or not np.isfinite(x) for x in v):
            continue
        t = tuple(int(np.floor(256 * float(np.float32(x)))) for x in v)
        ints[i] = min(ints.get(i, t), t)
    out = []
    for q, a in ints.items():
        if is_query(q):
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ints.items() if i != q and len(b) == len(a))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id string, along int").select("*", F.lit(1).alias("low"))


@pytest.mark.parametrize("values", [1 << 22, 20])
def test_equals_brute_force(spark, monkeypatch, values):
    monkeypatch.setattr(topk, "VALUES_AT_ONCE", values)  # in this process; tiles are cut in workers
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)], "c", 0) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, 0.5, 0.5], "c", 0) for i in range(12)]  # ties
    rows += [(200, None, "c", 0), (201, [1.0, None, 1.0, 1.0], "c", 0), (202, [float("nan")] * 4, "c", 0), (203, [float("inf"), 0.0, 0.0, 0.0], "c", 0), (None, [1.0] * 4, "c", 0), (204, [], "c", 0), (205, [1.0, 2.0], "c", 0), (5, [9.0] * 4, "c", 0), (0, [0.0] * 4, None, None)]
    got = topk.top_k(frame(spark, rows).repartition(3), F.col("id") % 5 == 0, k=5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute([(r[0], r[1]) for r in rows], 5, lambda i: i % 5 == 0)


def test_tiles_change_nothing(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    ids, matrix = np.arange(0, 40, 4), rng.integers(-9, 9, (40, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array(matrix.tolist(), pa.list_(pa.int64()))], ["id", "vector"])
    block = ids, matrix[ids], np.full(len(ids), -5), np.zeros(len(ids), np.int64)
    run = lambda: [[c.to_pylist() for c in b.columns] for work in (topk._kept, lambda *a: topk._histogram(*a, width=2, span=60)) for b in work([batch, batch.slice(0, 0)], block, 3, 1.0)]
    want = run()
    monkeypatch.setattr(topk, "QUERIES_IN_TILE", 3)
    monkeypatch.setattr(topk, "ROWS_IN_TILE", 7)
    assert run() == want


def test_unique_ids_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=4).astype(np.float32)], "c", 0) for i in range(60)]
    rows += [(200, None, "c", 0), (205, [1.0, None, 1.0, 1.0], "c", 0), (210, [float("nan")] * 4, "c", 0), (None, [1.0] * 4, "c", 0), (215, [], "c", 0), (220, [1.0, 2.0], "c", 0), (221, [3.0, 2.0], "c", 0)]
    got = topk.top_k(frame(spark, rows).repartition(3), F.col("id") % 5 == 0, k=5)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute([(r[0], r[1]) for r in rows], 5, lambda i: i % 5 == 0)


def test_few_and_no_rows(spark):
    one = frame(spark, [(0, [1.0], "c", 0)])
    assert topk.top_k(one, F.col("id") % 50 == 0).isEmpty()
    assert topk.top_k(one.where("false"), F.col("id") % 50 == 0).isEmpty()
    two = frame(spark, [(0, [1.0], "c", 0), (1, [-2.0], "c", 0)])
    assert [tuple(r) for r in topk.top_k(two, F.col("id") % 50 == 0).collect()] == [(0, 1, 1, -131072)]


def test_large_components_stay_exact():
    a = np.array([[1 << 30, 3]], np.int64)
    assert topk._scores(a, a)[0, 0] == (1 << 60) + 9


def test_large_scores(spark):
    rows = [(0, [2.0**20, 0.0], "c", 0), (1, [2.0**20, 1.0], "c", 0), (2, [-(2.0**20), 1.0], "c", 0)]
    got = topk.top_k(frame(spark, rows), F.col("id") % 50 == 0)
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 1 << 56), (0, 2, 2, -(1 << 56))]
