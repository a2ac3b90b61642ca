import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cairn.operators import lww, runs


def rows(df, *cols):
    return [tuple(r[c] if not isinstance(r[c], bytearray) else bytes(r[c]) for c in cols) for r in df.collect()]


def test_set_overwrite_get(log):
    changes = log(("foo", "bar"), ("hello", "world"), ("foo", "new"))
    assert sorted(rows(lww.live(changes), "key", "value")) == [("foo", b"new"), ("hello", b"world")]


def test_delete_and_resurrect(log):
    changes = log(("k", "v1"), ("k", None, True), ("k", "v2"), ("gone", "x"), ("gone", None, True))
    assert rows(lww.live(changes), "key", "value") == [("k", b"v2")]
    assert sorted(rows(lww.latest(changes), "key", "deleted")) == [("gone", True), ("k", False)]


def test_delete_of_missing_key_is_a_tombstone(log):
    changes = log(("nope", None, True))
    assert rows(lww.latest(changes), "key", "value", "deleted") == [("nope", None, True)]
    assert lww.live(changes).isEmpty()


def test_empty_value_and_empty_key_are_not_missing(spark, log):
    changes = log(("", "x"), ("empty", ""))
    asked = spark.createDataFrame([("",), ("empty",), ("none",)], "key string")
    assert sorted(rows(lww.get(changes, asked), "key", "value")) == [("", b"x"), ("empty", b""), ("none", None)]


def test_puts_turn_null_values_into_empty_ones(spark):
    df = spark.createDataFrame([("k", 1, None)], "k string, s long, v string")
    assert rows(lww.puts(df, F.col("k"), F.col("s"), F.col("v")), "value", "deleted") == [(b"", False)]


def test_three_states(spark, log):
    changes = log(("a", "1"), ("b", "2"), ("b", None, True))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "key string")
    assert sorted(rows(lww.lookup_state(changes, asked), "key", "state")) == [("a", "live"), ("b", "deleted"), ("c", "missing")]


def test_scan_is_in_byte_order(log):
    changes = log(("b", "1"), ("a", "1"), ("Z", "1"), ("č", "1"), ("", "1"), ("A", "1"))
    assert [r[0] for r in rows(lww.scan(changes), "key")] == ["", "A", "Z", "a", "b", "č"]
    assert rows(lww.first_key(changes), "key") == [("",)]


@pytest.mark.parametrize("n,size", [(1, 5), (2, 7), (3, 3)])
def test_memtable_size(log, n, size):
    changes = log(("abc", "de"), ("abc", "defg"), ("abc", None, True)).where(F.col("seq") <= n)
    assert lww.memtable_size(changes).first()["bytes"] == size


def test_empty_log(log):
    changes = log()
    assert lww.key_count(changes).first()[0] == 0
    assert lww.memtable_size(changes).first()["bytes"] == 0
    assert lww.first_key(changes).isEmpty()


def test_filter_on_key_reaches_below_the_aggregate(spark, log, tmp_path):
    log(("a", "1"), ("b", "2")).write.parquet(str(tmp_path / "log"))
    plan = lww.point_get(spark.read.parquet(str(tmp_path / "log")), "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan


def test_ties_of_seq_do_not_depend_on_order(spark):
    data = [("k", 1, b"a", False), ("k", 1, b"b", False), ("t", 1, b"z", False), ("t", 1, None, True)]
    for _ in range(3):
        random.shuffle(data)
        assert rows(lww.live(spark.createDataFrame(data, lww.CHANGE)), "key", "value") == [("k", b"b")]


def test_delete_where(log):
    changes = log(("x1", "a"), ("x2", "b"), ("y", "c"))
    gone = lww.delete_where(changes, F.col("key").startswith("x"), F.lit(100))
    assert rows(lww.live(lww.merge_runs(changes, gone)), "key") == [("y",)]


OPS = st.lists(st.tuples(st.sampled_from(["a", "b", "", "čš", "key"]), st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]), max_size=5))), max_size=30)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(OPS, st.integers(1, 4), st.randoms())
def test_equals_a_dict_however_runs_are_cut(log, ops, n_runs, rnd):
    want = {}
    for k, v in ops:
        if v is None:
            want.pop(k, None)
        else:
            want[k] = v.encode()
    changes = log(*[(k, v, v is None) for k, v in ops])
    cut = runs.cut_runs(changes, F.pmod(F.col("seq"), F.lit(n_runs)))
    shuffled = cut.orderBy(F.xxhash64("key", "seq", F.lit(rnd.randint(0, 99))))
    for got in (lww.live(changes), runs.compact(shuffled)):
        assert dict(rows(got, "key", "value")) == want


def test_flush_schedule_matches_known_counts():
    def last(ops, threshold):
        return list(runs.flush_schedule(ops, threshold))[-1]

    assert last([(f"key-{i:05d}", 29, False) for i in range(1000)], 8192) == (4, 1, 5)
    assert last([(f"b{b}-k{i:05d}", 29, False) for b in range(3) for i in range(500)], 8192)[1] >= 2
    assert last([(f"k-{i:05d}", 37, False) for i in range(3000)], 2048)[1] < 4


def test_all_tombstones_leave_no_run(log):
    changes = log(*[(f"k-{i}", "v") for i in range(50)], *[(f"k-{i}", None, True) for i in range(50)])
    assert runs.compact(runs.cut_runs(changes, (F.col("seq") / 25).cast("int"))).isEmpty()


def test_zone_maps_prune_runs(spark, log):
    cut = runs.cut_runs(log(("a", "1"), ("c", "1"), ("m", "1"), ("z", "1")), (F.col("seq") > 2).cast("int"))
    asked = spark.createDataFrame([("b",), ("n",), ("zz",)], "key string")
    assert sorted(rows(runs.candidate_runs(runs.zone_map(cut), asked), "key", "run")) == [("b", 0), ("n", 1)]
