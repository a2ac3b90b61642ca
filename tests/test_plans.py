"""Plans that must stay as they are at any size, and operators used without the driver's entry."""

import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cairn.operators import lww, metrics, ring, runs
from cairn.sources.store import KeyValueStore
from cairn.streaming import streams

REPO = Path(__file__).resolve().parent.parent


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(log, tmp_path, spark):
    log(*[(f"k-{i}", "v" * 50) for i in range(50)]).write.parquet(str(tmp_path / "log"))
    return spark.read.parquet(str(tmp_path / "log"))


def test_counts_and_deletes_of_keys_read_no_values(stored):
    for df in (lww.key_count(stored), lww.delete_where(stored, F.col("key") > "k-3", F.lit(99)), ring.foreign_keys(lww.live_keys(stored), 3, 0)):
        text = plan(df)
        assert "SortAggregate" not in text and "HashAggregate" in text
        assert "value" not in text.split("ReadSchema: ")[1].split(">")[0]


def test_marks_agree_with_whole_changes(spark):
    data = [("a", 1, b"x", False), ("a", 1, None, True), ("b", 5, None, True), ("b", 6, b"y", False), ("c", 0, b"", False)]
    changes = spark.createDataFrame(data, lww.CHANGE)
    assert {(r["key"], r["seq"]) for r in lww.live_keys(changes).collect()} == {(r["key"], r["seq"]) for r in lww.live(changes).collect()} == {("b", 6), ("c", 0)}


def test_point_reads_of_a_store_push_the_key(spark, tmp_path):
    store = KeyValueStore(spark, f"file://{tmp_path}/store")
    store.put(spark.createDataFrame([(f"k-{i}", b"v") for i in range(100)], "key string, value binary"))
    store.flush()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,k-7)]" in plan(lww.point_get(store.changes(), "k-7"))


def test_samples_order_the_last_intervals_only(spark):
    requests = spark.range(1000).select(F.timestamp_seconds("id").alias("ts"), F.when(F.col("id") % 3 == 0, "set").otherwise("get").alias("op"))
    got = [(r["sample"], r["reads"], r["writes"]) for r in metrics.samples(requests, kept=5).orderBy("sample").collect()]
    assert got == [(i + 1, sum(x % 3 != 0 for x in range(n)), sum(x % 3 == 0 for x in range(n))) for i, n in enumerate((992, 994, 996, 998, 1000))]
    assert "TakeOrderedAndProject" in plan(metrics.samples(requests))


def test_many_zones_meet_keys_in_blocks(spark, log, monkeypatch):
    changes = log(*[(f"k-{i:03d}", "v") for i in range(60)])
    zones = runs.zone_map(runs.cut_runs(changes, F.floor(F.col("seq") / 7).cast("int")))
    asked = spark.createDataFrame([(f"k-{i:03d}",) for i in range(0, 80, 3)], "key string")
    want = sorted(map(tuple, runs.candidate_runs(zones, asked).collect()))
    monkeypatch.setattr(runs, "ZONES_AT_ONCE", 4)
    assert sorted(map(tuple, runs.candidate_runs(zones, asked).collect())) == want


def test_zones_that_overlap_are_searched_in_layers_not_row_by_row(spark):
    chance = random.Random(3)
    key = lambda: "".join(chance.choices("abž", k=chance.randint(0, 3)))
    rows = [(i, *sorted((key(), key()))) for i in range(40)] + [(40, "", "žžž"), (41, None, None)]
    zones, keys = spark.createDataFrame(rows, "run int, min_key string, max_key string"), [key() for _ in range(60)]
    got = runs.candidate_runs(zones, spark.createDataFrame([(k,) for k in [*keys, None]], "key string"))
    assert sorted(map(tuple, got.collect())) == sorted((k, i) for k in set(keys) for i, low, high in rows if low is not None and low <= k <= high)
    assert "NestedLoop" not in plan(got)
    assert [places for _, _, places in runs.layers_of([(b"a", b"b"), (b"c", b"d"), (b"a", b"z"), (b"d", b"e"), (b"f", b"g")])] == [[0, 1, 4], [2], [3]]
    assert runs.candidate_runs(zones.limit(0), spark.createDataFrame([("a",)], "key string")).collect() == []


def test_flush_threshold(spark, tmp_path):
    rows = lambda name, n, size: spark.range(n).select(F.format_string(f"{name}-%05d", "id").alias("key"), F.repeat(F.lit("v"), size).cast("binary").alias("value"))
    store = KeyValueStore(spark, f"file://{tmp_path}/one", flush_bytes=8192)
    store.put(rows("key", 1000, 29))
    assert len(store.manifest.runs) == 1 and not store.manifest.log and store.key_count() == 1000
    store = KeyValueStore(spark, f"file://{tmp_path}/three", flush_bytes=8192)
    for b in range(3):
        store.put(rows(f"b{b}-k", 500, 29))
    assert len(store.manifest.runs) == 3
    store.put(rows("b3-k", 500, 29))
    assert len(store.manifest.runs) == 1 and store.key_count() == 2000
    store.set_flush_threshold(0)
    assert store.flush_bytes == 8192
    store.set_flush_threshold(1 << 20)
    for _ in range(3):
        store.put(rows("same", 200, 29))
    assert len(store.manifest.log) == 3
    store.set_flush_threshold(9000)  # the newest changes hold 200 * (10 + 29) = 7,800 bytes, all changes more
    store.put(rows("same", 200, 29))
    assert len(store.manifest.log) == 4
    store.put(rows("other", 200, 29))
    assert not store.manifest.log and KeyValueStore(spark, f"file://{tmp_path}/three").key_count() == 2400


def test_rows_move_to_their_owners(spark, tmp_path):
    shards = [ring.Shard(n, i, "") for i, n in enumerate("ABC")]
    stores = {n: KeyValueStore(spark, f"file://{tmp_path}/{n}", shards=shards, current=n) for n in range(3)}
    stores[1].put(spark.range(5000).select(F.concat(F.lit("orders:"), F.col("id").cast("string")).alias("key"), F.lit(b"v").alias("value")))
    stores[1].hand_over(stores)
    for n, kv in stores.items():
        assert kv.key_count() > 0 and ring.foreign_keys(lww.live_keys(kv.changes()), 3, n).isEmpty()
    assert sum(kv.key_count() for kv in stores.values()) == 5000
    moved = ring.to_owners(spark.range(500).select(F.col("id").cast("string").alias("key")), 3)
    assert moved.groupBy(F.spark_partition_id()).agg(F.count_distinct("shard").alias("n")).where("n > 2").isEmpty()


def test_stream_batches_merge(spark, log, tmp_path):
    changes = log(("a", "1"), ("b", "1"), ("a", "2"), ("b", None, True), ("c", "1"))
    source, out = str(tmp_path / "in"), f"file://{tmp_path}/out"
    for part in ([1, 2], [3], [4, 5]):
        changes.where(F.col("seq").isin(part)).coalesce(1).write.mode("append").parquet(source)
        streams.write_latest(spark.readStream.schema(lww.CHANGE).parquet(source), out, f"{tmp_path}/checkpoint").awaitTermination()
        streams.merge_batches(spark, out)
        assert len([p for p in (tmp_path / "out").iterdir() if p.is_dir()]) == 1
    assert {r["key"]: bytes(r["value"]) for r in streams.read_latest(spark, out).collect()} == {"a": b"2", "c": b"1"}


def test_bad_configs_tell_all_faults():
    with pytest.raises(ring.ShardConfigError, match="0 to 2.*no shard"):
        ring.parse_shards([ring.Shard("a", 0, ""), ring.Shard("b", 2, ""), ring.Shard("c", 2, "")], "x")


ALONE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master({master!r}).config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", {checkpoints!r}).getOrCreate()
{code}
"""


def run_elsewhere(tmp_path, code, master="local[2]", checkpoints=None):
    """Runs code in a process of its own, in another folder, where workers can't import the package by themselves."""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    script = ALONE.format(repo=str(REPO), code=code, master=master, checkpoints=f"file://{tmp_path}/checkpoints" if checkpoints is None else checkpoints)
    return subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)


def test_operators_send_the_package_to_workers(tmp_path):
    code = """
from cairn.operators import ring
from cairn.functions import bloom
from cairn.sources.store import KeyValueStore
keys = spark.range(50).select(F.col("id").cast("string").alias("key"))
assert ring.with_owner(keys, 3).where("shard is null").isEmpty()
assert bloom.build_words(keys, "key", 640, 7).count() > 0
store = KeyValueStore(spark, "file://{}/store", shards=[ring.Shard(n, i, "") for i, n in enumerate("ABC")])
store.put(keys.withColumn("value", F.lit(b"v")))
store.purge()
assert store.route(keys).count() == 50
from cairn.sources import files
files.write_wal(store.changes(), "file://{}/wal")
assert files.read_wal(spark, "file://{}/wal").count() > 50
print("fine")
""".replace("{}", str(tmp_path))
    out = run_elsewhere(tmp_path, code)
    assert "fine" in out.stdout, out.stderr[-3000:]


def test_a_cluster_without_a_shared_folder_is_refused(monkeypatch, spark):
    from types import SimpleNamespace

    from cairn.sources import scratch

    fake = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None), conf=SimpleNamespace(get=lambda k, d: None))
    with pytest.raises(RuntimeError):
        scratch.shared_root(fake)
