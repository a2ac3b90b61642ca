import pytest
from pyspark.sql import functions as F

from cairn.functions import bloom, hashing
from cairn.operators import ring

GOLDEN = {"": (14695981039346656037, 5381), "a": (12638187200555641996, 177670), "foo": (15902901984413996407, 193491849), "key-05000": (9684973676230103388, 249895145853335664)}


def test_hashes(spark):
    df = spark.createDataFrame([(k,) for k in GOLDEN], "key string")
    got = df.select("key", hashing.unsigned(hashing.fnv1a("key")).alias("h1"), hashing.unsigned(hashing.djb2x("key")).alias("h2"), hashing.unsigned(hashing.fnv1a_expr(F.col("key"))).alias("h3"))
    for r in got.collect():
        assert (int(r["h1"]), int(r["h2"])) == GOLDEN[r["key"]]
        assert r["h3"] == r["h1"] == hashing.fnv1a_py(r["key"])


def test_hash_of_multibyte_long_and_null_keys(spark):
    keys = ["čšž", "\x00" * 10_000, "🙂", "x"]
    df = spark.createDataFrame([(k,) for k in keys] + [(None,)], "key string")
    got = {r["key"]: r["h"] for r in df.select("key", hashing.unsigned(hashing.fnv1a("key")).alias("h")).collect()}
    assert got.pop(None) is None
    assert got == {k: hashing.fnv1a_py(k) for k in keys}
    assert {r[0]: r[1] for r in df.where("key is not null and length(key) < 9").select("key", hashing.unsigned(hashing.fnv1a_expr(F.col("key")))).collect()} == {k: hashing.fnv1a_py(k) for k in keys if len(k) < 9}


@pytest.mark.parametrize("n,want", [(1, (64, 30)), (10, (96, 7)), (100, (959, 7)), (500, (4793, 7)), (1000, (9586, 7)), (10000, (95851, 7)), (100000, (958506, 7)), (0, (64, 30)), (-3, (64, 30))])
def test_bloom_params(n, want):
    assert bloom.bloom_params(n) == want


def test_bloom_rates_outside_the_unit_interval():
    assert bloom.bloom_params(1000, 0) == bloom.bloom_params(1000, 1) == bloom.bloom_params(1000, 0.01)


def test_bloom_positions(spark):
    df = spark.createDataFrame([("foo",), (None,)], "key string")
    assert [r[0] for r in df.select(bloom.positions(F.col("key"), 9586, 7)).collect()] == [[5089, 3528, 1967, 406, 8431, 6870, 5309], None]


def test_bloom_has_no_false_negatives_and_few_false_positives(spark):
    m, k = bloom.bloom_params(1000)
    words = bloom.build_words(spark.range(1000).select(F.format_string("present-%d", "id").alias("key")), "key", m, k)
    assert bloom.probe(spark.range(1000).select(F.format_string("present-%d", "id").alias("key")), "key", words, m, k).where("not may_contain").isEmpty()
    absent = bloom.probe(spark.range(20000).select(F.format_string("absent-%d", "id").alias("key")), "key", words, m, k)
    assert absent.where("may_contain").count() == 273


def test_empty_bloom_filter_holds_nothing(spark):
    keys = spark.createDataFrame([("x",)], "key string")
    words = bloom.build_words(keys.where("false"), "key", 64, 30)
    assert bloom.probe(keys, "key", words, 64, 30).first()["may_contain"] is False


def test_bloom_binary_form():
    data = bloom.encode_filter(130, 7, {0: 5, 2: 1 << 63})
    assert bloom.decode_filter(data) == (130, 7, {0: 5, 2: 1 << 63})
    for n in (0, 15, len(data) - 1):
        with pytest.raises(ValueError):
            bloom.decode_filter(data[:n])


CONFIG = """
[[shards]]
name = "alpha"
idx = 0
address = "localhost:8080"
replicas = ["x"]
[[shards]]
name = "beta"
idx = 1
address = "localhost:8081"
[[shards]]
name = "gamma"
idx = 2
address = "localhost:8082"
"""


def test_config():
    shards = ring.parse_shards(ring.parse_config(CONFIG), "beta")
    assert (shards.count, shards.current, shards.addresses) == (3, 1, {0: "localhost:8080", 1: "localhost:8081", 2: "localhost:8082"})


@pytest.mark.parametrize("indexes,current", [((0, 0), "s0"), ((0, 2), "s0"), ((0, 1), "other")])
def test_bad_configs(indexes, current):
    with pytest.raises(ring.ShardConfigError):
        ring.parse_shards([ring.Shard(f"s{i}", i, "") for i in indexes], current)


def test_ring(spark):
    points = ring.ring_points(3)
    assert len(points) == 450 and points[0] == (4091413544699795968, 1) and points[-1][0] == 14382314650745583853
    arcs = ring.ring_arcs(3)
    assert len(arcs) == 451 and arcs[0][0] == ring.LOWEST and arcs[-1][1] == ring.HIGHEST
    assert all(a[1] + 1 == b[0] for a, b in zip(arcs, arcs[1:]))
    keys = spark.createDataFrame([("",), ("foo",), ("hello",), ("key-05000",)], "key string")
    assert {r["key"]: r["shard"] for r in ring.with_owner(keys, 3).collect()} == {"": 1, "foo": 1, "hello": 2, "key-05000": 2}


@pytest.mark.parametrize("prefix,n,want", [("orders:", 15000, {0: 2630, 1: 8010, 2: 4360}), ("user-", 10000, {0: 1200, 1: 5700, 2: 3100})])
def test_owner_counts(spark, prefix, n, want):
    keys = spark.range(n).select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("key"))
    assert {r["shard"]: r["count"] for r in ring.with_owner(keys, 3).groupBy("shard").count().collect()} == want


def test_one_shard_owns_everything_and_an_empty_ring_is_shard_0(spark):
    keys = spark.range(100).select(F.col("id").cast("string").alias("key"))
    assert {r["shard"] for r in ring.with_owner(keys, 1).collect()} == {0}
    assert ring.ring_arcs(0) == [(ring.LOWEST, ring.HIGHEST, 0)]


def test_lookup_shuffles_nothing(spark):
    plan = ring.with_owner(spark.range(9).select(F.col("id").cast("string").alias("key")), 3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan and "NestedLoop" not in plan
