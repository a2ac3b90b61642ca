"""The queries over the driver's tables, each with the SQL that gives the same rows.

``events`` is the change log: key 'user-<user_id>', seq event_id, value props, and an 'error' event deletes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.functions import bloom, codec, hashing
from cairn.operators import lww, metrics, replication, ring, runs
from cairn.sources import files, scratch, store
from cairn.streaming import streams

SHARDS = [ring.Shard("alpha", 0, "localhost:8080"), ring.Shard("beta", 1, "localhost:8081"), ring.Shard("gamma", 2, "localhost:8082")]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return lww.puts(e, F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("event_id"), F.col("props"), F.col("event_type") == "error")


def order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("key"))


def event_store(spark: SparkSession, sf_dir: str, flushed: bool = False, **options) -> store.KeyValueStore:
    """A new store that holds the event log."""
    kv = store.KeyValueStore(spark, scratch.scratch_path(spark, "store"), **options)
    kv.apply(event_changes(spark, sf_dir))
    if flushed:
        kv.flush()
    return kv


def customer_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of users, some of which have no events."""
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"))


def as_text(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.decode("value", "UTF-8"))


C = """c AS (SELECT 'user-' || user_id AS key, event_id AS seq, coalesce(props, '') AS value, event_type = 'error' AS deleted FROM events),
newest AS (SELECT key, seq, CASE WHEN deleted THEN NULL ELSE value END AS value, deleted FROM c QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1),
live AS (SELECT key, seq, value FROM newest WHERE NOT deleted)"""

FNV = "list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, strlen({k}) + 1), lambda at_: unicode(substr({k}, at_, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
DJB_IN = "((h * 33::UHUGEINT + b) % 18446744073709551616::UHUGEINT)"
DJB = f"list_reduce(list_concat([5381::UHUGEINT], list_transform(range(1, strlen({{k}}) + 1), lambda at_: unicode(substr({{k}}, at_, 1))::UHUGEINT)), lambda h, b: xor({DJB_IN}, {DJB_IN} // 4294967296::UHUGEINT))"


def fnv(k: str) -> str:
    return FNV.format(k=k)


def djb(k: str) -> str:
    return DJB.format(k=k)


O = f"o AS (SELECT 'orders:' || o_orderkey AS key, {fnv('key')} AS h FROM orders)"


def ring_sql(n: int, name: str = "ring") -> str:
    label = "(i::VARCHAR || '-' || v::VARCHAR)"
    return f"{name} AS (SELECT h, max(i) AS shard FROM (SELECT i, {fnv(label)} AS h FROM range({n}) a(i), range(150) b(v)) GROUP BY h)"


def owner_sql(keys: str, name: str, into: str = "shard") -> str:
    """Keys (key, h) with the shard of the first point at or after the hash."""
    return f"SELECT {keys}.*, coalesce({name}.shard, (SELECT arg_min(shard, h) FROM {name})) AS {into} FROM {keys} ASOF LEFT JOIN {name} ON {keys}.h <= {name}.h"


# the newest version wins


@query(f"WITH {C} SELECT * FROM live")
def lww_live(spark, sf_dir):
    return as_text(lww.live(event_changes(spark, sf_dir)))


@query(f"WITH {C} SELECT * FROM newest")
def latest_with_tombstones(spark, sf_dir):
    return as_text(lww.latest(event_changes(spark, sf_dir)))


@query(f"WITH {C} SELECT key, value FROM live WHERE key = 'user-7'")
def point_get(spark, sf_dir):
    """From a store's sorted runs: the key reaches the scan, which skips by statistics and Bloom filters."""
    return as_text(lww.point_get(event_store(spark, sf_dir, flushed=True).changes(), "user-7")).select("key", "value")


@query(f"WITH {C}, asked AS (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer) SELECT key, value FROM asked LEFT JOIN live USING (key)")
def get_missing_left_join(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"))
    return as_text(lww.get(event_changes(spark, sf_dir), asked))


@query(f"""WITH {C}, asked AS (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer)
SELECT key, CASE WHEN deleted IS NULL THEN 'missing' WHEN deleted THEN 'deleted' ELSE 'live' END AS state, value FROM asked LEFT JOIN newest USING (key)""")
def get_three_valued(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"))
    return as_text(lww.lookup_state(event_changes(spark, sf_dir), asked))


@query(f"WITH {C} SELECT count(*) AS key_count FROM live")
def key_count(spark, sf_dir):
    return lww.key_count(event_changes(spark, sf_dir))


@query(f"WITH {C} SELECT * FROM live ORDER BY key")
def scan_ordered(spark, sf_dir):
    return as_text(lww.scan(event_changes(spark, sf_dir)))


@query(f"WITH {C} SELECT * FROM live ORDER BY key LIMIT 1")
def scan_first_key(spark, sf_dir):
    return as_text(lww.first_key(event_changes(spark, sf_dir)))


@query(f"WITH {C} SELECT coalesce(sum(octet_length(encode(key)) + coalesce(octet_length(encode(value)), 0)), 0)::BIGINT AS bytes, count(*) AS entries, count(*) FILTER (deleted) AS tombstones FROM newest")
def memtable_size(spark, sf_dir):
    return lww.memtable_size(event_changes(spark, sf_dir))


@query("SELECT conv_id::VARCHAR AS key, max(turn) AS seq, arg_max(coalesce(text, ''), turn) AS value FROM conversations GROUP BY conv_id")
def lww_conversations(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return as_text(lww.live(lww.puts(c, F.col("conv_id").cast("string"), F.col("turn"), F.col("text"))))


@query(f"WITH {C} SELECT key, 1000000000::BIGINT AS seq, true AS deleted FROM live WHERE key LIKE 'user-1%'")
def delete_where(spark, sf_dir):
    return lww.delete_where(event_changes(spark, sf_dir), F.col("key").startswith("user-1"), F.lit(1000000000)).drop("value")


# runs: four ranges of seq

R = f"{C}, cut AS (SELECT (seq % 10007 // 2502)::BIGINT AS run, * FROM c), runs AS (SELECT run, key, seq, CASE WHEN deleted THEN NULL ELSE value END AS value, deleted FROM cut QUALIFY row_number() OVER (PARTITION BY run, key ORDER BY seq DESC) = 1)"


def event_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.cut_runs(event_changes(spark, sf_dir), F.floor((F.col("seq") % 10007) / 2502).cast("bigint"))


@query(f"WITH {R} SELECT * FROM runs")
def flush_runs(spark, sf_dir):
    return as_text(event_runs(spark, sf_dir))


@query(f"WITH {R} SELECT run, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, count(*) FILTER (deleted) AS tombstones FROM runs GROUP BY run")
def run_zone_map(spark, sf_dir):
    return runs.zone_map(event_runs(spark, sf_dir))


@query(f"WITH {R}, z AS (SELECT run, min(key) AS low, max(key) AS high FROM runs GROUP BY run), asked AS (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer) SELECT key, run FROM asked JOIN z ON key BETWEEN low AND high")
def run_pruning(spark, sf_dir):
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"))
    return runs.candidate_runs(runs.zone_map(event_runs(spark, sf_dir)), asked)


@query(f"WITH {C} SELECT * FROM live")
def compact_runs(spark, sf_dir):
    return as_text(runs.compact(event_runs(spark, sf_dir)))


@query(f"WITH {C} SELECT step, CASE step WHEN 'flushed' THEN (SELECT count(*) FROM newest) WHEN 'deleted' THEN (SELECT count(*) FROM newest) + (SELECT count(*) FROM live) ELSE 0 END AS entries, CASE step WHEN 'flushed' THEN (SELECT count(*) FROM newest WHERE deleted) WHEN 'deleted' THEN (SELECT count(*) FROM newest) ELSE 0 END AS tombstones, CASE step WHEN 'flushed' THEN 1 WHEN 'deleted' THEN 2 ELSE 0 END::BIGINT AS runs FROM (VALUES ('flushed'), ('deleted'), ('merged')) v(step)")
def compact_all_tombstones(spark, sf_dir):
    """What a store's runs hold after a flush, after every key was deleted, and after a merge, which leaves no run."""
    kv = event_store(spark, sf_dir, flushed=True)

    def held(step: str) -> DataFrame:
        return kv.changes().agg(F.lit(step).alias("step"), F.count("*").alias("entries"), F.count_if("deleted").alias("tombstones"), F.lit(len(kv.manifest.runs)).cast("bigint").alias("runs"))

    parts = [scratch.materialise(held("flushed"))]
    kv.delete_where(F.lit(True))
    kv.flush()
    parts.append(scratch.materialise(held("deleted")))
    kv.compact()
    return lww.merge_runs(*parts, held("merged"))


@query(f"""WITH b AS (SELECT 'orders:' || o_orderkey AS key, o_orderkey % 5 AS batch FROM orders)
SELECT (CASE WHEN batch < 4 THEN 0 ELSE 1 END)::INTEGER AS run, min(key) AS min_key, max(key) AS max_key, count(*) AS entries, 0::BIGINT AS log_segments FROM b GROUP BY 1""")
def store_auto_flush(spark, sf_dir):
    """Five batches of orders, each above the flush threshold: every one becomes a run by itself, and the fourth brings a merge."""
    kv = store.KeyValueStore(spark, scratch.scratch_path(spark, "store"), flush_bytes=4096)
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("orders:"), F.col("o_orderkey").cast("string")).alias("key"), F.encode("o_orderpriority", "UTF-8").alias("value"), (F.col("o_orderkey") % 5).alias("batch"))
    for i in range(5):
        kv.put(rows.where(F.col("batch") == i).select("key", "value"))
    each = [kv._frame([part]).withColumn("run", F.lit(n)) for n, part in enumerate(reversed(kv.manifest.runs))]
    return runs.zone_map(lww.merge_runs(*each)).select("run", "min_key", "max_key", "entries", F.lit(len(kv.manifest.log)).cast("bigint").alias("log_segments"))


# hashes and the ring


@query(f"WITH {O} SELECT key, h::VARCHAR AS fnv1a, ({djb('key')})::VARCHAR AS djb2x FROM o")
def fnv1a_hash(spark, sf_dir):
    keys = order_keys(spark, sf_dir)
    return keys.select("key", hashing.unsigned_text(hashing.fnv1a("key")).alias("fnv1a"), hashing.unsigned_text(hashing.djb2x("key")).alias("djb2x"))


@query(f"SELECT 'nation:' || n_name AS key, ({fnv(chr(39) + 'nation:' + chr(39) + ' || n_name')})::VARCHAR AS fnv1a FROM nation")
def fnv1a_native(spark, sf_dir):
    keys = table(spark, sf_dir, "nation").select(F.concat(F.lit("nation:"), "n_name").alias("key"))
    return keys.select("key", hashing.unsigned_text(hashing.fnv1a_expr(F.col("key"))).alias("fnv1a"))


@query("SELECT i::INTEGER AS idx, v::INTEGER AS vnode, (" + fnv("(i::VARCHAR || '-' || v::VARCHAR)") + ")::VARCHAR AS hash FROM range(3) a(i), range(150) b(v)")
def ring_points(spark, sf_dir):
    return ring.points_frame(spark, 3).withColumn("hash", hashing.unsigned_text(F.col("hash")))


@query(f"WITH {O}, {ring_sql(3)} SELECT key, shard::INTEGER AS shard FROM ({owner_sql('o', 'ring')})")
def ring_lookup(spark, sf_dir):
    return ring.with_owner(order_keys(spark, sf_dir), 3).select("key", "shard")


@query(f"WITH {O}, {ring_sql(3)} SELECT shard::INTEGER AS shard, count(*) AS keys FROM ({owner_sql('o', 'ring')}) GROUP BY shard")
def shard_counts(spark, sf_dir):
    return ring.with_owner(order_keys(spark, sf_dir), 3).groupBy("shard").agg(F.count("*").alias("keys"))


@query(f"""WITH {ring_sql(3)}, s AS (SELECT h, shard, lag(h) OVER (ORDER BY h) AS before FROM ring),
arcs AS (SELECT shard, (CASE WHEN before IS NULL THEN h + 1::UHUGEINT ELSE h - before END) AS width FROM s
UNION ALL SELECT (SELECT arg_min(shard, h) FROM ring), 18446744073709551615::UHUGEINT - (SELECT max(h) FROM ring))
SELECT shard::INTEGER AS shard, count(*) AS arcs, (sum(width::HUGEINT) * 1000000 // 18446744073709551616)::BIGINT AS share_ppm FROM arcs GROUP BY shard""")
def ring_arc_share(spark, sf_dir):
    return ring.arc_shares(spark, 3)


@query(f"""WITH {O}, {ring_sql(3, 'r3')}, {ring_sql(4, 'r4')}, a AS ({owner_sql('o', 'r3', 'from_shard')}), b AS ({owner_sql('a', 'r4', 'to_shard')})
SELECT from_shard::INTEGER AS from_shard, to_shard::INTEGER AS to_shard, count(*) AS keys FROM b GROUP BY ALL""")
def shard_movement_3_to_4(spark, sf_dir):
    return ring.movement(order_keys(spark, sf_dir), 3, 4)


@query(f"WITH {O} SELECT key, (h % 3::UHUGEINT)::INTEGER AS shard FROM o")
def modulo_fallback(spark, sf_dir):
    return order_keys(spark, sf_dir).select("key", ring.modulo_owner(F.col("key"), 3).alias("shard"))


@query(f"""WITH {C}, {ring_sql(3)}, k AS (SELECT *, {fnv('key')} AS h FROM live)
SELECT key, shard::INTEGER AS shard FROM ({owner_sql('k', 'ring')}) WHERE shard <> 0""")
def purge_foreign(spark, sf_dir):
    return ring.foreign_keys(lww.live_keys(event_changes(spark, sf_dir)), 3, 0).select("key", "shard")


@query(f"""WITH {C}, {ring_sql(3)}, k AS (SELECT *, {fnv('key')} AS h FROM live)
SELECT shard::INTEGER AS store, key, value FROM ({owner_sql('k', 'ring')})""")
def rows_to_owners(spark, sf_dir):
    """Shard 0's store had every key; each row after it was handed over, with the store that has it."""
    stores = {n: store.KeyValueStore(spark, scratch.scratch_path(spark, "store"), shards=SHARDS, current=n) for n in range(3)}
    stores[0].apply(event_changes(spark, sf_dir))
    stores[0].hand_over(stores)
    return as_text(lww.merge_runs(*[kv.scan().select(F.lit(n).alias("store"), "key", "value") for n, kv in stores.items()]))


@query("SELECT * FROM (VALUES (0, 'alpha', 'localhost:8080', false), (1, 'beta', 'localhost:8081', true), (2, 'gamma', 'localhost:8082', false)) v(idx, name, address, is_current)")
def shard_config(spark, sf_dir):
    """A TOML configuration, checked."""
    text = "".join(f'[[shards]]\nname = "{s.name}"\nidx = {s.idx}\naddress = "{s.address}"\n' for s in reversed(SHARDS))
    listed = ring.parse_config(text)
    shards = ring.parse_shards(listed, "beta")
    return spark.createDataFrame([(s.idx, s.name, shards.addresses[s.idx], s.idx == shards.current) for s in listed], "idx int, name string, address string, is_current boolean")


@query(f"""WITH r AS (SELECT 'user-' || user_id AS key, count(*) AS n FROM events GROUP BY user_id), k AS (SELECT *, {fnv('key')} AS h FROM r), {ring_sql(3)},
names AS (SELECT * FROM (VALUES (0, 'alpha', 'localhost:8080'), (1, 'beta', 'localhost:8081'), (2, 'gamma', 'localhost:8082')) v(shard, name, address))
SELECT x.shard::INTEGER AS shard, name, address, x.shard <> 0 AS redirected, sum(n)::BIGINT AS requests FROM ({owner_sql('k', 'ring')}) x JOIN names ON x.shard = names.shard GROUP BY ALL""")
def route_report(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select(F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("key"))
    return ring.route_report(requests, SHARDS, 0)


# Bloom filters

# the filter of all part keys, sized by their number; probed with them and with as many keys that are not in it
BITS = "list_transform(range(k), lambda i: ((({h1} + i::UHUGEINT * {h2}) % 18446744073709551616::UHUGEINT) % m::UHUGEINT)::BIGINT)".format(h1="h1", h2="h2")
HASHES = f"{fnv('key')} AS h1, greatest({djb('key')}, 1::UHUGEINT) AS h2"
P = f"""members AS (SELECT 'part-' || p_partkey AS key FROM part),
size_ AS (SELECT greatest(count(*), 1)::DOUBLE AS n, greatest(64, ceil(-greatest(count(*), 1) * ln(0.01) / (ln(2) * ln(2))))::BIGINT AS m FROM members),
params AS (SELECT m, least(greatest(floor(m / n * ln(2) + 0.5), 1), 30)::BIGINT AS k FROM size_),
mp AS (SELECT key, {BITS} AS pos FROM (SELECT key, {HASHES}, m, k FROM members, params)), set_bits AS (SELECT DISTINCT unnest(pos) AS bit FROM mp)"""


@query("""WITH s AS (SELECT n::BIGINT AS n, p::DOUBLE AS p FROM (VALUES (-5, 0.01), (0, 0.01), (1, 0.01), (10, 0.01), (100, 0.01), (500, 0.01), (1000, 0.01), (10000, 0.01), (100000, 0.01), (1000, 0.5), (1000, 0.0), (1000, 1.5)) v(n, p)),
c AS (SELECT n, p, greatest(n, 1)::DOUBLE AS n1, CASE WHEN p > 0 AND p < 1 THEN p ELSE 0.01 END AS p1 FROM s),
m AS (SELECT n, p, n1, greatest(64, ceil(-n1 * ln(p1) / (ln(2) * ln(2))))::BIGINT AS m FROM c)
SELECT n, p, m, least(greatest(floor(m / n1 * ln(2) + 0.5), 1), 30)::INTEGER AS k FROM m""")
def bloom_params(spark, sf_dir):
    sizes = [(n, 0.01) for n in (-5, 0, 1, 10, 100, 500, 1000, 10000, 100000)] + [(1000, 0.5), (1000, 0.0), (1000, 1.5)]
    m, k = bloom.bloom_params_expr(F.col("n"), F.col("p"))
    return spark.createDataFrame(sizes, "n bigint, p double").withColumn("m", m).withColumn("k", k)


def part_keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int, int]:
    """The keys, and the bits and hashes of a filter for as many."""
    keys = table(spark, sf_dir, "part").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("key"))
    return keys, *bloom.bloom_params(keys.count())


@query(f"WITH {P} SELECT key, array_to_string(pos, ',') AS positions FROM mp")
def bloom_positions(spark, sf_dir):
    keys, m, k = part_keys(spark, sf_dir)
    return keys.select("key", F.concat_ws(",", bloom.positions(F.col("key"), m, k).cast("array<string>")).alias("positions"))


@query(f"WITH {P} SELECT (bit // 64)::INTEGER AS word, lpad(to_hex(bit_or(1::UBIGINT << (bit % 64)::INTEGER)), 16, '0') AS bits FROM set_bits GROUP BY 1")
def bloom_build_words(spark, sf_dir):
    keys, m, k = part_keys(spark, sf_dir)
    return bloom.build_words(keys, "key", m, k).withColumn("bits", F.lpad(F.hex("bits"), 16, "0"))


@query(f"WITH {P} SELECT m::VARCHAR AS m, k::INTEGER AS k, (bit // 64)::INTEGER AS word, lpad(to_hex(bit_or(1::UBIGINT << (bit % 64)::INTEGER)), 16, '0') AS bits FROM set_bits, params GROUP BY ALL")
def bloom_codec(spark, sf_dir):
    """The filter in its binary form and back."""
    keys, m, k = part_keys(spark, sf_dir)
    words = {r["word"]: r["bits"] for r in bloom.build_words(keys, "key", m, k).collect()}  # one filter, which its size bounds
    m, k, words = bloom.decode_filter(bloom.encode_filter(m, k, words))
    return spark.createDataFrame([(str(m), k, w, f"{b:016X}") for w, b in words.items()], "m string, k int, word int, bits string")


PROBE = f"{P}, asked AS (SELECT key, true AS member FROM members UNION ALL SELECT 'absent-' || p_partkey, false FROM part), ab AS (SELECT key, member, unnest({BITS}) AS bit FROM (SELECT key, member, {HASHES}, m, k FROM asked, params)), hit AS (SELECT key, member, bool_and(s.bit IS NOT NULL) AS may_contain FROM ab LEFT JOIN set_bits s ON ab.bit = s.bit GROUP BY ALL)"


def probed(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, m, k = part_keys(spark, sf_dir)
    absent = keys.select(F.replace("key", F.lit("part-"), F.lit("absent-")).alias("key"))
    return bloom.probe(keys.unionByName(absent), "key", bloom.build_words(keys, "key", m, k), m, k)


@query(f"WITH {PROBE} SELECT key, may_contain FROM hit")
def bloom_probe(spark, sf_dir):
    return probed(spark, sf_dir)


@query(f"WITH {PROBE} SELECT member, count(*) AS keys, count(*) FILTER (may_contain) AS passed FROM hit GROUP BY member")
def bloom_fp_rate(spark, sf_dir):
    return probed(spark, sf_dir).groupBy(F.col("key").startswith("part-").alias("member")).agg(F.count("*").alias("keys"), F.count_if("may_contain").alias("passed"))


# replication: an acknowledgement for every user of a customer key, right for even ones

Q = f"{C}, pending AS (SELECT key, seq, value FROM c WHERE NOT deleted QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1), acks AS (SELECT 'user-' || c_custkey AS key, CASE WHEN c_custkey % 2 = 0 THEN coalesce(p.value, '') ELSE 'other' END AS value FROM customer LEFT JOIN pending p ON p.key = 'user-' || c_custkey)"


def event_queue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    queue = replication.pending(event_changes(spark, sf_dir))
    asked = table(spark, sf_dir, "customer").select(F.concat(F.lit("user-"), F.col("c_custkey").cast("string")).alias("key"), "c_custkey")
    none = F.unhex(F.lit(""))
    acks = asked.join(queue, "key", "left").select("key", F.when(F.col("c_custkey") % 2 == 0, F.coalesce("value", none)).otherwise(F.encode(F.lit("other"), "UTF-8")).alias("value"))
    return queue, acks


@query(f"WITH {Q} SELECT * FROM pending")
def replication_pending(spark, sf_dir):
    return as_text(event_queue(spark, sf_dir)[0])


@query(f"WITH {Q} SELECT * FROM pending ORDER BY key LIMIT 1")
def replication_next(spark, sf_dir):
    return as_text(replication.next_pending(event_queue(spark, sf_dir)[0]))


@query(f"WITH {Q} SELECT a.key, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.value = a.value THEN 'ok' ELSE 'mismatch' END AS status FROM acks a LEFT JOIN pending p ON a.key = p.key")
def replication_ack(spark, sf_dir):
    return replication.ack_status(*event_queue(spark, sf_dir))


@query(f"WITH {Q} SELECT * FROM pending p WHERE NOT EXISTS (FROM acks a WHERE a.key = p.key AND a.value = p.value)")
def replication_after_ack(spark, sf_dir):
    _, acks = event_queue(spark, sf_dir)
    return as_text(replication.pending(event_changes(spark, sf_dir), acks))


@query(f"WITH {Q} SELECT * FROM pending")
def replica_state(spark, sf_dir):
    return as_text(replication.replica_state(event_changes(spark, sf_dir).where(~F.col("deleted"))))


@query(f"""WITH {Q} SELECT key, '{{"Key":"' || key || '","Value":"' || replace(replace(value, '\\', '\\\\'), '"', '\\"') || '","Err":null}}' AS message FROM pending""")
def replication_message(spark, sf_dir):
    return replication.message(event_queue(spark, sf_dir)[0])


# logs and tables


@query(f"""WITH {C} SELECT seq, CASE WHEN deleted THEN '01' ELSE '00' END || printf('%08X', octet_length(encode(key))) || hex(encode(key)) || CASE WHEN deleted THEN '0000000000000000' ELSE printf('%016X', octet_length(encode(value))) || hex(encode(value)) END AS record FROM c""")
def wal_encode_hex(spark, sf_dir):
    return event_changes(spark, sf_dir).select("seq", codec.record_hex(F.col("key"), F.col("value"), F.col("deleted")).alias("record"))


@query(f"WITH {C} SELECT key, row_number() OVER (PARTITION BY key ORDER BY seq) AS nth, CASE WHEN deleted THEN NULL ELSE value END AS value, deleted FROM c")
def wal_replay_order(spark, sf_dir):
    """The whole log written to files, a key's changes to one file, and read back in the order of the files."""
    path = scratch.scratch_path(spark, "wal")
    files.write_wal(event_changes(spark, sf_dir).repartition("key"), path)
    in_file = Window.partitionBy("key").orderBy("path", "pos")
    return files.read_wal(spark, path).select(F.decode("key", "UTF-8").alias("key"), F.row_number().over(in_file).cast("bigint").alias("nth"), F.decode("value", "UTF-8").alias("value"), "deleted")


@query(f"WITH {C} SELECT key, value, deleted FROM newest")
def sstable_roundtrip(spark, sf_dir):
    path = scratch.scratch_path(spark, "sst")
    files.write_sstables(lww.latest(event_changes(spark, sf_dir)), path)
    return files.read_sstables(spark, path).select(F.decode("key", "UTF-8").alias("key"), F.decode("value", "UTF-8").alias("value"), "deleted")


@query(f"WITH {C}, asked AS (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer) SELECT key, value, deleted FROM asked JOIN newest USING (key)")
def sstable_get(spark, sf_dir):
    """Asked keys through the table files' ranges, filters and blocks."""
    path = scratch.scratch_path(spark, "sst")
    files.write_sstables(lww.latest(event_changes(spark, sf_dir)), path)
    return as_text(files.get_from_sstables(spark, path, customer_keys(spark, sf_dir))).drop("path")


@query("""WITH RECURSIVE e AS (SELECT c_custkey // 500 AS run, 'customer:' || c_custkey AS key, (13 + octet_length(encode('customer:' || c_custkey)) + octet_length(encode(c_name)))::BIGINT AS size FROM customer),
n AS (SELECT run, key, row_number() OVER w AS i, sum(size) OVER (w ROWS UNBOUNDED PRECEDING) AS total, count(*) OVER (PARTITION BY run) AS last FROM e WINDOW w AS (PARTITION BY run ORDER BY key)),
cut AS (SELECT run, 1::BIGINT AS i, 0::HUGEINT AS before, 0 AS block, 0::HUGEINT AS offset_ FROM n GROUP BY run
UNION ALL SELECT * FROM (SELECT c.run, x.i + 1 AS i, x.total AS before, c.block + 1 AS block, c.offset_ + 12 + x.total - c.before AS offset_
FROM cut c JOIN n x ON x.run = c.run AND x.i >= c.i AND 4 + x.total - c.before >= 4096 QUALIFY row_number() OVER (PARTITION BY c.run ORDER BY x.i) = 1)),
ends AS (SELECT *, coalesce(lead(i) OVER (PARTITION BY run ORDER BY block) - 1, (SELECT max(last) FROM n WHERE n.run = cut.run)) AS e FROM cut)
SELECT ends.run::BIGINT AS run, block::INTEGER AS block, f.key AS first_key, offset_::BIGINT AS "offset", (12 + t.total - ends.before)::BIGINT AS length, (ends.e - ends.i + 1)::INTEGER AS entries
FROM ends JOIN n f ON f.run = ends.run AND f.i = ends.i JOIN n t ON t.run = ends.run AND t.i = ends.e""")
def block_index(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    entries = c.select(F.floor(F.col("c_custkey") / 500).alias("run"), F.concat(F.lit("customer:"), F.col("c_custkey").cast("string")).alias("key"), F.encode("c_name", "UTF-8").alias("value"))
    return files.block_index(entries)


@query(f"WITH {C} SELECT key, value FROM live")
def store_scan(spark, sf_dir):
    """The log applied to a store in five batches, each flushed to a run (the fourth run brings a merge), and read back."""
    kv = store.KeyValueStore(spark, scratch.scratch_path(spark, "store"))
    changes = event_changes(spark, sf_dir)
    top = changes.agg(F.max("seq")).first()[0] or 0
    for i in range(5):
        kv.apply(changes.where(F.floor(F.col("seq") * 5 / F.lit(top + 1)) == i))
        kv.flush()
    return as_text(kv.scan()).select("key", "value")


@query(f"WITH {C}, asked AS (SELECT DISTINCT 'user-' || c_custkey AS key FROM customer) SELECT key, value FROM asked LEFT JOIN live USING (key)")
def store_get(spark, sf_dir):
    return as_text(event_store(spark, sf_dir, flushed=True).get(customer_keys(spark, sf_dir)))


@query(f"WITH {Q} SELECT key, value FROM pending")
def store_put_on_replica(spark, sf_dir):
    """A store opened for reading takes replicated puts, into its data only."""
    kv = store.KeyValueStore(spark, scratch.scratch_path(spark, "store"), read_only=True)
    kv.put_on_replica(event_changes(spark, sf_dir).where(~F.col("deleted")).select("key", "value", "seq"))
    assert kv.next_pending().isEmpty()
    return as_text(kv.scan()).select("key", "value")


@query(f"WITH {C} SELECT row_number() OVER (ORDER BY key) AS nth, key, value FROM live ORDER BY key LIMIT 10")
def store_visit(spark, sf_dir):
    """A visitor that ends after ten keys."""
    seen: list[tuple] = []

    def visit(key: str, value: bytes) -> bool:
        seen.append((len(seen) + 1, key, value.decode()))
        return len(seen) < 10

    event_store(spark, sf_dir, flushed=True).foreach(visit)
    return spark.createDataFrame(seen, "nth bigint, key string, value string")


@query(f"WITH {C} SELECT key, value, log_segments, runs FROM live, (VALUES (1::BIGINT, 0::BIGINT), (0, 1)) v(log_segments, runs)")
def store_reopen(spark, sf_dir):
    """The store closed without a flush and opened again, its log read back; and the same after a flush emptied the log."""
    kv = event_store(spark, sf_dir)
    kv.close()
    again = store.KeyValueStore(spark, kv.root)

    def rows() -> DataFrame:
        return as_text(again.scan()).select("key", "value", F.lit(len(again.manifest.log)).cast("bigint").alias("log_segments"), F.lit(len(again.manifest.runs)).cast("bigint").alias("runs"))

    before = scratch.materialise(rows())
    again.flush()
    return lww.merge_runs(before, rows())


@query(f"WITH {Q}, a AS (SELECT a.key, CASE WHEN p.key IS NULL THEN 'missing' WHEN p.value = a.value THEN 'ok' ELSE 'mismatch' END AS status FROM acks a LEFT JOIN pending p ON a.key = p.key) SELECT status, count(*) AS keys FROM a GROUP BY status UNION ALL SELECT 'pending', count(*) FROM pending p WHERE NOT EXISTS (FROM acks a WHERE a.key = p.key AND a.value = p.value)")
def store_ack(spark, sf_dir):
    """Acknowledgements taken by a store: how many of each status, and how many keys wait afterwards."""
    kv = event_store(spark, sf_dir)
    status = kv.ack(event_queue(spark, sf_dir)[1]).groupBy("status").agg(F.count("*").alias("keys"))
    return status.unionByName(kv.pending().agg(F.lit("pending").alias("status"), F.count("*").alias("keys")))


@query(f"WITH {Q} SELECT key, value FROM pending")
def store_pending(spark, sf_dir):
    kv = store.KeyValueStore(spark, scratch.scratch_path(spark, "store"))
    kv.apply(event_changes(spark, sf_dir))
    return as_text(kv.pending()).select("key", "value")


# observation


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views and clicks read, purchases and signups write, errors are reads that failed."""
    e = table(spark, sf_dir, "events")
    return e.select("ts", F.when(F.col("event_type").isin("purchase", "signup"), "set").otherwise("get").alias("op"), (F.col("event_type") == "error").alias("failed"))


@query(f"WITH {C} SELECT count(*) FILTER (event_type IN ('view', 'click', 'error')) AS reads, count(*) FILTER (event_type IN ('purchase', 'signup')) AS writes, count(*) FILTER (event_type = 'error') AS errors, (SELECT count(*) FROM live) AS key_count, 'alpha' AS shard_name, 0 AS shard_idx FROM events")
def metrics_snapshot(spark, sf_dir):
    return metrics.snapshot(requests(spark, sf_dir), lww.key_count(event_changes(spark, sf_dir)), "alpha", 0)


@query("""WITH r AS (SELECT to_timestamp((floor(epoch(ts) / 2) * 2 + 2)::BIGINT) AT TIME ZONE 'UTC' AS t, event_type IN ('purchase', 'signup') AS w FROM events),
g AS (SELECT t, count(*) FILTER (NOT w) AS r, count(*) FILTER (w) AS w FROM r GROUP BY t),
s AS (SELECT t, sum(r) OVER (ORDER BY t)::BIGINT AS reads, sum(w) OVER (ORDER BY t)::BIGINT AS writes FROM g),
k AS (SELECT * FROM s ORDER BY t DESC LIMIT 30)
SELECT row_number() OVER (ORDER BY t)::INTEGER AS sample, strftime(t, '%Y-%m-%d %H:%M:%S') AS sample_end, reads, writes FROM k""")
def metrics_last30(spark, sf_dir):
    return metrics.samples(requests(spark, sf_dir))


@query("WITH s AS (SELECT event_id, floor(epoch(ts))::BIGINT - (SELECT min(floor(epoch(ts)))::BIGINT FROM events) AS n FROM events) SELECT event_id, (n // 3600) || 'h' || (n % 3600 // 60) || 'm' || (n % 60) || 's' AS since_start FROM s")
def uptime_text(spark, sf_dir):
    """Every event's time since the first, as the text that uptimes have."""
    e = table(spark, sf_dir, "events").select("event_id", F.floor(F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") / 1000000).alias("at"))
    first = e.agg(F.min("at")).first()[0] or 0
    return e.select("event_id", metrics.duration(F.col("at") - first).alias("since_start"))


# streams


def _event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    e = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*")
    return lww.puts(e, F.concat(F.lit("user-"), F.col("user_id").cast("string")), F.col("event_id"), F.col("props"), F.col("event_type") == "error")


@query(f"WITH {C} SELECT * FROM live")
def lww_stream(spark, sf_dir):
    path = scratch.scratch_path(spark, "stream")
    streams.write_latest(_event_stream(spark, sf_dir), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    streams.merge_batches(spark, f"{path}/out")
    return as_text(streams.read_latest(spark, f"{path}/out"))


@query(f"WITH {Q} SELECT * FROM pending")
def replica_stream(spark, sf_dir):
    path = scratch.scratch_path(spark, "replica")
    streams.replicate(_event_stream(spark, sf_dir), f"{path}/out", f"{path}/checkpoint").awaitTermination()
    return as_text(streams.read_latest(spark, f"{path}/out"))
