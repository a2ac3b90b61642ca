"""Consistent-hash routing: ring points, arcs, owners, shard movement, purges.

A shard has ``VNODES`` points, the FNV-1a hashes of "index-number"; a key belongs
to the shard of the first point at or after its hash, wrapping around to the
first.  Hashes are held as ``h - 2**63`` (see :mod:`cairn.functions.hashing`), so
arcs are plain ranges of BIGINT; the arc that wraps around is two ranges.

A ring is made from the configuration alone (150 points a shard), so its arcs
are small whatever the data's size, and a lookup is a broadcast hash join: arcs
and keys meet on the leading bits of the hash.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions.hashing import HALF, fnv1a, fnv1a_py, unsigned

VNODES = 150
#: Leading bits by which arcs and hashes meet.
PREFIX_BITS = 12
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


@dataclass(frozen=True)
class Shard:
    name: str
    idx: int
    address: str


class ShardConfigError(ValueError):
    """A shard list that can't be used."""


@dataclass(frozen=True)
class Shards:
    count: int
    current: int
    addresses: dict[int, str]


def parse_config(text: str) -> list[Shard]:
    """The shards of a TOML configuration (tables ``shards`` with name, idx, address; other fields are ignored)."""
    return [Shard(str(s.get("name", "")), int(s.get("idx", 0)), str(s.get("address", ""))) for s in tomllib.loads(text).get("shards", [])]


def parse_shards(shards: list[Shard], current: str) -> Shards:
    """The shards by number.  Their numbers must be 0..N-1, each once, and ``current`` a name among them; an error tells all that is wrong."""
    numbers = sorted(s.idx for s in shards)
    own = [s.idx for s in shards if s.name == current]
    faults = []
    if numbers != list(range(len(shards))):
        faults.append(f"numbers must be 0 to {len(shards) - 1}, each once, but are {numbers}")
    if not own:
        faults.append(f"no shard has the name {current!r}")
    if faults:
        raise ShardConfigError("; ".join(faults))
    return Shards(len(shards), own[-1], {s.idx: s.address for s in shards})


def ring_points(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int]]:
    """(unsigned hash, shard) in order; where two points coincide the later index has it."""
    points: dict[int, int] = {}
    for idx in range(n_shards):
        for v in range(vnodes if vnodes > 0 else VNODES):
            points[fnv1a_py(f"{idx}-{v}")] = idx
    return sorted(points.items())


def ring_arcs(n_shards: int, vnodes: int = VNODES) -> list[tuple[int, int, int]]:
    """(low, high, shard): ranges of signed hashes, both ends included, that cover everything."""
    points = [(h - HALF, s) for h, s in ring_points(n_shards, vnodes)]
    if not points:
        return [(LOWEST, HIGHEST, 0)]
    arcs, low = [], LOWEST
    for h, s in points:
        arcs.append((low, h, s))
        low = h + 1
    if low <= HIGHEST:
        arcs.append((low, HIGHEST, points[0][1]))
    return arcs


def arcs_frame(spark: SparkSession, n_shards: int, vnodes: int = VNODES) -> DataFrame:
    return spark.createDataFrame(ring_arcs(n_shards, vnodes), "low bigint, high bigint, shard int")


def points_frame(spark: SparkSession, n_shards: int, vnodes: int = VNODES) -> DataFrame:
    """(idx, vnode, hash) of every label, hashed by Spark."""
    each = vnodes if vnodes > 0 else VNODES
    idx, vnode = F.expr(f"cast(id div {each} as int)"), (F.col("id") % each).cast("int")
    return spark.range(n_shards * each).select(idx.alias("idx"), vnode.alias("vnode"), fnv1a(F.concat_ws("-", idx.cast("string"), vnode.cast("string"))).alias("hash"))


def with_owner(df: DataFrame, n_shards: int, key: str = "key", vnodes: int = VNODES, into: str = "shard", hash_col: str | None = None) -> DataFrame:
    """``df`` with the shard that owns its key, null for a null key.  Rows are not shuffled.

    The join is an outer one as arcs cover everything: an inner one would have Spark test the hash for null first, and so hash twice.
    """
    spark = df.sparkSession
    shift = 64 - PREFIX_BITS
    arcs = arcs_frame(spark, n_shards, vnodes).select("*", F.explode(F.sequence(F.shiftright("low", shift), F.shiftright("high", shift))).alias("__prefix"))
    arcs = arcs.select(F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("shard").alias(into), "__prefix")
    hashed = df.withColumn("__hash", F.col(hash_col) if hash_col else fnv1a(F.col(key))).withColumn("__at", F.shiftright("__hash", shift))
    # 150 points a shard and 4096 prefixes: bounded by the configuration
    return hashed.join(F.broadcast(arcs), (F.col("__at") == F.col("__prefix")) & F.col("__hash").between(F.col("__low"), F.col("__high")), "left").drop("__hash", "__at", "__low", "__high", "__prefix")


def to_owners(df: DataFrame, n_shards: int, key: str = "key", vnodes: int = VNODES) -> DataFrame:
    """``df`` with ``shard``, its rows moved so that every shard's lie together, in partitions of their own.

    A partition holds a part of one shard's range of hashes, so a shard with most of the keys is spread over as many as it needs.
    """
    owned = with_owner(df.withColumn("__place", fnv1a(F.col(key))), n_shards, key, vnodes, hash_col="__place")
    return owned.repartitionByRange("shard", "__place").drop("__place")


def modulo_owner(key: Column, n_shards: int) -> Column:
    """The owner without a ring: unsigned hash modulo the number of shards."""
    return (unsigned(fnv1a(key)) % F.lit(n_shards).cast("decimal(20,0)")).cast("int")


def arc_shares(spark: SparkSession, n_shards: int, vnodes: int = VNODES) -> DataFrame:
    """(shard, arcs, share_ppm): how much of the hash space each shard owns, in millionths rounded down."""
    width = F.col("high").cast("decimal(38,0)") - F.col("low").cast("decimal(38,0)") + F.lit(1).cast("decimal(38,0)")
    total = arcs_frame(spark, n_shards, vnodes).groupBy("shard").agg(F.count("*").alias("arcs"), F.sum(width.cast("decimal(24,0)")).alias("width"))
    return total.select("shard", "arcs", F.floor(F.col("width") * F.lit(Decimal(1000000)) / F.lit(Decimal(1 << 64))).cast("bigint").alias("share_ppm"))


def movement(keys: DataFrame, before: int, after: int, key: str = "key") -> DataFrame:
    """(from_shard, to_shard, keys): how many keys each change of the ring moves or leaves."""
    both = with_owner(with_owner(keys.select(key, fnv1a(F.col(key)).alias("__h")), before, key, into="from_shard", hash_col="__h"), after, key, into="to_shard", hash_col="__h")
    return both.groupBy("from_shard", "to_shard").agg(F.count("*").alias("keys"))


def foreign_keys(live: DataFrame, n_shards: int, current: int) -> DataFrame:
    """The live rows (or keys) that belong to another shard, with their owner."""
    return with_owner(live, n_shards).where(F.col("shard") != current)


def route_report(requests: DataFrame, shards: list[Shard], current: int) -> DataFrame:
    """(shard, name, address, redirected, requests): where requests for keys go and whether another shard answers them."""
    names = requests.sparkSession.createDataFrame([(s.idx, s.name, s.address) for s in shards], "shard int, name string, address string")
    counted = with_owner(requests, len(shards)).groupBy("shard").agg(F.count("*").alias("requests"))
    return counted.join(F.broadcast(names), "shard").select("shard", "name", "address", (F.col("shard") != current).alias("redirected"), "requests")
