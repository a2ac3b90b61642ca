"""The relational core: the newest version of every key wins, tombstones hide keys.

A change is (key STRING, seq BIGINT, value BINARY, deleted BOOLEAN).  Order is
that of ``seq``, never that of arrival.  Among changes of one key with equal
``seq`` a delete wins, then the larger value, so results don't depend on how a
log is cut or ordered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHANGE = T.StructType([T.StructField("key", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("value", T.BinaryType()), T.StructField("deleted", T.BooleanType())])


def puts(df: DataFrame, key: Column, seq: Column, value: Column, deleted: Column | None = None) -> DataFrame:
    """Any table as a change log.  A put's null value is the empty value; a delete has none."""
    gone = F.lit(False) if deleted is None else F.coalesce(deleted, F.lit(False))
    data = F.coalesce(value.cast("binary"), F.unhex(F.lit("")))
    return df.select(key.cast("string").alias("key"), seq.cast("bigint").alias("seq"), F.when(~gone, data).alias("value"), gone.alias("deleted"))


def latest(changes: DataFrame) -> DataFrame:
    """The newest change of every key, tombstones included.  Changes are combined before the one shuffle."""
    newest = changes.groupBy("key").agg(F.max(F.struct("seq", "deleted", "value")).alias("v"))
    return newest.select("key", "v.seq", "v.value", "v.deleted")


def live(changes: DataFrame) -> DataFrame:
    """(key, seq, value) of the keys that exist.  Tombstones go only after the newest change is known."""
    return latest(changes).where(~F.col("deleted")).drop("deleted")


def newest_marks(changes: DataFrame) -> DataFrame:
    """(key, mark): ``2 * seq + deleted`` of the newest change of every key, for what needs no value: one BIGINT is
    aggregated by hash, and values are neither read nor moved.  ``seq`` must be within 62 bits."""
    return changes.groupBy("key").agg(F.max(F.col("seq") * 2 + F.col("deleted").cast("bigint")).alias("mark"))


def live_keys(changes: DataFrame) -> DataFrame:
    """(key, seq) of the keys that exist, without their values."""
    return newest_marks(changes).where(F.col("mark").bitwiseAND(F.lit(1)) == 0).select("key", F.shiftright("mark", 1).alias("seq"))


def merge_runs(*runs: DataFrame) -> DataFrame:
    """All runs as one log; :func:`latest` of it is their merge."""
    return reduce(DataFrame.unionByName, runs)


def point_get(changes: DataFrame, key: str) -> DataFrame:
    """The live row of one key, or none.  The filter on the grouping key reaches the scan."""
    return live(changes.where(F.col("key") == key))


def get(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, value) of every asked key; a missing or deleted key has a null value and is no error."""
    return keys.select("key").distinct().join(live(changes).select("key", "value"), "key", "left")


def lookup_state(changes: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, state, value): 'live', 'deleted' or 'missing' for every asked key."""
    found = keys.select("key").distinct().join(latest(changes), "key", "left")
    state = F.when(F.col("deleted").isNull(), "missing").when(F.col("deleted"), "deleted").otherwise("live")
    return found.select("key", state.alias("state"), "value")


def scan(changes: DataFrame) -> DataFrame:
    """All live rows in the byte order of keys."""
    return live(changes).orderBy("key")


def first_key(changes: DataFrame) -> DataFrame:
    """The live row with the smallest key."""
    return live(changes).orderBy("key").limit(1)


def key_count(changes: DataFrame) -> DataFrame:
    return live_keys(changes).agg(F.count("*").alias("key_count"))


def memtable_size(changes: DataFrame) -> DataFrame:
    """Bytes of keys and values of the newest changes, and their number; tombstones count with their key."""
    size = F.octet_length(F.encode("key", "UTF-8")) + F.coalesce(F.octet_length("value"), F.lit(0))
    return latest(changes).agg(F.coalesce(F.sum(size), F.lit(0)).cast("bigint").alias("bytes"), F.count("*").alias("entries"), F.count_if("deleted").alias("tombstones"))


def delete_where(changes: DataFrame, predicate: Column, seq: Column) -> DataFrame:
    """Tombstones for the live keys that satisfy a predicate on ``key``."""
    return live_keys(changes).where(predicate).select("key", seq.cast("bigint").alias("seq"), F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted"))
