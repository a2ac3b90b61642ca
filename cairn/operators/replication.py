"""The replication queue: the newest put of every key that no replica has acknowledged.

The queue is keyed and coalescing: of several puts of a key only the last is
pending, in the order of keys.  Deletes are not queued.  An acknowledgement names
the key and the value that was applied; it takes effect only while that value is
the pending one, so a newer put stays pending.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import lww


def pending(changes: DataFrame, acks: DataFrame | None = None) -> DataFrame:
    """(key, seq, value) that wait, after the acknowledgements (key, value)."""
    queue = lww.latest(changes.where(~F.col("deleted"))).select("key", "seq", "value")
    if acks is None:
        return queue
    return queue.join(acks.select("key", "value").distinct(), ["key", "value"], "left_anti")


def next_pending(queue: DataFrame) -> DataFrame:
    """The pending row with the smallest key; the empty key is a key like any other."""
    return queue.orderBy("key").limit(1)


def ack_status(queue: DataFrame, acks: DataFrame) -> DataFrame:
    """(key, status) of every acknowledgement: 'ok', 'missing' (nothing pending) or 'mismatch' (another value is)."""
    held = queue.select("key", F.col("value").alias("held"))
    status = F.when(F.col("held").isNull(), "missing").when(F.col("held") == F.col("value"), "ok").otherwise("mismatch")
    return acks.join(held, "key", "left").select("key", status.alias("status"))


def replica_state(applied: DataFrame) -> DataFrame:
    """The replica's rows after it applied puts, in any order and any number of times."""
    return lww.live(applied)


def message(queue: DataFrame) -> DataFrame:
    """(key, message): the JSON a replica receives for a pending row."""
    return queue.select("key", F.to_json(F.struct(F.col("key").alias("Key"), F.decode("value", "UTF-8").alias("Value"), F.lit(None).cast("string").alias("Err")), {"ignoreNullFields": "false"}).alias("message"))
