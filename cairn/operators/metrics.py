"""Counters and samples over a log of requests (ts, op, failed)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE = "2 seconds"
KEPT_SAMPLES = 30


def duration(seconds: Column) -> Column:
    """Whole seconds as text, such as '2h3m4s'."""
    total = seconds.cast("bigint")
    return F.format_string("%dh%dm%ds", F.floor(total / 3600).cast("bigint"), F.floor(total % 3600 / 60).cast("bigint"), total % 60)


def uptime(started: Column) -> Column:
    """Time since ``started`` (seconds since the epoch) as text."""
    return duration(F.floor(F.unix_micros(F.current_timestamp()) / 1000000 - started))


def counters(requests: DataFrame) -> DataFrame:
    """Reads, writes and errors.  Attempts count, failed ones too; a missing key is no error."""
    return requests.agg(F.count_if(F.col("op") == "get").alias("reads"), F.count_if(F.col("op") == "set").alias("writes"), F.count_if("failed").alias("errors"))


def snapshot(requests: DataFrame, key_count: DataFrame, shard_name: str, shard_idx: int, uptime: Column | None = None) -> DataFrame:
    """One row: the counters, the number of live keys and the shard; with ``uptime`` that too."""
    row = counters(requests).withColumn("one", F.lit(1)).join(key_count.withColumn("one", F.lit(1)), "one")  # one row each
    columns = ["reads", "writes", "errors", "key_count", F.lit(shard_name).alias("shard_name"), F.lit(shard_idx).alias("shard_idx")]
    return row.select(*([uptime.alias("uptime")] if uptime is not None else []), *columns)


def snapshot_json(snap: DataFrame) -> DataFrame:
    return snap.select(F.to_json(F.struct(*snap.columns)).alias("snapshot"))


def samples(requests: DataFrame, every: str = SAMPLE, kept: int = KEPT_SAMPLES) -> DataFrame:
    """The last samples: (sample, reads, writes), cumulative at the end of each interval that has requests.

    Requests are counted per interval first.  Only the last intervals are ordered; what came before them is one sum, so no
    task sees all intervals.
    """
    per = requests.groupBy(F.window("ts", every).getField("end").alias("end")).agg(F.count_if(F.col("op") == "get").alias("r"), F.count_if(F.col("op") == "set").alias("w"))
    last = per.orderBy(F.col("end").desc()).limit(kept)
    total = per.agg(F.sum("r").alias("all_r"), F.sum("w").alias("all_w"))  # one row
    later = Window.orderBy(F.col("end").desc()).rowsBetween(Window.unboundedPreceding, -1)  # over ``kept`` rows
    shown = last.withColumns({"later_r": F.coalesce(F.sum("r").over(later), F.lit(0)), "later_w": F.coalesce(F.sum("w").over(later), F.lit(0)), "sample": F.row_number().over(Window.orderBy("end"))})
    summed = shown.crossJoin(F.broadcast(total))  # one row
    return summed.select("sample", F.date_format("end", "yyyy-MM-dd HH:mm:ss").alias("sample_end"), (F.col("all_r") - F.col("later_r")).alias("reads"), (F.col("all_w") - F.col("later_w")).alias("writes"))
