"""Sorted immutable runs: cutting a log into them, their zone maps, pruning and full merges."""

from __future__ import annotations

import heapq
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.operators import lww
from cairn.shipping import ship

FLUSH_BYTES = 4 << 20
MERGE_AT = 4
ZONES_AT_ONCE = 10_000


def cut_runs(changes: DataFrame, run: Column) -> DataFrame:
    """Each run's newest change per key: (run, key, seq, value, deleted).  ``run`` names a change's run, by ranges of seq as a rule."""
    newest = changes.withColumn("run", run).groupBy("run", "key").agg(F.max(F.struct("seq", "deleted", "value")).alias("v"))
    return newest.select("run", "key", "v.seq", "v.value", "v.deleted")


def zone_map(runs: DataFrame) -> DataFrame:
    """Smallest and largest key, entries and tombstones of every run."""
    return runs.groupBy("run").agg(F.min("key").alias("min_key"), F.max("key").alias("max_key"), F.count("*").alias("entries"), F.count_if("deleted").alias("tombstones"))


def layers_of(zones: Iterable[tuple[bytes, bytes]]) -> list[tuple[list[bytes], list[bytes], list[int]]]:
    """Ranges (low, high) in as few layers as hold no two that meet: the lows, highs and places of each layer, in the order of keys."""
    layers: list[tuple[list[bytes], list[bytes], list[int]]] = []
    ends: list[tuple[bytes, int]] = []
    for low, high, place in sorted((*z, i) for i, z in enumerate(zones)):
        at = heapq.heappop(ends)[1] if ends and ends[0][0] < low else len(layers)
        if at == len(layers):
            layers.append(([], [], []))
        for column, v in zip(layers[at], (low, high, place), strict=True):
            column.append(v)
        heapq.heappush(ends, (high, at))
    return layers


def candidate_runs(zones: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, run): the runs whose key range holds an asked key.

    Ranges lie in layers that each hold no two that meet (files of one write are one layer), and an asked key is searched in
    each layer by bisection, so it costs as much as ranges lie over each other, however many runs there are.
    At most ``ZONES_AT_ONCE`` are searched at a time, and the asked keys meet them in as many blocks as that takes.
    """
    ship(keys.sparkSession)
    known = zones.select("run", F.col("min_key").cast("binary").alias("low"), F.col("max_key").cast("binary").alias("high")).where("low IS NOT NULL")
    asked = keys.select("key").distinct().select("key", F.col("key").cast("binary").alias("raw")).where("raw IS NOT NULL")
    table = known.toArrow().sort_by("low").combine_chunks()  # one short row a run
    schema = T.StructType([T.StructField("key", keys.schema["key"].dataType), T.StructField("run", zones.schema["run"].dataType)])

    def search(part: pa.Table) -> DataFrame:
        names = pa.concat_arrays([pa.array([], part["run"].type), *part["run"].chunks])
        layers = layers_of(zip(part["low"].to_pylist(), part["high"].to_pylist(), strict=True))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows: list[int] = []
                found: list[int] = []
                raw = batch.column(1).to_pylist()
                for lows, highs, places in layers:
                    for i, key in enumerate(raw):
                        at = bisect_right(lows, key) - 1
                        if at >= 0 and key <= highs[at]:
                            rows.append(i)
                            found.append(places[at])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), names.take(pa.array(found, pa.int64()))], ["key", "run"])

        return asked.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, [search(table.slice(at, ZONES_AT_ONCE)) for at in range(0, max(1, table.num_rows), ZONES_AT_ONCE)])


def compact(runs: DataFrame) -> DataFrame:
    """All runs as one: the newest change of each key, without tombstones, as all runs take part."""
    return lww.live(runs.select("key", "seq", "value", "deleted"))


def flush_schedule(changes: Iterable[tuple[str, int, bool]], flush_bytes: int = FLUSH_BYTES, merge_at: int = MERGE_AT) -> Iterator[tuple[int, int, int]]:
    """Replays (key, value bytes, deleted) as one writer would and yields (flushes, live runs, file numbers used) after each flush.

    A tail is flushed once its newest versions hold ``flush_bytes``; a flush that makes ``merge_at`` runs merges
    them into one, which takes a file number of its own unless nothing live is left.
    """
    tail: dict[str, tuple[int, bool]] = {}
    runs: list[dict[str, bool]] = []
    size = flushes = files = 0
    for key, n, deleted in changes:
        width = len(key.encode())
        old = tail.get(key)
        size += (width + (0 if deleted else n)) - (width + (0 if old[1] else old[0]) if old else 0)
        tail[key] = (n, deleted)
        if size >= flush_bytes:
            runs.append({k: d for k, (_, d) in tail.items()})
            tail, size = {}, 0
            flushes, files = flushes + 1, files + 1
            if len(runs) >= merge_at:
                merged: dict[str, bool] = {}
                for r in runs:
                    merged.update(r)
                merged = {k: d for k, d in merged.items() if not d}
                runs = [merged] if merged else []
                files += bool(merged)
            yield flushes, len(runs), files
