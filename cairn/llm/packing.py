"""Best-fit packing of documents into bins under conflicts.

Items go, largest first, into the open bin that they leave with the least room,
found by a successor search in the order of residual room.  Every bin carries
bitmaps: one of the clusters of duplicates in it, and ``per_source`` layers of
the sources in it (a source's nth document sets its bit in layer n).  A bin that
holds the item's cluster, or whose last layer has the item's source, conflicts,
and the search goes on to the next bin of that room, in the order of their numbers, then to the next larger room, until a compatible bin is found;
without one a new bin opens.

A document longer than a bin is cut: whole bins first, and its rest is an item.
Lengths are bytes of UTF-8.

Items are dealt by a hash to shards of about ``SHARD`` items, so a task's memory
is bounded and a large group of copies is spread over all shards.

Edge cases: null and empty texts have length 0 and no bin (null); null sources
count as one source; equal lengths go in the order of their keys; rows that
repeat a key and a text are items each; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import named
from cairn.shipping import ship

CAPACITY = 16_384
PER_SOURCE = 4
SHARD = 4_096


class Packer:
    """The bins of one shard."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.layers = capacity, per_source
        self.rooms = 0  # bit r: some bin has room r
        self.with_room: dict[int, list[int]] = {}
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.cluster_bits: dict = {}
        self.source_bits: dict = {}
        self.opened = 0

    def place(self, length: int, source, cluster) -> tuple[int, int]:
        """(bin, offset in it) of an item of 1..capacity bytes."""
        c = 1 << self.cluster_bits.setdefault(cluster, len(self.cluster_bits))
        s = 1 << self.source_bits.setdefault(source, len(self.source_bits))
        rooms = self.rooms >> length
        base = length
        while rooms:
            step = (rooms & -rooms).bit_length() - 1
            room = base + step
            bins = self.with_room[room]
            for i, b in enumerate(bins):
                if not self.clusters[b] & c and not self.sources[b][-1] & s:
                    del bins[i]
                    if not bins:
                        self.rooms ^= 1 << room
                    self._add(b, room - length, c, s)
                    return b, self.capacity - room
            rooms >>= step + 1
            base = room + 1
        b = self.open()
        self._add(b, self.capacity - length, c, s)
        return b, 0

    def open(self) -> int:
        self.clusters.append(0)
        self.sources.append([0] * self.layers)
        self.opened += 1
        return self.opened - 1

    def _add(self, b: int, room: int, c: int, s: int) -> None:
        self.clusters[b] |= c
        for i in range(self.layers):
            if not self.sources[b][i] & s:
                self.sources[b][i] |= s
                break
        if room:
            bisect.insort(self.with_room.setdefault(room, []), b)
            self.rooms |= 1 << room


def pack(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """The pieces of every row: key, source, ``piece`` (from 0), ``start`` and ``length`` (bytes of the text), ``bin_id``, ``bin_offset``.

    ``cluster`` names an item's group of duplicates; by default that of equal texts.
    """
    ship(df.sparkSession)
    group = F.xxhash64(named(text)) if cluster is None else cluster
    items = df.select(named(key).alias("key"), named(source).alias("source"), F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long").alias("length"), group.alias("cluster"))
    shards = max(1, math.ceil(df.count() / shard))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("key", "cluster", F.lit(5)), F.lit(shards)).cast("int"))
    full = F.floor(F.col("length") / capacity).cast("long")
    dealt = dealt.withColumn("full", full).withColumn("rest", F.col("length") - full * capacity)
    kinds = {c: dealt.schema[c].dataType.simpleString() for c in ("key", "source")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "source", "piece", "start", "length", "bin_id", "bin_offset"]
        now, packer = None, None
        for batch in batches:
            rows: list[list] = [[] for _ in names]
            take: list[int] = []
            shards_, fulls, rests, lengths, sources, clusters = (batch.column(i).to_pylist() for i in (2, 3, 4, 5, 1, 6))
            for i, (where, whole, rest, length, src, dup) in enumerate(zip(shards_, fulls, rests, lengths, sources, clusters, strict=True)):
                if where != now:
                    now, packer = where, Packer(capacity, per_source)
                made: list[tuple] = [(p, p * capacity, capacity, packer.open(), 0) for p in range(whole)]
                if rest:
                    made.append((whole, whole * capacity, rest, *packer.place(rest, src, dup)))
                elif not length:
                    made.append((0, 0, 0, None, None))
                for p, start, size, b, offset in made:
                    take.append(i)
                    for column, value in zip(rows[2:], (p, start, size, None if b is None else now << 40 | b, offset), strict=True):
                        column.append(value)
            picked = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(rows[2], pa.int32()), *[pa.array(c, pa.int64()) for c in rows[3:]]], names)

    ordered = dealt.select("key", "source", "shard", "full", "rest", "length", "cluster").repartition("shard").sortWithinPartitions("shard", F.col("rest").desc(), "key", "cluster")
    out = ordered.mapInArrow(run, f"key {kinds['key']}, source {kinds['source']}, piece int, start long, length long, bin_id long, bin_offset long")
    return out.withColumnsRenamed({"key": key, "source": source})
