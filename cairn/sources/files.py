"""Byte-exact log and table files: reading with Spark's own file access, writing through a Python data source.

``read_wal`` and ``read_sstables`` go through ``binaryFile``, so they read from
any store Spark can; a file is one task's work.  The writers begin a new file
once one holds ``FLUSH_BYTES``, so theirs are short; files of 2 GB and more, from elsewhere, can't be
read, as their records have no marks to split at.
"""

from __future__ import annotations

import itertools
import math
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from cairn.functions import bloom
from cairn.functions.codec import OVERHEAD, Record, decode_records, encode_record
from cairn.operators.runs import FLUSH_BYTES, candidate_runs
from cairn.shipping import ship
from cairn.sources.scratch import materialise

BLOCK_BYTES = 4096
KEYS_AT_ONCE = 100_000
FOOTER = struct.Struct(">5Q")
RATE = 0.01


class CorruptTable(ValueError):
    """A table file that is cut off or doesn't fit together."""


@dataclass
class BlockEntry:
    first_key: bytes
    offset: int
    length: int


@dataclass
class Table:
    blocks: list[BlockEntry]
    min_key: bytes
    max_key: bytes
    bloom: tuple[int, int, dict[int, int]]
    data: bytes

    def rows(self) -> Iterator[Record]:
        """All entries in the order of keys, tombstones too."""
        for b in self.blocks:
            yield from decode_block(self.data[b.offset : b.offset + b.length])

    @cached_property
    def words(self) -> np.ndarray:
        """The filter's 64-bit words, those of zero too."""
        m, _, words = self.bloom
        out = np.zeros((m + 63) // 64, np.uint64)
        out[np.fromiter(words.keys(), np.int64, len(words))] = np.fromiter(words.values(), np.uint64, len(words))
        return out

    @cached_property
    def first_keys(self) -> list[bytes]:
        return [b.first_key for b in self.blocks]

    def get(self, key: bytes) -> Record | None:
        """The entry of a key: out of range, or by the filter, or in the one block that can hold it."""
        return next((r for _, r in self.get_all([key])), None)

    def get_all(self, keys: list[bytes]) -> Iterator[tuple[int, Record]]:
        """(place among the keys, entry) of those that the table holds, as by :meth:`get`; the filter is asked for all of
        them at once, and a block is decoded once for all that it can hold."""
        asked = [i for i, key in enumerate(keys) if self.blocks and self.min_key <= key <= self.max_key]
        m, k, _ = self.bloom
        asked = list(itertools.compress(asked, bloom.may_contain(self.words, m, k, [keys[i] for i in asked]).tolist()))
        places: dict[int, list[int]] = {}
        for i in asked:
            places.setdefault(max(bisect_right(self.first_keys, keys[i]) - 1, 0), []).append(i)
        for at, those in places.items():
            b = self.blocks[at]
            entries = {r.key: r for r in reversed(decode_block(self.data[b.offset : b.offset + b.length]))}
            yield from ((i, entries[keys[i]]) for i in those if keys[i] in entries)


def _text(data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + data


def cut_blocks(sizes: Iterable[int], target: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """(entries, payload bytes) of each block: entries go in while the payload, its count included, is below the target."""
    n, payload = 0, 4
    for size in sizes:
        if payload >= target:
            yield n, payload
            n, payload = 0, 4
        n, payload = n + 1, payload + size
    if n:
        yield n, payload


def encode_table(entries: list[Record]) -> bytes:
    """A table file of entries that are sorted by key; ValueError without any."""
    if not entries:
        raise ValueError("a table needs entries")
    encoded = [encode_record(e) for e in entries]
    out, index, at = bytearray(), [], 0
    for n, payload in cut_blocks(map(len, encoded)):
        index.append(BlockEntry(entries[at].key, len(out), 8 + payload))
        out += struct.pack(">QI", payload, n) + b"".join(encoded[at : at + n])
        at += n
    body = _text(entries[0].key) + _text(entries[-1].key) + struct.pack(">I", len(index))
    body += b"".join(_text(b.first_key) + struct.pack(">QQ", b.offset, b.length) for b in index)
    index_at, index_len = len(out), 8 + len(body)
    out += struct.pack(">Q", len(body)) + body
    m, k = bloom.bloom_params(len(entries), RATE)
    packed = bloom.encode_filter(m, k, bloom.words_of([e.key for e in entries], m, k))
    bloom_at, bloom_len = len(out), 8 + len(packed)
    out += struct.pack(">Q", len(packed)) + packed
    out += FOOTER.pack(index_at, index_len, bloom_at, bloom_len, len(index))
    return bytes(out)


def decode_block(block: bytes) -> list[Record]:
    if len(block) < 12:
        raise CorruptTable("block cut off")
    payload, n = struct.unpack_from(">QI", block)
    if len(block) < 8 + payload:
        raise CorruptTable("block cut off")
    rows = [r for _, r in decode_records(block[12 : 8 + payload])]
    if len(rows) != n:
        raise CorruptTable("entries cut off")
    return rows


def decode_table(data: bytes) -> Table:
    if len(data) < FOOTER.size:
        raise CorruptTable("file too short")
    index_at, index_len, bloom_at, bloom_len, n = FOOTER.unpack(data[-FOOTER.size :])
    if index_at + index_len > len(data) or bloom_at + bloom_len > len(data):
        raise CorruptTable("index or filter cut off")
    at = index_at + 8

    def text() -> bytes:
        nonlocal at
        (size,) = struct.unpack_from(">I", data, at)
        at += 4 + size
        return data[at - size : at]

    try:
        low, high = text(), text()
        (count,) = struct.unpack_from(">I", data, at)
        at += 4
        blocks = []
        for _ in range(count):
            first = text()
            blocks.append(BlockEntry(first, *struct.unpack_from(">QQ", data, at)))
            at += 16
    except struct.error as e:
        raise CorruptTable("index cut off") from e
    if count != n:
        raise CorruptTable("index and footer differ")
    return Table(blocks, low, high, bloom.decode_filter(data[bloom_at + 8 : bloom_at + bloom_len]), data)


_ROWS = "path string, pos long, key binary, value binary, deleted boolean"


def _decoded(batches: Iterator[pa.RecordBatch], rows) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):  # one file at a time
            path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
            for part in itertools.batched(rows(content), 10_000):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(part)), pa.array([p for p, _ in part], pa.int64()), pa.array([r.key for _, r in part], pa.binary()), pa.array([r.value for _, r in part], pa.binary()), pa.array([r.deleted for _, r in part])],
                    ["path", "pos", "key", "value", "deleted"],
                )


def _files(spark: SparkSession, path: str, kind: str) -> DataFrame:
    ship(spark)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}").load(path).select("path", "content")


def read_wal(spark: SparkSession, path: str) -> DataFrame:
    """The complete records of every log file (suffix .log): path, pos (byte offset), key, value, deleted.  A torn tail is left out."""
    files = _files(spark, path, "log")
    return files.mapInArrow(lambda batches: _decoded(batches, decode_records), _ROWS)


def read_sstables(spark: SparkSession, path: str) -> DataFrame:
    """The entries of every table file (suffix .sst), tombstones too: path, pos (number in the file), key, value, deleted."""
    files = _files(spark, path, "sst")
    return files.mapInArrow(lambda batches: _decoded(batches, lambda c: enumerate(decode_table(c).rows())), _ROWS)


def sstable_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The block index of every table file: path, block, first_key, offset, length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                b = decode_table(content).blocks
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b)), pa.array(range(len(b)), pa.int32()), pa.array([x.first_key for x in b], pa.binary()), pa.array([x.offset for x in b], pa.int64()), pa.array([x.length for x in b], pa.int64())], ["path", "block", "first_key", "offset", "length"])

    files = _files(spark, path, "sst")
    return files.mapInArrow(run, "path string, block int, first_key binary, offset long, length long")


def get_from_sstables(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """(key, path, value, deleted) of the asked keys that table files hold: a file is read for the keys of its range only, its filter is asked, then one block.

    A file's keys are dealt to tasks of about ``KEYS_AT_ONCE``, which each get the file first and then read their keys as a stream.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                t = decode_table(batch.column(1)[i].as_py())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([t.min_key], pa.binary()), pa.array([t.max_key], pa.binary())], ["path", "min_key", "max_key"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, table = None, None
        for batch in batches:
            _, key, path, content = batch.columns
            starts = {0, batch.num_rows, *np.flatnonzero(path.is_valid().to_numpy(zero_copy_only=False)).tolist()}
            for at, end in itertools.pairwise(sorted(starts)):
                if path[at].is_valid:
                    name, table = path[at].as_py(), decode_table(content[at].as_py())
                    at += 1
                asked = key.slice(at, end - at)
                found = list(table.get_all(asked.cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays(
                    [asked.take(pa.array([i for i, _ in found], pa.int64())), pa.array([name] * len(found), pa.string()), pa.array([r.value for _, r in found], pa.binary()), pa.array([r.deleted for _, r in found], pa.bool_())],
                    ["key", "path", "value", "deleted"],
                )

    zones = _files(spark, path, "sst").mapInArrow(ranges, "path string, min_key binary, max_key binary").collect()  # one short row a file
    numbered = spark.createDataFrame([(i, z["min_key"], z["max_key"]) for i, z in enumerate(zones)], "run int, min_key binary, max_key binary")
    asked = materialise(candidate_runs(numbered, keys))
    dealt: list[tuple[int, str, int, int]] = []
    tasks = 0
    for r in asked.groupBy("run").count().collect():
        parts = math.ceil(r["count"] / KEYS_AT_ONCE)
        dealt.append((r["run"], zones[r["run"]]["path"], tasks, parts))
        tasks += parts
    plan = F.broadcast(spark.createDataFrame(dealt, "run int, path string, first int, parts int"))
    none = F.lit(None)
    tables = _files(spark, path, "sst").join(plan, "path").select(F.explode(F.sequence("first", F.col("first") + F.col("parts") - 1)).alias("task"), none.cast("string").alias("key"), "path", "content")
    wanted = asked.join(plan, "run").select((F.col("first") + F.pmod(F.xxhash64("key"), F.col("parts"))).cast("int").alias("task"), "key", none.cast("string").alias("path"), none.cast("binary").alias("content"))
    rows = tables.unionByName(wanted).repartitionById(max(tasks, 1), "task").sortWithinPartitions("task", F.col("key").asc_nulls_first())
    return rows.mapInArrow(find, "key string, path string, value binary, deleted boolean")


@dataclass
class _Written(WriterCommitMessage):
    names: list[str]


class _LogWriter(DataSourceWriter):
    """Log (or table) files named by the task, a new one after ``FLUSH_BYTES``; files appear whole and only the committed ones stay."""

    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def write(self, rows) -> _Written:
        import pyarrow.fs
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        names: list[str] = []

        def save(records: list[Record]) -> None:
            data = encode_table(records) if self.kind == "sst" else b"".join(map(encode_record, records))
            fs.create_dir(root, recursive=True)
            names.append(f"{root}/{context.partitionId():06d}-{len(names):06d}-{context.taskAttemptId()}.{self.kind}")
            with fs.open_output_stream(names[-1] + ".tmp") as f:
                f.write(data)

        held: list[Record] = []
        size = 0
        for r in rows:
            record = Record(bytes(r.key) if not isinstance(r.key, str) else r.key.encode(), None if r.value is None else bytes(r.value), bool(r.deleted))
            held.append(record)
            size += OVERHEAD + len(record.key) + len(record.value or b"")
            if size >= FLUSH_BYTES:
                save(held)
                held, size = [], 0
        if held:
            save(held)
        return _Written(names)

    def commit(self, messages) -> None:
        import pyarrow.fs

        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.move(name + ".tmp", name)

    def abort(self, messages) -> None:
        import pyarrow.fs

        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for m in messages:
            for name in m.names if m else ():
                fs.delete_file(name + ".tmp")


class ChangeFiles(DataSource):
    """``df.write.format("changefiles").option("kind", "log" | "sst").save(uri)`` for rows (key, value, deleted) in their order within a task."""

    @classmethod
    def name(cls) -> str:
        return "changefiles"

    def schema(self) -> str:
        return "key binary, value binary, deleted boolean"

    def writer(self, schema, overwrite) -> DataSourceWriter:
        return _LogWriter(self.options["path"], self.options.get("kind", "log"))


def write_wal(changes: DataFrame, uri: str) -> None:
    """Appends the changes, in order of ``seq`` within each task, to log files under a URI."""
    ship(changes.sparkSession)
    changes.sparkSession.dataSource.register(ChangeFiles)
    ordered = changes.sortWithinPartitions("seq").select(F.encode("key", "UTF-8").alias("key"), "value", "deleted")
    ordered.write.format("changefiles").option("kind", "log").mode("append").save(uri)


def write_sstables(newest: DataFrame, uri: str) -> None:
    """Writes rows with one version a key as table files under a URI, a file for each task's range of keys."""
    ship(newest.sparkSession)
    newest.sparkSession.dataSource.register(ChangeFiles)
    ordered = newest.repartitionByRange("key").sortWithinPartitions("key").select(F.encode("key", "UTF-8").alias("key"), "value", "deleted")
    ordered.write.format("changefiles").option("kind", "sst").mode("append").save(uri)


def block_index(entries: DataFrame, run: str = "run", target: int = BLOCK_BYTES) -> DataFrame:
    """The block index that each run of (run, key, value) would have: run, block, first_key, offset, length, entries.

    Packing is a fold in the order of keys, so a run is one task's work, read as a stream; a run is bounded by the flush threshold.
    """
    sized = entries.select(F.col(run).cast("long").alias("run"), "key", (F.lit(OVERHEAD) + F.octet_length(F.encode("key", "UTF-8")) + F.coalesce(F.octet_length("value"), F.lit(0))).cast("long").alias("size"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, offset, first, n, payload = None, 0, 0, None, 0, 4
        names = ["run", "block", "first_key", "offset", "length", "entries"]
        types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        for batch in batches:
            out: list[tuple] = []
            for r, key, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if n and (r != now or payload >= target):
                    out.append((now, block, first, offset, 8 + payload, n))
                    block, offset, n, payload = block + 1, offset + 8 + payload, 0, 4
                if r != now:
                    now, block, offset = r, 0, 0
                if not n:
                    first = key
                n, payload = n + 1, payload + size
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((now, block, first, offset, 8 + payload, n), types, strict=True)], names)

    ship(entries.sparkSession)
    return sized.repartition("run").sortWithinPartitions("run", "key").mapInArrow(fold, "run long, block int, first_key string, offset long, length long, entries int")
