"""A versioned key-value store on sorted Parquet runs with a manifest.

Layout under the root: ``log/`` (appended changes not yet in a run),
``runs/`` (sorted runs), ``queue/`` (puts and acknowledgements for
replicas), ``acks/`` (answers to acknowledgements) and ``manifest-<version>.json``.  A change is visible once a manifest
names it.  A manifest is written under a temporary name and renamed, and the
rename fails where the version exists, so commits are atomic and a second writer
that was too late sees :class:`Conflict`.  Data files are never changed in place
and go only after the manifest that drops them is in place.

A write that brings the log's newest changes to ``flush_bytes`` flushes it to a
run, and a flush that makes ``merge_at`` runs merges them.

All data moves as DataFrames; the driver handles file names only.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators import lww, metrics, replication, ring, runs
from cairn.sources.scratch import materialise

SCHEMA = lww.CHANGE


class ReadOnly(RuntimeError):
    """A write to a store that was opened read-only."""


class Conflict(RuntimeError):
    """Another writer committed first."""


class Closed(RuntimeError):
    """The store was closed."""


@dataclass
class Manifest:
    version: int = 0
    next_seq: int = 1
    next_file: int = 1
    log: list[str] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)  # newest first
    queue: list[str] = field(default_factory=list)
    log_bytes: int = 0  # of keys and values in the log, superseded ones too


class KeyValueStore:
    def __init__(self, spark: SparkSession, root: str, read_only: bool = False, merge_at: int = runs.MERGE_AT, flush_bytes: int = runs.FLUSH_BYTES, shards: list[ring.Shard] | None = None, current: int = 0) -> None:
        self.spark, self.root, self.read_only, self.merge_at, self.flush_bytes = spark, root.rstrip("/"), read_only, merge_at, flush_bytes
        self.shards, self.current = shards, current
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.root))
        self.closed = False
        self.started = time.time()
        self.reads = self.writes = self.errors = 0  # attempts through this handle
        self.manifest = self._load()

    # manifests

    def _load(self) -> Manifest:
        versions = [int(n[9:-5]) for s in self._fs.listStatus(self._path(self.root)) if (n := s.getPath().getName()).startswith("manifest-") and n.endswith(".json")]
        if not versions:
            return Manifest()
        text = self.spark.read.text(f"{self.root}/manifest-{max(versions)}.json", wholetext=True).first()[0]
        return Manifest(**json.loads(text))

    def _commit(self, new: Manifest, drop: list[str] = ()) -> None:
        new.version = self.manifest.version + 1
        final, temp = f"{self.root}/manifest-{new.version}.json", f"{self.root}/.manifest-{new.version}-{id(new)}.tmp"
        out = self._fs.create(self._path(temp), True)
        out.write(bytearray(json.dumps(asdict(new)).encode()))
        out.close()
        if self._fs.exists(self._path(final)) or not self._fs.rename(self._path(temp), self._path(final)):
            self._fs.delete(self._path(temp), False)
            raise Conflict(f"version {new.version} exists")
        self.manifest = new
        for p in drop:
            self._fs.delete(self._path(f"{self.root}/{p}"), True)

    def _next(self) -> Manifest:
        if self.closed:
            raise Closed("the store is closed")
        return Manifest(**asdict(self.manifest))

    def _frame(self, parts: list[str]) -> DataFrame:
        if self.closed:
            raise Closed("the store is closed")
        if not parts:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.root}/{p}" for p in parts])

    @staticmethod
    def _name(kind: str, manifest: Manifest) -> str:
        """A new data folder; no other writer's, whoever commits first."""
        return f"{kind}/{manifest.next_file:06d}-{uuid.uuid4().hex[:8]}"

    # writes

    def _append(self, changes: DataFrame, queued: bool) -> None:
        self.writes += 1
        try:
            self._write(changes, queued)
        except Exception:
            self.errors += 1
            raise

    def _refuse_read_only(self) -> None:
        if self.read_only:
            self.writes += 1
            self.errors += 1
            raise ReadOnly(f"{self.root} was opened for reading")

    def _write(self, changes: DataFrame, queued: bool) -> None:
        new = self._next()
        part = self._name("log", new)
        # rows keep the order of ``seq`` where the batch has one, and get numbers after all earlier ones
        order = F.col("seq") if "seq" in changes.columns else F.monotonically_increasing_id()
        base = changes.withColumn("seq", order + F.lit(new.next_seq))
        rows = base.select(F.col("key").cast("string").alias("key"), F.col("seq").cast("bigint").alias("seq"), F.when(~F.col("deleted"), F.coalesce(F.col("value").cast("binary"), F.unhex(F.lit("")))).alias("value"), "deleted")
        rows.write.parquet(f"{self.root}/{part}")
        written = self._frame([part])
        top, size = written.agg(F.max("seq"), F.sum(F.octet_length(F.encode("key", "UTF-8")) + F.coalesce(F.octet_length("value"), F.lit(0)))).first()
        new.log_bytes += size or 0
        new.next_file += 1
        new.next_seq = max(new.next_seq, (top if top is not None else new.next_seq - 1) + 1)
        new.log.append(part)
        if queued:
            queue = part.replace("log/", "queue/")
            written.where(~F.col("deleted")).write.parquet(f"{self.root}/{queue}")
            new.queue.append(queue)
        self._commit(new)
        # what the log has in all bounds its newest changes from above, which are counted only beyond the threshold
        if self.manifest.log_bytes >= self.flush_bytes and lww.memtable_size(self._frame(self.manifest.log)).first()["bytes"] >= self.flush_bytes:
            self.flush()

    def set_flush_threshold(self, flush_bytes: int) -> None:
        """From the next write on, the log is flushed once its newest changes hold so many bytes; numbers below 1 change nothing."""
        if flush_bytes > 0:
            self.flush_bytes = flush_bytes

    def put(self, rows: DataFrame) -> None:
        """Writes (key, value[, seq]); data and queue are one commit."""
        self._refuse_read_only()
        self._append(rows.withColumn("deleted", F.lit(False)), queued=True)

    def apply(self, changes: DataFrame) -> None:
        """Writes a batch of puts and deletes (key, seq, value, deleted), in the order of its ``seq``."""
        self._refuse_read_only()
        self._append(changes, queued=True)

    def put_on_replica(self, rows: DataFrame) -> None:
        """Applies replicated puts: to the data only, read-only or not."""
        self._append(rows.withColumn("deleted", F.lit(False)), queued=False)

    def delete(self, keys: DataFrame) -> None:
        """Tombstones for keys, whether they exist or not.  Replicas aren't told."""
        self._refuse_read_only()
        columns = ["key", *[c for c in keys.columns if c == "seq"]]
        self._append(keys.select(*columns, F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted")), queued=False)

    def delete_where(self, predicate: Column) -> None:
        """Tombstones for the live keys that satisfy a predicate on ``key``."""
        self._refuse_read_only()
        self.delete(lww.live_keys(self.changes()).where(predicate).select("key"))

    def purge(self) -> None:
        """Deletes the keys that belong to another shard."""
        self._refuse_read_only()
        self.delete(ring.foreign_keys(lww.live_keys(self.changes()), len(self.shards or []), self.current).select("key"))

    def hand_over(self, others: dict[int, KeyValueStore]) -> None:
        """Puts the rows of other shards into their stores, by shard number, and then deletes them here; rows of a shard that isn't given stay."""
        self._refuse_read_only()
        rows = materialise(ring.to_owners(lww.live(self.changes()), len(self.shards or [])).where(F.col("shard").isin([n for n in others if n != self.current])))
        for number in sorted(n for n in others if n != self.current):
            others[number].put(rows.where(F.col("shard") == number).select("key", "value"))
        self.delete(rows.select("key"))

    # reads

    def changes(self) -> DataFrame:
        """All changes that are stored."""
        return self._frame(self.manifest.runs + self.manifest.log)

    def get(self, keys: DataFrame) -> DataFrame:
        """(key, value) of every asked key; null for a missing one, which is no error."""
        self.reads += 1
        return lww.get(self.changes(), keys)

    def get_one(self, key: str) -> bytes | None:
        self.reads += 1
        row = lww.point_get(self.changes(), key).first()
        return None if row is None else bytes(row["value"])

    def scan(self) -> DataFrame:
        return lww.scan(self.changes())

    def key_count(self) -> int:
        return lww.key_count(self.changes()).first()[0]

    def foreach(self, visit, limit: int | None = None) -> None:
        """Calls ``visit(key, value)`` in the order of keys until it returns False; rows arrive a partition at a time."""
        rows = self.scan() if limit is None else self.scan().limit(limit)
        for r in rows.toLocalIterator():
            if visit(r["key"], bytes(r["value"])) is False:
                break

    def route(self, keys: DataFrame) -> DataFrame:
        """(key, shard, current, address): who owns each key, and whether that is this shard."""
        shards = self.shards or []
        names = self.spark.createDataFrame([(x.idx, x.address) for x in shards], "shard int, address string")
        owned = ring.with_owner(keys.select("key").distinct(), len(shards))
        return owned.join(F.broadcast(names), "shard", "left").select("key", "shard", (F.col("shard") == self.current).alias("current"), "address")  # one row a shard

    # maintenance

    def _write_run(self, rows: DataFrame, part: str) -> bool:
        """Writes a run sorted by key with a Bloom filter on it; False (and nothing) if it is empty.  The rows are computed once: ranges are sampled from what was stored."""
        rows = materialise(rows)
        if rows.isEmpty():
            return False
        options = {"parquet.bloom.filter.enabled#key": "true", "parquet.bloom.filter.fpp#key": "0.01"}
        rows.repartitionByRange("key").sortWithinPartitions("key").write.options(**options).parquet(f"{self.root}/{part}")
        return True

    def flush(self) -> None:
        """Moves the log's newest changes to a new run, tombstones too; merges once there are ``merge_at`` runs.  Nothing to do for an empty log."""
        new = self._next()
        if not new.log:
            return
        part = self._name("runs", new)
        if self._write_run(lww.latest(self._frame(new.log)), part):
            new.runs.insert(0, part)
            new.next_file += 1
        old, new.log, new.log_bytes = new.log, [], 0
        self._commit(new, old)
        if len(self.manifest.runs) >= self.merge_at:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one without tombstones; fewer than two stay as they are, and a merge with nothing live leaves none."""
        new = self._next()
        if len(new.runs) < 2:
            return
        part = self._name("runs", new)
        merged = lww.live(self._frame(new.runs)).select("key", "seq", "value", F.lit(False).alias("deleted"))
        old, new.runs = new.runs, []
        if self._write_run(merged, part):
            new.runs, new.next_file = [part], new.next_file + 1
        self._commit(new, old)

    def close(self) -> None:
        """No more use of this handle; the log is not flushed, it is read again on opening."""
        self.closed = True

    # replication

    def pending(self) -> DataFrame:
        """(key, seq, value) that replicas haven't acknowledged.  An acknowledgement is stored as a tombstone of the version it names."""
        return lww.live(self._frame(self.manifest.queue))

    def next_pending(self) -> DataFrame:
        return replication.next_pending(self.pending())

    def ack(self, acks: DataFrame) -> DataFrame:
        """Takes acknowledged (key, value) off the queue; gives (key, status), a table that stays in ``acks/``."""
        new = self._next()
        part = self._name("queue", new)
        answers = f"{self.root}/{part.replace('queue/', 'acks/')}"
        pending = self.pending()
        replication.ack_status(pending, acks).write.parquet(answers)
        done = pending.join(acks.select("key", "value").distinct(), ["key", "value"], "left_semi").select("key", "seq", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("deleted"))
        done.write.parquet(f"{self.root}/{part}")
        new.next_file += 1
        new.queue.append(part)
        self._commit(new)
        return self.spark.read.schema("key string, status string").parquet(answers)

    # observation

    def metrics(self) -> DataFrame:
        """One row: uptime, attempted reads and writes and errors through this handle, live keys, the shard, runs and log segments."""
        m, name = self.manifest, next((x.name for x in self.shards or [] if x.idx == self.current), "")
        counted = {"reads": self.reads, "writes": self.writes, "errors": self.errors}
        count = lww.key_count(self.changes())
        return count.select(metrics.uptime(F.lit(self.started)).alias("uptime"), *[F.lit(v).cast("bigint").alias(k) for k, v in counted.items()], "key_count", F.lit(name).alias("shard_name"), F.lit(self.current).alias("shard_idx"), F.lit(len(m.runs)).alias("runs"), F.lit(len(m.log)).alias("log_segments"))
