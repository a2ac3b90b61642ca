"""Context-triggered piecewise hashing of documents.

A hash rolls over every seven bytes of a text.  Where it hits a multiple of the
block size a chunk ends, and each chunk adds one character to the signature, so
an edit changes only the characters of the chunks that it touches.  The block
size doubles until at most ``MAX_CHUNKS`` chunks are left.  A fingerprint is
``block:signature:signature at twice the block``; two fingerprints compare by
the edit distance of signatures of one block size, and are unlike (0) where
they have no block size in common.

Edge cases: null is the empty text, with the fingerprint ``3::``; equal texts
have equal fingerprints and likeness 1; a text with one repeated character has a
single chunk; repeated rows are fingerprinted each, and rows that share a key
follow each other in the order of their texts; a null key sorts first; an empty
table gives an empty result.  Texts of any length are hashed whole, in bounded
pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._common import ROWS_AT_ONCE, arrow_map, materialise
from cairn.shipping import ship

WINDOW = 7
SMALLEST_BLOCK = 3
MAX_CHUNKS = 64
#: Bytes hashed at once; bounds memory only.
PIECE = 1 << 21
#: Fixed value: one character per six bits of a chunk's hash.
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", dtype=np.uint8)

_ROLL = np.array([pow(0x9E3779B1, i, 1 << 32) for i in range(WINDOW)], dtype=np.uint32)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _grown(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the chunk hash's base and of its inverse, modulo 2^64."""
    if len(_powers[0]) <= n:
        size = max(n + 1, 2 * len(_powers[0]))
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0], _powers[1]


def _levels(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (from ``WINDOW`` - 1 on) where a chunk of the smallest block may end, and how often its block may double there."""
    n = len(data) - WINDOW + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = data.astype(np.uint32) + np.uint32(1)
    h = np.zeros(n, np.uint32)
    for i in range(WINDOW):
        h += wide[WINDOW - 1 - i : WINDOW - 1 - i + n] * _ROLL[i]
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x85EBCA6B)
    h ^= h >> np.uint32(13)
    at = np.flatnonzero(h % np.uint32(SMALLEST_BLOCK) == 0)
    hit = h[at].astype(np.int64) | (1 << 32)
    low = hit & -hit
    return at, np.log2(low.astype(np.float64)).astype(np.int64)


def _characters(sums: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Signature characters of chunks from their polynomial sums and lengths."""
    h = sums + lengths.astype(np.uint64)
    h ^= h >> np.uint64(31)
    h *= np.uint64(0x94D049BB133111EB)
    return ALPHABET[(h >> np.uint64(58)).astype(np.int64)]


def _signatures_of(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[str]:
    """Fingerprints of the texts ``buffer[start:end]``; each has ``WINDOW`` - 1 zero bytes before it."""
    n = len(starts)
    at, level = _levels(buffer)
    at = at + (WINDOW - 1)
    owner = np.searchsorted(starts, at, side="right") - 1
    inside = (owner >= 0) & (at < ends[np.maximum(owner, 0)]) & (at >= starts[np.maximum(owner, 0)])
    at, level, owner = at[inside], level[inside], owner[inside]
    # a chunk end at the last byte opens no further chunk
    tail = at == ends[owner] - 1
    counts = np.zeros((n, 40), np.int64)
    np.add.at(counts, (owner[~tail], level[~tail]), 1)
    chunks = counts[:, ::-1].cumsum(axis=1)[:, ::-1] + 1
    block = np.argmax(chunks <= MAX_CHUNKS, axis=1)
    forward, backward = _grown(len(buffer))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * forward[: len(buffer)], dtype=np.uint64)])
    parts = []
    for more in (0, 1):
        use = (level >= block[owner] + more) & ~tail
        begin = np.concatenate([starts, at[use] + 1])
        who = np.concatenate([np.arange(n), owner[use]])
        order = np.lexsort((begin, who))
        begin, who = begin[order], who[order]
        end = np.append(begin[1:], 0)
        last = np.append(who[1:] != who[:-1], True)
        end[last] = ends[who[last]]
        some = end > begin
        begin, end, who = begin[some], end[some], who[some]
        letters = _characters((total[end] - total[begin]) * backward[begin], end - begin)
        cut = np.searchsorted(who, np.arange(n + 1))
        joined = letters.tobytes().decode("ascii")
        parts.append([joined[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)])
    return [f"{SMALLEST_BLOCK << b}:{x}:{y}" for b, x, y in zip(block.tolist(), *parts, strict=True)]


def _long_fingerprint(data: bytes) -> str:
    """The same fingerprint for one text longer than ``PIECE``, in pieces."""
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint8), np.frombuffer(data, np.uint8)])
    counts = np.zeros(40, np.int64)
    last = len(data) - 1

    def pieces() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for begin in range(0, len(data), PIECE):
            at, level = _levels(padded[begin : begin + PIECE + WINDOW - 1])
            at = at + begin
            yield at[at < last], level[at < last]

    for _, level in pieces():
        counts += np.bincount(level, minlength=40)
    block = int(np.argmax(counts[::-1].cumsum()[::-1] + 1 <= MAX_CHUNKS))
    ends = [(a, v) for at, level in pieces() for a, v in zip(at[level >= block].tolist(), level[level >= block].tolist(), strict=True)]
    forward, _ = _grown(PIECE)
    words = []
    for more in (0, 1):
        begin, word = 0, []
        for end in [a + 1 for a, v in ends if v >= block + more] + [len(data)]:
            total, scale = 0, 1
            for p in range(begin, end, PIECE):
                x = np.frombuffer(data[p : min(p + PIECE, end)], np.uint8).astype(np.uint64) + np.uint64(1)
                total = (total + scale * int(np.sum(x * forward[: len(x)], dtype=np.uint64))) % (1 << 64)
                scale = scale * int(forward[len(x) - 1]) * _BASE % (1 << 64)
            word.append(_characters(np.array([total], np.uint64), np.array([end - begin]))[0])
            begin = end
        words.append(bytes(word).decode("ascii"))
    return f"{SMALLEST_BLOCK << block}:{words[0]}:{words[1]}"


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text."""
    out: list[str] = [""] * len(texts)
    group: list[int] = []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if group:
            pad = bytes(WINDOW - 1)
            buffer = np.frombuffer(b"".join(pad + d for d in held), np.uint8)
            lengths = np.array([len(d) for d in held], np.int64)
            ends = np.cumsum(lengths + WINDOW - 1)
            for i, f in zip(group, _signatures_of(buffer, ends - lengths, ends), strict=True):
                out[i] = f
        group.clear()
        held.clear()
        size = 0

    for i, text in enumerate(texts):
        data = text.encode("utf-8", "surrogatepass")
        if len(data) > PIECE:
            out[i] = _long_fingerprint(data)
            continue
        if size + len(data) > PIECE:
            flush()
        group.append(i)
        held.append(data)
        size += len(data) + WINDOW - 1
    flush()
    return out


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the table at a time in the bits of one integer."""
    if not a or not b:
        return len(a) or len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, score = full, 0, len(a)
    for c in b:
        eq = where.get(c, 0)
        cross = ((eq & up) + up ^ up) | eq | down
        right_up = down | ~(cross | up) & full
        right_down = up & cross
        score += bool(right_up & top) - bool(right_down & top)
        right_up = right_up << 1 | 1
        right_down <<= 1
        up = (right_down | ~((eq | down) | right_up)) & full
        down = (eq | down) & right_up & full
    return score


def likeness(a: str, b: str) -> float:
    """1 - edit distance / length of the longer signature, at the block size that both fingerprints have; 0 without one."""
    if a == b:
        return 1.0
    (p, p1, p2), (q, q1, q2) = a.split(":"), b.split(":")
    x, y = int(p), int(q)
    if x == y:
        s, t = p1, q1
    elif x == 2 * y:
        s, t = p1, q2
    elif y == 2 * x:
        s, t = p2, q1
    else:
        return 0.0
    return 1.0 - edit_distance(s, t) / max(len(s), len(t), 1)


def edited(text: str, following: str) -> str:
    """The text with its last quarter (in code points) replaced by the first as many, or all, of the next text."""
    m = len(text) // 4
    return text[: len(text) - m] + following[:m]


_DONE = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _done_columns(texts: list[str], prints: list[str], following: list[str], next_prints: list[str]) -> list[pa.Array]:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    changed_prints = fingerprints(changed)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed]),
        pa.array(prints),
        pa.array(changed_prints),
        pa.array([likeness(a, b) for a, b in zip(prints, changed_prints, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(prints, next_prints, strict=True)], pa.float64()),
    ]


def fingerprint_documents(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row with ``fingerprint`` (general use; no comparison)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(fingerprints(texts), pa.string())], ["key", "n_chars", "fingerprint"])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"key {kind}, n_chars long, fingerprint string").withColumnRenamed("key", key)


def compare_with_edit_and_next(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Fingerprints every text, its edited text (see :func:`edited`) and compares it with that and the next text in the order of ``key``.

    One range shuffle brings neighbours together.  Each task completes all its rows but the last, whose successor
    is the first row of the next non-empty task; those edge rows, two a task, are joined afterwards.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        names = ["part", "edge", "key", *(c.split()[0] for c in _DONE.split(", ")), "text"]

        def record(edge: str, keys: pa.Array, done: list[pa.Array], texts: pa.Array) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([edge] * n), keys, *done, texts], names)

        def edge_row(edge: str, keys: pa.Array, value: str, mark: str) -> pa.RecordBatch:
            none = pa.nulls(1, pa.string())
            return record(edge, keys, [pa.array([len(value)], pa.int64()), none, pa.array([mark]), none, pa.nulls(1, pa.float64()), pa.nulls(1, pa.float64())], pa.array([value], pa.string()))

        held = None
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(start, ROWS_AT_ONCE)
                keys, texts = piece.column(0), [t or "" for t in piece.column(1).to_pylist()]
                prints = fingerprints(texts)
                if held is None:
                    yield edge_row("first", keys.slice(0, 1), texts[0], prints[0])
                else:
                    keys = pa.concat_arrays([held[0], keys])
                    texts, prints = [held[1], *texts], [held[2], *prints]
                n = len(texts) - 1
                if n:
                    yield record("", keys.slice(0, n), _done_columns(texts[:n], prints[:n], texts[1:], prints[1:]), pa.nulls(n, pa.string()))
                held = keys.slice(n, 1), texts[n], prints[n]
        if held is not None:
            yield edge_row("last", held[0], held[1], held[2])

    ship(df.sparkSession)
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text")).repartitionByRange("key").sortWithinPartitions("key", "text")
    parts = materialise(source.mapInArrow(run, f"part int, edge string, key {kind}, {_DONE}, text string"))

    first = parts.where("edge = 'first'").select("part", F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    order = Window.orderBy("part")  # one short row a task
    after = parts.where("edge = 'first'").select(F.col("part").alias("at"), F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("part"))
    last = parts.where("edge = 'last'").select(F.col("part").alias("at"), "key", "text", "fingerprint")
    edges = last.join(after, "at").join(first, "part").select("key", "text", "fingerprint", "next_text", "next_print")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        _, texts, prints, following, next_prints = (c.to_pylist() for c in batch.columns)
        return pa.RecordBatch.from_arrays([batch.column(0), *_done_columns(texts, prints, following, next_prints)], ["key", *(c.split()[0] for c in _DONE.split(", "))])

    done = parts.where("edge = ''").drop("part", "edge", "text").unionByName(arrow_map(edges, finish, f"key {kind}, {_DONE}"))
    return done.withColumnRenamed("key", key)
