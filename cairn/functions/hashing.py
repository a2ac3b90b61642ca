"""64-bit string hashes with unsigned wrap-around.

Spark has no unsigned type, so a hash h is held as the signed ``h - 2**63``,
which keeps the order of the unsigned values; :func:`unsigned` gives the exact
decimal.  :func:`fnv1a` and :func:`djb2x` are Arrow UDFs that run over all keys
of a batch one byte position at a time; :func:`fnv1a_expr` is the same in
built-in functions, for plans that must stay in the JVM (about ten times slower,
as folds over bytes are interpreted).
"""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.shipping import ship_active

# Parameters of the two hashes.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211
DJB_START = 5381
DJB_FACTOR = 33
HALF = 1 << 63


def _by_position(keys: pa.Array, start: int, step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> pa.Array:
    """Folds ``step`` over the bytes of every key; the keys that still have bytes are always the first of the order."""
    raw = keys.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)
    size = np.diff(ends)
    order = np.argsort(-size, kind="stable")
    begin, left = ends[:-1][order], size[order]
    h = np.full(len(keys), start, np.uint64)
    for i in range(int(left[0]) if len(left) else 0):
        n = int(np.searchsorted(-left, -i, side="left"))
        h[:n] = step(h[:n], data[begin[:n] + i].astype(np.uint64))
    out = np.empty(len(keys), np.uint64)
    out[order] = h
    signed = (out ^ np.uint64(HALF)).view(np.int64)
    return pa.array(signed, mask=np.asarray(keys.is_null()))


def _fnv_step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (h ^ b) * np.uint64(FNV_PRIME)


def _djb_step(h: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = h * np.uint64(DJB_FACTOR) + b
    return h ^ (h >> np.uint64(32))


@F.arrow_udf(T.LongType())
def _fnv1a(keys: pa.Array) -> pa.Array:
    return _by_position(keys, FNV_OFFSET, _fnv_step)


@F.arrow_udf(T.LongType())
def _djb2x(keys: pa.Array) -> pa.Array:
    return _by_position(keys, DJB_START, _djb_step)


def fnv1a(key: Column | str) -> Column:
    """FNV-1a of the UTF-8 bytes, as ``h - 2**63``; null for null."""
    ship_active()
    return _fnv1a(key)


def djb2x(key: Column | str) -> Column:
    """h = 33 h + byte, then h ^= h >> 32, from 5381; as ``h - 2**63``; null for null."""
    ship_active()
    return _djb2x(key)


def hashes_of(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Both unsigned hashes of keys at hand."""
    data = pa.array(keys, pa.binary())
    both = (_by_position(data, FNV_OFFSET, _fnv_step), _by_position(data, DJB_START, _djb_step))
    return tuple(h.to_numpy().view(np.uint64) ^ np.uint64(HALF) for h in both)


def fnv1a_expr(key: Column) -> Column:
    """:func:`fnv1a` in built-in functions: the state is two 32-bit halves, the prime is 2**40 + 435."""
    mask = F.lit(0xFFFFFFFF)
    hexes = F.hex(F.encode(key, "UTF-8"))
    count = F.length(hexes) / 2
    bytes_ = F.transform(F.sequence(F.lit(1), F.greatest(count.cast("int"), F.lit(1))), lambda i: F.conv(F.substring(hexes, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint"))
    bytes_ = F.when(F.length(hexes) > 0, bytes_).otherwise(F.array().cast("array<bigint>"))

    def step(acc: Column, b: Column) -> Column:
        x = acc["lo"].bitwiseXOR(b)
        p = x * 435
        hi = (acc["hi"] * 435 + F.shiftright(p, 32) + x * 256).bitwiseAND(mask)
        return F.struct(hi.alias("hi"), p.bitwiseAND(mask).alias("lo"))

    start = F.struct(F.lit(FNV_OFFSET >> 32).alias("hi"), F.lit(FNV_OFFSET & 0xFFFFFFFF).alias("lo"))
    return F.when(key.isNotNull(), F.aggregate(bytes_, start, step, lambda a: F.shiftleft(a["hi"] - (1 << 31), 32).bitwiseOR(a["lo"])))


def unsigned(h: Column) -> Column:
    """The unsigned value of a hash that is held as ``h - 2**63``: DECIMAL(20,0)."""
    return (h.cast("decimal(20,0)") + F.lit(Decimal(HALF))).cast("decimal(20,0)")


def unsigned_text(h: Column) -> Column:
    return unsigned(h).cast("string")


def fnv1a_py(key: str) -> int:
    """FNV-1a of one key on the driver."""
    h = FNV_OFFSET
    for b in key.encode("utf-8", "surrogatepass"):
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h
