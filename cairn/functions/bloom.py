"""Bloom filters over keys: size, bit positions, packed words, probes and their binary form.

The k positions of a key are (h1 + i * h2) mod 2**64 mod m for i = 0..k-1, with
h1 the FNV-1a and h2 the djb-xorshift hash of the key (a zero h2 counts as 1).
"""

from __future__ import annotations

import math
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.functions import hashing
from cairn.shipping import ship_active

DEFAULT_RATE = 0.01
MIN_BITS = 64
MAX_HASHES = 30


def bloom_params(n: int, p: float = DEFAULT_RATE) -> tuple[int, int]:
    """(bits m, hashes k) for n expected keys and false-positive rate p; n below 1 is 1, p outside (0, 1) is 0.01."""
    n = max(n, 1)
    if not 0 < p < 1:
        p = DEFAULT_RATE
    m = max(MIN_BITS, math.ceil(-n * math.log(p) / math.log(2) ** 2))
    k = math.floor(m / n * math.log(2) + 0.5)
    return m, min(max(k, 1), MAX_HASHES)


def bloom_params_expr(n: Column, p: Column) -> tuple[Column, Column]:
    """:func:`bloom_params` for a column of sizes and rates."""
    n = F.greatest(n.cast("double"), F.lit(1.0))
    p = F.when((p > 0) & (p < 1), p).otherwise(F.lit(DEFAULT_RATE))
    ln2 = math.log(2)
    m = F.greatest(F.lit(MIN_BITS), F.ceil(-n * F.log(p) / F.lit(ln2**2))).cast("bigint")
    k = F.floor(m / n * F.lit(ln2) + F.lit(0.5)).cast("int")
    return m, F.least(F.greatest(k, F.lit(1)), F.lit(MAX_HASHES))


def positions(key: Column, m: int, k: int) -> Column:
    """The key's k bit positions (ARRAY<BIGINT>), in hash order, not distinct."""

    @F.arrow_udf(T.ArrayType(T.LongType()))
    def run(keys: pa.Array) -> pa.Array:
        un = lambda a: a.view(np.uint64) ^ np.uint64(hashing.HALF)
        filled = keys.fill_null("") if not pa.types.is_binary(keys.type) else keys.fill_null(b"")
        h1 = un(hashing._by_position(filled, hashing.FNV_OFFSET, hashing._fnv_step).to_numpy(zero_copy_only=False))
        h2 = un(hashing._by_position(filled, hashing.DJB_START, hashing._djb_step).to_numpy(zero_copy_only=False))
        h2 = np.where(h2 == 0, np.uint64(1), h2)
        at = (h1[:, None] + np.arange(k, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(m)
        ends = pa.array(np.arange(len(keys) + 1, dtype=np.int32) * k)
        return pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int64).ravel()), mask=keys.is_null())

    ship_active()
    return run(key)


def positions_of(keys: list[bytes], m: int, k: int) -> np.ndarray:
    """The bit positions of keys at hand, a row of k for each."""
    h1, h2 = hashing.hashes_of(keys)
    h2 = np.where(h2 == 0, np.uint64(1), h2)
    return (h1[:, None] + np.arange(k, dtype=np.uint64)[None, :] * h2[:, None]) % np.uint64(m)


def words_of(keys: list[bytes], m: int, k: int) -> dict[int, int]:
    """The filter of keys at hand: its 64-bit words that are not zero."""
    bits = np.unique(positions_of(keys, m, k))
    word, start = np.unique(bits >> np.uint64(6), return_index=True)
    values = np.bitwise_or.reduceat(np.uint64(1) << (bits & np.uint64(63)), start) if len(bits) else []
    return dict(zip(word.tolist(), [int(v) for v in values], strict=True))


def may_contain(words: np.ndarray, m: int, k: int, keys: list[bytes]) -> np.ndarray:
    """Whether the filter may hold each of the keys at hand; ``words`` are all of its 64-bit words, in order."""
    at = positions_of(keys, m, k)
    return (words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1)


def build_words(keys: DataFrame, key: str, m: int, k: int) -> DataFrame:
    """The filter over all keys: (word, bits), the 64-bit words that are not zero.  Words are OR-ed before they are shuffled."""
    bits = keys.select(F.explode(positions(F.col(key), m, k)).alias("bit"))
    return bits.groupBy(F.expr("cast(bit div 64 as int)").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))


def probe(keys: DataFrame, key: str, words: DataFrame, m: int, k: int) -> DataFrame:
    """(key, may_contain) of every distinct key; ``words`` has m / 64 rows at most and m is the filter's own size, so its broadcast is bounded by it."""
    asked = keys.select(F.col(key).alias("key")).distinct().select("key", F.explode(positions(F.col("key"), m, k)).alias("bit"))
    side = F.broadcast(words) if m <= 1 << 26 else words
    hit = asked.join(side, F.expr("cast(bit div 64 as int)") == F.col("word"), "left")
    is_set = F.expr("coalesce((shiftrightunsigned(bits, cast(bit % 64 as int)) & 1) = 1, false)")
    return hit.groupBy("key").agg(F.bool_and(is_set).alias("may_contain"))


def encode_filter(m: int, k: int, words: dict[int, int]) -> bytes:
    """The binary form: m, k, then every word, all big-endian."""
    full = [words.get(i, 0) & 0xFFFFFFFFFFFFFFFF for i in range((m + 63) // 64)]
    return struct.pack(f">QQ{len(full)}Q", m, k, *full)


def decode_filter(data: bytes) -> tuple[int, int, dict[int, int]]:
    """The inverse of :func:`encode_filter`; ValueError for short or truncated data."""
    if len(data) < 16:
        raise ValueError("Bloom filter data too short")
    m, k = struct.unpack(">QQ", data[:16])
    n = (m + 63) // 64
    if len(data) < 16 + 8 * n:
        raise ValueError("Bloom filter data truncated")
    return m, k, {i: w for i, w in enumerate(struct.unpack(f">{n}Q", data[16 : 16 + 8 * n])) if w}
