"""Binary codecs of the change log, as built-in expressions and for single records.

Record: op (1 byte, 0 put, 1 delete), key length (4), key, value length (8),
value; all integers big-endian.  A tombstone's value is empty.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

OVERHEAD = 13


class Record(NamedTuple):
    key: bytes
    value: bytes | None
    deleted: bool


def record_hex(key: Column, value: Column, deleted: Column) -> Column:
    """The record of a change in upper-case hexadecimal; ``value`` is BINARY and counts as empty where null or deleted."""
    data = F.when(deleted | value.isNull(), F.unhex(F.lit(""))).otherwise(value)
    raw = F.encode(key, "UTF-8")
    return F.concat(
        F.when(deleted, F.lit("01")).otherwise(F.lit("00")),
        F.lpad(F.hex(F.octet_length(raw)), 8, "0"),
        F.hex(raw),
        F.lpad(F.hex(F.octet_length(data)), 16, "0"),
        F.hex(data),
    )


def record_binary(key: Column, value: Column, deleted: Column) -> Column:
    return F.unhex(record_hex(key, value, deleted))


def entry_size(key: Column, value: Column) -> Column:
    """Bytes of an encoded entry."""
    return F.lit(OVERHEAD) + F.octet_length(F.encode(key, "UTF-8")) + F.coalesce(F.octet_length(value), F.lit(0))


def encode_record(record: Record) -> bytes:
    value = b"" if record.deleted or record.value is None else record.value
    return struct.pack(">BI", int(record.deleted), len(record.key)) + record.key + struct.pack(">Q", len(value)) + value


def decode_records(data: bytes) -> Iterator[tuple[int, Record]]:
    """(offset, record) in order; stops without an error at a record that is cut off."""
    at = 0
    while at + 5 <= len(data):
        op, n = struct.unpack_from(">BI", data, at)
        if at + 5 + n + 8 > len(data):
            return
        key = data[at + 5 : at + 5 + n]
        (m,) = struct.unpack_from(">Q", data, at + 5 + n)
        end = at + OVERHEAD + n + m
        if end > len(data):
            return
        value = data[at + OVERHEAD + n : end]
        yield at, Record(key, None if op else value, bool(op))
        at = end


def complete_length(data: bytes) -> int:
    """Bytes up to the end of the last complete record."""
    end = 0
    for at, r in decode_records(data):
        end = at + OVERHEAD + len(r.key) + len(r.value or b"")
    return end
