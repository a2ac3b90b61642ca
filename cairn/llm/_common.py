"""Small helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cairn.shipping import ship
from cairn.sources.scratch import materialise, stored_rows

__all__ = ["arrow_map", "filter_array", "materialise", "named", "packed", "place_filter", "read_table", "small_or_not", "stored_rows", "unpacked"]

#: Rows that a Python step handles at once; bounds its memory, not its input.
ROWS_AT_ONCE = 512


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, rows: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` over slices of at most ``ROWS_AT_ONCE`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_ONCE):
                out = rows(batch.slice(start, ROWS_AT_ONCE))
                if out is not None and out.num_rows:
                    yield out

    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_or_not(df: DataFrame, most: int = 200_000) -> DataFrame:
    """A materialised frame with a broadcast hint where it has at most ``most`` rows; as it is, for a shuffled join, beyond."""
    return F.broadcast(df) if stored_rows(df) <= most else df


def named(column: str) -> Column:
    """A column by its name, whatever characters that has."""
    return F.col("`" + column.replace("`", "``") + "`")


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, by their places, so that no name of the input can clash with one of an operator."""
    return F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(df.columns)])


def unpacked(row: str, columns: list[str], **instead: Column) -> list[Column]:
    """The columns of a :func:`packed` row, some replaced."""
    return [(instead[c] if c in instead else F.col(f"{row}.c{i}")).alias(c) for i, c in enumerate(columns)]


#: Places of a filter at most: 16 MB of bits.
MOST_PLACES = 1 << 27


def place_filter(hashes: DataFrame, n: int | None = None) -> tuple[DataFrame, int]:
    """(words, places): a filter of one column of BIGINT hashes, 64-bit words (word, bits) of places ``hash mod places``.

    It has 32 places a hash or more, up to ``MOST_PLACES``, so at most two million rows; beyond that it lets more through, and what it let through is to be checked exactly.
    """
    n = stored_rows(hashes) if n is None else n
    hashes = hashes.toDF("hash")
    places = min(MOST_PLACES, 1 << max(10, int(32 * n - 1).bit_length()))
    at = hashes.select(F.pmod("hash", F.lit(places)).alias("place"))
    bits = at.select(F.shiftright("place", 6).alias("word"), F.expr("shiftleft(1L, cast(place & 63 as int))").alias("bit"))
    return bits.groupBy("word").agg(F.bit_or("bit").alias("bits")), places


def filter_array(words: DataFrame, places: int) -> np.ndarray:
    """The words of a :func:`place_filter` as one array for Python workers."""
    out = np.zeros(places // 64, np.uint64)
    table = words.toArrow()
    out[table["word"].to_numpy()] = table["bits"].to_numpy().view(np.uint64)
    return out
