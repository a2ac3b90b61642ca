"""The corpus pipeline: five operators of ``cairn.llm`` in a row.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.  Every stage works on all rows that the one
before kept, and its decisions take effect:

1. quality: documents whose probability of the highest grade is under one half go;
2. line_dedup: recurring lines go from the texts; a document of nothing else goes;
3. near_dedup: one document of each group of near duplicates stays;
4. mixing: sources are mixed to tempered weights; every document stays, those of
   small sources may come twice;
5. packing: the documents' pieces in bins.

Stages 1, 2, 3 and 5 learn, parse, link or search; SQL can't express them, so
``ORACLE_SQL`` is None, and ``tests/llm/test_pipeline.py`` compares each stage with a brute-force version.

Edge cases: rows with nulls in any column, empty texts and repeated rows go through as each
operator's module states; without labels of two grades nothing is rejected; a document
whose lines all recur elsewhere goes, one that was blank before stays; a row without an id stays; an empty
table gives empty stages; further columns of ``documents``, whatever their names, pass through
all stages but the last unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cairn.llm._common import materialise, read_table
from cairn.llm.line_dedup import without_recurring_lines
from cairn.llm.mixing import mix
from cairn.llm.near_dedup import deduplicated
from cairn.llm.packing import pack
from cairn.llm.quality import graded, selected, train

KEEP_FROM = 0.5
REPETITION = 2.0
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return selected(docs, train(docs, graded(read_table(spark, sf_dir, "labels"))), KEEP_FROM)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_recurring_lines(docs, min_tokens=1, length="n_chars")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, repetition=REPETITION, keep_columns=True, places=False)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared checkpoint folder before the next begins."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
