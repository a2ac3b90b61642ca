import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from conftest_names import CLASHING  # noqa: E402

@pytest.fixture
def docs(spark):
    """(doc_id, text, lang, source, n_chars) from texts or (text, lang, source) tuples; ids from 0."""

    def make(*texts):
        rows = []
        for i, t in enumerate(texts):
            text, lang, source = t if isinstance(t, tuple) else (t, "en", "s")
            rows.append((i, text, lang, source, None if text is None else len(text)))
        return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")

    return make


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names operators use themselves."""
    rows = [
        (0, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "x", 1),
        (1, None, None, None, None, None, None),
        (2, "", "de", "s", 0, "y", 2),
        (3, "   \n\t ", "de", "s", 6, "y", 2),
        (4, "word " * 40_000, "en", "t", 200_000, "z", 3),
        (5, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "x", 1),
        (5, "alpha beta gamma delta epsilon zeta", "en", "s", 35, "x", 1),
        (None, "no key here but some words", "en", "t", 26, "k", 4),
        (None, None, None, None, None, None, None),
        (7, "🙂 é\x00 ß", "xx", "", 7, "", 0),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, n long")
    return frame.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
