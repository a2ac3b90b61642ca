"""Quality classifier: ordinal cumulative-link regression on graded ratings.

A text's score is a sum of weights of its hashed features, shared by all grades;
ordered thresholds cut the score, and P(grade > g) = sigmoid(score - threshold g).
That gives an expected grade and a tail probability for selection.

Grades come from the labels: 0 for a toxic document, 1 for one that is not toxic
but of low quality, 2 for the rest.

Features: the letters of every distinct word (present or not), the share of
every word shape (what is left of a word once runs of letters and of digits are
one character each), the share of repeated words and the length in words, both
in steps.

Bound: at most ``ROWS_PER_GRADE`` labelled rows of each grade are learnt from,
those with the smallest hashes of their ids; their hashed features, not their
texts, reach the driver.  Every document is scored.

Edge cases: null and empty texts have the features of an empty text; labels
without a document, with null or with repeated ids count once or not at all; a
document without a key is scored as any other; without labels of two grades at
least there is nothing to learn, and every document gets the highest grade; an
empty table gives an empty result; texts are read whole.  Other columns may have any
names: :func:`selected` passes all through unchanged, and in :func:`score` with
``keep_columns`` an input column ``expected_grade`` or ``p_top`` gives way to the new one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._common import arrow_map, named, packed, unpacked

GRADES = 3
ROWS_PER_GRADE = 1500
SPACE = 1 << 18
#: The weight of a word shape's share; presence of a word weighs 1.
SHAPE_SCALE = 6.0
#: Features of fewer documents of the sample are not learnt.
LEAST_DOCUMENTS = 8
LASSO = 4e-4
#: Keeps steps small where gradients are.
EASE = 1e-3
STEPS = 300
RATE = 0.05
#: Words a worker remembers; bounds memory only.
REMEMBERED = 400_000

_NOT_LETTER = regex.compile(r"[^\p{L}]+")
_LETTERS = regex.compile(r"\p{L}+")
_DIGITS = regex.compile(r"\p{N}+")


def _slot(kind: str, name: str) -> int:
    return zlib.crc32(f"{kind}:{name}".encode("utf-8", "surrogatepass")) % SPACE


class Features:
    """Hashed features of texts; remembers words."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int]] = {}

    def of_word(self, word: str) -> tuple[int, int]:
        got = self.known.get(word)
        if got is None:
            core = _NOT_LETTER.sub("", word).lower()
            shape = _DIGITS.sub("0", _LETTERS.sub("a", word))[:12]
            got = _slot("word", core) if core else -1, _slot("shape", shape)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            if len(word) <= 64:
                self.known[word] = got
        return got

    def of_text(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        words = (text or "").split()
        counts = Counter(words)
        present: dict[int, float] = {}
        shapes: dict[int, int] = {}
        for word, n in counts.items():
            core, shape = self.of_word(word)
            if core >= 0:
                present[core] = 1.0
            shapes[shape] = shapes.get(shape, 0) + n
        total = max(len(words), 1)
        for shape, n in shapes.items():
            present[shape] = present.get(shape, 0.0) + SHAPE_SCALE * n / total
        for kind, step in (("variety", len(counts) * 16 // total), ("top", max(counts.values(), default=0) * 16 // total), ("length", len(words).bit_length())):
            present[_slot(kind, str(step))] = 1.0
        return np.fromiter(present.keys(), np.int32, len(present)), np.fromiter(present.values(), np.float32, len(present))


_features: list[Features] = []


def features() -> Features:
    if not _features:
        _features.append(Features())
    return _features[0]


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray  # ascending; one less than the grades

    def tails(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > g) of every text for g = 0, 1, ..."""
        f = features()
        score = np.zeros(len(texts))
        for i, t in enumerate(texts):
            at, x = f.of_text(t)
            score[i] = float(self.weights[at] @ x)
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def loss_and_gradient(score: np.ndarray, free: np.ndarray, grades: np.ndarray, each: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighed negative log likelihood, and its slopes by every score and by ``free`` (the first threshold, logs of the gaps)."""
    n_grades = len(free) + 1
    cut = free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))])
    upper = np.concatenate([cut, [np.inf]])[grades]
    lower = np.concatenate([[-np.inf], cut])[grades]
    hi, lo = 1 / (1 + np.exp(np.clip(score - upper, -500, 500))), 1 / (1 + np.exp(np.clip(score - lower, -500, 500)))
    dhi, dlo = hi * (1 - hi), lo * (1 - lo)
    p = np.maximum(hi - lo, 1e-12)
    by_cut = np.array([np.sum(each * (-dhi * (grades == k) + dlo * (grades == k + 1)) / p) for k in range(n_grades - 1)])
    by_free = np.concatenate([[by_cut.sum()], np.exp(free[1:]) * by_cut[::-1].cumsum()[::-1][1:]])
    return float(-np.sum(each * np.log(p))), each * (dhi - dlo) / p, by_free


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, share: np.ndarray | None = None, n_grades: int = GRADES) -> OrdinalModel:
    """Maximum likelihood with an absolute-value penalty, by Adam on whole passes with a proximal step; the thresholds are a first one and positive gaps.

    ``share`` is how often each grade occurs among all labels, for a sample that has other proportions.
    """
    n = len(rows)
    often = np.bincount(np.concatenate([a for a, _ in rows]), minlength=SPACE) >= LEAST_DOCUMENTS
    rows = [(a[often[a]], x[often[a]]) for a, x in rows]
    rows = [(np.append(a, SPACE), np.append(x, np.float32(0))) for a, x in rows]  # so that none is empty
    at = np.concatenate([a for a, _ in rows])
    x = np.concatenate([v for _, v in rows])
    used, at = np.unique(at, return_inverse=True)
    at = at.astype(np.int32)
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(a) for a, _ in rows])
    starts = np.concatenate([[0], np.cumsum([len(a) for a, _ in rows])[:-1]])
    weight = np.zeros(len(used))
    free = np.zeros(n_grades - 1)  # first threshold, logs of gaps
    size = np.bincount(grades, minlength=n_grades)
    each = ((size if share is None else share) / np.maximum(size, 1))[grades]
    each = each / each.sum()
    moment = [np.zeros_like(weight), np.zeros_like(weight), np.zeros_like(free), np.zeros_like(free)]
    for step in range(1, STEPS + 1):
        score = np.add.reduceat(weight[at] * x, starts)  # doubles, as the weights are
        _, slope, g_free = loss_and_gradient(score, free, grades, each)
        g_weight = np.bincount(at, weights=slope[owner] * x, minlength=len(used))
        for value, grad, m, v in ((weight, g_weight, moment[0], moment[1]), (free, g_free, moment[2], moment[3])):
            m *= 0.9
            m += 0.1 * grad
            v *= 0.99
            v += 0.01 * grad**2
            value -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + EASE)
        weight[:] = np.sign(weight) * np.maximum(np.abs(weight) - RATE * LASSO / (np.sqrt(moment[1] / (1 - 0.99**step)) + EASE), 0)
    full = np.zeros(SPACE + 1)
    full[used] = weight
    return OrdinalModel(full, free[0] + np.concatenate([[0], np.cumsum(np.exp(free[1:]))]))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade) of every labelled document; of rows that repeat a key, the lowest grade."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(F.col(key).alias("key"), grade.alias("grade")).where("key is not null and grade is not null").groupBy("key").agg(F.min("grade").alias("grade"))


def train(documents: DataFrame, grades: DataFrame, text: str = "text", key: str = "doc_id", rows_per_grade: int = ROWS_PER_GRADE) -> OrdinalModel:
    """Learns from a bounded sample of ``grades`` (key, grade)."""
    found = {r["grade"]: r["n"] for r in grades.groupBy("grade").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return OrdinalModel(np.zeros(SPACE), np.full(GRADES - 1, -20.0) + np.arange(GRADES - 1))
    order = F.shiftrightunsigned(F.xxhash64("key", F.lit(11)), 11) * F.lit(2.0**-53)
    share = F.coalesce(*[F.when(F.col("grade") == g, F.lit(min(1.0, 1.5 * rows_per_grade / n + 50 / n))) for g, n in found.items()])
    near = grades.where(order < share).withColumn("nth", F.row_number().over(Window.partitionBy("grade").orderBy(order, "key")))
    sample = near.where(F.col("nth") <= rows_per_grade).select("key", "grade")

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [features().of_text(t) for t in batch.column(1).to_pylist()]
        ends = pa.array(np.cumsum([0] + [len(a) for a, _ in made]), pa.int32())
        at = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([a for a, _ in made])))
        x = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([v for _, v in made])))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), at, x], ["key", "grade", "at", "x"])

    kind = documents.schema[key].dataType.simpleString()
    # at most GRADES * rows_per_grade rows
    picked = documents.select(named(key).alias("key"), named(text).alias("text")).join(F.broadcast(sample), "key").select("key", "text", "grade")
    table = arrow_map(picked, rows, f"key {kind}, grade int, at array<int>, x array<float>").orderBy("key").toArrow()
    if table.num_rows == 0:
        return OrdinalModel(np.zeros(SPACE), np.full(GRADES - 1, -20.0) + np.arange(GRADES - 1))
    table = table.combine_chunks()
    split = lambda c: np.split(c.combine_chunks().values.to_numpy(), c.combine_chunks().offsets.to_numpy()[1:-1])
    return fit(list(zip(split(table["at"]), split(table["x"]), strict=True)), table["grade"].to_numpy().astype(np.int64), np.array([found.get(g, 0) for g in range(GRADES)], float))


def score(documents: DataFrame, model: OrdinalModel, text: str = "text", key: str = "doc_id", keep_columns: bool = False) -> DataFrame:
    """Every row with ``expected_grade`` and ``p_top`` (probability of the highest grade); only the key beside them unless ``keep_columns``."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    new = ["expected_grade", "p_top"]
    kept = [c for c in documents.columns if c not in new] if keep_columns else [key]
    source = documents.select(named(text).alias("text"), F.struct(*[named(c).alias(f"c{i}") for i, c in enumerate(kept)]).alias("row"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        tails = shared.value.tails(batch.column(0).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(1), pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])], ["row", *new])

    out = arrow_map(source, rows, T.StructType([source.schema["row"], *[T.StructField(c, T.DoubleType()) for c in new]]))
    return out.select(*unpacked("row", kept), *new)


def selected(documents: DataFrame, model: OrdinalModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose probability of the highest grade is ``least`` or more, as they are."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(named(text).alias("text"), packed(documents).alias("row"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = shared.value.tails(batch.column(0).to_pylist())[:, -1] >= least
        return pa.RecordBatch.from_arrays([batch.column(1).filter(pa.array(good))], ["row"])

    return arrow_map(source, rows, T.StructType([source.schema["row"]])).select(*unpacked("row", documents.columns))
