"""Language identification by prediction with partial matching.

Each language has a byte context tree of orders 0 to ``ORDER``: symbol counts
after every context, frozen after training.  A symbol seen after the longest
known context has probability n / (total + distinct); else the model escapes
with probability distinct / (total + distinct) to the context that is one
shorter, where symbols that the longer context would have coded are excluded.
A text's code length in bits is then exact, and the language that codes it
shortest is predicted.

The trees of all languages are laid out as one dense table, context x symbol x
language, so that scoring is two table lookups a byte.

Symbols are the bytes of the UTF-8 text with A-Z folded to a-z, every byte from
0x80 up as itself, and one symbol for all other bytes.

Bounds: a language's tree learns from at most ``DOCS_PER_LANGUAGE`` labelled
documents (those with the smallest hashes of their ids).  Of contexts ``MAX_CONTEXTS`` are
kept, or as many as a table of ``MAX_TABLE_BYTES`` holds; every language has an equal share of
them, and of that each order up to a fair part, so that neither many languages nor low orders
crowd out the rest.  Within its share a language's most frequent contexts are kept.  These are parameters; the
broadcast table is never larger.

Edge cases: a text that is null or has no letter is ``und`` with score 0; with
nothing to learn from every text is ``und``; ties go to the language first in
alphabetical order; repeated rows are predicted each; an empty table gives an
empty result; other columns are ignored, whatever their names; texts are read whole.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._common import arrow_map, named

ORDER = 3
DOCS_PER_LANGUAGE = 1000
MAX_CONTEXTS = 16_000
MAX_TABLE_BYTES = 256 << 20
#: Bytes scored at once; bounds memory only.
PIECE = 1 << 20
#: Evidence counts as that of at most so many bytes when it becomes a score.
SCORE_BYTES = 64
UNDETERMINED = "und"

SYMBOLS = 1 + 26 + 128
_LETTER = regex.compile(r"\p{L}")


def _symbol_of_byte() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    for i in range(26):
        table[ord("a") + i] = table[ord("A") + i] = 1 + i
    table[128:] = np.arange(27, 155)
    return table


SYMBOL_OF_BYTE = _symbol_of_byte()


def _symbols(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each text after ``ORDER`` blanks, and where each text's own symbols begin (and the end)."""
    pad = b" " * ORDER
    data = np.frombuffer(b"".join(pad + t for t in texts), np.uint8)
    starts = np.cumsum([0] + [len(t) + ORDER for t in texts])
    return SYMBOL_OF_BYTE[data], starts


def _grams(symbols: np.ndarray, alphabet: int) -> np.ndarray:
    """Codes of (context of ORDER symbols, symbol) that end at positions ORDER, ORDER + 1, ..."""
    n = len(symbols) - ORDER
    code = np.zeros(n, np.int64)
    for i in range(ORDER + 1):
        code *= alphabet
        code += symbols[i : i + n]
    return code


def gram_counts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, how often) of the texts' own symbols in their contexts; what runs from one text into the next does not count."""
    symbols, starts = _symbols(texts)
    code = _grams(symbols.astype(np.int64), SYMBOLS)
    own = np.ones(len(code), bool)
    for s in starts[1:-1]:
        own[s - ORDER : s] = False
    return np.unique(code[own], return_counts=True)


@dataclass
class PpmModel:
    languages: list[str]
    dense: np.ndarray  # symbol -> number of the symbols in use; unused ones share number 0
    alphabet: int
    context: np.ndarray  # code of the last ORDER symbols -> the longest known context
    cost: np.ndarray  # (context, symbol, language) -> bits

    def code_lengths(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bits of every text under every language, and the texts' bytes."""
        bits = np.zeros((len(texts), len(self.languages)))
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        group: list[int] = []
        size = 0

        def flush() -> None:
            if group:
                symbols, starts = _symbols([data[i] for i in group])
                at = self._bits(self.dense[symbols], starts)
                for i, b in zip(group, at, strict=True):
                    bits[i] += b

        for i, d in enumerate(data):
            if len(d) > PIECE:  # pieces that overlap by the context
                for p in range(0, len(d), PIECE):
                    head = d[max(0, p - ORDER) : p]
                    symbols, _ = _symbols([d[p : p + PIECE]])
                    symbols[ORDER - len(head) : ORDER] = SYMBOL_OF_BYTE[np.frombuffer(head, np.uint8)]
                    bits[i] += self._bits(self.dense[symbols], np.array([0, len(symbols)]))[0]
                continue
            if size + len(d) > PIECE:
                flush()
                group, size = [], 0
            group.append(i)
            size += len(d) + ORDER
        flush()
        return bits, np.array([len(d) for d in data], np.int64)

    def _bits(self, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
        a = self.alphabet
        n = len(symbols) - ORDER
        if n <= 0:
            return np.zeros((len(starts) - 1, len(self.languages)))
        before = np.zeros(n, np.int64)
        for i in range(ORDER):
            before *= a
            before += symbols[i : i + n]
        rows = self.context[before].astype(np.int64)
        rows *= a
        rows += symbols[ORDER:]
        costs = self.cost[rows]
        for s in starts[1:-1]:  # the next text's blanks
            costs[s - ORDER : s] = 0
        firsts = starts[:-1]
        empty = np.diff(starts) <= ORDER
        out = np.add.reduceat(costs, np.minimum(firsts, n - 1), axis=0, dtype=np.float64)
        out[empty] = 0
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        some = [t is not None and bool(_LETTER.search(t)) for t in texts]
        bits, sizes = self.code_lengths([t if ok else "" for t, ok in zip(texts, some, strict=True)])
        best = bits.argmin(axis=1)
        weight = np.exp2(-(bits - bits.min(axis=1, keepdims=True)) * (np.minimum(sizes, SCORE_BYTES) / np.maximum(sizes, 1))[:, None])
        score = 1 / weight.sum(axis=1)
        names = [self.languages[b] if ok else UNDETERMINED for b, ok in zip(best, some, strict=True)]
        return names, np.where(some, score, 0.0).tolist()


def _contexts(grams: list[tuple[np.ndarray, np.ndarray]], a: int, most: int) -> list[np.ndarray]:
    """The contexts that are kept, by order: those met twice at least, the most frequent of each language within its share, each with all its shorter ones."""
    levels = [np.zeros(1, np.int64)]
    share = [max(0, most - 1) // max(1, len(grams))] * len(grams)
    met: dict[int, np.ndarray] = {}
    for order in range(1, ORDER + 1):
        uniq, at = np.unique(np.concatenate([g // a % a**order for g, _ in grams]), return_inverse=True)
        often = uniq[np.bincount(at, weights=np.concatenate([n for _, n in grams])) >= 2]
        kept = []
        for k, (g, n) in enumerate(grams):
            own, at = np.unique(g // a % a**order, return_inverse=True)
            times = np.bincount(at, weights=n)
            good = np.isin(own, often) & np.isin(own % a ** (order - 1), met.get(k, levels[0]))
            own, times = own[good], times[good]
            first = own[np.argsort(-times, kind="stable")[: share[k] // (ORDER - order + 1)]]
            share[k] -= len(first)
            met[k] = first
            kept.append(first)
        levels.append(np.unique(np.concatenate(kept)))
    return levels


def build_model(counts: dict[str, tuple[np.ndarray, np.ndarray]], max_contexts: int = MAX_CONTEXTS) -> PpmModel:
    """The frozen model from each language's counts of (context, symbol) codes over all ``SYMBOLS``."""
    languages = sorted(counts)
    if not languages:
        return PpmModel([], np.zeros(SYMBOLS, np.int64), 1, np.zeros(1, np.int32), np.zeros((1, 0), np.float32))
    used = np.zeros(SYMBOLS, bool)
    parts = {}
    for lang in languages:
        code, n = counts[lang]
        digits = np.stack([code // SYMBOLS**i % SYMBOLS for i in range(ORDER, -1, -1)])
        parts[lang] = digits, n
        used[np.unique(digits)] = True
    used[0] = False
    dense = np.zeros(SYMBOLS, np.int64)
    dense[used] = np.arange(1, used.sum() + 1)
    a = int(used.sum()) + 1
    grams = {}
    for lang in languages:
        digits, n = parts[lang]
        code = np.zeros(digits.shape[1], np.int64)
        for row in dense[digits]:
            code = code * a + row
        uniq, at = np.unique(code, return_inverse=True)
        grams[lang] = uniq, np.bincount(at, weights=n)
    levels = _contexts(list(grams.values()), a, min(max_contexts, MAX_TABLE_BYTES // (4 * a * len(languages))))
    offset = np.cumsum([0] + [len(x) for x in levels])
    cost = np.zeros((int(offset[-1]), a, len(languages)), np.float32)
    for k, lang in enumerate(languages):
        g, n = grams[lang]
        shorter = np.full((1, a), 1.0 / a)
        for order in range(ORDER + 1):
            known = levels[order]
            where = np.searchsorted(known, g // a % a**order)
            ok = (where < len(known)) & (known[np.minimum(where, len(known) - 1)] == g // a % a**order) if len(known) else np.zeros(len(g), bool)
            count = np.bincount(where[ok] * a + g[ok] % a, weights=n[ok], minlength=len(known) * a).reshape(len(known), a)
            if order:
                up = np.searchsorted(levels[order - 1], known % a ** (order - 1))
                up = np.minimum(up, len(levels[order - 1]) - 1)
                base = shorter[up]
            else:
                base = np.broadcast_to(shorter, (len(known), a))
            total, distinct = count.sum(axis=1, keepdims=True), (count > 0).sum(axis=1, keepdims=True)
            rest = np.where(count > 0, 0, base)
            room = rest.sum(axis=1, keepdims=True)
            escape = np.where(room > 0, distinct / np.maximum(total + distinct, 1), 0)
            p = np.where(count > 0, count / np.maximum(total + distinct * (room > 0), 1), escape * rest / np.where(room > 0, room, 1))
            p = np.where(total > 0, p, base)
            cost[offset[order] : offset[order + 1], :, k] = -np.log2(np.maximum(p, 1e-30))
            shorter = p
    context = np.zeros(a**ORDER, np.int32)
    for order in range(1, ORDER + 1):
        for number, code in enumerate(levels[order].tolist()):
            if order == ORDER:
                context[code] = offset[order] + number
            else:
                context.reshape(a ** (ORDER - order), -1)[:, code] = offset[order] + number
    return PpmModel(languages, dense, a, context, cost.reshape(-1, len(languages)))


def held_out(key: Column | str, folds: int = 5) -> Column:
    """True for the rows of the fold that nothing is learnt from."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs_per_language: int = DOCS_PER_LANGUAGE) -> PpmModel:
    """Learns the trees from the labelled rows that are not :func:`held_out`."""
    rows = df.select(named(key).alias("key"), named(text).alias("text"), named(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("key"))
    found = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    order = F.shiftrightunsigned(F.xxhash64("key", F.lit(7)), 11) * F.lit(2.0**-53)
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, 1.5 * docs_per_language / n + 50 / n))) for k, n in sorted(found.items())]) if found else F.lit(0.0)
    near = rows.where(order < share).withColumn("order", order)
    first = Window.partitionBy("lang").orderBy("order", "key")
    sample = near.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= docs_per_language)

    def count(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        langs, codes, counts = [], [], []
        by: dict[str, list[bytes]] = {}
        for t, k in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(k, []).append(t.encode("utf-8", "surrogatepass"))
        for k, texts in by.items():
            uniq, n = gram_counts(texts)
            langs += [k] * len(uniq)
            codes.append(uniq)
            counts.append(n)
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(codes), pa.int64()), pa.array(np.concatenate(counts), pa.int64())], ["lang", "code", "n"])

    grams = arrow_map(sample.select("text", "lang"), count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    table = grams.toArrow()
    names, codes, n = np.array(table["lang"].to_pylist(), dtype=object), table["code"].to_numpy(), table["n"].to_numpy()
    return build_model({k: (codes[names == k], n[names == k]) for k in found if (names == k).any()})


def identify(df: DataFrame, model: PpmModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, ``lang_pred`` and ``score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        names, scores = shared.value.predict(batch.column(1).to_pylist())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["key", "lang_pred", "score"])

    kind = df.schema[key].dataType.simpleString()
    return arrow_map(df.select(named(key).alias("key"), named(text).alias("text")), rows, f"key {kind}, lang_pred string, score double").withColumnRenamed("key", key)
