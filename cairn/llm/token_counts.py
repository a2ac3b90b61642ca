"""Exact token counts by prefix dynamic programming.

A byte-pair encoding of a string is the only segmentation whose neighbouring
tokens are all *compatible*: encoding the two tokens' bytes on their own gives
the two tokens back.  So the last token of every prefix is found from the
prefixes before it, and with it the exact number of tokens of every prefix;
no prefix is ever encoded anew.  The table answers how many tokens a text has,
how many any prefix of it has, and where to cut it for a budget.

Counts equal those of the ``tokenizers`` library for the same file, without
added special tokens; a special token's string inside a text counts as that one
token, which is the library's default.

Edge cases: null counts as the empty text (0 bytes, 0 tokens); repeated rows are
counted each; an empty table gives an empty result; other columns of the input
are ignored by :func:`count_tokens`.  Very long words cost time in proportion
to their length.
"""

from __future__ import annotations

import json
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import arrow_map

#: Fixed value: the published pattern that splits text before byte-level merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The alternatives of the pattern that a cut can split in two.
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Words whose counts a worker remembers before it starts anew; bounds memory only.
REMEMBERED = 500_000
#: Longer words are counted but not remembered.
LONG_WORD = 64


def _byte_of_symbol() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself where printable, else the next from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """The prefix tables of one vocabulary.  Not shared between processes."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        to_byte = _byte_of_symbol()
        raw = lambda s: bytes(to_byte[c] for c in s)
        model = spec["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items() if all(c in to_byte for c in s)}
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for r, (a, b) in enumerate(pairs):
            self.rank.setdefault((raw(a), raw(b)), r)
        self.starts = {t[:n] for t in self.ids for n in range(1, len(t))}
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(SPLIT)
        self.space = regex.compile(r"\s+")
        self.fits: dict[int, bool] = {}
        self.own: dict[bytes, bool] = {}
        self.known: dict[str, int] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The encoding by the merge rules themselves; the pairs of short tokens that :meth:`compatible` asks about."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min((self.rank.get(p, 1 << 60), i) for i, p in enumerate(pairwise(parts)))
            if best[0] == 1 << 60:
                break
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def compatible(self, a: bytes, b: bytes) -> bool:
        key = self.ids[a] << 20 | self.ids[b]
        if (known := self.fits.get(key)) is None:
            if len(self.fits) > 2_000_000:
                self.fits.clear()
            known = self.fits[key] = self.merged(a + b) == [a, b]
        return known

    def reachable(self, token: bytes) -> bool:
        if (known := self.own.get(token)) is None:
            known = self.own[token] = len(self.merged(token)) == 1
        return known

    def prefix_table(self, word: bytes) -> list[int]:
        """Tokens of ``word[:i]`` for i = 0..len(word), for a word that the split pattern leaves whole."""
        n = len(word)
        count = [0] * (n + 1)
        last: list[bytes | None] = [None] * (n + 1)
        ids, starts, fits, known = self.ids, self.starts, self.fits, self.own
        for j in range(n):
            before, c = last[j], count[j] + 1
            high = ids[before] << 20 if before is not None else 0
            for i in range(j + 1, n + 1):
                token = word[j:i]
                if last[i] is None and token in ids:
                    if before is None:
                        ok = known[token] if token in known else self.reachable(token)
                    else:
                        ok = fits.get(high | ids[token])
                        if ok is None:
                            ok = self.reachable(token) and self.compatible(before, token)
                    if ok:
                        last[i], count[i] = token, c
                if token not in starts:
                    break
        return count

    def word_count(self, word: str) -> int:
        known = self.known.get(word)
        if known is None:
            known = self.prefix_table(word.encode("utf-8", "surrogatepass"))[-1]
            if len(word) <= LONG_WORD:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[word] = known
        return known

    def segments(self, text: str) -> list[str]:
        return [s for s in self.special_split.split(text) if s] if self.special_split else [text] if text else []

    def count(self, text: str) -> int:
        total = 0
        for part in self.segments(text):
            if part in self.special:
                total += 1
                continue
            words = self.words.findall(part)
            try:
                total += sum(map(self.known.__getitem__, words))
            except KeyError:
                total += sum(map(self.word_count, words))
        return total

    def prefix_counts(self, text: str) -> np.ndarray:
        """Tokens of ``text[:i]`` for every i = 0..len(text), each as the library counts that prefix on its own.

        A cut changes how the pattern splits only near the cut: white space before the cut runs together, and
        a contraction cut in its middle falls apart.  A special token cut in its middle is ordinary text, that
        of the segment before it, whose words are counted again for it; all before that stands.
        """
        out = np.zeros(len(text) + 1, dtype=np.int64)
        at = total = 0
        begin = before = 0  # where the last ordinary segment began, and the count there
        for part in self.segments(text):
            if part in self.special:
                for i in range(1, len(part)):
                    out[at + i] = before + self.count(text[begin : at + i])
                at, total = at + len(part), total + 1
                begin, before = at, total
                out[at] = total
                continue
            begin, before = at, total
            space_at = space_total = None  # where the white space before this word begins, and the count there
            for word in self.words.findall(part):
                data = word.encode("utf-8", "surrogatepass")
                table = self.prefix_table(data)
                sizes = np.cumsum([len(c.encode("utf-8", "surrogatepass")) for c in word])
                for i, size in enumerate(sizes, 1):
                    head = word[:i]
                    if space_at is not None and self.space.fullmatch(head):
                        run = text[space_at : at + i]
                        out[at + i] = space_total + self.prefix_table(run.encode())[-1]
                    elif i == 2 and word in LONG_CONTRACTIONS:
                        out[at + i] = total + self.word_count("'") + self.word_count(word[1])
                    else:
                        out[at + i] = total + table[size]
                if not self.space.fullmatch(word):
                    space_at = space_total = None
                elif space_at is None:
                    space_at, space_total = at, total
                at, total = at + len(word), total + table[-1]
        return out

    def longest_prefix(self, text: str, budget: int) -> int:
        """Code points of the longest prefix with at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def count_tokens(df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, limit: int = 1024) -> DataFrame:
    """One row per input row: the key, ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens)."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(vocabulary or default_vocabulary())
        tokens = pa.array([c.count(t or "") for t in batch.column(1).to_pylist()], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["key", "n_bytes", "n_tokens"])

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"))
    counted = arrow_map(source, rows, f"key {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def truncate_to_budget(df: DataFrame, budget: int, text: str = "text", key: str = "doc_id", vocabulary: str | None = None) -> DataFrame:
    """One row per input row: the key, ``n_fit`` (code points of the longest prefix within the budget), ``fit_tokens`` (its exact count) and ``fit_text``."""

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(vocabulary or default_vocabulary())
        texts = [t or "" for t in batch.column(1).to_pylist()]
        tables = [c.prefix_counts(t) for t in texts]
        fit = [int(np.flatnonzero(x <= budget)[-1]) for x in tables]
        arrays = [batch.column(0), pa.array(fit, pa.int64()), pa.array([int(x[n]) for x, n in zip(tables, fit, strict=True)], pa.int64()), pa.array([t[:n] for t, n in zip(texts, fit, strict=True)], pa.string())]
        return pa.RecordBatch.from_arrays(arrays, ["key", "n_fit", "fit_tokens", "fit_text"])

    kind = df.schema[key].dataType.simpleString()
    out = arrow_map(df.select(F.col(key).alias("key"), F.col(text).alias("text")), rows, f"key {kind}, n_fit long, fit_tokens long, fit_text string")
    return out.withColumnRenamed("key", key)
