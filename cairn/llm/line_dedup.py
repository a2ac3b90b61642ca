"""Removes recurring lines by a log-template tree.

A line's place in the tree is fixed by its number of tokens and its first
``DEPTH`` tokens; runs of digits count as one 0.  In each leaf, a token that as many
documents have at its position as make a line recurring is constant there.  A line's
template is its tokens with every other one generalised: to what most often (in so
many documents at least) follows the template's token before it, if anything does,
else to a variable field; after a variable field, to the token that is most frequent at that
position.  A line that agrees with this in less than a share of ``SIMILARITY`` of
its tokens is a template of its own.

A template that occurs in ``MIN_DOCS`` documents or more is
recurring, and one of ``PASSAGE`` tokens or more, which chance does not repeat, in
``PASSAGE_DOCS`` already: its lines are dropped everywhere but at its first occurrence (the
smallest key, then the smallest line number), so that of a passage or of a
group of copies one remains.

The tree is counted, not grown line by line: templates depend on the counts of a leaf only,
never on an order, on parts or on the input's size.  Equal lines are counted before
fields are, counts are added up before they move, and the lines of a large leaf
are dealt to many tasks, each with the leaf's table of fields.  Leaves that hold too few lines
for any recurring template are left out before a line's text moves.

Edge cases: lines of fewer than ``min_tokens`` tokens always stay, which is
``MIN_TOKENS`` where a caller says nothing and 1 in the queries, so that only blank
lines are exempt there; in lines of one to three tokens all tokens must agree; null texts
stay null and empty ones empty; a document whose lines all go gets the empty
text; rows that repeat a key and a text are one document; a null key counts as a
document of its own, after all others; an empty table gives an empty result.
Other columns pass through unchanged, whatever their names; a column ``lines_dropped``
of the input is replaced.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import arrow_map, filter_array, materialise, named, packed, place_filter, small_or_not, unpacked
from cairn.shipping import ship

DEPTH = 3
SIMILARITY = 0.7
MIN_DOCS = 5
#: Lines of so many tokens are passages, for which fewer documents do.
PASSAGE = 20
PASSAGE_DOCS = 3
MIN_TOKENS = 3
#: Different lines of a leaf that one task parses at once, or an eighth of the fields in the leaf's table; changes no result.
LINES_AT_ONCE = 128
#: Stands for a variable field; no token is empty.
VARIABLE = ""

_DIGITS = re.compile("[0-9]+")


def template(tokens: list[str], constant: set[tuple[int, str]], follows: dict[tuple[int, str], str]) -> list[str]:
    """The template of a line: ``constant`` has (position, token), ``follows`` the most frequent token at (position, token before)."""
    out = tokens[:DEPTH]
    same = len(out)
    for i in range(DEPTH, len(tokens)):
        if (i, tokens[i]) in constant:
            out.append(tokens[i])
            same += 1
        else:
            out.append(follows.get((i, out[-1]), VARIABLE))
    return out if same >= math.ceil(SIMILARITY * len(tokens)) else tokens


def _template_id(leaf: int, tokens: list[str]) -> int:
    """A hash with the leaf's last bit."""
    return _signed(xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass"), leaf & 0xFFFFFFFFFFFFFFFF) & ~1 | (leaf & 1))


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(leaf, part, line_id, line, times, fields), a part's table of fields before its lines -> (line_id, template, times).

    A field with a null ``before`` is constant at its position, another one is the most frequent after ``before``.
    """
    now, constant, follows = None, set(), {}
    for batch in batches:
        lines, found = [], []
        leaves, parts, texts, tables = (batch.column(i).to_pylist() for i in (0, 1, 3, 5))
        for i, (leaf, part, line, fields) in enumerate(zip(leaves, parts, texts, tables, strict=True)):
            if (leaf, part) != now:
                now, constant, follows = (leaf, part), set(), {}
            if line is None:
                constant = {(f["pos"], f["token"]) for f in fields if f["before"] is None}
                follows = {(f["pos"], f["before"]): f["token"] for f in fields if f["before"] is not None}
            else:
                lines.append(i)
                found.append(_template_id(leaf, template(line.split(" "), constant, follows)))
        picked = pa.array(lines, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(2).take(picked), pa.array(found, pa.int64()), batch.column(4).take(picked)], ["line_id", "template", "times"])


def _normal(line: str) -> list[str]:
    """A line's tokens; runs of digits are one 0."""
    tokens = line.split()
    return _DIGITS.sub("0", " ".join(tokens)).split(" ") if _DIGITS.search(line) else tokens


def _signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def _leaf(tokens: list[str]) -> int:
    """A hash of the leaf; its last bit says whether the leaf's lines are passages."""
    digest = xxhash.xxh3_64_intdigest("\n".join(tokens[:DEPTH]).encode("utf-8", "surrogatepass"), len(tokens))
    return _signed(digest & ~1 | (len(tokens) >= PASSAGE))


def _needed(col: str, min_docs: int) -> F.Column:
    """The documents that make a template recurring; ``col`` is a leaf, or a template with the leaf's last bit."""
    return F.when(F.col(col).bitwiseAND(F.lit(1)) == 1, min(min_docs, PASSAGE_DOCS)).otherwise(min_docs)


def _line_id(tokens: list[str]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(" ".join(tokens).encode("utf-8", "surrogatepass")))


def _places_of(batch: pa.RecordBatch, min_tokens: int) -> pa.RecordBatch:
    """(key, digest, text) -> (key, digest, pos, leaf, line_id) of every line that counts."""
    take, pos, leaf, line = [], [], [], []
    for i, text in enumerate(batch.column(2).to_pylist()):
        for p, raw in enumerate(text.split("\n")):
            tokens = _normal(raw)
            if len(tokens) >= min_tokens:
                take.append(i)
                pos.append(p)
                leaf.append(_leaf(tokens))
                line.append(_line_id(tokens))
    picked = pa.array(take, pa.int64())
    return pa.RecordBatch.from_arrays([batch.column(0).take(picked), batch.column(1).take(picked), pa.array(pos, pa.int32()), pa.array(leaf, pa.int64()), pa.array(line, pa.int64())], ["key", "digest", "pos", "leaf", "line_id"])


def _lines_in(texts: list[str], wanted: np.ndarray, min_tokens: int) -> pa.RecordBatch:
    """The lines of leaves whose places are ``wanted``: (leaf, line_id, line, times: how many of the texts have it)."""
    times: dict[str, int] = {}
    leaves: dict[str, int] = {}
    places = len(wanted) * 64
    bits = wanted.tolist() if len(wanted) < 1 << 16 else wanted  # a list is read faster
    for text in texts:
        own = set()
        for raw in text.split("\n"):
            tokens = _normal(raw)
            if len(tokens) >= min_tokens:
                leaf = _leaf(tokens)
                place = leaf % places
                if int(bits[place >> 6]) >> (place & 63) & 1:
                    own.add(line := " ".join(tokens))
                    leaves[line] = leaf
        for line in own:
            times[line] = times.get(line, 0) + 1
    lines = list(times)
    return pa.RecordBatch.from_arrays([pa.array([leaves[x] for x in lines], pa.int64()), pa.array([_line_id(x.split(" ")) for x in lines], pa.int64()), pa.array(lines, pa.string()), pa.array([times[x] for x in lines], pa.int64())], ["leaf", "line_id", "line", "times"])


def _templates(lines: DataFrame, min_docs: int) -> DataFrame:
    """(line_id, template, times) of different lines (leaf, line_id, line, times)."""
    needed = F.col("times") >= _needed("leaf", min_docs)
    # where a leaf has one line, or all too seldom, nothing is to be generalised
    sizes = lines.groupBy("leaf").agg(F.count("*").alias("lines"), F.sum("times").alias("times")).where((F.col("lines") > 1) & needed)
    sizes = small_or_not(materialise(sizes.select("leaf", "lines")))
    tokens = lines.join(sizes.select("leaf"), "leaf", "left_semi").select("leaf", "times", F.split("line", " ").alias("t")).where(F.size("t") > DEPTH)
    at = F.expr(f"transform(sequence({DEPTH}, size(t) - 1), i -> struct(i AS pos, t[i - 1] AS before, t[i] AS token))")
    fields = materialise(tokens.select("leaf", "times", F.explode(at).alias("f")).groupBy("leaf", "f.pos", "f.before", "f.token").agg(F.sum("times").alias("times")))
    common = materialise(fields.groupBy("leaf", "pos", "token").agg(F.sum("times").alias("times")).where(needed))
    # of the tokens at one place the most frequent, then the smallest
    most = F.min(F.struct((-F.col("times")).alias("minus"), "token")).getField("token").alias("token")
    best = fields.where(needed).groupBy("leaf", "pos", "before").agg(most).unionByName(common.groupBy("leaf", "pos").agg(most).withColumn("before", F.lit(VARIABLE)))
    rows = common.select("leaf", F.struct("pos", F.lit(None).cast("string").alias("before"), "token").alias("f")).unionByName(best.select("leaf", F.struct("pos", "before", "token").alias("f")))
    tables = rows.groupBy("leaf").agg(F.collect_list("f").alias("fields"))
    tables = materialise(tables.join(sizes, "leaf").withColumn("parts", F.ceil(F.col("lines") / F.greatest(F.lit(LINES_AT_ONCE), F.size("fields") / 8)).cast("int")))
    dealt = lines.join(small_or_not(tables.select("leaf", "parts")), "leaf", "left")
    dealt = dealt.select("leaf", F.pmod("line_id", F.coalesce("parts", F.lit(1))).cast("int").alias("part"), "line_id", "line", "times", F.lit(None).cast(tables.schema["fields"].dataType).alias("fields"))
    given = tables.select("leaf", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("bigint").alias("line_id"), F.lit(None).cast("string").alias("line"), F.lit(None).cast("bigint").alias("times"), "fields")
    ordered = dealt.unionByName(given).repartition("leaf", "part").sortWithinPartitions("leaf", "part", F.col("line_id").asc_nulls_first())
    ship(lines.sparkSession)
    return ordered.mapInArrow(_parsed, "line_id long, template long, times long")


def recurring_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """Documents with lines to drop: (key, digest of the text, gone: line numbers from 0)."""
    min_tokens = max(1, min_tokens)  # a blank line is no line
    docs = df.select(named(key).alias("key"), F.xxhash64(named(text)).alias("digest"), named(text).alias("text")).where("text is not null")
    kind = docs.schema["key"].dataType.simpleString()
    places = materialise(arrow_map(docs, lambda batch: _places_of(batch, min_tokens), f"key {kind}, digest long, pos int, leaf long, line_id long"))
    leaves = places.groupBy("leaf").agg(F.count("*").alias("n")).where(F.col("n") >= _needed("leaf", min_docs))
    leaves = materialise(leaves.select("leaf"))
    shared = df.sparkSession.sparkContext.broadcast(filter_array(*place_filter(leaves)))
    likely = arrow_map(docs.select("text"), lambda batch: _lines_in(batch.column(0).to_pylist(), shared.value, min_tokens), "leaf long, line_id long, line string, times long")
    different = likely.groupBy("leaf", "line_id", "line").agg(F.sum("times").alias("times"))
    different = materialise(different.join(small_or_not(leaves), "leaf", "left_semi"))

    found = materialise(_templates(different, min_docs))
    often = found.groupBy("template").agg(F.sum("times").alias("times")).where(F.col("times") >= _needed("template", min_docs)).select("template")
    named_lines = materialise(found.join(small_or_not(materialise(often)), "template", "left_semi").select("line_id", "template"))

    met = places.join(small_or_not(named_lines), "line_id").select("key", "digest", "pos", "template")
    each = met.groupBy("template", "key", "digest").agg(F.min("pos").alias("pos"))
    order = F.struct(F.col("key").isNull().alias("none"), "key", "digest", "pos")
    many = each.groupBy("template").agg(F.count("*").alias("docs"), F.min(order).alias("first")).where(F.col("docs") >= _needed("template", min_docs))
    many = materialise(many.select("template", "first"))
    out = met.join(small_or_not(many), "template").where(~order.eqNullSafe(F.col("first")))
    return out.groupBy("key", "digest").agg(F.collect_set("pos").alias("gone"))


def _joined(df: DataFrame, text: str, key: str, min_docs: int, min_tokens: int) -> tuple[DataFrame, F.Column, F.Column]:
    """Rows (row, gone: the line numbers to drop or null), the whole text and what is left of it."""
    gone = recurring_lines(df, text, key, min_docs, min_tokens).toDF("of", "of_digest", "gone")
    rows = df.select(named(key).alias("key"), F.xxhash64(named(text)).alias("digest"), packed(df).alias("row"))
    joined = rows.join(gone, F.col("of").eqNullSafe(F.col("key")) & (F.col("of_digest") == F.col("digest")), "left")
    whole = F.col(f"row.c{df.columns.index(text)}")
    kept = F.array_join(F.filter(F.split(whole, "\n"), lambda x, i: ~F.array_contains("gone", i)), "\n")
    return joined, whole, F.when(F.col("gone").isNull(), whole).otherwise(kept)


def drop_recurring_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """``df`` with the recurring lines gone from ``text``, and ``lines_dropped``, how many of the row's went."""
    joined, _, left = _joined(df, text, key, min_docs, min_tokens)
    columns = unpacked("row", df.columns, **{text: left})
    dropped = F.coalesce(F.size("gone"), F.lit(0)).alias("lines_dropped")
    return joined.select(*[c for c, name in zip(columns, df.columns, strict=True) if name != "lines_dropped"], dropped)


def without_recurring_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS, length: str | None = None) -> DataFrame:
    """The rows of ``df`` without the recurring lines, and without those rows of which only blank lines are left; ``length`` names the column of the text's length, if it has one."""
    joined, _, left = _joined(df, text, key, min_docs, min_tokens)
    rows = joined.select("row", "gone", left.alias("left"))
    rows = rows.where(F.col("gone").isNull() | F.col("left").rlike(r"\S"))
    instead = {text: F.col("left")} | ({length: F.length("left").cast("long")} if length in df.columns else {})
    return rows.select(*unpacked("row", df.columns, **instead))
