"""Mixing sources to target weights by temperature.

A source's share of all tokens is raised to an exponent between 0 (all sources
alike) and 1 (as they are), and the shares are normalised anew.  The exponent is
bisected, all sources at once in a few aggregations over the table of sources,
until it meets the target: an entropy of the weights in bits, or a limit on how
often a source is repeated.

The weights are realised as block permutations.  A source's documents are dealt
to blocks of about ``BLOCK_DOCS`` by a hash; each pass over the source takes the
blocks in an order of its own until the source's budget of tokens is used up.
The pass that the budget ends takes whole blocks, then documents of one last
block, in an order by hash, and stops before the first that is too large.  Every
chosen copy has its place ``at`` in the mixture (0 to 1: the share of its
source's budget before its block, and within the block a place by hash), so that
ordering by it interleaves the sources in their target proportions.

With no budget given, it is the least that takes every source whole at least
once: nothing is dropped, and small sources repeat.  Tokens are runs of
characters other than white space.

Only DataFrame functions are used; no step holds a source's documents, nor all its blocks, in one
task (what is before a block is the sum of the groups of blocks before its own and of those in it), and the driver sees a fixed number of figures.

Edge cases: a null source is a source; documents without tokens, null texts
among them, are taken once, at place 0; rows that repeat key, source and text
are chosen together; a single source has weight 1; an empty table gives an empty
result.  Other columns pass through unchanged, whatever their names; where ``copy`` and
``at`` are asked for, columns of the input with these names give way.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.llm._common import materialise, named, packed, small_or_not, unpacked

BLOCK_DOCS = 1000
#: Leading bits of the hash that orders blocks: so many groups are summed before the blocks in them are.
GROUP_BITS = 12
#: The exponents tried at once, and how often the interval shrinks by as much.
GRID = 15
ROUNDS = 6


@dataclass
class Mixture:
    exponent: float
    plan: DataFrame  # source, tokens, docs, weight, target, passes (whole ones), rest (tokens of the last), blocks


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def _scan(logs: DataFrame, exponents: list[float]):
    """For every exponent: entropy of the weights in bits, and the most a source is repeated when each is taken once at least."""
    each = logs.select("log_share", F.explode(F.array(*[F.lit(x) for x in exponents])).alias("x"))
    scaled, spread = F.col("x") * F.col("log_share"), (F.col("x") - 1) * F.col("log_share")
    got = each.groupBy("x").agg(F.sum(F.exp(scaled)).alias("z"), F.sum(F.exp(scaled) * scaled).alias("e"), F.max(spread).alias("high"), F.min(spread).alias("low"))
    return {r["x"]: ((math.log(r["z"]) - r["e"] / r["z"]) / math.log(2), math.exp(min(700.0, r["high"] - r["low"]))) for r in got.collect()}


def find_exponent(totals: DataFrame, entropy: float | None, repetition: float) -> float:
    """The exponent for a target entropy, or else the smallest at which no source repeats more than ``repetition`` times as often as another."""
    total = totals.agg(F.sum("tokens")).first()[0]
    if not total:
        return 1.0
    logs = totals.where("tokens > 0").select(F.log(F.col("tokens") / F.lit(float(total))).alias("log_share"))
    # both conditions turn from false to true as the exponent grows
    met = (lambda e, r: e <= entropy) if entropy is not None else (lambda e, r: r <= repetition)
    low, high = 0.0, 1.0
    for turn in range(ROUNDS):
        tried = [low + (high - low) * i / (GRID + 1) for i in range(0 if turn == 0 else 1, GRID + 1)]
        seen = _scan(logs, tried)
        good = [x for x in tried if met(*seen[x])]
        high = min([high, *good])
        low = max([low, *[x for x in tried if x < high]])
        if high == 0.0:
            break
    return high


def plan_mixture(items: DataFrame, repetition: float = 2.0, entropy: float | None = None, budget: int | None = None) -> Mixture:
    """Weights and budgets per source for ``items`` (source, tokens)."""
    totals = materialise(items.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")))
    exponent = find_exponent(totals, entropy, repetition)
    scaled = F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(exponent))).otherwise(0.0)
    z, whole = totals.agg(F.sum(scaled), F.max(F.when(F.col("tokens") > 0, F.col("tokens") / scaled))).first()
    per_weight = float(budget) if budget is not None else (whole or 0.0) * (z or 0.0)
    weighted = totals.withColumn("weight", scaled / F.lit(z or 1.0)).withColumn("target", F.col("weight") * F.lit(per_weight))
    # a hair above, so that rounding takes no document from a whole pass
    passes = F.when(F.col("tokens") > 0, F.floor(F.col("target") / F.col("tokens") + F.lit(1e-9))).otherwise(0).cast("int")
    plan = weighted.withColumn("passes", passes).withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("tokens")))
    return Mixture(exponent, materialise(plan.withColumn("blocks", F.ceil(F.col("docs") / BLOCK_DOCS).cast("long"))))


def mix(df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", repetition: float = 2.0, entropy: float | None = None, budget: int | None = None, seed: int = 0, keep_columns: bool = False, places: bool = True) -> DataFrame:
    """The chosen copies: key, source, ``copy`` (pass, from 0), ``n_tokens``, ``at``; or, with ``keep_columns``, the rows of ``df`` with ``copy`` and ``at``, or without these where ``places`` is false."""
    mark = F.xxhash64(named(key), named(text), F.lit(seed))
    items = df.select(named(key).alias("key"), named(source).alias("source"), mark.alias("mark"), token_count(named(text)).alias("tokens"))
    items = materialise(items)
    plan = small_or_not(plan_mixture(items, repetition, entropy, budget).plan.withColumnRenamed("source", "of").drop("docs", "weight").withColumnRenamed("tokens", "all"))

    def placed(rows: DataFrame) -> DataFrame:
        """Rows (source, mark) with their source's plan and their block."""
        return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("block", F.pmod(F.col("mark"), F.col("blocks"))).drop("of")

    with_blocks = placed(items)
    block = with_blocks.where("tokens > 0").groupBy("source", "block").agg(F.sum("tokens").alias("tokens"), *[F.first(c).alias(c) for c in ("all", "target", "passes", "rest")])
    turns = block.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("passes"))))
    turns = turns.withColumn("order", F.xxhash64("source", "block", "copy", F.lit(seed)))
    turns = materialise(turns.withColumn("group", F.shiftright("order", 64 - GROUP_BITS)))
    # running sums in two steps: of the groups of a pass, then of the blocks of a group
    groups = turns.groupBy("source", "copy", "group").agg(F.sum("tokens").alias("sum"))
    earlier = F.sum("sum").over(Window.partitionBy("source", "copy").orderBy("group").rowsBetween(Window.unboundedPreceding, -1))
    groups = groups.select(F.col("source").alias("g_source"), F.col("copy").alias("g_copy"), F.col("group").alias("g_group"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    turns = turns.join(small_or_not(materialise(groups)), F.col("source").eqNullSafe(F.col("g_source")) & (F.col("copy") == F.col("g_copy")) & (F.col("group") == F.col("g_group")))
    within_group = F.sum("tokens").over(Window.partitionBy("source", "copy", "group").orderBy("order", "block").rowsBetween(Window.unboundedPreceding, -1))
    turns = turns.withColumn("before", F.col("earlier") + F.coalesce(within_group, F.lit(0)))
    left = F.when(F.col("copy") < F.col("passes"), F.col("tokens").cast("double")).otherwise(F.col("rest") - F.col("before"))
    # what a block gives to a pass: all its documents, or those that fit into `left`
    turns = materialise(turns.withColumn("left", left).where("left > 0").select(F.col("source").alias("of"), F.col("block").alias("of_block"), "copy", (F.col("left") >= F.col("tokens")).alias("whole"), "left", ((F.col("copy") * F.col("all") + F.col("before")) / F.col("target")).alias("begin"), (F.least("left", "tokens") / F.col("target")).alias("width")))
    same = F.col("source").eqNullSafe(F.col("of")) & (F.col("block") == F.col("of_block"))
    shuffle = F.xxhash64("mark", "copy", F.lit(seed + 1))
    within = F.shiftrightunsigned(F.col("shuffle"), 11) * F.lit(2.0**-53)
    # the last block of each source's last pass: one block, in order until the first that doesn't fit
    cut = with_blocks.where("tokens > 0").join(small_or_not(turns.where("not whole")), same).withColumn("shuffle", shuffle)
    cut = cut.withColumn("used", F.sum("tokens").over(Window.partitionBy("source", "block").orderBy("shuffle", "mark").rangeBetween(Window.unboundedPreceding, Window.currentRow)))
    cut = materialise(cut.where("used <= left").select(F.col("mark").alias("cut_mark"), F.col("source").alias("cut_source"), F.col("copy").alias("cut_copy")).distinct())

    def chosen(rows: DataFrame) -> DataFrame:
        """All copies of rows (source, mark, tokens)."""
        some = placed(rows.where("tokens > 0")).join(small_or_not(turns), same)
        some = some.join(small_or_not(cut), (F.col("mark") == F.col("cut_mark")) & F.col("source").eqNullSafe(F.col("cut_source")) & (F.col("copy") == F.col("cut_copy")), "left")
        some = some.where("whole or cut_mark is not null").withColumn("shuffle", shuffle).select(*rows.columns, "copy", (F.col("begin") + F.col("width") * within).alias("at"))
        none = rows.where("tokens = 0").select("*", F.lit(0).alias("copy"), F.lit(0.0).alias("at"))
        return some.unionByName(none)

    if not keep_columns:
        return chosen(items).select(F.col("key").alias(key), F.col("source").alias(source), "copy", F.col("tokens").alias("n_tokens"), "at")
    rows = chosen(df.select(packed(df).alias("row"), named(source).alias("source"), mark.alias("mark"), token_count(named(text)).alias("tokens")))
    if not places:
        return rows.select(*unpacked("row", df.columns))
    return rows.select(*[c for c, name in zip(unpacked("row", df.columns), df.columns, strict=True) if name not in ("copy", "at")], "copy", "at")
