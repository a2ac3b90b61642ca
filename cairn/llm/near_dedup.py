"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct five-word shingles.  Of each set,
``HASHES`` minima are taken; bands of ``ROWS`` minima give candidates, and the
lowest ``BITS`` bits of every minimum are packed into a signature.  For a
candidate pair the packed signatures are compared by counting bits, the share
of equal values is corrected for chance collisions, and pairs that are clearly
below the threshold go.  The rest is confirmed on the full sets, so a link is
exact.  A pair at the threshold of 0.75 fails to share a band with a probability
of 5e-6, and to pass the estimate (0.2 below the threshold, five standard
deviations) with 3e-7.

Documents with equal sets form a class that is handled as one; the classes are one
table, from which buckets, signatures and sizes are read.  In a band's
bucket not all pairs are made: all members are compared with one pivot, links
join components, and only buckets that still hold several components get further
pivots: all members outside the largest component where these are few, else some
more of all, until every pair of a bucket is in one component or was compared.
Before that, bounds on what can be in common leave out what can't be a link:
shingles that no other undecided document has, and those of a bucket's most
central member that one of two others lacks.
Work in a large bucket of mutual copies so is in proportion to its size, and no
link between different components is left out.  What is known of a bucket is one row,
joined as a table of its own, so a bucket's members can lie in any number of tasks.

Edge cases: a text that is null, empty or without words has the empty set and is
linked with nothing; fewer than five words are one shingle, the whole sequence;
rows that repeat an id belong to the class of their text each, so that an id with
several texts has all their links; keys may have any type that has an order; a null id takes no
part and has null results; an empty table gives an empty result; other columns are ignored by
:func:`near_duplicates` and pass through :func:`deduplicated`, whatever their names.  Texts are
read whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import arrow_map, materialise, named, packed, place_filter, small_or_not, stored_rows, unpacked
from cairn.llm.components import connected_components
from cairn.sources.scratch import forget_sizes

WORDS = 5
HASHES = 128
ROWS = 4
BITS = 4
THRESHOLD = 75  # per cent
MARGIN = 0.2
#: Pivots of an undecided bucket, how their number grows from round to round, and those of the first of these rounds.
PIVOTS = 16
GROWTH = 4
CENTRAL = 4
#: Rows that are broadcast in the rounds over buckets, of which there can be many.
FEW_ROWS = 20_000

#: Fixed value: ASCII capitals become small letters.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_RNG = np.random.default_rng(20240229)
_MIX = _RNG.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_STEP = (_RNG.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_PLACE = _RNG.integers(0, 1 << 63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND = _RNG.integers(0, 1 << 63, (HASHES // ROWS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2, _S = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(33)


def _mixed(x: np.ndarray) -> np.ndarray:
    x ^= x >> _S
    x *= _M1
    x ^= x >> _S
    x *= _M2
    x ^= x >> _S
    return x


def shingles(text: str | None) -> np.ndarray:
    """The sorted 64-bit hashes of a text's distinct shingles."""
    # bytes.split() divides at 09-0D and 20, the separators of the definition
    words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < WORDS:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words))], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    total = np.zeros(n, np.uint64)
    for i in range(WORDS):
        total += h[i : i + n] * _PLACE[i]
    return np.unique(_mixed(total))


def minima(sets: np.ndarray) -> np.ndarray:
    """The minimum of a set under each of ``HASHES`` hash functions."""
    folded = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(folded), 1024):
        np.minimum(low, ((folded[start : start + 1024][None, :] ^ _MIX) * _STEP).min(axis=1), out=low)
    return low


def _class(s: np.ndarray) -> bytes | None:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None


def _sketches(batch: pa.RecordBatch) -> pa.RecordBatch:
    sizes, classes, lows = [], [], []
    for text in batch.column(2).to_pylist():
        s = shingles(text)
        sizes.append(len(s))
        classes.append(_class(s))
        lows.append(minima(s))
    low = np.stack(lows)
    bands = _mixed((low.reshape(len(lows), -1, ROWS).astype(np.uint64) * _BAND).sum(axis=2, dtype=np.uint64)).view(np.int64)
    slices = [np.packbits((low >> np.uint32(b) & np.uint32(1)).astype(np.uint8), axis=1).view(">i8").astype(np.int64) for b in range(BITS)]
    sig = np.concatenate(slices, axis=1)
    offsets = lambda m: pa.array(np.arange(len(lows) + 1, dtype=np.int32) * m.shape[1])
    lists = [pa.ListArray.from_arrays(offsets(m), pa.array(m.ravel())) for m in (bands, sig)]
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), *lists], ["key", "mark", "n", "class", "bands", "sig"])


def _sets(batch: pa.RecordBatch) -> pa.RecordBatch:
    sets = [shingles(t) for t in batch.column(1).to_pylist()]
    ends = pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32())
    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(sets).view(np.int64)))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_class, sets), pa.binary()), lists], ["key", "class", "shingles"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity of two packed signatures: the share of equal b-bit values, corrected for collisions."""
    halves = HASHES // 64
    unlike = F.lit(0)
    for h in range(halves):
        word = lambda x, i, h=h: x[i * halves + h]
        differs = word(a, 0).bitwiseXOR(word(b, 0))
        for i in range(1, BITS):
            differs = differs.bitwiseOR(word(a, i).bitwiseXOR(word(b, i)))
        unlike = unlike + F.bit_count(differs)
    chance = 2.0**-BITS
    return ((F.lit(1.0) - unlike / HASHES) - chance) / (1 - chance)


_LACKS = [f"lack_{i}" for i in range(4)]


def _against(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """For pairs (id, ref): the size of ref's set, which of its shingles the id lacks (folded to 256 bits) and how many others the id has.

    Two ids have at most as many shingles in common as ref has without those that either lacks, and others.
    Folding only lowers the count of what they lack, so the bound stays one.
    """
    both = pairs.join(full, "id").join(full.select(F.col("id").alias("ref"), F.col("shingles").alias("theirs")), "ref")
    both = both.withColumn("lack", F.array_except("theirs", "shingles"))
    word = lambda i: F.expr(f"aggregate(filter(lack, s -> (shiftright(s, 6) & 3) = {i}), 0L, (acc, s) -> acc | shiftleft(1L, cast(s & 63 as int)))")
    return both.select("id", "ref", F.size("theirs").alias("ref_n"), F.size(F.array_except("shingles", "theirs")).alias("beside"), *[word(i).alias(c) for i, c in enumerate(_LACKS)])


def _few_parts(df: DataFrame, rows: int = 20_000) -> DataFrame:
    """Materialised, in no more parts than its rows need: parts of a few rows cost files and tasks in every later shuffle."""
    stored = forget_sizes(materialise(df))
    out = stored.coalesce(max(8, stored_rows(stored) // rows))
    out._stored_rows = stored_rows(stored)
    return out


def _release(df: DataFrame) -> None:
    """Has the driver's JVM collect what earlier rounds left: Spark removes their broadcasts, shuffle files and checkpoints only once they are collected, which an idle heap would put off."""
    df.sparkSession._jvm.System.gc()


def few_or_not(df: DataFrame) -> DataFrame:
    """A materialised frame for a join: broadcast up to ``FEW_ROWS`` rows."""
    return small_or_not(df, FEW_ROWS)


def _members(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row per input row: key, mark (a hash of the text), n (size of its set), label (a number of its component, null without words), component (smallest key reachable)."""
    source = df.select(named(key).alias("key"), F.xxhash64(named(text)).alias("mark"), named(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    sketches = materialise(arrow_map(source, _sketches, f"key {kind}, mark long, n long, class binary, bands array<bigint>, sig array<bigint>"))
    usable = sketches.where("n > 0 and key is not null")
    classes = usable.groupBy("class").agg(F.min("key").alias("key"), *[F.first(c).alias(c) for c in ("n", "sig", "bands")])
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()))
    known = classes.select("id", "n", "sig", F.col("n").alias("common"))

    rows = classes.select("id", F.explode("bands").alias("bucket"))
    shared = _few_parts(rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1"), 200_000)
    words, places = place_filter(shared.select("bucket"), stored_rows(shared))
    likely_shared = rows.join(F.broadcast(words), F.shiftright(F.pmod("bucket", F.lit(places)), 6) == F.col("word")).where(F.expr(f"shiftright(bits, cast(pmod(bucket, {places}) & 63 as int)) & 1 = 1"))  # two million words at most
    met = _few_parts(likely_shared.select("bucket", "id").join(shared, "bucket"), 200_000)
    # the text that a group was made from is in most of the group's buckets, so the best pivot is who meets most others
    meets = met.groupBy("id").agg(F.sum("members").alias("meets"))
    pivots = _few_parts(met.join(meets, "id").groupBy("bucket").agg(F.max_by("id", "meets").alias("pivot")), 200_000)
    open_rows = _few_parts(met.select("bucket", "id").join(pivots, "bucket").where("id <> pivot"), 200_000)

    repeated = not sketches.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()

    def sets_of(ids: DataFrame) -> DataFrame:
        """(id, shingles): the full sets of some classes, each from one of its texts."""
        wanted = _few_parts(ids.join(classes.select("id", "class", "key"), "id"))
        words, places = place_filter(wanted.select(F.xxhash64("key")), stored_rows(wanted))
        place = F.pmod(F.xxhash64("key"), F.lit(places))
        some = source.where("key is not null").select("key", "text", place.alias("place")).join(F.broadcast(words), F.shiftright("place", 6) == F.col("word"))  # two million words at most
        made = arrow_map(some.where(F.expr("shiftright(bits, cast(place & 63 as int)) & 1 = 1")).select("key", "text"), _sets, f"key {kind}, class binary, shingles array<bigint>")
        full = made.join(small_or_not(wanted), ["class", "key"]).select("id", "shingles")
        return _few_parts(full.dropDuplicates(["id"]) if repeated else full)

    def likely_of(pairs: DataFrame, facts: DataFrame) -> DataFrame:
        """Of the pairs (a, b), those that may be links by ``facts`` (id, n, sig, common: shingles that others may share)."""
        side = lambda c: facts.select(F.col("id").alias(c), *[F.col(x).alias(f"{x}_{c}") for x in ("n", "sig", "common")])
        both = pairs.join(side("a"), "a").join(side("b"), "b")
        most = F.least("common_a", "common_b")
        return both.where((100 * most >= THRESHOLD * (F.col("n_a") + F.col("n_b") - most)) & (estimate(F.col("sig_a"), F.col("sig_b")) >= THRESHOLD / 100 - MARGIN)).select("a", "b", "n_a", "n_b")

    def confirmed(likely: DataFrame, full: DataFrame) -> DataFrame:
        has = lambda c: full.select(F.col("id").alias(c), F.col("shingles").alias(f"set_{c}"))
        both = likely.join(has("a"), "a").join(has("b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        return both.where(100 * F.col("common") >= THRESHOLD * (F.col("n_a") + F.col("n_b") - F.col("common"))).select("a", "b")

    # every bucket's members with its pivot
    likely = _few_parts(likely_of(open_rows.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct(), known))
    labels = connected_components(confirmed(likely, sets_of(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct())))
    left = open_rows.select("bucket", "id")
    full = facts = None
    for turn in range(1 << 30):
        few = PIVOTS * GROWTH**turn
        _release(df)
        # a bucket is decided once all its members are in one component
        now = _few_parts(left.join(labels, "id", "left").select(*left.columns, F.coalesce("component", "id").alias("component")), 200_000)
        sizes = now.groupBy("bucket", "component").agg(F.count("*").alias("of_it")).groupBy("bucket")
        sizes = sizes.agg(F.sum("of_it").alias("members"), F.max(F.struct("of_it", "component")).alias("most"), F.count("*").alias("components"))
        undecided = sizes.where("components > 1").select("bucket", "members", F.col("most.component").alias("main"), (F.col("members") - F.col("most.of_it")).alias("outside"))
        undecided = _few_parts(undecided)
        if not stored_rows(undecided):
            break
        now = _few_parts(now.join(few_or_not(undecided), "bucket"), 200_000)
        if full is None:
            # shingles of one document only can't be in common: many texts so can link with none of their buckets
            full = sets_of(now.select("id").distinct())
            alone = full.select("id", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.min("id").alias("id"), F.count("*").alias("n")).where("n = 1").groupBy("id").agg(F.count("*").alias("alone"))
            facts = known.drop("common").join(full.select("id"), "id").join(alone, "id", "left").select("id", "n", "sig", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("common"))
            facts = _few_parts(facts)
            now = _few_parts(now.join(facts.select("id", "n", "common"), "id"), 200_000)
        own = F.col("n") - F.col("common")
        # those with the fewest shingles of their own are nearest to what the others were made from
        central = [F.min(F.struct(own.alias("own"), F.xxhash64("id", F.lit(i)), "id")).getField("id") for i in range(CENTRAL)]
        per = now.groupBy("bucket").agg(F.min("n").alias("smallest"), F.min(F.struct(own.alias("own"), "id")).getField("id").alias("ref"), *([F.array(*central).alias("central")] if turn == 0 else []))
        able = 100 * F.col("common") >= THRESHOLD * (F.col("n") + F.greatest("smallest", "common") - F.col("common"))
        now = _few_parts(now.join(few_or_not(_few_parts(per)), "bucket").where(able), 200_000)
        # few outside the main component: with all of them as pivots nothing is left to compare; else the same ids in all buckets
        chosen, extra = F.shiftrightunsigned(F.xxhash64("id", F.lit(turn)), 11) * F.lit(2.0**-53) < few / F.col("members"), []
        if turn == 0:
            chosen = F.array_contains("central", F.col("id"))
        else:
            now = now.join(_against(now.select("id", "ref").distinct(), full), ["id", "ref"]).withColumn("beside", F.greatest(F.lit(0), F.col("beside") - own))
            extra = ["beside", *_LACKS]
        now = _few_parts(now.withColumn("is_pivot", F.when(F.col("outside") <= few, F.col("component") != F.col("main")).otherwise(chosen)), 200_000)
        pivots = _few_parts(now.where("is_pivot").select(F.col("bucket").alias("p_bucket"), *[F.col(c).alias(f"p_{c}") for c in ("id", "component", "n", "common", *extra)]))
        most = F.least("common", "p_common")
        if extra:
            most = F.least(most, F.col("ref_n") - sum((F.bit_count(F.col(c).bitwiseOR(F.col(f"p_{c}"))) for c in _LACKS), F.lit(0)) + F.least("beside", "p_beside"))
        enough = 100 * most >= THRESHOLD * (F.col("n") + F.col("p_n") - most)
        pairs = now.join(few_or_not(pivots), (F.col("bucket") == F.col("p_bucket")) & (F.col("component") != F.col("p_component")) & enough)
        pairs = pairs.select(F.least("id", "p_id").alias("a"), F.greatest("id", "p_id").alias("b")).distinct()
        likely = _few_parts(likely_of(pairs, facts))
        _release(df)
        links = confirmed(likely, full)
        labels = connected_components(labels.where("id <> component").select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links))
        left = now.where((F.col("outside") > few) & ~F.col("is_pivot")).select("bucket", "id", "n", "common")

    _release(df)
    # a component's key is the smallest of its classes'
    keyed = labels.join(classes.select("id", "key"), "id")
    least = _few_parts(keyed.groupBy("component").agg(F.min("key").alias("least")))
    named_ids = _few_parts(labels.join(small_or_not(least), "component").select("id", F.col("component").alias("label"), "least"))
    final = classes.select("id", "class", "key").join(small_or_not(named_ids), "id", "left").select("class", F.coalesce("label", "id").alias("label"), F.coalesce("least", "key").alias("least"))
    members = sketches.select("key", "mark", "n", F.when(F.col("key").isNotNull(), F.col("class")).alias("class")).join(final, "class", "left")
    return members.select("key", "mark", "n", "label", F.coalesce("least", "key").alias("component"))


def near_duplicates(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per input row: the key, ``n_shingles``, ``component_id`` (smallest key reachable over links) and ``kept`` (the key is the component)."""
    return _members(df, text, key).select(F.col("key").alias(key), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), (F.col("key") == F.col("component")).alias("kept"))


def deduplicated(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that :func:`near_duplicates` keeps, one of each component.

    Of rows that repeat an id, one stays for each component that keeps it, and one for each text without words; rows without an id stay.
    """
    members = materialise(_members(df, text, key).where("key is not null"))
    gone = members.where("key <> component").select("key", "mark")
    repeated = not members.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1").isEmpty()
    if repeated:
        kept = members.where("key = component").withColumn("alone", F.when(F.col("label").isNull(), F.col("mark")))
        least = kept.groupBy("key", "label", "alone").agg(F.min("mark").alias("stays")).toDF("l_key", "l_label", "l_alone", "stays")
        same = kept.join(least, (F.col("key") == F.col("l_key")) & F.col("label").eqNullSafe(F.col("l_label")) & F.col("alone").eqNullSafe(F.col("l_alone")))
        gone = gone.unionByName(same.where("mark <> stays").select("key", "mark"))
    gone = materialise(gone.distinct().toDF("g_key", "g_mark"))
    rows = df.select(named(key).alias("key"), F.xxhash64(named(text)).alias("mark"), packed(df).alias("row"))
    out = rows.join(small_or_not(gone), (F.col("key") == F.col("g_key")) & (F.col("mark") == F.col("g_mark")), "left_anti")
    if repeated:
        out = out.where("key is not null").dropDuplicates(["key", "mark"]).unionByName(out.where("key is null"))
    return out.select(*unpacked("row", df.columns))
