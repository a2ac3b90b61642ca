import random
import re
from collections import defaultdict

import numpy as np

from cairn.llm import near_dedup as nd
from cairn.llm.components import connected_components

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def plain_set(text):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def plain(texts):
    sets = [plain_set(t) for t in texts]
    parent = list(range(len(texts)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(len(sets)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)]


def edits(r, words, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.randint(0, 9999)}"
    return " ".join(w)


def test_equals_brute_force(docs):
    r = random.Random(7)
    texts = []
    for g in range(12):
        base = [f"w{r.randint(0, 400)}" for _ in range(r.choice([60, 120, 200]))]
        texts += [edits(r, base, r.choice([0, 0, 1, 2, 3, 4, 6])) for _ in range(r.choice([1, 2, 5, 25]))]
    texts += [None, "", " \t\n", "one two", "ONE  two\n", "one two three", "É x", "é x", "a b c d e", "A b c d E", "a\x0bb\x0cc d e", "a\xa0b c d e"]
    r.shuffle(texts)
    got = sorted(tuple(x) for x in nd.near_duplicates(docs(*texts)).collect())
    assert got == plain(texts)


def test_large_group_of_near_copies(docs, monkeypatch):
    monkeypatch.setattr(nd, "PIVOTS", 2)
    monkeypatch.setattr(nd, "GROWTH", 2)
    r = random.Random(1)
    base = [f"w{i}" for i in range(100)]
    texts = [edits(r, base, r.randint(0, 6)) for _ in range(150)]
    assert sorted(tuple(x) for x in nd.near_duplicates(docs(*texts)).collect()) == plain(texts)


def test_estimate_is_near_the_similarity(spark):
    rng = np.random.default_rng(5)
    common = rng.integers(0, 1 << 62, 300, dtype=np.uint64)
    rows = []
    for share in (0.0, 0.5, 0.8, 1.0):
        n = int(300 * share)
        other = np.concatenate([common[:n], rng.integers(0, 1 << 62, 300 - n, dtype=np.uint64)])
        sig = []
        for s in (common, other):
            low = nd.minima(s)
            sig.append([int(x) for b in range(nd.BITS) for x in np.packbits((low >> np.uint32(b) & np.uint32(1)).astype(np.uint8)).view(">i8").astype(np.int64)])
        rows.append((n / (600 - n), *sig))
    df = spark.createDataFrame(rows, "want double, a array<long>, b array<long>")
    for r in df.select("want", nd.estimate(df.a, df.b).alias("got")).collect():
        assert abs(r["want"] - r["got"]) < 0.15


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)] + [(200, i) for i in range(201, 260)]
    got = {x["id"]: x["component"] for x in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    groups = {}
    for a, b in pairs:
        ga, gb = groups.get(a, {a}), groups.get(b, {b})
        for x in (whole := ga | gb):
            groups[x] = whole
    assert got == {x: min(g) for x, g in groups.items() if len(g) > 1}
    assert connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_odd_tables(odd_docs, docs):
    got = [tuple(r) for r in nd.near_duplicates(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    by = defaultdict(set)
    for key, n, component, kept in got:
        by[key].add((n, component, kept))
    assert by[0] == {(2, 0, True)} and by[5] == {(2, 0, False)} and by[1] == {(0, 1, True)} and by[2] == {(0, 2, True)}
    assert by[None] == {(2, None, None), (0, None, None)} and by[4] == {(1, 4, True)}
    kept = nd.deduplicated(odd_docs)
    assert kept.columns == odd_docs.columns and kept.where("doc_id = 4").first()["a.b"] == odd_docs.first()["a.b"] and sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (False, 1), (False, 2), (False, 3), (False, 4), (False, 7), (True, 0), (True, 0)]
    assert nd.near_duplicates(docs("x").where("false")).isEmpty()


def test_ids_with_several_texts_and_text_keys(spark):
    r = random.Random(4)
    base = [[f"w{g}{r.randint(0, 400)}" for _ in range(80)] for g in range(4)]
    near = lambda g: edits(r, base[g], 1)
    rows = [(5, near(0)), (7, near(0)), (5, near(1)), (9, near(1)), (5, near(0)), (6, near(2)), (6, near(2)), (3, near(3)), (8, near(3)), (8, "alone and short"), (2, ""), (2, None), (2, "")]
    for cast in ("long", "string"):
        df = spark.createDataFrame(rows, "k long, t string").selectExpr(f"cast(k AS {cast}) AS k", "t", "1 AS id", "2 AS class")
        of = lambda k: k if cast == "long" else str(k)
        got = sorted((x["k"], x["n_shingles"] > 1, x["component_id"], x["kept"]) for x in nd.near_duplicates(df, "t", "k").collect())
        assert got == sorted((of(k), n, of(c), k == c) for k, n, c in [(5, 1, 5), (7, 1, 5), (5, 1, 5), (9, 1, 5), (5, 1, 5), (6, 1, 6), (6, 1, 6), (3, 1, 3), (8, 1, 3), (8, 0, 8), (2, 0, 2), (2, 0, 2), (2, 0, 2)])
        kept = [x["k"] for x in nd.deduplicated(df, "t", "k").collect()]
        # two components keep 5, one keeps 6; an empty and a null text stay once each
        assert sorted(kept) == sorted(of(k) for k in (5, 5, 6, 3, 8, 2, 2))
