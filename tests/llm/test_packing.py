import random
from collections import Counter, defaultdict

from cairn.llm import packing


def plain(items, capacity, per_source):
    """Best fit by looking at every bin; of bins with equal room the one that was opened first."""
    bins = []
    out = []
    for length, source, cluster in items:
        fit = [b for b in bins if b["room"] >= length and cluster not in b["clusters"] and b["sources"][source] < per_source]
        if fit:
            b = min(fit, key=lambda b: (b["room"], b["n"]))
        else:
            b = {"room": capacity, "clusters": set(), "sources": Counter(), "n": len(bins)}
            bins.append(b)
        out.append((b["n"], capacity - b["room"]))
        b["room"] -= length
        b["clusters"].add(cluster)
        b["sources"][source] += 1
    return out


def test_search_finds_the_tightest_compatible_bin():
    r = random.Random(3)
    for per_source in (1, 2, 9):
        items = [(r.randint(1, 60), r.choice("abc"), r.randint(0, 15)) for _ in range(600)]
        p = packing.Packer(100, per_source)
        assert [p.place(*i) for i in items] == plain(items, 100, per_source)


def test_a_table_equals_brute_force(docs):
    r = random.Random(11)
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(0, 150))) for _ in range(120)] + ["copy of one text"] * 15
    sources = [r.choice(["a", "b", None]) for _ in texts]
    got = {(x["doc_id"], x["piece"]): (x["bin_id"], x["bin_offset"]) for x in packing.pack(docs(*[(t, "en", s) for t, s in zip(texts, sources)]), capacity=100, per_source=2, shard=10_000).collect()}
    size = [len(t.encode()) for t in texts]
    want, bins, places = {}, 0, []
    # whole bins are opened in the order of items as well, so numbers agree up to a renaming
    for i in sorted(range(len(texts)), key=lambda i: (-(size[i] % 100), i)):
        places.append(i)
    packed = plain([(size[i] % 100, sources[i], texts[i]) for i in places if size[i] % 100], 100, 2)
    for i, at in zip([i for i in places if size[i] % 100], packed):
        want[i] = at
    names = {}
    for i, (b, offset) in want.items():
        g = got[i, size[i] // 100]
        assert g[1] == offset and names.setdefault(b, g[0]) == g[0]
    assert len(set(names.values())) == len(names)
    assert all(got[i, p][1] == 0 and got[i, p][0] not in names.values() for i, n in enumerate(size) for p in range(n // 100))


def check(pieces, capacity, per_source, texts):
    bins = defaultdict(list)
    length = Counter()
    for r in pieces:
        length[r["doc_id"]] += r["length"]
        assert r["start"] == r["piece"] * capacity
        if r["bin_id"] is not None:
            bins[r["bin_id"]].append(r)
    assert length == Counter({i: len((t or "").encode()) for i, t in enumerate(texts)})
    for rows in bins.values():
        rows.sort(key=lambda r: r["bin_offset"])
        at = 0
        for r in rows:
            assert r["bin_offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= capacity
        assert max(Counter(r["source"] for r in rows).values()) <= per_source
        same = Counter(texts[r["doc_id"]] for r in rows)
        assert max(same.values()) == 1
    return len(bins)


def test_bins_hold_all_and_conflict_nowhere(docs):
    r = random.Random(5)
    texts = ["".join(r.choice("abé ") for _ in range(r.randint(0, 300))) for _ in range(200)] + ["copy of one text"] * 40 + [None, ""]
    df = docs(*[(t, "en", r.choice(["a", "b", "c", None])) for t in texts])
    for shard in (10_000, 30):
        check(packing.pack(df, capacity=256, per_source=3, shard=shard).collect(), 256, 3, texts)


def test_odd_tables(odd_docs, docs):
    got = packing.pack(odd_docs, capacity=64).collect()
    assert sum(r["length"] for r in got) == sum(len((r["text"] or "").encode()) for r in odd_docs.collect())
    assert packing.pack(docs("x").where("false")).count() == 0
    assert [(r["bin_id"], r["length"]) for r in packing.pack(docs(None)).collect()] == [(None, 0)]
