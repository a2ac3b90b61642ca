import math
import random
import struct
from collections import Counter, defaultdict

import pytest
import xxhash

from cairn.llm import mixing


def spark_hash(*values):
    """What Spark's xxhash64 gives: each value's bytes hashed with the hash so far; a null changes nothing."""
    h = 42
    for kind, v in values:
        if v is not None:
            data = v.encode() if kind == "s" else struct.pack("<i" if kind == "i" else "<q", v)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def unit(h):
    return ((h % (1 << 64)) >> 11) * 2.0**-53


def plain(rows, exponent, budget, block_docs, seed=0):
    """The mixture of rows (key, text, source) under an exponent, source by source, pass by pass, block by block."""
    of = defaultdict(list)
    out = Counter()
    for key, text, source in rows:
        n = len((text or "").split())
        if n:
            of[source].append((spark_hash(("q", key), ("s", text), ("i", seed)), n, key))
        else:
            out[key, source, 0, 0, 0.0] += 1
    total = {s: sum(n for _, n, _ in docs) for s, docs in of.items()}
    docs_in = Counter(r[2] for r in rows)
    z = sum(t**exponent for t in total.values())
    whole = max(t / t**exponent for t in total.values())
    for source, docs in of.items():
        target = total[source] ** exponent / z * (budget if budget is not None else whole * z)
        blocks = math.ceil(docs_in[source] / block_docs)
        inside = defaultdict(list)
        for mark, n, key in docs:
            inside[mark % blocks].append((mark, n, key))
        passes = math.floor(target / total[source] + 1e-9)
        for copy in range(passes + 1):
            room = total[source] if copy < passes else max(0.0, target - passes * total[source])
            used = 0
            for block in sorted(inside, key=lambda b: spark_hash(("s", source), ("q", b), ("i", copy), ("i", seed))):
                size = sum(n for _, n, _ in inside[block])
                left = size if copy < passes else room - used
                if left <= 0:
                    break
                width, begin = min(left, size) / target, (copy * total[source] + used) / target
                place = lambda mark: spark_hash(("q", mark), ("i", copy), ("i", seed + 1))
                taken = 0
                for mark in sorted({m for m, _, _ in inside[block]}, key=lambda m: (place(m), m)):
                    same = [(n, key) for m, n, key in inside[block] if m == mark]
                    taken += sum(n for n, _ in same)
                    if left < size and taken > left:
                        break
                    for n, key in same:
                        out[key, source, copy, n, round(begin + width * unit(place(mark)), 9)] += 1
                used += size
    return out


@pytest.mark.parametrize("block,budget,repetition", [(1000, None, 2.0), (9, None, 3.0), (9, 900, 2.0), (4, 77, 1.0)])
def test_equals_brute_force(docs, spark, monkeypatch, block, budget, repetition):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    r = random.Random(5)
    rows = [(i, " ".join("w" * r.randint(1, 4) for _ in range(r.choice([0, 1, 3, 9, 30]))), r.choice(["a", "a", "a", "b", "b", None, "c"]) if i > 20 else "d") for i in range(150)]
    rows += [rows[30], rows[30], (999, None, "a"), (1000, "alone here", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = Counter()
    for _, t, s in rows:
        total[s] += len((t or "").split())
    shares = sorted(t / sum(total.values()) for t in total.values())
    want = max(0.0, 1 + math.log(repetition) / math.log(shares[0] / shares[-1]))
    items = df.select("source", mixing.token_count(df.text).alias("tokens"))
    exponent = mixing.plan_mixture(items, repetition, None, budget).exponent
    assert abs(exponent - want) < 1e-6
    got = Counter((x["doc_id"], x["source"], x["copy"], x["n_tokens"], round(x["at"], 9)) for x in mixing.mix(df, repetition=repetition, budget=budget).collect())
    assert got == plain(rows, exponent, budget, block)


def table(docs, sizes, words=10):
    return docs(*[(" ".join(["w"] * words), "en", s) for s, n in sizes.items() for _ in range(n)])


def chosen(df):
    per = defaultdict(lambda: defaultdict(list))
    for r in df.collect():
        per[r["source"]][r["copy"]].append(r["doc_id"])
    return per


def test_repetition_limit_and_whole_passes(docs):
    df = table(docs, {"big": 400, "mid": 100, "small": 20})
    per = chosen(mixing.mix(df, repetition=2.0))
    assert len(per["big"][0]) == 400 and list(per["big"]) == [0]
    # the smallest source twice, within the limit and one document
    assert len(per["small"][0]) == 20 and 18 <= len(per["small"][1]) <= 20
    exponent = 1 + math.log(2) / math.log(20 / 400)
    assert abs(len(per["mid"][0]) + len(per["mid"][1]) - 100 * (100 / 400) ** (exponent - 1)) <= 1
    assert all(len(set(c)) == len(c) for p in per.values() for c in p.values())


def test_entropy_target(docs, spark):
    df = table(docs, {"a": 300, "b": 60, "c": 20})
    items = df.select("source", mixing.token_count(df.text).alias("tokens"))
    m = mixing.plan_mixture(items, entropy=1.3)
    weights = [r["weight"] for r in m.plan.collect()]
    assert abs(sum(weights) - 1) < 1e-9 and abs(-sum(w * math.log2(w) for w in weights) - 1.3) < 1e-4
    assert mixing.plan_mixture(items, entropy=9.0).exponent == 0.0


@pytest.mark.parametrize("block", [1000, 7])
def test_budget_is_met_by_blocks(docs, monkeypatch, block):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", block)
    df = table(docs, {"a": 120, "b": 40, None: 30})
    per = chosen(mixing.mix(df, repetition=100.0, budget=600))  # exponent 0: 20 documents each
    assert {s: sum(len(c) for c in p.values()) for s, p in per.items()} == {"a": 20, "b": 20, None: 20}
    assert chosen(mixing.mix(df, repetition=100.0, budget=600)) == per


def test_order_interleaves_sources(docs):
    df = table(docs, {"a": 200, "b": 100})
    rows = sorted(mixing.mix(df, repetition=1.0).collect(), key=lambda r: r["at"])
    assert all(0 <= r["at"] < 1 for r in rows)
    first = [r["source"] for r in rows[:150]]
    assert 85 <= first.count("a") <= 115


def test_no_python_in_the_plan(docs):
    plan = mixing.mix(table(docs, {"a": 20, "b": 4}), keep_columns=True)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_odd_tables(odd_docs, docs):
    got = mixing.mix(odd_docs, repetition=1.0).collect()
    assert sorted(r["n_tokens"] for r in got if r["copy"] == 0) == sorted(len((r["text"] or "").split()) if r["doc_id"] != 7 else 3 for r in odd_docs.collect())
    kept = mixing.mix(odd_docs, repetition=1.0, keep_columns=True)
    assert kept.columns == [*(c for c in odd_docs.columns if c not in ("copy", "at")), "copy", "at"] and kept.where("copy = 0").count() == odd_docs.count()
    whole = mixing.mix(odd_docs, repetition=1.0, keep_columns=True, places=False)
    assert whole.columns == odd_docs.columns and Counter(map(repr, whole.collect())) == Counter(map(repr, odd_docs.collect()))
    assert mixing.mix(docs("x").where("false")).count() == 0
    assert [r["copy"] for r in mixing.mix(docs(None, "")).collect()] == [0, 0]
