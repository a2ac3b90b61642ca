import random
import re
from collections import Counter, defaultdict

import pytest

from cairn.llm import line_dedup as ld


def plain(texts, min_docs, min_tokens=3):
    """The same by the definition: all lines in dictionaries, nothing of the operator's own code."""
    split = lambda raw: tuple(re.sub(r"\d+", "0", x) for x in raw.split())
    need = lambda n: min(min_docs, 3) if n >= 20 else min_docs
    docs = [[split(raw) for raw in (x or "").split("\n")] for x in texts]
    at, after = Counter(), Counter()
    for lines in docs:
        for line in {x for x in lines if len(x) >= min_tokens}:
            for i in range(3, len(line)):
                at[len(line), line[:3], i, line[i]] += 1
                after[len(line), line[:3], i, line[i - 1], line[i]] += 1

    def most_frequent(found, n):
        good = {t: c for t, c in found.items() if c >= need(n)}
        return min(good, key=lambda t: (-good[t], t)) if good else None

    by_place, by_before = defaultdict(dict), defaultdict(dict)
    for (n, first, i, token), c in at.items():
        by_place[n, first, i][token] = c
    for (n, first, i, before, token), c in after.items():
        by_before[n, first, i, before][token] = c

    def template(line):
        n, first, out = len(line), line[:3], list(line[:3])
        for i in range(3, n):
            if at[n, first, i, line[i]] >= need(n):
                out.append(line[i])
            elif out[-1] is None:
                out.append(most_frequent(by_place[n, first, i], n))
            else:
                out.append(most_frequent(by_before[n, first, i, out[-1]], n))
        agree = sum(a == b for a, b in zip(out, line))
        return (n, *out) if 10 * agree >= 7 * n else (n, *line)

    met = defaultdict(list)
    for d, lines in enumerate(docs):
        for p, line in enumerate(lines):
            if len(line) >= min_tokens:
                met[template(line)].append((d, p))
    gone = set()
    for line, places in met.items():
        if len({d for d, _ in places}) >= need(line[0]):
            gone |= set(sorted(places)[1:])
    return [None if x is None else "\n".join(raw for p, raw in enumerate(x.split("\n")) if (i, p) not in gone) for i, x in enumerate(texts)]


def letters(n):
    return "".join(chr(97 + int(d)) for d in str(n))


def sample(seed, n=80):
    r = random.Random(seed)
    boiler = ["All rights reserved by us", "Page 3 of 17 in this list", "short one", "a passage of many words " * 15]
    texts = []
    for i in range(n):
        lines = [" ".join(f"w{r.choice('abcdefghijklmnop')}{r.choice('xyz')}" for _ in range(r.randint(1, 12))) for _ in range(r.randint(1, 5))]
        for b in boiler:
            if r.random() < 0.4:
                lines.insert(r.randint(0, len(lines)), b.replace("3", str(r.randint(1, 99))))
        texts.append("\n".join(lines))
    return texts


@pytest.mark.parametrize("at_once", [128, 1, 3])
def test_equals_the_plain_way_however_leaves_are_dealt(docs, monkeypatch, at_once):
    monkeypatch.setattr(ld, "LINES_AT_ONCE", at_once)
    texts = sample(1) + [None, "", "\n\n", "All rights reserved by us"]
    got = {r["doc_id"]: r for r in ld.drop_recurring_lines(docs(*texts), min_docs=5).collect()}
    assert [got[i]["text"] for i in range(len(texts))] == plain(texts, 5)
    left = "\n".join(r["text"] or "" for r in got.values()).split("\n")
    assert left.count("All rights reserved by us") == 1 and sum(x.startswith("a passage") for x in left) == 1 and sum(x.startswith("Page ") for x in left) == 1
    assert left.count("short one") > 5


def variants(seed, n=120):
    """Lines of three templates in one leaf, with several variable fields, rare and frequent values and edits anywhere."""
    r = random.Random(seed)
    base = [["the", "same", "start", *[k + letters(i) for i in range(3, 24)]] for k in "abc"]
    texts = []
    for i in range(n):
        line = list(r.choice(base))
        for at in r.sample(range(3, 24), r.choice([0, 1, 2, 4, 9])):
            line[at] = r.choice(["rare" + letters(r.randint(0, 10**6)), "often", "more"])
        texts.append(f"{letters(i)} is where this text begins\n" + " ".join(line))
    return texts


@pytest.mark.parametrize("at_once", [128, 1, 7])
def test_several_variable_fields_in_one_large_leaf(docs, monkeypatch, at_once):
    monkeypatch.setattr(ld, "LINES_AT_ONCE", at_once)
    texts = variants(3)
    got = [r["text"] for r in ld.drop_recurring_lines(docs(*texts), min_docs=5, min_tokens=1).orderBy("doc_id").collect()]
    assert got == plain(texts, 5, 1)
    assert 10 < sum(len(t.split("\n")) == 1 for t in got) < 117


def test_near_copies_of_a_line_make_one_template(docs):
    r = random.Random(8)
    base = [letters(i) for i in range(40)]
    texts = []
    for i in range(60):
        line = list(base)
        for at in r.sample(range(3, 40), 3):
            line[at] = "new" + letters(1000 * i + at)
        texts.append(" ".join(line))
    got = [r["text"] for r in ld.drop_recurring_lines(docs(*texts)).orderBy("doc_id").collect()]
    assert got == [texts[0]] + [""] * 59


def test_variable_fields_make_one_template():
    lines = [f"user bob logged in from host h{'xyz'[i % 3]}{'abcdefgh'[i]} at noon" for i in range(8)]
    constant = {(i, t) for i, t in enumerate(lines[0].split()) if i not in (0, 1, 2, 6)}
    follows = {(i, lines[0].split()[i - 1] if i != 7 else ld.VARIABLE): lines[0].split()[i] for i in (3, 4, 5, 7, 8)}
    assert len({tuple(ld.template(x.split(), constant, follows)) for x in lines}) == 1
    assert ld.template("user bob logged a b c d e f".split(), constant, follows) == "user bob logged a b c d e f".split()


def test_odd_tables(odd_docs, docs):
    out = ld.drop_recurring_lines(odd_docs, min_docs=2)
    assert out.columns == [*(c for c in odd_docs.columns if c != "lines_dropped"), "lines_dropped"] and out.count() == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id < 5").collect()} == {r["doc_id"]: r["text"] for r in odd_docs.where("doc_id < 5").collect()}
    assert [r["text"] for r in out.where("doc_id = 5").collect()] == ["", ""]
    assert ld.drop_recurring_lines(docs("x").where("false")).isEmpty()


def test_short_lines_go_by_the_same_threshold(docs, spark, tmp_path):
    import corpus_pipeline
    from cairn.llm import queries

    own = [a + b for a in "abcdef" for b in "uvwxy"]
    df = docs(*[f"{x} is where this one begins\nMenu\n\nRead more\n{x}" for x in own])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    for out in (queries.op9_line_dedup(spark, str(tmp_path)), corpus_pipeline.line_dedup(spark, df, str(tmp_path))):
        got = {x["doc_id"]: x["text"].split("\n") for x in out.collect()}
        assert got[0] == ["au is where this one begins", "Menu", "", "Read more", "au"]
        assert all(got[i] == [f"{x} is where this one begins", "", x] for i, x in enumerate(own) if i)


def test_lines_and_passages_of_few_documents_go(docs):
    own = [a + b for a in "abcdef" for b in "uvwxy"]
    passage = " ".join(f"{x}tion" for x in own) + " " + " ".join(f"{x}ing" for x in own)
    line, rare = "Released under the terms of that license.", "a line that two writers had both"
    texts = [f"{x} is where this one begins" + "".join(f"\n{y}" for y, n in ((passage, 3), (line, 5), (rare, 2)) if i < n) for i, x in enumerate(own)]
    got = [r["text"] for r in ld.drop_recurring_lines(docs(*texts)).orderBy("doc_id").collect()]
    assert [sum(y in x.split("\n") for x in got) for y in (passage, line, rare)] == [1, 1, 2]
    assert got[0] == texts[0] and [x.split("\n")[0] for x in got] == [x.split("\n")[0] for x in texts]
