import random
import re
import zlib

import numpy as np
import pytest

from cairn.llm import quality


def corpus(docs, spark, n=600):
    r = random.Random(2)
    words = ["".join(r.choice("aeiourstln") for _ in range(r.randint(2, 7))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.randint(20, 200))]
        if i % 6 == 0:
            w.insert(r.randrange(len(w)), r.choice(["vileword", "meanword"]))
        elif i % 6 == 1:
            w = [x + "%%%" for x in w]
        texts.append(" ".join(w))
        labels.append((i, 0 if i % 6 == 1 else 1, 1 if i % 6 == 0 else 0))
    return docs(*texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(docs, spark):
    df, labels = corpus(docs, spark)
    known = quality.graded(labels.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r for r in quality.score(df, quality.train(df, known)).collect()}
    held = [i for i in range(0, 600, 5)]
    right = sum((got[i]["p_top"] >= 0.5) == (i % 6 > 1) for i in held)
    assert right >= 0.9 * len(held)
    assert all(0 <= r["expected_grade"] <= 2 for r in got.values())


def test_the_gradient_equals_differences():
    rng = np.random.default_rng(6)
    grades = rng.integers(0, 4, 40)
    each = rng.random(40)
    score, free = rng.normal(size=40), np.array([-0.7, 0.1, -0.4])
    _, by_score, by_free = quality.loss_and_gradient(score, free, grades, each)
    step = 1e-6

    def slope(at_score, at_free):
        up, down = (quality.loss_and_gradient(score + k * at_score, free + k * at_free, grades, each)[0] for k in (step, -step))
        return (up - down) / (2 * step)

    assert np.allclose(by_score, [slope(np.eye(40)[i], np.zeros(3)) for i in range(40)], atol=1e-6)
    assert np.allclose(by_free, [slope(np.zeros(40), np.eye(3)[i]) for i in range(3)], atol=1e-6)
    # the loss itself, grade by grade
    cut = np.cumsum([free[0], *np.exp(free[1:])])
    tail = lambda s, g: 1.0 if g < 0 else 0.0 if g > 2 else 1 / (1 + np.exp(cut[g] - s))
    assert np.isclose(quality.loss_and_gradient(score, free, grades, each)[0], -sum(w * np.log(tail(s, g - 1) - tail(s, g)) for s, g, w in zip(score, grades, each)))


def plain_features(text):
    """The features of a text by their definition, as {name: value}."""
    words = (text or "").split()
    out, n = {}, max(len(words), 1)
    for w in words:
        core = "".join(c for c in w if c.isalpha()).lower()
        if core:
            out["word", core] = 1.0
    shape = lambda w: re.sub(r"[0-9]+", "0", re.sub(r"[^\W\d_]+", "a", w))[:12]
    for w in words:
        out["shape", shape(w)] = out.get(("shape", shape(w)), 0) + 6.0 / n
    most = max((words.count(w) for w in words), default=0)
    return out | {("variety", str(16 * len(set(words)) // n)): 1.0, ("top", str(16 * most // n)): 1.0, ("length", str(len(words).bit_length())): 1.0}


def test_scores_equal_brute_force(docs):
    texts = ["one two two, three! 44 x-y", "", None, "a b c " * 50, "É ß 12ab34 --- $$$ x%%%", "word\n\tword"]
    rng = np.random.default_rng(3)
    model = quality.OrdinalModel(rng.normal(size=quality.SPACE + 1), np.array([-0.5, 0.8]))
    got = {r["doc_id"]: r for r in quality.score(docs(*texts), model).collect()}
    for i, t in enumerate(texts):
        value = sum(model.weights[zlib.crc32(f"{kind}:{name}".encode()) % quality.SPACE] * x for (kind, name), x in plain_features(t).items())
        tails = [1 / (1 + np.exp(c - value)) for c in model.thresholds]
        assert np.isclose(got[i]["expected_grade"], sum(tails), atol=1e-5) and np.isclose(got[i]["p_top"], tails[-1], atol=1e-5)
    kept = {r["doc_id"] for r in quality.selected(docs(*texts), model, 0.5).collect()}
    assert kept == {i for i in got if got[i]["p_top"] >= 0.5}


def test_thresholds_are_ordered():
    rows = [(np.array([1, 2 + i % 3], np.int32), np.array([1.0, 1.0], np.float32)) for i in range(90)]
    model = quality.fit(rows, np.array([i % 3 for i in range(90)]))
    assert model.thresholds[0] < model.thresholds[1]
    assert model.weights[2] < model.weights[3] < model.weights[4]


def test_grades(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, 1, 1), (3, 1, 0), (None, 1, 0), (4, None, 0), (5, None, 1)], "doc_id long, quality int, toxic int")
    assert {r["key"]: r["grade"] for r in quality.graded(labels).collect()} == {1: 2, 2: 1, 3: 0, 5: 0}


@pytest.mark.parametrize("keep", [False, True])
def test_odd_tables(odd_docs, docs, spark, keep):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for labels in (none, spark.createDataFrame([(0, 1, 0), (2, 0, 0), (4, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")):
        model = quality.train(odd_docs, quality.graded(labels))
        out = quality.score(odd_docs, model, keep_columns=keep)
        assert out.count() == odd_docs.count() and out.where("p_top is null or expected_grade is null").isEmpty()
        if keep:
            assert out.columns == [*(c for c in odd_docs.columns if c not in ("expected_grade", "p_top")), "expected_grade", "p_top"]
            assert quality.selected(odd_docs, model, 0.0).columns == odd_docs.columns and quality.selected(odd_docs, model, 0.0).count() == odd_docs.count()
    assert quality.score(odd_docs, quality.train(odd_docs, quality.graded(none))).where("p_top < 0.5").isEmpty()
    empty = docs("x").where("false")
    assert quality.score(empty, quality.train(empty, quality.graded(labels)), keep_columns=keep).isEmpty()
