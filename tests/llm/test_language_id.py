import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from cairn.llm import language_id as li

WORDS = {"en": "the of and thing where would ship through".split(), "de": "der die und nicht schiff über straße auch".split(), "fr": "le la les où être bateau très voilà".split()}


def texts(n, seed=0):
    r = random.Random(seed)
    out = []
    for i in range(n):
        lang = r.choice(list(WORDS))
        out.append((" ".join(r.choice(WORDS[lang]) for _ in range(r.randint(4, 60))), lang, "s"))
    return out


def test_held_out_accuracy(docs):
    rows = texts(300)
    df = docs(*rows)
    got = {r["doc_id"]: r for r in li.identify(df, li.train(df)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {r["doc_id"] for r in df.where(li.held_out("doc_id")).collect()} == set(held)
    assert sum(got[i]["lang_pred"] == rows[i][1] for i in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def model(rows):
    counts = {}
    for lang in sorted({x[1] for x in rows}):
        counts[lang] = li.gram_counts([x[0].encode() for x in rows if x[1] == lang])
    return li.build_model(counts)


def test_probabilities_sum_to_one_in_every_context():
    m = model(texts(60))
    cost = m.cost.reshape(-1, m.alphabet, len(m.languages))
    assert np.allclose(np.exp2(-cost.astype(np.float64)).sum(axis=1), 1, atol=1e-4)


def escape_probability(counts, alphabet, context, symbol):
    """P(symbol after context) by the plain recursion: a seen symbol n / (total + distinct); else escape to the shorter context without the symbols seen here."""

    def of(context, excluded):
        if context is None:
            return {s: 1.0 / len(alphabet) for s in alphabet}
        shorter = of(context[1:] if context else None, None)
        seen = counts.get(context)
        if not seen:
            return shorter
        total, distinct = sum(seen.values()), len(seen)
        unseen = [s for s in alphabet if s not in seen]
        room = sum(shorter[s] for s in unseen)
        if not room:
            return {s: n / total for s, n in seen.items()}
        return {s: seen[s] / (total + distinct) if s in seen else distinct / (total + distinct) * shorter[s] / room for s in alphabet}

    return of(context, None)[symbol]


def test_code_lengths_equal_a_plain_recursion():
    rows = texts(40)
    m = model(rows)
    fold = lambda t: [b - 65 + 1 if 65 <= b <= 90 else b - 97 + 1 if 97 <= b <= 122 else b - 101 if b >= 128 else 0 for b in t.encode()]
    used = {0} | {s for t, _, _ in rows for s in fold(t)}
    known = lambda t: [s if s in used else 0 for s in fold(t)]
    everywhere = Counter()
    per = {}
    for lang in m.languages:
        counts = defaultdict(Counter)
        for t, k, _ in rows:
            if k == lang:
                s = [0, 0, 0, *fold(t)]
                for i in range(3, len(s)):
                    for order in range(4):
                        counts[tuple(s[i - order : i])][s[i]] += 1
        per[lang] = counts
        for context, seen in counts.items():
            everywhere[context] += sum(seen.values())
    # contexts that were met once, in all languages together, are not kept
    per = {k: {c: dict(n) for c, n in counts.items() if not c or everywhere[c] > 1} for k, counts in per.items()}
    some = ["the ship über", "les être", "q", "nicht THE voilà", rows[3][0]]
    bits, _ = m.code_lengths(some)
    for t, got in zip(some, bits):
        s = [0, 0, 0, *known(t)]
        for lang, g in zip(m.languages, got):
            want = 0.0
            for i in range(3, len(s)):
                context = tuple(s[i - 3 : i])
                while context and context not in per[lang]:
                    context = context[1:]
                want -= math.log2(escape_probability(per[lang], sorted(used), context, s[i]))
            assert math.isclose(g, want, rel_tol=1e-4, abs_tol=1e-3)


def test_languages_share_the_contexts(monkeypatch):
    rows = texts(60) + [("щедрик щедрик щедрівочка " * 3, "uk", "s")]
    counts = {lang: li.gram_counts([x[0].encode() for x in rows if x[1] == lang]) for lang in {x[1] for x in rows}}
    small = li.build_model(counts, max_contexts=200)
    assert small.cost.shape[0] <= 200 * small.alphabet
    assert small.predict(["щедрик", "the thing where", "nicht über"])[0] == ["uk", "en", "de"]
    monkeypatch.setattr(li, "MAX_TABLE_BYTES", 100_000)
    assert li.build_model(counts).cost.nbytes <= 100_000


def test_code_length_is_the_sum_over_symbols_and_pieces_change_nothing(monkeypatch):
    m = model(texts(60))
    some = ["the ship über", "", "q", "les être " * 50]
    bits, _ = m.code_lengths(some)
    for t, b in zip(some, bits):
        s = m.dense[li._symbols([t.encode()])[0]]
        a = m.alphabet
        want = sum(m.cost[m.context[(s[i - 3] * a + s[i - 2]) * a + s[i - 1]] * a + s[i]] for i in range(3, len(s))) if len(s) > 3 else 0
        assert np.allclose(b, want, rtol=1e-4)
    monkeypatch.setattr(li, "PIECE", 7)
    assert np.allclose(m.code_lengths(some)[0], bits, rtol=1e-4)


def test_unknown_languages_and_odd_tables(odd_docs, docs):
    got = [(r["doc_id"], r["lang_pred"], r["score"]) for r in li.identify(odd_docs, li.train(odd_docs)).collect()]
    assert len(got) == odd_docs.count()
    assert {p for k, p, s in got if k in (1, 2, 3)} == {"und"} and {s for k, p, s in got if k in (1, 2, 3)} == {0.0}
    nothing = docs(("x", None, "s"), ("words here", None, "s"))
    assert {(r["lang_pred"], r["score"]) for r in li.identify(nothing, li.train(nothing)).collect()} == {("und", 0.0)}
    empty = docs("x").where("false")
    assert li.identify(empty, li.train(empty)).isEmpty()
    assert not any(math.isnan(s) for _, _, s in got)
