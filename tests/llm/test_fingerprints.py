import hashlib
import random

from cairn.llm import fingerprints as fp


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(n))


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def sequential(text):
    """A fingerprint byte by byte, from the definition."""
    data = text.encode()
    window = [0] * 7
    hits = []
    for b in data:
        window = [*window[1:], b]
        h = sum((x + 1) * pow(0x9E3779B1, 6 - i, 2**32) for i, x in enumerate(window)) % 2**32
        h ^= h >> 15
        h = h * 0x85EBCA6B % 2**32
        h ^= h >> 13
        hits.append(h)

    def signature(block):
        chunks, now = [], []
        for i, b in enumerate(data):
            now.append(b)
            if hits[i] % block == 0 and i < len(data) - 1:
                chunks.append(now)
                now = []
        chunks += [now] if now else []
        out = ""
        for c in chunks:
            h = (sum((b + 1) * pow(0x9E3779B97F4A7C15, i, 2**64) for i, b in enumerate(c)) + len(c)) % 2**64
            h ^= h >> 31
            out += LETTERS[h * 0x94D049BB133111EB % 2**64 >> 58]
        return out

    block = 3
    while len(signature(block)) > 64:
        block *= 2
    return f"{block}:{signature(block)}:{signature(2 * block)}"


def test_fingerprints_equal_a_sequential_version():
    texts = ["", "a", "abc", "x" * 500, "é🙂 ß" * 40, *(words(n, n) for n in (1, 3, 10, 60, 200, 500))]
    assert fp.fingerprints(texts) == [sequential(t) for t in texts]


def test_edit_distance_equals_the_table():
    def slow(a, b):
        row = list(range(len(b) + 1))
        for i, c in enumerate(a, 1):
            new = [i]
            for j, d in enumerate(b, 1):
                new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (c != d)))
            row = new
        return row[-1]

    r = random.Random(0)
    for _ in range(500):
        a, b = ("".join(r.choice("abc") for _ in range(r.randint(0, 12))) for _ in "ab")
        assert fp.edit_distance(a, b) == slow(a, b)


def test_equal_edited_and_other_texts():
    texts = [words(300, i) for i in range(20)]
    prints = fp.fingerprints(texts)
    assert fp.fingerprints(texts[::-1])[::-1] == prints and all(fp.likeness(p, p) == 1 for p in prints)
    near = [fp.likeness(p, q) for p, q in zip(prints, fp.fingerprints([t.replace(" ", "  ", 1) for t in texts]))]
    far = [fp.likeness(p, q) for p, q in zip(prints, prints[1:])]
    assert min(near) > 0.85 and max(far) < 0.3
    assert all(max(len(s) for s in p.split(":")[1:]) <= fp.MAX_CHUNKS for p in prints)


def test_pieces_change_nothing(monkeypatch):
    texts = ["", "a", "ab" * 5000, words(2000, 1), "🙂" * 3000, "x" * 9999]
    want = fp.fingerprints(texts)
    monkeypatch.setattr(fp, "PIECE", 500)
    assert fp.fingerprints(texts) == want


def test_whole_table_against_the_plain_way(spark, docs):
    texts = [words(n, n) for n in (5, 50, 400, 3, 0, 77)] + ["short", None, "ü" * 9]
    df = docs(*texts).repartition(3)
    got = {r["doc_id"]: r for r in fp.compare_with_edit_and_next(df).collect()}
    full = [t or "" for t in texts]
    prints = fp.fingerprints(full)
    for i, t in enumerate(full):
        j = (i + 1) % len(full)
        e = t[: len(t) - len(t) // 4] + full[j][: len(t) // 4]
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"]) == (len(t), hashlib.sha256(e.encode()).hexdigest(), prints[i])
        assert r["edited_fingerprint"] == fp.fingerprints([e])[0]
        assert (r["near_edited"], r["near_next"]) == (fp.likeness(prints[i], r["edited_fingerprint"]), fp.likeness(prints[i], prints[j]))


def test_odd_tables(odd_docs, docs):
    assert fp.compare_with_edit_and_next(odd_docs).count() == odd_docs.count()
    assert fp.fingerprint_documents(odd_docs).count() == odd_docs.count()
    assert fp.compare_with_edit_and_next(docs("x").where("false")).count() == 0
    assert fp.compare_with_edit_and_next(docs("alone text")).first()["near_next"] == 1.0
