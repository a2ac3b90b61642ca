import random

import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

from cairn.llm import token_counts as tc  # noqa: E402

PARTS = [*"abc the'srevlmd  \n\t.,!?0129é中🙂  '\r\x85", "'re", "'ve", "<|endoftext|>", "<|end", " the", "  ", "´", "½", " "]


@pytest.fixture(scope="module")
def both():
    return tc.counter(tc.default_vocabulary()), Tokenizer.from_file(tc.default_vocabulary())


def library(t, text):
    return len(t.encode(text, add_special_tokens=False).ids)


def test_every_prefix_counts_as_the_library_counts_it(both):
    counter, lib = both
    r = random.Random(4)
    for _ in range(400):
        text = "".join(r.choice(PARTS) for _ in range(r.randint(0, 20)))
        assert counter.count(text) == library(lib, text)
        assert list(counter.prefix_counts(text)) == [library(lib, text[:i]) for i in range(len(text) + 1)]


def test_long_words(both):
    counter, lib = both
    for text in ("a" * 3000, " " * 3000, "=" * 777 + "é" * 500, "0123456789" * 200):
        assert counter.count(text) == library(lib, text)


def test_many_special_strings_cost_time_in_proportion(both):
    import time

    counter, lib = both
    text = "some words here <|endoftext|>" * 800
    begin = time.perf_counter()
    table = counter.prefix_counts(text)
    assert time.perf_counter() - begin < 10
    for n in (0, 17, 29, 35, 10_000, len(text) - 3, len(text)):
        assert table[n] == library(lib, text[:n])


def test_budget(both, docs):
    counter, lib = both
    texts = ["one two three four five", "a" * 50, "", None, "short"]
    got = {r["doc_id"]: r for r in tc.truncate_to_budget(docs(*texts), 3).collect()}
    for i, t in enumerate(texts):
        fits = [n for n in range(len(t or "") + 1) if library(lib, (t or "")[:n]) <= 3]
        assert (got[i]["n_fit"], got[i]["fit_text"]) == (fits[-1], (t or "")[: fits[-1]])
        assert got[i]["fit_tokens"] == library(lib, got[i]["fit_text"])


def test_odd_tables(both, odd_docs, docs):
    _, lib = both
    got = sorted((r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tc.count_tokens(odd_docs).collect())
    texts = [r["text"] or "" for r in odd_docs.collect()]
    assert got == sorted((len(t.encode()), library(lib, t), library(lib, t) > 1024) for t in texts)
    assert tc.count_tokens(docs("x").where("false")).isEmpty()
