import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import corpus_pipeline
from cairn.llm import mixing, quality
from cairn.llm import queries as registry
from conftest_names import CLASHING
from test_line_dedup import plain as plain_lines
from test_mixing import plain as plain_mixture
from test_near_dedup import plain as plain_components
from test_packing import plain as plain_bins
from test_quality import plain_features

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def test_stages_over_a_small_corpus(spark, docs, tmp_path):
    r = random.Random(3)
    vocabulary = ["".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8))) for _ in range(200)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    clean = [prose(120) + "\n" + prose(60) for _ in range(90)]
    texts = [(t, "en", "big" if i % 3 else "small") for i, t in enumerate(clean)]
    texts += [(clean[i], "en", "big") for i in range(10)]  # 90..99: exact copies
    texts += [(clean[i] + " one more word", "en", "small") for i in range(10, 20)]  # 100..109: near copies
    texts += [(prose(100) + "\nthe very same closing line of all", "en", "big") for _ in range(30)]  # 110..139
    texts += [(" ".join(w + "%%%" for w in prose(150).split()), "en", "big") for _ in range(30)]  # 140..169: junk
    df = docs(*texts)
    labels = [(i, 0 if i >= 140 else 1, 0) for i in range(len(texts))]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    at = {}
    now = df
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        now = at[name] = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.columns == df.columns
    ids = {n: [x["doc_id"] for x in f.select("doc_id").collect()] for n, f in at.items()}
    assert set(ids["quality"]) == set(range(140))
    assert set(ids["line_dedup"]) == set(range(140))
    closing = [x["doc_id"] for x in at["line_dedup"].where("text like '%closing line%'").collect()]
    assert closing == [110]
    assert sorted(ids["near_dedup"]) == [*range(90), *range(110, 140)]
    assert set(ids["mixing"]) == set(ids["near_dedup"]) and max(Counter(ids["mixing"]).values()) <= 2
    assert set(ids["packing"]) == set(ids["near_dedup"])
    assert at["packing"].agg({"length": "sum"}).first()[0] == sum(len(x["text"].encode()) for x in at["mixing"].collect())


def small_corpus(seed=9):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("aeioustrnlm") for _ in range(r.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(120):
        text = prose(r.randint(30, 90)) + "\n" + r.choice(["Read more of this now", "All rights are reserved by us", prose(12)]) + "\n" + prose(20)
        if i % 6 == 0 and i:
            text = rows[i - 1][1]
        elif i % 6 == 1:
            text = (rows[i - 1][1] if i > 1 else text) + " one more"
        elif i % 10 == 3:
            text = " ".join(w + "%%%" for w in text.split())
        rows.append((i, text, "en", r.choice(["big", "big", "mid", None]), len(text)))
    rows += [(200, None, None, None, None), (201, "", "en", "big", 0), (202, "  ", None, "mid", 2), (5, rows[5][1], "en", rows[5][3], rows[5][4]), (None, "text without a key", "en", "big", 18)]
    return rows


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows = small_corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, 0 if i % 10 == 3 else 1, int(i % 17 == 0)) for i in range(0, 120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = spark.createDataFrame(rows, schema).select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASHING)])
    outputs = {}
    now = df
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        outputs[name] = now, spark.read.parquet(f"{tmp_path}/{name}")
        now = outputs[name][1]
        assert name == "packing" or now.columns == df.columns
    whole = lambda f: Counter(map(repr, f.collect()))
    read = lambda f: [tuple(x) for x in f.select(*schema.replace(" long", "").replace(" string", "").split(", ")).collect()]

    # 1: the rows whose probability, by the features' definition, is one half or more
    before, after = outputs["quality"]
    model = quality.train(before, quality.graded(spark.read.parquet(f"{tmp_path}/labels.parquet")))

    def top(text):
        value = sum(model.weights[zlib.crc32(f"{kind}:{name}".encode()) % quality.SPACE] * x for (kind, name), x in plain_features(text).items())
        return 1 / (1 + math.exp(model.thresholds[-1] - value))

    chances = {repr(x): top(x["text"]) for x in before.collect()}
    assert all(abs(c - 0.5) > 1e-4 for c in chances.values())
    assert whole(after) == Counter({k: n for k, n in whole(before).items() if chances[k] >= 0.5})

    # 2: the independent parser of lines, and no document of which nothing is left
    before, after = outputs["line_dedup"]
    ordered = sorted(read(before), key=lambda x: (x[0] is None, x[0] or 0, x[1] is not None, x[1] or ""))
    single = [x for i, x in enumerate(ordered) if i == 0 or x != ordered[i - 1] or x[1] is None]
    left = plain_lines([x[1] for x in single], 5, 1)
    expect = {x: (x[0], t, x[2], x[3], None if t is None else len(t)) for x, t in zip(single, left) if t == x[1] or (t and t.strip())}
    assert Counter(read(after)) == Counter(expect[x] for x in ordered if x in expect)

    # 3: every pair compared; one row of each component, all without a key
    before, after = outputs["near_dedup"]
    rows_in = read(before)
    by_id = {}
    for x in rows_in:
        if x[0] is not None:
            by_id[x[0]] = x
    ids = sorted(by_id)
    smallest = plain_components([by_id[i][1] for i in ids])
    assert Counter(read(after)) == Counter([by_id[i] for n, i in enumerate(ids) if smallest[n][3]] + [x for x in rows_in if x[0] is None])

    # 4: the independent mixture
    before, after = outputs["mixing"]
    items = [(x[0], x[1], x[3]) for x in read(before)]
    exponent = mixing.plan_mixture(before.select("source", mixing.token_count(before.text).alias("tokens")), corpus_pipeline.REPETITION).exponent
    chosen = plain_mixture(items, exponent, None, mixing.BLOCK_DOCS)
    assert Counter(x[0] for x in read(after)) == sum((Counter({k[0]: n}) for k, n in chosen.items()), Counter())
    assert set(whole(after)) == set(whole(before))

    # 5: bins by looking at every one, under the places of items within the one shard
    before, after = outputs["packing"]
    size = lambda t: len((t or "").encode())
    items = sorted((x for x in read(before) if size(x[1])), key=lambda x: (-size(x[1]), x[0] is not None, x[0] or 0, x[1]))
    assert len(items) <= 4096 and all(size(x[1]) < 16_384 for x in items)
    want = plain_bins([(size(x[1]), x[3], x[1]) for x in items], 16_384, 4)
    got = [tuple(x) for x in after.where("length > 0").select("doc_id", "length", F.expr("bin_id & ((1L << 40) - 1)"), "bin_offset").collect()]
    assert Counter(got) == Counter((x[0], size(x[1]), b, offset) for x, (b, offset) in zip(items, want))
    assert after.where("length = 0 and bin_id is not null").isEmpty()


def test_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs("x").where("false")
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, str(tmp_path))
        assert now.isEmpty(), name


@needs_data
def test_run_equals_its_stages(spark, tmp_path):
    got = corpus_pipeline.run(spark, DATA)
    now = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, DATA).write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, now.collect()))


@needs_data
@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_registered_queries_run_whole(spark, name):
    got = registry.queries()[name](spark, DATA)
    if name in registry.oracle_sql():
        c = duckdb.connect()
        for t in ("documents", "embeddings", "labels", "pages"):
            c.execute(f"CREATE VIEW {t} AS FROM '{DATA}/{t}.parquet'")
        want = c.sql(registry.oracle_sql()[name])
        columns = sorted(got.columns)
        assert sorted(want.columns) == columns
        at = [want.columns.index(x) for x in columns]
        assert sorted(tuple(str(x[k]) for k in columns) for x in got.collect()) == sorted(tuple(str(x[i]) for i in at) for x in want.fetchall())
    else:
        assert got.count() > 0


@needs_data
def test_registry_names():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
