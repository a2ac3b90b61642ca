"""Operators used from another folder, with frames that the queries' reader did not make."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent.parent

CODE = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.driver.host", "127.0.0.1").config("spark.checkpoint.dir", "file://{folder}/checkpoints").getOrCreate()
before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
docs = spark.range(30).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), "id").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
from cairn.llm import fingerprints, html_text, language_id, line_dedup, near_dedup, packing, topk
{call}
assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
print("fine")
"""

CALLS = """
assert packing.pack(docs).count() == 30
assert topk.top_k(spark.range(9).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float")).alias("embedding")), F.col("id") % 3 == 0, k=2).count() == 6
assert line_dedup.drop_recurring_lines(docs).where("text <> ''").count() == 1
assert near_dedup.near_duplicates(docs).count() == 30
assert html_text.extract(docs.select(F.col("doc_id").alias("page_id"), F.lit(None).cast("string").alias("url"), F.col("text").alias("html"))).count() == 30
assert language_id.identify(docs, language_id.train(docs)).count() == 30
assert fingerprints.compare_with_edit_and_next(docs).count() == 30
"""


def test_operators_send_the_package_to_workers(tmp_path):
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO), folder=tmp_path, call=CALLS)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "fine" in out.stdout, out.stderr[-3000:]
