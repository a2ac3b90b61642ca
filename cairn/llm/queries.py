"""The training-data queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm._common import read_table


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


# every pair of documents that share a shingle is counted, which whole small tables allow
OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle
  FROM w
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL
), links AS (
  SELECT x, y FROM pairs JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 75 * (nx.n + ny.n - c)
), sym AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS id, doc_id AS r FROM documents
  UNION SELECT sym.y AS id, reach.r FROM reach JOIN sym ON sym.x = reach.id
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT id, min(r) AS component_id FROM reach GROUP BY id) m ON m.id = d.doc_id
"""


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.topk import top_k

    return top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.fingerprints import compare_with_edit_and_next

    return compare_with_edit_and_next(read_table(spark, sf_dir, "documents"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.mixing import mix

    return mix(read_table(spark, sf_dir, "documents"), repetition=2.0)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.quality import graded, score, train

    documents = read_table(spark, sf_dir, "documents")
    out = score(documents, train(documents, graded(read_table(spark, sf_dir, "labels"))))
    return out.withColumn("kept", F.col("p_top") >= 0.5)


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.html_text import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), limit=1024)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.packing import pack

    return pack(read_table(spark, sf_dir, "documents"))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.near_dedup import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.line_dedup import drop_recurring_lines

    out = drop_recurring_lines(read_table(spark, sf_dir, "documents"), min_tokens=1)
    return out.select("doc_id", F.length("text").cast("long").alias("n_chars"), "lines_dropped", "text")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cairn.llm.language_id import held_out, identify, train

    documents = read_table(spark, sf_dir, "documents")
    out = identify(documents, train(documents))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_topk, op2_fingerprints, op3_mixing, op4_quality, op5_html_text, op6_token_counts, op7_packing, op8_near_dedup, op9_line_dedup, op10_language_id)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk": OP1_SQL, "op8_near_dedup": OP8_SQL}
