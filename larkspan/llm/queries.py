"""One registered query per operator, over whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import bit_sliced, decontaminate, fill_middle, hard_negatives, html_text, pieces, pitman_yor, quality, secrets, unigram, url_filter, warc
from larkspan.llm.jaccard_join import jaccard_components
from larkspan.llm.registry import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

MODEL = f"{os.environ.get('TOKENIZER_DIR', '/opt/tokenizers')}/piece_bpe_32k.model"


@query("op1_token_counts")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(table(spark, folder, "documents"), pieces.read_model(MODEL))


@query("op2_quality_classifier")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op3_warc")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


TOP_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.r <> c.r AND len(q.e) = len(c.e)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op4_exact_topk", TOP_SQL)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return bit_sliced.top_inner_products(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op5_sentencepiece")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode_documents(table(spark, folder, "documents"), pieces.read_model(MODEL))


@query("op6_secret_scans")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.fit(docs))


@query("op7_benchmark_decontamination")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op8_html_extraction")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


@query("op9_url_filters")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    return url_filter.judged(pages, url_filter.weak_labels(pages))


@query("op10_ngram_jaccard_join")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_components(table(spark, folder, "documents"))


NEGATIVES_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.r, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, coalesce(list_sum(list_transform(list_zip(a.e, c.e), lambda p: p[1] * p[2])), 0)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.r <> c.r AND len(a.e) = len(c.e)
), positive AS (
  SELECT r, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS slot FROM scored WHERE same
), ranked AS (
  SELECT p.anchor_id, positive_id, row_number() OVER (PARTITION BY p.r, slot ORDER BY score DESC, vec_id)::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM positive p JOIN scored s ON p.r = s.r AND slot <= 5 AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
)
SELECT * FROM ranked WHERE rank <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", label)
    return hard_negatives.hard_negatives(vectors, F.col("vec_id") % 100 == 0)


FILL_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(l) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(l) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(l) + 1) AS c2,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
       WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(l[1:least(c1, c2)], '') AS a, array_to_string(l[least(c1, c2) + 1:greatest(c1, c2)], '') AS b, array_to_string(l[greatest(c1, c2) + 1:], '') AS z FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""


@query("op13_fill_in_middle", FILL_SQL)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    rows = fill_middle.restored(fill_middle.fill_in_middle(table(spark, folder, "documents")))
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256")]
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


@query("op12_lm_scoring")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    return pitman_yor.scores(table(spark, folder, "documents"), train=remainder != 2, held_out=remainder == 2)
