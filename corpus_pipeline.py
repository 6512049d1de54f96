"""Training-data pipeline over ``documents``.

``STAGES`` holds (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's documents. All but the last stage return the columns of their input.

1. quality: drops documents that the quality classifier scores under 0.3.
2. near_duplicates: of each component of documents whose five-word shingle sets
   have a Jaccard similarity of 0.8 or more, the row of least id stays.
3. decontaminate: drops documents that overlap a benchmark item.
4. secrets: replaces secrets in texts by a mask (n_chars follows, where it is a
   column); no row goes.
5. encode: ids, token counts and the round trip of each text.

Nulls, empty texts and repeated rows: a null or empty text scores by the
classifier's bias, links with nothing, meets no benchmark item, holds no secret
and has no tokens. Rows equal in id and set are copies. Empty tables pass. Extra
columns, whatever their names, are carried as they are up to the last stage.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm import decontaminate, pieces, quality, secrets
from larkspan.llm.jaccard_join import jaccard_components, may_be_asked
from larkspan.llm.registry import table
from larkspan.llm.scratch import Scratch, free_name

TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
MODEL = "piece_bpe_32k.model"
# Words and characters that an encoding task holds: a third and a quarter of what the operator takes alone,
# since executors come to that stage with heaps that the stages before have filled.
MEMO_BYTES, LIST_CHARS = 1 << 24, 1 << 19
# What happens to the rows of one hash: none stays, all stay, one stays.
GOES, STAYS, ONCE = 0, 1, 2


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "score")
    return quality.with_score(docs, model, out=score).where(F.col(score) >= quality.THRESHOLD).select(*docs.columns)


def row_hash(docs: DataFrame) -> Column:
    """64-bit name of a row's values; nulls count by their place, which the hash alone leaves out."""
    cols = [F.to_json(F.struct(c)) if "map<" in kind else F.col(c) for c, kind in docs.dtypes]
    return F.xxhash64(*cols, *[F.col(c).isNull() for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # Rows are named by a hash of their values, which doesn't depend on how files are split, so that no text is
    # stored again. Rows of equal values are one here; their first place in the table counts.
    ids = Scratch(spark, "rows")
    row = free_name(docs, "row")
    keyed = docs.withColumn(row, row_hash(docs))
    places = keyed.select(F.col(row).alias("at"), F.col("doc_id").alias("id"), F.monotonically_increasing_id().alias("place"))
    places = ids.store(places.groupBy("at").agg(F.first("id").alias("id"), F.min("place").alias("place"), F.count(F.lit(1)).alias("n")), "places")
    found = jaccard_components(keyed, row).select(F.col("doc_id").alias("at"), "component_id", (F.col("n_shingles") > 0).alias("words")).distinct()
    rows = places.join(ids.store(found, "components"), "at")
    first = rows.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "place", "at", "n", "words")).alias("first")).select("first.*")
    # Rows without words link with nothing, not even with their copies.
    keep = ids.store(first.select("at", F.when((F.col("n") > 1) & F.col("words"), ONCE).otherwise(STAYS).alias("how")), "kept")
    gone = ids.store(places.join(keep, "at", "left_anti").select("at", F.lit(GOES).alias("how")), "gone")
    once = keep.where(F.col("how") == ONCE)
    # Only rows of the shorter list (and those that its filter lets through) are shuffled with their texts.
    told, rest = (gone.union(once), STAYS) if gone.count() < keep.count() else (keep, GOES)
    listed = may_be_asked(told.select(F.col("at").alias("_id")), row)
    met = keyed.where(listed).join(told.withColumnsRenamed({"at": row, "how": (how := free_name(keyed, "how"))}), row, "left")
    out = met.where(F.coalesce(how, F.lit(rest)) == STAYS).select(*docs.columns)
    if rest == STAYS:
        out = out.union(keyed.where(~listed).select(*docs.columns))
    if once.limit(1).count():
        out = out.union(met.where(F.col(how) == ONCE).dropDuplicates([row]).select(*docs.columns))
    return out


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact(docs, secrets.fit(docs))
    if "n_chars" not in docs.columns:
        return out
    kind = docs.schema["n_chars"].dataType
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kind)).select(*docs.columns)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(docs, pieces.read_model(f"{TOKENIZERS}/{MODEL}"), MEMO_BYTES, LIST_CHARS)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontaminate", decontamination_stage),
    ("secrets", secret_stage),
    ("encode", encoding_stage),
]

# The classifier, the component search and the tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = scratch.store(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
