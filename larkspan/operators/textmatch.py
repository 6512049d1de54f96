"""Near-equal names and weighted text search."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _osa(a: str, b: str) -> int:
    """Optimal string alignment: edits and swaps of neighbours, no substring edited twice."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            cost = min(before[j] + 1, row[j - 1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            row.append(cost)
    return row[-1]


@F.pandas_udf(T.IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else _osa(x, y) for x, y in zip(a, b)], dtype="Int32")


def deletions(c: Column, k: int) -> Column:
    """The text and every text left after deleting up to ``k`` characters.

    Two texts within ``k`` edits or neighbour swaps always share one of these.
    """
    shorter = lambda s: F.transform(
        F.sequence(F.lit(1), F.greatest(F.char_length(s), F.lit(1))),
        lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1)),
    )
    level = F.array(c)
    out = level
    for _ in range(k):
        level = F.array_distinct(F.flatten(F.transform(level, shorter)))
        out = F.array_union(out, level)
    return out


def near_names(a: DataFrame, b: DataFrame, left: str, right: str, k: int) -> DataFrame:
    """Distinct pairs of texts with an alignment distance of at most ``k``: (left, right, dist).

    Distinct texts meet on a hash of a shared deletion variant, so copies and
    common words make no extra pairs; an exact distance check follows.
    """
    variants = lambda df, c: df.select(c).distinct().filter(F.col(c).isNotNull()).select(
        c, F.explode(F.transform(deletions(F.col(c), k), lambda v: F.xxhash64(v))).alias("_v")
    )
    pairs = variants(a, left).join(variants(b, right), "_v").select(left, right).distinct()
    close = pairs.filter(F.levenshtein(F.col(left), F.col(right), 2 * k) >= 0)
    return close.withColumn("dist", osa_distance(left, right)).filter(F.col("dist") <= k)


def fuzzy_join(a: DataFrame, b: DataFrame, col: str, k: int = 2) -> DataFrame:
    """Inner join on texts at most ``k`` apart; all matches stay, keys become ``<col>_x`` and ``<col>_y``."""
    x, y = f"{col}_x", f"{col}_y"
    left, right = a.withColumnRenamed(col, x), b.withColumnRenamed(col, y)
    return left.join(near_names(left, right, x, y, k), x).join(right, y)


def tokens(c: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


# How much a match in each field counts.
FIELD_WEIGHTS = {"title": 0.99, "summary": 0.6, "authors": 0.5, "content": 0.2, "tags": 0.5, "categories": 0.5}


def token_table(df: DataFrame, key: str, weights: Mapping[str, float]) -> DataFrame:
    """(key, token, field, weight): one row per document, field and distinct word."""
    arrays = {f.name for f in df.schema.fields if f.dataType.typeName() == "array"}
    text = lambda c: F.concat_ws(" ", F.col(c)) if c in arrays else F.coalesce(F.col(c), F.lit(""))

    def words(field: str, weight: float) -> Column:
        return F.transform(
            tokens(text(field)), lambda t: F.struct(t.alias("token"), F.lit(field).alias("field"), F.lit(float(weight)).alias("weight"))
        )

    parts = [words(c, w) for c, w in weights.items() if c in df.columns]
    return df.select(key, F.inline(F.concat(*parts)))


def search(
    df: DataFrame, key: str, queries: DataFrame, query: str, weights: Mapping[str, float] = FIELD_WEIGHTS,
    k: int = 10, threshold: float = 0.0, fuzzy: int = 0, min_length: int = 1,
) -> DataFrame:
    """Best ``k`` documents per query: mean over its words of the weighted field matches.

    A batch of queries is matched at once through a join on words. With
    ``fuzzy`` a word also matches words of the collection within that distance,
    worth 1 - distance / length.
    """
    asked = queries.select(query).distinct().withColumn("_t", tokens(F.col(query)))
    asked = asked.select(query, F.size("_t").alias("_n"), F.explode("_t").alias("_word")).filter(F.char_length("_word") >= min_length)
    table = token_table(df, key, weights)
    if fuzzy:
        near = near_names(asked, table, "_word", "token", fuzzy)
        worth = F.greatest(1 - F.col("dist") / F.char_length("_word"), F.lit(0.0))
        words = asked.join(near, "_word").select(query, "_n", "_word", "token", worth.alias("_worth"))
    else:
        words = asked.select(query, "_n", "_word", F.col("_word").alias("token"), F.lit(1.0).alias("_worth"))
    hits = table.join(words, "token")
    if fuzzy:
        # A word counts once per field: its best match.
        hits = hits.groupBy(query, key, "_n", "_word", "field", "weight").agg(F.max("_worth").alias("_worth"))
    scored = hits.groupBy(query, key, "_n").agg(F.sum(F.col("weight") * F.col("_worth")).alias("_s"))
    scored = scored.select(query, key, F.round(F.col("_s") / F.col("_n"), 6).alias("score")).filter(F.col("score") > threshold)
    w = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
