"""Sorting, paging, sampling and set operations."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.plans.ordered import with_position


def sort(df: DataFrame, *cols: Column | str) -> DataFrame:
    return df.orderBy(*cols)


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """First ``k`` rows of a total order; each task keeps only its own ``k``."""
    return df.orderBy(*order).limit(k)


def argmin(df: DataFrame, by: str, ties: Sequence[str] = ()) -> DataFrame:
    """The single row with the smallest value, folded without a sort."""
    best = F.min_by(F.struct(*df.columns), F.struct(by, *ties))
    return df.filter(F.col(by).isNotNull()).agg(best.alias("b")).select("b.*")


def page(df: DataFrame, order: Sequence[Column], offset: int, n: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + n``; every task keeps only its first ``offset + n``."""
    return df.orderBy(*order).offset(offset).limit(n)


def deep_page(df: DataFrame, order: Sequence[Column], offset: int, n: int, blocks: int | None = None) -> DataFrame:
    """The same far down a long listing: rows are numbered block-wise and cut by number.

    ``order`` holds ascending expressions (negate a number for descending order).
    """
    numbered = with_position(df, [], order, "_at", blocks=blocks)
    return numbered.filter((F.col("_at") > offset) & (F.col("_at") <= offset + n)).drop("_at")


def hash_key(key: Sequence[str], seed: int) -> Column:
    """Pseudo-random text that depends on key and seed only, not on partitioning."""
    return F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], F.lit(str(seed))))


def sample_k(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """``k`` rows picked by hash, the same ones on every run."""
    return df.orderBy(hash_key(key, seed), *key).limit(k)


def sample_keys(df: DataFrame, key: Sequence[str], k: int, seed: int) -> DataFrame:
    """All rows of ``k`` distinct keys picked by hash."""
    return df.join(sample_k(df.select(*key).distinct(), key, k, seed), list(key), "left_semi")


def stack(*dfs: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def union_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows of ``a`` and the rows of ``b`` whose key is not in ``a``."""
    return a.unionByName(b.join(a.select(*key), list(key), "left_anti"))


def intersect_rows(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_semi")


def difference(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.join(b.select(*key), list(key), "left_anti")


def other_columns(df: DataFrame, *cols: str) -> list[str]:
    return [c for c in df.columns if c not in cols]


def with_prediction(model, df: DataFrame, out: str = "prediction") -> DataFrame:
    """Truth and prediction side by side; the model adds its column to the row."""
    scored = model.transform(df)
    return scored if out == "prediction" else scored.withColumnRenamed("prediction", out)
