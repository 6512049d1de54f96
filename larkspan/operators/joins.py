"""Equi-joins. Strategy, broadcasting and skew splitting are left to the planner."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.plans.ordered import with_lead


def join_on(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.join(b, list(keys), "inner")


def common_keys(a: DataFrame, b: DataFrame) -> list[str]:
    return [c for c in a.columns if c in set(b.columns)]


def natural_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Inner join on every shared column name."""
    keys = common_keys(a, b)
    if not keys:
        raise ValueError("no shared column names")
    return join_on(a, b, keys)


def join_as(a: DataFrame, b: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Inner join on differently named keys; the left names stay."""
    return join_on(a, b.withColumnsRenamed({r: l for l, r in keys.items()}), list(keys))


def left_onto(calendar: DataFrame, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the calendar with values where they exist; values off the calendar are dropped."""
    return calendar.join(df, list(keys), "left")


def keep_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(keys_df.select(*keys), list(keys), "left_semi")


def dropped_keys(df: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The groups ``keep_keys`` removes, for an audit."""
    return df.select(*keys).distinct().join(keys_df.select(*keys), list(keys), "left_anti")


def members_of(df: DataFrame, other: DataFrame, col: str, other_col: str | None = None) -> DataFrame:
    return df.join(other.select(F.col(other_col or col).alias(col)), col, "left_semi")


def lookup(df: DataFrame, dim: DataFrame, key: str, value: str, dim_key: str | None = None) -> DataFrame:
    """Attach one column of a dimension; unmatched keys give NULL."""
    return df.join(dim.select(F.col(dim_key or key).alias(key), value), key, "left")


def with_total(df: DataFrame, col: str, out: str = "total") -> DataFrame:
    """The overall total on every row, as a scalar subquery."""
    return df.withColumn(out, df.agg(F.sum(col)).scalar())


def expand_grid(a: DataFrame, b: DataFrame, buckets: int | None = None) -> DataFrame:
    """Every combination of two key tables, as an equi-join on a bucket number.

    Rows of ``b`` go to one bucket each and rows of ``a`` (the shorter table) to
    all of them, so the pairs spread over the tasks whatever the sizes are.
    """
    if buckets is None:
        buckets = min(int(a.sparkSession.conf.get("spark.sql.shuffle.partitions")), 512)
    cols = [*a.columns, *b.columns]
    left = a.withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    right = b.withColumn("_bucket", F.pmod(F.xxhash64(*b.columns), F.lit(buckets)).cast("int"))
    return left.join(right, "_bucket").select(*cols)


def best_match(df: DataFrame, left_key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per left key: the smallest in ``order``. Folds map-side, no sort."""
    rest = [c for c in df.columns if c not in left_key]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*left_key).agg(best.alias("_b")).select(*left_key, "_b.*").select(*df.columns)


def join_loss(a: DataFrame, joined: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows and left keys before and after a join, and both losses in percent.

    ``pct_rows`` compares row counts, as a duplicate-making join distorts it;
    ``pct_keys`` counts left rows whose key found no partner.
    """
    lost = a.join(joined.select(*key).distinct(), list(key), "left_anti")
    n = a.agg(F.count(F.lit(1))).scalar()
    m = joined.agg(F.count(F.lit(1))).scalar()
    return lost.agg(F.count(F.lit(1)).alias("unmatched")).select(
        n.alias("n_left"),
        m.alias("n_joined"),
        "unmatched",
        F.round((n - m) / n * 100, 2).alias("pct_rows"),
        F.round(F.col("unmatched") / n * 100, 2).alias("pct_keys"),
    )


def with_next(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], cols: Mapping[str, str], keep_last: bool = False,
    blocks: int | None = None, derived: bool = False,
) -> DataFrame:
    """Each row with columns of its successor; the last row of a group is dropped. ``derived`` as in ``with_position``."""
    out = with_lead(df.withColumn("_here", F.lit(1)), group, order, {**cols, "_next": "_here"}, blocks, derived)
    if not keep_last:
        out = out.filter(F.col("_next").isNotNull())
    return out.drop("_here", "_next")
