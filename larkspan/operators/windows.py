"""Ranking, running and neighbour columns.

Rank filters use window functions, whose group limit keeps only the best rows of
every partition before the shuffle. Everything that needs all positions of a
group goes through ``plans.ordered``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.plans.ordered import attach, with_lead, with_position


def top_n(df: DataFrame, keys: Sequence[str], n: int, by: str, ties: bool = True) -> DataFrame:
    """The ``n`` largest per group; rows tied with the last one stay too."""
    w = Window.partitionBy(*keys).orderBy(F.desc(by))
    at = F.rank() if ties else F.row_number()
    return df.withColumn("_at", at.over(w)).filter(F.col("_at") <= n).drop("_at")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group; above the group limit's threshold (1000) filter ``row_index`` instead."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= n).drop("_at")


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "row_index", blocks=None, derived=False) -> DataFrame:
    return with_position(df, keys, order, out, blocks=blocks, derived=derived)


def cum_share(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: str, index: str = "row_index", blocks=None, derived=False) -> DataFrame:
    """Index, running sum and running share of the group total."""
    out = with_position(df, keys, order, index, running={"cum_sum": F.col(n)}, totals={"total": F.col(n)}, blocks=blocks, derived=derived)
    return out.withColumn("cum_share", F.try_divide(F.col("cum_sum").cast("double"), F.col("total")))


def topk_share(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: str, k: int) -> DataFrame:
    """Share of the group total held by its first ``k`` rows; groups with fewer rows vanish.

    Only ``k`` rows per group are ever ranked; the totals fold map-side.
    """
    totals = df.groupBy(*keys).agg(F.sum(n).alias("_total"))
    head = first_n(df, keys, order, k).groupBy(*keys).agg(F.sum(n).alias("_head"), F.count(F.lit(1)).alias("_rows"))
    share = F.try_divide(F.col("_head").cast("double"), F.col("_total"))
    return head.filter(F.col("_rows") == k).join(totals, list(keys)).select(*keys, share.alias("cum_share"))


def with_ntile(df: DataFrame, order: Sequence[Column], n: int, keys: Sequence[str] = (), out: str = "tile", blocks=None, derived=False) -> DataFrame:
    """Tile 1..n of nearly equal size; the first tiles take the extra rows."""
    numbered = with_position(df, keys, order, "_pos", total="_rows", blocks=blocks, derived=derived)
    small = F.floor(F.col("_rows") / F.lit(n))
    extra = F.col("_rows") % n
    at = F.col("_pos") - 1
    in_big = F.floor(at / (small + 1))
    in_small = F.floor((at - extra) / F.greatest(small, F.lit(1)))
    tile = F.when(at < extra * (small + 1), in_big).otherwise(in_small)
    return numbered.withColumn(out, (tile + 1).cast("int")).drop("_pos", "_rows")


def running_counts(
    calendar: DataFrame, events: DataFrame, key: Sequence[str], t: str, flags: Mapping[str, str], blocks=None
) -> DataFrame:
    """Running sums per key on a calendar grid; steps without events carry the count forward."""
    sums = events.groupBy(*key, t).agg(*[F.sum(c).alias(out) for out, c in flags.items()])
    grid = calendar.join(sums, [*key, t], "left")
    return with_position(
        grid, key, [F.col(t)], None, running={out: F.coalesce(F.col(out), F.lit(0)) for out in flags}, blocks=blocks, derived=True
    )


def missing_streak(df: DataFrame, keys: Sequence[str], t: str, y: str, out: str = "streak", blocks: int | None = 1) -> DataFrame:
    """Length of the run of NULLs ending at each row (0 where observed).

    The default suits series (one row per key and date, so a group is no longer
    than its calendar). ``blocks`` above 1, or None to decide by size, splits
    groups of any length.
    """
    counted = with_position(df, keys, [F.col(t)], None, running={"_missing": F.col(y).isNull().cast("int")}, blocks=blocks)
    # The running count only grows, so its value at the last observed row is its largest there.
    seen = {"_base": ("max", F.when(F.col(y).isNotNull(), F.col("_missing")))}
    based = with_position(counted, keys, [F.col(t)], None, running=seen, blocks=blocks)
    return based.withColumn(out, F.col("_missing") - F.coalesce("_base", F.lit(0))).drop("_missing", "_base")


def lead_cols(df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Mapping[str, str], blocks=None) -> DataFrame:
    """Columns of the next row in group order; NULL on the last row."""
    return with_lead(df, keys, order, cols, blocks)


def group_mean(df: DataFrame, keys: Sequence[str], col: str, out: str = "group_mean") -> DataFrame:
    return attach(df, df.groupBy(*keys).agg(F.avg(col).alias(out)), keys)


def interpolate(
    df: DataFrame, keys: Sequence[str], t: str, y: str, out: str, both: bool = False, blocks: int | None = 1
) -> DataFrame:
    """Linear by row position between observed neighbours, inside each group.

    Trailing gaps take the last value; leading gaps stay NULL unless ``both``,
    which carries the first value back. ``blocks`` as in ``missing_streak``.
    """
    numbered = with_position(df, keys, [F.col(t)], "_i", blocks=blocks)
    seen = F.when(F.col(y).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(y).cast("double").alias("v")))
    # Positions order the observations: the latest so far is the largest, the next one the smallest to come.
    back = with_position(numbered, keys, [F.col("_i")], None, running={"_a": ("max", seen)}, blocks=blocks)
    sides = with_position(back, keys, [-F.col("_i")], None, running={"_b": ("min", seen)}, blocks=blocks)
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("_i") - a["i"]) / F.nullif(b["i"] - a["i"], F.lit(0))
    ends = F.coalesce(a["v"], b["v"]) if both else a["v"]
    value = F.coalesce(F.col(y).cast("double"), between, F.when(b.isNull() | F.lit(both), ends))
    return sides.withColumn(out, value).drop("_i", "_a", "_b")


def avg_rank(df: DataFrame, keys: Sequence[str], col: str, out: str = "rank", blocks=None) -> DataFrame:
    """Rank in the group with ties sharing their mean rank; NULL values get none.

    Only the distinct values with their counts are ordered; ranks join back.
    """
    counts = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_position(counts, keys, [F.col(col)], None, running={"_to": F.col("_n")}, blocks=blocks, derived=True)
    ranks = placed.select(*keys, col, (F.col("_to") - (F.col("_n") - 1) / 2).alias(out))
    return attach(df, ranks, [*keys, col])
