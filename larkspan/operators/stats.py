"""Trend tests, regressions, rank correlation and multiple-test adjustment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.functions.special import normal_two_sided, t_two_sided
from larkspan.operators.windows import avg_rank
from larkspan.plans.ordered import attach, with_position


def mann_kendall(df: DataFrame, key: Sequence[str], t: str, y: str, p_value: bool = True) -> DataFrame:
    """Mann-Kendall trend test per key: s, tie-corrected variance, z and two-sided p.

    One row per key and period, so a series is an array no longer than its
    calendar and the sign sums run inside the row; no pairs are emitted.
    """
    series = df.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), F.col(y).cast("double").alias("y")))), lambda r: r["y"]).alias("ys")
    )
    signs = F.aggregate(
        F.sequence(F.lit(1), F.size("ys")),
        F.lit(0.0),
        lambda acc, i: acc
        + F.aggregate(F.slice("ys", i + 1, F.size("ys")), F.lit(0.0), lambda a, v: a + F.signum(v - F.get("ys", i - 1))),
    )
    tied = F.aggregate(
        F.transform(F.array_distinct("ys"), lambda d: F.size(F.filter("ys", lambda v: v == d)).cast("double")),
        F.lit(0.0),
        lambda acc, c: acc + c * (c - 1) * (2 * c + 5),
    )
    n = F.col("n").cast("double")
    out = series.select(*key, F.size("ys").alias("n"), signs.cast("bigint").alias("s"), tied.alias("_ties"))
    out = out.withColumn("var_s", (n * (n - 1) * (2 * n + 5) - F.col("_ties")) / 18).drop("_ties")
    s = F.col("s")
    z = F.when(s == 0, F.lit(0.0)).otherwise(F.try_divide((s - F.signum(s)).cast("double"), F.sqrt("var_s")))
    out = out.withColumn("z", z)
    return out.withColumn("p_value", normal_two_sided("z")) if p_value else out


def ols_by(df: DataFrame, key: Sequence[str], x: str, y: str, fitted: bool = True) -> DataFrame:
    """Least-squares line per bucket; with ``fitted`` the rows get slope, intercept and fitted value."""
    lines = df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    if not fitted:
        return lines
    return attach(df, lines, key).withColumn("fitted", F.col(x) * F.col("slope") + F.col("intercept"))


def spearman_by(df: DataFrame, key: Sequence[str], x: str, y: str, p_value: bool = True) -> DataFrame:
    """Rank correlation per key over complete pairs, with a t-approximated p-value."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    ranked = avg_rank(avg_rank(pairs, key, x, "_rx"), key, y, "_ry")
    out = ranked.groupBy(*key).agg(F.corr("_rx", "_ry").alias("estimate"), F.count(F.lit(1)).alias("n"))
    if not p_value:
        return out
    r, free = F.col("estimate"), F.col("n") - 2
    t = r * F.sqrt(free / F.greatest(1 - r * r, F.lit(1e-300)))
    return out.withColumn("p_value", F.when(free > 0, t_two_sided(t, free.cast("double"))))


def p_adjust_bh(df: DataFrame, p: str, ties: Sequence[str], keys: Sequence[str] = (), out: str = "p_adj", blocks=None) -> DataFrame:
    """Benjamini-Hochberg adjustment over all tests (or per key); ``ties`` makes the order total."""
    numbered = with_position(df, keys, [F.col(p), *map(F.col, ties)], "_rank", total="_m", blocks=blocks, derived=True)
    scaled = numbered.withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    lowest = with_position(scaled, keys, [-F.col("_rank")], None, running={out: ("min", F.col("_raw"))}, blocks=blocks, derived=True)
    return lowest.withColumn(out, F.least(F.col(out), F.lit(1.0))).drop("_rank", "_m", "_raw")
