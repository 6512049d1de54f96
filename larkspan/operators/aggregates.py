"""Grouped summaries. Sums, counts and extremes fold map-side before the shuffle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from larkspan.functions.scalar import ratio
from larkspan.plans.ordered import attach, ready, with_position
from larkspan.session import checkpoint


# Items a quantile sketch keeps per level, and half the width of a bracket in ranks (some five times the sketch's error).
SKETCH_SIZE = 1600
MARGIN = 0.01


def summarise(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()])


def rate(df: DataFrame, keys: Sequence[str], num: str, den: str, out: str = "rate") -> DataFrame:
    """Ratio of sums; NULL where the denominator sums to zero."""
    return df.groupBy(*keys).agg(F.sum(num).alias(num), F.sum(den).alias(den)).withColumn(out, ratio(F.col(num), F.col(den)))


def group_bounds(df: DataFrame, keys: Sequence[str], col: str, floor: float, cap: float) -> DataFrame:
    """Per-group minimum times ``floor`` and maximum times ``cap``, on every row."""
    facts = df.groupBy(*keys).agg(
        (F.min(col) * floor).alias("floor_value"), (F.max(col) * cap).alias("cap_value")
    )
    return attach(df, facts, keys)


def distinct_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.select(*keys).distinct()


def count_groups(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return distinct_keys(df, keys).agg(F.count(F.lit(1)).alias("n_groups"))


def count_by(df: DataFrame, *cols: str, out: str = "n") -> DataFrame:
    """Row count per category, largest first, ties by category."""
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias(out)).orderBy(F.desc(out), *cols)


def quantiles(
    df: DataFrame, keys: Sequence[str], col: str, qs: Mapping[str, float], blocks: int | None = None,
    weight: str | None = None, approx: bool = False, accuracy: int = 10000,
) -> DataFrame:
    """Exact quantiles (linear between neighbours) per group, one column per entry of ``qs``.

    A mergeable sketch per group brackets every quantile; a second pass counts
    what lies below a bracket and numbers only the values inside it. A group
    whose counts show that a bracket missed is ranked whole. ``weight`` names a
    column of repeat counts; weighted rows are ranked whole. ``approx`` returns a
    value whose rank is off by at most 1 / ``accuracy`` of the group's rows.
    Input known to be small goes to the built-in exact percentile, which holds a
    group's distinct values in one task.
    """
    if approx:
        return df.groupBy(*keys).agg(*[F.percentile_approx(col, q, accuracy).alias(k) for k, q in qs.items()])
    used = dict.fromkeys([*keys, col, *([weight] if weight else [])])
    some, n = ready(df.filter(F.col(col).isNotNull()).select(*used), blocks, False)
    if n <= 1:
        levels = F.array(*[F.lit(float(q)) for q in qs.values()])
        found = F.percentile(F.col(col).cast("double"), levels, F.col(weight) if weight else 1)
        return some.groupBy(*keys).agg(found.alias("_q")).select(*keys, *[F.col("_q")[i].alias(k) for i, k in enumerate(qs)])
    if weight is None:
        return _bracketed_quantiles(some, keys, col, qs, blocks)
    return _ranked_quantiles(some, keys, col, qs, blocks, weight)


def _ranked_quantiles(
    df: DataFrame, keys: Sequence[str], col: str, qs: Mapping[str, float], blocks: int | None, weight: str | None = None
) -> DataFrame:
    """Equal values are counted; the running count over a group's distinct values tells which ones hold the two ranks."""
    n_rows = F.sum(weight) if weight else F.count(F.lit(1))
    counted = df.groupBy(*keys, col).agg(n_rows.cast("bigint").alias("_c"))
    placed = with_position(
        counted, keys, [F.col(col)], position=None, running={"_to": F.col("_c")}, totals={"_n": F.col("_c")}, blocks=blocks,
        derived=True,
    )
    picked = placed.groupBy(*keys).agg(*[c for i, q in enumerate(qs.values()) for c in _holders(i, q, F.col(col))])
    return picked.select(*keys, *[_between_holders(i).alias(k) for i, k in enumerate(qs)])


def _holders(i: int, q: float, value: Column, among: Column | bool = True) -> list[Column]:
    """Values at the two ranks around a quantile and its place between them, from running counts ``_to`` of ``_c`` rows."""
    first, last, h = F.col("_to") - F.col("_c"), F.col("_to") - 1, (F.col("_n") - 1) * F.lit(float(q))
    holds = lambda at: F.max(F.when((first <= at) & (at <= last) & among, value))
    return [holds(F.floor(h)).alias(f"_low{i}"), holds(F.ceil(h)).alias(f"_high{i}"), F.max(h - F.floor(h)).alias(f"_part{i}")]


def _between_holders(i: int) -> Column:
    return F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * F.col(f"_part{i}")


def _bracketed_quantiles(some: DataFrame, keys: Sequence[str], col: str, qs: Mapping[str, float], blocks: int | None) -> DataFrame:
    keys, levels, v = list(keys), [float(q) for q in qs.values()], F.col(col).cast("double")
    real = F.when(~F.isnan(v), v)
    sketch = some.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(real).alias("_real"), F.kll_sketch_agg_double(real, SKETCH_SIZE).alias("_sketch")
    )
    at = lambda r: F.kll_sketch_get_quantile_double("_sketch", F.lit(r))
    # NaN is the greatest double. A group of NaNs only is one bracket.
    some_real, lowest, highest = F.col("_real") > 0, F.lit(float("-inf")), F.lit(float("nan"))
    low = [F.when(some_real, at(q - MARGIN)).otherwise(lowest) if q - MARGIN > 0 else lowest for q in levels]
    high = [F.when(some_real, at(q + MARGIN)).otherwise(highest) if q + MARGIN < 1 else highest for q in levels]
    # Sketches draw random bits; the stored bounds are the same for a task that runs again.
    bounds = checkpoint(sketch.select(*keys, "_n", F.array(*low).alias("_from"), F.array(*high).alias("_upto")))
    marked = attach(some, bounds, keys)
    # What lies below a bracket folds into one NULL per group and bracket, which sorts first.
    zones = [
        F.when(v <= F.col("_upto")[i], F.struct(F.lit(i).alias("_at"), F.when(v >= F.col("_from")[i], F.col(col)).alias("_v")))
        for i in range(len(levels))
    ]
    inside = marked.select(*keys, "_n", F.explode(F.array_compact(F.array(*zones))).alias("_zone")).select(*keys, "_n", "_zone.*")
    counted = inside.groupBy(*keys, "_n", "_at", "_v").agg(F.count(F.lit(1)).alias("_c"))
    placed = with_position(counted, [*keys, "_at"], [F.col("_v")], position=None, running={"_to": F.col("_c")}, blocks=blocks, derived=True)
    picked = placed.groupBy(*keys).agg(*[c for i, q in enumerate(levels) for c in _holders(i, q, F.col("_v"), F.col("_at") == i)])
    held = reduce(lambda x, y: x & y, [F.col(f"_low{i}").isNotNull() & F.col(f"_high{i}").isNotNull() for i in range(len(levels))])
    found = checkpoint(picked.select(*keys, *[_between_holders(i).alias(k) for i, k in enumerate(qs)], held.alias("_held")))
    missed = found.filter(~F.col("_held")).select(*keys, "_held")
    if not missed.limit(1).count():
        return found.drop("_held")
    rest = attach(some, missed, keys).filter(F.col("_held").isNotNull()).drop("_held")
    return found.filter("_held").drop("_held").unionByName(_ranked_quantiles(rest, keys, col, qs, blocks))


def five_num(df: DataFrame, keys: Sequence[str], col: str, blocks: int | None = None) -> DataFrame:
    return quantiles(df, keys, col, {"low": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "high": 1.0}, blocks)


def over_index(
    df: DataFrame, entity: str, group: str, n: str, min_in_group: float, min_overall: float
) -> DataFrame:
    """How much more common an entity is in a group than overall.

    (n / group total) / (entity total / grand total), for pairs reaching both
    minimum counts. All totals come from the counted pairs, not from the rows.
    Rows without an entity or group are left out first, so that every branch
    reads the same counted pairs and Spark exchanges them once.
    """
    known = df.filter(F.col(entity).isNotNull() & F.col(group).isNotNull())
    counts = known.groupBy(entity, group).agg(F.sum(n).alias("n"))
    by_entity = counts.groupBy(entity).agg(F.sum("n").alias("entity_total")).filter(F.col("entity_total") >= min_overall)
    by_group = counts.groupBy(group).agg(F.sum("n").alias("group_total"))
    total = counts.agg(F.sum("n")).scalar()
    return (
        counts.filter(F.col("n") >= min_in_group)
        .join(by_entity, entity)
        .join(by_group, group)
        .withColumn("overrepresented_ratio", (F.col("n") / F.col("group_total")) / (F.col("entity_total") / total))
    )


def sum_distinct(df: DataFrame, key: Sequence[str], val: str, keys: Sequence[str] = (), out: str = "total") -> DataFrame:
    """Sum of a value repeated on many rows of its key, counted once per key and value."""
    return df.select(*keys, *key, val).distinct().groupBy(*keys).agg(F.sum(val).alias(out))


def weighted_points(
    df: DataFrame, keys: Sequence[str], weights: Mapping[str, float], den: str, out: str = "points", digits: int = 1
) -> DataFrame:
    """Mean value per success: weighted sum of the count columns over the sum of ``den``."""
    num = sum((F.sum(c) * w for c, w in weights.items()), F.lit(0))
    return df.groupBy(*keys).agg(F.round(F.try_divide(num, F.sum(den)), digits).alias(out))


def mean_ci(df: DataFrame, keys: Sequence[str], y: str, z: float = 1.96) -> DataFrame:
    """Group mean with a normal interval for a Poisson mean: se = sqrt(mean / n)."""
    means = df.groupBy(*keys).agg(F.avg(y).alias("mean"), F.count(y).alias("n"))
    se = F.sqrt(F.col("mean") / F.col("n"))
    return means.select(*keys, "mean", "n", (F.col("mean") - se * z).alias("lower"), (F.col("mean") + se * z).alias("upper"))


def observed(df: DataFrame, name: str, **aggs: Column) -> tuple[DataFrame, Observation]:
    """Measure aggregates while the rows flow by; read them after any action."""
    watch = Observation(name)
    return df.observe(watch, *[c.alias(k) for k, c in aggs.items()]), watch


def step_counts(steps: Mapping[str, DataFrame], **aggs: Column) -> DataFrame:
    """Rows: one per named step with its aggregates, to read the steps' effects side by side."""
    parts = [df.agg(*[c.alias(k) for k, c in aggs.items()]).select(F.lit(name).alias("step"), *aggs.keys()) for name, df in steps.items()]
    return reduce(DataFrame.union, parts)


def lump(df: DataFrame, col: str, n: int, other: str, out: str | None = None) -> DataFrame:
    """Keep the ``n`` most frequent values of a column and call the rest ``other``."""
    top = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), col).limit(n)
    listed = top.select(F.col(col).alias("_top"))
    joined = df.join(listed, F.col(col) == F.col("_top"), "left")
    text = F.col(col).cast("string")
    value = F.when(F.col("_top").isNotNull(), text).when(F.col(col).isNotNull(), F.lit(other))
    return joined.withColumn(out or col, value).drop("_top")


def digest(df: DataFrame, key: Sequence[str], order: str, text: str, empty: str, out: str = "message") -> DataFrame:
    """One message per key: its lines in order, or a fallback where every line is NULL.

    A key must hold at most one row per ``order`` value (an hour), which bounds
    a message.
    """
    line = F.when(F.col(text).isNotNull(), F.struct(order, text))
    lists = df.groupBy(*key).agg(F.array_sort(F.collect_list(line)).alias("_lines"))
    joined = F.array_join(F.transform("_lines", lambda r: r[text]), "<br/>")
    body = F.when(F.size("_lines") > 0, joined).otherwise(F.lit(empty))
    return lists.select(*key, F.concat(F.lit("<p>"), body, F.lit("</p>")).alias(out))


def mean_param(df: DataFrame, col: str, out: str = "mean") -> DataFrame:
    return df.agg(F.rint(F.avg(col)).alias(out))


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Counts in equal-width bins from the smallest to the largest value, empty bins included."""
    limits = df.agg(F.min(col).cast("double").alias("low"), F.max(col).cast("double").alias("high"))
    span = limits.select(F.struct("low", "high").alias("s")).scalar()
    x = F.col(col).cast("double")
    s = F.col("_s")
    at = F.least(F.floor((x - s["low"]) / F.nullif(s["high"] - s["low"], F.lit(0.0)) * bins), F.lit(bins - 1))
    counts = (
        df.filter(x.isNotNull())
        .select(x.alias(col))
        .withColumn("_s", span)
        .groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("high") - F.col("low")) / bins
    frame = limits.select("low", "high", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        "bin", (F.col("low") + F.col("bin") * width).alias("left"), (F.col("low") + (F.col("bin") + 1) * width).alias("right")
    )
    return frame.join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


