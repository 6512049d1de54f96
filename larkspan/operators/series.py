"""Preparation of many time series at once.

A series is the rows of one key ordered by date, with one row per key and date
(``to_series`` makes it so). A group is then no longer than its calendar, and
every step below is a window over the group keys: chained steps share a single
exchange and sort.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.functions.scalar import anchored_dates, snap_to
from larkspan.operators.clean import clamp_negative, expm1_round_like, log1p_cols, tag
from larkspan.operators.filters import keep_groups_min_obs
from larkspan.operators.joins import expand_grid, keep_keys
from larkspan.operators.sets import stack
from larkspan.operators.windows import interpolate, missing_streak


@dataclass(frozen=True)
class SeriesSpec:
    keys: tuple[str, ...]
    date: str
    y: str
    freq: str = "W-FRI"


def to_series(df: DataFrame, spec: SeriesSpec, value: Column, at: Column) -> DataFrame:
    """Sum a value per key and period; ``at`` maps a row to its period's date."""
    return df.groupBy(*spec.keys, at.alias(spec.date)).agg(F.sum(value).alias(spec.y))


def filter_min_obs(df: DataFrame, spec: SeriesSpec, k: int, inclusive: bool = False) -> DataFrame:
    return keep_groups_min_obs(df, spec.keys, spec.y, k, inclusive)


def clamp(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    return clamp_negative(df, spec.y)


def on_grid(spec: SeriesSpec) -> Column:
    """Whether the date falls on the anchor day."""
    return F.col(spec.date) == snap_to(F.col(spec.date), spec.freq)


def pad(df: DataFrame, spec: SeriesSpec, off_grid: str = "drop") -> DataFrame:
    """Rows on every calendar date between a group's first and last date, y NULL where new.

    No calendar table is joined: each row adds the dates up to the group's next
    row. Dates off an anchored calendar are dropped, rejected or moved to the
    next anchor day; unanchored steps start at each group's first date.
    """
    keys, d, y = list(spec.keys), F.col(spec.date), spec.y
    extra = [c for c in df.columns if c not in (*keys, spec.date, y)]
    df = df.withColumn(spec.date, d.cast("date"))
    w = Window.partitionBy(*keys).orderBy(spec.date)
    if spec.freq.startswith("W-"):
        if off_grid == "snap":
            df = df.groupBy(*keys, snap_to(d, spec.freq).alias(spec.date)).agg(F.sum(y).alias(y))
            extra = []
        elif off_grid == "error":
            fault = F.raise_error(F.concat(F.lit("date off the calendar: "), d.cast("string"))).cast("date")
            df = df.withColumn(spec.date, F.when(on_grid(spec), d).otherwise(fault))
        here = on_grid(spec)
        between = anchored_dates(F.date_add(d, 1), F.date_sub(F.col("_next"), 1), spec.freq)
    else:
        days = int(spec.freq[:-1] or 1)
        first = F.min(spec.date).over(Window.partitionBy(*keys))
        df = df.withColumn("_first", first)
        since = F.datediff(d, F.col("_first"))
        here = since % days == 0
        start = F.date_add(d, F.lit(days) - F.pmod(since, F.lit(days)))
        between = anchored_dates(start, F.date_sub(F.col("_next"), 1), spec.freq)
    rows = df.withColumn("_next", F.lead(spec.date).over(w))
    own = F.when(here, F.array(F.struct(d.alias("d"), F.lit(True).alias("own")))).otherwise(
        F.array().cast("array<struct<d:date,own:boolean>>")
    )
    gap = F.transform(between, lambda g: F.struct(g.alias("d"), F.lit(False).alias("own")))
    new = F.when(F.col("_next").isNull(), own).otherwise(F.concat(own, gap))
    out = rows.select(*keys, *extra, F.col(y).alias("_y"), F.explode(new).alias("_g"))
    value = lambda c, name: F.when(F.col("_g.own"), F.col(c)).alias(name)
    return out.select(*keys, F.col("_g.d").alias(spec.date), value("_y", y), *[value(c, c) for c in extra])


def with_streak(df: DataFrame, spec: SeriesSpec, out: str = "streak") -> DataFrame:
    return missing_streak(df, spec.keys, spec.date, spec.y, out)


def filter_max_streak(df: DataFrame, spec: SeriesSpec, k: int) -> DataFrame:
    """Groups whose longest run of NULLs is at most ``k``."""
    whole = Window.partitionBy(*spec.keys)
    longest = with_streak(df, spec, "_streak").withColumn("_longest", F.max("_streak").over(whole))
    return longest.filter(F.col("_longest") <= k).drop("_streak", "_longest")


def fill(df: DataFrame, spec: SeriesSpec, method: str = "linear", both: bool = False) -> DataFrame:
    """Fill NULLs within each group: ``linear`` between neighbours, group ``mean``, or ``zero``.

    Linear carries the last value forward at the end; a leading gap stays NULL
    unless ``both``. Observed values never change.
    """
    y = F.col(spec.y)
    if method == "linear":
        return interpolate(df, spec.keys, spec.date, spec.y, spec.y, both)
    if method == "mean":
        return df.withColumn(spec.y, F.coalesce(y, F.avg(y).over(Window.partitionBy(*spec.keys))))
    if method == "zero":
        return df.withColumn(spec.y, F.coalesce(y, F.lit(0)))
    raise ValueError(f"unknown fill method {method!r}")


def add_bounds(df: DataFrame, spec: SeriesSpec, floor: float, cap: float) -> DataFrame:
    """Forecast bounds: the group's minimum times ``floor``, its maximum times ``cap``."""
    whole = Window.partitionBy(*spec.keys)
    return df.withColumns(
        {"floor_value": F.min(spec.y).over(whole) * floor, "cap_value": F.max(spec.y).over(whole) * cap}
    )


def prepare(
    df: DataFrame,
    spec: SeriesSpec,
    min_obs: int,
    max_streak: int,
    floor: float,
    cap: float,
    off_grid: str = "drop",
    method: str = "linear",
    log: bool = True,
) -> DataFrame:
    """All steps in order: min-obs, negatives, pad, max-streak, fill, bounds, log."""
    whole = Window.partitionBy(*spec.keys)
    kept = df.withColumn("_n", F.count(spec.y).over(whole)).filter(F.col("_n") > min_obs).drop("_n")
    out = (
        kept.transform(clamp, spec)
        .transform(pad, spec, off_grid)
        .transform(filter_max_streak, spec, max_streak)
        .transform(fill, spec, method)
        .transform(add_bounds, spec, floor, cap)
    )
    return log1p_cols(out, spec.y, "floor_value", "cap_value") if log else out


def logged(spec: SeriesSpec) -> SeriesSpec:
    """The spec after the log step renamed y."""
    return replace(spec, y=f"{spec.y}_log1p")


def yearly_series(
    df: DataFrame, key: Sequence[str], year: str, n: str, start: int, minimum: float
) -> DataFrame:
    """Yearly totals per key from a start year, zero-filled over all years, for keys reaching a minimum.

    The minimum is checked before the zero rows are made.
    """
    recent = df.filter(F.col(year) >= start)
    yearly = recent.groupBy(*key, year).agg(F.sum(n).alias(n))
    large = yearly.groupBy(*key).agg(F.sum(n).alias("_t")).filter(F.col("_t") >= minimum)
    return complete_years(keep_keys(yearly, large, key), yearly.select(year).distinct(), key, year, n)


def complete_years(kept: DataFrame, years: DataFrame, key: Sequence[str], year: str, n: str) -> DataFrame:
    grid = expand_grid(years, kept.select(*key).distinct())
    return grid.join(kept, [*key, year], "left").withColumn(n, F.coalesce(F.col(n), F.lit(0))).select(*key, year, n)


def bind_forecast(
    actuals: DataFrame, forecast: DataFrame, spec: SeriesSpec, run: Column, round_actuals: bool = True
) -> DataFrame:
    """Actuals and forecast in one table, tagged, on the original scale.

    Both parts are transformed back with expm1 and rounded half to even;
    ``round_actuals=False`` leaves the actuals on the log scale.
    """
    past = tag(actuals.withColumnsRenamed({"y": spec.y, "ds": spec.date}).drop("cap", "floor"), part="actuals")
    names = {"yhat": spec.y, "yhat_lower": f"{spec.y}_lb", "yhat_upper": f"{spec.y}_ub", "ds": spec.date}
    ahead = tag(forecast.withColumnsRenamed(names), part="forecast", fcast_date=run)
    if round_actuals:
        return expm1_round_like(stack(past, ahead), spec.y)
    return stack(past, expm1_round_like(ahead, spec.y))


