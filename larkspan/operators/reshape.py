"""Wide, long, complete and nested shapes."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.operators.joins import expand_grid


def to_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(list(ids), list(cols), name, value)


def to_wide(
    df: DataFrame, ids: Sequence[str], name: str, value: str, values: Sequence, agg: Callable[..., Column] = F.first
) -> DataFrame:
    """Listed names become columns; the list is required so that no extra job looks for it."""
    return df.groupBy(*ids).pivot(name, list(values)).agg(agg(value))


def split_rows(df: DataFrame, col: str, sep: str = ", ") -> DataFrame:
    return df.withColumn(col, F.explode(F.split(col, sep)))


def complete(df: DataFrame, a: Sequence[str], b: Sequence[str], fill: Mapping[str, object]) -> DataFrame:
    """Every combination of the two key sets, missing rows filled with constants.

    The longer key list should be ``b``: it is spread over buckets.
    """
    grid = expand_grid(df.select(*a).distinct(), df.select(*b).distinct())
    out = grid.join(df, [*a, *b], "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in fill.items()})


def nest(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "rows") -> DataFrame:
    """The rows of a group as one array. For groups with a known small size only."""
    rest = [*order, *[c for c in df.columns if c not in (*keys, *order)]]
    return df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*rest))).alias(out))


def unnest(df: DataFrame, col: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != col], F.inline(col))


def map_groups(df: DataFrame, keys: Sequence[str], fn: Callable, schema: str) -> DataFrame:
    """Grouped map ``fn(key, frame) -> frame``.

    A group becomes one frame in one task, so callers aggregate it to a bounded
    size first (one row per period, or one per distinct cell).
    """
    return df.groupBy(*keys).applyInPandas(fn, schema)
