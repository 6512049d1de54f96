"""Row and group filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.scalar import earth_feet
from larkspan.functions.text import is_lower, is_upper
from larkspan.operators.joins import keep_keys


def where(df: DataFrame, *conditions: Column | str) -> DataFrame:
    for c in conditions:
        df = df.filter(c)
    return df


def only_values(df: DataFrame, col: str, values: Sequence) -> DataFrame:
    return df.filter(F.col(col).isin(list(values)))


def exclude_values(df: DataFrame, col: str, values: Sequence[str], ci: bool = True) -> DataFrame:
    """Drop the listed values; NULL is kept."""
    c = F.lower(col) if ci else F.col(col)
    listed = [v.lower() for v in values] if ci else list(values)
    return df.filter(F.col(col).isNull() | ~c.isin(listed))


@dataclass(frozen=True)
class Rules:
    """Inclusive ranges per column and rejected values per column."""

    ranges: Mapping[str, tuple[float, float]]
    rejected: Mapping[str, Sequence[str]]

    def condition(self) -> Column:
        out = F.lit(True)
        for col, (low, high) in self.ranges.items():
            out = out & F.col(col).between(low, high)
        for col, values in self.rejected.items():
            out = out & ~F.col(col).isin(list(values))
        return out


# When an hour suits a run.
RUNNING = Rules(
    ranges={"hour": (13, 19), "temp": (30, 90), "wind_speed": (0, 30)},
    rejected={"status": ("Rain", "Snow", "Smoke")},
)


def match_rules(df: DataFrame, rules: Rules | Mapping[str, Rules], name: str = "rule_set") -> DataFrame:
    """Rows passing a rule set; with several named sets, one row per set passed."""
    if isinstance(rules, Rules):
        return df.filter(rules.condition())
    hits = F.array_compact(F.array(*[F.when(r.condition(), F.lit(k)) for k, r in rules.items()]))
    return df.select("*", F.explode(hits).alias(name))


def mixed_case_only(df: DataFrame, col: str) -> DataFrame:
    """Drop names in all capitals, in all lower case, and blank ones."""
    c = F.col(col)
    return df.filter((c != "") & ~is_upper(c) & ~is_lower(c))


def keep_groups_having(df: DataFrame, keys: Sequence[str], condition: Column, **aggs: Column) -> DataFrame:
    """Rows of the groups whose aggregates satisfy a condition on the aggregate names."""
    return keep_keys(df, df.groupBy(*keys).agg(*[c.alias(k) for k, c in aggs.items()]).filter(condition), keys)


def keep_groups_min_obs(df: DataFrame, keys: Sequence[str], y: str, k: int, inclusive: bool = False) -> DataFrame:
    """Groups with more than ``k`` non-NULL values (``inclusive``: at least ``k``)."""
    n = F.col("n_obs")
    return keep_groups_having(df, keys, n >= k if inclusive else n > k, n_obs=F.count(y))


def keep_groups_total(df: DataFrame, keys: Sequence[str], col: str, k: float) -> DataFrame:
    """Groups whose total reaches ``k``."""
    return keep_groups_having(df, keys, F.col("total") >= k, total=F.sum(col))


def within_radius(
    df: DataFrame, lat: str, lng: str, lat0: float, lng0: float, feet: float, out: str = "distance_feet"
) -> DataFrame:
    """Points within a great-circle radius, with the distance.

    A latitude band goes first: it holds every point of the circle and is a
    plain range on a stored column, so files and row groups can be skipped.
    """
    # A degree of latitude on the sphere used by earth_feet, with a little slack.
    band = feet / (6378.145 * 3280.8 * 3.141592653589793 / 180) * 1.000001
    near = df.filter(F.col(lat).between(lat0 - band, lat0 + band))
    return near.withColumn(out, earth_feet(F.lit(lat0), F.lit(lng0), F.col(lat), F.col(lng))).filter(F.col(out) <= feet)
