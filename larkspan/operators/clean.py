"""Projection, schema and cleaning steps."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions.names import clean_names
from larkspan.functions.scalar import expm1_round

__all__ = ["clean_names"]


def _matches(name: str, patterns: Iterable[str]) -> bool:
    return any(re.search(p, name) for p in patterns)


def like_names(cols: Iterable[str], include: Sequence[str] = (), exclude: Sequence[str] = ()) -> list[str]:
    """Names matching any ``include`` pattern (all if none given) and no ``exclude`` pattern."""
    return [c for c in cols if (not include or _matches(c, include)) and not _matches(c, exclude)]


def contains(text: str) -> str:
    return re.escape(text)


def starts_with(text: str) -> str:
    return f"^{re.escape(text)}"


def ends_with(text: str) -> str:
    return f"{re.escape(text)}$"


def select_like(df: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    return df.select(*like_names(df.columns, include, exclude))


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def strip_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[c.removeprefix(prefix) for c in df.columns])


def move_last(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in cols], *cols)


def with_cols(df: DataFrame, exprs: Mapping[str, Column]) -> DataFrame:
    return df.withColumns(dict(exprs))


def try_cast_like(df: DataFrame, pattern: str, dtype: str) -> DataFrame:
    """Cast every column whose name matches; text that does not parse becomes NULL."""
    hit = set(like_names(df.columns, [pattern]))
    return df.select(*[F.col(c).try_cast(dtype).alias(c) if c in hit else F.col(c) for c in df.columns])


def fill_all(df: DataFrame, value) -> DataFrame:
    """Replace NULL by a constant in every column whose type takes it."""
    return df.na.fill(value)


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def clamp_negative(df: DataFrame, col: str) -> DataFrame:
    """Negative values to zero, NULL unchanged."""
    return df.withColumn(col, F.when(F.col(col) < 0, F.lit(0)).otherwise(F.col(col)))


def log1p_cols(df: DataFrame, *cols: str) -> DataFrame:
    """Add ``<c>_log1p`` for each column and drop the original."""
    return df.withColumns({f"{c}_log1p": F.log1p(c) for c in cols}).drop(*cols)


def expm1_round_like(df: DataFrame, text: str) -> DataFrame:
    """Undo log1p, rounding half to even, on every numeric column whose name contains ``text``."""
    numeric = {f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)}
    return df.select(*[expm1_round(F.col(c)).alias(c) if text in c and c in numeric else F.col(c) for c in df.columns])


def to_model_frame(df: DataFrame, keys: Sequence[str], date_col: str, y_col: str) -> DataFrame:
    """Keys, ``ds`` and ``y``, plus ``cap`` and ``floor`` where both bounds are present."""
    caps = like_names(df.columns, ["cap_value"])
    floors = like_names(df.columns, ["floor_value"])
    bounds = [F.col(caps[0]).alias("cap"), F.col(floors[0]).alias("floor")] if caps and floors else []
    return df.select(*keys, *bounds, F.to_date(date_col).alias("ds"), F.col(y_col).alias("y"))


def tag(df: DataFrame, **literals) -> DataFrame:
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in literals.items()})


def peek(df: DataFrame, n: int, *order: Column | str, last: bool = False) -> DataFrame:
    """First (or last) ``n`` rows of an explicit order."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order]
    return df.orderBy(*([c.desc() for c in cols] if last else cols)).limit(n)


def glimpse(df: DataFrame) -> DataFrame:
    """Column, declared type, non-NULL count, smallest and largest value as text."""
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    stats = df.agg(
        *[
            F.struct(F.count(f.name).alias("n"), F.min(f.name).cast("string").alias("low"), F.max(f.name).cast("string").alias("high")).alias(f.name)
            for f in plain
        ]
    )
    rows = F.array(
        *[F.struct(F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col(f"`{f.name}`.n").alias("n"),
                   F.col(f"`{f.name}`.low").alias("low"), F.col(f"`{f.name}`.high").alias("high")) for f in plain]
    )
    return stats.select(F.inline(rows))


def with_order(df: DataFrame, label: str, by: str, group: Sequence[str] = (), out: str = "label_order") -> DataFrame:
    """Order number of each label by the sum of another column, optionally within groups.

    The labels are aggregated first, so only one row per label is ranked.
    """
    from larkspan.plans.ordered import attach, with_position

    keys = [*group, label]
    labels = df.groupBy(*keys).agg(F.sum(by).alias("_by"))
    ranked = with_position(labels, list(group), [F.col("_by"), F.col(label)], position=out, derived=True).drop("_by")
    return attach(df, ranked, keys)


def with_levels(df: DataFrame, label: str, levels: Sequence[str], out: str = "label_order") -> DataFrame:
    """Order number from an explicit list of levels; unknown labels get NULL."""
    from larkspan.functions.scalar import bucket_order

    return df.withColumn(out, bucket_order(F.col(label), levels))


def run_date(value: date | str) -> Column:
    return F.lit(str(value)).cast("date")
