"""Writers for dated JSON, CSV and partitioned landing paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_daily_json(df: DataFrame, path: str, day: str | Column, column: str = "date") -> None:
    """One folder per day; only the days present in ``df`` are replaced.

    Rows are gathered by day first, which keeps the files few; a large day is
    split over several.
    """
    value = day if isinstance(day, Column) else F.lit(day).cast("date")
    (
        df.withColumn(column, value)
        .hint("rebalance", F.col(column))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(column)
        .json(path)
    )


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).csv(path, header=True)


def write_partitioned(df: DataFrame, path: str, cols: Sequence[str], fmt: str = "parquet") -> None:
    """Partitioned files; a rerun replaces the partitions it writes and no others."""
    (
        df.hint("rebalance", *map(F.col, cols))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*cols)
        .format(fmt)
        .save(path)
    )
