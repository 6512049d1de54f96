"""Readers. Schemas are always declared, never inferred."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DATED_NAME = r"(\d{4}-\d{2}-\d{2})"


def read_table(spark: SparkSession, path: str, schema: str, sep: str = ",", null: str = "") -> DataFrame:
    """Delimited file with a header line; unreadable cells become NULL."""
    return spark.read.schema(schema).csv(path, header=True, sep=sep, nullValue=null, mode="PERMISSIVE")


def read_many(
    spark: SparkSession, paths: str | Sequence[str], schema: str, provenance: str | None = None
) -> DataFrame:
    """Headerless files stacked into one table, optionally with the file each row came from."""
    df = spark.read.schema(schema).csv(paths if isinstance(paths, str) else list(paths), header=False)
    return df.select("*", F.col("_metadata.file_path").alias(provenance)) if provenance else df


def read_json_docs(spark: SparkSession, path: str, schema: str, rows: str | None = None) -> DataFrame:
    """JSON documents, one per line; ``rows`` names an array of objects to turn into rows."""
    df = spark.read.schema(schema).json(path)
    return df.select(F.inline(rows)) if rows else df


def read_json_twice(spark: SparkSession, path: str, schema: str, rows: str | None = None) -> DataFrame:
    """Documents stored as a JSON string that itself holds JSON text."""
    from larkspan.functions.scalar import json_twice

    df = spark.read.text(path).select(json_twice(F.col("value"), schema).alias("doc"))
    return df.select(F.inline(f"doc.{rows}")) if rows else df.select("doc.*")


def newest_day(spark: SparkSession, path: str) -> str | None:
    """Largest date in the file names under a path; only the listing is read, no file content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    day = F.nullif(F.regexp_extract("path", DATED_NAME + "[^/]*(/[^/]*)?$", 1), F.lit(""))
    return files.agg(F.max(day).alias("d")).first().d


def read_latest(spark: SparkSession, path: str, schema: str, as_of: date | str | None = None) -> DataFrame:
    """JSON of the newest dated file or folder only; fails when that is not ``as_of``."""
    newest = newest_day(spark, path)
    if newest is None or (as_of is not None and newest != str(as_of)):
        raise FileNotFoundError(f"no data for {as_of or 'any day'}, newest is {newest}")
    df = spark.read.schema(schema).json(f"{path.rstrip('/')}/*{newest}*")
    return df.withColumn("file_date", F.lit(newest).cast("date"))
