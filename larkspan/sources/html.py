"""Rows out of HTML text with regular-expression builtins only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _body(tag: str) -> str:
    return rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"


def tag_bodies(c: Column, tag: str) -> Column:
    """Array of the texts between ``<tag>`` and ``</tag>``, in page order."""
    return F.regexp_extract_all(c, F.lit(_body(tag)), F.lit(1))


def html_tag_bodies(df: DataFrame, html: str, tag: str, out: str = "body", position: str = "pos") -> DataFrame:
    """One row per tag body, with its 0-based place on the page."""
    keep = [c for c in df.columns if c != html]
    return df.select(*keep, F.posexplode(tag_bodies(F.col(html), tag)).alias(position, out))


def parse_records(df: DataFrame, html: str, row_pattern: str, fields: Mapping[str, str]) -> DataFrame:
    """Split pages into records and take one field per pattern, in one pass.

    ``missing`` lists the fields that were not found; a page without records
    keeps one row without a record number.
    """
    keep = [c for c in df.columns if c != html]
    found = F.regexp_extract_all(F.col(html), F.lit(row_pattern), F.lit(0))
    rows = df.select(*keep, F.posexplode_outer(found).alias("record_no", "record"))
    missed = F.array_compact(F.array(*[F.when(~F.col("record").rlike(p), F.lit(name)) for name, p in fields.items()]))
    return rows.select("*", *[F.regexp_extract("record", p, 1).alias(name) for name, p in fields.items()], missed.alias("missing"))


def extract_records(df: DataFrame, html: str, row_pattern: str, fields: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """(records, rejects): a record missing any field goes to rejects with the names of those fields."""
    keep = [c for c in df.columns if c != html]
    parsed = parse_records(df, html, row_pattern, fields).filter(F.col("record_no").isNotNull())
    good = parsed.filter(F.size("missing") == 0).select(*keep, "record_no", *fields)
    bad = parsed.filter(F.size("missing") > 0).select(*keep, "record_no", "record", "missing")
    return good, bad


def extract_pages(
    df: DataFrame, html: str, row_pattern: str, fields: Mapping[str, str], key: str
) -> tuple[DataFrame, DataFrame]:
    """Extract from every page; a page giving no record is reported and the rest continue.

    Returns (records, report), the report with the records and rejects per page.
    """
    parsed = parse_records(df, html, row_pattern, fields)
    there = F.col("record_no").isNotNull()
    report = parsed.groupBy(key).agg(
        F.count_if(there & (F.size("missing") == 0)).alias("records"), F.count_if(there & (F.size("missing") > 0)).alias("rejects")
    )
    return extract_records(df, html, row_pattern, fields)[0], report.withColumn("failed", F.col("records") == 0)


def html_tables(
    df: DataFrame, html: str, require_col: str | None = None, nth: int | None = None
) -> DataFrame:
    """Cells of HTML tables in long form: table_no, row_no, header, value.

    ``nth`` keeps one table by position (0 = first) and ``require_col`` the
    tables with that header, so pages may differ in layout. A cell's header is
    the one in the same column; a column without a header gets an empty one.
    """
    keep = [c for c in df.columns if c != html]
    tables = df.select(*keep, F.posexplode(tag_bodies(F.col(html), "table")).alias("table_no", "_table"))
    if nth is not None:
        tables = tables.filter(F.col("table_no") == nth)
    headers = F.transform(tag_bodies(F.col("_table"), "th"), lambda h: F.trim(F.regexp_replace(h, "<[^>]*>", "")))
    tables = tables.withColumn("_heads", headers)
    if require_col is not None:
        tables = tables.filter(F.array_contains("_heads", require_col))
    rows = tables.select(*keep, "table_no", "_heads", F.posexplode(tag_bodies(F.col("_table"), "tr")).alias("row_no", "_tr"))
    cells = rows.select(
        *keep, "table_no", "row_no", "_heads", F.posexplode(tag_bodies(F.col("_tr"), "td")).alias("_col", "_td")
    )
    return cells.select(
        *keep,
        "table_no",
        "row_no",
        F.coalesce(F.get("_heads", F.col("_col")), F.lit("")).alias("header"),
        F.trim(F.regexp_replace("_td", "<[^>]*>", "")).alias("value"),
    )
