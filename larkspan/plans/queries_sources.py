"""Queries for readers, writers and HTML extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions.scalar import json_rows, json_twice
from larkspan.plans.registry import query
from larkspan.sources.html import extract_pages, extract_records, html_tables, html_tag_bodies
from larkspan.sources.readers import read_json_docs, read_latest, read_many, read_table
from larkspan.sources.writers import write_csv, write_daily_json, write_partitioned

PART_SCHEMA = "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


@query("csv_table", "A1 A6", "SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def _(t):
    path = t.scratch("csv")
    write_csv(t.part, path)
    return read_table(t.spark, path, PART_SCHEMA)


@query(
    "csv_stack",
    "A2",
    "SELECT c_custkey AS custkey, c_name AS name, c_acctbal AS acctbal, c_mktsegment AS segment FROM customer",
)
def _(t):
    path = t.scratch("stack")
    rows = t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    rows.write.partitionBy("c_mktsegment").csv(path)
    stacked = read_many(t.spark, f"{path}/*", "custkey bigint, name string, acctbal double", "file")
    return stacked.select("custkey", "name", "acctbal", F.regexp_extract("file", "c_mktsegment=([^/]+)/", 1).alias("segment"))


HOURS_SCHEMA = "array<struct<dt:bigint,temp:double,wind_speed:double,weather:array<struct<main:string>>>>"


def weather_docs(t):
    """One nested document per event: epoch seconds, readings and a status list."""
    hour = F.struct(
        F.unix_timestamp(F.col("ts").cast("timestamp")).alias("dt"),
        F.col("value").alias("temp"),
        F.get_json_object("props", "$.k").cast("double").alias("wind_speed"),
        F.array(F.struct(F.col("event_type").alias("main"))).alias("weather"),
    )
    return t.events.select("event_id", F.to_json(F.struct(F.array(hour).alias("hourly"))).alias("doc"))


HOUR_ROWS = """
SELECT CAST(floor(epoch(ts)) AS BIGINT) AS dt, value AS temp, CAST(props->>'$.k' AS DOUBLE) AS wind_speed, event_type AS status
FROM events
"""


@query("json_documents", "A3 I16", HOUR_ROWS)
def _(t):
    path = t.scratch("docs")
    weather_docs(t).select("doc").write.text(path)
    rows = read_json_docs(t.spark, path, f"hourly {HOURS_SCHEMA}", "hourly")
    return rows.select("dt", "temp", "wind_speed", F.col("weather")[0]["main"].alias("status"))


@query("json_rows", "I16 A3", HOUR_ROWS)
def _(t):
    docs = weather_docs(t).select(json_rows(F.col("doc"), f"struct<hourly:{HOURS_SCHEMA}>").alias("d"))
    return docs.select(F.inline("d.hourly")).select("dt", "temp", "wind_speed", F.col("weather")[0]["main"].alias("status"))


@query("json_twice", "A3", HOUR_ROWS)
def _(t):
    # A JSON array of one string, without its brackets, is the quoted string.
    quoted = weather_docs(t).select(F.to_json(F.array("doc")).alias("q"))
    stored = quoted.select(F.expr("substring(q, 2, length(q) - 2)").alias("s"))
    docs = stored.select(json_twice(F.col("s"), f"struct<hourly:{HOURS_SCHEMA}>").alias("d"))
    return docs.select(F.inline("d.hourly")).select("dt", "temp", "wind_speed", F.col("weather")[0]["main"].alias("status"))


@query(
    "latest_day",
    "A4 A5",
    """SELECT event_id, user_id, value, ts::DATE AS file_date FROM events
       WHERE ts::DATE = (SELECT max(ts::DATE) FROM events)""",
)
def _(t):
    path = t.scratch("daily")
    write_daily_json(t.events.select("event_id", "user_id", "value", "ts"), path, F.to_date("ts"))
    return read_latest(t.spark, path, "event_id bigint, user_id bigint, value double")


@query(
    "partitioned_landing",
    "A7",
    """SELECT year(o_orderdate)::INT AS season, count(*) AS n, round(sum(o_totalprice), 2) AS total
       FROM orders GROUP BY ALL""",
)
def _(t):
    path = t.scratch("landing")
    write_partitioned(t.orders.withColumn("season", F.year("o_orderdate")), path, ["season"])
    landed = t.spark.read.schema("o_totalprice double, season int").parquet(path)
    return landed.groupBy("season").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "tag_bodies",
    "A8",
    r"""SELECT page_id, (i - 1)::INT AS pos, bodies[i] AS body
        FROM (SELECT page_id, regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1) AS bodies FROM pages),
             unnest(generate_series(1, len(bodies))) AS u(i)""",
)
def _(t):
    return html_tag_bodies(t.pages.select("page_id", "html"), "html", "li")


# A link whose target ends in a full stop or comma misses the "plain" pattern.
LINK_ROW = r"(?is)<li>.*?</li>"
LINK_FIELDS = {"href": r'href="/([^"]*)"', "label": r">([^<]*)</a>", "plain": r'href="/[^"]*([^",.])"'}

LINKS = r"""
WITH found AS (
  SELECT page_id, regexp_extract_all(html, '(?is)<li>.*?</li>') AS recs FROM pages
), recs AS (
  SELECT page_id, (i - 1)::INT AS record_no, recs[i] AS record FROM found, unnest(generate_series(1, len(recs))) AS u(i)
), fields AS (
  SELECT *, regexp_extract(record, 'href="/([^"]*)"', 1) AS href, regexp_extract(record, '>([^<]*)</a>', 1) AS label,
         regexp_extract(record, 'href="/[^"]*([^",.])"', 1) AS plain,
         regexp_matches(record, 'href="/([^"]*)"') AS has_href, regexp_matches(record, '>([^<]*)</a>') AS has_label,
         regexp_matches(record, 'href="/[^"]*([^",.])"') AS has_plain
  FROM recs
)
"""


@query("records", "A9", LINKS + "SELECT page_id, record_no, href, label, plain FROM fields WHERE has_href AND has_label AND has_plain")
def _(t):
    return extract_records(t.pages.select("page_id", "html"), "html", LINK_ROW, LINK_FIELDS)[0]


@query(
    "record_rejects",
    "A9",
    LINKS
    + """SELECT page_id, record_no, record, array_to_string(list_filter([CASE WHEN NOT has_href THEN 'href' END,
         CASE WHEN NOT has_label THEN 'label' END, CASE WHEN NOT has_plain THEN 'plain' END], lambda x: x IS NOT NULL), ',') AS missing
         FROM fields WHERE NOT (has_href AND has_label AND has_plain)""",
)
def _(t):
    bad = extract_records(t.pages.select("page_id", "html"), "html", LINK_ROW, LINK_FIELDS)[1]
    return bad.withColumn("missing", F.concat_ws(",", "missing"))


@query(
    "page_report",
    "A11",
    LINKS
    + """SELECT page_id, coalesce(sum((has_href AND has_label AND has_plain)::INT), 0)::BIGINT AS records,
         coalesce(sum((NOT (has_href AND has_label AND has_plain))::INT), 0)::BIGINT AS rejects,
         coalesce(sum((has_href AND has_label AND has_plain)::INT), 0) = 0 AS failed
         FROM pages LEFT JOIN fields USING (page_id) GROUP BY page_id""",
)
def _(t):
    pages = t.pages.select("page_id", "html")
    return extract_pages(pages, "html", LINK_ROW, LINK_FIELDS, "page_id")[1]


def school_pages(t):
    """A page per part with two tables: one with a School column, one without."""
    row = lambda *cells: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), c, F.lit("</td>")) for c in cells], F.lit("</tr>"))
    first = F.concat(
        F.lit('<table class="a"><tr><th>School</th><th><b>Size</b></th></tr>'),
        row(F.col("p_name"), F.col("p_size").cast("string")),
        row(F.concat(F.lit("<i>"), F.col("p_brand"), F.lit("</i>")), F.col("p_type")),
        F.lit("</table>"),
    )
    second = F.concat(F.lit("<table><tr><th>Kind</th></tr>"), row(F.col("p_type")), F.lit("</table>"))
    return t.part.select("p_partkey", F.concat(F.lit("<html><body>"), second, first, F.lit("</body></html>")).alias("html"))


@query(
    "tables_by_header",
    "A10",
    """SELECT p_partkey, 1 AS table_no, r AS row_no, h AS header, v AS value FROM part,
       LATERAL (VALUES (1, 'School', p_name), (1, 'Size', p_size::VARCHAR), (2, 'School', p_brand), (2, 'Size', p_type)) AS c(r, h, v)""",
)
def _(t):
    return html_tables(school_pages(t), "html", require_col="School")


@query("tables_by_position", "A10", "SELECT p_partkey, 0 AS table_no, 1 AS row_no, 'Kind' AS header, p_type AS value FROM part")
def _(t):
    return html_tables(school_pages(t), "html", nth=0)
