"""Queries for cleaning, scalar functions and row filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions import scalar as S
from larkspan.functions import text as X
from larkspan.operators import clean as C
from larkspan.operators import filters as W
from larkspan.operators.aggregates import summarise
from larkspan.plans.registry import query


@query(
    "clean_names",
    "B1",
    """SELECT l_returnflag AS return_flag, sum(l_quantity)::DOUBLE AS total_qty, max(l_tax) AS max_tax,
       count(*) AS f_gs_made FROM lineitem GROUP BY ALL""",
)
def _(t):
    return C.clean_names(
        t.lineitem.groupBy(F.col("l_returnflag").alias("ReturnFlag")).agg(
            F.sum("l_quantity").alias("Total Qty"), F.max("l_tax").alias("max.tax"), F.count(F.lit(1)).alias("FGs Made")
        )
    )


@query(
    "clean_names_snake",
    "B2",
    """SELECT l_returnflag AS return_flag, count(*) AS f_gs_made_20_29_yards, max(l_tax) AS max_percent_tax,
       min(l_tax) AS return_flag_2 FROM lineitem GROUP BY ALL""",
)
def _(t):
    return C.clean_names(
        t.lineitem.groupBy(F.col("l_returnflag").alias("Return Flag")).agg(
            F.count(F.lit(1)).alias("FGs Made 20-29 (Yards)"), F.max("l_tax").alias("Max % Tax"), F.min("l_tax").alias("return-flag")
        ),
        "snake",
    )


@query("select_like", "B3", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer")
def _(t):
    return C.select_like(t.customer, [C.ends_with("key"), C.contains("bal")], ["segment"])


@query("rename_columns", "B4", "SELECT c_custkey AS id, c_nationkey AS nationkey, c_acctbal AS acctbal, c_name AS label FROM customer")
def _(t):
    df = C.strip_prefix(t.customer.drop("c_mktsegment"), "c_")
    return C.move_last(C.rename(df, {"custkey": "id", "name": "label"}), "label")


@query(
    "derived_columns",
    "B5 B10 B12 I13 I15",
    """SELECT o_orderkey, o_totalprice / 1000 AS thousands,
       CASE WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 400000 THEN 1 ELSE 0 END AS success,
       (year(o_orderdate) // 10 * 10)::INT AS decade,
       round(log2(o_totalprice), 6) AS magnitude, round(sqrt(o_totalprice), 6) AS root,
       least(greatest(o_totalprice, 50000.0), 300000.0) AS clipped
       FROM orders""",
)
def _(t):
    price = F.col("o_totalprice")
    new = {
        "thousands": price / 1000,
        "success": S.flag((F.col("o_orderpriority") == "1-URGENT") | (price > 400000)),
        "decade": S.floor_to(F.year("o_orderdate"), 10),
        "magnitude": F.round(F.log2(price), 6),
        "root": F.round(F.sqrt(price), 6),
        "clipped": S.clip(price, 50000.0, 300000.0),
    }
    return C.with_cols(t.orders, new).select("o_orderkey", *new)


@query(
    "try_cast_columns",
    "B6 B7 B8",
    """SELECT p_partkey, CASE WHEN p_size < 10 THEN 0 ELSE p_size END::DOUBLE AS size_made,
       p_retailprice AS price_made FROM part""",
)
def _(t):
    text = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") < 10, "--").otherwise(F.col("p_size").cast("string")).alias("size_made"),
        F.col("p_retailprice").cast("string").alias("price_made"),
    )
    return C.fill_all(C.try_cast_like(text, "made$", "double"), 0)


@query(
    "drop_incomplete",
    "B8 B6",
    "SELECT p_partkey, p_size::DOUBLE AS size_made FROM part WHERE p_size >= 10",
)
def _(t):
    text = t.part.select(
        "p_partkey", F.when(F.col("p_size") < 10, "--").otherwise(F.col("p_size").cast("string")).alias("size_made")
    )
    return C.drop_incomplete(C.try_cast_like(text, "made$", "double"))


@query(
    "parse_number",
    "B9",
    "SELECT o_orderkey, o_totalprice AS price, l AS discount FROM orders JOIN (SELECT l_orderkey, l_linenumber, l_discount * 100 AS l FROM lineitem) ON o_orderkey = l_orderkey".replace(
        "l AS discount", "round(l, 1) AS discount"
    ),
)
def _(t):
    money = t.orders.select("o_orderkey", F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("price"))
    pct = t.lineitem.select("l_orderkey", F.concat(F.format_number(F.col("l_discount") * 100, 1), F.lit("%")).alias("discount"))
    joined = money.join(pct, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("o_orderkey", X.parse_number(F.col("price")).alias("price"), X.parse_number(F.col("discount")).alias("discount"))


RANKS = [(1, 10), (11, 20), (21, 30), (31, 40), (41, None)]
RANK_LABELS = ["1 - 10", "11 - 20", "21 - 30", "31 - 40", "> 40"]
RANK_SQL = """CASE WHEN p_size BETWEEN 1 AND 10 THEN '1 - 10' WHEN p_size BETWEEN 11 AND 20 THEN '11 - 20'
  WHEN p_size BETWEEN 21 AND 30 THEN '21 - 30' WHEN p_size BETWEEN 31 AND 40 THEN '31 - 40' WHEN p_size > 40 THEN '> 40' END"""


@query(
    "bucketize",
    "B11 B20",
    f"""SELECT p_partkey, {RANK_SQL} AS size_bucket,
        list_position(['1 - 10', '11 - 20', '21 - 30', '31 - 40', '> 40'], {RANK_SQL})::INT AS label_order FROM part""",
)
def _(t):
    df = t.part.select("p_partkey", S.bucketize(F.col("p_size"), RANKS, RANK_LABELS).alias("size_bucket"))
    return C.with_levels(df, "size_bucket", RANK_LABELS)


@query(
    "clamp_negative",
    "B13 K2",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS c_acctbal FROM (SELECT c_custkey, c_acctbal - 5000 AS c_acctbal FROM customer)",
)
def _(t):
    return C.clamp_negative(t.customer.select("c_custkey", (F.col("c_acctbal") - 5000).alias("c_acctbal")), "c_acctbal")


@query(
    "log_columns",
    "B14 K8",
    "SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS o_totalprice_log1p FROM orders",
)
def _(t):
    df = C.log1p_cols(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return df.withColumn("o_totalprice_log1p", F.round("o_totalprice_log1p", 9))


@query(
    "expm1_round",
    "B15 I13",
    "SELECT o_orderkey, floor(o_totalprice) AS price_log1p, round_even(o_totalprice * 100, 0) / 100 AS price FROM orders",
)
def _(t):
    whole = t.orders.select(
        "o_orderkey", F.floor("o_totalprice").cast("double").alias("price"), (S.round_half_even(F.col("o_totalprice") * 100) / 100).alias("exact")
    )
    back = C.expm1_round_like(C.log1p_cols(whole, "price"), "price")
    return back.withColumnRenamed("exact", "price")


@query(
    "model_frame",
    "B16 B17",
    """SELECT o_custkey, 2 * o_totalprice AS cap, 0.5 * o_totalprice AS floor, o_orderdate::DATE AS ds, o_totalprice AS y,
       'actuals' AS part, DATE '2021-03-28' AS fcast_date FROM orders""",
)
def _(t):
    df = t.orders.withColumns({"cap_value_x": F.col("o_totalprice") * 2, "floor_value_x": F.col("o_totalprice") * 0.5})
    return C.tag(C.to_model_frame(df, ["o_custkey"], "o_orderdate", "o_totalprice"), part="actuals", fcast_date=C.run_date("2021-03-28"))


@query("swap_name", "B18 I6", "SELECT p_partkey, p_name AS name, regexp_extract(p_brand, '\\d+') AS brand_no, p_name AS two FROM part")
def _(t):
    words = F.split("p_name", " ")
    listed = F.concat(words[1], F.lit(", "), words[0])
    return t.part.select(
        "p_partkey", X.swap_name(listed).alias("name"), X.first_digits(F.col("p_brand")).alias("brand_no"),
        X.first_tokens(F.concat("p_name", F.lit(" more words")), 2).alias("two"),
    )


@query("peek_first", "B19", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def _(t):
    return C.peek(t.orders.select("o_orderkey", "o_totalprice"), 6, F.desc("o_totalprice"), F.col("o_orderkey"))


@query(
    "glimpse",
    "B19",
    """SELECT 'c_custkey' AS "column", 'bigint' AS type, count(c_custkey) AS n, min(c_custkey)::VARCHAR AS low, max(c_custkey)::VARCHAR AS high FROM customer
       UNION ALL SELECT 'c_name', 'string', count(c_name), min(c_name), max(c_name) FROM customer
       UNION ALL SELECT 'c_nationkey', 'int', count(c_nationkey), min(c_nationkey)::VARCHAR, max(c_nationkey)::VARCHAR FROM customer
       UNION ALL SELECT 'c_acctbal', 'double', count(c_acctbal), min(c_acctbal)::VARCHAR, max(c_acctbal)::VARCHAR FROM customer
       UNION ALL SELECT 'c_mktsegment', 'string', count(c_mktsegment), min(c_mktsegment), max(c_mktsegment) FROM customer""",
)
def _(t):
    return C.glimpse(t.customer)


@query(
    "label_order",
    "B20",
    """SELECT n_name, c_mktsegment, n, row_number() OVER (PARTITION BY n_name ORDER BY n, c_mktsegment)::INT AS label_order
       FROM (SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)""",
)
def _(t):
    joined = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    counts = summarise(joined, ["n_name", "c_mktsegment"], n=F.count(F.lit(1)))
    return C.with_order(counts, "c_mktsegment", "n", ["n_name"]).withColumn("label_order", F.col("label_order").cast("int"))


@query(
    "text_case",
    "I1 I2 I5",
    r"""SELECT p_partkey, lower(p_brand) AS low,
        upper(p_name[1]) || lower(split_part(p_name, ' ', 1)[2:]) || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] AS title,
        regexp_replace(p_name, 'l', '$') AS first_only, regexp_replace(p_name, 'l', '$', 'g') AS every,
        p_name || ', Portland, OR' AS with_suffix, p_name AS without FROM part""",
)
def _(t):
    name = F.col("p_name")
    return t.part.select(
        "p_partkey",
        F.lower("p_brand").alias("low"),
        X.title(F.replace(name, F.lit(" "), F.lit("_"))).alias("title"),
        X.replace_first(name, "l", "$").alias("first_only"),
        X.replace_all(name, "l", "$").alias("every"),
        X.add_suffix(name, ", Portland, OR").alias("with_suffix"),
        X.drop_suffix(X.add_suffix(name, ", Portland, OR"), ", Portland, OR").alias("without"),
    )


@query(
    "normalise_college",
    "I3",
    r"""WITH raw AS (SELECT p_partkey, p_name || ' (' || p_type || ')%2c ' || p_brand || ' %26 great falls at ' || p_type || ', or - x' AS name FROM part),
        a AS (SELECT p_partkey, replace(replace(replace(regexp_replace(name, ' \(.+?\)', '', 'g'), '%2c', ','), '%26', '&'), '%27', '''') AS name FROM raw)
        SELECT p_partkey, trim(replace(regexp_replace(regexp_replace(name, 'at (.+/?)', '', 'g'), ',\s[a-z][a-z]', '', 'g'), ' - ', '-')) AS name,
               trim(replace(regexp_replace(regexp_replace(name, '\bat (.+/?)', '', 'g'), ',\s[a-z][a-z]', '', 'g'), ' - ', '-')) AS strict_name
        FROM a""",
)
def _(t):
    raw = F.concat(
        F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")%2c "), F.col("p_brand"), F.lit(" %26 great falls at "), F.col("p_type"), F.lit(", or - x")
    )
    return t.part.select("p_partkey", X.normalise_college(raw).alias("name"), X.normalise_college(raw, strict=True).alias("strict_name"))


@query(
    "clean_listing_names",
    "I4 C5",
    r"""WITH raw AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<li(?:\s[^>]*)?>(.*?)</li>', 1)) AS body FROM pages),
        listed AS (SELECT page_id, 'No. ' || page_id || ' -- ' || regexp_replace(body, '<[^>]*>', '', 'g') || ' &amp; co: <em>x</em>' AS a,
                          regexp_replace(body, '<[^>]*>', '', 'g') AS b FROM raw),
        named AS (SELECT page_id, trim(regexp_replace(regexp_replace(v, '<em> (.*?)</em>', '', 'g'), 'No. \d+ --', '', 'g')) AS n
                  FROM (SELECT page_id, a AS v FROM listed UNION ALL SELECT page_id, b FROM listed)),
        shown AS (SELECT page_id, n, replace(regexp_replace(replace(n, '&amp;', '&'), ': <em>(.*?)</em>', '', 'g'), ':', '') AS name FROM named)
        SELECT page_id, name FROM shown
        WHERE NOT (n = upper(n) AND regexp_matches(n, '\pL')) AND NOT (n = lower(n) AND regexp_matches(n, '\pL')) AND name <> ''""",
)
def _(t):
    bodies = t.pages.select(
        "page_id", F.explode(F.regexp_extract_all("html", F.lit(r"(?is)<li(?:\s[^>]*)?>(.*?)</li>"), F.lit(1))).alias("body")
    )
    word = F.regexp_replace("body", "<[^>]*>", "")
    numbered = F.concat(F.lit("No. "), F.col("page_id").cast("string"), F.lit(" -- "), word, F.lit(" &amp; co: <em>x</em>"))
    names = bodies.select("page_id", F.explode(F.array(numbered, word)).alias("raw"))
    return names.select("page_id", X.clean_bar_name(F.col("raw")).alias("name")).filter(F.col("name").isNotNull())


@query(
    "player_urls",
    "I7",
    "SELECT p_partkey, 'https://example.org/players/' || split_part(p_name, ' ', 2)[1] || '/' || p_partkey || '.htm' AS url FROM part",
)
def _(t):
    return t.part.select("p_partkey", X.player_url("https://example.org/players/", F.col("p_name"), F.col("p_partkey").cast("string")).alias("url"))


@query(
    "format_lines",
    "I8",
    """SELECT event_id, '<b>' || ltrim(strftime(ts, '%I'), '0') || ':00 ' || strftime(ts, '%p') || ':</b> '
       || round_even(value, 0)::BIGINT || 'F with wind at ' || (props->>'$.k') || ' mph and ' || lower(event_type) AS line FROM events""",
)
def _(t):
    wind = F.get_json_object("props", "$.k").cast("double")
    return t.events.select("event_id", X.fmt_line(F.hour("ts"), F.col("value"), wind, F.col("event_type")).alias("line"))


@query(
    "unit_text",
    "I9",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN l_quantity * 10 ELSE round(l_quantity / 10, 1) * 5280 END AS feet FROM lineitem""",
)
def _(t):
    feet = F.concat((F.col("l_quantity") * 10).cast("int").cast("string"), F.lit(" ft"))
    miles = F.concat(F.round(F.col("l_quantity") / 10, 1).cast("string"), F.lit(" mi"))
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", X.to_feet(F.when(F.col("l_quantity") < 10, feet).otherwise(miles)).alias("feet")
    )


@query(
    "dates",
    "I10 I11 I12",
    """SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS year_start, strftime(o_orderdate, '%Y-%m-%d') AS day_text,
       hour((o_orderdate + INTERVAL 7 HOUR) AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::INT AS local_hour,
       len(list_filter(range(o_orderdate::DATE, o_orderdate::DATE + INTERVAL 31 DAY, INTERVAL 1 DAY), lambda d: isodow(d) = 5))::INT AS fridays
       FROM orders""",
)
def _(t):
    day = F.col("o_orderdate").cast("date")
    epoch = F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + 7 * 3600
    return t.orders.select(
        "o_orderkey",
        S.year_date(F.year("o_orderdate")).alias("year_start"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"),
        S.local_hour(epoch, "America/Los_Angeles").alias("local_hour"),
        F.size(S.anchored_dates(day, F.date_add(day, 30), "W-FRI")).alias("fridays"),
    )


@query(
    "great_circle",
    "I14",
    """WITH p AS (SELECT vec_id, 45.5 + embedding[1]::DOUBLE AS lat, -122.6 + embedding[2]::DOUBLE AS lng FROM embeddings),
       h AS (SELECT vec_id, pow(sin((radians(lat) - radians(45.5)) / 2), 2)
             + cos(radians(45.5)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(-122.6)) / 2), 2) AS a FROM p)
       SELECT vec_id, round(2 * atan2(sqrt(a), sqrt(1 - a)) * 6378.145 * 3280.8, 3) AS feet FROM h""",
)
def _(t):
    lat, lng = F.col("embedding")[0].cast("double") + 45.5, F.col("embedding")[1].cast("double") - 122.6
    return t.embeddings.select("vec_id", F.round(S.earth_feet(F.lit(45.5), F.lit(-122.6), lat, lng), 3).alias("feet"))


@query(
    "plain_text",
    "W9",
    r"""WITH p AS (SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS plain FROM pages)
        SELECT page_id, length(plain)::INT AS n, md5(plain) AS digest, ceil(len(string_split(plain, ' ')) / 213)::INT AS minutes FROM p""",
)
def _(t):
    plain = t.pages.select("page_id", X.plain_text(F.col("html")).alias("plain"))
    return plain.select(
        "page_id", F.char_length("plain").alias("n"), F.md5("plain").alias("digest"), X.reading_minutes(F.col("plain")).alias("minutes")
    )


@query(
    "filters",
    "C1 C2",
    """SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
       WHERE year(o_orderdate) >= 1998 AND (o_totalprice > 100000 OR o_orderpriority = '5-LOW')
         AND lower(o_orderstatus) NOT IN ('p') AND o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def _(t):
    df = W.where(
        t.orders, F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"), (F.col("o_totalprice") > 100000) | (F.col("o_orderpriority") == "5-LOW")
    )
    df = W.only_values(W.exclude_values(df, "o_orderstatus", ["p"]), "o_orderpriority", ["1-URGENT", "5-LOW"])
    return df.select("o_orderkey", "o_orderstatus", "o_totalprice")


def hours(t):
    """Events as weather readings: value = temperature, k = wind, type = status."""
    return t.events.select(
        "event_id", F.hour("ts").alias("hour"), F.col("value").alias("temp"),
        F.get_json_object("props", "$.k").cast("double").alias("wind_speed"), F.col("event_type").alias("status"),
    )


@query(
    "match_rules",
    "C3",
    """WITH h AS (SELECT event_id, hour(ts) AS hour, value AS temp, (props->>'$.k')::DOUBLE AS wind, event_type FROM events)
       SELECT event_id, 'run' AS rule_set FROM h WHERE hour BETWEEN 13 AND 19 AND temp BETWEEN 30 AND 90 AND wind BETWEEN 0 AND 30 AND event_type NOT IN ('error', 'signup')
       UNION ALL SELECT event_id, 'walk' FROM h WHERE hour BETWEEN 6 AND 22 AND wind BETWEEN 0 AND 50""",
)
def _(t):
    run = W.Rules(W.RUNNING.ranges, {"status": ("error", "signup")})
    walk = W.Rules({"hour": (6, 22), "wind_speed": (0, 50)}, {})
    return W.match_rules(hours(t), {"run": run, "walk": walk}).select("event_id", "rule_set")


@query(
    "same_local_day",
    "C4 I11",
    """SELECT event_id, hour(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::INT AS local_hour FROM events
       WHERE (ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')::DATE = DATE '2024-01-15'""",
)
def _(t):
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    zone = "America/Los_Angeles"
    same = t.events.filter(S.same_local_day(epoch, zone, F.lit("2024-01-15").cast("date")))
    return same.select("event_id", S.local_hour(epoch, zone).alias("local_hour"))


@query(
    "mixed_case_only",
    "C5",
    r"""SELECT page_id, word FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href="/([^"]*)"', 1)) AS word FROM pages)
        WHERE word <> '' AND NOT (word = upper(word) AND regexp_matches(word, '\pL')) AND NOT (word = lower(word) AND regexp_matches(word, '\pL'))""",
)
def _(t):
    words = t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="/([^"]*)"'), F.lit(1))).alias("word"))
    return W.mixed_case_only(words, "word")


@query(
    "within_radius",
    "C10 I14",
    """WITH p AS (SELECT vec_id, 45.5 + embedding[1]::DOUBLE / 10 AS lat, -122.6 + embedding[2]::DOUBLE / 10 AS lng FROM embeddings),
       h AS (SELECT vec_id, pow(sin((radians(lat) - radians(45.5)) / 2), 2)
             + cos(radians(45.5)) * cos(radians(lat)) * pow(sin((radians(lng) - radians(-122.6)) / 2), 2) AS a FROM p),
       d AS (SELECT vec_id, 2 * atan2(sqrt(a), sqrt(1 - a)) * 6378.145 * 3280.8 AS feet FROM h)
       SELECT vec_id, round(feet, 3) AS feet FROM d WHERE d.feet <= 5280 * 3""",
)
def _(t):
    points = t.embeddings.select(
        "vec_id", (F.col("embedding")[0] / F.lit(10.0) + 45.5).alias("lat"), (F.col("embedding")[1] / F.lit(10.0) - 122.6).alias("lng")
    )
    near = W.within_radius(points, "lat", "lng", 45.5, -122.6, 5280 * 3)
    return near.select("vec_id", F.round("distance_feet", 3).alias("feet"))


@query(
    "keep_groups_having",
    "C8",
    """SELECT l_suppkey, sum(l_quantity)::DOUBLE AS qty FROM lineitem GROUP BY l_suppkey
       HAVING count(DISTINCT year(l_shipdate)) >= 2 AND count(*) >= 590 AND min(year(l_shipdate)) // 10 * 10 >= 1990""",
)
def _(t):
    kept = W.keep_groups_having(
        t.lineitem.withColumn("year", F.year("l_shipdate")),
        ["l_suppkey"],
        (F.col("seasons") >= 2) & (F.col("attempts") >= 590) & (S.floor_to(F.col("first_year"), 10) >= 1990),
        seasons=F.countDistinct("year"), attempts=F.count(F.lit(1)), first_year=F.min("year"),
    )
    return kept.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("qty"))


@query(
    "keep_groups_min_obs",
    "C6 K1",
    """SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN
       (SELECT o_custkey FROM orders GROUP BY 1 HAVING count(CASE WHEN o_orderstatus <> 'P' THEN 1 END) > 10)""",
)
def _(t):
    df = t.orders.select("o_custkey", "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("y"))
    return W.keep_groups_min_obs(df, ["o_custkey"], "y", 10).select("o_custkey", "o_orderkey")


@query(
    "keep_groups_total",
    "C9",
    "SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM orders GROUP BY 1 HAVING sum(o_totalprice) >= 3000000)",
)
def _(t):
    return W.keep_groups_total(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_totalprice", 3000000).select(
        "o_custkey", "o_orderkey"
    )
