"""Queries for joins, aggregates, windows, set operations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions.text import label_from_name
from larkspan.operators import aggregates as A
from larkspan.operators import joins as J
from larkspan.operators import reshape as R
from larkspan.operators import sets as G
from larkspan.operators import windows as V
from larkspan.plans.queries_core import NAMES, name_counts
from larkspan.plans.registry import query

# ---------------------------------------------------------------- joins


@query(
    "natural_join",
    "D2 D1",
    "SELECT o_orderkey, l_linenumber, o_totalprice, l_quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
)
def _(t):
    orders = t.orders.select(F.col("o_orderkey").alias("orderkey"), "o_totalprice")
    lines = t.lineitem.select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_quantity")
    return J.natural_join(orders, lines).withColumnRenamed("orderkey", "o_orderkey")


@query("join_as", "D3", "SELECT c_custkey, c_nationkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def _(t):
    return J.join_as(t.customer.select("c_custkey", "c_nationkey"), t.nation.select("n_nationkey", "n_name"), {"c_nationkey": "n_nationkey"})


DAYS = """
WITH daily AS (SELECT o_orderpriority AS priority, o_orderdate::DATE AS day, sum(o_totalprice) AS total FROM orders GROUP BY ALL),
ends AS (SELECT priority, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1),
cal AS (SELECT priority, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 1 DAY))::DATE AS day FROM ends)
"""


@query("left_onto_calendar", "D4", DAYS + "SELECT priority, day, round(total, 2) AS total FROM cal LEFT JOIN daily USING (priority, day)")
def _(t):
    daily = t.orders.groupBy(F.col("o_orderpriority").alias("priority"), F.to_date("o_orderdate").alias("day")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    ends = daily.groupBy("priority").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    calendar = ends.select("priority", F.explode(F.sequence("lo", "hi")).alias("day"))
    return J.left_onto(calendar, daily, ["priority", "day"])


@query(
    "keep_keys",
    "D5 D6",
    """SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)""",
)
def _(t):
    big = t.orders.filter(F.col("o_totalprice") > 450000)
    return J.members_of(t.customer.select("c_custkey", "c_mktsegment"), big, "c_custkey", "o_custkey")


@query("dropped_keys", "D5", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(t):
    return J.dropped_keys(t.customer, t.orders.withColumnRenamed("o_custkey", "c_custkey"), ["c_custkey"])


@query(
    "lookup",
    "D7",
    "SELECT s_suppkey, s_nationkey, n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) ON s_nationkey = n_nationkey",
)
def _(t):
    dim = t.nation.filter(F.col("n_regionkey") != 3)
    return J.lookup(t.supplier.select("s_suppkey", "s_nationkey"), dim, "s_nationkey", "n_name", "n_nationkey")


@query(
    "with_total",
    "D8",
    "SELECT o_orderkey, round(o_totalprice / (SELECT sum(o_totalprice) FROM orders) * 1e6, 4) AS share FROM orders",
)
def _(t):
    df = J.with_total(t.orders.select("o_orderkey", "o_totalprice"), "o_totalprice")
    return df.select("o_orderkey", F.round(F.col("o_totalprice") / F.col("total") * 1e6, 4).alias("share"))


@query(
    "expand_grid",
    "D9",
    "SELECT n_name, p_brand, year FROM nation, (SELECT DISTINCT p_brand FROM part), (SELECT DISTINCT year(o_orderdate)::INT AS year FROM orders)",
)
def _(t):
    years = t.orders.select(F.year("o_orderdate").alias("year")).distinct()
    return J.expand_grid(J.expand_grid(t.nation.select("n_name"), t.part.select("p_brand").distinct()), years)


@query(
    "successors",
    "D14 F8",
    """SELECT * FROM (SELECT l_orderkey, l_linenumber, l_shipdate, lead(l_shipdate) OVER w AS next_ship, lead(l_quantity) OVER w AS next_qty
       FROM (SELECT l_orderkey, l_linenumber, min(l_shipdate) AS l_shipdate, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)
       WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber)) WHERE next_qty IS NOT NULL""",
)
def _(t):
    lines = t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_shipdate").alias("l_shipdate"), F.max("l_quantity").alias("l_quantity"))
    out = J.with_next(lines, ["l_orderkey"], [F.col("l_shipdate"), F.col("l_linenumber")], {"next_ship": "l_shipdate", "next_qty": "l_quantity"}, derived=True)
    return out.drop("l_quantity")


# ---------------------------------------------------------------- aggregates


@query(
    "summarise",
    "E1",
    """SELECT l_returnflag, l_linestatus, sum(l_quantity)::DOUBLE AS qty, count(*) AS n, min(l_shipdate) AS first, max(l_shipdate) AS last,
       round(avg(l_extendedprice), 4) AS mean_price FROM lineitem GROUP BY ALL""",
)
def _(t):
    return A.summarise(
        t.lineitem, ["l_returnflag", "l_linestatus"], qty=F.sum("l_quantity"), n=F.count(F.lit(1)), first=F.min("l_shipdate"),
        last=F.max("l_shipdate"), mean_price=F.round(F.avg("l_extendedprice"), 4),
    )


@query(
    "rate",
    "E2",
    "SELECT l_suppkey, sum((l_returnflag = 'R')::INT)::BIGINT AS made, count(*) AS attempted, round(sum((l_returnflag = 'R')::INT) / count(*), 9) AS rate FROM lineitem GROUP BY ALL",
)
def _(t):
    lines = t.lineitem.select("l_suppkey", (F.col("l_returnflag") == "R").cast("int").alias("made"), F.lit(1).alias("attempted"))
    return A.rate(lines, ["l_suppkey"], "made", "attempted").withColumn("rate", F.round("rate", 9))


@query(
    "group_bounds",
    "E3",
    """SELECT o_orderkey, 0.5 * min(o_totalprice) OVER w AS floor_value, 1.5 * max(o_totalprice) OVER w AS cap_value
       FROM orders WINDOW w AS (PARTITION BY o_orderpriority)""",
)
def _(t):
    df = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return A.group_bounds(df, ["o_orderpriority"], "o_totalprice", 0.5, 1.5).select("o_orderkey", "floor_value", "cap_value")


@query("count_groups", "E4", "SELECT count(*) AS n_groups FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem)")
def _(t):
    return A.count_groups(t.lineitem, ["l_suppkey", "l_returnflag"])


@query("distinct_keys", "E4", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def _(t):
    return A.distinct_keys(t.lineitem, ["l_partkey", "l_suppkey"])


@query("count_by", "E5", "SELECT p_type, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_type")
def _(t):
    return A.count_by(t.part, "p_type")


@query(
    "quantiles",
    "E6",
    """SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.025), 6) AS lb, round(quantile_cont(l_extendedprice, 0.5), 6) AS mdn,
       round(quantile_cont(l_extendedprice, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""",
)
def _(t):
    q = A.quantiles(t.lineitem, ["l_returnflag"], "l_extendedprice", {"lb": 0.025, "mdn": 0.5, "p99": 0.99})
    return q.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("lb", "mdn", "p99")])


@query(
    "five_num",
    "E16",
    """SELECT o_orderpriority, min(o_totalprice) AS low, round(quantile_cont(o_totalprice, 0.25), 6) AS q1, round(quantile_cont(o_totalprice, 0.5), 6) AS median,
       round(quantile_cont(o_totalprice, 0.75), 6) AS q3, max(o_totalprice) AS high FROM orders GROUP BY 1""",
)
def _(t):
    f = A.five_num(t.orders, ["o_orderpriority"], "o_totalprice")
    return f.select("o_orderpriority", "low", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "high")


@query(
    "sum_distinct",
    "E8",
    "SELECT l_suppkey, sum(l_extendedprice)::DOUBLE AS total FROM (SELECT DISTINCT l_suppkey, l_orderkey, round(l_extendedprice) AS l_extendedprice FROM lineitem) GROUP BY 1",
)
def _(t):
    lines = t.lineitem.select("l_suppkey", "l_orderkey", F.round("l_extendedprice").alias("l_extendedprice"))
    return A.sum_distinct(lines, ["l_orderkey"], "l_extendedprice", ["l_suppkey"])


@query(
    "weighted_points",
    "E9",
    """SELECT l_suppkey, round(sum(3 * (l_returnflag = 'A')::INT + 4 * (l_returnflag = 'N')::INT + 5 * (l_returnflag = 'R')::INT) / count(*), 1) AS points
       FROM lineitem GROUP BY 1""",
)
def _(t):
    flags = t.lineitem.select("l_suppkey", *[(F.col("l_returnflag") == f).cast("int").alias(f) for f in "ANR"], F.lit(1).alias("made"))
    return A.weighted_points(flags, ["l_suppkey"], {"A": 3, "N": 4, "R": 5}, "made")


@query(
    "mean_ci",
    "E10",
    """SELECT l_returnflag, round(avg(l_quantity), 9) AS mean, count(*) AS n, round(avg(l_quantity) - 1.96 * sqrt(avg(l_quantity) / count(*)), 9) AS lower,
       round(avg(l_quantity) + 1.96 * sqrt(avg(l_quantity) / count(*)), 9) AS upper FROM lineitem GROUP BY 1""",
)
def _(t):
    ci = A.mean_ci(t.lineitem, ["l_returnflag"], "l_quantity")
    return ci.select("l_returnflag", "n", *[F.round(c, 9).alias(c) for c in ("mean", "lower", "upper")])


@query(
    "step_audit",
    "E11",
    """SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 5""",
)
def _(t):
    watched, _watch = A.observed(t.orders, "orders read", rows=F.count(F.lit(1)), no_price=F.count_if(F.col("o_totalprice").isNull()))
    return watched.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 5)


@query(
    "step_counts",
    "E11",
    """WITH kept AS (SELECT * FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 5)
       SELECT 'orders read' AS step, count(*) AS n_rows, count(DISTINCT o_custkey) AS n_groups, count(*) - count(o_totalprice) AS n_null FROM orders
       UNION ALL SELECT 'customers with over 5', count(*), count(DISTINCT o_custkey), count(*) - count(o_totalprice) FROM kept""",
)
def _(t):
    orders = t.orders.select("o_custkey", "o_totalprice")
    often = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 5)
    kept = orders.join(often, "o_custkey", "left_semi")
    return A.step_counts(
        {"orders read": orders, "customers with over 5": kept},
        n_rows=F.count(F.lit(1)), n_groups=F.count_distinct("o_custkey"), n_null=F.count_if(F.col("o_totalprice").isNull()),
    )


@query(
    "lump",
    "E12",
    """WITH top AS (SELECT p_size FROM part GROUP BY 1 ORDER BY count(*) DESC, p_size LIMIT 2)
       SELECT CASE WHEN p_size IN (SELECT p_size FROM top) THEN p_size::VARCHAR ELSE 'Other Size' END AS size_group, count(*) AS n FROM part GROUP BY 1""",
)
def _(t):
    return A.lump(t.part, "p_size", 2, "Other Size", "size_group").groupBy("size_group").agg(F.count(F.lit(1)).alias("n"))


@query("mean_param", "E14", "SELECT round_even(avg(l_quantity), 0) AS mean FROM lineitem")
def _(t):
    return A.mean_param(t.lineitem, "l_quantity")


@query(
    "histogram",
    "E15",
    """WITH e AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
       b AS (SELECT least(floor((value - lo) / (hi - lo) * 30), 29)::INT AS bin, count(*) AS n FROM events, e GROUP BY 1)
       SELECT i::INT AS bin, round(lo + i * ((hi - lo) / 30), 6) AS "left", round(lo + (i + 1) * ((hi - lo) / 30), 6) AS "right", coalesce(n, 0) AS n
       FROM range(30) AS r(i) CROSS JOIN e LEFT JOIN b ON bin = i""",
)
def _(t):
    h = A.histogram(t.events, "value", 30)
    return h.select("bin", F.round("left", 6).alias("left"), F.round("right", 6).alias("right"), "n")


# ---------------------------------------------------------------- windows


@query("top_n_ties", "F1", "SELECT p_partkey, p_brand, p_size FROM part QUALIFY rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) <= 3")
def _(t):
    return V.top_n(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], 3, "p_size")


@query(
    "first_n",
    "F10",
    "SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 5",
)
def _(t):
    lines = t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return V.first_n(lines, ["l_suppkey"], [F.desc("l_extendedprice"), F.col("l_orderkey"), F.col("l_linenumber")], 5)


@query(
    "row_index",
    "F2",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey)::INT AS row_index FROM orders",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_totalprice")
    return V.row_index(orders, ["o_orderpriority"], [-F.col("o_totalprice"), F.col("o_orderkey")]).select("o_orderkey", F.col("row_index").cast("int").alias("row_index"))


@query(
    "cum_share",
    "F3 F2",
    NAMES
    + """SELECT state, name, n, row_number() OVER w::INT AS row_index, sum(n) OVER w::BIGINT AS cum_sum,
         round(sum(n) OVER w / sum(n) OVER (PARTITION BY state), 9) AS cum_share
         FROM counts WINDOW w AS (PARTITION BY state ORDER BY n DESC, name ROWS UNBOUNDED PRECEDING)""",
)
def _(t):
    counts = name_counts(t).groupBy("state", "name").agg(F.sum("frequency").alias("n"))
    out = V.cum_share(counts, ["state"], [-F.col("n"), F.col("name")], "n", derived=True)
    return out.select("state", "name", "n", F.col("row_index").cast("int").alias("row_index"), "cum_sum", F.round("cum_share", 9).alias("cum_share"))


@query(
    "topk_share",
    "F4",
    NAMES
    + """SELECT state, round(sum(n) / any_value(total), 9) AS cum_share FROM
         (SELECT state, n, sum(n) OVER (PARTITION BY state) AS total, row_number() OVER (PARTITION BY state ORDER BY n DESC, name) AS i FROM counts)
         WHERE i <= 20 GROUP BY 1 HAVING count(*) = 20""",
)
def _(t):
    counts = name_counts(t).groupBy("state", "name").agg(F.sum("frequency").alias("n"))
    out = V.topk_share(counts, ["state"], [F.desc("n"), F.col("name")], "n", 20)
    return out.select("state", F.round("cum_share", 9).alias("cum_share"))


@query("ntile", "F5", "SELECT o_orderkey, ntile(3) OVER (ORDER BY o_totalprice, o_orderkey)::INT AS tile FROM orders")
def _(t):
    return V.with_ntile(t.orders.select("o_orderkey", "o_totalprice"), [F.col("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


WEEKS = """
WITH e AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, (value >= 30)::INT AS success FROM events),
cal AS (SELECT user_id, week FROM (SELECT DISTINCT user_id FROM e), (SELECT DISTINCT week FROM e)),
g AS (SELECT user_id, week, coalesce(s, 0) AS s, coalesce(f, 0) AS f FROM cal
      LEFT JOIN (SELECT user_id, week, sum(success) AS s, sum(1 - success) AS f FROM e GROUP BY ALL) USING (user_id, week))
"""


def weekly_success(t):
    """Events as attempts: value of 30 or more is a success, weeks start on Monday."""
    return t.events.select(
        "user_id", F.to_date(F.date_trunc("week", "ts")).alias("week"), (F.col("value") >= 30).cast("int").alias("success")
    )


def player_weeks(events):
    return J.expand_grid(events.select("week").distinct(), events.select("user_id").distinct()).select("user_id", "week")


@query(
    "running_counts",
    "F6",
    WEEKS
    + """SELECT user_id, week, sum(s) OVER w::BIGINT AS made, sum(f) OVER w::BIGINT AS missed
         FROM g WINDOW w AS (PARTITION BY user_id ORDER BY week)""",
)
def _(t):
    events = weekly_success(t).withColumn("miss", 1 - F.col("success"))
    return V.running_counts(player_weeks(events), events, ["user_id"], "week", {"made": "success", "missed": "miss"})


@query(
    "lead_columns",
    "F8",
    """SELECT event_id, lead(ts) OVER w AS next_ts, lead(event_type) OVER w AS next_type FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
)
def _(t):
    rows = t.events.select("event_id", "user_id", "ts", "event_type")
    out = V.lead_cols(rows, ["user_id"], [F.col("ts"), F.col("event_id")], {"next_ts": "ts", "next_type": "event_type"})
    return out.select("event_id", "next_ts", "next_type")


@query("group_mean", "F9", "SELECT event_id, round(avg(value) OVER (PARTITION BY event_type), 9) AS group_mean FROM events")
def _(t):
    rows = V.group_mean(t.events.select("event_id", "event_type", "value"), ["event_type"], "value")
    return rows.select("event_id", F.round("group_mean", 9).alias("group_mean"))


@query(
    "average_rank",
    "F12",
    """SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2 AS rank FROM part""",
)
def _(t):
    return V.avg_rank(t.part.select("p_partkey", "p_brand", "p_size"), ["p_brand"], "p_size").select("p_partkey", "rank")


# ---------------------------------------------------------------- sets


@query("sorted_rows", "G1", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _(t):
    return G.sort(t.customer.select("c_mktsegment", "c_acctbal", "c_custkey"), "c_mktsegment", F.desc("c_acctbal"), "c_custkey")


@query("top_k", "G2", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 25")
def _(t):
    return G.top_k(A.summarise(t.lineitem, ["l_partkey"], n=F.count(F.lit(1))), [F.desc("n"), F.col("l_partkey")], 25)


@query("argmin", "G3", "SELECT l_suppkey, sum(l_quantity)::DOUBLE AS qty FROM lineitem GROUP BY 1 ORDER BY qty, l_suppkey LIMIT 1")
def _(t):
    return G.argmin(A.summarise(t.lineitem, ["l_suppkey"], qty=F.sum("l_quantity")), "qty", ["l_suppkey"])


@query("paging", "G4", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 10 OFFSET 20")
def _(t):
    return G.page(t.orders.select("o_orderkey", "o_orderdate"), [F.desc("o_orderdate"), F.col("o_orderkey")], 20, 10)


@query("sample_rows", "G5", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5(o_orderkey || ':1'), o_orderkey LIMIT 24")
def _(t):
    return G.sample_k(t.orders.select("o_orderkey", "o_totalprice"), ["o_orderkey"], 24, 1)


@query(
    "sample_groups",
    "G5",
    "SELECT l_suppkey, l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey IN (SELECT s FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem) ORDER BY md5(s || ':7'), s LIMIT 6)",
)
def _(t):
    return G.sample_keys(t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber"), ["l_suppkey"], 6, 7)


@query(
    "stack_rows",
    "G6",
    """SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS acctbal FROM customer
       UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier""",
)
def _(t):
    a = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("acctbal"))
    return G.stack(a, b)


@query(
    "page_sets",
    "G7 G8",
    """SELECT doc_id, 'union' AS part FROM documents WHERE lang = 'fr' OR source = 'src1'
       UNION ALL SELECT doc_id, 'both' FROM documents WHERE lang = 'fr' AND source = 'src1'
       UNION ALL SELECT doc_id, 'only' FROM documents WHERE lang = 'fr' AND source <> 'src1'""",
)
def _(t):
    docs = t.documents.select("doc_id", "lang", "source")
    a, b = docs.filter(F.col("lang") == "fr"), docs.filter(F.col("source") == "src1")
    named = {"union": G.union_rows(a, b, ["doc_id"]), "both": G.intersect_rows(a, b, ["doc_id"]), "only": G.difference(a, b, ["doc_id"])}
    return G.stack(*[df.select("doc_id", F.lit(name).alias("part")) for name, df in named.items()])


# ---------------------------------------------------------------- reshape


@query(
    "to_long",
    "H1 H6",
    """SELECT l_suppkey, CASE name WHEN 'made_20_29_yards' THEN '20-29' WHEN 'made_50_yards' THEN '50+' END AS label, value FROM (
       SELECT l_suppkey, count(CASE WHEN l_quantity < 25 THEN 1 END) AS made_20_29_yards, count(CASE WHEN l_quantity >= 25 THEN 1 END) AS made_50_yards
       FROM lineitem GROUP BY 1) UNPIVOT (value FOR name IN (made_20_29_yards, made_50_yards))""",
)
def _(t):
    wide = t.lineitem.groupBy("l_suppkey").agg(
        F.count_if(F.col("l_quantity") < 25).alias("made_20_29_yards"), F.count_if(F.col("l_quantity") >= 25).alias("made_50_yards")
    )
    long = R.to_long(wide, ["l_suppkey"], ["made_20_29_yards", "made_50_yards"])
    return long.select("l_suppkey", label_from_name(F.col("name")).alias("label"), "value")


@query(
    "to_wide",
    "H2",
    """SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS A, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS N,
       sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS R FROM lineitem GROUP BY 1""",
)
def _(t):
    return R.to_wide(t.lineitem, ["l_suppkey"], "l_returnflag", "l_quantity", ["A", "N", "R"], F.sum)


@query("split_rows", "H3", "SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def _(t):
    return R.split_rows(t.part.select("p_partkey", F.col("p_name").alias("word")), "word", " ")


@query(
    "complete",
    "H4 D9",
    NAMES + "SELECT state, name, coalesce(n, 0) AS n FROM (SELECT DISTINCT state FROM counts), (SELECT DISTINCT name FROM counts) LEFT JOIN counts USING (state, name)".replace(
        "(SELECT DISTINCT state FROM counts), (SELECT DISTINCT name FROM counts)",
        "(SELECT s.state, m.name FROM (SELECT DISTINCT state FROM counts) s, (SELECT DISTINCT name FROM counts) m)",
    ),
)
def _(t):
    counts = name_counts(t).groupBy("state", "name").agg(F.sum("frequency").alias("n"))
    return R.complete(counts, ["state"], ["name"], {"n": 0})


@query(
    "nest_rows",
    "H5",
    "SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY ALL",
)
def _(t):
    yearly = t.orders.groupBy("o_custkey", F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    return R.unnest(R.nest(yearly, ["o_custkey"], ["year"]), "rows")


@query("map_groups", "H5 Q1", "SELECT p_brand, p_size, n, round(n / sum(n) OVER (PARTITION BY p_brand), 9) AS share FROM (SELECT p_brand, p_size, count(*) AS n FROM part GROUP BY ALL)")
def _(t):
    counts = A.summarise(t.part, ["p_brand", "p_size"], n=F.count(F.lit(1)))

    def share(_, pdf):
        return pdf.assign(share=(pdf["n"] / pdf["n"].sum()).round(9))

    return R.map_groups(counts, ["p_brand"], share, "p_brand string, p_size int, n bigint, share double")
