"""Queries for series preparation and forecasting."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions.scalar import snap_to
from larkspan.operators import forecast as P
from larkspan.operators import series as K
from larkspan.operators.clean import run_date, to_model_frame
from larkspan.plans.registry import query

SPEC = K.SeriesSpec(("n_name", "c_mktsegment"), "day", "sales")


def weekly_sales(t):
    """Order value in whole dollars per nation, segment and week ending on Friday; weeks without orders are absent."""
    customers = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment").join(
        t.nation.select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    orders = t.orders.select("o_custkey", "o_orderdate", "o_totalprice").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return K.to_series(orders, SPEC, F.round("o_totalprice"), snap_to(F.col("o_orderdate"), SPEC.freq))


WEEKLY = """
WITH series AS (
  SELECT n_name, c_mktsegment, d + ((12 - isodow(d)) % 7)::INT AS day, sum(round(o_totalprice)) AS sales
  FROM (SELECT n_name, c_mktsegment, o_orderdate::DATE AS d, o_totalprice FROM orders
        JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
  GROUP BY ALL
), padded AS (
  SELECT n_name, c_mktsegment, day, sales FROM (
    SELECT n_name, c_mktsegment, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS day FROM series GROUP BY n_name, c_mktsegment
  ) LEFT JOIN series USING (n_name, c_mktsegment, day)
), counted AS (
  SELECT *, sum((sales IS NULL)::INT) OVER w AS missing FROM padded WINDOW w AS (PARTITION BY n_name, c_mktsegment ORDER BY day)
), streaks AS (
  SELECT n_name, c_mktsegment, day, sales,
         (missing - coalesce(last_value(CASE WHEN sales IS NOT NULL THEN missing END IGNORE NULLS) OVER w, 0))::BIGINT AS streak
  FROM counted WINDOW w AS (PARTITION BY n_name, c_mktsegment ORDER BY day)
), sided AS (
  SELECT *, last_value(sales IGNORE NULLS) OVER b AS va, last_value(CASE WHEN sales IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
         first_value(sales IGNORE NULLS) OVER a AS vb, first_value(CASE WHEN sales IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib
  FROM (SELECT *, row_number() OVER (PARTITION BY n_name, c_mktsegment ORDER BY day) AS i FROM streaks)
  WINDOW b AS (PARTITION BY n_name, c_mktsegment ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY n_name, c_mktsegment ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
), filled AS (
  SELECT n_name, c_mktsegment, day, streak, coalesce(sales, va + (vb - va) * (i - ia) / nullif(ib - ia, 0), va) AS sales FROM sided
)
"""
COLUMNS = "n_name, c_mktsegment, day, sales"


def shown(df, *extra):
    return df.select("n_name", "c_mktsegment", "day", "sales", *extra)


@query("weekly_sales", "K1 I12", WEEKLY + f"SELECT {COLUMNS} FROM series")
def _(t):
    return shown(weekly_sales(t))


@query("pad_weeks", "K3 D4 I12", WEEKLY + f"SELECT {COLUMNS} FROM padded")
def _(t):
    return shown(K.pad(weekly_sales(t), SPEC))


DAILY = """
WITH daily AS (SELECT o_orderpriority, o_orderdate::DATE AS day, sum(o_totalprice) AS sales FROM orders GROUP BY ALL),
ends AS (SELECT o_orderpriority, min(day) AS lo, max(day) AS hi FROM daily GROUP BY 1)
"""
DAILY_SPEC = K.SeriesSpec(("o_orderpriority",), "day", "sales")


def daily_sales(t):
    return K.to_series(t.orders, DAILY_SPEC, F.col("o_totalprice"), F.to_date("o_orderdate"))


@query(
    "pad_off_grid",
    "K3",
    DAILY
    + """SELECT o_orderpriority, day, round(sales, 4) AS sales FROM (
         SELECT o_orderpriority, unnest(generate_series((lo + ((12 - isodow(lo)) % 7)::INT)::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY))::DATE AS day FROM ends)
         LEFT JOIN daily USING (o_orderpriority, day)""",
)
def _(t):
    return K.pad(daily_sales(t), DAILY_SPEC).withColumn("sales", F.round("sales", 4))


@query(
    "pad_snapped",
    "K3",
    DAILY
    + """, snapped AS (SELECT o_orderpriority, day + ((12 - isodow(day)) % 7)::INT AS day, sum(sales) AS sales FROM daily GROUP BY ALL),
        weeks AS (SELECT o_orderpriority, unnest(generate_series(min(day)::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 7 DAY))::DATE AS day FROM snapped GROUP BY o_orderpriority)
        SELECT o_orderpriority, day, round(sales, 4) AS sales FROM weeks LEFT JOIN snapped USING (o_orderpriority, day)""",
)
def _(t):
    return K.pad(daily_sales(t), DAILY_SPEC, off_grid="snap").withColumn("sales", F.round("sales", 4))


@query(
    "pad_steps",
    "K9",
    DAILY
    + """SELECT o_orderpriority, day, round(sales, 4) AS sales FROM (
         SELECT o_orderpriority, unnest(generate_series(lo::TIMESTAMP, hi::TIMESTAMP, INTERVAL 7 DAY))::DATE AS day FROM ends)
         LEFT JOIN daily USING (o_orderpriority, day)""",
)
def _(t):
    spec = K.SeriesSpec(("o_orderpriority",), "day", "sales", "7D")
    return K.pad(daily_sales(t), spec).withColumn("sales", F.round("sales", 4))


@query("missing_streaks", "F7", WEEKLY + f"SELECT {COLUMNS}, streak FROM streaks")
def _(t):
    return shown(K.with_streak(K.pad(weekly_sales(t), SPEC), SPEC), "streak")


@query(
    "filter_max_streak",
    "K4 C7 F7",
    WEEKLY + f"SELECT {COLUMNS} FROM streaks WHERE (n_name, c_mktsegment) IN (SELECT (n_name, c_mktsegment) FROM streaks GROUP BY n_name, c_mktsegment HAVING max(streak) <= 12)",
)
def _(t):
    return shown(K.filter_max_streak(K.pad(weekly_sales(t), SPEC), SPEC, 12))


@query("fill_linear", "K5 F11", WEEKLY + f"SELECT {COLUMNS} FROM filled")
def _(t):
    return shown(K.fill(K.pad(weekly_sales(t), SPEC), SPEC))


SHIFTED = """, shifted AS (
  SELECT n_name, c_mktsegment, day, i, lag(sales) OVER (PARTITION BY n_name, c_mktsegment ORDER BY day) AS sales FROM sided
), s2 AS (
  SELECT *, last_value(sales IGNORE NULLS) OVER b AS va, last_value(CASE WHEN sales IS NOT NULL THEN i END IGNORE NULLS) OVER b AS ia,
         first_value(sales IGNORE NULLS) OVER a AS vb, first_value(CASE WHEN sales IS NOT NULL THEN i END IGNORE NULLS) OVER a AS ib
  FROM shifted
  WINDOW b AS (PARTITION BY n_name, c_mktsegment ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         a AS (PARTITION BY n_name, c_mktsegment ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT n_name, c_mktsegment, day, coalesce(sales, va + (vb - va) * (i - ia) / nullif(ib - ia, 0), va, vb) AS sales FROM s2
"""


@query("fill_both", "K6", WEEKLY + SHIFTED)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy(*SPEC.keys).orderBy("day")
    late = K.pad(weekly_sales(t), SPEC).withColumn("sales", F.lag("sales").over(w))
    return shown(K.fill(late, SPEC, both=True))


@query(
    "fill_mean",
    "K5",
    WEEKLY + "SELECT n_name, c_mktsegment, day, coalesce(sales, avg(sales) OVER (PARTITION BY n_name, c_mktsegment)) AS sales FROM padded",
)
def _(t):
    return shown(K.fill(K.pad(weekly_sales(t), SPEC), SPEC, "mean"))


@query("fill_zero", "K6", WEEKLY + "SELECT n_name, c_mktsegment, day, coalesce(sales, 0) AS sales FROM padded")
def _(t):
    return shown(K.fill(K.pad(weekly_sales(t), SPEC), SPEC, "zero"))


@query(
    "series_bounds",
    "K7 E3",
    WEEKLY
    + f"""SELECT {COLUMNS}, 0.5 * min(series.sales) OVER w AS floor_value, 1.5 * max(series.sales) OVER w AS cap_value
          FROM series WINDOW w AS (PARTITION BY n_name, c_mktsegment)""",
)
def _(t):
    out = K.add_bounds(weekly_sales(t), SPEC, 0.5, 1.5)
    return shown(out, "floor_value", "cap_value")


# The narrower series groups keep some whole weeks empty at every scale of the tables.
CFG = {"min_obs": 13, "max_streak": 12, "floor": 0.5, "cap": 1.5}
PREPARED = """, kept AS (
  SELECT * FROM filled
  WHERE (n_name, c_mktsegment) IN (SELECT (n_name, c_mktsegment) FROM series GROUP BY n_name, c_mktsegment HAVING count(sales) > 13)
    AND (n_name, c_mktsegment) IN (SELECT (n_name, c_mktsegment) FROM streaks GROUP BY n_name, c_mktsegment HAVING max(streak) <= 12)
), bounded AS (
  SELECT n_name, c_mktsegment, day, sales, 0.5 * min(sales) OVER w AS floor_value, 1.5 * max(sales) OVER w AS cap_value
  FROM kept WINDOW w AS (PARTITION BY n_name, c_mktsegment)
)
"""


@query(
    "prepare_series",
    "K10 K1 K2 K3 K4 K5 K7 K8 Q6",
    WEEKLY
    + PREPARED
    + """SELECT n_name, c_mktsegment, day, round(ln(1 + sales), 9) AS sales_log1p, round(ln(1 + floor_value), 9) AS floor_value_log1p,
         round(ln(1 + cap_value), 9) AS cap_value_log1p FROM bounded""",
)
def _(t):
    out = K.prepare(weekly_sales(t), SPEC, **CFG)
    logs = ("sales_log1p", "floor_value_log1p", "cap_value_log1p")
    return out.select("n_name", "c_mktsegment", "day", *[F.round(c, 9).alias(c) for c in logs])


def model_frame(t):
    prepared = K.prepare(weekly_sales(t), SPEC, **CFG)
    return to_model_frame(prepared, SPEC.keys, "day", "sales_log1p")


@query("forecast_groups", "L1 Q1")
def _(t):
    return P.forecast_groups(model_frame(t), SPEC, horizon=13)


@query(
    "forecast_dates",
    "L1 L2",
    WEEKLY
    + PREPARED
    + """ SELECT n_name, c_mktsegment, (last + 7 * i::INT)::DATE AS ds, true AS ordered, true AS bounded
        FROM (SELECT n_name, c_mktsegment, max(day) AS last FROM bounded GROUP BY ALL), range(1, 14) r(i)""",
)
def _(t):
    # Keys, dates and bounds of the forecasts; the fit itself has no SQL form.
    frame = model_frame(t)
    limits = frame.groupBy(*SPEC.keys).agg(F.min("floor").alias("floor"), F.max("cap").alias("cap"))
    out = P.forecast_groups(frame, SPEC, horizon=13).join(limits, list(SPEC.keys))
    ordered = (F.col("yhat_lower") <= F.col("yhat")) & (F.col("yhat") <= F.col("yhat_upper"))
    return out.select(*SPEC.keys, "ds", ordered.alias("ordered"), ((F.col("floor") <= F.col("yhat_lower")) & (F.col("yhat_upper") <= F.col("cap"))).alias("bounded"))


@query("forecast_holidays", "L1 L2")
def _(t):
    return P.holiday_effects(model_frame(t), SPEC)


@query("forecast_bound", "K12 L1 B15 B17 G6")
def _(t):
    frame = model_frame(t)
    ahead = P.forecast_groups(frame, SPEC, horizon=13)
    return K.bind_forecast(frame, ahead, K.logged(SPEC), run_date("2001-08-01"))


@query(
    "bind_actuals",
    "K12 B15 G6",
    WEEKLY
    + PREPARED
    + """, past AS (SELECT n_name, c_mktsegment, day, round_even(floor(sales), 0) AS v FROM bounded),
        ahead AS (SELECT n_name, c_mktsegment, max(day) + 7 AS day, max(v) AS v FROM past GROUP BY ALL)
        SELECT n_name, c_mktsegment, day, v AS sales, NULL::DOUBLE AS sales_lb, NULL::DOUBLE AS sales_ub, 'actuals' AS part, NULL::DATE AS fcast_date FROM past
        UNION ALL SELECT n_name, c_mktsegment, day, v, v, v, 'forecast', DATE '2001-08-01' FROM ahead""",
)
def _(t):
    bounded = K.prepare(weekly_sales(t), SPEC, **CFG, log=False).withColumn("y", F.log1p(F.floor("sales").cast("double")))
    frame = bounded.select("n_name", "c_mktsegment", F.col("day").alias("ds"), "y")
    flat = frame.groupBy("n_name", "c_mktsegment").agg(F.date_add(F.max("ds"), 7).alias("ds"), F.max("y").alias("yhat"))
    ahead = flat.withColumns({"yhat_lower": F.col("yhat"), "yhat_upper": F.col("yhat")})
    return K.bind_forecast(frame, ahead, SPEC, run_date("2001-08-01"))


# The calendar of the years in orders, as b (holiday, d).
HOLIDAYS = """WITH y AS (SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders),
       d AS (SELECT y, unnest(generate_series(make_date(y, 1, 1)::TIMESTAMP, make_date(y, 12, 31)::TIMESTAMP, INTERVAL 1 DAY))::DATE AS d FROM y),
       k AS (SELECT d, month(d) AS m, day(d) AS dd, isodow(d) AS w FROM d),
       h AS (SELECT d, CASE
         WHEN m = 1 AND dd = 1 THEN 'New Year''s Day' WHEN m = 1 AND w = 1 AND dd BETWEEN 15 AND 21 THEN 'Martin Luther King Jr. Day'
         WHEN m = 2 AND w = 1 AND dd BETWEEN 15 AND 21 THEN 'Washington''s Birthday' WHEN m = 5 AND w = 1 AND dd >= 25 THEN 'Memorial Day'
         WHEN m = 6 AND dd = 19 AND year(d) >= 2021 THEN 'Juneteenth National Independence Day'
         WHEN m = 7 AND dd = 4 THEN 'Independence Day' WHEN m = 9 AND w = 1 AND dd <= 7 THEN 'Labor Day'
         WHEN m = 10 AND w = 1 AND dd BETWEEN 8 AND 14 THEN 'Columbus Day' WHEN m = 11 AND dd = 11 THEN 'Veterans Day'
         WHEN m = 11 AND w = 4 AND dd BETWEEN 22 AND 28 THEN 'Thanksgiving' WHEN m = 12 AND dd = 25 THEN 'Christmas Day' END AS holiday FROM k),
       b AS (SELECT holiday, d FROM h WHERE holiday IS NOT NULL
             UNION ALL SELECT holiday || ' (observed)', CASE isodow(d) WHEN 6 THEN d - 1 ELSE d + 1 END FROM h WHERE holiday IS NOT NULL AND isodow(d) >= 6)"""


@query(
    "us_holidays",
    "L2",
    HOLIDAYS
    + """
       SELECT holiday, d + o::INT AS ds, o::INT AS "offset" FROM b, range(-1, 2) AS r(o)""",
)
def _(t):
    return P.us_holidays(t.orders.select(F.year("o_orderdate").alias("y")), "y", (-1, 1))


@query(
    "holiday_sales",
    "L2",
    HOLIDAYS.replace("SELECT DISTINCT year(o_orderdate)::INT AS y FROM orders", "SELECT DISTINCT year(o_orderdate)::INT + unnest([0, 1]) AS y FROM orders")
    + """ SELECT (o_orderdate::DATE IN (SELECT d FROM b))::INT AS is_holiday, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1""",
)
def _(t):
    days = t.orders.select(F.to_date("o_orderdate").alias("ds"), "o_totalprice")
    marked = P.mark_holidays(days, "ds")
    return marked.groupBy("is_holiday").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(
    "yearly_series",
    "K11 H4 C9",
    """WITH y AS (SELECT l_partkey, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem WHERE year(l_shipdate) >= 1996 GROUP BY ALL),
       k AS (SELECT l_partkey FROM y GROUP BY 1 HAVING sum(n) >= 25)
       SELECT l_partkey, year, coalesce(n, 0) AS n FROM (SELECT k.l_partkey, v.year FROM k, (SELECT DISTINCT year FROM y) v) LEFT JOIN y USING (l_partkey, year)""",
)
def _(t):
    return yearly_lines(t)


def yearly_lines(t):
    lines = t.lineitem.select("l_partkey", F.year("l_shipdate").alias("year"), F.lit(1).alias("n"))
    return K.yearly_series(lines, ["l_partkey"], "year", "n", 1996, 25)


@query("smoothing_forecast", "L3 Q3")
def _(t):
    return P.ets_groups(yearly_lines(t), ["l_partkey"], "year", "n", h=10)


@query(
    "smoothing_steps",
    "L3 Q3",
    """WITH y AS (SELECT l_partkey FROM lineitem WHERE year(l_shipdate) >= 1996 GROUP BY 1 HAVING count(*) >= 25), last AS (SELECT max(year(l_shipdate)) AS last FROM lineitem)
       SELECT l_partkey, (last + step)::INT AS year, true AS bounded FROM y, last, range(1, 11) r(step)""",
)
def _(t):
    out = P.ets_groups(yearly_lines(t), ["l_partkey"], "year", "n", h=10)
    bounded = (F.col("lo") >= 0) & (F.col("lo") <= F.greatest("n", F.lit(0.0))) & (F.col("n") <= F.col("hi"))
    return out.select("l_partkey", "year", bounded.alias("bounded"))
