"""Queries that run a stream over everything that has arrived and read its sink back."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from larkspan.plans.registry import query
from larkspan.streaming import alerts as ST
from larkspan.streaming.weekly import POSTERIOR, weekly_posteriors

HOURLY = """
WITH hours AS (SELECT ts::DATE AS day, hour(ts)::INT AS hour, max(value) AS temp, min((props->>'$.k')::DOUBLE) AS wind_speed, min(event_type) AS status FROM events GROUP BY ALL),
lines AS (SELECT day, hour, '<b>' || ((hour + 11) % 12 + 1) || CASE WHEN hour < 12 THEN ':00 AM' ELSE ':00 PM' END || ':</b> ' || round_even(temp, 0)::BIGINT || 'F with wind at '
          || round_even(wind_speed, 0)::BIGINT || ' mph and ' || lower(status) AS line FROM hours
          WHERE hour BETWEEN 13 AND 19 AND temp BETWEEN 30 AND 90 AND wind_speed BETWEEN 0 AND 30 AND status NOT IN ('Rain', 'Snow', 'Smoke'))
SELECT day, '<p>' || coalesce(string_agg(line, '<br/>' ORDER BY lines.hour), 'No Times to Run Today!') || '</p>' AS message
FROM (SELECT DISTINCT day FROM hours) LEFT JOIN lines USING (day) GROUP BY day
"""


def hourly(t):
    """One reading per day and hour."""
    return t.events.groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(
        F.max("value").alias("temp"), F.min(F.get_json_object("props", "$.k").cast("double")).alias("wind_speed"), F.min("event_type").alias("status")
    )


@query("daily_messages", "E13 C3 I8", HOURLY)
def _(t):
    return ST.daily_message(hourly(t), ["day"])


@query("alert_stream", "ST1 ST2 ST3 A5", HOURLY)
def _(t):
    arrived, sink = t.scratch("readings"), t.scratch("messages")
    # A day's readings arrive in three files, of which a batch takes one.
    hourly(t).repartition(3, F.col("hour") % 3).write.json(arrived)
    schema = "day date, hour int, temp double, wind_speed double, status string"
    ST.run_available(ST.alert_stream(ST.stream_json(t.spark, arrived, schema, files_per_trigger=1), ["day"], sink), t.scratch("state"))
    return t.spark.read.schema("message string, day date").json(sink).select("day", "message")


@query("arriving_events", "ST1 ST2", "SELECT event_id, ts, user_id, event_type, value FROM events")
def _(t):
    sink = t.scratch("arrived")
    stream = ST.stream_parquet(t.spark, t.folder, t.events.schema, "events.parquet")
    rows = stream.select("event_id", "ts", "user_id", "event_type", "value")
    ST.run_available(rows.writeStream.format("parquet").option("path", sink), t.scratch("state"))
    return t.spark.read.schema(rows.schema).parquet(sink)


@query(
    "posterior_stream",
    "ST4 L14",
    """SELECT user_id, sum((value >= 30)::INT)::BIGINT AS successes, sum((value < 30)::INT)::BIGINT AS failures, 1 + sum((value >= 30)::INT)::BIGINT AS alpha,
       1 + sum((value < 30)::INT)::BIGINT AS beta, (1 + sum((value >= 30)::INT)) / (2 + count(*)) AS mean FROM events GROUP BY 1""",
)
def _(t):
    sink = t.scratch("posterior")
    stream = ST.stream_parquet(t.spark, t.folder, t.events.schema, "events.parquet")
    flagged = stream.select("user_id", (F.col("value") >= 30).alias("success"))
    state = ST.beta_stream(flagged, ["user_id"], "success")
    ST.run_available(ST.keep_updates(state, sink), t.scratch("state"))
    updates = t.spark.read.schema("user_id bigint, successes bigint, failures bigint, alpha bigint, beta bigint, mean double, epoch int").parquet(sink)
    return ST.latest_state(updates, ["user_id"])


@query(
    "posterior_week_stream",
    "ST4 L15 L14",
    """WITH e AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, (value >= 30)::INT AS success FROM events),
       u AS (SELECT user_id, greatest(sum(success) FILTER (week < DATE '2024-01-08'), 1) AS a0, greatest(sum(1 - success) FILTER (week < DATE '2024-01-08'), 1) AS b0 FROM e GROUP BY 1),
       w AS (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', (SELECT max(ts) FROM events) - INTERVAL 8 DAY, INTERVAL 7 DAY))::DATE AS week),
       c AS (SELECT user_id, week, sum(success) AS s, sum(1 - success) AS f FROM e GROUP BY ALL),
       r AS (SELECT user_id, week, a0, b0, sum(coalesce(s, 0)) OVER o AS s, sum(coalesce(f, 0)) OVER o AS f FROM u CROSS JOIN w LEFT JOIN c USING (user_id, week)
             WINDOW o AS (PARTITION BY user_id ORDER BY week))
       SELECT user_id, week, s::BIGINT AS successes, f::BIGINT AS failures, (a0 + s)::BIGINT AS alpha, (b0 + f)::BIGINT AS beta,
              round((a0 + s) / (a0 + s + b0 + f), 9) AS mean FROM r""",
)
def _(t):
    arrived, sink, state = t.scratch("events"), t.scratch("weeks"), t.scratch("state")
    events = t.events.select("user_id", "ts", (F.col("value") >= 30).alias("success"))
    # Two arrivals, with a restart of the stream between them.
    middle = events.agg(F.expr("min(ts) + (max(ts) - min(ts)) / 2")).scalar()
    for part in (F.col("ts") < middle, F.col("ts") >= middle):
        events.filter(part).write.mode("append").parquet(arrived)
        weeks = weekly_posteriors(ST.stream_parquet(t.spark, arrived, events.schema), ["user_id"], "ts", "success", date(2024, 1, 8))
        ST.run_available(ST.keep_updates(weeks, sink), state)
    return t.spark.read.schema(f"user_id bigint, {POSTERIOR}").parquet(sink).drop("epoch").withColumn("mean", F.round("mean", 9))
