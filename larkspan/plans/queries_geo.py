"""Queries for distances and routes: the first two vector elements place a point, the label is its group."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import geo as P
from larkspan.plans.ordered import attach, with_lead, with_position
from larkspan.plans.registry import query

POINTS = """
WITH points AS (SELECT vec_id, label, 45.5 + embedding[1]::DOUBLE AS lat, -122.6 + embedding[2]::DOUBLE AS lng,
                       vec_id = min(vec_id) OVER (PARTITION BY label) AS depot FROM embeddings)
"""


def points(t):
    e = F.col("embedding")
    stops = t.embeddings.select("vec_id", "label", (e[0].cast("double") + 45.5).alias("lat"), (e[1].cast("double") - 122.6).alias("lng"))
    first = t.embeddings.groupBy("label").agg(F.min("vec_id").alias("_first"))
    return stops.join(first, "label").withColumn("depot", F.col("vec_id") == F.col("_first")).drop("_first")


@query(
    "near_pairs",
    "P1 D13",
    POINTS
    + """SELECT a.label, a.vec_id AS i, b.vec_id AS j, round(sqrt(pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2)), 9) AS dist FROM points a JOIN points b
         ON a.label = b.label AND a.vec_id < b.vec_id WHERE sqrt(pow(a.lat - b.lat, 2) + pow(a.lng - b.lng, 2)) <= 0.05""",
)
def _(t):
    return P.pair_dist(points(t), ["label"], "vec_id", "lat", "lng", 0.05).withColumn("dist", F.round("dist", 9))


def tours(t):
    return P.route_groups(points(t), ["label"], "vec_id", "lat", "lng", "depot")


@query("routes", "P2 P3")
def _(t):
    return P.rotate(tours(t), ["label"], "tour_pos", "depot").drop("tour_pos")


def tour_length(df, position):
    """Length of each label's closed tour."""
    begin = df.groupBy("label").agg(F.min_by("lat", position).alias("_lat"), F.min_by("lng", position).alias("_lng"))
    stops = attach(with_lead(df, ["label"], [F.col(position)], {"lat2": "lat", "lng2": "lng"}), begin, ["label"])
    leg = F.sqrt(F.pow(F.coalesce("lat2", "_lat") - F.col("lat"), 2) + F.pow(F.coalesce("lng2", "_lng") - F.col("lng"), 2))
    return stops.groupBy("label").agg(F.sum(leg).alias("length"))


@query(
    "route_facts",
    "P2 P3",
    POINTS
    + """SELECT label, count(DISTINCT vec_id) AS stops, (count(*) * (count(*) + 1) // 2)::BIGINT AS places, max(CASE WHEN depot THEN vec_id END) AS first_stop,
         true AS shorter FROM points GROUP BY label""",
)
def _(t):
    route = P.rotate(tours(t), ["label"], "tour_pos", "depot")
    at = F.col("route_order")
    facts = route.groupBy("label").agg(
        F.count_distinct("vec_id").alias("stops"), F.sum(at).alias("places"), F.max(F.when(at == 1, F.col("vec_id"))).alias("first_stop")
    )
    # The optimised tour is no longer than the one from west to east.
    both = tour_length(route, "route_order").join(tour_length(west_east(t), "pos").withColumnRenamed("length", "plain"), "label")
    return facts.join(both.select("label", (F.col("length") <= F.col("plain") * (1 + 1e-9)).alias("shorter")), "label")


TOUR = POINTS + """, tour AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY lng, vec_id) AS pos FROM points),
ordered AS (SELECT *, ((pos - max(CASE WHEN depot THEN pos END) OVER w + count(*) OVER w) % count(*) OVER w + 1)::BIGINT AS route_order FROM tour WINDOW w AS (PARTITION BY label))
"""


def west_east(t):
    """A simple tour by longitude; the depot sits anywhere in it."""
    return with_position(points(t), ["label"], [F.col("lng"), F.col("vec_id")], "pos", derived=True)


@query("rotated_tours", "P3", TOUR + "SELECT label, vec_id, route_order FROM ordered")
def _(t):
    return P.rotate(west_east(t), ["label"], "pos", "depot").select("label", "vec_id", "route_order")


@query(
    "route_legs",
    "P4 F8 D14",
    TOUR
    + """SELECT * FROM (SELECT label, route_order, lat AS start_lat, lng AS start_lng, lead(lat) OVER w AS end_lat, lead(lng) OVER w AS end_lng,
         vec_id || ' to ' || lead(vec_id) OVER w AS leg FROM ordered WINDOW w AS (PARTITION BY label ORDER BY route_order)) WHERE end_lat IS NOT NULL""",
)
def _(t):
    return P.legs(P.rotate(west_east(t), ["label"], "pos", "depot"), ["label"], "route_order", "lat", "lng", "vec_id")


@query(
    "route_totals",
    "P5 E8 I9",
    """WITH l AS (SELECT label, vec_id, (vec_id * 37 % 1800)::INT AS seconds FROM embeddings)
       SELECT label, round(sum(seconds) / 3600, 1) AS hours,
              round(sum(CASE WHEN seconds < 300 THEN seconds ELSE round(seconds / 600, 1) * 5280 END) / 5280, 1) AS miles FROM l GROUP BY 1""",
)
def _(t):
    legs = t.embeddings.select("label", "vec_id", (F.col("vec_id") * 37 % 1800).cast("int").alias("seconds"))
    s = F.col("seconds")
    length = F.when(s < 300, F.concat(s.cast("string"), F.lit(" ft"))).otherwise(F.concat(F.round(s / 600, 1).cast("string"), F.lit(" mi")))
    path = legs.withColumn("miles_text", length).withColumn("path_order", F.explode(F.sequence(F.lit(1), F.lit(3))))
    return P.route_totals(path, ["label"], "vec_id", "seconds", "miles_text")
