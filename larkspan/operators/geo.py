"""Distances and routes for many groups at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.scalar import earth_feet
from larkspan.functions.text import FEET_PER_MILE, to_feet
from larkspan.plans.ordered import attach, spread, with_lead, with_position
from larkspan.session import checkpoint


def distance(metric: str, lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """``degrees``: Euclidean on the coordinates; ``feet``: great circle."""
    if metric == "degrees":
        return F.sqrt(F.pow(lat1 - lat2, F.lit(2)) + F.pow(lng1 - lng2, F.lit(2)))
    if metric == "feet":
        return earth_feet(lat1, lng1, lat2, lng2)
    raise ValueError(f"unknown metric {metric!r}")


def pair_dist(
    df: DataFrame, group: Sequence[str], key: str, lat: str, lng: str, radius: float, metric: str = "degrees"
) -> DataFrame:
    """Pairs (i < j) of a group at most ``radius`` degrees apart, with their distance.

    Points are laid on a grid of radius-sized cells and meet only points of the
    nine cells around them, so the work follows the number of near pairs, not
    the square of the group.
    """
    cell = lambda c: F.floor(F.col(c) / F.lit(radius))
    left = df.select(*group, F.col(key).alias("i"), F.col(lat).alias("_la"), F.col(lng).alias("_ga"), cell(lat).alias("_r"), cell(lng).alias("_c"))
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    right = df.select(
        *group, F.col(key).alias("j"), F.col(lat).alias("_lb"), F.col(lng).alias("_gb"), cell(lat).alias("_r0"), cell(lng).alias("_c0"),
        F.explode(around).alias("_d"),
    ).select(*group, "j", "_lb", "_gb", (F.col("_r0") + F.col("_d.a")).alias("_r"), (F.col("_c0") + F.col("_d.b")).alias("_c"))
    near = left.join(right, [*group, "_r", "_c"]).filter(F.col("i") < F.col("j"))
    apart = distance("degrees", F.col("_la"), F.col("_ga"), F.col("_lb"), F.col("_gb"))
    near = near.filter(apart <= radius)
    return near.select(*group, "i", "j", distance(metric, F.col("_la"), F.col("_ga"), F.col("_lb"), F.col("_gb")).alias("dist"))


def curve_key(lat: Column, lng: Column, bits: int = 16) -> Column:
    """Place on a Hilbert curve over the scaled coordinates: neighbours on it are neighbours on the map."""
    scale = (1 << bits) - 1
    x = F.floor((lng + 180) / 360 * scale).cast("bigint")
    y = F.floor((lat + 90) / 180 * scale).cast("bigint")
    one = F.lit(1).cast("bigint")

    def step(at: Column, bit: Column) -> Column:
        rx, ry = (F.call_function("shiftright", at[c], bit).bitwiseAND(one) for c in "xy")
        flip = (ry == 0) & (rx == 1)
        fx, fy = (F.when(flip, scale - at[c]).otherwise(at[c]) for c in "xy")
        return F.struct(
            F.when(ry == 0, fy).otherwise(fx).alias("x"), F.when(ry == 0, fx).otherwise(fy).alias("y"),
            (at["key"] * 4 + (rx * 3).bitwiseXOR(ry)).alias("key"),
        )

    first = F.struct(x.alias("x"), y.alias("y"), F.lit(0).cast("bigint").alias("key"))
    return F.aggregate(F.sequence(F.lit(bits - 1), F.lit(0), F.lit(-1)), first, step, lambda at: at["key"])


def lengths(points: np.ndarray) -> np.ndarray:
    """Distances of all points of a piece."""
    return np.sqrt(((points[:, None, :] - points[None, :, :]) ** 2).sum(-1))


def nearest_first(d: np.ndarray) -> np.ndarray:
    """Visiting order from the first point, always on to the nearest point left."""
    tour, left = [0], set(range(1, len(d)))
    while left:
        tour.append(min(left, key=lambda j: (d[tour[-1], j], j)))
        left.remove(tour[-1])
    return np.array(tour)


def improve(tour: np.ndarray, d: np.ndarray, closed: bool) -> tuple[np.ndarray, bool]:
    """2-opt until no gain, and whether there was one. The first point stays; so does the last of an open piece."""
    n, gained, better = len(tour), False, True
    while better:
        better = False
        for i in range(1, n - 1):
            # Reversing tour[i..j] swaps the edges before i and after j.
            j = np.arange(i + 1, n if closed else n - 1)
            if not len(j):
                continue
            after = tour[(j + 1) % n]
            gain = d[tour[i - 1], tour[i]] + d[tour[j], after] - d[tour[i - 1], tour[j]] - d[tour[i], after]
            best = int(np.argmax(gain))
            if gain[best] > 1e-12:
                stop = int(j[best]) + 1
                tour[i:stop] = tour[i:stop][::-1].copy()
                better = gained = True
    return tour, gained


def two_opt(points: np.ndarray, closed: bool) -> np.ndarray:
    """Visiting order from the first point: nearest neighbour, then 2-opt until no gain."""
    d = lengths(points)
    return improve(nearest_first(d), d, closed)[0]


def route_groups(
    df: DataFrame, group: Sequence[str], key: str, lat: str, lng: str, depot: str, max_stops: int = 200, blocks=None
) -> DataFrame:
    """Round trip per group from its depot through all stops: adds ``tour_pos`` from 1.

    Stops are put on a space-filling curve, depot first, and the closed tour is
    cut into equal pieces of at most ``max_stops``, each optimised in its own
    task. Passes over the pieces follow, cut by turns half a piece further
    (across the tour's end) and as at first, until a pass finds no gain: then no
    2-opt move inside any piece of either cut is left. A group of one piece is
    the closed tour itself. A huge group never lands in one task.
    """
    group = list(group)
    order = [F.when(F.col(depot), F.lit(0)).otherwise(F.lit(1)), curve_key(F.col(lat), F.col(lng)), F.col(key)]
    placed = with_position(df, group, order, "_at", total="_n", blocks=blocks)
    placed = placed.withColumns({"_first": F.col("_at") == 1, "_gained": F.lit(False)})
    types = {f.name: f.dataType.simpleString() for f in placed.schema.fields}
    schema = ", ".join(f"`{c}` {t}" for c, t in types.items())

    def one_pass(tours: DataFrame, shifted: bool, start: bool) -> DataFrame:
        # The cut is floor(place * pieces / n), where place counts from the cut's first stop.
        count = F.ceil(F.col("_n") / F.lit(max_stops))
        half = F.floor(F.col("_n") / (2 * count)) if shifted else F.lit(0)
        place = F.pmod(F.col("_at") - 1 + half, F.col("_n"))
        pieces = tours.withColumns({"_place": place, "_piece": F.floor(place * count / F.col("_n")).cast("bigint")})

        def one(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("_place")
            d = lengths(pdf[[lat, lng]].to_numpy(float))
            tour, gained = improve(nearest_first(d) if start else np.arange(len(pdf)), d, len(pdf) == int(pdf["_n"].iloc[0]))
            out = pdf.iloc[tour].copy()
            out["_at"] = pdf["_at"].to_numpy()
            out["_gained"] = gained
            return out.drop(columns=["_place", "_piece"])

        return checkpoint(spread(pieces, *group, "_piece").groupBy(*group, "_piece").applyInPandas(one, schema))

    tours, shifted = one_pass(placed, False, True), True
    several = F.col("_n") > max_stops
    while tours.filter(several).limit(1).count():
        tours = one_pass(tours, shifted, False)
        if not tours.filter(several & F.col("_gained")).limit(1).count():
            break
        shifted = not shifted
    return rotate(tours.drop("_n"), group, "_at", "_first", "tour_pos").select(*df.columns, "tour_pos")


def rotate(df: DataFrame, group: Sequence[str], position: str, depot: str, out: str = "route_order") -> DataFrame:
    """Number the stops of a cyclic tour from its depot, whichever position that has."""
    facts = df.groupBy(*group).agg(
        F.min(F.when(F.col(depot), F.col(position))).alias("_d"), F.count(F.lit(1)).alias("_n")
    )
    joined = attach(df, facts, group)
    return joined.withColumn(out, (F.pmod(F.col(position) - F.col("_d"), F.col("_n")) + 1).cast("bigint")).drop("_d", "_n")


def legs(
    df: DataFrame, group: Sequence[str], position: str, lat: str, lng: str, label: str, blocks: int | None = None
) -> DataFrame:
    """Each stop with the coordinates of the one at the next position and a label; a stop before a gap has no leg."""
    cols = {"end_lat": lat, "end_lng": lng, "_label": label, "_after": position}
    joined = with_lead(df, group, [F.col(position)], cols, blocks)
    follows = F.col("_after") == F.col(position) + 1
    return joined.filter(follows & F.col("end_lat").isNotNull() & F.col("end_lng").isNotNull()).select(
        *group,
        position,
        F.col(lat).alias("start_lat"),
        F.col(lng).alias("start_lng"),
        "end_lat",
        "end_lng",
        F.concat(F.col(label).cast("string"), F.lit(" to "), F.col("_label").cast("string")).alias("leg"),
    )


def route_totals(df: DataFrame, group: Sequence[str], leg: str, seconds: str, length: str) -> DataFrame:
    """Hours and miles per route, one decimal, from rows that repeat each leg's values."""
    each = df.select(*group, leg, seconds, to_feet(F.col(length)).alias("_feet")).distinct()
    return each.groupBy(*group).agg(
        F.round(F.sum(seconds) / 3600, 1).alias("hours"), F.round(F.sum("_feet") / FEET_PER_MILE, 1).alias("miles")
    )
