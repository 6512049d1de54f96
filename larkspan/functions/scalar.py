"""Numeric, date and JSON expressions."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sphere radius in km and feet per km of the distance formula.
EARTH_KM = 6378.145
FEET_PER_KM = 3280.8

WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, F.lit(1)).otherwise(F.lit(0))


def bucketize(c: Column, edges: Sequence[tuple[float | None, float | None]], labels: Sequence[str]) -> Column:
    """Label of the inclusive range holding the value; gaps and NULL give NULL."""
    out = None
    for (low, high), label in zip(edges, labels):
        inside = F.lit(True)
        if low is not None:
            inside = inside & (c >= low)
        if high is not None:
            inside = inside & (c <= high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def bucket_order(c: Column, labels: Sequence[str]) -> Column:
    """Position of a label in its explicit order, from 1."""
    return F.nullif(F.array_position(F.array(*map(F.lit, labels)), c), F.lit(0)).cast("int")


def floor_to(c: Column, step: int) -> Column:
    return (F.floor(c / F.lit(step)) * step).cast("int")


def clip(c: Column, low=None, high=None) -> Column:
    """Bounded value; NULL stays NULL although least and greatest skip it."""
    out = c
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(c.isNotNull(), out)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL where the denominator is zero or NULL."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def round_half_even(c: Column) -> Column:
    return F.rint(c)


def expm1_round(c: Column) -> Column:
    return F.rint(F.expm1(c))


def earth_feet(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in feet."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), F.lit(2))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lng1, lng2)
    return F.atan2(F.sqrt(h), F.sqrt(1 - h)) * (2 * EARTH_KM * FEET_PER_KM)


def year_date(c: Column) -> Column:
    return F.make_date(c, F.lit(1), F.lit(1))


def local_time(epoch: Column, zone: str | Column) -> Column:
    """Wall-clock timestamp in ``zone`` (the session zone is UTC)."""
    return F.from_utc_timestamp(F.timestamp_seconds(epoch), zone)


def local_hour(epoch: Column, zone: str | Column) -> Column:
    return F.hour(local_time(epoch, zone))


def same_local_day(epoch: Column, zone: str | Column, as_of: date | Column) -> Column:
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.to_date(local_time(epoch, zone)) == day


def anchored_dates(low: Column, high: Column, freq: str) -> Column:
    """Array of dates in [low, high]: ``W-FRI`` falls on Fridays, ``7D`` steps from ``low``.

    Empty where no anchor day lies inside.
    """
    low, high = low.cast("date"), high.cast("date")
    if freq.startswith("W-"):
        if freq[2:] not in WEEKDAYS:
            raise ValueError(f"unknown weekday in {freq!r}")
        first, days = F.next_day(F.date_sub(low, 1), freq[2:]), 7
    elif freq.endswith("D"):
        first, days = low, int(freq[:-1] or 1)
    else:
        raise ValueError(f"unsupported frequency {freq!r}")
    steps = F.sequence(first, high, F.expr(f"interval {days} days"))
    return F.when(first <= high, steps).otherwise(F.array().cast("array<date>"))


def snap_to(c: Column, freq: str) -> Column:
    """The anchor day on or after the date."""
    return F.next_day(F.date_sub(c.cast("date"), 1), freq[2:])


def json_rows(c: Column, schema: str) -> Column:
    """Parse JSON text with a declared schema; bad text gives NULL."""
    return F.from_json(c, schema, {"mode": "PERMISSIVE"})


def json_twice(c: Column, schema: str) -> Column:
    """Parse a document that was encoded as a JSON string inside JSON text."""
    inner = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
    return F.from_json(inner, schema, {"mode": "PERMISSIVE"})
