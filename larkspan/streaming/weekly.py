"""Posteriors per key and week as keyed state: late counts wait in their week, timers close weeks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import UTC, date, datetime, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

WEEK = timedelta(days=7)
POSTERIOR = "week date, successes bigint, failures bigint, alpha bigint, beta bigint, mean double"


def _millis(day: date) -> int:
    return int(datetime(day.year, day.month, day.day, tzinfo=UTC).timestamp() * 1000)


class WeeklyPosterior(StatefulProcessor):
    """State of a key: totals up to the last closed week, and the counts of each open week.

    A timer at the end of the next week to close emits that week's posterior,
    with or without events in it, drops the week's counts and sets the timer of
    the week after. Weeks before ``first`` are the prior, each count at least 1.
    """

    def __init__(self, keys: Sequence[str], first: date):
        self.keys, self.first = list(keys), first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "prior_s long, prior_f long, s long, f long, next date")
        self.weeks = handle.getMapState("weeks", "week date", "s long, f long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        known = self.totals.exists()
        prior_s, prior_f, s, f, following = self.totals.get() if known else (0, 0, 0, 0, self.first)
        for pdf in rows:
            counts = pdf.groupby("at_week")["won"].agg(["sum", "size"])
            for week, won, n in counts.itertuples():
                won, lost = int(won), int(n - won)
                if week < self.first:
                    prior_s, prior_f = prior_s + won, prior_f + lost
                else:
                    old = self.weeks.getValue((week,)) if self.weeks.containsKey((week,)) else (0, 0)
                    self.weeks.updateValue((week,), (old[0] + won, old[1] + lost))
        self.totals.update((prior_s, prior_f, s, f, following))
        if not known:
            self.handle.registerTimer(_millis(self.first + WEEK))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        prior_s, prior_f, s, f, week = self.totals.get()
        out = []
        while _millis(week + WEEK) <= timerValues.getCurrentWatermarkInMs():
            if self.weeks.containsKey((week,)):
                won, lost = self.weeks.getValue((week,))
                s, f = s + won, f + lost
                self.weeks.removeKey((week,))
            alpha, beta = max(prior_s, 1) + s, max(prior_f, 1) + f
            out.append((*key, week, s, f, alpha, beta, alpha / (alpha + beta)))
            week += WEEK
        self.totals.update((prior_s, prior_f, s, f, week))
        self.handle.registerTimer(_millis(week + WEEK))
        yield pd.DataFrame(out, columns=[*self.keys, "week", "successes", "failures", "alpha", "beta", "mean"])

    def close(self) -> None:
        pass


def weekly_posteriors(events: DataFrame, key: Sequence[str], ts: str, success: str, first: date, delay: str = "1 day") -> DataFrame:
    """One row per key and week (Monday, UTC) from ``first`` on, once the watermark has passed its end.

    Events may arrive in any order up to ``delay`` behind the newest; later ones
    are dropped, as by every watermark. Weeks without events carry the counts
    on. A key's weeks before its first event count as zero. The state of a key
    is its totals and open weeks only, whatever it has seen.
    """
    key = list(key)
    types = {f.name: f.dataType.simpleString() for f in events.schema.fields}
    # Names that start with an underscore reach the processor renamed.
    flagged = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay).select(
        *key, ts, F.to_date(F.date_trunc("week", F.col(ts))).alias("at_week"), F.col(success).cast("int").alias("won")
    )
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in key], POSTERIOR])
    processor = WeeklyPosterior(key, first)
    return flagged.groupBy(*key).transformWithStateInPandas(processor, schema, "Update", "EventTime")
