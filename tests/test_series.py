from datetime import date, timedelta

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspan.operators import forecast as P
from larkspan.operators import series as K
from larkspan.operators.clean import clamp_negative, expm1_round_like
from larkspan.operators.filters import keep_groups_min_obs
from larkspan.operators.joins import expand_grid
from larkspan.operators.windows import topk_share

SPEC = K.SeriesSpec(("store", "dept"), "date", "sales")


def d(month, day, year=2010):
    return date(year, month, day)


@pytest.fixture(scope="module")
def one(spark):
    data = [(1, 1, d(2, 5), 24924.0), (1, 1, d(2, 19), 41596.0), (1, 1, d(2, 26), 19404.0), (1, 1, d(3, 19), 22137.0), (1, 1, d(3, 26), 26229.0)]
    return spark.createDataFrame(data, "store int, dept int, date date, sales double")


def test_padding(one):
    out = {r["date"]: r["sales"] for r in K.pad(one, SPEC).collect()}
    assert len(out) == 8
    assert sorted(k for k, v in out.items() if v is None) == [d(2, 12), d(3, 5), d(3, 12)]


def test_padding_twice_changes_nothing(one):
    padded = K.pad(one, SPEC)
    assert rows(padded) == rows(K.pad(padded, SPEC))


def test_unanchored_steps_follow_the_first_date(one):
    spec = K.SeriesSpec(("store", "dept"), "date", "sales", "7D")
    assert rows(K.pad(one, spec)) == rows(K.pad(one, SPEC))


def test_off_grid_dates(spark):
    data = [(1, 1, d(2, 3), 1.0), (1, 1, d(2, 12), 2.0), (1, 1, d(2, 14), 4.0), (1, 1, d(2, 25), 8.0)]
    df = spark.createDataFrame(data, "store int, dept int, date date, sales double")
    assert rows(K.pad(df, SPEC), "date", "sales") == [(d(2, 5), None), (d(2, 12), 2.0), (d(2, 19), None)]
    snapped = rows(K.pad(df, SPEC, off_grid="snap"), "date", "sales")
    assert snapped == [(d(2, 5), 1.0), (d(2, 12), 2.0), (d(2, 19), 4.0), (d(2, 26), 8.0)]
    with pytest.raises(Exception, match="off the calendar"):
        K.pad(df, SPEC, off_grid="error").collect()


def test_longest_streak_and_filter(one):
    padded = K.pad(one, SPEC)
    assert K.with_streak(padded, SPEC).agg(F.max("streak")).first()[0] == 2
    assert K.filter_max_streak(padded, SPEC, 2).count() == 8
    assert K.filter_max_streak(padded, SPEC, 1).count() == 0


def test_linear_fill(one):
    out = {r["date"]: r["sales"] for r in K.fill(K.pad(one, SPEC), SPEC).collect()}
    assert (out[d(2, 12)], out[d(3, 5)], out[d(3, 12)]) == (33260.0, 20315.0, 21226.0)


def test_fill_stays_inside_a_group(spark):
    data = [(1, 1, d(2, 5), 10.0), (1, 1, d(2, 12), None), (2, 1, d(2, 5), None), (2, 1, d(2, 12), 7.0), (2, 1, d(2, 19), None)]
    df = spark.createDataFrame(data, "store int, dept int, date date, sales double")
    assert [r[3] for r in rows(K.fill(df, SPEC), "store", "dept", "date", "sales")] == [10.0, 10.0, None, 7.0, 7.0]
    assert [r[3] for r in rows(K.fill(df, SPEC, both=True), "store", "dept", "date", "sales")] == [10.0, 10.0, 7.0, 7.0, 7.0]
    assert [r[3] for r in rows(K.fill(df, SPEC, "mean"), "store", "dept", "date", "sales")] == [10.0, 10.0, 7.0, 7.0, 7.0]
    assert [r[3] for r in rows(K.fill(df, SPEC, "zero"), "store", "dept", "date", "sales")] == [10.0, 0.0, 0.0, 7.0, 0.0]


def test_bounds(spark):
    df = spark.createDataFrame([(1, 1, d(2, 5), 10.0), (1, 1, d(2, 12), 100.0)], "store int, dept int, date date, sales double")
    assert {(r["floor_value"], r["cap_value"]) for r in K.add_bounds(df, SPEC, 0.5, 1.5).collect()} == {(5.0, 150.0)}


def test_min_observations_is_strict(spark):
    df = spark.sql("SELECT IF(id < 13, 1, 2) AS g, IF(id = 40, NULL, id) AS y FROM range(27)")
    assert {r[0] for r in keep_groups_min_obs(df, ["g"], "y", 13).collect()} == {2}
    assert {r[0] for r in keep_groups_min_obs(df, ["g"], "y", 13, inclusive=True).collect()} == {1, 2}


def test_negatives_and_half_even(spark):
    df = spark.createDataFrame([(1, -3.0), (2, None), (3, 4.0)], "id int, y double")
    assert rows(clamp_negative(df, "y")) == [(1, 0.0), (2, None), (3, 4.0)]
    halves = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(F.rint("v").alias("v"))
    assert [r[0] for r in rows(halves)] == [0.0, 2.0, 2.0]
    back = expm1_round_like(spark.createDataFrame([(float(np.log1p(41596.0)), "a")], "sales double, sales_note string"), "sales")
    assert rows(back) == [(41596.0, "a")]


def test_prepare_whole(spark, one):
    two = one.unionByName(spark.createDataFrame([(9, 9, d(2, 5), 5.0)], "store int, dept int, date date, sales double"))
    out = K.prepare(two, SPEC, 4, 2, 0.5, 1.5)
    assert out.count() == 8
    assert out.columns == ["store", "dept", "date", "sales_log1p", "floor_value_log1p", "cap_value_log1p"]
    r = out.orderBy("date").first()
    assert np.isclose(np.expm1(r["floor_value_log1p"]), 9702.0) and np.isclose(np.expm1(r["cap_value_log1p"]), 62394.0)


def test_yearly_series_zero_fill(spark):
    df = spark.createDataFrame([("a", 2000, 5), ("a", 2002, 5), ("b", 2001, 3), ("c", 1999, 99)], "name string, year int, n bigint")
    assert rows(K.yearly_series(df, ["name"], "year", "n", 2000, 5)) == [("a", 2000, 5), ("a", 2001, 0), ("a", 2002, 5)]


def test_bind_forecast(spark):
    actual = spark.createDataFrame([(1, d(1, 1), float(np.log1p(9.0)))], "k int, ds date, y double")
    ahead = spark.createDataFrame([(1, d(1, 8), 0.0, 1.0, float(np.log1p(4.0)))], "k int, ds date, yhat_lower double, yhat_upper double, yhat double")
    spec = K.SeriesSpec(("k",), "ds", "sales")
    out = K.bind_forecast(actual, ahead, spec, F.lit("2021-03-28"))
    assert rows(out, "ds", "sales", "sales_lb", "sales_ub", "part", "fcast_date") == [
        (d(1, 1), 9.0, None, None, "actuals", None), (d(1, 8), 4.0, 0.0, 2.0, "forecast", "2021-03-28")
    ]
    kept = K.bind_forecast(actual, ahead, spec, F.lit("x"), round_actuals=False)
    assert np.isclose(kept.filter("part = 'actuals'").first()["sales"], np.log1p(9.0))


def test_topk_share_drops_short_groups(spark):
    df = spark.createDataFrame([("a", "x", 6), ("a", "y", 3), ("a", "z", 1), ("b", "x", 9)], "g string, e string, n int")
    assert rows(topk_share(df, ["g"], [F.desc("n"), F.col("e")], "n", 2)) == [("a", 0.9)]


def series(spark, slope=0.0, season=0.0, weeks=208):
    weeks_df = spark.sql(f"SELECT id AS i, date_add(DATE '2010-01-01', CAST(id * 7 AS INT)) AS ds FROM range({weeks})")
    y = 50 + slope * F.col("i") + season * F.sin(F.col("i") * 7 * 2 * np.pi / 365.25)
    return weeks_df.select(F.lit(1).alias("k"), F.lit(200.0).alias("cap"), F.lit(0.0).alias("floor"), "ds", y.alias("y"))


def test_forecast_follows_trend_and_season(spark):
    spec = K.SeriesSpec(("k",), "ds", "y")
    out = P.forecast_groups(series(spark, 0.1, 10), spec).orderBy("ds").collect()
    assert len(out) == 13 and out[0]["ds"] == date(2013, 12, 27)
    i = np.arange(208, 221)
    truth = 50 + 0.1 * i + 10 * np.sin(i * 7 * 2 * np.pi / 365.25)
    assert np.max(np.abs(np.array([r["yhat"] for r in out]) - truth)) < 6
    assert all(0 <= r["yhat_lower"] <= r["yhat"] <= r["yhat_upper"] <= 200 for r in out)


def test_forecast_stays_in_bounds(spark):
    spec = K.SeriesSpec(("k",), "ds", "y")
    steep = series(spark, 1.0).withColumn("cap", F.lit(260.0))
    assert all(r["yhat_upper"] <= 260 for r in P.forecast_groups(steep, spec).collect())


def test_forecast_rejects_short_series(spark):
    spec = K.SeriesSpec(("k",), "ds", "y")
    one = series(spark, weeks=1).withColumn("k", F.lit(2))
    none = series(spark, weeks=3).withColumns({"k": F.lit(3), "y": F.lit(None).cast("double")})
    df = series(spark).unionByName(one).unionByName(none)
    assert rows(P.forecast_rejects(df, spec), "k", "n") == [(2, 1), (3, 0)]
    assert [r["k"] for r in P.forecast_groups(df, spec).select("k").distinct().collect()] == [1]


def test_holidays_of_far_years(spark):
    df = spark.createDataFrame([(date(2149, 12, 25),), (date(2150, 12, 30),)], "ds date")
    found = P._holiday_days(df, 14)
    assert date(2149, 12, 25) in found["Christmas Day", 0] and date(2151, 1, 1) in found["New Year's Day", 0]


def test_named_holidays_have_effects_of_their_own(spark):
    """A planted effect of Thanksgiving and of the day after is found; other holidays, a neighbour among them, have none."""
    spec = K.SeriesSpec(("k",), "ds", "y", "1D")
    rng = np.random.default_rng(3)
    days = [date(2015, 1, 1) + timedelta(days=i) for i in range(4 * 365)]
    calendar = P._holiday_days(spark.createDataFrame([(days[0],), (days[-1],)], "ds date"), 30, (0, 1))
    thanks, after, veterans = calendar["Thanksgiving", 0], calendar["Thanksgiving", 1], calendar["Veterans Day", 0]
    y = [60 + 0.005 * i + 8 * np.sin(2 * np.pi * i / 365.25) + 30 * (d in thanks) - 15 * (d in after) + rng.normal(0, 1) for i, d in enumerate(days)]
    df = spark.createDataFrame([(1, 200.0, 0.0, d, float(v)) for d, v in zip(days, y)], "k int, cap double, floor double, ds date, y double")
    found = {(r.holiday, r.offset): r.effect for r in P.holiday_effects(df, spec, window=(0, 1)).collect()}
    assert abs(found["Thanksgiving", 0] - 30) < 2 and abs(found["Thanksgiving", 1] + 15) < 2
    assert abs(found["Veterans Day", 0]) < 2 and abs(found["Columbus Day", 0]) < 2 and len(veterans) >= 4
    ahead = {r.ds: r.yhat for r in P.forecast_groups(df.where("ds < date'2018-11-10'"), spec, horizon=20, window=(0, 1)).collect()}
    assert ahead[date(2018, 11, 22)] - ahead[date(2018, 11, 20)] > 20 and ahead[date(2018, 11, 23)] - ahead[date(2018, 11, 20)] < -8


def test_intervals_cover(spark):
    """On simulated series with two changes of slope, 95 % intervals hold 90 to 99 % of what comes."""
    rng = np.random.default_rng(11)
    spec = K.SeriesSpec(("k",), "ds", "y")
    first = date(2012, 1, 6)
    past, coming = [], {}
    for k in range(60):
        t = np.arange(169)
        slope = rng.normal(0, 0.01) * np.ones(169)
        for at in rng.integers(20, 150, 2):
            slope[at:] += rng.laplace(0, 0.004)
        truth = 100 / (1 + np.exp(-(rng.normal(0, 0.5) + np.cumsum(slope)))) + 5 * np.sin(2 * np.pi * t * 7 / 365.25 + rng.uniform(0, 6))
        y = truth + rng.normal(0, 2, 169)
        for i in range(169):
            d = first + timedelta(days=7 * i)
            if i < 156:
                past.append((k, 120.0, -20.0, d, float(y[i])))
            else:
                coming[k, d] = y[i]
    df = spark.createDataFrame(past, "k int, cap double, floor double, ds date, y double")
    hit = [r.yhat_lower <= coming[r.k, r.ds] <= r.yhat_upper for r in P.forecast_groups(df, spec).collect()]
    assert len(hit) == 60 * 13 and 0.9 <= np.mean(hit) <= 0.99, np.mean(hit)


def test_smoothing_picks_a_trend(spark):
    years = spark.range(2000, 2019).withColumnRenamed("id", "year")
    df = expand_grid(spark.createDataFrame([("up",), ("flat",)], "name string"), years).withColumn(
        "n", F.when(F.col("name") == "up", (F.col("year") - 1990) * 10.0).otherwise(F.lit(40.0))
    )
    out = P.ets_groups(df, ["name"], "year", "n", h=10)
    up = [r["n"] for r in out.filter("name = 'up'").orderBy("year").collect()]
    flat = out.filter("name = 'flat'").collect()
    assert np.allclose(up, np.arange(290, 390, 10), atol=5)
    assert len(flat) == 10 and all(abs(r["n"] - 40) < 1e-6 and r["lo"] >= 0 for r in flat)


def smoothed(m, n, alpha, beta, phi, relative, sd, level, slope, seed=1):
    """Simulated innovations state-space series, one per row."""
    rng, out = np.random.default_rng(seed), []
    l, b = np.full(m, level), np.full(m, slope)
    for _ in range(n):
        mean = l + phi * b
        error = rng.normal(0, sd, m) * (mean if relative else 1)
        out.append(mean + error)
        l, b = mean + alpha * error, phi * b + beta * error
    return np.array(out).T


@pytest.mark.parametrize(
    "form, relative, weights, sd, level, slope",
    [
        ("N", False, (0.3, 0.0, 1.0), 1.0, 50.0, 0.0),
        ("A", False, (0.5, 0.1, 1.0), 0.5, 500.0, 0.5),
        ("Ad", False, (0.5, 0.2, 0.9), 0.5, 500.0, 0.5),
        ("N", True, (0.3, 0.0, 1.0), 0.02, 50.0, 0.0),
        ("A", True, (0.4, 0.1, 1.0), 0.001, 500.0, 0.5),
    ],
)
def test_smoothing_recovers_parameters(form, relative, weights, sd, level, slope):
    y = smoothed(40, 1500, *weights, relative, sd, level, slope)
    y = y[(y > 0).all(axis=1)] if relative else y
    y = y / np.abs(y).mean(axis=1, keepdims=True)
    u = P.ets_fit(y, form, relative)
    assert len(u) >= 15
    for got, true in zip(P._weights(u, form), weights):
        assert abs(np.mean(got) - true) < 0.02 and np.quantile(np.abs(got - true), 0.9) < 0.05
    # The search starts on the grid and never ends above it.
    assert (P.ets_deviance(y, u, form, relative)[0] <= P.ets_deviance(y, P.ets_start(y, form), form, relative)[0]).all()


@pytest.mark.parametrize("form", list(P.FORMS))
@pytest.mark.parametrize("relative", [False, True])
def test_smoothing_gradient(form, relative):
    y = smoothed(6, 25, 0.4, 0.1, 0.9, False, 1.0, 50.0, 0.2)
    y = y / y.mean(axis=1, keepdims=True)
    u = P.ets_start(y, form)
    gradient = P.ets_deviance(y, u, form, relative)[1]
    for j, step in enumerate(np.eye(u.shape[1]) * 1e-6):
        by_hand = (P.ets_deviance(y, u + step, form, relative)[0] - P.ets_deviance(y, u - step, form, relative)[0]) / 2e-6
        assert np.allclose(by_hand, gradient[:, j], rtol=1e-3, atol=1e-3)


def test_smoothing_intervals_hold_the_future():
    hits = []
    for relative, sd in ((False, 3.0), (True, 0.05)):
        y = smoothed(200, 210, 0.3, 0.05, 1.0, relative, sd, 100.0, 1.0, seed=5)
        y = y[(y > 0).all(axis=1)]
        _, mean, half = P.ets_forecast(y[:, :200], 10, P.Z80)
        hits.append(np.mean(np.abs(y[:, 200:] - mean) <= half))
    assert all(0.72 <= h <= 0.88 for h in hits), hits


def test_smoothing_of_odd_series():
    y = np.array([[0.0] * 8, [5.0] * 8, [0, 0, 0, 9.0, 0, 0, 0, 1], [1e12, 2e12, 1e12, 3e12, 2e12, 1e12, 2e12, 2e12], list(np.arange(8.0) * 3 + 1)])
    names, mean, half = P.ets_forecast(y, 3, P.Z80)
    assert np.isfinite(mean).all() and np.isfinite(half).all() and (half >= 0).all() and (names != "").all()
    assert np.allclose(mean[:2], [[0] * 3, [5] * 3]) and np.allclose(mean[4], [25, 28, 31], atol=0.01)
    for n in (3, 4, 5, 6, 7):
        names, mean, half = P.ets_forecast(y[:, :n], 3, P.Z80)
        assert np.isfinite(mean).all() and np.isfinite(half).all() and (names != "").all()


def test_holidays(spark):
    out = P.us_holidays(spark.createDataFrame([(2010,), (2021,)], "y int"), "y")
    got = {(r["holiday"], r["ds"]) for r in out.collect()}
    assert ("Thanksgiving", date(2010, 11, 25)) in got and ("Memorial Day", date(2010, 5, 31)) in got
    assert ("Independence Day (observed)", date(2010, 7, 5)) in got and ("Christmas Day (observed)", date(2010, 12, 24)) in got
    assert not any(h.startswith("Juneteenth") and x.year == 2010 for h, x in got)


def test_new_years_day_observed_in_the_old_year(spark):
    from larkspan.operators.forecast import mark_holidays

    days = spark.sql("SELECT explode(array(date'2004-12-30', date'2004-12-31')) AS ds")
    assert {str(r.ds): r.is_holiday for r in mark_holidays(days, "ds").collect()} == {"2004-12-30": 0, "2004-12-31": 1}
