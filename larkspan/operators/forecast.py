"""One model per series, fitted in parallel with grouped maps.

Each group is one prepared series (one row per date), so a group is bounded by
its calendar; Spark spreads the groups over the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators.series import SeriesSpec
from larkspan.plans.ordered import spread

YEAR = 365.25
Z80 = 1.2815515655446004
# Observations a series needs to be fitted.
LEAST_ROWS = 2


def us_holidays(years: DataFrame, col: str, window: tuple[int, int] = (0, 0)) -> DataFrame:
    """US federal holidays of each year in a column: (holiday, ds, offset).

    A holiday on a weekend also gets its observed weekday. ``window`` adds days
    before and after each date.
    """
    y = F.col(col)
    day = lambda m, d: F.make_date(y, F.lit(m), F.lit(d))
    nth = lambda m, n, wd: F.date_add(F.next_day(F.date_sub(day(m, 1), 1), wd), 7 * (n - 1))
    # The rule of each holiday.
    rules = {
        "New Year's Day": day(1, 1),
        "Martin Luther King Jr. Day": nth(1, 3, "MON"),
        "Washington's Birthday": nth(2, 3, "MON"),
        "Memorial Day": F.next_day(F.date_sub(F.last_day(day(5, 1)), 7), "MON"),
        "Juneteenth National Independence Day": F.when(y >= 2021, day(6, 19)),
        "Independence Day": day(7, 4),
        "Labor Day": nth(9, 1, "MON"),
        "Columbus Day": nth(10, 2, "MON"),
        "Veterans Day": day(11, 11),
        "Thanksgiving": nth(11, 4, "THU"),
        "Christmas Day": day(12, 25),
    }
    named = F.array(*[F.struct(F.lit(k).alias("holiday"), v.alias("ds")) for k, v in rules.items()])
    base = years.select(col).distinct().select(F.inline(named)).filter(F.col("ds").isNotNull())
    weekday = F.dayofweek("ds")
    observed = F.when(weekday == 7, F.date_sub("ds", 1)).when(weekday == 1, F.date_add("ds", 1))
    both = F.array_compact(
        F.array(
            F.struct("holiday", "ds"),
            F.when(observed.isNotNull(), F.struct(F.concat("holiday", F.lit(" (observed)")).alias("holiday"), observed.alias("ds"))),
        )
    )
    steps = F.sequence(F.lit(window[0]), F.lit(window[1]))
    return (
        base.select(F.inline(both))
        .select("holiday", "ds", F.explode(steps).alias("offset"))
        .select("holiday", F.expr("date_add(ds, offset)").alias("ds"), "offset")
    )


def mark_holidays(df: DataFrame, date: str, out: str = "is_holiday") -> DataFrame:
    """Flag the dates that are holidays, by an exact date join.

    The year after each date's is looked at too: its New Year's Day may be observed on 31 December.
    """
    years = df.select(F.explode(F.array(F.year(date), F.year(date) + 1)).alias("_y")).distinct()
    days = us_holidays(years, "_y").select(F.col("ds").alias(date)).distinct()
    return df.join(days.withColumn(out, F.lit(1)), date, "left").withColumn(out, F.coalesce(out, F.lit(0)))


# Scales of the priors, for a series scaled to its bounds: trend offset and slope, changes of slope (Laplace), yearly terms, holidays.
TREND_SD, CHANGE_SCALE, SEASON_SD, HOLIDAY_SD = 5.0, 0.05, 10.0, 10.0
LEAST_NOISE = 1e-3
TRAJECTORIES = 500


def _trend_basis(t: np.ndarray, knots: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - knots, 0)])


def _yearly(days: np.ndarray, order: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / YEAR, np.arange(1, order + 1))
    return np.column_stack([np.sin(angle), np.cos(angle)])


def _sigmoid(v: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(v, -500, 500)))


def _most_likely(y: np.ndarray, basis: np.ndarray, extra: np.ndarray, sd: np.ndarray, changes: slice) -> tuple[np.ndarray, float, np.ndarray]:
    """Parameters and noise of largest posterior density, by damped Gauss-Newton steps, and the parameters' covariance.

    The model is sigmoid(basis @ trend) + extra @ effects. ``sd`` holds the
    priors' scales; that of ``changes`` is a Laplace prior, whose curvature is
    that of the square through the current value.
    """
    k, n = basis.shape[1], len(y)
    third = max(n // 3, 1)
    edge = np.clip([y[:third].mean(), y[-third:].mean()], 0.02, 0.98)
    ends = np.log(edge / (1 - edge))
    theta = np.zeros(k + extra.shape[1])
    theta[0], theta[1] = ends[0], ends[1] - ends[0]
    noise = max(float(np.std(y)), LEAST_NOISE)

    def parts(theta):
        curve = _sigmoid(basis @ theta[:k])
        return curve, y - curve - extra @ theta[k:]

    def cost(theta, rest):
        square = (theta / sd) ** 2 / 2
        square[changes] = np.abs(theta[changes]) / sd[changes]
        return (rest @ rest) / (2 * noise**2) + square.sum()

    for _ in range(12):
        damp = 1e-3
        curve, rest = parts(theta)
        now = start = cost(theta, rest)
        for _ in range(25):
            jacobian = np.column_stack([basis * (curve * (1 - curve))[:, None], extra])
            pull = 1 / sd**2
            pull[changes] = 1 / (sd[changes] * (np.abs(theta[changes]) + 1e-4))
            gram = jacobian.T @ jacobian / noise**2 + np.diag(pull)
            step = np.linalg.solve(gram + damp * np.diag(np.diag(gram)), jacobian.T @ rest / noise**2 - pull * theta)
            after = theta + step
            curve_after, rest_after = parts(after)
            then = cost(after, rest_after)
            if then < now:
                gained, theta, curve, rest, now = now - then, after, curve_after, rest_after, then
                damp = max(damp / 5, 1e-9)
                if gained < 1e-6 * (1 + abs(now)):
                    break
            else:
                damp *= 8
                if damp > 1e9:
                    break
        before, noise = noise, max(float(np.sqrt(rest @ rest / n)), LEAST_NOISE)
        if abs(noise - before) < 1e-4 * before and start - now < 1e-4 * (1 + abs(now)):
            break
    # Parameters used up by the fit make the residuals too small; how much they are in doubt is in the curvature.
    about = np.linalg.inv(jacobian.T @ jacobian / noise**2 + np.diag(pull))
    used = np.trace(about @ jacobian.T @ jacobian) / noise**2
    return theta, noise * np.sqrt(n / max(n - used, 1.0)), about


def fit_series(
    days: np.ndarray, y: np.ndarray, floor: float, cap: float, holidays: np.ndarray,
    future: np.ndarray, future_holidays: np.ndarray, level: float, order: int, max_knots: int, seed: int = 7,
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Saturating trend with changepoints, plus yearly terms and an effect per holiday column, for one series.

    The trend is a logistic curve between the bounds whose exponent changes slope
    at the knots; the other terms are added on the scale of the series, whose
    values may lie outside the bounds. Returns the mean, the interval and the
    holiday effects. The interval holds the noise, the doubt about the parameters
    and simulated changes of slope to come, as many and as large as those seen;
    it is clipped to the bounds.
    """
    width = max(cap - floor, 1e-9)
    start, span = days[0], max(days[-1] - days[0], 1.0)
    count = min(max_knots, max(len(days) // 3 - 1, 0))
    knots = np.linspace(0, 0.8, count + 1)[1:]
    basis, extra = _trend_basis((days - start) / span, knots), np.column_stack([_yearly(days, order), holidays])
    sd = np.concatenate([[TREND_SD] * 2, np.full(count, CHANGE_SCALE), np.full(2 * order, SEASON_SD), np.full(holidays.shape[1], HOLIDAY_SD)])
    theta, noise, about = _most_likely((y - floor) / width, basis, extra, sd, slice(2, 2 + count))
    trend, effects = theta[: 2 + count], theta[2 + count :]
    t = (future - start) / span
    exponent, added = _trend_basis(t, knots) @ trend, np.column_stack([_yearly(future, order), future_holidays]) @ effects
    curve = _sigmoid(exponent)
    mean = curve + added
    toward = np.column_stack([_trend_basis(t, knots) * (curve * (1 - curve))[:, None], _yearly(future, order), future_holidays])
    doubt = np.sqrt(noise**2 + np.maximum(np.einsum("ij,jk,ik->i", toward, about, toward), 0))

    rng = np.random.default_rng([seed, len(days)])
    size = np.mean(np.abs(trend[2:])) if count else 0.0
    new = rng.poisson(count * max(t[-1] - 1, 0.0), TRAJECTORIES) if count else np.zeros(TRAJECTORIES, int)
    most = max(int(new.max()), 1)
    at = rng.uniform(1, max(t[-1], 1.0), (TRAJECTORIES, most))
    change = np.where(np.arange(most) < new[:, None], rng.laplace(0, max(size, 1e-12), (TRAJECTORIES, most)), 0.0)
    moved = exponent + np.einsum("sk,skt->st", change, np.maximum(t - at[:, :, None], 0))
    drawn = _sigmoid(moved) + added + rng.normal(0, 1, (TRAJECTORIES, len(t))) * doubt
    low, high = np.quantile(drawn, [(1 - level) / 2, (1 + level) / 2], axis=0)
    back = lambda v: floor + width * np.clip(v, 0, 1)
    return back(mean), back(np.minimum(low, mean)), back(np.maximum(high, mean)), effects[2 * order :] * width


def _per_series(df: DataFrame, spec: SeriesSpec, horizon: int, window: tuple[int, int], made, columns: str) -> DataFrame:
    """One fit per key; ``made(ds, future, names, fitted)`` gives the rows of its result."""
    keys = list(spec.keys)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in keys], columns])
    names = [c.split()[0] for c in columns.split(", ")]
    calendar = _holiday_days(df, horizon * 7 if spec.freq.startswith("W-") else horizon * int(spec.freq[:-1] or 1), window)
    step = spec.freq if spec.freq.startswith("W-") else f"{int(spec.freq[:-1] or 1)}D"

    def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["y"].notna()].sort_values("ds")
        if len(pdf) < LEAST_ROWS:
            return pd.DataFrame(columns=[*keys, *names])
        ds = pd.to_datetime(pdf["ds"])
        future = pd.date_range(ds.iloc[-1], periods=horizon + 1, freq=step)[-horizon:]
        plain = lambda s: np.asarray(s, "datetime64[D]")
        # A column per named holiday and day of its window that the series has seen.
        seen = set(plain(ds).tolist())
        columns = sorted({c for c, dates in calendar.items() if dates & seen})
        flags = lambda s: np.array([[float(d in calendar[c]) for c in columns] for d in plain(s).tolist()]).reshape(len(s), len(columns))
        out = made(plain(ds), plain(future), columns, pdf["y"].to_numpy(float), float(pdf["floor"].iloc[0]), float(pdf["cap"].iloc[0]), flags(ds), flags(future))
        for name, value in zip(keys, key):
            out[name] = value
        return out[[*keys, *names]]

    return spread(df.select(*keys, "cap", "floor", "ds", "y"), *keys).groupBy(*keys).applyInPandas(one, schema)


def forecast_groups(
    df: DataFrame, spec: SeriesSpec, horizon: int = 13, level: float = 0.95, order: int = 10, max_knots: int = 25, window: tuple[int, int] = (0, 0)
) -> DataFrame:
    """Forecast every series of a model frame (keys, cap, floor, ds, y) ``horizon`` steps ahead.

    Returns ds, keys, yhat, yhat_lower and yhat_upper; all lie between the bounds.
    Every US holiday has an effect of its own, with ``window`` also on the days
    around it. Series too short to fit are in ``forecast_rejects``.
    """

    def made(ds, future, columns, y, floor, cap, flags, future_flags):
        mean, low, high, _ = fit_series(ds.astype(float), y, floor, cap, flags, future.astype(float), future_flags, level, order, max_knots)
        return pd.DataFrame({"ds": future.tolist(), "yhat_lower": low, "yhat_upper": high, "yhat": mean})

    return _per_series(df, spec, horizon, window, made, "ds date, yhat_lower double, yhat_upper double, yhat double")


def holiday_effects(df: DataFrame, spec: SeriesSpec, order: int = 10, max_knots: int = 25, window: tuple[int, int] = (0, 0)) -> DataFrame:
    """Keys, holiday, offset, effect: what each named holiday (and day around it) adds to every series that has seen it."""

    def made(ds, future, columns, y, floor, cap, flags, future_flags):
        *_, effects = fit_series(ds.astype(float), y, floor, cap, flags, future.astype(float), future_flags, 0.95, order, max_knots)
        return pd.DataFrame({"holiday": [c[0] for c in columns], "offset": [c[1] for c in columns], "effect": effects})

    return _per_series(df, spec, 1, window, made, "holiday string, offset int, effect double")


def forecast_rejects(df: DataFrame, spec: SeriesSpec) -> DataFrame:
    """The series that ``forecast_groups`` cannot fit: keys, observations, reason."""
    seen = df.groupBy(*spec.keys).agg(F.count("y").alias("n"))
    return seen.filter(F.col("n") < LEAST_ROWS).withColumn("reason", F.lit(f"fewer than {LEAST_ROWS} observations"))


def _holiday_days(df: DataFrame, days_ahead: int, window: tuple[int, int] = (0, 0)) -> dict[tuple[str, int], set]:
    """The rule calendar over the data's years and the horizon: the dates of each (holiday, day of its window)."""
    span = df.agg(F.min("ds").alias("a"), F.max("ds").alias("b")).first()
    if span.a is None:
        return {}
    # New Year's Day may be observed in the year before.
    years = range(span.a.year - 1, (span.b + timedelta(days=days_ahead)).year + 2)
    frame = df.sparkSession.range(years.start, years.stop).select(F.col("id").cast("int").alias("y"))
    out: dict[tuple[str, int], set] = {}
    for r in us_holidays(frame, "y", window).collect():
        out.setdefault((r["holiday"], r["offset"]), set()).add(r["ds"])
    return out


# Parameters of each form, the error's variance included.
FORMS = {"N": 3, "A": 5, "Ad": 6}
# Bounds of the level weight, of the slope weight's share of it, and of the damping.
LEVEL, SHARE, DAMPING = (1e-4, 0.9999), (1e-4, 0.9999), (0.8, 0.98)
# Weights of the starting points.
WEIGHTS = np.arange(0.1, 1.0, 0.1)
STARTS = {
    "N": np.array([(a, 0.0, 1.0) for a in WEIGHTS]),
    "A": np.array([(a, b, 1.0) for a in WEIGHTS for b in WEIGHTS]),
    "Ad": np.array([(a, b, p) for a in WEIGHTS for b in WEIGHTS for p in (0.82, 0.9, 0.97)]),
}
# Least mean squared error of a series scaled to mean size 1.
LEAST_VAR = 1e-12


def _between(u: np.ndarray, bounds: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """A free number mapped between bounds, and the derivative."""
    low, high = bounds
    s = _sigmoid(u)
    return low + (high - low) * s, (high - low) * s * (1 - s)


def _free(x: np.ndarray, bounds: tuple[float, float]) -> np.ndarray:
    share = np.clip((x - bounds[0]) / (bounds[1] - bounds[0]), 0.01, 0.99)
    return np.log(share / (1 - share))


def _weights(u: np.ndarray, form: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Level weight, slope weight and damping of free parameters (level, [slope, [damping]], states)."""
    alpha = _between(u[:, 0], LEVEL)[0]
    if form == "N":
        return alpha, np.zeros_like(alpha), np.ones_like(alpha)
    beta = alpha * _between(u[:, 1], SHARE)[0]
    return alpha, beta, _between(u[:, 2], DAMPING)[0] if form == "Ad" else np.ones_like(alpha)


def ets_deviance(y: np.ndarray, u: np.ndarray, form: str, relative: bool, curved: bool = False) -> tuple[np.ndarray, ...]:
    """Minus twice the log likelihood (without constants) of one parameter row per series, its
    gradient, the error variance, the last level and slope, and with ``curved`` the
    Gauss-Newton part of the Hessian.

    Level and slope move alike under both error kinds; relative errors are
    measured against the expected value. A row whose expected value is not
    positive has no relative likelihood (infinite deviance).
    """
    m, k = u.shape
    n = y.shape[1]
    alpha, d_alpha = _between(u[:, 0], LEVEL)
    beta, phi = np.zeros(m), np.ones(m)
    to_alpha, to_beta, to_phi = np.zeros((m, k)), np.zeros((m, k)), np.zeros((m, k))
    to_alpha[:, 0] = d_alpha
    level, slope = u[:, k - 1].copy(), np.zeros(m)
    d_level, d_slope = np.zeros((m, k)), np.zeros((m, k))
    if form == "N":
        d_level[:, k - 1] = 1
    else:
        share, d_share = _between(u[:, 1], SHARE)
        beta = alpha * share
        to_beta[:, 0], to_beta[:, 1] = share * d_alpha, alpha * d_share
        level, slope = u[:, k - 2].copy(), u[:, k - 1].copy()
        d_level[:, k - 2] = d_slope[:, k - 1] = 1
    if form == "Ad":
        phi, to_phi[:, 2] = _between(u[:, 2], DAMPING)
    col = lambda v: v[:, None]
    squares, logs = np.zeros(m), np.zeros(m)
    d_squares, d_logs = np.zeros((m, k)), np.zeros((m, k))
    crossed = np.zeros((m, k, k)) if curved else None
    wrong = np.zeros(m, dtype=bool)
    for i in range(n):
        ahead = level + phi * slope
        d_ahead = d_level + col(phi) * d_slope + col(slope) * to_phi
        error = y[:, i] - ahead
        if relative:
            wrong |= ahead <= 1e-9
            safe = np.where(ahead <= 1e-9, 1.0, ahead)
            rate = error / safe
            squares += rate * rate
            d_error = -col(y[:, i] / (safe * safe)) * d_ahead
            d_squares += col(2 * rate) * d_error
            logs += np.log(safe)
            d_logs += d_ahead / col(safe)
        else:
            squares += error * error
            d_error = -d_ahead
            d_squares += col(2 * error) * d_error
        if curved:
            crossed += d_error[:, :, None] * d_error[:, None, :]
        d_slope = col(phi) * d_slope + col(slope) * to_phi - col(beta) * d_ahead + col(error) * to_beta
        d_level = col(1 - alpha) * d_ahead + col(error) * to_alpha
        level, slope = ahead + alpha * error, phi * slope + beta * error
    var = squares / n
    value = n * np.log(np.maximum(var, LEAST_VAR)) + 2 * logs
    gradient = np.where(col(var > LEAST_VAR), n * d_squares / col(np.maximum(squares, n * LEAST_VAR)), 0.0) + 2 * d_logs
    bad = wrong | ~np.isfinite(value)
    value[bad], gradient[bad] = np.inf, 0.0
    found = value, gradient, np.maximum(var, LEAST_VAR), level, slope
    return (*found, crossed * (2 * n / np.maximum(squares, n * LEAST_VAR))[:, None, None]) if curved else found


def ets_start(y: np.ndarray, form: str) -> np.ndarray:
    """Free parameters of the weights on a coarse grid whose path from the first two values errs least."""
    grid = STARTS[form]
    alpha, share, phi = grid.T
    level = np.repeat(y[:, :1], len(grid), axis=1)
    first = (y[:, 1] - y[:, 0]) if form != "N" else np.zeros(len(y))
    slope = np.repeat(first[:, None], len(grid), axis=1)
    sse = np.zeros_like(level)
    for i in range(1, y.shape[1]):
        ahead = level + phi * slope
        error = y[:, i : i + 1] - ahead
        level, slope = ahead + alpha * error, phi * slope + alpha * share * error
        sse += error * error
    best = grid[np.argmin(sse, axis=1)]
    # States before the first value that expect exactly the first value and then the slope.
    states = [y[:, 0]] if form == "N" else [y[:, 0] - first, first / best[:, 2]]
    weights = [_free(best[:, 0], LEVEL)]
    if form != "N":
        weights.append(_free(best[:, 1], SHARE))
    if form == "Ad":
        weights.append(_free(best[:, 2], DAMPING))
    return np.stack([*weights, *states], axis=1)


def _inverse(y: np.ndarray, u: np.ndarray, form: str, relative: bool) -> np.ndarray:
    """Inverse Hessian that a search along ``u`` starts with."""
    hessian = ets_deviance(y, u, form, relative, curved=True)[5]
    at = np.arange(hessian.shape[1])
    hessian[:, at, at] = hessian[:, at, at] * (1 + 1e-6) + 1e-3
    return np.linalg.inv(hessian)


def ets_fit(y: np.ndarray, form: str, relative: bool, steps: int = 200) -> np.ndarray:
    """Free parameters of largest likelihood for each row of a matrix of equally long series.

    All rows take quasi-Newton (BFGS) steps together, each with its own inverse
    Hessian and its own halved step. A row whose deviance stands still starts
    again from the Gauss-Newton Hessian, and leaves if that doesn't help. No row
    ends above the deviance of its start.
    """
    u = ets_start(y, form)
    value, gradient = ets_deviance(y, u, form, relative)[:2]
    inverse = _inverse(y, u, form, relative)
    fresh = np.ones(len(u), dtype=bool)
    live = np.flatnonzero(np.isfinite(value))
    for _ in range(steps):
        live = live[np.abs(gradient[live]).max(axis=1, initial=0) > 1e-6]
        if not len(live):
            break
        g = gradient[live]
        move = -np.einsum("mij,mj->mi", inverse[live], g)
        fall = (move * g).sum(axis=1)
        uphill = ~(fall < 0)
        move[uphill], fall[uphill] = -g[uphill], -(g[uphill] ** 2).sum(axis=1)
        # No parameter moves by more than 1 in a step.
        scale = np.minimum(1.0, 1.0 / np.abs(move).max(axis=1))
        move, fall = move * scale[:, None], fall * scale
        length = np.ones(len(live))
        new, new_value, new_gradient = u[live].copy(), value[live].copy(), g.copy()
        trying = np.arange(len(live))
        for _ in range(25):
            rows = live[trying]
            tried = u[rows] + length[trying, None] * move[trying]
            v, d = ets_deviance(y[rows], tried, form, relative)[:2]
            ok = v <= value[rows] + 1e-4 * length[trying] * fall[trying]
            done = trying[ok]
            new[done], new_value[done], new_gradient[done] = tried[ok], v[ok], d[ok]
            trying = trying[~ok]
            if not len(trying):
                break
            length[trying] /= 2
        s, z = new - u[live], new_gradient - g
        curve = (s * z).sum(axis=1)
        fit = curve > 1e-12
        rows = live[fit]
        if len(rows):
            sf, zf, rho = s[fit], z[fit], 1 / curve[fit]
            hz = np.einsum("mij,mj->mi", inverse[rows], zf)
            zhz = (zf * hz).sum(axis=1)
            cross = hz[:, :, None] * sf[:, None, :]
            square = sf[:, :, None] * sf[:, None, :]
            inverse[rows] += ((1 + rho * zhz) * rho)[:, None, None] * square - rho[:, None, None] * (cross + cross.transpose(0, 2, 1))
        still = value[live] - new_value <= 1e-8 * (1 + np.abs(new_value))
        u[live], value[live], gradient[live] = new, new_value, new_gradient
        leaves = still & fresh[live]
        again = live[still & ~leaves]
        if len(again):
            inverse[again] = _inverse(y[again], u[again], form, relative)
        fresh[live] = still
        live = live[~leaves]
    return u


def ets_forecast(y: np.ndarray, h: int, z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best form by AICc for each row of a matrix of equally long series.

    Additive (A) and, for positive series, multiplicative (M) errors with no (N),
    additive (A) or damped (Ad) trend, each by maximum likelihood; no seasons.
    Returns (form such as ``MAdN``, mean, half width of the interval).
    """
    n = y.shape[1]
    size = np.abs(y).mean(axis=1)
    size[size == 0] = 1.0
    scaled = y / size[:, None]
    best = np.full(len(y), np.inf)
    names = np.full(len(y), "", dtype=object)
    mean, half = np.zeros((len(y), h)), np.zeros((len(y), h))
    exact = np.zeros(len(y), dtype=bool)
    for error in "AM":
        for form, k in FORMS.items():
            if form != "N" and n - k - 1 <= 0:
                continue
            # A series that additive errors fit exactly needs no other.
            rows = np.arange(len(y)) if error == "A" else np.flatnonzero((y > 0).all(axis=1) & ~exact)
            if not len(rows):
                continue
            part = scaled[rows]
            u = ets_fit(part, form, error == "M")
            value, _, var, level, slope = ets_deviance(part, u, form, error == "M")
            if error == "A":
                exact |= var <= LEAST_VAR
            score = value + 2 * k + 2 * k * (k + 1) / max(n - k - 1, 1e-9)
            # The interval's variance allows for the fitted parameters.
            var = var * n / max(n - k + 1, 1)
            alpha, beta, phi = (c[:, None] for c in _weights(u, form))
            damp = np.cumsum(phi ** np.arange(1, h + 1), axis=1)
            ahead = level[:, None] + slope[:, None] * damp
            # Effect of a shock on the value j steps later.
            effect = (alpha + beta * damp) ** 2
            if error == "A":
                spread_of = var[:, None] * (1 + np.concatenate([np.zeros((len(part), 1)), np.cumsum(effect, axis=1)[:, :-1]], axis=1))
            else:
                second = np.zeros_like(ahead)
                for j in range(h):
                    second[:, j] = ahead[:, j] ** 2 + var * (effect[:, :j] * second[:, :j][:, ::-1]).sum(axis=1)
                spread_of = (1 + var[:, None]) * second - ahead**2
            win = score < best[rows] - 1e-9
            at = rows[win]
            best[at], names[at] = score[win], f"{error}{form}N"
            mean[at] = ahead[win] * size[at, None]
            half[at] = z * np.sqrt(np.maximum(spread_of[win], 0)) * size[at, None]
    return names, mean, half


def ets_groups(df: DataFrame, key: Sequence[str], t: str, y: str, h: int = 10, level_z: float = Z80) -> DataFrame:
    """Exponential-smoothing forecast of a yearly series per key, lower bound clipped at zero.

    A series is one array (one value per year), and a batch of equally long
    series is fitted as one matrix. Series of one or two values repeat their
    first value.
    """
    key = list(key)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    point = F.struct(F.col(t).cast("int").alias("t"), F.col(y).cast("double").alias("y"))
    series = df.groupBy(*key).agg(F.array_sort(F.collect_list(point)).alias("p"))
    series = series.select(*key, F.array_max("p.t").alias("_last"), F.col("p.y").alias("_ys"))
    ahead = "array<struct<step:int,y:double,lo:double,hi:double>>"
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in key], "_last int", "model string", f"_ahead {ahead}"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lengths = pdf["_ys"].map(len)
            for length in sorted(lengths.unique()):
                part = pdf[lengths == length]
                values = np.array(part["_ys"].tolist(), dtype=float)
                if length < 3:
                    values = np.concatenate([np.repeat(values[:, :1], 3 - length, axis=1), values], axis=1)
                names, mean, half = ets_forecast(values, h, level_z)
                low, high = np.maximum(mean - half, 0), mean + half
                steps = [
                    [{"step": j + 1, "y": m[j], "lo": a[j], "hi": b[j]} for j in range(h)] for m, a, b in zip(mean, low, high)
                ]
                yield part[[*key, "_last"]].assign(model=names, _ahead=steps)

    out = spread(series, *key).mapInPandas(run, schema).select(*key, "_last", "model", F.inline("_ahead"))
    return out.select(*key, (F.col("_last") + F.col("step")).alias(t), F.col("y").alias(y), "lo", "hi", "model")
