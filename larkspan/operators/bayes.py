"""Beta-binomial posteriors, empirical priors and posterior comparisons."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.functions.special import beta_pdf, beta_ppf, digamma, lgamma, trigamma
from larkspan.operators.aggregates import quantiles
from larkspan.operators.windows import running_counts
from larkspan.plans.ordered import spread
from larkspan.session import checkpoint


def beta_update(df: DataFrame, success: str, failure: str, a0: Column, b0: Column) -> DataFrame:
    """Posterior parameters and mean from counts and a prior."""
    out = df.withColumns({"alpha": a0 + F.col(success), "beta": b0 + F.col(failure)})
    return out.withColumn("mean", F.col("alpha") / (F.col("alpha") + F.col("beta")))


def beta_evolution(
    events: DataFrame, key: Sequence[str], t: str, success: str, calendar: DataFrame, priors: DataFrame | None = None, blocks=None
) -> DataFrame:
    """Posterior per key and calendar step; keys without a prior start from (1, 1).

    ``events`` hold a 0/1 success per row and ``calendar`` the (key, step) grid;
    ``priors`` has one row per key with prior_alpha and prior_beta.
    """
    flagged = events.withColumns({"_s": F.col(success), "_f": 1 - F.col(success)})
    counts = running_counts(calendar, flagged, key, t, {"successes": "_s", "failures": "_f"}, blocks)
    if priors is not None:
        counts = counts.join(priors, list(key), "left")
        a0, b0 = F.coalesce("prior_alpha", F.lit(1)), F.coalesce("prior_beta", F.lit(1))
    else:
        a0, b0 = F.lit(1), F.lit(1)
    out = beta_update(counts, "successes", "failures", a0, b0)
    return out.select(*key, t, "successes", "failures", "alpha", "beta", "mean")


def density_grid(df: DataFrame, steps: int = 100) -> DataFrame:
    """Posterior density at 0, 1/steps, ..., 1 for every row."""
    x = F.explode(F.sequence(F.lit(0), F.lit(steps)))
    grid = df.select("*", x.alias("_i")).withColumn("x", F.col("_i") / steps).drop("_i")
    return grid.withColumn("density", beta_pdf("x", F.col("alpha").cast("double"), F.col("beta").cast("double")))


def credible(df: DataFrame, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """Credible interval and mean of each posterior.

    A quantile takes far longer than its row's bytes suggest, so the rows are dealt evenly.
    """
    df = spread(df)
    a, b = F.col("alpha").cast("double"), F.col("beta").cast("double")
    return df.withColumns(
        {"lower": beta_ppf(F.lit(low), a, b), "upper": beta_ppf(F.lit(high), a, b), "mean": a / (a + b)}
    )


def ucb_pick(df: DataFrame, t: str, entity: str) -> DataFrame:
    """Per step the entity with the greatest upper bound, ties by name."""
    best = F.min_by(F.struct(entity, "upper"), F.struct(-F.col("upper"), F.col(entity)))
    return df.groupBy(t).agg(best.alias("b")).select(t, "b.*")


def _design(pdf: pd.DataFrame, covs: Sequence[str]) -> np.ndarray:
    return np.column_stack([np.ones(len(pdf)), *[pdf[c].to_numpy(float) for c in covs]])


def _moments(theta: np.ndarray, covs: Sequence[str]):
    """Per-batch log-likelihood, gradient and Hessian of the beta-binomial, flattened."""
    size = len(theta)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _design(pdf, covs)
            k, n, w = (pdf[c].to_numpy(float) for c in ("k", "n", "w"))
            mu, s = x @ theta[:-1], np.exp(theta[-1])
            bad = (mu <= 0) | (mu >= 1)
            m = np.where(bad, 0.5, mu)
            a, b = m * s, (1 - m) * s
            ll = lgamma(a + k) - lgamma(a) + lgamma(b + n - k) - lgamma(b) - lgamma(s + n) + lgamma(np.full_like(n, s))
            da, db, ds = digamma(a + k) - digamma(a), digamma(b + n - k) - digamma(b), digamma(s + n) - digamma(np.full_like(n, s))
            ta, tb, ts = trigamma(a + k) - trigamma(a), trigamma(b + n - k) - trigamma(b), trigamma(s + n) - trigamma(np.full_like(n, s))
            g_mu, g_s = s * (da - db), a * da + b * db - s * ds
            h_mm, h_ss = s * s * (ta + tb), g_s + a * a * ta + b * b * tb - s * s * ts
            h_ms = g_mu + s * (a * ta - b * tb)
            grad = np.append(x.T @ (w * g_mu), np.sum(w * g_s))
            hess = np.zeros((size, size))
            hess[:-1, :-1] = x.T @ (x * (w * h_mm)[:, None])
            hess[:-1, -1] = hess[-1, :-1] = x.T @ (w * h_ms)
            hess[-1, -1] = np.sum(w * h_ss)
            flat = np.concatenate([[np.sum(w * ll), float(bad.sum())], grad, hess.ravel()])
            yield pd.DataFrame({"at": np.arange(len(flat)), "v": flat})

    return run


def _evaluate(cells: DataFrame, theta: np.ndarray, covs: Sequence[str]):
    size = len(theta)
    rows = cells.mapInPandas(_moments(theta, covs), "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    flat = np.zeros(2 + size + size * size)
    for r in rows:
        flat[r["at"]] = r["v"]
    value = -np.inf if flat[1] > 0 else flat[0]
    return value, flat[2 : 2 + size], flat[2 + size :].reshape(size, size)


def eb_coefficients(
    df: DataFrame, k: str, n: str, covs: Sequence[str] = (), iterations: int = 40, tol: float = 1e-7
) -> tuple[np.ndarray, float]:
    """Beta-binomial fit with identity link: mean coefficients and dispersion sigma.

    Rows are counted per distinct (k, n, covariates) cell; the cells are stored in
    partitions by their size, not by the number of shuffle partitions. Every Newton step is
    one distributed aggregation on standardised covariates; only the gradient and Hessian sums, whose size
    depends on the number of covariates alone, come back.
    """
    covs = list(covs)
    scale = {c: (0.0, 1.0) for c in covs}
    if covs:
        facts = df.agg(*[F.struct(F.avg(c), F.stddev(c)).alias(c) for c in covs]).first()
        scale = {c: (float(facts[c][0]), float(facts[c][1] or 1.0)) for c in covs}
    cells = checkpoint(
        df.select(F.col(k).cast("double").alias("k"), F.col(n).cast("double").alias("n"), *[((F.col(c) - scale[c][0]) / scale[c][1]).alias(c) for c in covs])
        .na.drop()
        .filter(F.col("n") > 0)
        .groupBy("k", "n", *covs)
        .agg(F.count(F.lit(1)).cast("double").alias("w"))
    )
    n, k, w = F.col("n"), F.col("k"), F.col("w")
    rate = cells.agg((F.sum(k * w) / F.sum(n * w)).alias("mu")).first().mu
    rate = min(max(rate, 1e-3), 1 - 1e-3)
    # The spread beyond binomial gives the first guess of the dispersion.
    chi = F.sum(w * F.pow(k - n * rate, F.lit(2)) / (n * rate * (1 - rate)))
    excess = cells.agg(chi.alias("chi"), F.sum(w).alias("rows"), (F.sum(n * w) / F.sum(w)).alias("size")).first()
    rho = (excess.chi / excess.rows - 1) / max(excess.size - 1, 1e-9)
    theta = np.concatenate([[rate], np.zeros(len(covs)), [np.clip(-np.log(max(rho, 1e-12)), -5, 14)]])
    value, grad, hess = _evaluate(cells, theta, covs)
    for _ in range(iterations):
        # Absolute curvatures make every step go uphill.
        curve, axes = np.linalg.eigh(hess)
        step = axes @ ((axes.T @ grad) / np.maximum(np.abs(curve), 1e-8))
        step *= min(1.0, 2 / max(abs(step[-1]), 1e-12))
        size, moved = 1.0, False
        while size > 1e-4:
            new = theta + size * step
            new[-1] = np.clip(new[-1], -5, 15)
            result = _evaluate(cells, new, covs)
            if result[0] > value:
                gain, moved = result[0] - value, True
                theta, (value, grad, hess) = new, result
                break
            size /= 2
        if not moved or gain < tol * (1 + abs(value)):
            break
    slopes = np.array([b / scale[c][1] for c, b in zip(covs, theta[1:-1])])
    constant = theta[0] - sum(b * scale[c][0] for c, b in zip(covs, slopes))
    return np.array([constant, *slopes]), float(np.exp(-theta[-1]))


def eb_fit(df: DataFrame, k: str, n: str, covs: Sequence[str] = (), low: float = 0.025, high: float = 0.975) -> DataFrame:
    """Shrunken rate per entity from a fitted prior, with its credible interval."""
    coefs, sigma = eb_coefficients(df, k, n, covs)
    mu = F.lit(float(coefs[0]))
    for c, b in zip(covs, coefs[1:]):
        mu = mu + F.col(c) * F.lit(float(b))
    prior = df.withColumns({"mu": mu, "sigma": F.lit(sigma)}).withColumns(
        {"alpha0": F.col("mu") / F.col("sigma"), "beta0": (1 - F.col("mu")) / F.col("sigma")}
    )
    post = prior.withColumns({"alpha": F.col("alpha0") + F.col(k), "beta": F.col("beta0") + F.col(n) - F.col(k)})
    out = credible(post, low, high).withColumnRenamed("mean", "estimate")
    return out.withColumn("raw", F.try_divide(F.col(k).cast("double"), F.col(n)))


def _generator(seed: int, *key) -> np.random.Generator:
    """Random stream fixed by the key and seed, wherever the row is processed."""
    return np.random.default_rng([seed, int.from_bytes(blake2b(repr(key).encode(), digest_size=16).digest())])


def posterior_win_prob(df: DataFrame, key: Sequence[str], a: str, b: str, n: int = 1000, seed: int = 123) -> DataFrame:
    """P(a > b) from ``n`` draws per row; ``a`` and ``b`` prefix the alpha and beta columns."""
    key = list(key)
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join([*[f"`{k}` {types[k]}" for k in key], "win_prob double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            wins = []
            for row in pdf.itertuples(index=False):
                rng = _generator(seed, *[str(getattr(row, k)) for k in key])
                first = rng.beta(getattr(row, f"{a}_alpha"), getattr(row, f"{a}_beta"), n)
                second = rng.beta(getattr(row, f"{b}_alpha"), getattr(row, f"{b}_beta"), n)
                wins.append(float(np.mean(first > second)))
            yield pdf[key].assign(win_prob=wins)

    return spread(df, *key).mapInPandas(run, schema)


def versus(posteriors: DataFrame, t: str, entity: str, a: str, b: str) -> DataFrame:
    """One row per step with the parameters of two named entities side by side."""
    pick = lambda name, prefix: posteriors.filter(F.col(entity) == name).select(
        t, F.col("alpha").alias(f"{prefix}_alpha"), F.col("beta").alias(f"{prefix}_beta")
    )
    return pick(a, "a").join(pick(b, "b"), t)


def versus_leader(posteriors: DataFrame, t: str, entity: str) -> DataFrame:
    """Per step every entity against the one of highest posterior mean (ties: the least entity).

    The leaders fold map-side to one row per step, so the join has a small side.
    """
    mean = F.col("alpha") / (F.col("alpha") + F.col("beta"))
    best = F.min_by(F.struct(F.col(entity).alias("leader"), F.col("alpha").alias("b_alpha"), F.col("beta").alias("b_beta")), F.struct(-mean, entity))
    leaders = posteriors.groupBy(t).agg(best.alias("_best")).select(t, "_best.*")
    sides = posteriors.select(t, entity, F.col("alpha").alias("a_alpha"), F.col("beta").alias("a_beta"))
    return sides.join(leaders, t).filter(F.col(entity) != F.col("leader"))


def posterior_predictive(
    df: DataFrame, entity: str, trials: int, points: float, n: int = 1000, seed: int = 2018
) -> DataFrame:
    """``n`` simulated seasons per entity: a rate draw, a binomial draw, points."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = f"`{entity}` {types[entity]}, draw int, successes bigint, season_pts double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, a, b in zip(pdf[entity], pdf["alpha"], pdf["beta"]):
                rng = _generator(seed, str(name))
                made = rng.binomial(trials, rng.beta(a, b, n))
                yield pd.DataFrame({entity: name, "draw": np.arange(n, dtype="int32"), "successes": made, "season_pts": made * points})

    given = df.select(entity, F.col("alpha").cast("double"), F.col("beta").cast("double"))
    return spread(given, entity).mapInPandas(run, schema)


def paired_diff(df: DataFrame, entity: str, draw: str, value: str, a, b) -> DataFrame:
    """Share of draws where ``a`` beats ``b`` and the 5/50/95 % quantiles of the difference."""
    left = df.filter(F.col(entity) == a).select(draw, F.col(value).alias("_a"))
    right = df.filter(F.col(entity) == b).select(draw, F.col(value).alias("_b"))
    both = left.join(right, draw).withColumn("diff", F.col("_a") - F.col("_b"))
    spread = quantiles(both, [], "diff", {"q05": 0.05, "q50": 0.5, "q95": 0.95})
    won = both.agg(F.avg((F.col("_a") > F.col("_b")).cast("double")).alias("pct_greater")).scalar()
    return spread.select(won.alias("pct_greater"), "q05", "q50", "q95")
