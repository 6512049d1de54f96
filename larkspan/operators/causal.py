"""Effect of a 0/1 treatment: naive, weighted by propensity, bootstrapped."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspan.functions.scalar import clip
from larkspan.operators.aggregates import quantiles
from larkspan.session import checkpoint


def group_means(df: DataFrame, y: str, treat: str, weight: str | None = None) -> DataFrame:
    """Weighted outcome totals of both groups in one row."""
    w = F.col(weight) if weight else F.lit(1.0)
    part = lambda v, c: F.sum(F.when(F.col(treat) == v, c))
    return df.filter(F.col(y).isNotNull()).agg(
        *[part(v, w).alias(f"w{v}") for v in (0, 1)], *[part(v, w * F.col(y)).alias(f"y{v}") for v in (0, 1)]
    )


def naive_effect(df: DataFrame, y: str, treat: str) -> DataFrame:
    """Difference of the plain group means."""
    g = group_means(df, y, treat)
    m0, m1 = F.col("y0") / F.col("w0"), F.col("y1") / F.col("w1")
    return g.select(m0.alias("mean_control"), m1.alias("mean_treated"), (m1 - m0).alias("effect"))


def glm_effect(df: DataFrame, y: str, treat: str, weight: str | None = None) -> DataFrame:
    """Poisson regression on the treatment flag: coefficients, errors and effect.

    With one binary regressor the model is saturated, so its fit is the two
    weighted means and no iteration is needed. The effect is on the count scale:
    exp(b0 + b1) - exp(b0).
    """
    g = group_means(df, y, treat, weight)
    m0, m1 = F.col("y0") / F.col("w0"), F.col("y1") / F.col("w1")
    return g.select(
        F.log(m0).alias("intercept"),
        (F.log(m1) - F.log(m0)).alias("coefficient"),
        F.sqrt(1 / F.col("y0")).alias("se_intercept"),
        F.sqrt(1 / F.col("y0") + 1 / F.col("y1")).alias("se_coefficient"),
        (m1 - m0).alias("effect"),
    )


def propensity_model(df: DataFrame, treat: str, covs: Sequence[str], rows: str | None = None) -> PipelineModel:
    """Logistic regression of the treatment on the covariates.

    Rows are counted per distinct covariate cell: the label is the treated
    share and the weight the number of rows, which gives the fit on the rows.
    ``rows`` names a column of repeat counts.
    """
    n = F.col(rows).cast("double") if rows else F.lit(1.0)
    share = [(F.sum(F.col(treat) * n) / F.sum(n)).alias("_share"), F.sum(n).alias("_n")]
    cells = df.na.drop(subset=[treat, *covs]).groupBy(*covs).agg(*share)
    assembler = VectorAssembler(inputCols=list(covs), outputCol="_x", handleInvalid="skip")
    glr = GeneralizedLinearRegression(
        family="binomial", link="logit", labelCol="_share", featuresCol="_x", weightCol="_n", predictionCol="propensity", maxIter=50, tol=1e-10
    )
    return PipelineModel([assembler, glr.fit(assembler.transform(cells))])


def propensity(df: DataFrame, treat: str, covs: Sequence[str], rows: str | None = None) -> DataFrame:
    """Treatment probability per row."""
    return propensity_model(df, treat, covs, rows).transform(df).drop("_x")


def iptw(p: Column, treat: Column) -> Column:
    """Inverse-probability weight: 1/p treated, 1/(1-p) control."""
    return 1 / F.when(treat == 0, 1 - p).otherwise(p)


def trim_weights(df: DataFrame, w: str, q: float = 0.99, rows: str | None = None) -> DataFrame:
    """Weights above their own quantile are set to it; ``rows`` names a column of repeat counts."""
    limit = quantiles(df, [], w, {"limit": q}, weight=rows).scalar()
    return df.withColumn(w, clip(F.col(w), high=limit))


def weighted_effect(df: DataFrame, y: str, treat: str, covs: Sequence[str], q: float = 0.99) -> DataFrame:
    """Propensity, weights, truncation and effect in one go.

    Rows with the same treatment, covariates and outcome weigh the same, so the
    steps run on counted cells and the rows are read once for them.
    """
    cells = df.groupBy(treat, *covs, y).agg(F.count(F.lit(1)).alias("_rows"))
    scored = propensity(cells, treat, covs, "_rows").withColumn("iptw", iptw(F.col("propensity"), F.col(treat)))
    trimmed = trim_weights(scored, "iptw", q, "_rows").withColumn("_w", F.col("iptw") * F.col("_rows"))
    return glm_effect(trimmed, y, treat, "_w")


@F.pandas_udf(T.LongType())
def _poisson(mean: pd.Series, u: pd.Series) -> pd.Series:
    """Poisson counts by inversion of uniform numbers, a table for each distinct mean."""
    means, uniform = mean.to_numpy(float), u.to_numpy(float)
    out = np.empty(len(means), np.int64)
    order = np.argsort(means, kind="stable")
    values, starts = np.unique(means[order], return_index=True)
    for m, at in zip(values, np.split(order, starts[1:])):
        low = max(0, int(m - 12 * np.sqrt(m) - 12))
        k = np.arange(low + 1, int(m + 12 * np.sqrt(m) + 40))
        logs = np.concatenate([[0.0], np.cumsum(np.log(m) - np.log(k))])
        weights = np.cumsum(np.exp(logs - logs.max()))
        out[at] = low + np.searchsorted(weights, uniform[at] * weights[-1], side="right")
    return pd.Series(out)


def bootstrap_replicates(df: DataFrame, y: str, treat: str, covs: Sequence[str], n: int = 500, seed: int = 1, q: float = 0.99) -> DataFrame:
    """Effect in ``n`` resamples and in the data itself (replicate 0).

    Rows are first counted per distinct (treatment, covariates, outcome) cell. In
    a resample every cell draws a Poisson count from a hash of seed, replicate
    and cell, so the result depends neither on partitioning nor on size. All
    replicates are fitted at once: a logistic step groups by replicate and needs
    one gradient and one Hessian of each, so only those come back between steps.
    A resample without both treatments has no effect (null).
    """
    covs = list(covs)
    cells = checkpoint(df.groupBy(treat, *covs, y).agg(F.count(F.lit(1)).alias("n")).na.drop())
    runs = cells.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(n))))
    # The upper 53 bits of a hash as a number from 0 to 1.
    uniform = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "replicate", treat, *covs, y), 11) * F.lit(2.0**-53)
    counts = F.when(F.col("replicate") == 0, F.col("n")).otherwise(_poisson(F.col("n").cast("double"), uniform))
    data = checkpoint(runs.withColumn("_c", counts).filter(F.col("_c") > 0))
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in covs]]
    size = len(x)
    total = data.groupBy("replicate").agg(F.sum(F.col(treat) * F.col("_c")).alias("t"), F.sum("_c").alias("c")).collect()
    start = lambda t, c: np.log((t + 0.5) / (c - t + 0.5))
    betas = {r["replicate"]: np.array([start(r["t"], r["c"]), *np.zeros(size - 1)]) for r in total}

    def fitted() -> DataFrame:
        rows = [(r, [float(v) for v in b]) for r, b in betas.items()]
        known = data.sparkSession.createDataFrame(rows, "replicate int, _b array<double>")
        eta = sum((F.col("_b")[i] * x[i] for i in range(1, size)), F.col("_b")[0])
        return data.join(known, "replicate").withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), eta))))).drop("_b")

    for _ in range(50):
        p, c = F.col("_p"), F.col("_c")
        slopes = [F.sum(c * (F.col(treat) - p) * x[i]) for i in range(size)]
        curves = [F.sum(c * p * (1 - p) * x[i] * x[j]) for i in range(size) for j in range(size)]
        largest = 0.0
        for r in fitted().groupBy("replicate").agg(F.array(*slopes).alias("g"), F.array(*curves).alias("h")).collect():
            step = np.linalg.solve(np.array(r["h"]).reshape(size, size) + 1e-12 * np.eye(size), np.array(r["g"]))
            betas[r["replicate"]] = betas[r["replicate"]] + step
            largest = max(largest, float(np.max(np.abs(step))))
        if largest < 1e-9:
            break
    weighted = fitted().withColumn("_w", iptw(F.col("_p"), F.col(treat)))
    limits = quantiles(weighted, ["replicate"], "_w", {"_limit": q}, weight="_c")
    used = F.least("_w", "_limit") * F.col("_c")
    mean = lambda v: F.sum(F.when(F.col(treat) == v, used * F.col(y))) / F.sum(F.when(F.col(treat) == v, used))
    # Digits beyond the fit's tolerance depend on the order of the sums.
    return weighted.join(limits, "replicate").groupBy("replicate").agg(F.round(mean(1) - mean(0), 9).alias("effect"))


def bootstrap_effect(df: DataFrame, y: str, treat: str, covs: Sequence[str], n: int = 500, seed: int = 1, q: float = 0.99) -> DataFrame:
    """2.5, 50 and 97.5 percentiles of the bootstrapped effect, the original sample included."""
    reps = bootstrap_replicates(df, y, treat, covs, n, seed, q)
    return reps.agg(F.percentile("effect", F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("p")).select(
        F.col("p")[0].alias("lb"), F.col("p")[1].alias("mdn"), F.col("p")[2].alias("ub")
    )
