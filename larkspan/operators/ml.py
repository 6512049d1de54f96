"""Splits, features, boosted trees and local explanations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from fractions import Fraction
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.operators.boosting import BoostedTrees, fitted, grown
from larkspan.operators.sets import hash_key
from larkspan.operators.windows import with_ntile
from larkspan.plans.ordered import with_position
from larkspan.session import checkpoint


class Predictor(Protocol):
    """Anything that adds a ``prediction`` column."""

    def transform(self, df: DataFrame) -> DataFrame: ...


def split(df: DataFrame, key: Sequence[str], frac: float = 0.75, seed: int = 2021, out: str = "part") -> DataFrame:
    """``train`` or ``test`` by a hash of the key: the same rows on every run and partitioning."""
    limit = f"{int(frac * 16**8):08x}"
    return df.withColumn(out, F.when(F.substring(hash_key(key, seed), 1, 8) < limit, "train").otherwise("test"))


def kfold(
    df: DataFrame, key: Sequence[str], y: str, k: int = 5, strata: int = 4, seed: int = 2021, out: str = "fold", blocks=None
) -> DataFrame:
    """Fold 0..k-1, balanced inside quantile strata of ``y``."""
    tiled = with_ntile(df, [F.col(y), *map(F.col, key)], strata, out="_stratum", blocks=blocks)
    hashed = tiled.withColumn("_hash", hash_key(key, seed))
    placed = with_position(hashed, ["_stratum"], [F.col("_hash"), *map(F.col, key)], "_at", blocks=blocks, derived=True)
    return placed.withColumn(out, ((F.col("_at") - 1) % k).cast("int")).drop("_stratum", "_hash", "_at")


def multi_hot(df: DataFrame, key: Sequence[str], col: str, values: Mapping[str, str], sep: str = ", ") -> DataFrame:
    """Label counts per key, one column per label (``values`` maps label to column name).

    Labels are counted inside each cell, so only one row per input row is shuffled.
    """
    cells = F.split(col, sep)

    def count_of(label: str) -> Column:
        return F.size(F.filter(cells, lambda c: c == label))

    flags = {name: count_of(label) for label, name in values.items()}
    return df.select(*key, *[c.alias(n) for n, c in flags.items()]).groupBy(*key).agg(*[F.sum(n).alias(n) for n in flags])


def nzv_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: ratio of the two largest value counts and percent of distinct values."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot([], list(cols), "name", "value")
    counts = long.filter(F.col("value").isNotNull()).groupBy("name", "value").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("name").orderBy(F.desc("n"), "value")
    top = counts.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= 2)
    two = top.groupBy("name").agg(F.max("n").alias("first"), F.max(F.when(F.col("_at") == 2, F.col("n"))).alias("second"))
    sizes = counts.groupBy("name").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_rows"))
    return two.join(sizes, "name").select(
        "name",
        F.coalesce(F.col("first") / F.col("second"), F.lit(0.0)).alias("freq_ratio"),
        (F.col("n_values") / F.col("n_rows") * 100).alias("pct_unique"),
        (F.col("n_values") == 1).alias("constant"),
    )


def near_zero(stats: DataFrame, freq: float = 95 / 5, unique: float = 10) -> DataFrame:
    return stats.withColumn(
        "near_zero", F.col("constant") | ((F.col("freq_ratio") > freq) & (F.col("pct_unique") <= unique))
    )


def drop_nzv(df: DataFrame, cols: Sequence[str], freq: float = 95 / 5, unique: float = 10) -> DataFrame:
    """Drop the columns that hardly vary."""
    rows = near_zero(nzv_stats(df, cols), freq, unique).filter("near_zero").select("name").collect()
    return df.drop(*[r["name"] for r in rows])


def fit_gbt(
    df: DataFrame, x: Sequence[str], y: str, trees: int = 100, mtry: int | None = None, rate: float = 0.01, depth: int = 6, seed: int = 1
) -> BoostedTrees:
    """Boosted regression trees; rows with a missing feature or target are left out."""
    data, stored = df.select(*x, y).dropna(), df.storageLevel
    if not (stored.useMemory or stored.useDisk):  # else its rows are read from where they are
        data.persist()
    try:
        return fitted(data, x, y, trees, mtry, rate, depth, seed)
    finally:
        data.unpersist()


def tune(
    df: DataFrame, x: Sequence[str], y: str, mtry: Sequence[int], trees: Sequence[int], fold: str = "fold",
    folds: int = 5, rate: float = 0.01, depth: int = 6, seed: int = 123,
) -> DataFrame:
    """Mean absolute error of every (mtry, trees) point over the folds.

    One fit per fold and mtry grows the longest model, all of them in the same
    pass; shorter ones are its first trees, so their errors are read off on the
    way.
    """
    fits = [(m, f) for m in mtry for f in range(folds)]
    plan = {
        "mtry": tuple(min(m, len(x)) for m, _ in fits), "left_out": tuple(f for _, f in fits), "trees": max(trees), "rate": rate, "depth": depth,
        "seed": seed, "staged": tuple(trees),
    }
    # Read several times and by a result that is still to run, so it is cut from its input.
    data = checkpoint(df.select(*x, y, fold).dropna())
    errors, _ = grown(data, x, y, fold, plan)
    per_fold = errors.groupBy("fit", "trees").agg((F.sum("error") / F.sum("n")).alias("error"))
    at = F.array(*[F.lit(m) for m, _ in fits])
    scores = per_fold.select(F.element_at(at, F.col("fit") + 1).alias("mtry"), "trees", "error")
    return scores.groupBy("mtry", "trees").agg(F.avg("error").alias("mae"), F.stddev("error").alias("sd"))


def mae(df: DataFrame, y: str, yhat: str) -> DataFrame:
    return df.agg(F.avg(F.abs(F.col(y) - F.col(yhat))).alias("mae"))


def importance(df: DataFrame, model: BoostedTrees, names: Sequence[str]) -> DataFrame:
    """Share of the drop in squared error that each feature's splits bring, largest first. ``df`` only supplies the session."""
    total = model.gains.sum() or 1.0
    rows = [(n, float(v / total)) for n, v in zip(names, model.gains)]
    return df.sparkSession.createDataFrame(rows, "feature string, gain double").orderBy(F.desc("gain"), "feature")


def _fixed_means(model: Predictor, background: DataFrame, x: Sequence[str], row: Mapping[str, float], sets: Sequence[frozenset]) -> dict:
    """Mean prediction over the background with each set of features fixed at the row's values.

    The background is read once: every row is scored once per set. Rows that ``model.alike`` counted (``_n``) and that
    have become equal, as most do with features fixed, are added up first where that surely takes away half of them.
    """
    counted = hasattr(model, "alike")
    columns = [c for c in background.columns if not (counted and c == "_n")]
    steps = background.withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(sets) - 1))))
    fixed = {}
    for name in columns:
        at = [i for i, s in enumerate(sets) if name in s]
        if at:
            fixed[name] = F.when(F.col("_step").isin(at), F.lit(float(row[name]))).otherwise(F.col(name))
    steps = steps.withColumns(fixed) if fixed else steps
    if not counted:
        found = model.transform(steps).groupBy("_step").agg(F.avg("prediction").alias("m")).collect()
        return {sets[r["_step"]]: r["m"] for r in found}
    # Whole numbers: a feature without an effect leaves the mean exactly as it is, however rows are dealt.
    whole = F.rint(F.col("prediction") * F.lit(float(model.scale))).cast("decimal(19,0)") * F.col("_n").cast("decimal(18,0)")
    rows = background.count()
    if 2 * sum(min(rows, model.kinds([c for c in columns if c not in s])) for s in sets) <= rows * len(sets):
        steps = steps.groupBy("_step", *columns).agg(F.sum("_n").alias("_n"))
    found = model.transform(steps).groupBy("_step").agg(F.sum(whole).alias("total"), F.sum("_n").alias("n")).collect()
    return {sets[r["_step"]]: float(Fraction(r["total"]) / r["n"] / Fraction(model.scale)) for r in found}


def break_down(model: Predictor, background: DataFrame, x: Sequence[str], row: Mapping[str, float]) -> DataFrame:
    """Local attribution: from the mean prediction to the row's, one feature at a time.

    Features enter by the size of the change each makes on its own. A model that says which rows it scores alike
    (``alike``) scores one for all of them, so that scoring grows with what it can tell apart, not with rows.
    """
    x = list(x)
    data = background.select(*x)
    if hasattr(model, "alike"):
        data = checkpoint(model.alike(data))  # read twice, in few partitions
    means = _fixed_means(model, data, x, row, [frozenset(), *[frozenset([n]) for n in x]])
    none = means[frozenset()]
    order = sorted(x, key=lambda n: (-abs(means[frozenset([n])] - none), n))
    longer = [frozenset(order[:i]) for i in range(2, len(order) + 1)]
    if longer:
        means |= _fixed_means(model, data, x, row, longer)
    at = [means[frozenset(order[:i])] for i in range(len(order) + 1)]
    rows = [(0, "intercept", None, at[0], at[0])]
    rows += [(i, n, float(row[n]), at[i] - at[i - 1], at[i]) for i, n in enumerate(order, 1)]
    rows.append((len(order) + 1, "prediction", None, at[-1], at[-1]))
    return background.sparkSession.createDataFrame(rows, "step int, feature string, value double, contribution double, cumulative double")


def score(model: Predictor, rows: DataFrame) -> DataFrame:
    return model.transform(rows)
