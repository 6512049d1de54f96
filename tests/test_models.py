import math
import time

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from larkspan.functions import special as Z
from larkspan.operators import bayes as B
from larkspan.operators import causal as C
from larkspan.operators import geo as P
from larkspan.operators import boosting as B2
from larkspan.operators import ml as M
from larkspan.operators import stats as S
from larkspan.operators.aggregates import lump, mean_ci
from larkspan.plans.catalog import QUERIES


def test_beta_identities():
    rng = np.random.default_rng(1)
    a, b, x = rng.uniform(0.05, 300, 500), rng.uniform(0.05, 300, 500), rng.uniform(0, 1, 500)
    assert np.allclose(Z.betainc(a, b, x) + Z.betainc(b, a, 1 - x), 1, atol=1e-12)
    assert np.allclose(Z.betainc(a, np.ones(500), x), x**a, atol=1e-12)
    n, k = 12, 5
    tail = sum(math.comb(n, j) * 0.3**j * 0.7 ** (n - j) for j in range(k, n + 1))
    assert np.isclose(Z.betainc(k, n - k + 1, 0.3), tail)


def test_beta_quantiles():
    for a, b in [(8, 22), (0.5, 0.5), (1, 1), (5000, 3), (1e5, 2e5), (0.2, 40)]:
        q = np.array([0.001, 0.05, 0.5, 0.95, 0.999])
        assert np.allclose(Z.betainc(a, b, Z.betaincinv(a, b, q)), q, atol=1e-8)
    assert list(Z.betaincinv(2, 3, [0.0, 1.0])) == [0.0, 1.0]


def test_beta_quantiles_stop_at_rounding_and_wait_for_none(monkeypatch):
    seen, plain = [], Z.betainc
    monkeypatch.setattr(Z, "betainc", lambda a, b, x: seen.append(np.size(x)) or plain(a, b, x))
    a, b = np.array([2.0] * 99 + [3e6]), np.array([3.0] * 99 + [7e6])
    found = Z.betaincinv(a, b, 0.025)
    assert np.allclose(plain(a, b, found), 0.025, rtol=1e-8)
    assert sum(seen) < 12 * len(a) and len(seen) < 40


def test_credible_intervals_are_dealt_evenly(spark):
    few = spark.range(40).select((F.col("id") + 1.0).alias("alpha"), F.lit(2.0).alias("beta")).coalesce(1)
    found = B.credible(few)
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and found.count() == 40


def test_gamma_derivatives():
    x = np.array([0.1, 1.0, 2.5, 40.0])
    h = 1e-5
    assert np.allclose(Z.digamma(x), (Z.lgamma(x + h) - Z.lgamma(x - h)) / (2 * h), atol=1e-6)
    assert np.isclose(Z.digamma(1.0), -0.5772156649015329) and np.isclose(Z.trigamma(1.0), math.pi**2 / 6)


def test_student_p():
    assert np.isclose(Z.students_p(12.706204736, 1), 0.05) and np.isclose(Z.students_p(0.0, 7), 1.0)


def test_mann_kendall_by_pairs(spark):
    rng = np.random.default_rng(3)
    data = [(k, i, float(v)) for k in range(5) for i, v in enumerate(rng.integers(0, 6, 15))]
    out = {r["k"]: r for r in S.mann_kendall(spark.createDataFrame(data, "k int, t int, y double"), ["k"], "t", "y").collect()}
    for k in range(5):
        y = [v for g, _, v in data if g == k]
        s = sum(np.sign(y[j] - y[i]) for i in range(15) for j in range(i + 1, 15))
        ties = sum(c * (c - 1) * (2 * c + 5) for c in pd.Series(y).value_counts())
        var = (15 * 14 * 35 - ties) / 18
        z = 0 if s == 0 else (s - np.sign(s)) / math.sqrt(var)
        assert out[k]["s"] == s and np.isclose(out[k]["z"], z) and np.isclose(out[k]["p_value"], math.erfc(abs(z) / math.sqrt(2)))


def test_spearman_and_adjustment(spark):
    df = spark.createDataFrame([("m", float(i), float(i * i)) for i in range(10)] + [("n", float(i), float(i % 3)) for i in range(10)], "k string, x double, y double")
    out = {r["k"]: r for r in S.spearman_by(df, ["k"], "x", "y").collect()}
    assert np.isclose(out["m"]["estimate"], 1) and out["m"]["p_value"] < 1e-9
    pd_value = pd.Series(range(10)).corr(pd.Series([i % 3 for i in range(10)]), method="pearson")
    assert abs(out["n"]["estimate"] - pd.Series(range(10)).rank().corr(pd.Series([i % 3 for i in range(10)]).rank())) < 1e-12 and pd_value is not None
    p = [0.01, 0.04, 0.03, 0.005, 0.9]
    adj = dict(rows(S.p_adjust_bh(spark.createDataFrame(list(enumerate(p)), "i int, p double"), "p", ["i"]), "i", "p_adj"))
    assert np.allclose([adj[i] for i in range(5)], [0.025, 0.05, 0.05, 0.025, 0.9])


@pytest.fixture(scope="module")
def customers(spark):
    """Purchases with a known membership effect of 0.1, confounded by engagement."""
    rng = np.random.default_rng(2021)
    n = 20000
    pre = np.concatenate([rng.poisson(0.75, n), rng.poisson(1.0, n)])
    tile = np.argsort(np.argsort(pre, kind="stable"), kind="stable") * 3 // len(pre)
    member = rng.binomial(1, np.choose(tile, [0.2, 0.3, 0.4]))
    post = rng.poisson(pre + 0.1 * member)
    return spark.createDataFrame(pd.DataFrame({"pre": pre, "member": member, "post": post})).cache()


def test_effects_recovered(customers):
    naive = C.naive_effect(customers, "post", "member").first()["effect"]
    weighted = C.weighted_effect(customers, "post", "member", ["pre"]).first()
    assert 0.2 < naive < 0.4 and abs(weighted["effect"] - 0.1) < 0.05
    assert np.isclose(math.exp(weighted["intercept"] + weighted["coefficient"]) - math.exp(weighted["intercept"]), weighted["effect"])
    band = C.bootstrap_effect(customers, "post", "member", ["pre"], n=100, seed=1).first()
    assert band["lb"] < 0.1 < band["ub"] and band["ub"] - band["lb"] < 0.12
    reps = C.bootstrap_replicates(customers, "post", "member", ["pre"], n=3, seed=1)
    assert reps.count() == 4
    original = reps.filter("replicate = 0").first()["effect"]
    assert np.isclose(original, weighted["effect"], atol=1e-4)


def test_saturated_fit_equals_iteration(customers):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    data = VectorAssembler(inputCols=["member"], outputCol="x").transform(customers)
    fit = GeneralizedLinearRegression(family="poisson", labelCol="post", featuresCol="x").fit(data)
    mine = C.glm_effect(customers, "post", "member").first()
    assert np.isclose(fit.intercept, mine["intercept"]) and np.isclose(fit.coefficients[0], mine["coefficient"])
    assert np.allclose(sorted(fit.summary.coefficientStandardErrors), sorted([mine["se_intercept"], mine["se_coefficient"]]), rtol=1e-4)


def test_replicates_match_resampled_rows(customers):
    def brute(pdf):
        w = 1 / np.where(pdf["member"] == 1, pdf["p"], 1 - pdf["p"])
        w, y, m = np.minimum(w, np.quantile(w, 0.99)), pdf["post"].to_numpy(float), pdf["member"].to_numpy()
        return np.average(y[m == 1], weights=w[m == 1]) - np.average(y[m == 0], weights=w[m == 0])

    mine = C.bootstrap_replicates(customers, "post", "member", ["pre"], n=100, seed=1).toPandas().set_index("replicate")["effect"]
    pdf = C.propensity(customers, "member", ["pre"]).select("post", "member", "propensity").toPandas().rename(columns={"propensity": "p"})
    drawn = np.array([brute(pdf.sample(len(pdf), replace=True, random_state=i)) for i in range(100)])
    assert len(mine) == 101 and np.isclose(mine[0], brute(pdf), atol=1e-4)
    assert abs(mine[1:].mean() - drawn.mean()) < 0.01 and 0.75 < mine[1:].std() / drawn.std() < 1.33


def test_replicates_do_not_depend_on_partitions(customers):
    args = ("post", "member", ["pre"])
    one, many = (C.bootstrap_replicates(customers.repartition(k), *args, n=5, seed=3).toPandas().set_index("replicate")["effect"].sort_index() for k in (1, 7))
    assert np.allclose(one, many, atol=1e-9)


def test_poisson_counts(spark):
    draws = spark.range(60000).selectExpr("id", "array(0.5, 3, 5000)[id % 3] AS m").withColumn("u", F.shiftrightunsigned(F.xxhash64("id"), 11) * F.lit(2.0**-53))
    out = draws.withColumn("c", C._poisson(F.col("m").cast("double"), "u")).groupBy("m").agg(F.avg("c"), F.var_samp("c")).collect()
    assert len(out) == 3 and all(abs(r[1] / float(r[0]) - 1) < 0.03 and abs(r[2] / float(r[0]) - 1) < 0.06 for r in out)


def test_prior_update(spark):
    df = spark.createDataFrame([("Flacco", 8, 22), ("Mariota", 0, 0)], "player string, s int, f int")
    out = dict((r["player"], r) for r in B.beta_update(df, "s", "f", F.lit(0), F.lit(0)).filter("s > 0").collect())
    assert (out["Flacco"]["alpha"], out["Flacco"]["beta"]) == (8, 22) and round(out["Flacco"]["mean"], 5) == 0.26667


def test_evolution_carries_forward(spark):
    events = spark.createDataFrame([("a", 1, 1), ("a", 3, 0), ("b", 2, 1)], "p string, w int, s int")
    grid = spark.createDataFrame([(p, w) for p in "ab" for w in (1, 2, 3)], "p string, w int")
    priors = spark.createDataFrame([("a", 8, 22)], "p string, prior_alpha int, prior_beta int")
    out = rows(B.beta_evolution(events, ["p"], "w", "s", grid, priors), "p", "w", "alpha", "beta")
    assert out == [("a", 1, 9, 22), ("a", 2, 9, 22), ("a", 3, 9, 23), ("b", 1, 1, 1), ("b", 2, 2, 1), ("b", 3, 2, 1)]


def test_prior_fit_recovers_parameters(spark):
    rng = np.random.default_rng(5)
    n = rng.integers(30, 400, 3000)
    k = rng.binomial(n, rng.beta(40, 10, 3000))
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "k": k, "n": n}))
    coefs, sigma = B.eb_coefficients(df, "k", "n")
    assert abs(coefs[0] - 0.8) < 0.005 and abs(sigma - 1 / 50) < 0.003
    out = B.eb_fit(df, "k", "n").toPandas()
    assert ((out["estimate"] - out["raw"]).abs().max() > 0) and (out["lower"] < out["estimate"]).all() and (out["estimate"] < out["upper"]).all()
    shrunk = (out["estimate"] - 0.8).abs() <= (out["raw"] - 0.8).abs() + 0.01
    assert shrunk.all()


def test_prior_fit_with_covariates(spark):
    rng = np.random.default_rng(6)
    n, decade = rng.integers(30, 600, 4000), rng.integers(0, 5, 4000)
    mu = 0.5 + 0.03 * np.log2(n) + 0.01 * decade
    k = rng.binomial(n, rng.beta(mu * 80, (1 - mu) * 80))
    df = spark.createDataFrame(pd.DataFrame({"k": k, "n": n, "log2n": np.log2(n), "decade": decade.astype(float)}))
    coefs, sigma = B.eb_coefficients(df, "k", "n", ["log2n", "decade"])
    assert np.allclose(coefs, [0.5, 0.03, 0.01], atol=[0.03, 0.004, 0.003]) and abs(sigma - 1 / 80) < 0.002


def test_everyone_meets_the_leader(spark):
    df = spark.createDataFrame([(1, "a", 8, 2), (1, "b", 5, 5), (1, "c", 4, 1), (2, "a", 1, 9)], "w int, who string, alpha int, beta int")
    out = rows(B.versus_leader(df, "w", "who"), "w", "who", "leader", "a_alpha", "b_beta")
    assert out == [(1, "b", "a", 5, 2), (1, "c", "a", 4, 2)]


def test_comparisons(spark):
    df = spark.createDataFrame([(1, 50.0, 10.0, 10.0, 50.0), (2, 5.0, 5.0, 5.0, 5.0)], "w int, a_alpha double, a_beta double, b_alpha double, b_beta double")
    won = dict(rows(B.posterior_win_prob(df, ["w"], "a", "b", n=4000)))
    assert won[1] > 0.999 and abs(won[2] - 0.5) < 0.04
    post = spark.createDataFrame([("good", 900.0, 100.0), ("bad", 700.0, 300.0)], "name string, alpha double, beta double")
    sims = B.posterior_predictive(post, "name", 27, 3.5, n=1000).cache()
    means = dict(rows(sims.groupBy("name").agg(F.avg("season_pts"))))
    assert abs(means["good"] - 0.9 * 27 * 3.5) < 1.5 and abs(means["bad"] - 0.7 * 27 * 3.5) < 1.5
    diff = B.paired_diff(sims, "name", "draw", "season_pts", "good", "bad").first()
    assert diff["pct_greater"] > 0.9 and diff["q05"] < diff["q50"] < diff["q95"]
    picks = spark.createDataFrame([(1, "x", 0.5), (1, "y", 0.5), (1, "z", 0.4)], "w int, p string, upper double")
    assert rows(B.ucb_pick(picks, "w", "p")) == [(1, "x", 0.5)]


def test_group_summaries(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",), (None,)], "c string")
    assert rows(lump(df, "c", 2, "2 or More").groupBy("c").count()) == [("2 or More", 1), ("a", 3), ("b", 2), (None, 1)]
    ci = mean_ci(spark.createDataFrame([("g", 1.0), ("g", 3.0)], "g string, y double"), ["g"], "y").first()
    assert np.isclose(ci["upper"] - ci["mean"], 1.96) and ci["n"] == 2


def test_split_and_folds(spark):
    df = spark.range(8000).withColumn("y", F.col("id") * 1.0)
    share = M.split(df, ["id"]).filter("part = 'train'").count() / 8000
    assert abs(share - 0.75) < 0.02
    folds = M.kfold(df, ["id"], "y")
    per = folds.withColumn("q", F.floor(F.col("y") / 2000)).groupBy("q", "fold").count().toPandas()
    assert len(per) == 20 and set(per["count"]) == {400}


def test_near_zero_variance(spark):
    df = spark.sql("SELECT IF(id = 0, 1, 0) AS rare, id % 2 AS even, 1 AS one, id FROM range(200)")
    assert M.drop_nzv(df, ["rare", "even", "one"]).columns == ["even", "id"]


@pytest.fixture(scope="module")
def trees(spark):
    df = spark.sql("SELECT id, CAST(id % 10 AS DOUBLE) AS a, CAST(id % 7 AS DOUBLE) AS b, CAST(id % 3 AS DOUBLE) AS noise FROM range(2000)")
    df = df.withColumn("y", 10 * F.col("a") + F.col("b")).cache()
    return df, M.fit_gbt(df, ["a", "b", "noise"], "y", trees=10, rate=0.3, depth=4)


def test_trees_learn_and_explain(trees):
    df, model = trees
    scored = model.transform(df)
    assert M.mae(scored, "y", "prediction").first()[0] < 5
    assert M.importance(df, model, ["a", "b", "noise"]).first()["feature"] == "a"
    row = {"a": 9.0, "b": 6.0, "noise": 0.0}
    parts = M.break_down(model, df, ["a", "b", "noise"], row).orderBy("step").collect()
    one = df.limit(1).withColumns({k: F.lit(v) for k, v in row.items()})
    assert np.isclose(parts[-1]["cumulative"], M.score(model, one).first()["prediction"])
    assert np.isclose(parts[0]["cumulative"] + sum(p["contribution"] for p in parts[1:-1]), parts[-1]["cumulative"])
    assert parts[1]["feature"] == "a"


class Plain:
    """A predictor that can't say which rows it scores alike."""

    def __init__(self, model):
        self.transform = model.transform


def by_hand(model, data, names, row):
    """break_down's features and means, row by row in numpy."""

    def mean(fixed):
        x = np.stack([np.full(len(data), row[n]) if n in fixed else data[n].to_numpy(np.float64) for n in names], 1)
        return math.fsum(model.predict(x[~np.isnan(x).any(1)])) / (~np.isnan(x).any(1)).sum()

    order = sorted(names, key=lambda n: (-abs(mean([n]) - mean([])), n))
    return order, [mean(order[:i]) for i in range(len(names) + 1)]


def test_break_down_scores_what_trees_tell_apart_not_rows(trees, monkeypatch):
    df, model = trees
    row, names, plain, scored = {"a": 9.0, "b": 6.0, "noise": 0.0}, ["a", "b", "noise"], B2.BoostedTrees.transform, []
    monkeypatch.setattr(B2.BoostedTrees, "transform", lambda self, rows: scored.append(rows.count()) or plain(self, rows))
    found, work = [], []
    for data in (df, df.unionAll(df).unionAll(df)):
        found.append([tuple(r) for r in M.break_down(model, data, names, row).orderBy("step").collect()])
        work.append(sum(scored))
        scored.clear()
    assert found[0] == found[1] and work[0] == work[1] < 1000  # 2,000 and 6,000 rows, 210 of them distinct
    order, means = by_hand(model, df.toPandas(), names, row)
    assert [r[1] for r in found[0]] == ["intercept", *order, "prediction"]
    assert np.allclose([r[4] for r in found[0]], [*means, means[-1]], rtol=1e-12)


def test_break_down_with_missing_and_odd_values(spark):
    names = ["a", "b", "idle"]
    inf, nan = float("inf"), float("nan")
    odd = [(inf, 1.0, 3.0), (-inf, 2.0, 3.0), (-0.0, 0.0, 3.0), (0.0, -0.0, 3.0), (None, 3.0, 3.0), (nan, 3.0, None), (2.0, None, 3.0), (1e300, -1e300, nan)] * 3
    some = [(float(i % 9 - 4), float(i % 5), 3.0) for i in range(300)]
    train = spark.createDataFrame([(*r, 10 * r[0] + r[1] ** 2) for r in some], "a double, b double, idle double, y double")
    model = M.fit_gbt(train, names, "y", trees=5, rate=0.5, depth=3)
    model.cut[1, 0], model.cut[1, 1], model.cut[2, 0] = -inf, 0.0, nan
    data, row = spark.createDataFrame(some + odd, "a double, b double, idle double"), {"a": 1.0, "b": 4.0, "idle": 7.0}
    parts = [[tuple(r) for r in M.break_down(m, data, names, row).orderBy("step").collect()] for m in (model, Plain(model))]
    order, means = by_hand(model, data.toPandas(), names, row)
    for found in parts:
        assert [r[1] for r in found] == ["intercept", *order, "prediction"]
        assert np.allclose([r[4] for r in found], [*means, means[-1]], rtol=1e-12)
    assert model.alike(data).count() < 80


def test_break_down_of_an_unused_feature_is_nothing(spark):
    df = spark.range(1000).select((F.col("id") % 10 * 1.0).alias("a"), (F.col("id") % 7 * 0.1).alias("b"), F.lit(2.0).alias("c"), F.lit(1.0).alias("d"))
    model = M.fit_gbt(df.withColumn("y", F.col("a") / 3 + F.col("b")), ["a", "b", "c", "d"], "y", trees=7, rate=0.3, depth=3)
    parts = M.break_down(model, df, ["d", "c", "b", "a"], {"a": 3.0, "b": 0.1, "c": 5.0, "d": -5.0}).orderBy("step").collect()
    assert [(r["feature"], r["contribution"]) for r in parts[3:5]] == [("c", 0.0), ("d", 0.0)]
    one = M.break_down(M.fit_gbt(df, ["a"], "b", trees=2, depth=2), df, ["a"], {"a": 3.0}).count()
    assert one == 3


def test_break_down_joins_its_rows_once(spark, sf, monkeypatch):
    held, fit, explain = [], M.fit_gbt, M.break_down
    stored = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    monkeypatch.setattr(M, "fit_gbt", lambda df, x, y: held.append(df.storageLevel.useMemory) or fit(df, x, y, trees=2, depth=2))
    monkeypatch.setattr(M, "break_down", lambda model, df, x, row: held.extend([df.storageLevel.useMemory, stored()]) or explain(model, df, x, row))
    before = stored()
    assert QUERIES["break_down"].run(spark, sf).count() == 8
    assert held == [True, True, before + 1] and stored() == before  # once, not again by the fit, and given back


def test_tuning_reads_stages(trees):
    df, _ = trees
    scores = M.tune(M.kfold(df, ["id"], "y", k=2), ["a", "b"], "y", [2], [1, 3, 6], folds=2, rate=0.3, depth=3).orderBy("trees").collect()
    errors = [r["mae"] for r in scores]
    assert errors == sorted(errors, reverse=True) and len(errors) == 3


class Asked(Exception):
    pass


@pytest.mark.parametrize("name", ["boosted_trees", "feature_importance", "break_down", "scored_hypotheticals", "tuned_trees"])
def test_queries_register_the_surveyed_trees(spark, sf, monkeypatch, name):
    asked = {}

    def fit(df, x, y, trees=100, mtry=None, rate=0.01, depth=6, seed=1):
        asked.update(trees=[trees], rate=rate, depth=depth)
        raise Asked

    def tune(df, x, y, mtry, trees, fold="fold", folds=5, rate=0.01, depth=6, seed=123):
        asked.update(mtry=list(mtry), trees=list(trees), rate=rate, depth=depth, folds=folds, seen=df.select(fold).distinct().count(), features=len(x))
        raise Asked

    monkeypatch.setattr(M, "fit_gbt", fit)
    monkeypatch.setattr(M, "tune", tune)
    with pytest.raises(Asked):
        QUERIES[name].run(spark, sf)
    assert min(asked["trees"]) >= 50 and (asked["rate"], asked["depth"]) == (0.01, 6)
    if name == "tuned_trees":
        assert asked["mtry"] == [2, 4, 6, 8] and asked["trees"] == list(range(50, 1001, 50))
        assert asked["folds"] == asked["seen"] == 5 and asked["features"] > 8


def test_trees_do_not_depend_on_how_rows_are_dealt(trees):
    """One task, or a barrier stage of several that add up their histograms: the same trees."""
    df, _ = trees
    one = B2.fitted(df, ["a", "b", "noise"], "y", trees=2, mtry=2, rate=0.3, depth=2, seed=4)
    many = B2.fitted(df, ["a", "b", "noise"], "y", trees=2, mtry=2, rate=0.3, depth=2, seed=4, rows_per_task=400)
    for part in ("feature", "cut", "leaf", "gains"):
        assert (getattr(one, part) == getattr(many, part)).all(), part
    plan = {"mtry": (1, 3), "left_out": (0, 1), "trees": 2, "rate": 0.3, "depth": 2, "seed": 4, "staged": (1, 2)}
    folded = df.withColumn("fold", F.col("id") % 2)
    found = []
    for rows in (10**6, 400):
        out, _ = B2.grown(folded, ["a", "b", "noise"], "y", "fold", plan, rows)
        found.append([tuple(r) for r in out.groupBy("fit", "trees").agg(F.sum("error"), F.sum("n")).orderBy("fit", "trees").collect()])
    assert np.allclose(found[0], found[1], rtol=1e-9) and [r[3] for r in found[0]] == [1000] * 4


def test_blocks_of_cells_take_a_job_a_level(trees):
    """44 levels in blocks, over a checkpoint of them; an all-gather a level would take 44 seconds and more."""
    df, _ = trees
    one = B2.fitted(df, ["a", "b", "noise"], "y", trees=22, mtry=None, rate=0.3, depth=2, seed=4)
    began = time.monotonic()
    many = B2.fitted(df, ["a", "b", "noise"], "y", trees=22, mtry=None, rate=0.3, depth=2, seed=4, rows_per_task=400)
    assert time.monotonic() - began < 35
    assert (one.feature == many.feature).all() and (one.cut == many.cut).all() and (one.leaf == many.leaf).all()


def test_rows_of_equal_bins_are_one_cell(spark):
    df = spark.range(600).select((F.col("id") % 3).cast("double").alias("a"), (F.col("id") % 2).cast("double").alias("b"), (F.col("id") % 7).alias("fold"), (F.col("id") * 1.5).alias("y"))
    cells = B2._cells(df.select("a", "b", "y", "fold"), B2.cut_points(df, ["a", "b"]), 2.0)
    assert cells.count() == 42
    assert tuple(cells.agg(F.sum("n"), F.sum("y")).first()) == (600, 3 * sum(range(600)))


def test_trees_match_the_ml_library(spark, sf):
    """Held-out error of one fold against Spark ML, whose squared-error gradient is twice the residual: half the rate there."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    rng = np.random.default_rng(2)
    x = rng.uniform(0, 1, (3000, 3))
    y = 10 * np.sin(6 * x[:, 0]) + 5 * (x[:, 1] > 0.4) * x[:, 2] + rng.normal(0, 0.5, 3000)
    df = spark.createDataFrame([(i, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))], "id long, a double, b double, c double, y double").repartition(4).cache()
    train, test = df.where("id % 5 <> 0"), df.where("id % 5 = 0")
    own = M.mae(M.fit_gbt(train, ["a", "b", "c"], "y", trees=40, rate=0.05, depth=5).transform(test), "y", "prediction").first()[0]
    features = VectorAssembler(inputCols=["a", "b", "c"], outputCol="f")
    model = GBTRegressor(labelCol="y", featuresCol="f", maxIter=40, stepSize=0.025, maxDepth=5, seed=1).fit(features.transform(train))
    library = M.mae(model.transform(features.transform(test)), "y", "prediction").first()[0]
    assert abs(own - library) < 0.02 * library  # cut points differ


def test_trees_leave_out_missing_values_and_bear_constants(spark):
    rows = [(float(i % 2), 1.0, float(i % 2) * 4) for i in range(50)] + [(None, 1.0, 9.0), (float("nan"), 1.0, 9.0), (1.0, 1.0, None)]
    df = spark.createDataFrame(rows, "a double, same double, y double")
    model = M.fit_gbt(df, ["a", "same"], "y", trees=3, depth=3)
    assert {(r.a, r.prediction) for r in model.transform(df).collect()} == {(0.0, 0.0), (1.0, 4.0)}
    flat = M.fit_gbt(df, ["same"], "y", trees=2, depth=2).transform(df.where("a = 1 and y = 4")).first()
    assert np.isclose(flat["prediction"], 4 * 25 / 52 + 9 * 2 / 52)


def tour_length(points, order):
    p = points[order]
    return np.sqrt(((p - np.roll(p, -1, axis=0)) ** 2).sum(1)).sum()


def stops(spark, groups, n, seed=1):
    rng = np.random.default_rng(seed)
    data = [(g, i, float(a), float(b), i == 0) for g in range(groups) for i, (a, b) in enumerate(rng.uniform(0, 1, (n, 2)))]
    return spark.createDataFrame(data, "g int, i int, lat double, lng double, depot boolean")


def test_routes_visit_everything_once(spark):
    df = stops(spark, 3, 25)
    out = P.rotate(P.route_groups(df, ["g"], "i", "lat", "lng", "depot"), ["g"], "tour_pos", "depot").toPandas()
    for _, g in out.groupby("g"):
        g = g.sort_values("route_order")
        assert sorted(g["i"]) == list(range(25)) and list(g["route_order"]) == list(range(1, 26)) and g["depot"].iloc[0]
        pts = g[["lat", "lng"]].to_numpy()
        best = tour_length(pts, np.arange(25))
        for a in range(1, 24):
            for b in range(a + 1, 25):
                flipped = np.concatenate([np.arange(a), np.arange(b, a - 1, -1), np.arange(b + 1, 25)])
                assert tour_length(pts, flipped) >= best - 1e-9


def test_a_huge_route_is_cut_into_pieces(spark):
    df = stops(spark, 1, 300)
    out = P.route_groups(df, ["g"], "i", "lat", "lng", "depot", max_stops=50, blocks=4).toPandas().sort_values("tour_pos")
    assert sorted(out["i"]) == list(range(300)) and out["depot"].iloc[0] and list(out["tour_pos"]) == list(range(1, 301))
    pts = out[["lat", "lng"]].to_numpy()
    rng = np.random.default_rng(0)
    assert tour_length(pts, np.arange(300)) < 0.4 * tour_length(pts, rng.permutation(300))


@pytest.mark.parametrize("n", [40, 50, 51, 120, 300])
def test_pieces_lengthen_a_route_little(spark, n):
    df = stops(spark, 1, n, seed=3)
    length = {}
    for limit in (50, 1000):
        out = P.route_groups(df, ["g"], "i", "lat", "lng", "depot", max_stops=limit).toPandas().sort_values("tour_pos")
        assert sorted(out["i"]) == list(range(n)) and out["depot"].iloc[0] and list(out["tour_pos"]) == list(range(1, n + 1))
        length[limit] = tour_length(out[["lat", "lng"]].to_numpy(), np.arange(n))
    print(n, length)
    assert length[50] <= 1.15 * length[1000]


def test_rotation(spark):
    df = spark.createDataFrame([(1, "a", 1, False), (1, "b", 2, False), (1, "d", 3, True), (2, "d", 1, True), (2, "e", 2, False)], "g int, s string, pos int, depot boolean")
    assert rows(P.rotate(df, ["g"], "pos", "depot"), "g", "route_order", "s") == [(1, 1, "d"), (1, 2, "a"), (1, 3, "b"), (2, 1, "d"), (2, 2, "e")]


def test_near_pairs_by_brute_force(spark):
    df = stops(spark, 2, 120)
    pdf = df.toPandas()
    want = set()
    for g, part in pdf.groupby("g"):
        for a in part.itertuples():
            for b in part.itertuples():
                if a.i < b.i and math.hypot(a.lat - b.lat, a.lng - b.lng) <= 0.11:
                    want.add((g, a.i, b.i))
    got = {(r["g"], r["i"], r["j"]) for r in P.pair_dist(df, ["g"], "i", "lat", "lng", 0.11).collect()}
    assert got == want and len(want) > 50


def test_betainc_for_large_parameters():
    import numpy as np
    from larkspan.functions.special import betainc

    sizes = np.array([1e6, 1e8, 1e9])
    # At the mean the value tends to 1/2, and I_x(a, b) + I_1-x(b, a) = 1.
    low = betainc(0.3 * sizes, 0.7 * sizes, 0.3)
    assert np.allclose(low, 0.5, atol=2e-4)
    assert np.allclose(low + betainc(0.7 * sizes, 0.3 * sizes, 0.7), 1, atol=1e-6)


def test_tuning_counts_cells_not_rows(spark, monkeypatch):
    # 600 rows are over the limit of one task, their 12 cells are not.
    monkeypatch.setattr(B2, "CELLS_PER_TASK", 100)
    monkeypatch.setattr(B2, "_grow_in_jobs", None)
    df = spark.range(600).select("id", (F.col("id") % 3).alias("a"), (F.col("id") % 2).alias("b"), (F.col("id") * 1.5).alias("y"))
    scores = M.tune(M.kfold(df, ["id"], "y", k=2), ["a", "b"], "y", [2], [1, 3], folds=2, rate=0.3, depth=2)
    assert [r.trees for r in scores.orderBy("trees").collect()] == [1, 3]


def test_staged_errors_deal_rows_by_bins(spark, monkeypatch):
    """Every task walked every cell down all trees; now a cell of few rows is in one task, and errors are those of its predictions."""
    seen = []
    deal = type(spark.range(0)).repartitionByRange
    monkeypatch.setattr(type(spark.range(0)), "repartitionByRange", lambda self, n, *cols: seen.append(out := deal(self, n, *cols)) or out)
    df = spark.range(4000).select((F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b"), (F.col("id") % 7 % 2).alias("fold"), ((F.col("id") % 20) * 2.0 + F.col("id") % 11).alias("y"))
    plan = {"mtry": (1, 2, 2), "left_out": (0, 0, 1), "trees": 5, "rate": 0.3, "depth": 3, "seed": 4}
    staged, cuts = B2.grown(df, ["a", "b"], "y", "fold", {**plan, "staged": (2, 5)})
    errors = {(r.fit, r.trees): (r.e, r.n) for r in staged.groupBy("fit", "trees").agg(F.sum("error").alias("e"), F.sum("n").alias("n")).collect()}
    tasks = seen[-1].withColumn("task", F.spark_partition_id()).groupBy("bins").agg(F.countDistinct("task").alias("n"))
    assert sum(r.n for r in tasks.collect()) < 60 + spark.sparkContext.defaultParallelism
    grown = sorted(B2.grown(df, ["a", "b"], "y", "fold", plan)[0].collect(), key=lambda t: t["tree"])
    rows = df.toPandas()
    for fit, out in enumerate(plan["left_out"]):
        held = rows[rows["fold"] == out]
        for n in (2, 5):
            model = B2.BoostedTrees(["a", "b"], [t for t in grown if t["fit"] == fit][:n], cuts, 0.3)
            error, count = errors[fit, n]
            assert count == len(held) and np.isclose(error, np.abs(held["y"] - model.predict(held[["a", "b"]].to_numpy())).sum())
