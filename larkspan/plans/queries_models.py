"""Queries for statistics, causal effects, Bayesian estimates and machine learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.functions.special import beta_pdf, beta_ppf
from larkspan.operators import bayes as B
from larkspan.operators import causal as C
from larkspan.operators import ml as M
from larkspan.operators import stats as S
from larkspan.operators.aggregates import five_num, summarise
from larkspan.operators.clean import with_cols
from larkspan.operators.reshape import to_long
from larkspan.operators.sets import argmin, other_columns, with_prediction
from larkspan.functions.scalar import floor_to
from larkspan.plans.queries_groups import WEEKS, player_weeks, weekly_success
from larkspan.plans.queries_rows import RANK_LABELS, RANK_SQL, RANKS
from larkspan.plans.queries_series import yearly_lines
from larkspan.functions.scalar import bucketize
from larkspan.plans.registry import query

# ---------------------------------------------------------------- statistics

YEARLY = """
WITH y AS (SELECT l_partkey, year(l_shipdate)::INT AS year, count(*) AS n FROM lineitem WHERE year(l_shipdate) >= 1996 GROUP BY ALL),
k AS (SELECT l_partkey FROM y GROUP BY 1 HAVING sum(n) >= 25),
f AS (SELECT l_partkey, year, coalesce(n, 0) AS n FROM (SELECT k.l_partkey, v.year FROM k, (SELECT DISTINCT year FROM y) v) LEFT JOIN y USING (l_partkey, year)),
s AS (SELECT a.l_partkey, sum(sign(b.n - a.n))::BIGINT AS s FROM f a JOIN f b ON a.l_partkey = b.l_partkey AND a.year < b.year GROUP BY 1),
t AS (SELECT l_partkey, sum(c)::BIGINT AS n, sum(c * (c - 1) * (2 * c + 5)) AS ties FROM (SELECT l_partkey, n, count(*) AS c FROM f GROUP BY ALL) GROUP BY 1),
v AS (SELECT l_partkey, t.n, s, (t.n * (t.n - 1) * (2 * t.n + 5) - ties) / 18 AS var_s FROM s JOIN t USING (l_partkey)),
z AS (SELECT l_partkey, n, s, var_s, CASE WHEN s = 0 THEN 0.0::DOUBLE ELSE (s - sign(s)) / sqrt(var_s) END AS z FROM v)
"""


@query("mann_kendall", "L4 Q5", YEARLY + "SELECT l_partkey, n, s, round(var_s, 6) AS var_s, round(z, 6) AS z FROM z")
def _(t):
    out = S.mann_kendall(yearly_lines(t), ["l_partkey"], "year", "n", p_value=False)
    return out.select("l_partkey", F.col("n").cast("bigint").alias("n"), "s", F.round("var_s", 6).alias("var_s"), F.round("z", 6).alias("z"))


@query("trending_parts", "L4 L7 G2 D6")
def _(t):
    tests = S.mann_kendall(yearly_lines(t), ["l_partkey"], "year", "n")
    adjusted = S.p_adjust_bh(tests, "p_value", ["l_partkey"])
    return adjusted.orderBy(F.desc("z"), "l_partkey").limit(25)


@query(
    "ols_by_bucket",
    "L5 B11 D1",
    f"""WITH b AS (SELECT p_partkey, p_size, p_retailprice, {RANK_SQL} AS bucket FROM part),
        l AS (SELECT bucket, regr_slope(p_retailprice, p_size) AS slope, regr_intercept(p_retailprice, p_size) AS intercept FROM b GROUP BY 1)
        SELECT p_partkey, bucket, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(p_size * slope + intercept, 6) AS fitted
        FROM b JOIN l USING (bucket)""",
)
def _(t):
    df = t.part.select("p_partkey", "p_size", "p_retailprice", bucketize(F.col("p_size"), RANKS, RANK_LABELS).alias("bucket"))
    out = S.ols_by(df, ["bucket"], "p_size", "p_retailprice")
    return out.select("p_partkey", "bucket", *[F.round(c, 6).alias(c) for c in ("slope", "intercept", "fitted")])


METRICS = """
WITH m AS (SELECT l_suppkey, avg(l_quantity) AS quantity, avg(l_discount) AS discount, count(*)::DOUBLE AS lines,
                  round(sum(l_extendedprice), 2) AS revenue FROM lineitem GROUP BY 1),
long AS (SELECT metric, value, s_acctbal FROM (SELECT * FROM m UNPIVOT (value FOR metric IN (quantity, discount, lines, revenue))) JOIN supplier ON l_suppkey = s_suppkey),
r AS (SELECT metric, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2 AS rx,
             rank() OVER (PARTITION BY metric ORDER BY s_acctbal) + (count(*) OVER (PARTITION BY metric, s_acctbal) - 1) / 2 AS ry FROM long)
"""


def supplier_metrics(t):
    wide = summarise(
        t.lineitem, ["l_suppkey"], quantity=F.avg("l_quantity"), discount=F.avg("l_discount"),
        lines=F.count(F.lit(1)).cast("double"), revenue=F.round(F.sum("l_extendedprice"), 2),
    )
    long = to_long(wide, ["l_suppkey"], ["quantity", "discount", "lines", "revenue"], "metric", "value")
    return long.join(t.supplier.select("s_suppkey", "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))


@query("spearman", "L6 F12 H1", METRICS + "SELECT metric, round(corr(rx, ry), 6) AS estimate, count(*) AS n FROM r GROUP BY 1")
def _(t):
    out = S.spearman_by(supplier_metrics(t), ["metric"], "value", "s_acctbal", p_value=False)
    return out.select("metric", F.round("estimate", 6).alias("estimate"), "n")


@query("spearman_adjusted", "L6 L7")
def _(t):
    return S.p_adjust_bh(S.spearman_by(supplier_metrics(t), ["metric"], "value", "s_acctbal"), "p_value", ["metric"])


@query(
    "adjust_p_values",
    "L7",
    """WITH r AS (SELECT event_id, value / 500 AS p, row_number() OVER (ORDER BY value, event_id) AS i, count(*) OVER () AS m FROM events)
       SELECT event_id, round(least(min(p * m / i) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1), 9) AS p_adj FROM r""",
)
def _(t):
    out = S.p_adjust_bh(t.events.select("event_id", (F.col("value") / 500).alias("p")), "p", ["event_id"])
    return out.select("event_id", F.round("p_adj", 9).alias("p_adj"))


# ---------------------------------------------------------------- causal effects

CUT = "1998-07-01"
PURCHASES = f"""
WITH n AS (SELECT o_custkey, count(CASE WHEN o_orderdate < DATE '{CUT}' THEN 1 END)::INT AS n_purchase_pre,
                  count(CASE WHEN o_orderdate >= DATE '{CUT}' THEN 1 END)::INT AS n_purchase_post FROM orders GROUP BY 1),
purchases AS (SELECT c_custkey, coalesce(n_purchase_pre, 0) AS n_purchase_pre, coalesce(n_purchase_post, 0) AS n_purchase_post,
                     (c_acctbal + 400 * coalesce(n_purchase_pre, 0) > 7000)::INT AS member_enrolled
              FROM customer LEFT JOIN n ON c_custkey = o_custkey)
"""


def purchases(t):
    """Orders before and after a cut date per customer; enrolment depends on the earlier ones."""
    early = F.col("o_orderdate") < F.lit(CUT).cast("timestamp_ntz")
    n = t.orders.groupBy("o_custkey").agg(
        F.count_if(early).cast("int").alias("n_purchase_pre"), F.count_if(~early).cast("int").alias("n_purchase_post")
    )
    joined = t.customer.select("c_custkey", "c_acctbal").join(n, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0)
    member = (F.col("c_acctbal") + 400 * F.col("n_purchase_pre") > 7000).cast("int")
    return joined.select("c_custkey", "n_purchase_pre", "n_purchase_post", member.alias("member_enrolled"))


@query(
    "naive_effect",
    "L13",
    PURCHASES
    + """SELECT round(avg(CASE WHEN member_enrolled = 0 THEN n_purchase_post END), 9) AS mean_control,
         round(avg(CASE WHEN member_enrolled = 1 THEN n_purchase_post END), 9) AS mean_treated,
         round(avg(CASE WHEN member_enrolled = 1 THEN n_purchase_post END) - avg(CASE WHEN member_enrolled = 0 THEN n_purchase_post END), 9) AS effect FROM purchases""",
)
def _(t):
    out = C.naive_effect(purchases(t), "n_purchase_post", "member_enrolled")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


GLM = """ SELECT round(ln(y0 / w0), 9) AS intercept, round(ln(y1 / w1) - ln(y0 / w0), 9) AS coefficient, round(sqrt(1 / y0), 9) AS se_intercept,
round(sqrt(1 / y0 + 1 / y1), 9) AS se_coefficient, round(y1 / w1 - y0 / w0, 9) AS effect FROM """


@query(
    "glm_effect",
    "L8",
    PURCHASES
    + GLM
    + """(SELECT sum(CASE member_enrolled WHEN 0 THEN 1.0::DOUBLE END) AS w0, sum(CASE member_enrolled WHEN 1 THEN 1.0::DOUBLE END) AS w1,
         sum(CASE member_enrolled WHEN 0 THEN n_purchase_post::DOUBLE END) AS y0, sum(CASE member_enrolled WHEN 1 THEN n_purchase_post::DOUBLE END) AS y1 FROM purchases)""",
)
def _(t):
    out = C.glm_effect(purchases(t), "n_purchase_post", "member_enrolled")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


WEIGHTED = """, p AS (SELECT *, avg(member_enrolled) OVER (PARTITION BY n_purchase_pre) AS p FROM purchases),
w AS (SELECT *, 1 / CASE member_enrolled WHEN 0 THEN 1 - p ELSE p END AS iptw FROM p),
tr AS (SELECT *, least(iptw, (SELECT quantile_cont(iptw, 0.99) FROM w)) AS w FROM w)
"""


def stratum_weights(t):
    """Weights from the share of members among customers with as many earlier orders."""
    rows = purchases(t)
    share = rows.groupBy("n_purchase_pre").agg(F.avg("member_enrolled").alias("p"))
    return rows.join(share, "n_purchase_pre").withColumn("iptw", C.iptw(F.col("p"), F.col("member_enrolled")))


@query("trimmed_weights", "L10 L11 I15 E6", PURCHASES + WEIGHTED + "SELECT c_custkey, round(w, 9) AS iptw FROM tr")
def _(t):
    return C.trim_weights(stratum_weights(t), "iptw").select("c_custkey", F.round("iptw", 9).alias("iptw"))


@query(
    "weighted_glm",
    "L8 L10 L11",
    PURCHASES
    + WEIGHTED
    + GLM
    + """(SELECT sum(CASE member_enrolled WHEN 0 THEN w END) AS w0, sum(CASE member_enrolled WHEN 1 THEN w END) AS w1,
         sum(CASE member_enrolled WHEN 0 THEN w * n_purchase_post END) AS y0, sum(CASE member_enrolled WHEN 1 THEN w * n_purchase_post END) AS y1 FROM tr)""",
)
def _(t):
    out = C.glm_effect(C.trim_weights(stratum_weights(t), "iptw"), "n_purchase_post", "member_enrolled", "iptw")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query("propensity", "L9 L10")
def _(t):
    scored = C.propensity(purchases(t), "member_enrolled", ["n_purchase_pre"])
    return scored.withColumn("iptw", C.iptw(F.col("propensity"), F.col("member_enrolled")))


@query(
    "propensity_moments",
    "L9",
    PURCHASES + "SELECT count(*) AS n, sum(member_enrolled)::DOUBLE AS members, sum(member_enrolled * n_purchase_pre)::DOUBLE AS earlier_orders FROM purchases",
)
def _(t):
    # At the largest likelihood the scores sum to the members, and weighted by a covariate to the members' covariates.
    p = C.propensity(purchases(t), "member_enrolled", ["n_purchase_pre"])
    total = lambda c: F.round(F.sum(c), 3)
    return p.agg(F.count(F.lit(1)).alias("n"), total(F.col("propensity")).alias("members"), total(F.col("propensity") * F.col("n_purchase_pre")).alias("earlier_orders"))


@query("weighted_effect", "L8 L9 L10 L11")
def _(t):
    return C.weighted_effect(purchases(t), "n_purchase_post", "member_enrolled", ["n_purchase_pre"])


@query("bootstrap_effect", "L12")
def _(t):
    return C.bootstrap_effect(purchases(t), "n_purchase_post", "member_enrolled", ["n_purchase_pre"], n=500, seed=2021)


# ---------------------------------------------------------------- Bayesian estimates


@query(
    "beta_update",
    "L14",
    """SELECT l_suppkey, sum((l_returnflag = 'R')::INT)::BIGINT AS k, count(*) AS n, 8 + sum((l_returnflag = 'R')::INT)::BIGINT AS alpha,
       22 + sum((l_returnflag <> 'R')::INT)::BIGINT AS beta, round((8 + sum((l_returnflag = 'R')::INT)) / (30 + count(*)), 9) AS mean FROM lineitem GROUP BY 1""",
)
def _(t):
    counts = returned(t).withColumn("missed", F.col("n") - F.col("k"))
    out = B.beta_update(counts, "k", "missed", F.lit(8), F.lit(22))
    return out.select("l_suppkey", "k", "n", "alpha", "beta", F.round("mean", 9).alias("mean"))


def returned(t):
    """Returned lines (k) of all lines (n) per supplier."""
    return summarise(t.lineitem, ["l_suppkey"], k=F.count_if(F.col("l_returnflag") == "R"), n=F.count(F.lit(1)))


FIRST = "2024-01-08"


def evolution(t):
    """Posteriors per user and week, with the first week's counts as the prior."""
    events = weekly_success(t)
    start = F.lit(FIRST).cast("date")
    prior = events.filter(F.col("week") < start).groupBy("user_id").agg(
        F.greatest(F.sum("success"), F.lit(1)).alias("prior_alpha"), F.greatest(F.sum(1 - F.col("success")), F.lit(1)).alias("prior_beta")
    )
    later = events.filter(F.col("week") >= start)
    return B.beta_evolution(later, ["user_id"], "week", "success", player_weeks(later), prior)


@query(
    "posterior_by_week",
    "L15 L14 F6",
    f"""WITH e AS (SELECT user_id, date_trunc('week', ts)::DATE AS week, (value >= 30)::INT AS success FROM events),
        pr AS (SELECT user_id, greatest(sum(success), 1)::BIGINT AS a0, greatest(sum(1 - success), 1)::BIGINT AS b0 FROM e WHERE week < DATE '{FIRST}' GROUP BY 1),
        l AS (SELECT * FROM e WHERE week >= DATE '{FIRST}'),
        c AS (SELECT user_id, week FROM (SELECT DISTINCT user_id FROM l), (SELECT DISTINCT week FROM l)),
        g AS (SELECT user_id, week, coalesce(s, 0) AS s, coalesce(f, 0) AS f FROM c LEFT JOIN
              (SELECT user_id, week, sum(success) AS s, sum(1 - success) AS f FROM l GROUP BY ALL) USING (user_id, week)),
        r AS (SELECT user_id, week, sum(s) OVER w::BIGINT AS successes, sum(f) OVER w::BIGINT AS failures FROM g WINDOW w AS (PARTITION BY user_id ORDER BY week))
        SELECT user_id, week, successes, failures, coalesce(a0, 1) + successes AS alpha, coalesce(b0, 1) + failures AS beta,
               round((coalesce(a0, 1) + successes) / (coalesce(a0, 1) + successes + coalesce(b0, 1) + failures), 9) AS mean
        FROM r LEFT JOIN pr USING (user_id)""",
)
def _(t):
    return evolution(t).withColumn("mean", F.round("mean", 9))


@query(
    "beta_density",
    "I17 Q2 Q3",
    """WITH c AS (SELECT event_type, 1 + sum((value >= 30)::INT)::DOUBLE / 20 AS a, 1 + sum((value < 30)::INT)::DOUBLE / 20 AS b FROM events GROUP BY 1)
       SELECT event_type, round(i / 100, 2) AS x, round(CASE WHEN i IN (0, 100) THEN 0 ELSE
         exp((a - 1) * ln(i / 100) + (b - 1) * ln(1 - i / 100) - lgamma(a) - lgamma(b) + lgamma(a + b)) END, 6) AS density FROM c, range(101) AS r(i)""",
)
def _(t):
    hit = (F.col("value") >= 30).cast("int")
    counts = t.events.groupBy("event_type").agg((1 + F.sum(hit) / 20).alias("alpha"), (1 + F.sum(1 - hit) / 20).alias("beta"))
    return B.density_grid(counts).select("event_type", F.round("x", 2).alias("x"), F.round("density", 6).alias("density"))


@query(
    "beta_quantile",
    "I18",
    """SELECT p_partkey, round(pow(0.9, 1 / p_size::DOUBLE), 9) AS first_shape, round(1 - pow(0.1, 1 / p_size::DOUBLE), 9) AS second_shape FROM part""",
)
def _(t):
    # With one parameter at 1 the quantile has a closed form.
    size, one = F.col("p_size").cast("double"), F.lit(1.0)
    return t.part.select(
        "p_partkey", F.round(beta_ppf(F.lit(0.9), size, one), 9).alias("first_shape"), F.round(beta_ppf(F.lit(0.9), one, size), 9).alias("second_shape")
    )


@query("credible_intervals", "L16 I18")
def _(t):
    return B.credible(evolution(t))


@query("upper_bound_choice", "L17 L16")
def _(t):
    return B.ucb_pick(B.credible(evolution(t)), "week", "user_id")


def supplier_rates(t):
    return returned(t).withColumns({"log2_n": F.log2("n"), "decade": floor_to(F.col("l_suppkey"), 10) / F.lit(1000.0)})


@query("shrunken_rates", "L18 L16")
def _(t):
    return B.eb_fit(returned(t), "k", "n")


@query("shrunken_rates_by_size", "L19 L16")
def _(t):
    return B.eb_fit(supplier_rates(t), "k", "n", ["log2_n", "decade"])


@query("win_probability", "L20")
def _(t):
    weeks = B.versus_leader(evolution(t), "week", "user_id")
    return B.posterior_win_prob(weeks, ["week", "user_id", "leader"], "a", "b", n=1000)


@query("simulated_seasons", "L21 E16 F9")
def _(t):
    post = B.beta_update(returned(t).withColumn("m", F.col("n") - F.col("k")), "k", "m", F.lit(1), F.lit(1))
    return five_num(B.posterior_predictive(post, "l_suppkey", 27, 3.5), ["l_suppkey"], "season_pts")


@query(
    "paired_comparison",
    "L22 E6",
    """WITH d AS (SELECT o_orderpriority AS p, o_orderdate::DATE AS day, sum(o_totalprice) AS v FROM orders GROUP BY ALL),
       j AS (SELECT a.v AS a, b.v AS b, a.v - b.v AS diff FROM d a JOIN d b USING (day) WHERE a.p = '1-URGENT' AND b.p = '5-LOW')
       SELECT round(avg((a > b)::INT), 9) AS pct_greater, round(quantile_cont(diff, 0.05), 4) AS q05, round(quantile_cont(diff, 0.5), 4) AS q50,
              round(quantile_cont(diff, 0.95), 4) AS q95 FROM j""",
)
def _(t):
    days = t.orders.groupBy("o_orderpriority", F.to_date("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("v"))
    out = B.paired_diff(days, "o_orderpriority", "day", "v", "1-URGENT", "5-LOW")
    return out.select(F.round("pct_greater", 9).alias("pct_greater"), *[F.round(c, 4).alias(c) for c in ("q05", "q50", "q95")])


# ---------------------------------------------------------------- machine learning


@query("train_test_split", "M1", "SELECT l_orderkey, l_linenumber, CASE WHEN substr(md5(l_orderkey || ':' || l_linenumber || ':2021'), 1, 8) < 'c0000000' THEN 'train' ELSE 'test' END AS part FROM lineitem")
def _(t):
    return M.split(t.lineitem.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"])


@query(
    "stratified_folds",
    "M2 F5",
    """WITH s AS (SELECT p_partkey, ntile(4) OVER (ORDER BY p_retailprice, p_partkey) AS q FROM part)
       SELECT p_partkey, ((row_number() OVER (PARTITION BY q ORDER BY md5(p_partkey || ':2021'), p_partkey) - 1) % 5)::INT AS fold FROM s""",
)
def _(t):
    return M.kfold(t.part.select("p_partkey", "p_retailprice"), ["p_partkey"], "p_retailprice").select("p_partkey", "fold")


WORDS = {w: f"is_{w}" for w in ("red", "blue", "hot", "cold", "ring", "bolt", "rod", "gear")}


@query(
    "multi_hot",
    "M3 H3",
    "SELECT p_brand, " + ", ".join(f"count(CASE WHEN list_contains(string_split(p_name, ' '), '{w}') THEN 1 END) AS {c}" for w, c in WORDS.items()) + " FROM part GROUP BY 1",
)
def _(t):
    return M.multi_hot(t.part, ["p_brand"], "p_name", WORDS, " ")


@query(
    "near_zero_variance",
    "M4",
    """WITH long AS (SELECT 'l_linestatus' AS name, l_linestatus AS value FROM lineitem UNION ALL SELECT 'l_returnflag', l_returnflag FROM lineitem
       UNION ALL SELECT 'l_linenumber', l_linenumber::VARCHAR FROM lineitem UNION ALL SELECT 'heavy', (l_quantity >= 50)::INT::VARCHAR FROM lineitem
       UNION ALL SELECT 'one', '1' FROM lineitem),
       c AS (SELECT name, value, count(*) AS n FROM long GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY n DESC, value) AS i FROM c),
       s AS (SELECT name, max(n) AS first, max(CASE WHEN i = 2 THEN n END) AS second, count(*) AS n_values, sum(n) AS n_rows FROM r GROUP BY 1)
       SELECT name, round(coalesce(first / second, 0), 6) AS freq_ratio, round(n_values / n_rows * 100, 6) AS pct_unique, n_values = 1 AS constant,
              n_values = 1 OR (coalesce(first / second, 0) > 95 / 5 AND n_values / n_rows * 100 <= 10) AS near_zero FROM s""",
)
def _(t):
    df = t.lineitem.select("l_linestatus", "l_returnflag", "l_linenumber", (F.col("l_quantity") >= 50).cast("int").alias("heavy"), F.lit("1").alias("one"))
    out = M.near_zero(M.nzv_stats(df, df.columns))
    return out.select("name", F.round("freq_ratio", 6).alias("freq_ratio"), F.round("pct_unique", 6).alias("pct_unique"), "constant", "near_zero")


@query(
    "mean_absolute_error",
    "M7",
    "SELECT round(avg(abs(l_extendedprice - 1500 * l_quantity)), 4) AS mae FROM lineitem",
)
def _(t):
    df = with_cols(t.lineitem.select("l_extendedprice", "l_quantity"), {"guess": 1500 * F.col("l_quantity")})
    return M.mae(df, "l_extendedprice", "guess").select(F.round("mae", 4).alias("mae"))


FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "promo"]


def model_rows(t):
    """Line price with features of the line and its part, split and folded by the line's key."""
    parts = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_type") == "PROMO").cast("int").alias("promo"))
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount", "l_tax", "l_extendedprice").join(
        parts, F.col("l_partkey") == F.col("p_partkey")
    )
    return M.split(rows, ["l_orderkey", "l_linenumber"])


@query(
    "tree_stump",
    "M5 M10",
    """SELECT (p_type = 'PROMO')::INT AS promo, round(avg(l_extendedprice), 2) AS prediction, count(*) AS n
       FROM lineitem JOIN part ON l_partkey = p_partkey WHERE substr(md5(l_orderkey || ':' || l_linenumber || ':2021'), 1, 8) < 'c0000000' GROUP BY 1""",
)
def _(t):
    # One split on a flag leaves the two group means.
    rows = model_rows(t).filter(F.col("part") == "train")
    scored = M.score(M.fit_gbt(rows, ["promo"], "l_extendedprice", trees=1, depth=1), rows)
    return scored.groupBy("promo").agg(F.round(F.avg("prediction"), 2).alias("prediction"), F.count("*").alias("n"))


@query("boosted_trees", "M5 M7 M1 G9")
def _(t):
    rows = model_rows(t)
    model = M.fit_gbt(rows.filter(F.col("part") == "train"), FEATURES, "l_extendedprice", mtry=4)
    scored = with_prediction(model, rows.filter(F.col("part") == "test"))
    return M.mae(scored, "l_extendedprice", "prediction")


@query("tuned_trees", "M6 M2 G3")
def _(t):
    # A grid up to mtry 8 needs more than 8 features, or its points repeat each other.
    flags = [F.array_contains(F.split("p_name", " "), w).cast("int").alias(c) for w, c in WORDS.items()]
    rows = t.part.select("p_partkey", "p_size", "p_retailprice", (F.col("p_type") == "PROMO").cast("int").alias("promo"), F.length("p_name").alias("chars"), *flags)
    folded = M.kfold(rows, ["p_partkey"], "p_retailprice", k=5)
    x = other_columns(rows, "p_partkey", "p_retailprice")
    scores = M.tune(folded, x, "p_retailprice", mtry=[2, 4, 6, 8], trees=range(50, 1001, 50))
    return argmin(scores, "mae", ["mtry", "trees"])


@query("feature_importance", "M8 M5")
def _(t):
    rows = model_rows(t)
    model = M.fit_gbt(rows.filter(F.col("part") == "train"), FEATURES, "l_extendedprice")
    return M.importance(rows, model, FEATURES)


@query("break_down", "M9 M10 Q4")
def _(t):
    # Fit, means and explanation read the rows; they are joined and split once.
    train = model_rows(t).filter(F.col("part") == "train").select(*FEATURES, "l_extendedprice").persist()
    try:
        model = M.fit_gbt(train, FEATURES, "l_extendedprice")
        means = train.agg(*[F.avg(c).alias(c) for c in FEATURES]).first().asDict()
        return M.break_down(model, train, FEATURES, {**means, "l_quantity": 45.0, "p_size": 25.0})
    finally:
        train.unpersist()


@query("scored_hypotheticals", "M10 M5")
def _(t):
    rows = model_rows(t)
    model = M.fit_gbt(rows.filter(F.col("part") == "train"), FEATURES, "l_extendedprice")
    typical = rows.groupBy("promo").agg(*[F.avg(c).alias(c) for c in FEATURES if c != "promo"])
    return M.score(model, typical.withColumn("l_quantity", F.lit(45.0)))
