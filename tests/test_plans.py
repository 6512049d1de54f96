"""Plans that must hold at scale, and hot groups."""

import pytest
from conftest import plan_of, rows
from pyspark.sql import functions as F

from larkspan.operators import aggregates as A
from larkspan.operators import joins as J
from larkspan.operators import sets as G
from larkspan.operators import windows as V
from larkspan.operators.series import SeriesSpec, prepare
from larkspan.plans import ordered as O
from larkspan.plans.catalog import QUERIES

NATIVE = [
    "over_index", "summarise", "quantiles", "cum_share", "topk_share", "running_counts", "prepare_series", "fill_linear", "mann_kendall",
    "weighted_glm", "posterior_by_week", "records", "tables_by_header", "near_pairs", "related_pages", "search", "content_index", "complete",
]


@pytest.mark.parametrize("name", NATIVE)
def test_no_python(spark, sf, name):
    plan = plan_of(QUERIES[name].run(spark, sf))
    assert "Python" not in plan and "Pandas" not in plan


def test_pruned_scan(spark, sf):
    plan = plan_of(QUERIES["over_index"].run(spark, sf))
    assert "o_totalprice" not in plan and "c_acctbal" not in plan
    assert "PushedFilters: [IsNotNull" in plan


def test_rank_filters_limit_before_the_shuffle(spark, sf):
    for name in ("top_n_ties", "first_n", "over_index", "search", "related_pages"):
        df = QUERIES[name].run(spark, sf)
        df.collect()
        plan = plan_of(df)
        assert "WindowGroupLimit" in plan and "Partial" in plan, name


def test_prepared_series_share_one_exchange(spark):
    spec = SeriesSpec(("g",), "d", "y")
    df = spark.sql("SELECT id % 5 AS g, date_add(DATE '2010-01-01', CAST(id * 7 AS INT)) AS d, CAST(id AS DOUBLE) AS y FROM range(500)")
    plan = plan_of(prepare(df, spec, 1, 4, 0.5, 1.5))
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the rows in one group, many of them with equal values, and a NULL group."""
    return spark.sql(
        """SELECT CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 31 = 1 THEN NULL ELSE concat('k', id % 17) END AS k, id,
                  CAST(CASE WHEN id % 4 = 0 THEN 1 ELSE pmod(xxhash64(id), 50) END AS DOUBLE) AS v FROM range(3000)"""
    ).cache()


@pytest.mark.parametrize("blocks", [2, 7, 40])
def test_blocks_give_the_same_positions(hot, blocks):
    args = dict(total="n", running={"s": F.col("v"), "low": ("min", F.col("v")), "high": ("max", F.col("v"))}, totals={"t": F.col("v")})
    order = [-F.col("v"), F.col("id")]
    for keys in (["k"], []):
        one = O.with_position(hot, keys, order, blocks=1, **args)
        many = O.with_position(hot, keys, order, blocks=blocks, **args)
        cols = ["id", "pos", "n", "s", "low", "high", "t"]
        assert rows(one, *cols) == rows(many, *cols)


def test_blocks_split_a_hot_group(hot):
    sizes = O.with_block(hot, [F.col("k"), F.col("v"), F.col("id")], 20, "b").groupBy("k", "b").count()
    assert sizes.agg(F.max("count")).first()[0] < 600


def test_window_operators_in_blocks(hot):
    order = [F.col("v"), F.col("id")]
    pairs = [
        (V.with_ntile(hot, order, 7, blocks=1), V.with_ntile(hot, order, 7, blocks=9)),
        (V.avg_rank(hot, ["k"], "v", blocks=1), V.avg_rank(hot, ["k"], "v", blocks=9)),
        (V.cum_share(hot, ["k"], order, "v", blocks=1), V.cum_share(hot, ["k"], order, "v", blocks=9)),
        (V.lead_cols(hot, ["k"], order, {"next": "id"}, blocks=1), V.lead_cols(hot, ["k"], order, {"next": "id"}, blocks=9)),
        (A.quantiles(hot, ["k"], "v", {"a": 0.1, "b": 0.77}, blocks=1), A.quantiles(hot, ["k"], "v", {"a": 0.1, "b": 0.77}, blocks=9)),
    ]
    for one, many in pairs:
        assert rows(one) == rows(many, *one.columns)


def test_next_rows_across_blocks(spark, hot):
    # Rows of NULLs are successors too, and no row is matched with all rows again.
    some = hot.withColumn("x", F.when(F.col("id") % 3 != 1, F.col("id")))
    order = [-F.col("v"), F.col("id")]
    for keys in (["k"], []):
        one = J.with_next(some, keys, order, {"x2": "x", "id2": "id"}, keep_last=True, blocks=1)
        assert "Join" not in plan_of(one)
        for blocks in (2, 9, 60):
            many = J.with_next(some, keys, order, {"x2": "x", "id2": "id"}, keep_last=True, blocks=blocks)
            assert rows(one) == rows(many, *one.columns)
    lost = J.with_next(some, ["k"], order, {"x2": "x"}, blocks=9)
    assert lost.count() == 3000 - some.select("k").distinct().count()


def test_borders_are_joined_not_rows(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "ts")
    plan = V.lead_cols(events, ["user_id"], [F.col("ts"), F.col("event_id")], {"next_ts": "ts"}, blocks=6)._jdf.queryExecution().optimizedPlan().toString()
    join = plan.index("Join Inner")
    sides = plan[join:].split("\n")
    # The only join: one side is aggregated to one row per key and block.
    assert plan.count("Join Inner") == 1 and sum("Aggregate" in line for line in sides) == 1
    assert not any("Join" in line for line in sides[1:])


def test_gaps_in_blocks(spark, hot):
    gappy = hot.withColumn("y", F.when(F.col("id") % 5 < 2, F.col("v")))
    for make in (
        lambda b: V.missing_streak(gappy, ["k"], "id", "y", blocks=b),
        lambda b: V.interpolate(gappy, ["k"], "id", "y", "z", blocks=b),
        lambda b: V.interpolate(gappy, ["k"], "id", "y", "z", both=True, blocks=b),
    ):
        one = make(1)
        assert rows(one) == rows(make(8), *one.columns)


def test_quantiles_equal_builtin(hot):
    weighted = hot.groupBy("k", "v").count()
    assert rows(A.quantiles(weighted, ["k"], "v", {"q": 0.4}, weight="count", blocks=6)) == rows(A.quantiles(hot, ["k"], "v", {"q": 0.4}, blocks=1))
    mine = A.quantiles(hot, ["k"], "v", {"q": 0.33}, blocks=5)
    builtin = hot.groupBy("k").agg(F.percentile("v", 0.33).alias("q"))
    assert [(k, round(q, 9)) for k, q in rows(mine)] == [(k, round(q, 9)) for k, q in rows(builtin)]


QS = {"a": 0.0, "b": 0.025, "c": 0.5, "d": 0.99, "e": 1.0}


@pytest.fixture(scope="module")
def odd(spark):
    """Groups of every size with many equal values, NaNs and NULLs."""
    return spark.sql(
        """SELECT CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 31 = 1 THEN NULL WHEN id % 101 = 2 THEN 'nan' ELSE concat('k', id % 17) END AS k,
                  CASE WHEN id % 101 = 2 THEN double('NaN') WHEN id % 57 = 0 THEN NULL WHEN id % 4 = 0 THEN 1 ELSE xxhash64(id) / 1e9 END AS v
           FROM range(60000)"""
    ).cache()


@pytest.mark.parametrize("margin", [0.01, 0.0005, 0.0])
def test_bracketed_quantiles_equal_builtin(odd, monkeypatch, margin):
    # With margins under the sketch's error brackets miss, and their groups are ranked whole.
    monkeypatch.setattr(A, "MARGIN", margin)
    for keys in (["k"], []):
        data = odd if keys else odd.filter("NOT isnan(v)")
        mine, whole = rows(A.quantiles(data, keys, "v", QS, blocks=7)), rows(A.quantiles(data, keys, "v", QS, blocks=1))
        assert len(mine) == len(whole) and [r[: len(keys)] for r in mine] == [r[: len(keys)] for r in whole]
        for a, b in zip(mine, whole):
            assert a[len(keys) :] == pytest.approx(b[len(keys) :], rel=1e-12, nan_ok=True)


def test_only_brackets_are_ranked(spark, monkeypatch):
    ranked = []
    kept = A.with_position
    monkeypatch.setattr(A, "with_position", lambda df, *a, **k: (ranked.append(df.count()), kept(df, *a, **k))[1])
    data = spark.sql("SELECT id % 3 AS k, CAST(xxhash64(id) AS DOUBLE) AS v FROM range(300000)")
    A.quantiles(data, ["k"], "v", {"low": 0.025, "mid": 0.5, "high": 0.99}, blocks=4).collect()
    assert len(ranked) == 1 and ranked[0] < 0.07 * 300000


def test_approximate_quantiles_keep_their_error(spark):
    data = spark.sql("SELECT id % 3 AS k, id AS v FROM range(300000)")
    for accuracy in (20, 1000):
        for r in A.quantiles(data, ["k"], "v", {"low": 0.025, "mid": 0.5, "high": 0.99}, approx=True, accuracy=accuracy).collect():
            for q, value in zip((0.025, 0.5, 0.99), (r.low, r.mid, r.high)):
                assert abs(value / 300000 - q) <= 1 / accuracy


def test_deep_page(hot):
    order = [F.col("v"), F.col("id")]
    assert rows(G.page(hot, order, 1000, 20)) == rows(G.deep_page(hot, order, 1000, 20, blocks=6))


def test_attach_keeps_null_groups(hot):
    out = A.group_bounds(hot, ["k"], "v", 0.5, 2)
    assert out.count() == hot.count()
    assert out.filter("k IS NULL AND cap_value IS NULL").count() == 0


def test_grid_is_complete(spark):
    a, b = spark.range(7).withColumnRenamed("id", "a"), spark.range(50).withColumnRenamed("id", "b")
    grid = J.expand_grid(a, b, buckets=3)
    assert grid.count() == grid.distinct().count() == 350


def test_results_do_not_depend_on_partitions(spark, sf):
    for name in ("bootstrap_effect", "simulated_seasons", "win_probability", "train_test_split"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        out = []
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            out.append(rows(QUERIES[name].run(spark, sf)))
        spark.conf.set("spark.sql.shuffle.partitions", before)
        assert out[0] == out[1], name


def test_grown_input_is_counted(spark):
    grown = spark.createDataFrame([(1,)], "k int").select(F.explode(F.sequence(F.lit(1), F.lit(100))).alias("v"))
    assert O.estimated_bytes(grown) is None
    out = O.with_position(grown, [], [F.col("v")])
    assert dict(out.dtypes)["pos"] == "bigint" and out.filter("pos = v").count() == 100


def test_block_limit_follows_the_cluster(spark):
    assert O.blocks_of_rows(10**13, 4000) == 4000 and O.blocks_of_rows(10, 4000) == 1


def test_well_packed_files_are_counted(spark, tmp_path, monkeypatch):
    # Files under 64 MB can hold more rows than one task should number.
    monkeypatch.setattr(O, "TINY_BYTES", 0)
    monkeypatch.setattr(O, "ROWS_PER_BLOCK", 50)
    spark.range(400).write.parquet(str(tmp_path / "t"))
    packed = spark.read.parquet(str(tmp_path / "t"))
    for derived in (False, True):
        assert O.ready(packed, None, derived)[1] == 8
        assert O.with_position(packed, [], [F.col("id")], derived=derived).filter("pos = id + 1").count() == 400


def test_small_groups_need_no_blocks(spark, hot, tmp_path, monkeypatch):
    monkeypatch.setattr(O, "TINY_BYTES", 0)
    monkeypatch.setattr(O, "ROWS_PER_BLOCK", 50)
    spark.range(3000).selectExpr("id div 3 AS k", "id").write.parquet(str(tmp_path / "t"))
    even = spark.read.parquet(str(tmp_path / "t"))
    assert O.ready(even, None, False, ["k"])[1] == 1 and O.ready(even, None, True, ["k"])[1] == 1
    assert "Join" not in plan_of(O.with_lead(even, ["k"], [F.col("id")], {"next": "id"}))
    # A group of 1,000 rows is cut all the same, and given numbers of blocks hold.
    assert O.ready(hot, None, True, ["k"])[1] > 1 and O.ready(even, 4, False, ["k"])[1] == 4
