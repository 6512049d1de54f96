"""Every registered query against its SQL, and row checks for the rest."""

import duckdb
import pytest
from check_queries import compare
from conftest import plan_of

from larkspan.plans import ordered
from larkspan.plans.catalog import QUERIES
from larkspan.plans.registry import TABLES

WITH_SQL = [n for n, q in QUERIES.items() if q.sql]
WITHOUT_SQL = [n for n, q in QUERIES.items() if not q.sql]
# Queries whose operators number rows inside groups.
NUMBERED = [
    "quantiles", "five_num", "row_index", "cum_share", "ntile", "running_counts", "lead_columns", "average_rank", "label_order", "successors",
    "spearman", "adjust_p_values", "trimmed_weights", "posterior_by_week", "stratified_folds", "rotated_tours", "route_legs", "paired_comparison",
]


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def no_cross_join(df):
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def check(spark, sf, con, name):
    q = QUERIES[name]
    df = q.run(spark, sf)
    no_cross_join(df)
    cur = con.execute(q.sql)
    message = compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in cur.description], cur.fetchall())
    assert message is None, message


@pytest.mark.parametrize("name", WITH_SQL)
def test_matches_sql(spark, sf, con, name):
    check(spark, sf, con, name)


@pytest.mark.parametrize("name", NUMBERED)
def test_matches_sql_in_blocks(spark, sf, con, name, monkeypatch):
    monkeypatch.setattr(ordered, "SMALL_BYTES", -1)
    monkeypatch.setattr(ordered, "ROWS_PER_BLOCK", 50)
    check(spark, sf, con, name)


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_gives_rows(spark, sf, name):
    # The smallest tables leave every weekly series with long gaps, which the streak filter drops.
    df = QUERIES[name].run(spark, sf.replace("sf0.001", "sf0.01") if name.startswith("forecast_") else sf)
    no_cross_join(df)
    assert len(set(df.columns)) == len(df.columns)
    assert len(df.take(1)) == 1


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
