"""Flagship and name-count queries: a nation stands for a state, (segment/priority) for a name."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators.aggregates import over_index
from larkspan.operators.windows import top_n
from larkspan.plans.registry import query


def name_counts(t):
    """Orders as (state, region, name, n) rows, one per order."""
    customers = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    return (
        t.orders.select("o_custkey", "o_orderpriority", "o_orderdate")
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("state"),
            F.concat_ws("/", "c_mktsegment", "o_orderpriority").alias("name"),
            F.year("o_orderdate").alias("year"),
            F.lit(1).alias("frequency"),
        )
    )


NAMES = """
WITH rows AS (
  SELECT n_name AS state, c_mktsegment || '/' || o_orderpriority AS name, year(o_orderdate)::INT AS year
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), counts AS (SELECT state, name, count(*) AS n FROM rows GROUP BY ALL)
"""


@query(
    "over_index",
    "E7 F1 D8 D1 E1 G1",
    NAMES
    + """, ratios AS (
  SELECT name, state, n, entity_total, group_total,
         (n / group_total) / (entity_total / (SELECT sum(n) FROM counts)) AS overrepresented_ratio
  FROM counts
  JOIN (SELECT name, sum(n)::BIGINT AS entity_total FROM counts GROUP BY name) USING (name)
  JOIN (SELECT state, sum(n)::BIGINT AS group_total FROM counts GROUP BY state) USING (state)
  WHERE n >= 2 AND entity_total >= 5
)
SELECT name, state, n, entity_total, group_total, round(overrepresented_ratio, 6) AS overrepresented_ratio
FROM ratios QUALIFY rank() OVER (PARTITION BY state ORDER BY ratios.overrepresented_ratio DESC) <= 10
""",
)
def _(t):
    rated = over_index(name_counts(t), "name", "state", "frequency", 2, 5)
    best = top_n(rated, ["state"], 10, "overrepresented_ratio")
    return best.select(
        "name", "state", "n", "entity_total", "group_total", F.round("overrepresented_ratio", 6).alias("overrepresented_ratio")
    )
