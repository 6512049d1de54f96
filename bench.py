"""Time the headline queries: prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from larkspan.plans.catalog import QUERIES  # noqa: E402
from larkspan.session import local_session  # noqa: E402

HEADLINE = [
    "over_index",
    "summarise",
    "natural_join",
    "quantiles",
    "cum_share",
    "topk_share",
    "running_counts",
    "prepare_series",
    "forecast_groups",
    "yearly_series",
    "mann_kendall",
    "smoothing_forecast",
    "adjust_p_values",
    "weighted_glm",
    "bootstrap_effect",
    "posterior_by_week",
    "shrunken_rates",
    "simulated_seasons",
    "boosted_trees",
    "fuzzy_join",
    "search",
    "related_pages",
    "records",
    "near_pairs",
    "routes",
    "posterior_stream",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores, partitions=int(cores))
    # Start the JVM's and the Python workers' code paths before the clock.
    QUERIES["summarise"].run(spark, folder).count()
    QUERIES["map_groups"].run(spark, folder).count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
