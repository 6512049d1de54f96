"""Positions and running totals inside groups of any size.

A plain ``Window.partitionBy(key)`` sorts a whole group in one task, so one key
holding a third of the rows stalls the job. Here the (key, order) space is cut
into contiguous blocks: rows are numbered inside their block, per-block totals
(at most one row per key plus one per block) are accumulated over the blocks of
a key, and the two are joined on (key, block). Any choice of cut points gives
the exact answer; they only decide how even the blocks are.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.session import checkpoint

# Inputs the planner expects to stay under this size are numbered with one window per group. Files are
# estimated by their compressed size, so rows of larger ones are counted, up to a size where blocks are due anyway.
TINY_BYTES = 1024 * 1024
SMALL_BYTES = 64 * 1024 * 1024
# Plan nodes that make rows which the planner's size estimate does not count.
GROWING = re.compile(r"\b(Generate|Expand|MapIn\w+|FlatMap\w+|MapPartitions\w*|LogicalRDD)\b")
LEAST_BLOCKS_LIMIT = 512
ROWS_PER_BLOCK = 250_000
# Hash buckets of keys whose rows tell whether a group is too large for one task.
KEY_BUCKETS = 4096
SAMPLES_PER_BLOCK = 16

KEY, BLOCK = "_grp", "_blk"
FOLD = {"sum": F.sum, "min": F.min, "max": F.max}


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate for ``df``; None where it cannot be asked or relied on."""
    try:
        plan = df._jdf.queryExecution().optimizedPlan()
        return None if GROWING.search(plan.toString()) else int(str(plan.stats().sizeInBytes()))
    except Exception:
        return None


def block_limit(df: DataFrame) -> int:
    """As many blocks as the cluster has shuffle partitions, 512 at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), LEAST_BLOCKS_LIMIT)


def block_count(df: DataFrame, blocks: int | None = None) -> int:
    """1 for input known to be tiny, else one block per shuffle partition."""
    if blocks is not None:
        return blocks
    size = estimated_bytes(df)
    if size is not None and size <= min(TINY_BYTES, SMALL_BYTES):
        return 1
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def blocks_of_rows(rows: int, limit: int) -> int:
    return max(1, min(-(-rows // ROWS_PER_BLOCK), limit))


def only_small_groups(df: DataFrame, keys: Sequence[str]) -> bool:
    """Whether no group has more rows than a block, or than twice an even share of a hash bucket of the keys."""
    bucket = F.pmod(F.xxhash64(*keys), F.lit(KEY_BUCKETS))
    most, rows = df.groupBy(bucket.alias("b")).count().agg(F.max("count"), F.sum("count")).first()
    return (most or 0) <= max(ROWS_PER_BLOCK, 2 * (rows or 0) // KEY_BUCKETS)


def ready(df: DataFrame, blocks: int | None, derived: bool, keys: Sequence[str] = ()) -> tuple[DataFrame, int]:
    """The rows to cut and the number of blocks; counted where the size can't be estimated or relied on.

    Groups of ``keys`` that each fit one task need no blocks, however many rows there are.
    """
    n = block_count(df, blocks)
    if n <= 1:
        return df, n
    size = None if blocks is not None else estimated_bytes(df)
    if derived or (blocks is None and size is None):
        df = checkpoint(df)
    if blocks is None and (derived or size is None or size <= SMALL_BYTES):
        n = blocks_of_rows(df.count(), block_limit(df))
    if n > 1 and blocks is None and keys and only_small_groups(df, keys):
        n = 1
    return df, n


def _tuple(parts: Sequence[Column]) -> Column:
    return F.struct(*[p.alias(f"f{i}") for i, p in enumerate(parts)])


def with_block(df: DataFrame, parts: Sequence[Column], blocks: int, out: str = BLOCK) -> DataFrame:
    """Add each row's block number in the order of ``parts``.

    The cut points are a fixed-size uniform sample of the tuples (smallest
    hashes), so the driver only ever sees ``blocks * SAMPLES_PER_BLOCK`` rows.
    """
    tup = _tuple(parts)
    keyed = df.select(tup.alias("t"))
    fields = keyed.schema["t"].dataType.fields
    rows = (
        keyed.orderBy(F.xxhash64("t")).limit(blocks * SAMPLES_PER_BLOCK).orderBy("t").collect()
    )
    step = max(1, len(rows) // blocks)
    cuts = [r.t for r in rows[step::step]]
    if not cuts:
        return df.withColumn(out, F.lit(0))
    # Two short lookups instead of one long one: the run of cuts, then the place in it.
    width = math.isqrt(len(cuts) - 1) + 1
    literal = [
        F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(cut, fields)]) for cut in cuts
    ]
    runs = [literal[i : i + width] for i in range(0, len(literal), width)]
    passed = lambda array: F.size(F.filter(array, lambda cut: cut <= F.col("_tup")))
    # The tuple and the run are columns of their own, so that no lookup builds them again.
    found = df.withColumn("_tup", tup).withColumn("_run", passed(F.array(*[r[0] for r in runs])))
    inside = passed(F.get(F.array(*[F.array(*r) for r in runs]), F.col("_run") - 1))
    block = F.when(F.col("_run") == 0, F.lit(0)).otherwise((F.col("_run") - 1) * width + inside)
    return found.withColumn(out, block).drop("_tup", "_run")


def with_position(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    position: str | None = "pos",
    total: str | None = None,
    running: Mapping[str, Column | tuple[str, Column]] | None = None,
    totals: Mapping[str, Column] | None = None,
    blocks: int | None = None,
    derived: bool = False,
) -> DataFrame:
    """Add the row number (BIGINT) in group order, and optionally the group's row count,
    running values (current row included) and group sums.

    A running value is a column to sum, or ``("min" | "max" | "sum", column)``.

    ``order`` holds ascending expressions that make a total order in the group;
    negate a number for descending order. ``derived`` says that the input is the
    result of joins or aggregations: unless known to be small it is checkpointed
    (as is input whose size the planner can't estimate, such as exploded rows),
    so that its three uses do not compute it three times, and its counted rows
    decide how many blocks are needed.
    """
    running = {k: v if isinstance(v, tuple) else ("sum", v) for k, v in (running or {}).items()}
    totals = dict(totals or {})
    order = list(order)
    df, n = ready(df, blocks, derived, keys)
    if n <= 1:
        whole = Window.partitionBy(*keys)
        rows = whole.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        new = {name: FOLD[fn](c).over(rows) for name, (fn, c) in running.items()}
        new |= {name: F.sum(c).over(whole) for name, c in totals.items()}
        if position:
            new[position] = F.row_number().over(whole.orderBy(*order)).cast("bigint")
        if total:
            new[total] = F.count(F.lit(1)).over(whole)
        return df.withColumns(new)

    cols = df.columns
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    base = with_block(df, [*map(F.col, keys), *order], n).withColumn(KEY, group)
    per_block = base.groupBy(KEY, BLOCK).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[FOLD[fn](c).alias(f"_r_{k}") for k, (fn, c) in running.items()],
        *[F.sum(c).alias(f"_t_{k}") for k, c in totals.items()],
    )
    over = Window.partitionBy(KEY)
    before = over.orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_block.select(
        F.col(KEY),
        F.col(BLOCK),
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_first"),
        F.sum("_rows").over(over).alias("_all"),
        *[FOLD[fn](f"_r_{k}").over(before).alias(f"_o_{k}") for k, (fn, _) in running.items()],
        *[F.sum(f"_t_{k}").over(over).alias(f"_a_{k}") for k in totals],
    )
    inside = Window.partitionBy(KEY, BLOCK)
    rows = inside.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = {f"_l_{k}": FOLD[fn](c).over(rows) for k, (fn, c) in running.items()}
    if position:
        local["_at"] = F.row_number().over(inside.orderBy(*order))
    out = base.withColumns(local).join(offsets, [KEY, BLOCK])
    new = {}
    for k, (fn, _) in running.items():
        earlier, here = F.col(f"_o_{k}"), F.col(f"_l_{k}")
        if fn == "sum":
            new[k] = F.when(earlier.isNull(), here).otherwise(earlier + F.coalesce(here, F.lit(0)))
        else:
            new[k] = (F.least if fn == "min" else F.greatest)(earlier, here)
    new |= {k: F.col(f"_a_{k}") for k in totals}
    if position:
        new[position] = F.col("_first") + F.col("_at")
    if total:
        new[total] = F.col("_all")
    keep = [c for c in cols if c not in new]
    return out.withColumns(new).select(*keep, *new)


def with_lead(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], cols: Mapping[str, str], blocks: int | None = None, derived: bool = False
) -> DataFrame:
    """Attach columns (new name -> column) of the next row in group order; NULL on the last row.

    ``order`` as in ``with_position``. A block's rows take their successor inside
    the block; only its last row takes the first row of the group's next block,
    which is one row per key and block.
    """
    order = list(order)
    df, n = ready(df, blocks, derived, keys)
    next_row = F.struct(*[F.col(src).alias(dst) for dst, src in cols.items()])
    if n <= 1:
        found = df.withColumn("_to", F.lead(next_row).over(Window.partitionBy(*keys).orderBy(*order)))
        return found.withColumns({dst: F.col("_to")[dst] for dst in cols}).drop("_to")
    group = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    base = with_block(df, [*map(F.col, keys), *order], n).withColumn(KEY, group).withColumn("_own", next_row)
    first = base.groupBy(KEY, BLOCK).agg(F.min_by("_own", _tuple(order)).alias("_first"))
    border = first.select(KEY, BLOCK, F.lead("_first").over(Window.partitionBy(KEY).orderBy(BLOCK)).alias("_border"))
    inside = base.withColumn("_to", F.lead("_own").over(Window.partitionBy(KEY, BLOCK).orderBy(*order)))
    out = inside.join(border, [KEY, BLOCK])
    # A row with a successor in its block has a struct there, even one of NULLs.
    out = out.withColumn("_to", F.coalesce("_to", "_border")).withColumns({dst: F.col("_to")[dst] for dst in cols})
    return out.drop(KEY, BLOCK, "_own", "_to", "_border")


def attach(df: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join one-row-per-group facts back to the rows, matching NULL keys too.

    Facts are aggregated first (map-side combine); the join side is left to the
    planner, which broadcasts only a small measured side and splits hot keys.
    """
    if not keys:
        return df.withColumns({c: facts.select(c).scalar() for c in facts.columns})
    marked = facts.select(
        F.struct(*[F.col(k) for k in keys]).alias(KEY), *[c for c in facts.columns if c not in keys]
    )
    return df.withColumn(KEY, F.struct(*[F.col(k) for k in keys])).join(marked, KEY, how).drop(KEY)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Fixed number of hash partitions ahead of Python model fits.

    Their cost is the fits, not the bytes, so merging small partitions by size
    would leave the work to a few tasks. Grouping by the same keys needs no
    further exchange; without keys the rows are dealt out in turn.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)
