"""Boosted regression trees on binned features, many fits at once.

Features are binned once, by cut points from Spark's quantile sketch. Rows of
one fold with equal bins are one cell: a tree can't tell them apart, so their
number and their sum of y is all that growing needs. A level of a tree is one
histogram (sum and count per fit, node, feature and bin). Cells that fit one
task are dealt by fit: every fit is a task of its own and nothing is exchanged.
More cells are dealt in blocks, which stay in Spark's storage with their
predictions; a level is one job that adds up the blocks' histograms. A job takes
some hundredths of a second, a barrier stage's all-gather a whole one. Per level
bins times features go to the driver, never rows. Errors of shorter models are
read off by walking the left-out folds down the finished trees: rows are dealt by
their bins, so that a task walks few cells, each once for all fits.

Values and predictions are integers of a fixed scale, so histogram sums are
exact and a model doesn't depend on how rows are dealt. The first tree enters
whole, later ones times ``rate``; leaves are means, splits take the largest drop
in squared error among ``mtry`` features drawn per node by a hash of seed, tree
and node. Nodes without a gain pass their rows on, so all trees are complete.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.session import checkpoint

BINS = 32
CELLS_PER_TASK = 1_000_000
CELLS_PER_BLOCK = 500_000
ROWS_PER_WALK = 1 << 18
# Blocks whose histograms are added up on the driver, not by tasks before it; trees between checkpoints of the blocks.
FEW_BLOCKS = 32
TREES_PER_CHECKPOINT = 20
TREE = "fit int, tree int, feature array<int>, cut array<int>, gain array<double>, leaf array<double>"
STAGED = "fit int, trees int, error double, n long"


@dataclass(frozen=True)
class Plan:
    """What to grow: per fit the features a node may choose from and the fold left out (None: no fold)."""

    mtry: tuple[int, ...]
    left_out: tuple[int | None, ...]
    trees: int
    rate: float
    depth: int
    seed: int
    scale: float
    features: int
    staged: tuple[int, ...] = ()

    def weight(self, tree: int) -> float:
        return self.rate if tree else 1.0


class _Cells:
    """The cells of one block that one fit learns from."""

    def __init__(self, plan: Plan, fit: int, block: tuple, pred: np.ndarray | None = None):
        self.plan, self.fit = plan, fit
        bins, n, y, fold = block
        out = plan.left_out[fit]
        if out is not None:
            kept = np.flatnonzero(fold != out)
            bins, n, y = bins[kept], n[kept], y[kept]
        self.bins, self.n, self.y = bins, n, y
        # Cells of each feature's histogram, a row per feature.
        self.at = np.ascontiguousarray(bins.T.astype(np.int64))
        self.pred = np.zeros(len(y)) if pred is None else pred
        self.first = np.arange(len(y)) * plan.features

    def start(self) -> None:
        self.g = self.y - self.n * np.rint(self.pred * self.plan.scale)
        self.node = np.zeros(len(self.y), np.int64)

    def histogram(self, level: int) -> np.ndarray:
        """Sums and counts, [2, nodes, features, bins]."""
        out = np.empty((2, 1 << level, self.plan.features, BINS))
        first = self.node * BINS
        for j, at in enumerate(self.at):
            where = at + first
            out[0, :, j] = np.bincount(where, self.g, BINS << level).reshape(-1, BINS)
            out[1, :, j] = np.bincount(where, self.n, BINS << level).reshape(-1, BINS)
        return out

    def move(self, feature: np.ndarray, cut: np.ndarray) -> None:
        self.node = 2 * self.node + (self.bins.ravel().take(self.first + feature[self.node]) > cut[self.node])

    def finish(self, tree: int, leaf: np.ndarray) -> None:
        self.pred = self.pred + self.plan.weight(tree) * leaf[self.node]


def _split(plan: Plan, fit: int, sums: np.ndarray, tree: int, level: int) -> tuple[np.ndarray, ...]:
    """Feature, cut, gain of each node; sums and counts of its children."""
    nodes = 1 << level
    g, n = sums
    left_g, left_n = np.cumsum(g, -1), np.cumsum(n, -1)
    all_g, all_n = left_g[:, :1, -1:], left_n[:, :1, -1:]
    right_g, right_n = all_g - left_g, all_n - left_n
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = np.where(all_n > 0, all_g**2 / all_n, 0.0)
        gain = left_g**2 / left_n + right_g**2 / right_n - whole
    gain[(left_n == 0) | (right_n == 0)] = -np.inf
    if plan.mtry[fit] < plan.features:
        order = np.random.default_rng([plan.seed, tree, level, plan.mtry[fit]]).random((nodes, plan.features)).argsort(1).argsort(1)
        gain[order >= plan.mtry[fit]] = -np.inf
    best = gain.reshape(nodes, -1).argmax(1)
    top = gain.reshape(nodes, -1)[np.arange(nodes), best]
    splits = top > 1e-9 * np.maximum(1.0, whole[:, 0, 0])
    feature, cut = np.where(splits, best // BINS, 0), np.where(splits, best % BINS, BINS - 1)
    pick = (np.arange(nodes), feature, cut)
    child_g = np.stack([left_g[pick], right_g[pick]], 1).ravel()
    child_n = np.stack([left_n[pick], right_n[pick]], 1).ravel()
    return feature, cut, np.where(splits, top, 0.0) / plan.scale**2, child_g, child_n


def _leaves(plan: Plan, child_g: np.ndarray, child_n: np.ndarray) -> np.ndarray:
    return np.where(child_n > 0, child_g / np.maximum(child_n, 1), 0.0) / plan.scale


def _row(fit: int, tree: int, grown: list, leaf: np.ndarray) -> dict:
    """A row of TREE; ``grown`` has feature, cut and gain of each level."""
    feature, cut, gain = (np.concatenate(part).tolist() for part in zip(*grown))
    return {"fit": fit, "tree": tree, "feature": feature, "cut": cut, "gain": gain, "leaf": leaf.tolist()}


def _grow(plan: Plan, fit: int, block: tuple) -> Iterator[dict]:
    """All trees of a fit whose cells are in one task."""
    cells = _Cells(plan, fit, block)
    for tree in range(plan.trees):
        cells.start()
        grown = []
        for level in range(plan.depth):
            *node, child_g, child_n = _split(plan, fit, cells.histogram(level), tree, level)
            cells.move(*node[:2])
            grown.append(node)
        leaf = _leaves(plan, child_g, child_n)
        cells.finish(tree, leaf)
        yield _row(fit, tree, grown, leaf)


def _merged(block: tuple) -> tuple:
    """The block with cells of equal bins as one, whatever their folds."""
    bins, n, y, fold = block
    if not len(n):
        return block
    _, first, at = np.unique(np.ascontiguousarray(bins).view(f"V{bins.shape[1]}").ravel(), return_index=True, return_inverse=True)
    return bins[first], np.bincount(at, n), np.bincount(at, y), fold[first]


def _grow_in_jobs(plan: Plan, blocks: RDD) -> list[dict]:
    """All trees of all fits over blocks of cells, a job a level."""
    fits = range(len(plan.mtry))
    state = blocks.map(lambda block: (block, [None] * len(plan.mtry))).persist(StorageLevel.MEMORY_AND_DISK)
    few, out, last = blocks.getNumPartitions() <= FEW_BLOCKS, [], None

    def placed(element: tuple, fit: int, grown: list) -> _Cells:
        cells = _Cells(plan, fit, element[0], element[1][fit])
        cells.start()
        for feature, cut, _ in grown:
            cells.move(feature, cut)
        return cells

    def histograms(trees: list):
        return lambda element: np.stack([placed(element, f, trees[f]).histogram(len(trees[f])) for f in fits])

    def finished(tree: int, trees: list, leaves: list):
        def run(element: tuple) -> tuple:
            preds = []
            for f in fits:
                cells = placed(element, f, trees[f])
                cells.finish(tree, leaves[f])
                preds.append(cells.pred)
            return element[0], preds

        return run

    for tree in range(plan.trees):
        trees = [[] for _ in fits]
        for level in range(plan.depth):
            found = state.map(histograms([list(t) for t in trees]))
            sums = sum(found.collect()) if few else found.treeReduce(np.add)
            if last is not None:
                last.unpersist()
                last = None
            ends = []
            for f in fits:
                *node, child_g, child_n = _split(plan, f, sums[f], tree, level)
                trees[f].append(node)
                ends.append((child_g, child_n))
        leaves = [_leaves(plan, *end) for end in ends]
        out += [_row(f, tree, trees[f], leaves[f]) for f in fits]
        last, state = state, state.map(finished(tree, trees, leaves)).persist(StorageLevel.MEMORY_AND_DISK)
        if (tree + 1) % TREES_PER_CHECKPOINT == 0:
            state.checkpoint()  # written by the next job, so that the lineage stays short
    for held in (last, state):
        if held is not None:
            held.unpersist()
    return out


def _binned(table: pa.Table, cuts: Sequence[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, table.column(i).to_numpy(), side="left").astype(np.uint8) for i, c in enumerate(cuts)], 1)


def _binned_rows(rows: DataFrame, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Rows (features, then y, then fold) as bins, fold and y."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            ends = pa.py_buffer(np.arange(0, width * batch.num_rows + 1, width, dtype=np.int32))
            bins = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(_binned(table, cuts).tobytes())])
            yield pa.RecordBatch.from_arrays([bins, batch.column(width + 1), batch.column(width)], ["bins", "fold", "y"])

    return rows.mapInArrow(run, "bins binary, fold long, y double")


def _cells(rows: DataFrame, cuts: Sequence[np.ndarray], scale: float) -> DataFrame:
    """Rows (features, then y, then fold) as cells: bins, fold, number of rows, sum of scaled y."""
    y = F.rint(F.col("y") * F.lit(float(scale))).cast("long")
    return _binned_rows(rows, cuts).groupBy("bins", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("y"))


def _block(table: pa.Table, features: int) -> tuple:
    """Bins, numbers of rows, sums of y and folds of cells."""
    bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, features)
    return bins, *(table.column(c).to_numpy().astype(np.float64) for c in ("n", "y")), table.column("fold").to_numpy()


def _staged(plan: Plan, rows: DataFrame, cuts: Sequence[np.ndarray], trees: list) -> DataFrame:
    """Sum of absolute errors and number of the left-out rows, per fit and length of the model."""
    grown = sorted(trees, key=lambda t: (t["fit"], t["tree"]))
    fits, width = len(plan.mtry), len(cuts)
    # Features and cuts are less than 256. A tree's nodes or leaves of all fits lie side by side.
    kept = tuple(np.array([t[c] for t in grown], kind).reshape(fits, plan.trees, -1).swapaxes(0, 1).reshape(plan.trees, -1) for c, kind in (("feature", np.uint8), ("cut", np.uint8), ("leaf", np.float64)))
    shared = rows.sparkSession.sparkContext.broadcast(kept)
    nodes, leaves = (1 << plan.depth) - 1, 1 << plan.depth

    def walk(table: pa.Table) -> pa.RecordBatch:
        bins = np.frombuffer(b"".join(table.column("bins").to_pylist()), np.uint8).reshape(-1, width)
        y, fold = table.column("y").to_numpy(), table.column("fold").to_numpy()
        held, cells, fit_of = [], [], []
        for fit, out in enumerate(plan.left_out):
            if out not in plan.left_out[:fit]:
                mine = np.flatnonzero(fold == out)
                some, at = np.unique(np.ascontiguousarray(bins[mine]).view(f"V{width}").ravel(), return_inverse=True)
                own = out, some.view(np.uint8).reshape(-1, width), mine, at
                held.append(own)
            else:
                own = next(h for h in held if h[0] == out)
            cells.append(own[1])
            fit_of.append(own)
        sizes = [len(c) for c in cells]
        flat = np.concatenate(cells).ravel()
        begin, pred = np.arange(0, len(flat), width), np.zeros(sum(sizes))
        first_node, first_leaf = np.repeat(np.arange(fits) * nodes, sizes), np.repeat(np.arange(fits) * leaves, sizes)
        starts, found = np.cumsum([0, *sizes]), []
        for tree, (feature, cut, leaf) in enumerate(zip(*shared.value)):
            node = np.zeros(len(pred), np.int64)
            for level in range(plan.depth):
                place = node + (first_node + ((1 << level) - 1))
                node = 2 * node + (flat.take(begin + feature.take(place)) > cut.take(place))
            pred += plan.weight(tree) * leaf.take(first_leaf + node)
            if tree + 1 in plan.staged:
                for fit, (_, _, mine, at) in enumerate(fit_of):
                    if len(mine):
                        found.append((fit, tree + 1, float(np.abs(y[mine] - pred[starts[fit] + at]).sum()), len(mine)))
        columns = zip(*found) if found else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()))], ["fit", "trees", "error", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_PER_WALK:
                yield walk(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield walk(pa.Table.from_batches(held))

    # A cell's walk takes far longer than its bytes suggest; a cell of very many rows is cut by their numbers.
    dealt = _binned_rows(rows, cuts).withColumn("at", F.monotonically_increasing_id())
    return dealt.repartitionByRange(rows.sparkSession.sparkContext.defaultParallelism, "bins", "at").mapInArrow(run, STAGED)


def cut_points(df: DataFrame, x: Sequence[str]) -> list[np.ndarray]:
    """Up to BINS - 1 cut points per feature, halfway between neighbouring quantiles."""
    found = df.approxQuantile(list(x), np.linspace(0, 1, BINS).tolist(), 0.001)
    values = [np.unique(np.array(q, np.float64)) for q in found]
    return [(v[:-1] + v[1:]) / 2 for v in values]


def grown(df: DataFrame, x: Sequence[str], y: str, fold: str | None, plan: dict, rows_per_task: int | None = None) -> tuple[DataFrame, list[np.ndarray]]:
    """Trees (or staged errors) of all fits of ``plan`` as rows, and the cut points. ``df`` is read several times.

    ``rows_per_task`` is the most cells that a task may hold whole.
    """
    spark = df.sparkSession
    parallelism = spark.sparkContext.defaultParallelism
    n, largest = df.agg(F.count("*"), F.max(F.abs(F.col(y)))).first()
    cuts = cut_points(df, x) if n else [np.zeros(0)] * len(x)
    # Sums of n residuals of up to twice the largest y stay whole numbers of a double.
    scale = 2.0 ** (51 - np.ceil(np.log2(max(2.0 * n * (largest or 1.0), 1.0))))
    todo = Plan(**plan, scale=scale, features=len(x))
    fits, width = len(todo.mtry), len(x)
    rows = df.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(x)], F.col(y).cast("double").alias("y"), (F.col(fold).cast("long") if fold else F.lit(-1).cast("long")).alias("fold"))
    cells = checkpoint(_cells(rows, cuts, scale))
    count = cells.count()
    if count <= (rows_per_task or CELLS_PER_TASK):

        def whole(key: tuple, table: pa.Table) -> pa.Table:
            block = _block(table, width)
            out = todo.left_out[key[0].as_py()]
            kept = np.flatnonzero(block[3] != out) if out is not None else slice(None)
            return pa.Table.from_pylist(list(_grow(todo, key[0].as_py(), _merged(tuple(v[kept] for v in block)))), kind)

        kind = pa.schema([("fit", pa.int32()), ("tree", pa.int32()), *((c, pa.list_(t)) for c, t in (("feature", pa.int32()), ("cut", pa.int32()), ("gain", pa.float64()), ("leaf", pa.float64())))])
        dealt = cells.withColumn("fit", F.explode(F.array(*map(F.lit, range(fits)))))  # few cells, each once per fit
        trees = dealt.repartitionByRange(max(fits, 1), "fit").groupBy("fit").applyInArrow(whole, TREE)
        return (_staged(todo, rows, cuts, trees.collect()) if todo.staged else trees), cuts

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            parts = _block(pa.Table.from_batches(held), width)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in parts], ["bins", "n", "y", "fold"])

    def unpacked(row) -> tuple:
        bins, *rest = (np.frombuffer(v, t) for v, t in zip(row, (np.uint8, np.float64, np.float64, np.int64)))
        return bins.reshape(-1, width), *rest

    tasks = max(parallelism, -(-count // CELLS_PER_BLOCK))
    blocks = cells.repartition(tasks).mapInArrow(packed, "bins binary, n binary, y binary, fold binary").rdd.map(unpacked)
    trees = _grow_in_jobs(todo, blocks)
    return (_staged(todo, rows, cuts, trees) if todo.staged else spark.createDataFrame([tuple(t.values()) for t in trees], TREE)), cuts


def _places(df: DataFrame, x: Sequence[str], cuts: Sequence[np.ndarray]) -> DataFrame:
    """Per feature how many of its cuts, finite and rising, are below the value: b0, b1, ...; -1 is missing, -2 is minus infinity.

    Spark's Bucketizer looks values up without Python. Its buckets hold their lower end and a place its upper one, so signs are turned.
    """
    turned = df.select(*[(F.lit(0.0) - F.col(c).cast("double")).alias(f"x{i}") for i, c in enumerate(x)])
    some = [i for i, c in enumerate(cuts) if len(c)]
    if some:
        splits = [[-np.inf, *(0.0 - cuts[i][::-1]).tolist(), np.inf] for i in some]
        turned = Bucketizer(splitsArray=splits, inputCols=[f"x{i}" for i in some], outputCols=[f"at{i}" for i in some], handleInvalid="keep").transform(turned)

    def place(i: int) -> Column:
        value = F.col(f"x{i}")
        known = F.lit(len(cuts[i])) - F.col(f"at{i}").cast("int") if len(cuts[i]) else F.lit(0)
        return F.when(value.isNull() | F.isnan(value), -1).when(value == np.inf, -2).otherwise(known).alias(f"b{i}")

    return turned.select(*map(place, range(len(cuts))))


class BoostedTrees:
    """A fitted model; ``transform`` adds ``prediction`` to rows without missing features."""

    def __init__(self, names: Sequence[str], trees: Sequence, cuts: Sequence[np.ndarray], rate: float):
        self.names = list(names)
        self.feature = np.array([t["feature"] for t in trees], np.int64)
        self.leaf = np.array([t["leaf"] for t in trees], np.float64)
        self.weight = np.array([rate if t["tree"] else 1.0 for t in trees])
        gain = np.array([t["gain"] for t in trees], np.float64)
        self.gains = np.bincount(self.feature.ravel(), gain.ravel(), len(self.names))
        # Rows up to the cut go left; past the last cut everything does.
        self.cut = np.array([[cuts[f][c] if c < len(cuts[f]) else np.inf for f, c in zip(t["feature"], t["cut"])] for t in trees])

    def predict(self, x: np.ndarray) -> np.ndarray:
        out, every = np.zeros(len(x)), np.arange(len(x))
        depth = int(self.leaf.shape[1]).bit_length() - 1
        for feature, cut, leaf, weight in zip(self.feature, self.cut, self.leaf, self.weight):
            node, first = np.zeros(len(x), np.int64), 0
            for level in range(depth):
                at = first + node
                node = 2 * node + (x[every, feature[at]] > cut[at])
                first += 1 << level
            out += weight * leaf[node]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        model = self

        @F.pandas_udf("double")
        def predicted(*cols: pd.Series) -> pd.Series:
            return pd.Series(model.predict(np.stack([c.to_numpy(np.float64) for c in cols], 1)))

        return df.dropna(subset=self.names).withColumn("prediction", predicted(*[F.col(c).cast("double") for c in self.names]))

    def cuts_of(self, name: str) -> np.ndarray:
        """The finite cuts of the trees' splits on a feature."""
        return np.unique(self.cut[(self.feature == self.names.index(name)) & np.isfinite(self.cut)])

    def alike(self, df: DataFrame) -> DataFrame:
        """Features that stand for all rows of ``df`` that no tree tells from them, and the number of those rows (``_n``).

        A value becomes the least cut of the trees that is not below it, missing ones stay missing.
        """
        cuts = [self.cuts_of(name) for name in self.names]
        places = [f"b{f}" for f in range(len(cuts))]
        counts = _places(df, self.names, cuts).groupBy(*places).agg(F.count(F.lit(1)).alias("_n"))
        ends = [F.array(*map(F.lit, [*c.tolist(), float("inf")])) for c in cuts]
        values = [F.when(F.col(b) >= 0, F.element_at(end, F.col(b) + 1)).when(F.col(b) == -2, F.lit(float("-inf"))) for b, end in zip(places, ends)]
        return counts.select(*[v.alias(name) for name, v in zip(self.names, values)], "_n")

    def kinds(self, names: Sequence[str]) -> int:
        """The most rows of these features that ``alike`` tells apart, missing and infinite values counted."""
        return math.prod(len(self.cuts_of(name)) + 3 for name in names)

    @property
    def scale(self) -> float:
        """A power of two by which predictions may be multiplied and rounded: as whole numbers their sums are exact."""
        return 2.0 ** (51 - np.ceil(np.log2(max(float(self.weight @ np.abs(self.leaf).max(1)), 1e-250))))


def fitted(df: DataFrame, x: Sequence[str], y: str, trees: int, mtry: int | None, rate: float, depth: int, seed: int, rows_per_task: int | None = None) -> BoostedTrees:
    plan = {"mtry": (min(mtry or len(x), len(x)),), "left_out": (None,), "trees": trees, "rate": rate, "depth": depth, "seed": seed}
    out, cuts = grown(df, x, y, None, plan, rows_per_task)
    return BoostedTrees(x, sorted(out.collect(), key=lambda t: t["tree"]), cuts, rate)
