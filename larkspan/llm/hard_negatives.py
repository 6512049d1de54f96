"""Hard-negative mining on lists shared by clusters of anchors.

Anchors of one label that point in similar directions form a cluster. In a block
of candidates, a cluster's list holds the candidates its members may take, sorted
once by an upper bound: with t the angle between candidate and cluster centre
and b the widest angle between centre and member, no member scores more with a
candidate than (both lengths) * cos(max(0, t - b)). Every member walks that list
from the top and leaves it when the bound of the next candidates lies below what
it still needs: its worst kept score, or the lower edge of its window. That
certifies that nothing after it belongs to the result, whatever the clusters are.

Two walks use the same lists: the first finds an anchor's positives (best rows of
its own label), the second the negatives of each positive (best rows of other
labels with a score between ``low`` and ``high`` percent of the positive's).

Anchors are dealt in groups along (length, label, cluster), candidates in blocks;
a task holds one group and meets a stripe of blocks one after another, so that
its thresholds rise on the way and it returns k rows a list at most. A large
label or many copies of one vector fill several groups and blocks like any rows.

Components become integers, floor(scale * x); scores are exact integers.

Cases: rows without an id, a label or a vector, or with a null or non-finite
component take no part. Rows stand for themselves: an anchor's own row is not its
candidate, another row of the same id and vector is, and two anchor rows of one
id give results each. Vectors meet those of the same length only. Fewer positives
or negatives than asked for: all of them; a positive of score 0 or less has the
window between low and high percent of that, which is empty below 0. Components
or scores that leave 64 bits are an error. Empty tables give empty results;
columns other than id, label and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.bit_sliced import SCALE, integers, matrix, met
from larkspan.llm.scratch import Scratch

GROUP_ROWS, BLOCK_ROWS, CHUNK = 8192, 8192, 512
CENTRES, SAMPLE, ROUNDS = 16, 1024, 5
PACKED = "grp int, dim int, label long, cluster int, row binary, id binary, labels binary, v binary, slots binary, pos binary"
_ANGLE, _SHARE, _LEAST = 1e-6, 1e-9, 1e-6  # what rounding may take from a bound


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; an error where one might leave 64 bits."""
    limit = lengths(a).max(initial=0.0) * lengths(b).max(initial=0.0)
    if limit < 2.0**52:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if limit < 2.0**62:
        return a @ b.T
    out = a.astype(object) @ b.T.astype(object)
    if out.size and max(abs(out.max()), abs(out.min())) >= 1 << 63:
        raise OverflowError("an inner product leaves 64 bits")
    return out.astype(np.int64)


def lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(np.float64) ** 2).sum(1))


def directions(rows: np.ndarray) -> np.ndarray:
    size = lengths(rows)
    return rows / np.where(size > 0, size, 1.0)[:, None]


def centres_of(rows: np.ndarray, k: int = CENTRES, rounds: int = ROUNDS) -> np.ndarray:
    """Directions of up to ``k`` centres of the rows' directions, by a few rounds of spherical k-means."""
    unit = directions(rows)
    centres = unit[np.linspace(0, len(unit) - 1, min(k, len(unit))).astype(int)]
    for _ in range(rounds):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 1e-9, sums / np.where(size > 1e-9, size, 1.0), centres)
    return centres


def _clustered(centres: dict[int, np.ndarray]):
    """Adds the nearest centre's number to rows (row, vec_id, label, dim, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            cluster = np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims).tolist():
                if dim in centres:
                    own = np.flatnonzero(dims == dim)
                    cluster[own] = (directions(matrix(batch.column(4), own, dim)) @ centres[dim].T).argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cluster)], [*batch.schema.names, "cluster"])

    return run


def _narrow(v: np.ndarray) -> bytes:
    small = not v.size or (v.min() >= -(1 << 31) and v.max() < 1 << 31)
    return v.astype("<i4" if small else "<i8").tobytes()


def _wide(data: bytes, n: int, dim: int) -> np.ndarray:
    kind = "<i4" if len(data) == 4 * n * dim else "<i8"
    return np.frombuffer(data, kind).astype(np.int64).reshape(n, dim)


def _packed(rows_a_pack: int, by_cluster: bool):
    """One row per run of the partition's rows: bytes of its ids, labels and vectors (and slots, where there are any)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for batch in batches:
            row, ids, labels, dims = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            clusters = batch.column(5).to_numpy(zero_copy_only=False)
            keys = np.stack([dims, labels, clusters], 1) if by_cluster else np.stack([dims, dims * 0, dims * 0], 1)
            slots = batch.column(6).to_pylist() if batch.num_columns > 6 else None
            for key in np.unique(keys, axis=0):
                every = np.flatnonzero((keys == key).all(1))
                for own in np.split(every, range(rows_a_pack, len(every), rows_a_pack)):
                    found = [(i, s, p) for i, at in enumerate(own.tolist()) for s, p in ((x["slot"], x["score"]) for x in slots[at])] if slots else [(i, 0, 0) for i in range(len(own))]
                    which = np.array([[i, s] for i, s, _ in found], np.int64).reshape(-1, 2)
                    pos = np.array([p for _, _, p in found], np.int64)
                    values = [part, int(key[0]), int(key[1]), int(key[2]), row[own].astype("<i8").tobytes(), ids[own].astype("<i8").tobytes(), labels[own].astype("<i8").tobytes(), _narrow(matrix(batch.column(4), own, int(key[0]))), which.tobytes(), pos.tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int32(), pa.int32(), pa.int64(), pa.int32()] + [pa.binary()] * 6)], [c.split()[0] for c in PACKED.split(", ")])

    return run


class Cluster:
    """Members of a cluster, their wanted windows (slots), and the best rows found so far."""

    def __init__(self, label: int, rows: np.ndarray, v: np.ndarray, slots: np.ndarray, low: list[int], high: list[int], k: int):
        self.label, self.rows, self.v, self.k = label, rows, v, k
        self.size = lengths(v)
        unit = directions(v)
        centre = unit.sum(0)
        if np.linalg.norm(centre) < 1e-9:
            centre = unit[self.size.argmax()]
        size = np.linalg.norm(centre)
        self.centre = centre / size if size > 0 else centre
        # A member without direction scores 0 with everything, under any bound.
        cosines = np.where(self.size > 0, unit @ self.centre, 1.0)
        self.widest = float(np.arccos(np.clip(cosines, -1, 1)).max(initial=0.0)) if size > 0 else np.pi
        self.owner, self.slot = slots[:, 0], slots[:, 1]
        # Windows lie within 64 bits, as scores do.
        self.low = np.array([max(x, -(1 << 63)) for x in low], np.int64)
        self.high = np.array([min(x, (1 << 63) - 1) for x in high], np.int64)
        self.found = (np.zeros(0, np.int64),) * 3  # slot number, score, id
        self.worst = self.low.copy()  # least score still of use
        self.worst_id = np.full(len(self.low), np.iinfo(np.int64).max)

    def bounds(self, v: np.ndarray) -> np.ndarray:
        """Upper bound of each candidate's score with any member, per unit of the member's length."""
        size = lengths(v)
        angle = np.arccos(np.clip(np.where(size > 0, directions(v) @ self.centre, 1.0), -1, 1))
        return size * np.cos(np.maximum(0.0, angle - self.widest - _ANGLE))

    def walk(self, rows: np.ndarray, ids: np.ndarray, v: np.ndarray) -> int:
        """Walks the list of a block's candidates; returns the number of scores computed."""
        bound = self.bounds(v)
        order = np.argsort(-bound, kind="stable")
        bound, rows, ids, v = bound[order], rows[order], ids[order], v[order]
        useful = self.low <= self.high
        seen = 0
        for at in range(0, len(order), CHUNK):
            # A slot is certified when the best of what follows lies below its need.
            best = bound[at] * self.size
            need = np.full(len(self.rows), np.inf)
            np.minimum.at(need, self.owner[useful], self.worst[useful].astype(np.float64))
            active = np.flatnonzero(best + np.abs(best) * _SHARE + np.abs(need) * _SHARE + _LEAST >= need)
            if not len(active):
                break
            part = slice(at, at + CHUNK)
            scores = product(self.v[active], v[part])
            seen += scores.size
            place = np.full(len(self.rows), -1)
            place[active] = np.arange(len(active))
            asks = np.flatnonzero(useful & (place[self.owner] >= 0))
            own = scores[place[self.owner[asks]]]
            least = self.worst[asks, None]
            hit = (own >= least) & (own <= self.high[asks, None])
            hit &= (own > least) | (ids[None, part] < self.worst_id[asks, None])
            hit &= rows[None, part] != self.rows[self.owner[asks], None]
            slot, col = np.nonzero(hit)
            if len(slot):
                self.keep(asks[slot], own[slot, col], ids[part][col])
        return seen

    def keep(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        slot, score, ids = (np.concatenate(pair) for pair in zip(self.found, (slot, score, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = rank < self.k
        self.found = slot[kept], score[kept], ids[kept]
        last = rank == self.k - 1
        self.worst[slot[last]], self.worst_id[slot[last]] = score[last], ids[last]


def _walk(k: int, low: int, high: int, same: bool):
    """Rows in order of (group, stripe, anchors first, block) -> the best k rows a slot within each group and stripe."""

    def results(clusters: dict[int, list[Cluster]]) -> Iterator[pa.RecordBatch]:
        for own in clusters.values():
            for c in own:
                slot, score, ids = c.found
                arrays = [c.rows[c.owner[slot]], c.slot[slot], ids, score]
                yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int64)) for a in arrays], ["row", "slot", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, clusters = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                grp, stripe, kind, _, dim, label, _, row, ids, labels, v, slots, pos = (c[i].as_py() for c in batch.columns)
                if (grp, stripe) != now:
                    yield from results(clusters)
                    now, clusters = (grp, stripe), {}
                row = np.frombuffer(row, "<i8")
                v = _wide(v, len(row), dim)
                if kind == 0:
                    which = np.frombuffer(slots, np.int64).reshape(-1, 2)
                    pos = np.frombuffer(pos, np.int64).tolist()
                    least = [-(1 << 63)] * len(which) if same else [-(-low * p // 100) for p in pos]
                    most = [(1 << 63) - 1] * len(which) if same else [high * p // 100 for p in pos]
                    clusters.setdefault(dim, []).append(Cluster(label, row, v, which, least, most, k))
                    continue
                ids, labels = np.frombuffer(ids, "<i8"), np.frombuffer(labels, "<i8")
                for c in clusters.get(dim, []):
                    own = np.flatnonzero((labels == c.label) == same)
                    if len(own):
                        c.walk(row[own], ids[own], v[own])
        yield from results(clusters)

    return run


def hard_negatives(
    vectors: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", group_rows: int = GROUP_ROWS, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors`` is a condition on the columns of ``vectors``. The centres are
    fitted on at most ``SAMPLE`` anchors; they only decide which members share a
    list, never what is found.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    asks = F.coalesce(anchors, F.lit(False))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("e"), asks.alias("asks"))
    rows = integers(rows.where("id is not null and label is not null"), "e", "v", scale)
    base = scratch.store(rows.select(F.monotonically_increasing_id().alias("row"), "id", "label", F.size("v").alias("dim"), "v", "asks"), "rows")
    plain = ["row", "id", "label", "dim", "v"]
    n, n_asks = base.agg(F.count("*"), F.count_if("asks")).first()
    blocks = max(1, -(-n // block_rows))
    spread = max(blocks, min(2 * spark.sparkContext.defaultParallelism, -(-n // CHUNK)))
    index = scratch.store(base.select(*plain, F.lit(0).alias("cluster")).repartition(max(1, spread), "row").mapInArrow(_packed(block_rows, False), PACKED), "blocks")

    sample = base.where("asks").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("dim", "v").collect()
    by_dim: dict[int, list] = {}
    for r in sample:
        by_dim.setdefault(r["dim"], []).append(r["v"])
    centres = {dim: centres_of(np.array(v, np.float64)) for dim, v in by_dim.items() if dim}
    asked = scratch.store(base.where("asks").select(*plain).mapInArrow(_clustered(centres), "row long, id long, label long, dim int, v array<bigint>, cluster int"), "anchors")

    def found(members: DataFrame, k: int, same: bool) -> DataFrame:
        ranged = members.repartitionByRange(max(1, -(-n_asks // group_rows)), "dim", "label", "cluster", "row")
        packed = scratch.store(ranged.sortWithinPartitions("dim", "label", "cluster", "row").mapInArrow(_packed(group_rows, True), PACKED), "groups")
        groups = sorted(r["grp"] for r in packed.select("grp").distinct().collect())
        stripes = max(1, min(spread, -(-2 * spark.sparkContext.defaultParallelism // max(1, len(groups)))))
        near = met(packed, index, groups or [0], stripes).mapInArrow(_walk(k, low, high, same), "row long, slot long, id long, score long")
        best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
        return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)

    first = scratch.store(found(asked, positives, True).select("row", F.col("rank").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    wanted = first.groupBy("row").agg(F.collect_list(F.struct("slot", F.col("positive_score").alias("score"))).alias("slots"))
    second = found(asked.join(wanted, "row").select(*plain, "cluster", "slots"), negatives, False)
    named = first.join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    out = second.select("row", "slot", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(named, ["row", "slot"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
