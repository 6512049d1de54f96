"""Exact top-k inner products on a bit-sliced index.

Vectors become integers, floor(256 x) per component. The index keeps blocks of
rows; in a block each component is a set of bitmaps, one per binary digit of its
distance from the block's least value. A query's score is a sum of shifted
slices: the digits of each query component pick the shifts, a negative component
reads the inverted slices. Carry-save adders fold all bitmaps of a weight at
once, three to two, until one bitmap per weight is left. The top rows are chosen
from the most significant slice downward; the rows left equal at the boundary
are taken by smallest id. Every step is exact.

Queries are dealt in groups, index rows in blocks; a task holds one group and
meets a stripe of blocks one after another, so that a block is sent once per
group and a task returns k rows a query.

Cases: vectors that are null or hold a null or non-finite component take no
part, nor do rows without an id; components or scores that leave 64 bits are an
error. Vectors meet those of the same length only. Rows stand for themselves: a
query's own row is not its candidate, another row of the same id is, and two
rows of one id that ask get a ranking each. Empty tables give no rows. Columns
other than id and vector are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch

SCALE = 256
INDEX_ROWS, QUERY_ROWS = 8192, 4096

_U = np.uint64


def integers(df: DataFrame, vector_col: str, out: str, scale: int = SCALE) -> DataFrame:
    """``df`` with ``out``, floor(scale * x) of the components of an array of doubles, as longs.

    Rows whose vector is null or holds a null or non-finite component go; a
    component that doesn't fit a long is an error.
    """
    fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = df.where(F.col(vector_col).isNotNull()).where(fine)
    over = F.raise_error(F.lit("a vector component leaves 64 bits")).cast("long")
    return kept.withColumn(out, F.transform(vector_col, lambda x: F.when(F.abs(x * scale) < 2.0**63, F.floor(x * scale).cast("long")).otherwise(over)))


def quantised(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, the integer vector v and the flag ``asks`` of the rows that take part."""
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("e"), "asks")
    return integers(rows.where(F.col("vec_id").isNotNull()), "e", "v").select("vec_id", "v", "asks")


def matrix(vectors: pa.Array, own: np.ndarray, dim: int) -> np.ndarray:
    """The rows ``own`` of a list column, all of length ``dim``."""
    ends = vectors.offsets.to_numpy()[1:].astype(np.int64)
    flat = vectors.values.to_numpy(zero_copy_only=False)
    return flat[(ends[own] - dim)[:, None] + np.arange(dim)].astype(np.int64).reshape(len(own), dim)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per vector length and run of the partition's rows (row, vec_id, v): their numbers, ids and vectors as bytes."""
    part = TaskContext.get().partitionId()
    for batch in batches:
        rows, ids = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
        sizes = np.diff(batch.column(2).offsets.to_numpy())
        for dim in np.unique(sizes).tolist():
            every = np.flatnonzero(sizes == dim)
            for own in np.split(every, range(INDEX_ROWS, len(every), INDEX_ROWS)):
                values = [part, dim, *(x.astype("<i8").tobytes() for x in (rows[own], ids[own], matrix(batch.column(2), own, dim)))]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, [pa.int32()] * 2 + [pa.binary()] * 3)], ["grp", "dim", "row", "id", "v"])


PACKED = "grp int, dim int, row binary, id binary, v binary"


def met(asked: DataFrame, blocks: DataFrame, groups: list[int], stripes: int) -> DataFrame:
    """Packed queries and index blocks, every group with every block: within each (grp, stripe) the
    queries first (kind 0), then the blocks (kind 1)."""
    rest = [c for c in asked.columns if c != "grp"]
    left = asked.select("grp", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))).alias("stripe"), F.lit(0).alias("kind"), F.lit(0).alias("block"), *rest)
    right = blocks.select(F.explode(F.array(*map(F.lit, groups))).alias("to"), (F.col("grp") % stripes).alias("stripe"), F.lit(1).alias("kind"), F.col("grp").alias("block"), *rest)
    both = left.unionByName(right.withColumnRenamed("to", "grp"))
    return both.repartition(len(groups) * stripes, "grp", "stripe").sortWithinPartitions("grp", "stripe", "kind", "block")


class Slices:
    """A block's bitmaps: ``bits[j]`` slices of component j, and their inverse."""

    def __init__(self, numbers: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        self.numbers, self.ids, self.n, self.dim = numbers, ids, *rows.shape
        self.low = rows.min(0)
        shifted = rows.view(_U) - self.low.view(_U)  # distances fit 64 bits without a sign
        self.width = [int(x).bit_length() for x in shifted.max(0)]
        words = -(-self.n // 64)
        maps = np.zeros((sum(self.width), words * 8), np.uint8)
        self.first = np.concatenate([[0], np.cumsum(self.width)]).astype(np.int64)
        for j, width in enumerate(self.width):
            for b in range(width):
                packed = np.packbits((shifted[:, j] >> _U(b) & _U(1)).astype(np.uint8), bitorder="little")
                maps[self.first[j] + b, : len(packed)] = packed
        maps = maps.view(_U)
        # Slices, then their inverses.
        self.maps = np.concatenate([maps, ~maps])
        everyone = np.zeros(words * 8, np.uint8)
        packed = np.packbits(np.ones(self.n, np.uint8), bitorder="little")
        everyone[: len(packed)] = packed
        self.everyone = everyone.view(_U)

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray | None], int]:
        """Bitmaps of the sum by weight, and the constant that makes it the inner product."""
        chosen: dict[int, list[int]] = {}
        constant, half = 0, len(self.maps) // 2
        for j, q in enumerate(query.tolist()):
            constant += q * int(self.low[j])
            width = self.width[j]
            if not q or not width:
                continue
            start = int(self.first[j]) + (half if q < 0 else 0)
            if q < 0:
                constant -= -q * ((1 << width) - 1)
            q = abs(q)
            for k in range(q.bit_length()):
                if q >> k & 1:
                    for b in range(width):
                        chosen.setdefault(k + b, []).append(start + b)
        out: list[np.ndarray | None] = []
        carries: list[np.ndarray] = []
        weight = 0
        while weight <= max(chosen, default=-1) or carries:
            parts = [self.maps[chosen[weight]]] if weight in chosen else []
            rows = np.concatenate(parts + carries) if parts or carries else np.zeros((0, 0), _U)
            carries = []
            while len(rows) >= 3:
                k = len(rows) // 3
                a, b, c = rows[:k], rows[k : 2 * k], rows[2 * k : 3 * k]
                both = a ^ b
                carries.append(a & b | both & c)
                rows = np.concatenate([both ^ c, rows[3 * k :]])
            if len(rows) == 2:
                carries.append(rows[:1] & rows[1:])
                rows = rows[:1] ^ rows[1:]
            out.append(rows[0] if len(rows) else None)
            weight += 1
        return out, constant

    def top(self, query: np.ndarray, own: int, k: int) -> list[tuple[int, int]]:
        """Scores and ids of the k best rows other than row ``own``; ties by smaller id."""
        slices, constant = self.sums(query)
        tied = self.everyone.copy()
        for at in np.flatnonzero(self.numbers == own):
            tied[at // 64] &= ~(_U(1) << _U(at % 64))
        sure = np.zeros_like(tied)
        for bits in reversed(slices):
            if bits is None:
                continue
            above = tied & bits
            count = int(np.bitwise_count(sure | above).sum())
            if count > k:
                tied = above
            else:
                sure |= above
                tied &= ~bits
                if count == k:
                    tied[:] = 0
                    break
        place = np.flatnonzero(np.unpackbits(sure.view(np.uint8), bitorder="little"))
        edge = np.flatnonzero(np.unpackbits(tied.view(np.uint8), bitorder="little"))
        if len(edge):
            edge = edge[np.argsort(self.ids[edge], kind="stable")][: k - len(place)]
            place = np.concatenate([place, edge])
        score = [constant] * len(place)
        for weight, bits in enumerate(slices):
            if bits is not None:
                for i, bit in enumerate(((bits[place // 64] >> (place % 64).astype(_U)) & _U(1)).tolist()):
                    score[i] += bit << weight
        if score and max(map(abs, score)) >= 1 << 63:
            raise OverflowError("an inner product leaves 64 bits")
        return list(zip(score, self.ids[place].tolist()))


def _search(k: int):
    def results(asked: dict[int, list]) -> Iterator[pa.RecordBatch]:
        for queries in asked.values():
            flat = [(row, own, *hit) for row, own, _, best in queries for hit in best]
            if flat:
                row, own, score, ids = zip(*flat)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (row, own, ids, score)], ["row", "query_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked = None, {}
        for batch in batches:
            for i in range(batch.num_rows):
                grp, stripe, kind, _, dim, numbers, ids, rows = (c[i].as_py() for c in batch.columns)
                if (grp, stripe) != now:
                    yield from results(asked)
                    now, asked = (grp, stripe), {}
                numbers, ids = np.frombuffer(numbers, "<i8"), np.frombuffer(ids, "<i8")
                rows = np.frombuffer(rows, "<i8").reshape(len(ids), dim)
                if kind == 0:
                    asked.setdefault(dim, []).extend([number, own, query, []] for number, own, query in zip(numbers.tolist(), ids.tolist(), rows))
                elif dim in asked:
                    slices = Slices(numbers, ids, rows)
                    for query in asked[dim]:
                        both = query[3] + slices.top(query[2], query[0], k)
                        query[3] = sorted(both, key=lambda hit: (-hit[0], hit[1]))[:k]
        yield from results(asked)

    return run


def top_inner_products(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best rows of ``vectors`` for each of its rows that fulfils ``queries``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "bit-sliced")
    flagged = vectors.select(F.col(id_col), F.col(vector_col), F.coalesce(queries, F.lit(False)).alias("asks"))
    base = scratch.store(quantised(flagged, id_col, vector_col).select(F.monotonically_increasing_id().alias("row"), "vec_id", "v", "asks"), "rows")
    n, n_asks = base.agg(F.count("*"), F.count_if("asks")).first()
    plain = ["row", "vec_id", "v"]
    blocks = max(1, -(-n // INDEX_ROWS))
    index = scratch.store(base.select(*plain).repartition(blocks, "row").mapInArrow(_packed, PACKED), "index")
    asked = scratch.store(base.where("asks").select(*plain).repartition(max(1, -(-n_asks // QUERY_ROWS)), "row").mapInArrow(_packed, PACKED), "queries")
    groups = sorted(r["grp"] for r in asked.select("grp").distinct().collect()) or [0]
    stripes = max(1, min(blocks, -(-2 * spark.sparkContext.defaultParallelism // len(groups))))
    found = met(asked, index, groups, stripes).mapInArrow(_search(k), "row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
