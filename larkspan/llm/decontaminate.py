"""Benchmark decontamination by spaced-seed hashing.

Tokens are lower-cased runs of letters, digits and non-ASCII bytes. A mask reads
some positions of a span and ignores the others, so a hash still meets where an
ignored token was substituted. Hashes of all masks at all positions of the
benchmark items and of the documents are joined; each hit fixes an alignment of
document and item without gaps, and the alignment is verified around the hit:
a stretch that starts and ends on equal tokens, of which at least ``percent``
per cent are equal and at least ``min_tokens`` in number (or ``percent`` per
cent of an item, where that is less).

Before the join, document hashes pass a table of bits of fixed size set by the
item hashes. Misses end there; false passes are removed by the join. A document
sends one row per region around its hits: the region's tokens and hits.

Cases: null and empty texts have no tokens and meet nothing. Items with fewer
tokens than the shortest mask reads are met by no hash and so by nothing.
Repeated document rows give rows of their own; repeated items too. Null ids are
kept. Other columns are ignored or, in ``clean``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch, free_name
from larkspan.llm.words import hashed_words, mix
from larkspan.llm.workers import tidy

# Positions read (1) and ignored (0); each reads six tokens.
MASKS = ("111111", "11011011", "1110100011", "1010110101")
MIN_TOKENS = 16
PERCENT = 80
REACH = 256  # tokens kept on either side of a hit
TABLE_BITS = 24

_U = np.uint64
_STEP = np.array([pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64) for i in range(64)], dtype=_U)


def seed_hashes(tokens: np.ndarray, masks: tuple[str, ...] = MASKS) -> Iterator[np.ndarray]:
    """For each mask the hashes at all positions."""
    for number, shape in enumerate(masks):
        n = len(tokens) - len(shape) + 1
        total = np.full(max(0, n), number + 1, _U)
        if n > 0:
            for i, bit in enumerate(shape):
                if bit == "1":
                    total += tokens[i : i + n] * _STEP[i]
        yield mix(total)


def _slot(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _U(64 - TABLE_BITS)).astype(np.int64)


def best_overlap(doc: np.ndarray, item: np.ndarray, shift: int, min_tokens: int = MIN_TOKENS, percent: int = PERCENT) -> tuple[int, int, int] | None:
    """Longest qualifying stretch (start in doc, length, equal tokens) of item position = doc position + shift."""
    lo, hi = max(0, -shift), min(len(doc), len(item) - shift)
    need = min(min_tokens, -(-percent * len(item) // 100))
    if hi - lo < need or not need:
        return None
    same = np.flatnonzero(doc[lo:hi] == item[lo + shift : hi + shift])
    if not len(same):
        return None
    # With gain 100 - percent per equal token and -percent per other one, a stretch from equal token i to
    # equal token j qualifies if level[j] + gain >= level[i]; for each i take the last such j.
    rank = np.arange(len(same))
    level = 100 * rank - percent * same
    after = np.maximum.accumulate((level + 100 - percent)[::-1])[::-1]
    best = None
    end = 0
    for i in range(len(same)):
        end = max(end, i)
        while end + 1 < len(same) and after[end + 1] >= level[i]:
            end += 1
        j = end
        while j > i and level[j] + 100 - percent < level[i]:
            j -= 1
        length = int(same[j] - same[i]) + 1
        if j - i + 1 >= need and (best is None or length > best[1]):
            best = (int(same[i]) + lo, length, j - i + 1)
    return best


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and seed hashes of the items."""
    base = TaskContext.get().partitionId() << 33
    count = 0
    for batch in batches:
        for row, after, hashes, bounds, _ in hashed_words(batch.column(1), letters=True):
            for i in range(row, after):
                own = hashes[bounds[i - row] : bounds[i - row + 1]]
                found = [(h, np.arange(len(h))) for h in seed_hashes(own)]
                key = base + count
                count += 1
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), batch.column(0)[i : i + 1], pa.array([own.view(np.int64)], pa.list_(pa.int64())), pa.array([np.concatenate([h for h, _ in found]).view(np.int64)], pa.list_(pa.int64())), pa.array([np.concatenate([p for _, p in found]).astype(np.int32)], pa.list_(pa.int32()))], ["item", "item_id", "item_tokens", "h", "at"])


def _regions(bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.unpackbits(bits.value).astype(bool)
        base = TaskContext.get().partitionId() << 33
        count = 0
        names = ["region", "doc_id", "start", "tokens", "h", "at"]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row, after, hashes, bounds, _ in hashed_words(batch.column(1), letters=True):
                # Hashes over the run's rows at once; those across rows are left out below.
                seeds = [(h, np.flatnonzero(table[_slot(h)])) for h in seed_hashes(hashes)]
                place = np.concatenate([p for _, p in seeds])
                if not len(place):
                    continue
                value = np.concatenate([h[p] for h, p in seeds])
                span = np.concatenate([np.full(len(p), len(m)) for (_, p), m in zip(seeds, MASKS)])
                owner = np.searchsorted(bounds, place, side="right") - 1
                ok = place + span <= bounds[owner + 1]
                order = np.argsort(place[ok], kind="stable")
                place, value, owner = place[ok][order], value[ok][order], owner[ok][order]
                if not len(place):
                    continue
                cuts = np.flatnonzero((np.diff(owner, prepend=-1) != 0) | (np.diff(place, prepend=-10 * REACH) > 2 * REACH))
                for a, b in zip(cuts, [*cuts[1:], len(place)]):
                    first, last = bounds[owner[a]], bounds[owner[a] + 1]
                    lo, hi = max(first, place[a] - REACH), min(last, place[b - 1] + REACH)
                    line = (base + count, batch.column(0)[row + int(owner[a])].as_py(), int(lo - first), hashes[lo:hi].view(np.int64), value[a:b].view(np.int64), (place[a:b] - lo).astype(np.int32))
                    count += 1
                    for col, x in zip(out, line):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64()), pa.array(out[3], pa.list_(pa.int64())), pa.array(out[4], pa.list_(pa.int64())), pa.array(out[5], pa.list_(pa.int32()))], names)

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "item_id", "start", "length", "equal"]
    for batch in batches:
        out: list[list] = [[] for _ in names]
        col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        for i in range(batch.num_rows):
            doc = col["tokens"][i].values.to_numpy(zero_copy_only=False)
            item = col["item_tokens"][i].values.to_numpy(zero_copy_only=False)
            best = best_overlap(doc, item, col["shift"][i].as_py())
            if best:
                line = (col["doc_id"][i].as_py(), col["item_id"][i].as_py(), col["start"][i].as_py() + best[0], best[1], best[2])
                for c, x in zip(out, line):
                    c.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, doc_start, n_tokens, n_equal): the longest overlap of each document row region and item."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "decontaminate")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = scratch.store(items.mapInArrow(tidy(_item_rows), "item long, item_id long, item_tokens array<long>, h array<long>, at array<int>"), "items")
    seeds = items.select("item", F.explode(F.arrays_zip("h", "at")).alias("z")).select("item", F.col("z.h").alias("h"), F.col("z.at").alias("item_at"))
    # The table has a fixed number of bits: its set places are at most that many numbers.
    slots = seeds.select(F.shiftrightunsigned("h", 64 - TABLE_BITS).cast("int").alias("slot")).distinct().toPandas()
    table = np.zeros(1 << TABLE_BITS, bool)
    table[slots["slot"].to_numpy()] = True
    bits = spark.sparkContext.broadcast(np.packbits(table))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    regions = scratch.store(texts.mapInArrow(tidy(_regions(bits)), "region long, doc_id long, start long, tokens array<long>, h array<long>, at array<int>"), "regions")
    hits = regions.select("region", F.explode(F.arrays_zip("h", "at")).alias("z")).select("region", F.col("z.h").alias("h"), F.col("z.at").alias("doc_at"))
    aligned = hits.join(seeds, "h").select("region", "item", (F.col("item_at") - F.col("doc_at")).alias("shift")).distinct()
    aligned = scratch.store(aligned, "aligned")
    met = aligned.join(regions.select("region", "doc_id", "start", "tokens"), "region").join(items.select("item", "item_id", "item_tokens"), "item")
    found = met.select("doc_id", "item_id", "start", "tokens", "item_tokens", "shift").mapInArrow(tidy(_verified), "doc_id long, item_id long, start long, length long, equal long")
    longest = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("length", "equal", (-F.col("start")).alias("back"))).alias("best"))
    return longest.select("doc_id", "item_id", (-F.col("best.back")).alias("doc_start"), F.col("best.length").alias("n_tokens"), F.col("best.equal").alias("n_equal"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id has no overlap with an item; all columns kept."""
    name = free_name(docs, "found")
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(found, docs["doc_id"].cast("long").eqNullSafe(F.col(name)), "left_anti")
