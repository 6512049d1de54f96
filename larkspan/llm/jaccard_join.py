"""N-gram Jaccard join with set-relation skipping.

A document's set holds the hashes of its distinct word shingles. Two documents
link when ``100 * |x & y| >= percent * |x | y|``; the result gives each document
its component under these links.

Steps:

1. Equal sets become one, named by a 64-bit hash of the sorted set.
2. Each set indexes its first ``n - ceil(t n) + 1`` shingles in a global order;
   linked sets share one of those. The order puts shingles of crowded counters
   (a table of fixed size, counted over all documents) last, then goes by hash.
   Shingles in the index of one set only are dropped.
3. A set probes of an index list only the blocks (size bands) that can link
   with it and, inside them, only entries whose positions leave room for the
   overlap needed.
4. Lists are joined in rounds. A round meets each entry with the first entries
   (leaders) of its list only, verifies the pairs on whole sets, and merges
   linked sets; later rounds take more leaders of those lists that still hold
   several components. A group of copies so costs a few pairs per member.
5. Answers are derived where possible: sets already in one component are not
   compared, and a pair is skipped if the computed overlap of one set's most
   similar linked set with the other bounds the pair's overlap below the need.

No pair that could link two components is left out: rounds end when every list
was joined completely or holds a single component.

Cases: null or empty texts, and texts without words, have an empty set, size 0,
and link with nothing, not with each other. Fewer words than ``width`` make one
shingle of them all. Null ids are kept; a component's id is its smallest id that
is not null. Repeated rows and repeated ids are rows of their own. Other columns
are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larkspan.llm.components import components
from larkspan.llm.scratch import Scratch, partitions
from larkspan.llm.words import SHINGLE_WORDS, mix, shingle_sets
from larkspan.llm.workers import tidy

COUNTER_BITS = 23
STRIPE_BITS = 17
CROWDED = 32
# Shingle (48 bits: shorter names only add candidates), set, set size, place in the set's order.
ENTRY = np.dtype([("t", "<i8"), ("s", "<i8"), ("n", "<i4"), ("p", "<i4"), ("late", "<i4")])
SHINGLE_BITS = np.uint64((1 << 48) - 1)
ENTRIES_PER_FLUSH = 1 << 19
ENTRIES_PER_PARTITION = 1 << 21
CHUNK_PAIRS = 256
# Parts a root's pairs are dealt to when they look up how many chunks the root has.
SALTS = 16
# Bits of the filter over the ids of texts that a verification reads.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 15, 27
FILTER_BITS = 16
FIRST_LEADERS, MORE_LEADERS = 8, 64

_SUM = np.uint64(0x2545F4914F6CDD1D)


def set_id(tokens: np.ndarray) -> int:
    """64-bit name of a sorted set of hashes."""
    return int(mix(np.add.reduce(mix(tokens ^ _SUM), keepdims=True, dtype=np.uint64) + np.uint64(len(tokens))).view(np.int64)[0])


def _sketch(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNTER_BITS, np.int32)
        for batch in batches:
            names, sizes = [0] * batch.num_rows, [0] * batch.num_rows
            for i, tokens in shingle_sets(batch.column(1), width):
                if len(tokens):
                    names[i], sizes[i] = set_id(tokens), len(tokens)
                    np.add.at(counts, (tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), 1)
            none = pa.nulls(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), none.cast(pa.int32()), none.cast(pa.binary())], ["doc_id", "s", "n", "stripe", "hits"])
        # The counters in stripes, so that they add up in as many tasks.
        stripes = counts.reshape(-1, 1 << STRIPE_BITS)
        full = np.flatnonzero(stripes.any(1))
        blobs = [pa.compress(np.minimum(stripes[i], 65535).astype("<u2").tobytes(), "zstd", asbytes=True) for i in full]
        none = pa.nulls(len(full))
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.int32()), pa.array(full.astype(np.int32)), pa.array(blobs, pa.binary())], ["doc_id", "s", "n", "stripe", "hits"])

    return run


def _crowded(limit: int):
    """The places of counters over ``limit``, of all partitions' stripes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for stripe, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts = np.frombuffer(pa.decompress(blob, 2 << STRIPE_BITS, "zstd", asbytes=True), "<u2")
                sums[stripe] = sums.get(stripe, 0) + counts.astype(np.int64)
        for stripe, total in sums.items():
            places = np.flatnonzero(total > limit) + (stripe << STRIPE_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(places.astype(np.int32))], ["slot"])

    return run


def pack(rows: np.ndarray) -> bytes:
    """Entries as compressed byte planes, so that high bytes take no room in a shuffle."""
    planes = b"".join(np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in ENTRY.names)
    return len(rows).to_bytes(4, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(blob: bytes) -> np.ndarray:
    rows = np.empty(int.from_bytes(blob[:4], "little"), ENTRY)
    planes = np.frombuffer(pa.decompress(blob[4:], len(rows) * ENTRY.itemsize, "zstd", asbytes=True), np.uint8)
    at = 0
    for c in ENTRY.names:
        width = ENTRY[c].itemsize
        part = planes[at : at + width * len(rows)].reshape(width, -1).T
        rows[c] = np.ascontiguousarray(part).view(ENTRY[c])[:, 0]
        at += width * len(rows)
    return rows


def _need(n, percent: int):
    """Smallest overlap of a set of ``n`` with any set it links with: ceil(percent n / 100)."""
    return (percent * n + 99) // 100


def _index(width: int, percent: int, crowded, buckets: int):
    def flush(parts: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(parts)
        # Entries of frequent shingles need no count, so they are dealt out by set as well.
        key = np.where(rows["late"] > 0, rows["t"] ^ rows["s"], rows["t"]).view(np.uint64)
        place = (mix(key) % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        rows, place = rows[order], place[order]
        cuts = np.flatnonzero(np.diff(place, prepend=-1))
        ends = [*cuts[1:], len(rows)]
        return pa.RecordBatch.from_arrays([pa.array(place[cuts]), pa.array([pack(rows[a:b]) for a, b in zip(cuts, ends)], pa.binary())], ["bucket", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(crowded.value).view(bool)
        seen: set[int] = set()  # copies in one partition are indexed once
        parts, held = [], 0
        for batch in batches:
            for _, tokens in shingle_sets(batch.column(0), width):
                n = len(tokens)
                if not n or (s := set_id(tokens)) in seen:
                    continue
                seen.add(s)
                late = bits[(tokens >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]
                k = n - _need(n, percent) + 1
                first = np.argsort(late, kind="stable")[:k]
                rows = np.empty(k, ENTRY)
                rows["t"], rows["late"] = (tokens[first] & SHINGLE_BITS).view(np.int64), late[first]
                rows["s"], rows["n"], rows["p"] = s, n, np.arange(k)
                parts.append(rows)
                held += k
                if held >= ENTRIES_PER_FLUSH:
                    yield flush(parts)
                    parts, held = [], 0
        if parts:
            yield flush(parts)

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries of the lists with two sets or more, each entry once."""
    held = [unpack(entries) for batch in batches for entries in batch.column(1).to_pylist()]
    rows = np.concatenate(held) if held else np.empty(0, ENTRY)
    rows = rows[np.lexsort((rows["s"], rows["t"]))]
    same = rows["t"][1:] == rows["t"][:-1]
    rows = rows[np.concatenate([[True], ~(same & (rows["s"][1:] == rows["s"][:-1]))])[: len(rows)]]
    same = np.concatenate([[False], rows["t"][1:] == rows["t"][:-1], [False]])[: len(rows) + 1]
    rows = rows[same[:-1] | same[1:] | (rows["late"] > 0)]
    for at in range(0, len(rows), 1 << 18):
        some = rows[at : at + (1 << 18)]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(some[c])) for c in ENTRY.names[:4]], list(ENTRY.names[:4]))


def _overlaps(width: int):
    """Sizes and overlaps of the pairs of each chunk; a chunk's texts come before its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, sets = None, {}
        for batch in batches:
            cs, ks, names, others = (batch.column(i).to_pylist() for i in range(4))
            found = {i: tokens for i, tokens in shingle_sets(batch.column(4), width) if others[i] is None}
            rows = []
            for i, here in enumerate(zip(cs, ks)):
                if here != chunk:
                    chunk, sets = here, {}
                if others[i] is None:
                    # Rows of the same id may hold other texts.
                    if len(found[i]) and set_id(found[i]) == names[i]:
                        sets[names[i]] = found[i]
                else:
                    x, y = sets[names[i]], sets[others[i]]
                    rows.append((names[i], others[i], len(x), len(y), len(np.intersect1d(x, y, assume_unique=True))))
            columns = np.array(rows, np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(columns[:, i])) for i in range(5)], ["a", "b", "na", "nb", "o"])

    return run


def _slot(column: str, bits: int):
    """Place of an id in a filter, from 1."""
    return F.pmod(F.xxhash64(column), F.lit(1 << bits)) + 1


def may_be_asked(wanted: DataFrame, id_col: str) -> Column:
    """Whether a row's ``id_col`` may be an ``_id`` of ``wanted``, told without a shuffle.

    The filter is a bitmap of hashed ids, of FILTER_BITS bits an id and 16 MB at
    most. Some rows pass by chance; no asked row fails. A null id is an id like
    others.
    """
    bits = min(max((FILTER_BITS * wanted.count()).bit_length(), LEAST_FILTER_BITS), MOST_FILTER_BITS)
    slot = _slot("_id", bits)
    parts = wanted.groupBy(F.bitmap_bucket_number(slot).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("held"))
    whole = np.zeros((1 << bits) // 8, np.uint8)
    for part, held in parts.collect():  # one row of 4 KB for each 32,768 bits
        whole[(part - 1) * len(held) : part * len(held)] = np.frombuffer(held, np.uint8)
    shared = wanted.sparkSession.sparkContext.broadcast(whole)

    @F.pandas_udf("boolean")
    def asked(slots: pd.Series) -> pd.Series:
        at = slots.to_numpy() - 1
        return pd.Series((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)

    return asked(_slot(id_col, bits))


def only_asked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` may be an ``_id`` of ``wanted``, before any shuffle.

    A row let through by chance goes at the join that follows.
    """
    return docs.where(may_be_asked(wanted, "doc_id"))


class JaccardJoin:
    """The join over one table of documents; ``documents()`` gives the components."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE_WORDS):
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "jaccard")
        self.docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        self.percent, self.width = percent, width

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) per row of the table."""
        store, drop = self.scratch.store, self.scratch.drop
        read = store(self.docs.mapInArrow(tidy(_sketch(self.width)), "doc_id long, s long, n int, stripe int, hits binary"), "sketch")
        rows = read.where("stripe is null").select("doc_id", "s", "n")
        named = rows.where("n > 0").groupBy("s").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
        named = store(named, "sets")
        entries = store(self._entries(read, named), "entries")
        labels = self._link(entries, named)
        sets = named.join(labels, named.s == labels.node, "left").select("s", "doc_id", F.coalesce("label", "s").alias("g"))
        least = sets.groupBy("g").agg(F.min("doc_id").alias("component_id"))
        sets = store(sets.join(least, "g").select("s", "component_id"), "components")
        drop(named)
        return rows.join(sets, "s", "left").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

    def _entries(self, read: DataFrame, named: DataFrame) -> DataFrame:
        """The index (t, s, n, p): shingle, set, set size, place in the set's order."""
        total, kept = named.select(F.sum("n"), F.sum(F.col("n") - F.ceil(F.col("n") * self.percent / 100) + 1)).first()
        limit = max(CROWDED, 3 * (total or 0) >> COUNTER_BITS)
        stripes = read.where("stripe is not null").select("stripe", "hits").repartition(1 << (COUNTER_BITS - STRIPE_BITS), "stripe")
        # At most as many numbers as there are counters.
        slots = stripes.mapInArrow(tidy(_crowded(limit)), "slot int").toPandas()
        flags = np.zeros(1 << COUNTER_BITS, bool)
        flags[slots["slot"].to_numpy()] = True
        crowded = self.spark.sparkContext.broadcast(np.packbits(flags))
        parts = max(partitions(self.spark), -(-(kept or 0) // ENTRIES_PER_PARTITION))
        packed = self.docs.select("text").mapInArrow(tidy(_index(self.width, self.percent, crowded, 4 * parts)), "bucket int, entries binary")
        return packed.repartition(parts, "bucket").mapInArrow(tidy(_shared), "t long, s long, n int, p int")

    def _link(self, entries: DataFrame, named: DataFrame) -> DataFrame:
        """(node, label) for the sets that have links."""
        store, drop = self.scratch.store, self.scratch.drop
        live = entries.withColumn("g", F.col("s"))
        labels = verified = None
        lo, hi = 0, FIRST_LEADERS
        while True:
            pairs = self._pairs(live, lo, hi)
            if verified is not None:
                pairs = self._underived(pairs, verified)
            pairs = store(pairs, "pairs")
            if pairs.limit(1).count():
                new = self._verify(pairs, named)
                verified = new if verified is None else verified.union(new)
                edges = new.where("linked").select("a", "b")
                if labels is not None:
                    edges = edges.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
                labels = components(edges, self.scratch)
            drop(pairs)
            lists = live if labels is None else live.drop("g").join(labels, live.s == labels.node, "left").withColumn("g", F.coalesce("label", "s")).drop("node", "label")
            open_ = lists.groupBy("t").agg(F.count(F.lit(1)).alias("c"), F.min("g").alias("g0"), F.max("g").alias("g1")).where((F.col("c") > hi) & (F.col("g0") != F.col("g1"))).select("t")
            later = store(lists.join(open_, "t", "left_semi"), "lists")
            drop(entries)
            live = entries = later
            if not live.limit(1).count():
                return labels if labels is not None else self.spark.createDataFrame([], "node long, label long")
            lo, hi = hi, hi * MORE_LEADERS

    def _pairs(self, live: DataFrame, lo: int, hi: int) -> DataFrame:
        """Candidate pairs (a, b) of each entry with the leaders ``lo`` to ``hi`` of its list.

        A set's name is a hash, so the first names of a list are a random choice,
        and the same one in all lists that a group of copies shares.
        """
        t = self.percent
        first = Window.partitionBy("t").orderBy("s")
        lead = live.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= hi).where(F.col("rank") > lo)
        lead = self.scratch.store(lead.select("t", *[F.col(c).alias(f"{c}0") for c in ("s", "n", "p", "g")]), "leaders")
        # Blocks of sizes: sets whose bands differ by more than one can't link.
        band = lambda n: F.floor(F.log(F.col(n).cast("double")) / F.log(F.lit(100.0 / t)))
        # overlap >= percent/(100+percent) * (sizes), and no more than what follows either position
        room = F.least(F.col("n") - F.col("p"), F.col("n0") - F.col("p0"))
        fits = (
            (F.col("s0") < F.col("s"))
            & (F.col("g") != F.col("g0"))
            & (F.abs(band("n") - band("n0")) <= 1)
            & (100 * F.least("n", "n0") >= t * F.greatest("n", "n0"))
            & ((100 + t) * room >= t * (F.col("n") + F.col("n0")))
        )
        return live.join(lead, "t").where(fits).select(F.col("s0").alias("a"), F.col("s").alias("b"), F.col("n0").alias("na"), F.col("n").alias("nb")).distinct()

    def _underived(self, pairs: DataFrame, verified: DataFrame) -> DataFrame:
        """Pairs whose answer does not follow from verified ones.

        If p is the set most similar to x and |p & y| is known, then
        |x & y| <= |p & y| + |x - p|.
        """
        t = self.percent
        turned = lambda df: df.select("a", "b", "o").union(df.select(F.col("b").alias("a"), F.col("a").alias("b"), "o"))
        parent = turned(verified.where("linked")).groupBy(F.col("a").alias("b")).agg(F.max(F.struct("o", F.col("b").alias("p"))).alias("best")).select("b", F.col("best.p").alias("p"), F.col("best.o").alias("shared"))
        known = turned(verified).select(F.col("a").alias("p"), F.col("b").alias("a"), F.col("o").alias("po"))
        out = pairs.join(parent, "b", "left").join(known, ["p", "a"], "left")
        most = F.col("po") + F.col("nb") - F.col("shared")
        return out.where(F.col("po").isNull() | ((100 + t) * most >= t * (F.col("na") + F.col("nb")))).select("a", "b", "na", "nb").distinct()

    def _verify(self, pairs: DataFrame, named: DataFrame) -> DataFrame:
        """The pairs with their overlap ``o`` and whether they link, on whole sets.

        Pairs whose first sets share a smaller partner meet in chunks, dealt by
        their second set. A chunk gets each set's text once, not once a pair,
        and has about ``CHUNK_PAIRS`` pairs however large the group is.
        """
        store, drop = self.scratch.store, self.scratch.drop
        least = pairs.groupBy(F.col("b").alias("a")).agg(F.min("a").alias("root"))
        rooted = store(pairs.join(least, "a", "left").select(F.coalesce("root", "a").alias("c"), "a", "b"), "rooted")
        # Only roots with several chunks are looked up (at most a row for CHUNK_PAIRS pairs, stored so that
        # their size is known), and a hot root's pairs meet its row under as many salts.
        sizes = rooted.groupBy("c").agg(F.ceil(F.count(F.lit(1)) / CHUNK_PAIRS).alias("m")).where("m > 1")
        sizes = store(sizes.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "sizes")
        salted = rooted.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
        part = F.pmod(F.xxhash64("b", F.lit(1)), F.coalesce("m", F.lit(1)))
        chunks = store(salted.join(sizes, ["c", "salt"], "left").select("c", part.alias("k"), "a", "b"), "chunks")
        wanted = chunks.select("c", "k", F.col("a").alias("s")).union(chunks.select("c", "k", "b")).distinct()
        wanted = store(wanted.join(named.select("s", F.col("doc_id").alias("_id")), "s").select("c", "k", "s", "_id"), "wanted")
        docs = only_asked(self.docs, wanted)
        texts = docs.join(wanted, docs.doc_id.eqNullSafe(F.col("_id"))).select("c", "k", "s", F.lit(None).cast("long").alias("b"), "text")
        rows = texts.union(chunks.select("c", "k", "a", "b", F.lit(None).cast("string")))
        rows = rows.repartition(partitions(self.spark), "c", "k").sortWithinPartitions("c", "k", F.col("b").asc_nulls_first())
        met = rows.mapInArrow(tidy(_overlaps(self.width)), "a long, b long, na long, nb long, o long")
        t = self.percent
        out = store(met.withColumn("linked", (100 + t) * F.col("o") >= t * (F.col("na") + F.col("nb"))), "verified")
        drop(rooted, sizes, chunks, wanted)
        return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; see the module's text."""
    return JaccardJoin(docs, id_col, text_col, percent, width).documents()
