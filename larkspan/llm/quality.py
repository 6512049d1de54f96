"""Quality classifier on supervised subword embeddings.

A document is the mean of learned vectors of its hashed features: words, pairs
of words, word shapes and the character n-grams of each word. A softmax over two
classes reads that mean. Vectors and output weights are trained together by
stochastic gradient descent in NumPy on a bounded sample of labelled rows; the
model has a fixed size, whatever the corpus.

The output is linear in the mean, so scoring adds up one number per feature: the
difference of the class outputs of its vector.

Cases: a null or empty text has no features and scores by the bias alone. Texts
are read whole, in pieces of bounded size. Repeated rows score alike. Rows
labelled null, or without a text row, are not trained on; a sample with one
class or none gives the constant model of that class (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch
from larkspan.llm.words import hashed_words, mix, text_buffers
from larkspan.llm.workers import tidy

BUCKET_BITS = 18
DIM = 8
GRAMS = (3, 4)
REPEAT_WEIGHT = 4
EPOCHS, RATE, BATCH, DECAY = 8, 0.5, 32, 1e-6
MIN_STEPS = 600  # small samples take more epochs
MAX_ROWS = 2500
MAX_CHARS = 16_000_000
CHUNK = 1 << 18
THRESHOLD = 0.3

_U = np.uint64
# Classes of bytes in word shapes: lower, upper, digit, byte of a wider character, then other signs by value.
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 1, 2, 3, 4


def features(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows: (first row, row after the last, feature buckets, each one's row in the run)."""
    shift = _U(64 - BUCKET_BITS)
    data, offsets = text_buffers(column)
    for row, after, hashes, bounds, (starts, ends) in hashed_words(column, CHUNK, spans=True):
        owner = np.repeat(np.arange(after - row), np.diff(bounds))
        if not len(hashes):
            yield row, after, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        lo = offsets[row]
        starts = starts + (offsets[row:after] - lo)[owner]
        ends = ends + (offsets[row:after] - lo)[owner]
        raw = data[lo : offsets[after]]
        found, rows = [hashes], [owner]
        same = owner[1:] == owner[:-1]
        pair = mix(hashes[:-1] * _U(31) + hashes[1:])
        # A word that repeats the one before is a feature of its own, whatever the word.
        again = same & (hashes[1:] == hashes[:-1])
        found += [pair[same], np.full(REPEAT_WEIGHT * int(again.sum()), 0x1234567890ABCDEF, _U)]
        rows += [owner[1:][same], np.repeat(owner[1:][again], REPEAT_WEIGHT)]
        # Shape: classes of the first and the last two bytes, and whether the word is long.
        shape = _SHAPE[raw].astype(_U)
        code = ((shape[starts] << _U(8) | shape[ends - 1]) << _U(8) | shape[np.maximum(ends - 2, starts)]) << _U(2) | (ends - starts > 24).astype(_U)
        found.append(mix(code + _U(0x5851F42D4C957F2D)))
        rows.append(owner)
        # Character n-grams inside words, with the white space around them as edges.
        word = np.zeros(len(raw) + 1, np.int64)
        np.add.at(word, starts, 1)
        np.add.at(word, ends, -1)
        inside = np.cumsum(word)[:-1] > 0
        low = np.where(inside, raw, 32).astype(_U)
        place = np.repeat(np.arange(after - row), np.diff(offsets[row : after + 1]))
        for n in GRAMS:
            if len(raw) < n:
                continue
            m = len(raw) - n + 1
            gram = np.zeros(m, _U)
            ok = place[: m] == place[n - 1 :]
            for i in range(n):
                gram = gram * _U(257) + low[i : i + m]
                if 0 < i < n - 1:
                    ok &= inside[i : i + m]
            at = np.flatnonzero(ok)
            found.append(mix(gram[at] + _U(n << 56)))
            rows.append(place[at])
        yield row, after, (np.concatenate(found) >> shift).astype(np.int64), np.concatenate(rows)


def means(column: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean of ``table`` over each row's features; 0 without any."""
    out = np.zeros(len(column))
    for row, after, buckets, rows in features(column):
        n = np.bincount(rows, minlength=after - row)
        out[row:after] = np.bincount(rows, table[buckets], minlength=after - row) / np.maximum(n, 1)
    return out


@dataclass
class Model:
    """``slope[b]`` is what a feature of bucket b adds to the logit of class 1."""

    slope: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(means(column, self.slope) + self.bias, -500, 500)))


def train(texts: list[str], labels: np.ndarray, seed: int = 7) -> Model:
    """Fit vectors and softmax weights; labels are 0 or 1."""
    labels = np.asarray(labels, dtype=np.int64)
    size = 1 << BUCKET_BITS
    if len(labels) == 0 or labels.min() == labels.max():
        return Model(np.zeros(size, np.float32), 0.0 if len(labels) == 0 else (30.0 if labels[0] else -30.0))
    docs = []
    for at in range(0, len(texts), 64):
        for row, after, buckets, rows in features(pa.array(texts[at : at + 64], pa.string())):
            order = np.argsort(rows, kind="stable")
            for own in np.split(buckets[order], np.searchsorted(rows[order], np.arange(1, after - row))):
                own, counts = np.unique(own, return_counts=True)
                docs.append((own.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (size, DIM)).astype(np.float32)
    weights, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    # Both classes weigh alike in an epoch; the bias is set to the real shares afterwards.
    share = np.bincount(labels, minlength=2) / len(labels)
    # Rows of rarer buckets learn at the summed squares' own pace (Adagrad).
    seen = np.full(size, 1e-4, np.float32)
    per_epoch = -(-len(docs) // BATCH)
    epochs = max(EPOCHS, -(-MIN_STEPS // per_epoch))
    steps = epochs * per_epoch
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            some = order[at : at + BATCH]
            lengths = [len(docs[i][0]) for i in some]
            ids = np.concatenate([docs[i][0] for i in some])
            mass = np.concatenate([docs[i][1] for i in some])
            owner = np.repeat(np.arange(len(some)), lengths)
            cuts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            filled = np.array(lengths) > 0
            mean = np.zeros((len(some), DIM), np.float32)
            if len(ids):
                mean[filled] = np.add.reduceat(vectors[ids] * mass[:, None], cuts[filled], axis=0)
            logits = mean @ weights + bias
            prob = np.exp(logits - logits.max(1, keepdims=True))
            prob /= prob.sum(1, keepdims=True)
            grad = prob
            grad[np.arange(len(some)), labels[some]] -= 1
            grad /= (2 * share[labels[some]])[:, None]
            rate = RATE * (1 - step / steps)
            step += 1
            back = grad @ weights.T
            change = back[owner] * mass[:, None]
            np.add.at(seen, ids, (change**2).mean(1))
            np.add.at(vectors, ids, -rate * change / np.sqrt(seen[ids])[:, None])
            weights -= rate * (mean.T @ grad / len(some) + DECAY * weights)
            bias -= rate * grad.mean(0)
    slope = (vectors @ (weights[:, 1] - weights[:, 0])).astype(np.float32)
    return Model(slope, float(bias[1] - bias[0] + np.log(share[1] / share[0])))


def held_out(doc_id: Column) -> Column:
    """Rows never trained on: crc32 of the id's decimal text divides by 5; so does a null id's empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> Model:
    """Train on up to ``max_rows`` labelled rows that are not held out.

    The sample is the rows of least id hash; of their texts those are used that
    fit into ``max_chars`` characters, so that no corpus fills the driver.
    """
    right = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("quality").alias("other")).where("quality = other")
    known = right.where("doc_id is not null").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # One text per id, however often the id is repeated; at most max_rows rows are written.
    texts = docs.where("text is not null").select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    scratch = Scratch(docs.sparkSession, "quality")
    kept = scratch.store(texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "sample")
    chosen, left = [], max_chars
    for row in sorted(kept.select("doc_id", F.length("text").alias("chars")).collect()):
        if row["chars"] <= left:
            left -= row["chars"]
            chosen.append(row["doc_id"])
    rows = sorted(kept.where(F.col("doc_id").isin(chosen)).collect()) if chosen else []
    scratch.drop(kept)
    return train([r["text"] for r in rows], np.array([r["quality"] for r in rows], np.int64))


def with_score(df: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``df`` with the model's score (0 to 1) of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(batch.schema.get_field_index(text_col)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out])

    schema = df.select("*").schema.add(out, "double")
    return df.mapInArrow(tidy(run), schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``threshold`` on) for every document."""
    model = fit(docs, labels)
    scored = with_score(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), model).drop("text")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
