"""Secret scans: fixed patterns, and character Markov models for the rest.

Patterns find assignments, access keys and hex runs. What they leave of every
run of key characters is scored by two Markov models of character pairs, one of
random strings and one of ordinary identifiers. Each character adds its
log-likelihood ratio less a threshold; a stretch whose sum rises far enough above
what went before is a secret, whatever stands around it in the run. It is
widened to the letters and digits it cuts through, and has ``RUN_CHARS``
characters at least (``REST_CHARS`` beside a pattern span). A repeated character
adds nothing, so rulers and padding are no secrets. Threshold and least sum are
set on labelled samples from the corpus: words and identifiers joined from them
(label 0), and values of pattern hits with random strings over their alphabets
(label 1).

Spans are in code points, end exclusive; an assignment's span is its whole
match. Markov spans don't overlap pattern spans.

Cases: a null or empty text has no spans. Texts are read whole, in time linear in
their length. Repeated rows give repeated rows, an empty table an empty one.
Without words to learn from, the identifier model is uniform and no stretch
reaches the threshold. Other columns, whatever their names, are kept by
``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch
from larkspan.llm.workers import tidy

KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_CHARS, RUN_CHARS, REST_CHARS = 12, 16, 8
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RANDOM_ALPHABETS = (ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], ALPHABET[:26] + ALPHABET[52:62], "0123456789abcdef")
SAMPLE_DOCS, SAMPLE_CHARS, SAMPLES = 2000, 4_000_000, 4000
FALSE_SHARE = 1e-3  # of held-out ordinary identifiers that may reach the threshold
MASK = "[secret]"

_CODE = np.full(128, -1, np.int64)
_CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))


@dataclass
class MarkovModel:
    """``ratio[a, b]``: log-likelihood ratio of b after a (row ``len(ALPHABET)`` starts a run).

    ``threshold`` is taken off each character's ratio, ``least`` is the sum a secret reaches.
    """

    ratio: np.ndarray
    threshold: float
    least: float = np.inf

    def ratios(self, run: str) -> np.ndarray:
        codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
        return self.ratio[np.concatenate([[len(ALPHABET)], codes[:-1]]), codes]

    def score(self, run: str) -> float:
        return float(self.ratios(run).mean())

    def peak(self, run: str) -> float:
        """The largest sum of any stretch."""
        sums = np.cumsum(np.append(0.0, self.ratios(run) - self.threshold))
        return float((sums - np.minimum.accumulate(sums)).max())

    def stretches(self, gains: np.ndarray) -> list[tuple[int, int]]:
        """Stretches of largest sum, from where the sum was least to where it peaks, of ``least`` and more."""
        found, parts = [], [(0, len(gains))]
        while parts:
            lo, hi = parts.pop()
            sums = np.cumsum(np.append(0.0, gains[lo:hi]))
            lowest = np.minimum.accumulate(sums)
            rise = sums - lowest
            if not len(rise) or rise.max() < self.least:
                continue
            first = np.flatnonzero(sums == lowest)
            peaks = np.maximum.reduceat(rise, first)
            ends = np.append(first[1:], len(sums))
            for i in np.flatnonzero(peaks >= self.least).tolist():
                top = int(first[i] + rise[first[i] : ends[i]].argmax())
                found.append((lo + int(first[i]), lo + top))
                # After its peak a rise may hold another one.
                parts.append((lo + top, lo + int(ends[i]) - 1))
        return sorted(found)


def _logs(samples: list[str]) -> np.ndarray:
    n = len(ALPHABET)
    counts = np.full((n + 1, n), 0.5)
    for run in samples:
        codes = _CODE[np.frombuffer(run.encode(), np.uint8)]
        np.add.at(counts, (np.concatenate([[n], codes[:-1]]), codes), 1)
    return np.log(counts / counts.sum(1, keepdims=True))


def fit_markov(samples: list[tuple[str, int]], false_share: float = FALSE_SHARE) -> MarkovModel:
    """Two models of labelled runs (1 random, 0 ordinary); each fifth run only sets the threshold."""
    runs = [(r, y) for r, y in samples if r and r.isascii() and min(_CODE[np.frombuffer(r.encode(), np.uint8)]) >= 0]
    learn, test = [x for i, x in enumerate(runs) if i % 5], runs[::5]
    if not all(any(y == k for _, y in part) for part in (learn, test) for k in (0, 1)):
        return MarkovModel(np.zeros((len(ALPHABET) + 1, len(ALPHABET))), 1.0)
    model = MarkovModel(_logs([r for r, y in learn if y]) - _logs([r for r, y in learn if not y]), 0.0)
    same = np.arange(len(ALPHABET))
    model.ratio[same, same] = np.minimum(model.ratio[same, same], 0.0)
    ordinary = np.array([model.score(r) for r, y in test if not y])
    random_ = np.array([model.score(r) for r, y in test if y])
    low, high = np.quantile(ordinary, 1 - false_share), np.quantile(random_, 0.01)
    # Between the two, where they part; else at the share of false hits allowed.
    model.threshold = max(float(low), float((low + high) / 2), 0.05)
    model.least = max(float(np.quantile([model.peak(r) for r, y in test if not y], 1 - false_share)), 1.0)
    return model


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Pattern spans (start, end, kind), by start, then kind as listed."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_CHARS]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _union(spans: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Disjoint stretches covered by sorted spans."""
    out: list[tuple[int, int]] = []
    for start, end, _ in spans:
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def all_spans(text: str, model: MarkovModel, base: list[tuple[int, int, str]] | None = None) -> list[tuple[int, int, str]]:
    base = base_spans(text) if base is None else base
    found = list(base)
    covered, at = _union(base), 0
    for m in RUN.finditer(text):
        while at < len(covered) and covered[at][1] <= m.start():
            at += 1
        # What the patterns leave of the run.
        parts, lo, i = [], m.start(), at
        while i < len(covered) and covered[i][0] < m.end():
            parts.append((lo, covered[i][0]))
            lo, i = covered[i][1], i + 1
        parts.append((lo, m.end()))
        gains = None
        for lo, hi in parts:
            need = RUN_CHARS if (lo, hi) == m.span() else REST_CHARS
            if hi - lo < need:
                continue
            if gains is None:
                gains = model.ratios(m.group()) - model.threshold
            last = lo
            for start, end in model.stretches(gains[lo - m.start() : hi - m.start()]):
                start, end = max(lo + start, last), lo + end
                if start >= end:
                    continue
                while start > last and text[start - 1].isalnum() and text[start].isalnum():
                    start -= 1
                while end < hi and text[end].isalnum() and text[end - 1].isalnum():
                    end += 1
                last = end
                if end - start >= need:
                    found.append((start, end, "markov"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def samples_of(texts: list[str], seed: int = 11) -> list[tuple[str, int]]:
    """Labelled runs from texts: joined words (0); values of pattern hits and random strings (1)."""
    rng = np.random.default_rng(seed)
    words, values = [], []
    for text in texts:
        spans = base_spans(text)
        values += [run for start, end, _ in spans for run in RUN.findall(text[start:end])]
        words += re.findall(r"[A-Za-z]+", mask(text, spans, " "))
    if not words:
        return []
    out = []
    for _ in range(SAMPLES):
        parts = [words[i] for i in rng.integers(0, len(words), rng.integers(2, 7))]
        style = rng.integers(0, 4)
        run = (["_", "-", "/", ""][style]).join(p.capitalize() if style == 3 else p for p in parts)
        if rng.random() < 0.25:
            run += ["", "_", "-"][rng.integers(0, 3)] + str(rng.integers(0, 3000))
        out.append((run, 0))
    long_words = sorted({w for w in words if len(w) >= 12})
    out += [(w, 0) for w in long_words[:SAMPLES]]
    for _ in range(SAMPLES):
        letters = RANDOM_ALPHABETS[rng.integers(0, len(RANDOM_ALPHABETS))]
        out.append(("".join(letters[i] for i in rng.integers(0, len(letters), rng.integers(RUN_CHARS, 60))), 1))
    out += [(v, 1) for v in values[:SAMPLES]]
    order = rng.permutation(len(out))
    return [out[i] for i in order]


def fit(docs: DataFrame, max_docs: int = SAMPLE_DOCS, max_chars: int = SAMPLE_CHARS) -> MarkovModel:
    """Models from up to ``max_docs`` documents of least text hash and ``max_chars`` characters in all."""
    scratch = Scratch(docs.sparkSession, "secrets")
    hashed = docs.where("length(text) > 0").select("text", F.xxhash64("text").alias("h"))
    picked = hashed.select("h").distinct().orderBy("h").limit(max_docs)
    kept = scratch.store(hashed.join(F.broadcast(picked), "h").groupBy("h").agg(F.min("text").alias("text")), "sample")
    texts, left = [], max_chars
    sized = sorted(kept.select("h", F.length("text").alias("chars")).collect())
    wanted = []
    for row in sized:
        if row["chars"] <= left:
            left -= row["chars"]
            wanted.append(row["h"])
    if wanted:
        texts = sorted({r["text"] for r in kept.where(F.col("h").isin(wanted)).select("text").collect()})
    scratch.drop(kept)
    return fit_markov(samples_of(texts))


def _join(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan(docs: DataFrame, model: MarkovModel) -> DataFrame:
    """doc_id, counts of the pattern kinds, base_sha256 and all spans of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            cols: list[list] = [[] for _ in range(6)]
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                spans = all_spans(text, model, base)
                kinds = [s[2] for s in base]
                row = (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), len(spans) - len(base), hashlib.sha256(_join(base).encode()).hexdigest(), _join(spans))
                for col, value in zip(cols, row):
                    col.append(value)
            arrays = [pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(c, pa.string()) for c in cols[4:]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), schema).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_markov")


def mask(text: str, spans: list[tuple[int, int, str]], by: str = MASK) -> str:
    """``text`` with every run of overlapping spans replaced."""
    out, at, last = [], 0, 0
    for start, end, _ in spans:
        if start >= last:
            out += [text[at:start], by]
        at = last = max(last, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, model: MarkovModel, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets of every text replaced by a mask; other columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            texts = [None if t is None else mask(t, all_spans(t, shared.value)) for t in (x.as_py() for x in batch.column(at))]
            arrays = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)

    return docs.mapInArrow(tidy(run), docs.schema)
