"""Hierarchical Pitman-Yor language model, and log10 probabilities of whole texts.

Words are customers. Each context (the word before) has a restaurant; its tables
are customers of the one parent restaurant, that of single words, whose own base
is uniform over the V training words and one unknown word. With c customers of a
word at t tables, of C and T in all, discount d and strength s,

    p(word | context) = (c - d t) / (s + C) + (s + d T) / (s + C) * p(word).

Seating is sampled by Gibbs: given all other tables, the customers of one word in
one restaurant (a dish) are seated anew. How many tables they take has
probability S(c, t) * prod_j (s + d (T' + j)) p, j < t, with T' the tables of other dishes
and S the generalised Stirling numbers; the sizes of the tables are summed out,
as no probability needs them. Dishes of up to ``EXACT`` customers are drawn
from just that; for larger ones S is taken at its saddle point, and where many
numbers of tables are likely, they are weighed on a grid. A sweep draws all dishes of
all contexts by the parent and the totals of the sweep before, then the parent's.
After ``burn_in`` sweeps each one is a sample; probabilities are averaged over
the samples, then their logarithms are summed.

Counts cover all training documents. Documents are kept as packs of word
numbers. Words belong to buckets by hash, dishes to buckets by their context; a
context with more than 1 in ``HEAVY`` of all tokens is spread over all buckets.
A step sends arrays between packs and buckets: the rows of a bucket, its fixed
part and what it is sent, meet by one groupBy. All steps are stored, so a lost
executor costs the tasks of one step. A bucket holds the distinct pairs of about
``bucket_tokens`` tokens; messages are as many as the square of the buckets, so
corpora of thousands of buckets want larger ones.
All draws hash the seed, sweep and dish, so partitioning changes nothing.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, known by a 64-bit hash;
each text ends with one end token.

Cases: a null or empty text is its end token. Rows without an id don't train and
have a null ``held_out``; they are scored. Texts are taken whole, of any length.
Repeated rows count, and are scored, each time. Without training text every
token has probability 1 (V is 0). Empty tables give empty results. Columns other
than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspan.llm.scratch import Scratch
from larkspan.llm.words import hashed_words, mix

PACK_TOKENS, BUCKET_TOKENS = 1 << 20, 1 << 20
HEAVY = 256
LEAST_BUCKETS, ROUNDS = 8, 2
EXACT, GRID = 1024, 129
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 40, 48, 64, 96, 128, 192, 256, 384, 512, 768, EXACT])  # dishes drawn together
CELLS = 1 << 20

_U = np.uint64
END, START = _U(0xD1B54A32D192ED03), _U(0x8CB92BA72F3D8DD7)
ROW = "to string, kind string, frm long, x long, y long, a binary, b binary, c binary, d binary, e binary"
_NAMES = [c.split()[0] for c in ROW.split(", ")]
_TYPES = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in ROW.split(", ")]


# ---------------------------------------------------------------- arrays in rows


def enc(values: np.ndarray) -> bytes:
    """Non-negative integers in their narrowest type, compressed byte by byte of them unless they are hashes."""
    top = int(values.max()) if len(values) else 0
    kind = next(i for i, k in enumerate("1248") if top < 1 << 8 * int(k))
    data = values.astype(f"<u{1 << kind}")
    if kind == 3:
        return struct.pack("<BQ", kind, len(values)) + data.tobytes()
    planes = data.view(np.uint8).reshape(-1, 1 << kind).T.tobytes()
    return struct.pack("<BQ", kind, len(values)) + pa.compress(planes, "zstd", asbytes=True)


def dec(data: bytes) -> np.ndarray:
    kind, n = struct.unpack_from("<BQ", data)
    if kind == 3:
        return np.frombuffer(data[9:], "<u8").copy()
    planes = np.frombuffer(pa.decompress(data[9:], n << kind, "zstd", asbytes=True), np.uint8).reshape(1 << kind, n)
    return np.ascontiguousarray(planes.T).view(f"<u{1 << kind}").reshape(n).astype(np.int64)


def hashes(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u8")


def message(to: str, kind: str, frm: int = 0, x: int = 0, y: int = 0, *arrays: bytes) -> tuple:
    return (to, kind, frm, int(x), int(y), *arrays, *[None] * (5 - len(arrays)))


def as_table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=_NAMES)


def grouped(*parts: DataFrame, step: Callable[[str, list[dict]], list[tuple]]) -> DataFrame:
    """``step`` over all rows sent to one place."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        # Sorted, so that a step doesn't depend on the order rows arrive in.
        return as_table(step(key[0].as_py(), sorted(table.to_pylist(), key=lambda r: (r["kind"], r["frm"]))))

    return rows.groupBy("to").applyInArrow(run, ROW)


def of(rows: list[dict], kind: str) -> list[dict]:
    return [r for r in rows if r["kind"] == kind]


def split_by(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each occurring bucket with its places, in order."""
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, order[edges[b] : edges[b + 1]]


# ---------------------------------------------------------------- packs


@dataclass
class Pack:
    """Documents as numbers into a sorted vocabulary (which holds START)."""

    name: str
    ids: list
    train: np.ndarray
    held: list
    size: np.ndarray
    vocab: np.ndarray
    stream: np.ndarray

    @staticmethod
    def of(row: dict) -> Pack:
        flags = np.frombuffer(row["b"], np.uint8)
        ids = np.frombuffer(row["a"], "<i8").tolist()
        # Bits: trains, held out, the id is null.
        # Words are kept by falling frequency, which makes their numbers small; here they are sorted.
        vocab, stream = hashes(row["d"]), dec(row["e"])
        order = np.argsort(vocab)
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        return Pack(row["to"], [None if f & 4 else i for f, i in zip(flags.tolist(), ids)], (flags & 1).astype(bool), [None if f & 4 else bool(f & 2) for f in flags.tolist()], dec(row["c"]), vocab[order], number[stream])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (context, word) as number of the pair, sorted, the pair of each token, and whether it trains."""
        first = np.cumsum(self.size) - self.size
        before = np.empty_like(self.stream)
        before[1:] = self.stream[:-1]
        before[first] = np.searchsorted(self.vocab, START)
        keys, which = np.unique(before * len(self.vocab) + self.stream, return_inverse=True)
        return keys, which, np.repeat(self.train, self.size)


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, made = TaskContext.get().partitionId(), 0
    ids: list = []
    flags: list = []
    words: list[np.ndarray] = []
    held = 0

    def close() -> pa.RecordBatch:
        size = np.array([len(w) for w in words], np.int64)
        every = np.concatenate(words)
        vocab, stream, counts = np.unique(np.append(every, START), return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        number = np.empty_like(order)
        number[order] = np.arange(len(order))
        row = message(f"p{part}-{made}", "pack", 0, len(every), len(ids), np.array([i or 0 for i in ids], "<i8").tobytes(), np.array(flags, np.uint8).tobytes(), enc(size), vocab[order].tobytes(), enc(number[stream[:-1]]))
        return as_table([row]).combine_chunks().to_batches()[0]

    end = np.array([END])
    for batch in batches:
        own_ids, train, out = (batch.column(i).to_pylist() for i in (0, 2, 3))
        for row, after, found, bounds, _ in hashed_words(batch.column(1)):
            for i in range(row, after):
                words.append(np.concatenate([found[bounds[i - row] : bounds[i - row + 1]], end]))
                ids.append(own_ids[i])
                flags.append((own_ids[i] is not None and bool(train[i])) | 2 * bool(out[i]) | 4 * (own_ids[i] is None))
                held += len(words[-1])
                if held >= PACK_TOKENS:
                    yield close()
                    made, ids, flags, words, held = made + 1, [], [], [], 0
    if ids:
        yield close()


def _each_pack(fn: Callable[[Pack], list[tuple]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rows = fn(Pack.of(batch.slice(i, 1).to_pylist()[0]))
                yield from as_table(rows).combine_chunks().to_batches()

    return run


# ---------------------------------------------------------------- seating


def _uniform(key: np.ndarray, turn: int) -> np.ndarray:
    """Numbers in (0, 1) by key and turn."""
    return (mix(key + _U(turn * 0x9E3779B97F4A7C15 % (1 << 64))) >> _U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


@lru_cache(8)
def stirling_logs(limit: int, d: float) -> np.ndarray:
    """log S(c, t) for c, t <= limit: S(c + 1, t) = S(c, t - 1) + (c - d t) S(c, t)."""
    out = np.full((limit + 1, limit + 1), -np.inf)
    out[0, 0] = 0.0
    t = np.arange(1, limit + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        for c in range(limit):
            grow = np.where(c - d * t > 0, np.log(np.maximum(c - d * t, 1e-300)), -np.inf) + out[c, 1:]
            out[c + 1, 1:] = np.logaddexp(out[c, :-1], grow)
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """For x > 0, by Stirling's series above 8."""
    shift = np.zeros_like(x)
    for _ in range(8):
        low = x < 8
        shift -= np.where(low, np.log(np.where(low, x, 1.0)), 0.0)
        x = np.where(low, x + 1, x)
    return shift + (x - 0.5) * np.log(x) - x + 0.9189385332046727 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def _stirling_log(c: np.ndarray, t: np.ndarray, d: float) -> np.ndarray:
    """log S(c, t) for large c: the saddle point of c! / (t! d^t) [x^c] (1 - (1 - x)^d)^t."""
    goal = c / np.minimum(t, c * 0.999999)
    low, high = np.full(t.shape, -80.0 / d), np.full(t.shape, -1e-12)  # log(1 - x)
    for _ in range(45):
        mid = (low + high) / 2
        y = np.exp(mid)
        steep = d * -np.expm1(mid) * np.exp((d - 1) * mid) / -np.expm1(d * mid) > goal
        low, high = np.where(steep, mid, low), np.where(steep, high, mid)
    ly = (low + high) / 2
    y, f = np.exp(ly), -np.expm1(d * ly)
    x, slope = -np.expm1(ly), d * np.exp((d - 1) * ly)
    spread = slope / f + x * (1 - d) * slope / y / f - x * (slope / f) ** 2
    return _log_gamma(c + 1) - _log_gamma(t + 1) - t * np.log(d) + t * np.log(f) - c * np.log(x) - 0.5 * np.log(2 * np.pi * np.maximum(t * x * spread, 1e-12))


def _seat(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, s: float, key: np.ndarray, turn: int) -> np.ndarray:
    """Tables of large dishes: the most likely number, and a draw by the weights on a grid around it."""

    # The saddle point is off by about e / t; one table, where S is known, tells e.
    one = np.ones(len(c))
    off = _log_gamma(c - d) - _log_gamma(one - d) - _stirling_log(c, one, d)

    def weight(t: np.ndarray) -> np.ndarray:
        return _stirling_log(c, t, d) + off / t + t * np.log(d * p) + _log_gamma(s / d + others + t)

    low, high = np.ones(len(c)), c.copy()
    while (low < high).any():
        mid = np.floor((low + high) / 2)
        here, after = weight(np.stack([mid, np.minimum(mid + 1, c)]))
        up = after > here
        low, high = np.where(up & (mid < high), mid + 1, low), np.where(up, high, mid)
    mode, top = low, weight(low)
    edges = []
    for sign, end in ((-1, np.ones(len(c))), (1, c)):
        reach = np.ones(len(c))
        for _ in range(64):
            at = np.clip(mode + sign * reach, 1, c)
            short = (weight(at) > top - 30) & (at != end)
            if not short.any():
                break
            reach = np.where(short, reach * 2, reach)
        edges.append(np.clip(mode + sign * reach, 1, c))
    grid = np.linspace(edges[0], edges[1], GRID)
    whole = np.rint(grid)
    again = whole == np.vstack([np.zeros(len(c)), whole[:-1]])  # numbers that the grid names twice count once
    share = np.cumsum(np.where(again, 0.0, np.exp(weight(whole) - top)), 0)
    pick = np.minimum((share < _uniform(key, turn) * share[-1]).sum(0), GRID - 1)
    # Between grid points further than one apart, any number is as likely.
    gap = (edges[1] - edges[0]) / (GRID - 1)
    jitter = np.where(gap > 1, (_uniform(key, turn + 1) - 0.5) * gap, 0.0)
    return np.clip(np.rint(grid[pick, np.arange(len(c))] + jitter), 1, c).astype(np.int64)


def draw_tables(c: np.ndarray, others: np.ndarray, p: np.ndarray, d: float, s: float, key: np.ndarray, sweep: int) -> np.ndarray:
    """Numbers of tables of dishes of ``c`` customers, given the other tables of their restaurants and the parent's ``p``."""
    out = np.ones(len(c), np.int64)
    turn = sweep << 32
    logs = stirling_logs(EXACT, d)
    for kind, own in split_by(np.searchsorted(WIDTHS, c), len(WIDTHS) + 1):
        if kind == 0:
            continue
        width = int(WIDTHS[kind]) if kind < len(WIDTHS) else GRID
        for at in range(0, len(own), max(1, CELLS // width)):
            part = own[at : at + max(1, CELLS // width)]
            if kind == len(WIDTHS):
                out[part] = _seat(c[part].astype(float), others[part].astype(float), p[part], d, s, key[part], turn)
                continue
            opened = np.log(s + d * (others[part, None] + np.arange(width))) + np.log(p[part, None])
            weight = logs[c[part], 1 : width + 1] + np.cumsum(opened, 1)
            share = np.cumsum(np.exp(weight - weight.max(1, keepdims=True)), 1)
            out[part] = 1 + (share < _uniform(key[part], turn)[:, None] * share[:, -1:]).sum(1)
    return np.minimum(out, np.maximum(c, 1))


# ---------------------------------------------------------------- the model


@dataclass
class Settings:
    buckets: int
    tokens: int
    words: int
    docs: int
    heavy: np.ndarray
    discount: float
    parent_discount: float
    strength: float
    parent_strength: float
    seed: int

    def word_bucket(self, w: np.ndarray) -> np.ndarray:
        return (w % _U(self.buckets)).astype(np.int64)

    def dish_bucket(self, u: np.ndarray, w: np.ndarray) -> np.ndarray:
        own = mix(u)
        spread = np.isin(u, self.heavy)
        own[spread] = mix(own[spread] + w[spread])
        return (own % _U(self.buckets)).astype(np.int64)

    def parent(self, customers: np.ndarray, tables: np.ndarray, totals: tuple[int, int]) -> np.ndarray:
        """p(word) by its customers and tables in the parent's restaurant."""
        c, t = totals
        base = (self.parent_strength + self.parent_discount * t) / (self.parent_strength + c) / (self.words + 1)
        return (customers - self.parent_discount * tables) / (self.parent_strength + c) + base


def _ask_words(buckets: int):
    def rows(pack: Pack) -> list[tuple]:
        train = np.repeat(pack.train, pack.size)
        counts = np.bincount(pack.stream[train], minlength=len(pack.vocab))
        own = (pack.vocab % _U(buckets)).astype(np.int64)
        return [message(f"w{b}", pack.name, 0, 0, 0, pack.vocab[at].tobytes(), enc(counts[at])) for b, at in split_by(own, buckets)]

    return _each_pack(rows)


def _count_words(to: str, rows: list[dict]) -> list[tuple]:
    """The bucket's training words (and START) with their counts, and the places of each pack's words among them, from 1."""
    words = np.concatenate([hashes(r["a"]) for r in rows])
    counts = np.concatenate([dec(r["b"]) for r in rows])
    every, which = np.unique(words, return_inverse=True)
    total = np.bincount(which, counts, len(every)).astype(np.int64)
    kept = (total > 0) | (every == START)
    place = np.where(kept, np.cumsum(kept), 0)
    out = [message(to, "words", 0, total.sum(), (total > 0).sum(), every[kept].tobytes(), enc(total[kept]))]
    at = 0
    for r in rows:
        n = len(r["a"]) // 8
        out.append(message(to, "asked:" + r["kind"], 0, 0, 0, enc(place[which[at : at + n]])))
        at += n
    return out


def _ask_dishes(model: Settings, turn: int):
    """A pack's pairs to the buckets of one round, so that not all of them are on the way at a time."""

    def rows(pack: Pack) -> list[tuple]:
        keys, which, train = pack.pairs()
        counts = np.bincount(which[train], minlength=len(keys))
        u, w = pack.vocab[keys // len(pack.vocab)], pack.vocab[keys % len(pack.vocab)]
        out = []
        for b, at in split_by(model.dish_bucket(u, w), model.buckets):
            if b % ROUNDS != turn:
                continue
            first = np.flatnonzero(np.append(True, u[at][1:] != u[at][:-1]))
            out.append(message(f"d{b}", pack.name, 0, 0, 0, u[at][first].tobytes(), enc(np.diff(np.append(first, len(at)))), w[at].tobytes(), enc(counts[at])))
        return out

    return _each_pack(rows)


def _count_dishes(model: Settings):
    """A bucket's dishes of two and more customers, its contexts, the links of its words, and the codes of each pack's pairs."""

    def step(to: str, rows: list[dict]) -> list[tuple]:
        u = np.concatenate([np.repeat(hashes(r["a"]), dec(r["b"])) for r in rows])
        w = np.concatenate([hashes(r["c"]) for r in rows])
        counts = np.concatenate([dec(r["d"]) for r in rows])
        order = np.lexsort((w, u))
        u, w, counts = u[order], w[order], counts[order]
        new = np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1]))
        dish = np.cumsum(new) - 1
        total = np.bincount(dish, counts).astype(np.int64)
        u, w = u[new], w[new]
        large, single = total > 1, total == 1
        # 0 and 1: pairs of so many customers; others: place among the large dishes, from 2.
        code = np.where(large, np.cumsum(large) + 1, np.minimum(total, 1))
        back = np.empty(len(order), np.int64)
        back[order] = code[dish]
        own, at = int(to[1:]), 0
        out = []
        for r in rows:
            n = len(r["c"]) // 8
            codes = back[at : at + n]
            at += n
            big = codes >= 2
            out.append(message(to, "asked:" + r["kind"], 0, 0, 0, enc(np.minimum(codes, 2)), enc(np.diff(codes[big], prepend=0))))
        known = total > 0
        contexts, ctx = np.unique(u[known], return_inverse=True)
        ones = np.bincount(ctx[single[known]], minlength=len(contexts))
        names, word = np.unique(w[large], return_inverse=True)
        # Words in order of their buckets, so that what is sent to a bucket is one slice.
        order = np.argsort(model.word_bucket(names), kind="stable")
        place = np.empty(len(names), np.int64)
        place[order] = np.arange(len(names))
        names = names[order]
        out.append(message(to, "dishes", 0, single.sum(), (total == 2).sum(), contexts.tobytes(), enc(ones), enc(ctx[large[known]]), enc(total[large]), enc(place[word])))
        out.append(message(to, "names", 0, 0, 0, names.tobytes()))
        out += [message(f"w{k}", "link", own, 0, 0, names[at].tobytes()) for k, at in split_by(model.word_bucket(names), model.buckets)]
        alone, ones = np.unique(w[single], return_counts=True)
        out += [message(f"w{k}", "single", own, 0, 0, alone[at].tobytes(), enc(ones[at])) for k, at in split_by(model.word_bucket(alone), model.buckets)]
        return out

    return step


def _link_words(to: str, rows: list[dict]) -> list[tuple]:
    """Places of each dish bucket's words in a word bucket, and its words' customers that sit alone in their contexts."""
    words = [r for r in rows if r["kind"] == "words"]
    names = hashes(words[0]["a"])
    alone = np.zeros(len(names), np.int64)
    out = []
    for r in rows:
        if r["kind"] == "single":
            alone[np.searchsorted(names, hashes(r["a"]))] += dec(r["b"])
        elif r["kind"] == "link":
            out.append(message(to, "link", r["frm"], 0, 0, enc(np.searchsorted(names, hashes(r["a"])))))
    return [*out, message(to, "words", 0, 0, 0, words[0]["a"], enc(alone))]


def _parents(model: Settings, sweep: int, totals: tuple[int, int] | None):
    """A word bucket's step: customers from the tables it is sent, then new tables; both go to the dish buckets."""

    def step(to: str, rows: list[dict]) -> list[tuple]:
        words = of(rows, "words")[0]
        key = hashes(words["a"])
        customers = dec(words["b"]).copy()
        places = {r["frm"]: dec(r["a"]) for r in of(rows, "link")}
        for r in of(rows, "tables"):
            customers[places[r["frm"]]] += dec(r["a"])
        tables = np.minimum(customers, 1)
        if totals:
            before = dec(of(rows, "own")[0]["b"])
            base = np.full(len(key), 1.0 / (model.words + 1))
            fresh = draw_tables(customers, totals[1] - before, base, model.parent_discount, model.parent_strength, key + _U(model.seed), sweep)
            tables = np.where(customers > 0, fresh, 0)
        out = [message(f"d{b}", "parent", int(to[1:]), 0, 0, enc(customers[at]), enc(tables[at])) for b, at in places.items()]
        out.append(message(to, "own", 0, customers.sum(), tables.sum(), enc(customers), enc(tables)))
        out.append(message("", "few", 0, (customers == 1).sum(), (customers == 2).sum()))
        return out

    return step


def _dishes(model: Settings, sweep: int, totals: tuple[int, int] | None, heavy: dict[int, int]):
    """A dish bucket's step: new tables of its dishes; their sums go to the word buckets."""

    def step(to: str, rows: list[dict]) -> list[tuple]:
        own = of(rows, "dishes")[0]
        contexts, ctx, size, word = hashes(own["a"]), dec(own["c"]), dec(own["d"]), dec(own["e"])
        names = hashes(of(rows, "names")[0]["a"])
        if totals is None:
            tables = np.ones(len(size), np.int64)
        else:
            tables = dec(of(rows, "own")[0]["a"])
            sent = sorted(of(rows, "parent"), key=lambda r: r["frm"])
            p = model.parent(np.concatenate([dec(r["a"]) for r in sent]), np.concatenate([dec(r["b"]) for r in sent]), totals)[word] if sent else np.zeros(0)
            in_all = _in_all(contexts, ctx, dec(own["b"]), tables, heavy)
            key = mix(contexts[ctx] + _U(model.seed)) + names[word]
            tables = draw_tables(size, in_all[ctx] - tables, p, model.discount, model.strength, key, sweep)
        sums = np.bincount(word, tables, len(names)).astype(np.int64)
        out = [message(f"w{k}", "tables", int(to[1:]), 0, 0, enc(sums[at])) for k, at in split_by(model.word_bucket(names), model.buckets)]
        out.append(message(to, "own", 0, 0, 0, enc(tables)))
        for at in np.flatnonzero(np.isin(contexts, model.heavy)).tolist():
            number = int(np.searchsorted(model.heavy, contexts[at]))
            out.append(message("", "heavy", number, tables[ctx == at].sum() + dec(own["b"])[at], 0))
        return out

    return step


def _in_all(contexts, ctx, ones, tables, heavy: dict[int, int]) -> np.ndarray:
    """Tables of each context of a bucket; those of heavy contexts are known over all buckets."""
    found = ones + np.bincount(ctx, tables, len(contexts)).astype(np.int64)
    if heavy:
        names = np.array(list(heavy), _U)
        at = np.searchsorted(contexts, names)
        for place, name in zip(at.tolist(), names):
            if place < len(contexts) and contexts[place] == name:
                found[place] = heavy[int(name)]
    return found


def _answer_pairs(model: Settings, samples: int):
    """To the packs, customers and tables of their pairs in every sample; to the word buckets, the tables of contexts."""

    def step(to: str, rows: list[dict]) -> list[tuple]:
        own = of(rows, "dishes")[0]
        contexts, ctx, size = hashes(own["a"]), dec(own["c"]), dec(own["d"])
        drawn = [dec(of(rows, f"own{i}")[0]["a"]) for i in range(samples)]
        ones = dec(own["b"])
        sums = [ones + np.bincount(ctx, t, len(contexts)).astype(np.int64) for t in drawn]
        out = [message(f"w{k}", "context", int(to[1:]), 0, 0, contexts[at].tobytes(), *[enc(np.concatenate([s[at] for s in sums]))]) for k, at in split_by(model.word_bucket(contexts), model.buckets)]
        # Places 0 and 1 stand for pairs of no and of one customer.
        wide = [np.concatenate([[0, 1], x]) for x in (size, *drawn)]
        for r in rows:
            if r["kind"].startswith("asked:"):
                codes = dec(r["a"])
                codes[codes == 2] = np.cumsum(dec(r["b"]))
                out.append(message(r["kind"][6:], "pairs", int(to[1:]), 0, 0, enc(wide[0][codes]), enc(np.concatenate([t[codes] for t in wide[1:]]))))
        return out

    return step


def _answer_words(model: Settings, samples: int):
    """To the packs: count, and by sample customers and tables in the parent and tables of the word's own context."""

    def step(to: str, rows: list[dict]) -> list[tuple]:
        words = of(rows, "words")[0]
        names, counts = hashes(words["a"]), dec(words["b"])
        inside = np.zeros((samples, len(names)), np.int64)
        for r in of(rows, "context"):
            at = np.searchsorted(names, hashes(r["a"]))
            inside[:, at] += dec(r["b"]).reshape(samples, -1)
        drawn = [of(rows, f"own{i}")[0] for i in range(samples)]
        blank = lambda x: np.concatenate([[0], x])
        counts = blank(counts)
        parts = [[blank(x) for x in side] for side in ([dec(r["a"]) for r in drawn], [dec(r["b"]) for r in drawn], list(inside))]
        out = []
        for r in rows:
            if r["kind"].startswith("asked:"):
                at = dec(r["a"])
                out.append(message(r["kind"][6:], "words", int(to[1:]), 0, 0, enc(counts[at]), *[enc(np.concatenate([x[at] for x in side])) for side in parts]))
        return out

    return step


def _score(model: Settings, totals: list[tuple[int, int]]):
    samples = len(totals)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pack = Pack.of(of(rows, "pack")[0])
        n = len(pack.vocab)
        counts, wide = np.zeros(n, np.int64), np.zeros((3, samples, n), np.int64)
        places = dict(split_by(model.word_bucket(pack.vocab), model.buckets))
        for r in of(rows, "words"):
            at = places[r["frm"]]
            counts[at] = dec(r["a"])
            for side, data in enumerate((r["b"], r["c"], r["d"])):
                wide[side][:, at] = dec(data).reshape(samples, -1)
        keys, which, _ = pack.pairs()
        u, w = keys // n, keys % n
        size, tables = np.zeros(len(keys), np.int64), np.zeros((samples, len(keys)), np.int64)
        places = dict(split_by(model.dish_bucket(pack.vocab[u], pack.vocab[w]), model.buckets))
        for r in of(rows, "pairs"):
            at = places[r["frm"]]
            size[at] = dec(r["a"])
            tables[:, at] = dec(r["b"]).reshape(samples, -1)
        # As a context, a word has as many customers as it has uses; START has one a training document.
        inside = np.where(pack.vocab == START, model.docs, counts)[u]
        mean = np.zeros(len(keys))
        for i in range(samples):
            p = model.parent(wide[0][i], wide[1][i], totals[i])
            mean += (size - model.discount * tables[i] + (model.strength + model.discount * wide[2][i][u]) * p[w]) / (model.strength + inside)
        doc = np.repeat(np.arange(len(pack.size)), pack.size)
        logs = np.log10(mean / samples)
        base = np.log10((counts + 1) / (model.tokens + model.words + 1))
        cols = {
            "doc_id": pa.array(pack.ids, pa.int64()), "held_out": pa.array(pack.held, pa.bool_()), "n_tokens": pa.array(pack.size, pa.int64()),
            "n_known": pa.array(np.bincount(doc, counts[pack.stream] > 0, len(pack.size)).astype(np.int64)),
            "train_tokens": pa.array(np.full(len(pack.size), model.tokens, np.int64)),
            "base_score": pa.array(np.bincount(doc, base[pack.stream], len(pack.size))),
            "score": pa.array(np.bincount(doc, logs[which], len(pack.size))),
        }
        return pa.table(cols)

    return run


def discount_of(ones: int, twos: int) -> float:
    """The discount by the numbers of dishes of one and of two customers."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def scores(
    docs: DataFrame, train: Column, held_out: Column, sweeps: int = 6, burn_in: int = 3, strength: float = 1.0, parent_strength: float = 1.0,
    seed: int = 12, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None, bucket_tokens: int = BUCKET_TOKENS,
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document.

    ``train`` marks the rows to learn from, ``held_out`` is returned as it is.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) of the token counts.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "pitman-yor")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(held_out, F.lit(False)).alias("held"))
    packs = scratch.store(rows.mapInArrow(_packs, ROW), "packs")
    known = packs.agg(F.sum("x")).first()[0]
    if known is None:
        return spark.createDataFrame([], "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    buckets = buckets or max(LEAST_BUCKETS, -(-known // bucket_tokens))

    counted = scratch.store(grouped(packs.mapInArrow(_ask_words(buckets), ROW), step=_count_words), "words")
    words, asked_words = counted.where("kind = 'words'"), counted.where("kind like 'asked:%'")
    tokens, n_words = words.agg(F.sum("x"), F.sum("y")).first()
    heavy, n_docs = _heavy_contexts(words, tokens)
    model = Settings(buckets, tokens, n_words, n_docs, heavy, 0.5, 0.5, strength, parent_strength, seed)

    rounds = [scratch.store(grouped(packs.mapInArrow(_ask_dishes(model, turn), ROW), step=_count_dishes(model)), "dishes") for turn in range(ROUNDS)]
    dishes = reduce(DataFrame.unionByName, rounds)
    fixed = dishes.where("kind in ('dishes', 'names')")
    model.discount = discount_of(*(dishes.where("kind = 'dishes'").agg(F.sum("x"), F.sum("y")).first()))
    links = scratch.store(grouped(words, dishes.where("kind in ('link', 'single')"), step=_link_words), "links")

    def totals_of(stored: DataFrame) -> tuple[int, int]:
        return tuple(stored.where("kind = 'own'").agg(F.sum("x"), F.sum("y")).first())

    def heavy_of(stored: DataFrame) -> dict[int, int]:
        found = stored.where("kind = 'heavy'").groupBy("frm").agg(F.sum("x")).collect()
        return {int(heavy[number]): total for number, total in found}

    tables = scratch.store(grouped(fixed, step=_dishes(model, 0, None, {})), "tables")
    parents = scratch.store(grouped(links, tables.where("kind = 'tables'"), step=_parents(model, 0, None)), "parents")
    model.parent_discount = discount_of(*parents.where("kind = 'few'").agg(F.sum("x"), F.sum("y")).first())
    samples, totals = [], totals_of(parents)
    for sweep in range(1, sweeps + 1):
        last_tables, last_parents = tables, parents
        tables = scratch.store(grouped(fixed, tables.where("kind = 'own'"), parents.where("kind = 'parent'"), step=_dishes(model, sweep, totals, heavy_of(tables))), "tables")
        parents = scratch.store(grouped(links, tables.where("kind = 'tables'"), parents.where("kind = 'own'"), step=_parents(model, sweep, totals)), "parents")
        totals = totals_of(parents)
        if sweep <= burn_in + 1:
            scratch.drop(last_tables, last_parents)
        if sweep > burn_in:
            samples.append((tables, parents, totals))

    drawn = [[s[side].where("kind = 'own'").withColumn("kind", F.lit(f"own{i}")) for i, s in enumerate(samples)] for side in (0, 1)]
    from_pairs = scratch.store(grouped(dishes.where("kind = 'dishes' or kind like 'asked:%'"), *drawn[0], step=_answer_pairs(model, len(samples))), "pairs")
    from_words = scratch.store(grouped(words, asked_words, from_pairs.where("kind = 'context'"), *drawn[1], step=_answer_words(model, len(samples))), "answers")
    scratch.drop(*rounds, counted, links, *[x for s in samples for x in s[:2]])
    answers = packs.unionByName(from_pairs.where("kind = 'pairs'")).unionByName(from_words)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return answers.groupBy("to").applyInArrow(_score(model, [s[2] for s in samples]), schema)


def _heavy_contexts(words: DataFrame, tokens: int) -> tuple[np.ndarray, int]:
    """START and the words of more than 1 in HEAVY of all tokens (so at most HEAVY), sorted, and the number of END tokens."""
    least = max(1, tokens // HEAVY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                names, counts = hashes(a), dec(b)
                at = np.flatnonzero((counts > least) | (names == END))
                yield pa.RecordBatch.from_arrays([pa.array(names[at].view(np.int64)), pa.array(counts[at], pa.int64())], ["name", "n"])

    found = {int(_U(r["name"] % (1 << 64))): r["n"] for r in words.select("a", "b").mapInArrow(run, "name long, n long").collect()}
    often = [name for name, n in found.items() if n > least]
    return np.unique(np.array([*often, int(START)], _U)), found.get(int(END), 0)
