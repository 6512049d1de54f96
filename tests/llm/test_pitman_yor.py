"""The Pitman-Yor language model against brute force: counts, seating, a plain Gibbs sampler, and its defined edge cases."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from larkspan.llm import pitman_yor
from larkspan.llm.queries import QUERIES
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def rest():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 7 == 2


def tokens(text):
    return [*WORD.findall((text or "").translate(LOWER)), None]


def base_rows(docs):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score) of each document."""
    counts = Counter(w for i, t in docs if i is not None and not held(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in docs:
        own = tokens(t)
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)
        out.append((i, None if i is None else held(i), len(own), sum(counts[w] > 0 for w in own), n, base))
    return out


def key(row):
    return [(x is None, x) for x in row[:5]]


def test_counts_and_base_scores(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op12_lm_scoring"](spark, sf).collect()
    want = sorted(base_rows(docs), key=key)
    got = sorted(map(tuple, got), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    unseen = [g for g in got if g[1]]
    assert sum(g[6] for g in unseen) > sum(g[5] for g in unseen)  # better than the base on held-out texts
    assert all(g[6] < 0 for g in got)


def weights(c, others, p, d, s):
    """Probabilities of 1..c tables by summing over all ways to seat c customers one after another."""
    state = {1: s + d * others}
    for n in range(1, c):
        after = defaultdict(float)
        for t, w in state.items():
            after[t] += w * (n - d * t) / n
            after[t + 1] += w * (s + d * (others + t)) * p / n
        state = after
    total = sum(state.values())
    return np.array([state.get(t, 0) / total for t in range(1, c + 1)])


@pytest.mark.parametrize("c, others, p, d, s", [(2, 0, 0.3, 0.5, 1.0), (5, 7, 0.2, 0.8, 0.5), (12, 3, 0.05, 0.3, 2.0), (48, 40, 0.1, 0.6, 1.0), (60, 40, 0.1, 0.6, 1.0), (257, 40, 0.1, 0.6, 1.0), (600, 0, 0.02, 0.6, 1.0), (1500, 25, 0.3, 0.7, 1.0), (3000, 40, 0.1, 0.5, 1.0)])
def test_tables_of_a_dish(c, others, p, d, s):
    n = 20_000
    drawn = pitman_yor.draw_tables(np.full(n, c), np.full(n, others), np.full(n, p), d, s, np.arange(n).astype(np.uint64), 3)
    want = weights(c, others, p, d, s)
    got = np.bincount(drawn, minlength=c + 1)[1:] / n
    # Above EXACT the Stirling numbers are close, not exact; the rest is the noise of the draws.
    assert np.abs(got - want).sum() < (0.05 if c <= pitman_yor.EXACT else 0.15)
    sizes = np.arange(1, c + 1)
    assert abs((got * sizes).sum() - (want * sizes).sum()) < (0.02 if c <= pitman_yor.EXACT else 0.05) * (want * sizes).sum()


def test_dishes_of_any_size_end():
    c = np.array([0, 1, 2, 10**4, 10**7, 10**10])
    t = pitman_yor.draw_tables(c, c // 10, np.full(6, 0.5), 0.5, 1.0, np.arange(6).astype(np.uint64), 1)
    assert (t <= np.maximum(c, 1)).all() and t[3] < t[4] < t[5] < 10**10


def gibbs(train, d, d0, s, s0, sweeps, burn_in, rng):
    """Customer by customer, with the tables and their sizes; yields a predictive function per sample."""
    counts = Counter(w for doc in train for w in doc)
    base = 1.0 / (len(counts) + 1)
    seats = defaultdict(lambda: defaultdict(list))  # context -> word -> sizes of tables; context () is the parent
    totals, tables = Counter(), Counter()

    def p_parent(w):
        sizes = seats[()].get(w, [])
        return (sum(sizes) - d0 * len(sizes) + (s0 + d0 * tables[()]) * base) / (s0 + totals[()])

    def sit(u, w):
        disc, strength, above = (d0, s0, base) if u == () else (d, s, p_parent(w))
        sizes = seats[u][w]
        options = [n - disc for n in sizes] + [(strength + disc * tables[u]) * above]
        at = rng.choices(range(len(options)), options)[0]
        if at == len(sizes):
            sizes.append(1)
            tables[u] += 1
            if u != ():
                sit((), w)
        else:
            sizes[at] += 1
        totals[u] += 1

    def leave(u, w):
        sizes = seats[u][w]
        at = rng.choices(range(len(sizes)), sizes)[0]
        sizes[at] -= 1
        totals[u] -= 1
        if not sizes[at]:
            sizes.pop(at)
            tables[u] -= 1
            if u != ():
                leave((), w)

    pairs = [((u,), w) for doc in train for u, w in zip(["^", *doc[:-1]], doc)]
    for u, w in pairs:
        sit(u, w)
    for sweep in range(sweeps):
        for u, w in pairs:
            leave(u, w)
            sit(u, w)
        if sweep >= burn_in:
            yield lambda u, w: (sum(seats[(u,)].get(w, [])) - d * len(seats[(u,)].get(w, [])) + (s + d * tables[(u,)]) * p_parent(w)) / (s + totals[(u,)])


def test_scores_match_a_plain_gibbs_sampler(spark):
    rng = random.Random(3)
    chain = {w: [rng.choice("abcdefgh") for _ in range(3)] for w in "abcdefgh"}
    docs = []
    for i in range(60):
        w, words = rng.choice("abc"), []
        for _ in range(rng.randint(1, 14)):
            words.append(w)
            w = rng.choice(chain.get(w, "abc")) if rng.random() < 0.8 else rng.choice("abcdefghijklmnop")
        docs.append((i, " ".join(words)))
    docs += [(100, "q r s"), (101, "a a a a q"), (102, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    learn = (F.col("doc_id") < 100) & (rest() != 2)
    got = {r.doc_id: r.score for r in pitman_yor.scores(df, learn, ~learn, sweeps=16, burn_in=4, buckets=2).collect()}
    train = [tokens(t) for i, t in docs if i < 100 and not held(i)]
    pairs = Counter(p for doc in train for p in zip(["^", *doc[:-1]], doc))
    ones, twos = (sum(n == k for n in pairs.values()) for k in (1, 2))
    d = pitman_yor.discount_of(ones, twos)
    types = Counter(w for _, w in pairs)
    d0 = pitman_yor.discount_of(*(sum(n == k for n in types.values()) for k in (1, 2)))
    wanted = [(u, w) for _, t in docs for own in [tokens(t)] for u, w in zip(["^", *own[:-1]], own)]
    mean, samples = Counter(), 0
    for predict in gibbs(train, d, d0, 1.0, 1.0, 320, 20, rng):
        samples += 1
        for pair in set(wanted):
            mean[pair] += predict(*pair)
    for i, t in docs:
        own = tokens(t)
        want = sum(math.log10(mean[p] / samples) for p in zip(["^", *own[:-1]], own))
        assert abs(got[i] - want) < 0.03 * len(own), (i, t)
    errors = [got[i] - sum(math.log10(mean[p] / samples) for p in zip(["^", *tokens(t)[:-1]], tokens(t))) for i, t in docs]
    assert abs(sum(errors)) / sum(len(tokens(t)) for _, t in docs) < 0.004


def edge(spark, rows):
    return spark.createDataFrame([(*r, 0.5, "x", 1) for r in rows], "doc_id long, text string, score double, held_out string, n_tokens int")


def run(df, **settings):
    return sorted(map(tuple, pitman_yor.scores(df, rest() != 2, rest() == 2, **settings).collect()), key=key)


def test_edge_cases_and_any_partitioning(spark):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "The the THE cat"), (4, "The the THE cat"), (5, "é 漢 é 漢 É"), (None, "the cat"), (None, None), (6, "word " * 30_000), (7, "x" * 100_000), (8, "unseen here"), (9, "the cat the dog " * 50)]
    df = edge(spark, rows)
    got = run(df)
    want = sorted(base_rows(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-9)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    again = run(df.repartition(5), buckets=7)
    assert [g[:5] for g in again] == [g[:5] for g in got]
    assert np.allclose([g[6] for g in again], [g[6] for g in got], rtol=1e-12)


def test_nothing_to_learn_from(spark):
    assert run(edge(spark, [])) == []
    only = next(i for i in range(100) if held(i))
    assert run(edge(spark, [(only, "a b")])) == [(only, True, 3, 0, 0, 0.0, 0.0)]
    got = run(edge(spark, [(3, None)]))
    assert got[0][:5] == (3, False, 1, 1, 1) and math.isclose(got[0][5], math.log10(2 / 3))
