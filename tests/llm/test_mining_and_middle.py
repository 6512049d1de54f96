"""Hard negatives and fill-in-middle against SQL and brute force, and their defined edge cases."""

import duckdb
import numpy as np
import pytest
from larkspan.llm import fill_middle, hard_negatives
from larkspan.llm.queries import QUERIES, SQL
from pyspark.sql import functions as F


def matches_sql(spark, sf, name, table):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    out = QUERIES[name](spark, sf)
    found = con.execute(SQL[name])
    assert sorted(out.columns) == sorted(d[0] for d in found.description)
    order = [d[0] for d in found.description]
    assert sorted(tuple(r) for r in out.select(order).collect()) == sorted(found.fetchall())


def test_hard_negatives_match_sql(spark, sf):
    matches_sql(spark, sf, "op11_hard_negatives", "embeddings")


def test_fill_in_middle_matches_sql(spark, sf):
    matches_sql(spark, sf, "op13_fill_in_middle", "documents")


# ---------------------------------------------------------------- hard negatives


def brute_negatives(rows, every=10, positives=5, negatives=10, low=30, high=90):
    fine = [(i, y, [int(np.floor(256 * x)) for x in v]) for i, y, v in rows if i is not None and y is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for at, (a, label, v) in enumerate(fine):
        if a % every:
            continue
        others = [(-sum(p * q for p, q in zip(v, w)), i, y) for n, (i, y, w) in enumerate(fine) if n != at and len(w) == len(v)]
        for p, positive, _ in sorted(o for o in others if o[2] == label)[:positives]:
            own = [(s, i) for s, i, y in sorted(others) if y != label and -low * p <= -100 * s <= -high * p][:negatives]
            out += [(a, positive, n + 1, i, -p, -s) for n, (s, i) in enumerate(own)]
    return sorted(out)


SCHEMA = "vec_id long, label int, embedding array<double>, rank int, score double, slot string"


def mined(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, 0.5, "x") for r in rows], SCHEMA)
    return sorted(map(tuple, hard_negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, **settings).collect()))


def test_hard_negatives_of_ties_hot_labels_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(int(i), int(rng.integers(0, 3)) if i % 3 else 0, [float(x) for x in rng.integers(-2, 6, 5) / 256]) for i in range(260)]
    rows += [(300 + i, 1, [0.01] * 5) for i in range(80)]  # copies of one vector
    rows += [(500 + i, i % 2, [0.0] * 5) for i in range(12)]  # no direction: scores of 0
    rows += [(10, 0, rows[10][2]), (10, 2, [0.02] * 5)]  # ids that occur twice, once as a copy
    rows += [(1000, None, [1.0] * 5), (1010, 1, None), (1020, 1, [1.0, None, 0.0, 0.0, 0.0]), (1030, 2, [float("inf")] * 5), (1040, 2, [float("nan")] * 5), (None, 1, [1.0] * 5)]
    rows += [(1050, 1, [1.0, 2.0]), (1051, 1, [1.0, 2.5]), (1052, 2, [0.5, 1.0]), (1060, 1, []), (1061, 1, []), (1062, 2, [])]
    want = brute_negatives(rows)
    assert len(want) > 300
    assert mined(spark, rows) == want
    # Groups and blocks of any size give the same rows.
    assert mined(spark, rows, group_rows=7, block_rows=11) == want
    assert mined(spark, rows, positives=2, negatives=3, low=-50, high=100) == brute_negatives(rows, positives=2, negatives=3, low=-50, high=100)
    assert mined(spark, []) == [] == mined(spark, [(1, 1, [1.0])])


def test_hard_negatives_of_large_components(spark):
    big = 2.0**23
    rows = [(0, 1, [big, 1.0]), (1, 1, [big, -1.0]), (2, 2, [big / 2, 3.0]), (3, 2, [big / 2, 3.0 + 1 / 256]), (4, 3, [-big, 0.0])]
    assert mined(spark, rows) == brute_negatives(rows)
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [2.0**40]), (1, 1, [2.0**40])])


def test_lists_end_early_where_bounds_allow():
    """On clustered vectors a walk is certified long before its list ends."""
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(20, 16)) * 300
    v = np.concatenate([c + rng.normal(size=(200, 16)) * 5 for c in centres]).astype(np.int64)
    members = v[:40]
    walk = hard_negatives.Cluster(0, np.arange(40), members, np.stack([np.arange(40), np.zeros(40, int)], 1), [-(1 << 63)] * 40, [(1 << 63) - 1] * 40, 5)
    seen = walk.walk(np.arange(40, 4000), np.arange(40, 4000), v[40:])
    assert seen < 0.4 * 40 * 3960
    slot, score, ids = walk.found
    exact = members @ v[40:].T
    for i in range(40):
        want = sorted((-s, n + 40) for n, s in enumerate(exact[i]))[:5]
        assert [(-s, n) for s, n in zip(score[slot == i].tolist(), ids[slot == i].tolist())] == want


# ---------------------------------------------------------------- fill in the middle


def brute_middle(doc_id, text, seed=7, rate=100, spm=50):
    import hashlib
    import re

    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]
    a, b = sorted(x % (len(lines) + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return (doc_id, len(lines), "plain", None, None, text)
    prefix, middle, suffix = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    spm_form = h[3] % 100 < spm
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm_form else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(lines), "spm" if spm_form else "psm", len(prefix), len(middle), out)


def key(row):
    return [(x is None, x) for x in row]


def test_middle_of_edge_texts(spark):
    texts = [None, "", "\n", "\n\n\n", "a", "no end\nof line", "é漢😀\r\nb\n\nc", "x <P> y\n", "<S", "P>\n<<M\n>", "<\n<M", "word " * 50_000 + "\nend", "\n" * 70_001, "line é\n" * 40_000]
    rows = [(i * 31 + j, t) for j, t in enumerate(texts) for i in range(6)] + [(None, "a\nb\nc"), (5, "a\nb"), (5, "a\nb"), (5, "other\ntext\n")]
    df = spark.createDataFrame([(*r, "plain", "x", 3) for r in rows], "doc_id long, text string, form string, output string, n int")
    for settings in ({}, {"rate": 40, "spm": 90, "seed": 11}):
        out = fill_middle.fill_in_middle(df, **settings)
        assert sorted(map(tuple, out.collect()), key=key) == sorted((brute_middle(*r, **settings) for r in rows), key=key)
        back = fill_middle.restored(out).select("doc_id", "restored").collect()
        assert sorted(map(tuple, back), key=key) == sorted(((i, t or "") for i, t in rows), key=key)
    assert fill_middle.restored(fill_middle.fill_in_middle(df.limit(0))).count() == 0


def test_exchange_in_place():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 7, 1000, 400_000):
        data = rng.integers(0, 256, n).astype(np.uint8)
        lo, cut, hi = sorted(rng.integers(0, n + 1, 3).tolist())
        view = data.copy()
        fill_middle.exchange(view, lo, cut, hi)
        assert (view == np.concatenate([data[:lo], data[cut:hi], data[lo:cut], data[hi:]])).all()
        fill_middle.exchange(view, lo, lo + hi - cut, hi)
        assert (view == data).all()


def test_sentinels_that_could_overlap_are_refused():
    fill_middle.Sentinels("<|fim_prefix|>", "<|fim_suffix|>", "<|fim_middle|>")
    for own in (("<P>", "<P>x", "q"), ("ab", "ba", "c"), ("", "a", "b"), ("aba", "x", "y"), ("x", "x", "y")):
        with pytest.raises(ValueError):
            fill_middle.Sentinels(*own)


def test_other_sentinels(spark):
    marks = fill_middle.Sentinels("[pre]", "[suf]", "[mid]")
    rows = [(i, "one\ntwo <P>\nthree <M> <S>\n" * i) for i in range(20)]
    out = fill_middle.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=marks)
    assert out.where("form = 'plain'").count() == 1
    assert sorted(map(tuple, fill_middle.restored(out, sentinels=marks).select("doc_id", "restored").collect())) == rows
