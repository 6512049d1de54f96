"""The pipeline against its stages' brute-force versions."""

import os
import subprocess
import sys

import corpus_pipeline
import pyarrow as pa
import pytest
from larkspan.llm import pieces
from larkspan.llm.queries import MODEL
from pyspark.sql import functions as F
from test_text_operators import DOCS, brute_components, brute_spans, edge_docs, empty_docs


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """Rows of each stage, written and read as the pipeline's driver does."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stage_columns_and_decisions(spark, sf, stages):
    documents, good, single, decontaminated, masked, coded = stages
    assert all(s.columns == documents.columns for s in stages[1:-1])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id for r in good.collect()}
    assert all(i in kept for i, y in labels.items() if y) and sum(i in kept for i, y in labels.items() if not y) <= 2
    rows = [(r.doc_id, r.text) for r in good.collect()]
    assert sorted(r.doc_id for r in single.collect()) == sorted({c for _, _, c in brute_components(rows)})
    items = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    before = {r.doc_id: r.text for r in single.collect()}
    after = {r.doc_id for r in decontaminated.collect()}
    leaked = {i for i, t in before.items() if any(x in t for x in items)}
    assert not leaked & after and len(set(before) - leaked - after) <= 1
    assert {r.doc_id for r in masked.collect()} == after
    assert all(not brute_spans(r.text) and r.n_chars == len(r.text) for r in masked.collect())
    codec = pieces.Codec(pieces.read_model(MODEL))
    texts = {r.doc_id: r.text for r in masked.collect()}
    assert {r.doc_id: list(r.ids) for r in coded.collect()} == {i: x.tolist() for i, x in zip(texts, codec.encode(list(texts.values())))}


def test_run_gives_the_last_stage(spark, sf, stages):
    assert sorted((r.doc_id, r.n_tokens) for r in corpus_pipeline.run(spark, sf).collect()) == sorted((r.doc_id, r.n_tokens) for r in stages[-1].collect())


def test_stages_bear_edges(spark, sf):
    for docs in (edge_docs(spark), empty_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.count() <= docs.count(), name
    left = corpus_pipeline.near_duplicate_stage(spark, edge_docs(spark), sf)
    assert left.schema == spark.createDataFrame([], DOCS).schema
    # One of the cat rows, one of the two-word rows, and every row without words.
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in left.collect()) == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 6), (False, 8), (False, 9), (True, 0)]


def test_near_duplicates_bear_other_file_splits(spark, sf, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs.repartition(6, "doc_id").write.parquet(str(tmp_path / "docs"))
    settings = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    found = corpus_pipeline.jaccard_components

    def then_split_otherwise(*args):
        out = found(*args)
        for k, v in settings.items():
            spark.conf.set(k, v)
        return out

    monkeypatch.setattr(corpus_pipeline, "jaccard_components", then_split_otherwise)
    try:
        left = corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(str(tmp_path / "docs")), sf)
        kept = sorted(r.doc_id for r in left.collect())
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert kept == sorted({c for _, _, c in brute_components([(r.doc_id, r.text) for r in docs.collect()])})


def test_stages_keep_columns_of_any_name(spark, sf):
    """Extra columns named like the stages' own ones come back untouched."""
    names = ["row", "row_", "score", "found", "id", "at", "component_id", "none", "first", "_row", "_score", "_found"]
    docs = edge_docs(spark).select("doc_id", "text", *[F.lit(f"kept {n}").alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"kept {n}" for r in rows for n in names), name


def test_near_duplicates_store_no_text_again(spark, sf, monkeypatch):
    """The rows' texts were stored once more under row numbers, and all of them shuffled to the numbers that stay."""
    held = []
    store = corpus_pipeline.Scratch.store
    monkeypatch.setattr(corpus_pipeline.Scratch, "store", lambda self, df, name="table": held.append(df.columns) or store(self, df, name))
    corpus_pipeline.near_duplicate_stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf).count()
    assert held and not any("text" in columns for columns in held)


@pytest.mark.parametrize("others", [0, 40])
def test_near_duplicates_of_equal_rows(spark, sf, others):
    """Rows equal in all values leave one, rows without words all; whether most rows go or most stay."""
    copies = [(7, "one two three four five six", "a", None)] * 5 + [(None, "some words of no id at all", None, "a")] * 4
    copies += [(8, "one two three four five six", "a", None), (7, "one two three four five six", None, "a"), (1, None, "a", None), (1, None, "a", None), (None, " ", None, None), (None, " ", None, None)]
    docs = spark.createDataFrame(copies + [(100 + i, f"text {i} of its own {i}", "b", None) for i in range(others)], "doc_id long, text string, lang string, source string").coalesce(1)
    left = [tuple(r) for r in corpus_pipeline.near_duplicate_stage(spark, docs, sf).collect()]
    assert sorted(map(str, (r for r in left if r[2] != "b"))) == sorted(map(str, [copies[0], copies[5], *copies[-4:]]))
    assert sum(r[2] == "b" for r in left) == others


def test_long_texts_go_to_python_in_small_batches(spark):
    """3,000 texts of 4 KB were one batch of 12 MB."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    docs = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 4096).alias("text"))
    assert docs.mapInArrow(sizes, "n long").agg(F.max("n")).first()[0] < 6_000_000


def test_workers_give_memory_back(spark, sf, monkeypatch):
    used, frame = [], type(spark.range(1))
    plain = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, func, *rest: used.append(func) or plain(self, func, *rest))
    corpus_pipeline.run(spark, sf)
    assert len(used) >= 6 and {f.__qualname__ for f in used} == {"tidy.<locals>.tidied"}


def test_tidy_tasks_leave_little_behind():
    """Memory that a worker holds after a task over some MB of texts, as it was and tidied."""
    code = """
import re, sys, numpy as np, pyarrow as pa
from larkspan.llm import pieces, workers
from larkspan.llm.jaccard_join import _sketch
held = lambda: int(re.search(r"Anonymous:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10
rng = np.random.default_rng(3)
def batches():
    for i in range(8):
        yield pa.RecordBatch.from_arrays([pa.array(range(1250)), pa.array([" ".join(map(str, rng.integers(0, 100000, 500))) for _ in range(1250)])], ["doc_id", "text"])
workers.release()
before = held()
run = _sketch(5)
for out in (workers.tidy(run) if sys.argv[1] == "tidy" else run)(batches()):
    pass
del out
print(held() - before)
"""
    left = {how: int(subprocess.run([sys.executable, "-c", code, how], env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}, capture_output=True, text=True, check=True).stdout) for how in ("plain", "tidy")}
    assert left["tidy"] < 50 and left["tidy"] < left["plain"] / 2, left


def test_memo_size_changes_no_ids():
    model = pieces.read_model(MODEL)
    small, large = pieces.Codec(model, 1 << 12), pieces.Codec(model)
    texts = [f"word{i} again{i % 7} and the same" for i in range(500)]
    for at in range(0, 500, 50):
        assert [x.tolist() for x in small.encode(texts[at : at + 50])] == [x.tolist() for x in large.encode(texts[at : at + 50])]
    assert len(small.memo) + len(small.before) < len(large.memo) / 2
