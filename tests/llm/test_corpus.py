"""The queries of the subpackage on the given tables, and the pipeline stage by stage."""

from __future__ import annotations

import hashlib

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from helpers import DOCS, docs_of, empty_docs, odd_docs
from pyspark.sql import functions as F
from test_native import dedup_twin

NAMES = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]


def test_all_operators_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES if n != "pipeline") == list(range(1, 14)) and "pipeline" in NAMES
    assert {"op4_line_bitmaps", "op5_seekable_warc", "op12_extendible_hash", "op13_edit_lattice"} <= set(entry.oracle_sql())


def test_stages_keep_columns_and_decide(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    start = docs.count()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}

    clean = corpus_pipeline.toxicity_stage(spark, docs, sf).cache()
    assert clean.columns == columns and 0.6 * start < clean.count() < start
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in clean.collect()}
    assert sum(labels.get(i) == 1 for i in gone) > 0

    lines = corpus_pipeline.line_dedup_stage(spark, clean, sf).cache()
    twin = dedup_twin([(r["doc_id"], r["text"]) for r in clean.collect()])
    assert lines.columns == columns and sorted((r["doc_id"], r["text"]) for r in lines.collect()) == [(i, t) for i, _, _, t in twin]
    assert lines.where(F.col("n_chars") != F.length("text")).count() == 0

    single = corpus_pipeline.near_duplicate_stage(spark, lines, sf).cache()
    texts = [" ".join((r["text"] or "").lower().split()) for r in single.collect()]
    assert single.columns == columns and len(texts) == len(set(texts)) < lines.count()

    pure = corpus_pipeline.decontamination_stage(spark, single, sf).cache()
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = [r["text"] or "" for r in pure.collect()]
    assert pure.columns == columns and not any(i in t for i in items for t in kept)

    rows = {r["doc_id"]: r for r in corpus_pipeline.token_stage(spark, pure, sf).collect()}
    for r in pure.collect():
        assert rows[r["doc_id"]]["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
        assert rows[r["doc_id"]]["n_tokens"] == len(rows[r["doc_id"]]["ids"])


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages_on_odd_and_empty_tables(spark, k):
    sf = "/root/testdata/sf0.001"
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (odd_docs(spark), empty_docs(spark)):
        out = stage(spark, docs, sf)
        rows = out.collect()
        assert len(rows) <= docs.count()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
            if name == "line dedup":
                assert len(rows) == docs.count()


def test_stages_with_null_and_reused_ids(spark, tmp_path):
    """No unrelated text is lost with an id that is used twice, and rows without an id are judged by their texts."""
    a, b, item = (" ".join(f"{w}{k}" for k in range(40)) for w in ("alpha", "beta", "item"))
    docs = spark.createDataFrame([
        (5, a, "en", "s", 1), (5, b, "en", "s", 1), (6, a, "en", "s", 1), (None, a + " and", "en", "s", 1), (None, f"so {item} it is", "en", "s", 1),
        (None, "a clean text without an id", "en", "s", 1), (9, None, "en", "s", 1), (9, None, "en", "s", 1),
    ], DOCS)
    single = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    want = [(5, a), (5, b), (9, None), (None, "a clean text without an id"), (None, f"so {item} it is")]
    pick = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    assert pick(single) == want
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pick(corpus_pipeline.decontamination_stage(spark, single, str(tmp_path))) == want[:4]


def test_a_reused_id_counts_once_among_a_lines_documents(spark):
    line = "a line of more than forty characters that several documents hold"
    for extra in ("", "x", "yy", "zzz"):
        four = [(1, line), (1, f"{line}\n{extra} of the same id"), (2, line), (3, line), (4, line + "\nmore" + extra)]
        for rows, gone in ((four, 0), (four + [(9, line)], 5)):
            out = corpus_pipeline.line_dedup_stage(spark, docs_of(spark, rows), "").collect()
            assert sum(line not in (r["text"] or "") for r in out) == gone
            assert sorted((r["doc_id"], r["text"]) for r in out) == sorted((i, t) for i, _, _, t in dedup_twin(rows))
