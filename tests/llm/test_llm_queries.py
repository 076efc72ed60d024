"""Registered queries against their DuckDB forms, and the pipeline against its parts."""

import re

import pytest
from harness import connect, difference
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
import corpus_pipeline
from corpusloom.llm.queries import ORACLE, QUERIES, vocabulary
from llm_loops import jaccard_loop

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_names():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_point.queries())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, name):
    assert difference(QUERIES[name](spark, sf), connect(sf), ORACLE[name]) is None


CONTRACT = {
    "op2_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op3_byte_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op5_sentence_spans": {"doc_id": "bigint", "n_removed": "bigint"},
    "op6_toxicity": {"doc_id": "bigint", "toxic": "boolean"},
    "op7_html_paths": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op9_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
}


@pytest.mark.parametrize("name", sorted(CONTRACT))
def test_whole_table_and_columns(spark, sf, name):
    out = QUERIES[name](spark, sf)
    assert CONTRACT[name].items() <= dict(out.dtypes).items()
    table = "pages" if name.startswith("op7") else "documents"
    assert out.count() == spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    known = corpus_pipeline.identify_language(spark, docs, sf)
    assert known.columns == DOCUMENTS and known.count() == docs.filter(F.col("text").rlike(r"\p{L}")).count()
    one = corpus_pipeline.remove_near_duplicates(spark, known, sf)
    want = jaccard_loop([(r["doc_id"], r["text"]) for r in known.select("doc_id", "text").collect()])
    assert sorted(r[0] for r in one.select("doc_id").collect()) == want
    clean = corpus_pipeline.mask_secrets(spark, one, sf)
    assert clean.columns == DOCUMENTS and clean.count() == one.count()
    assert clean.filter("n_chars <> char_length(text)").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, clean, sf)
    assert mixed.columns == DOCUMENTS
    tokens = corpus_pipeline.encode_tokens(spark, mixed, sf)
    import tiktoken

    ranks, pattern = vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r["doc_id"], library.encode_ordinary(r["text"])) for r in mixed.collect())
    assert sorted((r["doc_id"], r["ids"]) for r in tokens.collect()) == want


def test_pipeline_runs_whole(spark, sf):
    got = corpus_pipeline.run(spark, sf)
    assert got.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "secret_scan", "mixing", "byte_bpe"]


def test_pipeline_stages_on_edges(spark, edges, sf):
    docs = edges
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == edges.columns
    assert {r["doc_id"] for r in corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()} <= {None, 4, 5, 6}
    docs = edges.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0
