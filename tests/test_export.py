"""The export job: documents and specs to shards, statistics and manifest."""

import json
import os

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import export
from corpusloom.operators.export import export_corpus
from corpusloom.operators.tokenizers import Tokenizer, register_tokenizer
from corpusloom.sources.docs import read_docs, read_sidecar
from corpusloom.sources.manifest import parse_specs, read_manifest
from corpusloom.sources.token_shards import read_shards

TEXTS = ["a" * 9, "b" * 25, "", "ccc", "d" * 9, "eéé "]


@pytest.fixture
def inputs(spark, tmp_path):
    register_tokenizer("sp_bpe_300", lambda: Tokenizer("letters", "sentencepiece_bpe", "sp300", 300, 1, 2, encode_batch=lambda texts: [[5 + ord(c) % 200 for c in t] for t in texts]))
    (tmp_path / "docs.jsonl").write_text("".join(json.dumps({"text": t}) + "\n" for t in TEXTS))
    specs = [{"kind": "byte", "own": {"k": [1, "1"]}}, {"vocab_size": 300, "trainer_overrides": {"x": 1}}]
    return read_docs(spark, f"{tmp_path}/docs.jsonl"), parse_specs(spark.createDataFrame([(json.dumps(specs),)], "value STRING"))


def body_of(root):
    return json.load(open(f"{root}/manifest.json"))


def tokens_of(spark, root, name, split):
    path = next(d["path"] for d in body_of(root)["datasets"] if d["name"] == name)
    rows = read_shards(spark, f"{root}/{path}").filter(F.col("split") == split).orderBy("shard_id", "block_offset").collect()
    return [t for r in rows for t in r["tokens"]]


def test_documents_to_manifest(spark, inputs, tmp_path):
    docs, specs = inputs
    root = str(tmp_path / "out")
    (tmp_path / "side.json").write_text(json.dumps({"num_docs": 6, "docs_val": 2, "shuffle_seed": 9, "docs_sha256": "ff", "more": {"a": 1.5}}))
    side = read_sidecar(spark, f"{tmp_path}/side.json")
    assert export_corpus(docs, specs, root, shard_size=10, sidecar=side, sidecar_path=f"{tmp_path}/side.json", repo_id="r", docs_jsonl="d.jsonl").endswith("/manifest.json")
    body = body_of(root)
    assert (body["num_docs"], body["num_val_docs"], body["shuffle_seed"], body["docs_meta"]["source_sidecar"]["more"]) == (6, 2, 9, {"a": 1.5})
    assert {json.dumps(s, sort_keys=True) for s in body["tokenizer_specs"]} == {json.dumps(s, sort_keys=True) for s in ({"kind": "byte", "own": {"k": [1, "1"]}}, {"vocab_size": 300, "trainer_overrides": {"x": 1}})}
    byte = next(d for d in body["datasets"] if d["tokenizer_kind"] == "byte")
    assert byte["stats"] == {
        "docs_total": 6, "docs_val": 2, "docs_train": 4, "files_total": 7, "files_val": 4, "files_train": 3, "tokens_total": 58, "tokens_val": 36, "tokens_train": 22,
    } and byte["recommended_bigram_vocab_size"] == 1920
    for split, texts in (("val", TEXTS[:2]), ("train", TEXTS[2:])):
        assert tokens_of(spark, root, byte["name"], split) == [t for x in texts for t in [1] + [b + 4 for b in x.encode()]]
        assert tokens_of(spark, root, "fineweb10B_sp300", split) == [t for x in texts for t in [1] + [5 + ord(c) % 200 for c in x]]
    assert len([f for f in os.listdir(f"{root}/{byte['path']}") if f.startswith("fineweb_val_")]) == 4
    datasets, tokenizers = read_manifest(spark, f"{root}/manifest.json")
    assert datasets.count() == 2 and {r["name"] for r in tokenizers.collect()} == {"pure_byte_260", "sp_bpe_300"}


def test_a_job_that_dies_leaves_the_export_as_it_was(spark, inputs, tmp_path, monkeypatch):
    docs, specs = inputs
    root = str(tmp_path / "out")
    export_corpus(docs, specs, root, num_val_docs=2, shard_size=10, skip_byte=True)
    before = body_of(root)
    tokens = tokens_of(spark, root, "fineweb10B_sp300", "train")

    def dies(*_):
        raise RuntimeError("killed before the manifest")

    with monkeypatch.context() as m:
        m.setattr(export, "_commit", dies)
        with pytest.raises(RuntimeError, match="killed"):
            export_corpus(docs.limit(0), specs, root, num_val_docs=0, shard_size=5, skip_byte=True)
    assert body_of(root) == before and tokens_of(spark, root, "fineweb10B_sp300", "train") == tokens
    for n in (3, 4):
        export_corpus(docs, specs, root, num_val_docs=n, shard_size=10, skip_byte=True)
    assert body_of(root)["num_val_docs"] == 4
    # The first export is gone, the replaced one stays for readers that have begun.
    assert not os.path.exists(f"{root}/{before['datasets'][0]['path']}")
    assert len(tokens_of(spark, root, "fineweb10B_sp300", "val")) == sum(len(t) + 1 for t in TEXTS[:4])


def test_refused_exports(spark, inputs, tmp_path):
    docs, specs = inputs
    root = str(tmp_path / "out")
    side = spark.createDataFrame([(9, 1, None, None)], "num_docs BIGINT, docs_val BIGINT, shuffle_seed BIGINT, docs_sha256 STRING")
    with pytest.raises(ValueError, match="expected 9 docs, exported 6"):
        export_corpus(docs, specs, root, sidecar=side, shard_size=10, skip_byte=True)
    with pytest.raises(ValueError, match="cannot take 7 validation documents"):
        export_corpus(docs, specs, root, num_val_docs=7)
    with pytest.raises(ValueError, match="duplicate"):
        export_corpus(docs, specs.unionByName(specs), root, num_val_docs=1)
    with pytest.raises(KeyError, match="no tokenizer registered"):
        export_corpus(docs, parse_specs(spark.createDataFrame([('[{"vocab_size": 999}]',)], "value STRING")), root, num_val_docs=1)
    assert not os.path.exists(f"{root}/manifest.json")
