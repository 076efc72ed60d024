"""Paths resolve like Spark's own, and what cannot be kept fails."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.runs import distinct_logs, parse_runs
from corpusloom.operators.shards import cut_pieces, export_pieces
from corpusloom.operators.tokenizers import vocabulary_table
from corpusloom.session import qualified
from corpusloom.sources.archive import read_log_lines
from corpusloom.sources.manifest import write_manifest
from corpusloom.sources.token_shards import filesystem
from corpusloom.operators import merges, runs
from corpusloom.operators.tokenizers import token_pair_counts
from corpusloom.schema import BOS_ID, BYTE_OFFSET



def test_bare_path_is_on_the_default_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    link = "fs.viewfs.mounttable.elsewhere.link./data"
    conf.set(link, f"file://{tmp_path}")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    try:
        assert qualified(spark, "/data/shards") == "viewfs://elsewhere/data/shards"
        assert qualified(spark, f"file:{tmp_path}/x") == f"file:{tmp_path}/x"
    finally:
        conf.unset(link)
        conf.set("fs.defaultFS", before or "file:///")
    assert qualified(spark, "/data/shards") == "file:/data/shards"


def test_tasks_take_full_uris_only():
    with pytest.raises(ValueError, match="not a full URI"):
        filesystem("/data/shards")
    assert filesystem("file:/data/x")[1] == "/data/x"


def test_token_id_out_of_range_fails(spark):
    stats = spark.createDataFrame([(1, 2), (70_000, 3)], "token_id int, n_bytes int")
    with pytest.raises(Exception, match="token id out of range: 70000"):
        vocabulary_table(stats).collect()
    assert vocabulary_table(stats.limit(1)).count() == 1


def test_null_text_fails_the_export(spark):
    docs = spark.createDataFrame([(0, "a"), (1, None), (2, "b")], "doc_ordinal bigint, text string")
    with pytest.raises(Exception, match="document without text: 1"):
        export_pieces(docs, 0, 10).collect()
    empty = spark.createDataFrame([(0, 0, 0), (1, 0, 3)], "doc_ordinal bigint, offset bigint, n_tokens bigint")
    assert cut_pieces(empty, 10, by=None).count() == 1


def test_every_field_can_be_corrected(spark):
    raw = spark.createDataFrame([("r", "t", json.dumps({"name": "n", "val_bpb": 1.5, "artifact_bytes": 7, "steps": "10070.5"}))], "run_dir string, track string, json string")
    fixes = spark.createDataFrame([("r", "artifact_bytes", "9", "x"), ("r", "author", "me", "x"), ("r", "val_bpb", None, "x")], "run_dir string, field string, value string, reason string")
    row = parse_runs(raw, fixes).first()
    assert (row["artifact_bytes"], row["author"], row["val_bpb"], row["steps"]) == (9, "me", None, 10071)
    with pytest.raises(Exception, match="no such field to correct: seeds"):
        parse_runs(raw, fixes.withColumn("field", F.lit("seeds"))).collect()


def test_copied_log_files_are_found(spark, tmp_path):
    for run in ("a", "b", "c"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "train.log").write_text("first\nsecond\nfirst\n" if run != "c" else "first\nfirst\nsecond\n")
    lines = read_log_lines(spark, f"{tmp_path}/*/*.log")
    assert {(r["run"], r["line_no"], r["line"]) for r in lines.collect()} >= {("a", 0, "first"), ("b", 1, "second"), ("c", 2, "second")}
    assert {(r["run"], r["copies"]) for r in distinct_logs(lines).collect()} == {("a", 2), ("c", 1)}


def test_manifest_keeps_trainer_overrides(spark, tmp_path):
    specs = spark.createDataFrame([("b", {"x": "1"}), ("a", None)], "name string, trainer_overrides map<string,string>")
    some = spark.createDataFrame([("d", "/r/d", "/r/t", "/r/v")], "name string, path string, train_glob string, val_glob string")
    path = str(tmp_path / "m")
    write_manifest(some, spark.createDataFrame([("t", "/r/m")], "name string, path string"), path, root="/r", num_docs=1, num_val_docs=0, shard_size=1, docs_jsonl="/r/docs.jsonl", specs=specs)
    body = json.loads(spark.read.text(path, wholetext=True).first()[0])
    assert [(s["name"], s.get("trainer_overrides")) for s in body["tokenizer_specs"]] == [("a", None), ("b", {"x": "1"})]


def test_board_rows_that_cannot_be_read_are_listed(spark):
    lines = [
        "| Run | Score | Author | Summary | Date | Info |", "|---|---|---|---|---|---|",
        "| a | 1.25 | x | with \\| inside | 2026-03-20 | [info](records/main/a/README.md) |",
        "| b | 1.30 | x | with | inside | 2026-03-20 | [info](records/main/b/README.md) |",
        "| c | n/a 3 | x | y | 2026-03-20 | [info](records/main/c/README.md) |", "text",
    ]
    df = spark.createDataFrame([(line,) for line in lines], "line STRING")
    got = runs.parse_board(df).collect()
    assert [(r["run"], r["summary"], r["run_dir"]) for r in got] == [("a", "with | inside", "a")]
    assert sorted(r["detail"][2] for r in runs.check_board(df).collect()) == ["b", "c"]


def test_symbol_marks_in_a_text_fail(spark):
    df = spark.createDataFrame([(f"a{merges.OPEN}b", 2)], "word STRING, n BIGINT")
    with pytest.raises(Exception, match="noncharacter"):
        merges.alphabet(df).collect()


def test_pairs_are_those_of_a_plain_loop(spark):
    texts = ["", "ab", "aab", "ba"]
    df = spark.createDataFrame([(t,) for t in texts], "text STRING").repartition(2)
    want = {}
    for text in texts:
        ids = [BOS_ID, *(b + BYTE_OFFSET for b in text.encode())]
        for pair in zip([None, *ids], ids):
            want[pair] = want.get(pair, 0) + 1
    assert {(r["prev"], r["token"]): r["n"] for r in token_pair_counts(df).collect()} == want
