import json

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import udtf
from corpusloom.operators.checks import check_unique
from corpusloom.operators.tokenizers import parse_reuse, resolve_specs
from corpusloom.operators.catalog import check_catalog, missing_shards, select_shards
from corpusloom.sources.archive import check_results, read_board, read_log_facts, read_log_points, read_results, read_runs
from corpusloom.sources.docs import read_docs, read_sidecar, resolve_counts
from corpusloom.sources.manifest import (
    manifest_document,
    read_manifest,
    read_specs,
    write_byte_tokenizer,
    write_manifest,
    write_specs,
)


def test_lines_keep_their_order_over_files_and_splits(spark, tmp_path):
    texts = [f"line {i} é" * (i % 7 + 1) for i in range(3000)]
    for k, (a, b) in enumerate([(0, 1200), (1200, 1201), (1201, 3000)]):
        body = "".join(json.dumps({"id": i, "text": texts[i]}, ensure_ascii=i % 2 == 0) + "\n" for i in range(a, b))
        (tmp_path / f"part-{k}.jsonl").write_text(body, encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        docs = read_docs(spark, f"{tmp_path}/*.jsonl")
        assert docs.rdd.getNumPartitions() > 5
        got = docs.orderBy("doc_ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["doc_ordinal"], r["text"]) for r in got] == list(enumerate(texts))


def test_odd_texts(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"text": ""}\n{"text": "\\ud800x", "k": 1}\n{"text": "a\\u0000b\\n"}\n')
    assert [r["text"] for r in read_docs(spark, f"{tmp_path}/d.jsonl").orderBy("doc_ordinal").collect()] == ["", "?x", "a\0b\n"]


@pytest.mark.parametrize("line", ['{"body": "x"}', "not json", "[]"])
def test_line_without_text_fails(spark, tmp_path, line):
    (tmp_path / "d.jsonl").write_text('{"text": "ok"}\n' + line + "\n")
    with pytest.raises(Exception, match="line without text at ordinal 1"):
        read_docs(spark, f"{tmp_path}/d.jsonl").collect()


def test_sidecar(spark, tmp_path):
    docs = spark.createDataFrame([(i, "x") for i in range(5)], "doc_ordinal BIGINT, text STRING")
    absent = read_sidecar(spark, f"{tmp_path}/none.json")
    assert resolve_counts(docs, absent, 2) == (5, 2)
    with pytest.raises(ValueError, match="50000 validation documents of 5"):
        resolve_counts(docs, absent)
    (tmp_path / "s.json").write_text('{\n "num_docs": 9, "docs_val": 3, "docs_sha256": "ab"\n}')
    side = read_sidecar(spark, f"{tmp_path}/s.json")
    assert resolve_counts(docs, side) == (9, 3) and side.first()["shuffle_seed"] is None
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(Exception, match="sidecar is not an object"):
        read_sidecar(spark, f"{tmp_path}/l.json").collect()


@pytest.mark.parametrize("shape", ["list", "tokenizers", "tokenizer_specs"])
def test_specs(spark, tmp_path, shape):
    specs = [{"name": "a", "vocab_size": 1024, "trainer_overrides": {"x": "1"}}, {"kind": "byte"}]
    body = specs if shape == "list" else {shape: specs}
    (tmp_path / "c.json").write_text(json.dumps(body))
    got = read_specs(spark, f"{tmp_path}/c.json")
    rows = got.collect()
    assert [(r["name"], r["kind"], r["vocab_size"], r["trainer_overrides"]) for r in rows] == [("a", None, 1024, {"x": "1"}), (None, "byte", None, None)]
    write_specs(got, f"{tmp_path}/out")
    again = read_specs(spark, f"{tmp_path}/out")
    known = [c for c in got.columns if c != "raw"]
    assert again.select(*known).collect() == got.select(*known).collect()


def test_specs_keep_foreign_keys_and_types(spark, tmp_path):
    spec = {"name": "a", "vocab_size": 1024, "trainer_overrides": {"x": 1, "y": 0.5, "z": [True, None, "s"]}, "own": {"b": [1, "1"]}, "recommended_bigram_vocab_size": 777}
    (tmp_path / "c.json").write_text(json.dumps([spec, {"kind": "byte", "note": None}]))
    got = read_specs(spark, f"{tmp_path}/c.json")
    write_specs(got, f"{tmp_path}/out")
    body = json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/out").collect()))
    assert body["tokenizers"] == [spec, {"kind": "byte", "note": None}]
    assert got.filter("name = 'a'").select(F.variant_get("raw", "$.trainer_overrides.x", "int")).first()[0] == 1
    sizes = {r["name"]: r["recommended_bigram_vocab_size"] for r in resolve_specs(got).collect()}
    assert sizes == {"a": 777, "pure_byte_260": 1920}


def test_sidecar_keeps_foreign_keys(spark, tmp_path):
    side = {"num_docs": 5, "docs_val": 1, "shuffle_seed": 7, "docs_sha256": "ab", "maker": {"name": "x", "n": [1, 2.5]}}
    (tmp_path / "s.json").write_text(json.dumps(side))
    sidecar = read_sidecar(spark, f"{tmp_path}/s.json")
    assert sidecar.select("num_docs", "docs_val").first() == (5, 1)
    datasets, tokenizers = _catalog(spark)
    write_manifest(
        datasets, tokenizers, f"{tmp_path}/m", root="/root/x", num_docs=5, num_val_docs=1, shard_size=10, docs_jsonl="/root/x/docs.jsonl",
        sidecar=sidecar, sidecar_path="/root/x/s.json", repo_id="who/what", remote_root="sub",
    )
    body = json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/m").collect()))
    assert body["docs_meta"] == {"remote_repo_id": "who/what", "remote_root": "sub", "num_docs": 5, "docs_sha256": "ab", "source_manifest": "s.json", "source_sidecar": side}
    assert body["shuffle_seed"] == 7
    whole = manifest_document(spark.read.text(f"{tmp_path}/m")).select(F.variant_get("manifest", "$.docs_meta.source_sidecar.maker.n[1]", "double")).first()[0]
    assert whole == 2.5


@pytest.mark.parametrize("body, message", [("[]", "non-empty list"), ("{}", "non-empty list"), ("[1]", "is not an object")])
def test_bad_specs(spark, tmp_path, body, message):
    (tmp_path / "c.json").write_text(body)
    with pytest.raises(Exception, match=message):
        read_specs(spark, f"{tmp_path}/c.json").collect()


def _catalog(spark):
    stats = "named_struct('docs_total', 5L, 'docs_val', 1L, 'docs_train', 4L, 'files_total', 4L, 'files_val', 1L, 'files_train', 3L, 'tokens_total', 40L, 'tokens_val', 5L, 'tokens_train', 35L)"
    datasets = spark.sql(f"""SELECT 'ds' AS name, 'tok' AS tokenizer_name, 'byte' AS tokenizer_kind, '/root/x/datasets/ds' AS path,
        '/root/x/datasets/ds/t_*.bin' AS train_glob, '/elsewhere/v_*.bin' AS val_glob, 260L AS vocab_size, 1L AS bos_id, 2L AS eos_id,
        1920L AS recommended_bigram_vocab_size, {stats} AS stats""")
    tokenizers = spark.sql("""SELECT 'tok' AS name, 'byte' AS kind, 260L AS vocab_size, 1L AS bos_id, 2L AS eos_id, 1920L AS recommended_bigram_vocab_size,
        '{}' AS source_spec, '/root/x/tokenizers/b.json' AS path, CAST(NULL AS STRING) AS model_path, CAST(NULL AS STRING) AS vocab_path, 0L AS pad_id, 3L AS unk_id""")
    return datasets, tokenizers


def test_manifest_round_trip(spark, tmp_path):
    datasets, tokenizers = _catalog(spark)
    write_manifest(
        datasets, tokenizers, f"{tmp_path}/m", root="/root/x", num_docs=5, num_val_docs=1, shard_size=10, docs_jsonl="/root/x/docs.jsonl"
    )
    got, toks = read_manifest(spark, f"{tmp_path}/m")
    row = got.first()
    assert (row["path"], row["train_glob"], row["val_glob"]) == ("datasets/ds", "datasets/ds/t_*.bin", "/elsewhere/v_*.bin")
    assert row["stats"]["files_train"] == 3 and toks.first()["path"] == "tokenizers/b.json"
    body = json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/m").collect()))
    assert body["version"] == "10B" and body["append_eos"] is False and body["shuffle_seed"] is None and body["docs_jsonl"] == "docs.jsonl"


def test_byte_tokenizer_description(spark, tmp_path):
    write_byte_tokenizer(spark, f"{tmp_path}/t")
    body = json.loads("".join(r["value"] for r in spark.read.text(f"{tmp_path}/t").collect()))
    assert body["tokenizer_type"] == "pure_byte" and body["vocab_size"] == 260
    assert body["config"] == {"pad_id": 0, "bos_id": 1, "eos_id": 2, "unk_id": 3, "byte_offset": 4, "byte_count": 256}


def test_reuse_list(spark):
    reuse = parse_reuse(spark.createDataFrame([("1024=/m/a=b.model",), ("4096=x",), ("1024=y",)], "value STRING"))
    assert [tuple(r) for r in reuse.collect()] == [(1024, "/m/a=b.model"), (4096, "x"), (1024, "y")]
    assert check_unique(reuse, ["vocab_size"]).first()["detail"] == "1024"


def test_selection_and_catalog_checks(spark):
    datasets, tokenizers = _catalog(spark)
    got = sorted((r["split"], r["shard_id"]) for r in select_shards(datasets, 2).collect())
    assert got == [("train", 0), ("train", 1), ("val", 0)]
    with pytest.raises(ValueError):
        select_shards(datasets, -1)
    with pytest.raises(Exception, match="too few training shards"):
        select_shards(datasets, 4).collect()
    files = lambda n, tok: spark.createDataFrame([("ds", "train", n, tok)], "dataset STRING, split STRING, n_files BIGINT, tokenizer_file STRING")
    assert check_catalog(datasets, tokenizers, files(2, "y/b.json")).count() == 0
    assert {r["rule"] for r in check_catalog(datasets, tokenizers, files(4, "y/c.json")).collect()} == {"surplus_shards", "tokenizer_file"}
    assert check_catalog(datasets, tokenizers.limit(0), files(1, "b.json")).first()["rule"] == "unknown_tokenizer"
    present = spark.createDataFrame([("ds", "val", 0), ("ds", "train", 7)], "name STRING, split STRING, shard_id BIGINT")
    states = sorted((r["state"], r["split"], r["shard_id"]) for r in missing_shards(select_shards(datasets, 1), present).collect())
    assert states == [("missing", "train", 0), ("unexpected", "train", 7)]


LOG = """
seed:1337
train_batch_tokens:524288 train_seq_len:2048 iterations:20000
warmup_step:1/20
step:0/20000 val_loss:6.9357 val_bpb:4.1077 train_time:0ms step_avg:0.02ms
step:1/20000 train_loss:6.9370 train_time:27ms step_avg:27.23ms
step:11564/20000 val_loss:2.0269 val_bpb:1.2005 train_time:600038ms step_avg:51.89ms
stopping_early: wallclock_cap train_time:600038ms step:11564/20000
peak memory allocated: 10247 MiB reserved: 10488 MiB
Serialized model: 67224983 bytes
Code size: 47716 bytes
Serialized model int8+zlib: 15819554 bytes (payload:17178912 raw_torch:17224025 payload_ratio:3.91x)
final_int8_zlib_roundtrip val_loss:2.0359 val_bpb:1.2058 eval_time:1639ms
final_int8_zlib_roundtrip_exact val_loss:2.03588345 val_bpb:1.20576485
  sliding_eval [ 84.6%] 102432/121136 windows running_bpb=1.153384
final_int6_sliding_window val_loss:1.8972 val_bpb:1.1236 stride:64 eval_time:73133ms
some warning: step:12 is odd
"""


def test_log_grammar(spark, tmp_path):
    (tmp_path / "run_a").mkdir()
    (tmp_path / "run_a" / "train.log").write_text(LOG)
    points = read_log_points(spark, f"{tmp_path}/*/*.log").orderBy("step", "kind").collect()
    assert [(r["run"], r["step"], r["kind"], r["loss"], r["bpb"], r["train_time_ms"], r["step_avg_ms"]) for r in points] == [
        ("run_a", 0, "val", 6.9357, 4.1077, 0, 0.02),
        ("run_a", 1, "train", 6.937, None, 27, 27.23),
        ("run_a", 11564, "val", 2.0269, 1.2005, 600038, 51.89),
    ]
    facts = {r["key"]: r["value"] for r in read_log_facts(spark, f"{tmp_path}/*/*.log").collect()}
    want = {
        "seed": "1337", "train_seq_len": "2048", "warmup_step": "1/20", "stop_reason": "wallclock_cap", "stop_step": "11564",
        "peak_mib": "10247", "model_bytes": "67224983", "code_bytes": "47716", "model_bytes.int8+zlib": "15819554",
        "model_bytes.int8+zlib.payload": "17178912", "model_bytes.int8+zlib.ratio": "3.91",
        "final_int8_zlib_roundtrip_exact.val_bpb": "1.20576485", "final_int8_zlib_roundtrip.eval_time_ms": "1639",
        "final_int6_sliding_window.stride": "64", "progress_bpb": "1.153384", "progress_windows": "121136",
    }
    assert {k: facts.get(k) for k in want} == want


def test_run_shapes(spark, tmp_path):
    shapes = {
        "plain": {"name": "n", "author": "a", "date": "2026-03-18T14:56:29Z", "val_loss": 2.07, "val_bpb": 1.22, "bytes_total": 15863489, "bytes_code": 47642},
        "seeds": {"date": "2026-03-19", "seed_results": {"7": {"val_bpb": 1.17, "steps": 10498}, "42": {"val_bpb": 1.18}}, "mean_val_bpb": 1.175, "artifact_bytes": 15374243},
        "flat": {"run_name": "r", "val_bpb": "<1.5", "seeds": [1, 2, 3], "train_steps_mean": 10070, "artifact_bytes_mean": 5},
        "null": {"val_loss": None, "val_bpb": 1.32, "step_stop": 3773, "wallclock_seconds": 600, "bytes_code": None},
        "misplaced": {"val_loss": 1.14276, "date": "bad date"},
    }
    for name, body in shapes.items():
        (tmp_path / "t" / name).mkdir(parents=True)
        (tmp_path / "t" / name / "submission.json").write_text(json.dumps(body, indent=1))
    fixes = spark.createDataFrame(
        [("misplaced", "val_bpb", 1.14276, "bpb in loss field"), ("misplaced", "val_loss", None, "bpb in loss field")],
        "run_dir STRING, field STRING, value DOUBLE, reason STRING",
    )
    got = {r["run_dir"]: r for r in read_runs(spark, f"{tmp_path}/t/*/submission.json", fixes).collect()}
    assert got["plain"]["artifact_bytes"] == 15863489 and got["plain"]["ts"].isoformat() == "2026-03-18T14:56:29"
    assert got["seeds"]["val_bpb"] == 1.175 and got["seeds"]["ts"].isoformat() == "2026-03-19T00:00:00" and got["seeds"]["track"] == "t"
    assert got["flat"]["val_bpb"] == 1.5 and got["flat"]["seeds"] == [1, 2, 3] and got["flat"]["steps"] == 10070 and got["flat"]["name"] == "r"
    assert got["null"]["val_loss"] is None and got["null"]["steps"] == 3773 and got["null"]["wallclock_s"] == 600.0
    assert got["misplaced"]["val_loss"] is None and got["misplaced"]["val_bpb"] == 1.14276 and got["misplaced"]["ts"] is None


def test_results_and_board(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("val_bpb\tartifact_bytes\tmemory_mb\tnotes\n1.36330099\t12265862\t10255\tbaseline\n1.35919834\t15102915\t11552\tReLU²\n")
    rows = read_results(spark, f"{tmp_path}/r.tsv").collect()
    assert rows[1]["notes"] == "ReLU²" and rows[0]["artifact_bytes"] == 12265862
    (tmp_path / "b.md").write_text("# Title\n| Run | Score | Author | Summary | Date | Info |\n|---|---:|---|---|---|---|\n| A+B | 1.1228 | me | x, y | 2026-03-22 | [info](records/t/dir_1/README.md) |\n| 4k seq| 1.2 | me | z | 2026-03-19 | [i](a/b/c.md) |\n")
    board = read_board(spark, f"{tmp_path}/b.md").orderBy("score").collect()
    assert [(r["run"], r["score"], str(r["date"]), r["run_dir"]) for r in board] == [("A+B", 1.1228, "2026-03-22", "dir_1"), ("4k seq", 1.2, "2026-03-19", "b")]


def test_table_functions(spark):
    udtf.register(spark)
    assert [tuple(r) for r in spark.sql("SELECT * FROM micro_chunks(1000, 64, 500)").collect()] == [(0, 448), (1, 448), (2, 64)]
    assert [tuple(r) for r in spark.sql("SELECT * FROM windows(5, 4, 2)").collect()] == [(0, 4, 0), (2, 3, 1), (4, 1, 0)]
    rows = spark.sql("SELECT d, p.* FROM VALUES (0, 8L, 5L), (1, 13L, 30L) AS t(d, o, n), LATERAL shard_pieces(o, n, 10L) AS p").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 8, 0, 2), (0, 1, 0, 2, 3), (1, 1, 3, 0, 7), (1, 2, 0, 7, 10), (1, 3, 0, 17, 10), (1, 4, 0, 27, 3)]


@pytest.mark.parametrize("policy", ["all_starts", "full_only", "full_first", "jump", "exact_once"])
def test_window_functions_equal_the_plans(spark, policy):
    from corpusloom.operators.sequences import windows

    udtf.register(spark)
    spark.createDataFrame([("a", 5), ("b", 31), ("c", 0), ("d", 8)], "name STRING, total BIGINT").createOrReplaceTempView("pairs_of")
    got = spark.sql(f"SELECT * FROM windows_of(TABLE(pairs_of), 8, 3, '{policy}')").collect()
    for name, total in (("a", 5), ("b", 31), ("d", 8)):
        want = sorted(tuple(r) for r in windows(spark, total, 8, 3, policy).collect())
        assert sorted(tuple(r)[2:] for r in got if r["name"] == name) == want
        assert sorted(tuple(r) for r in spark.sql(f"SELECT * FROM windows({total}L, 8, 3, '{policy}')").collect()) == [w[1:] for w in want]


@pytest.mark.parametrize("policy", ["all_starts", "full_only", "full_first", "jump", "exact_once"])
@pytest.mark.parametrize("seq_len, stride", [(8, 3), (8, 7), (5, 1), (64, 8)])
def test_window_arrays_equal_single_windows(policy, seq_len, stride):
    import numpy as np

    from corpusloom.operators.sequences import window_at, window_count, window_counts, windows_at

    total = np.arange(0, 200)
    counts = window_counts(total, seq_len, stride, policy)
    assert counts.tolist() == [window_count(t, seq_len, stride, policy) for t in range(200)]
    row, k = np.repeat(total, counts), np.concatenate([np.arange(n) for n in counts])
    assert list(zip(*(a.tolist() for a in windows_at(k, row, seq_len, stride, policy)))) == [window_at(int(i), int(t), seq_len, stride, policy) for i, t in zip(k, row)]


def test_windows_of_a_known_schema_come_in_arrow_batches(spark):
    pairs = spark.createDataFrame([("a", 5), ("b", 31), ("c", 0), ("d", 400_000)], "name STRING, total BIGINT").coalesce(1)
    pairs.createOrReplaceTempView("pairs_known")
    udtf.register(spark)
    udtf.register_windows_of(spark, "pairs_windows_of", pairs.schema)
    for policy in udtf.POLICY_NAMES.split(", "):  # d alone has more windows than a batch
        got, want = (spark.sql(f"SELECT name, total, count(*) AS n, sum(hash(*)) AS h FROM {f}(TABLE(pairs_known), 8, 4, '{policy}') GROUP BY ALL ORDER BY name").collect() for f in ("pairs_windows_of", "windows_of"))
        assert got == want and got[-1]["n"] > udtf.WINDOW_ROWS
    with pytest.raises(ValueError, match="lacks total"):
        udtf.register_windows_of(spark, "w", spark.range(1).schema)
    for call, message in (("pairs_windows_of(TABLE(pairs_known), 4, 8, 'jump')", "stride <= seq_len"), ("pairs_windows_of(TABLE(SELECT 'x' AS name, NULL::BIGINT AS total), 8, 4, 'jump')", "without total")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM {call}").collect()


def test_sql_windows_makes_its_rows_in_arrow_batches_of_one_scan(spark, sf):
    from corpusloom.plans.file_queries import sql_windows

    plan = sql_windows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("doc_windows_of(") == 5 and "parquet" not in plan


def test_pieces_of_a_table_carry_the_offset(spark):
    from corpusloom.operators.shards import shard_pieces

    udtf.register(spark)
    rows = [(i, 1 + i * 7 % 23) for i in range(40)]
    lengths = spark.createDataFrame(rows, "doc_ordinal BIGINT, n_tokens BIGINT")
    lengths.selectExpr("*", "'x' AS split").unionByName(lengths.selectExpr("*", "'y' AS split")).createOrReplaceTempView("lengths_of")
    got = spark.sql("SELECT * FROM shard_pieces_of(TABLE(lengths_of) PARTITION BY split ORDER BY (doc_ordinal), 25)").collect()
    want = sorted(tuple(r) for r in shard_pieces(lengths, 0, 25).select("doc_ordinal", "shard_id", "shard_offset", "doc_from", "n").collect())
    for split in "xy":
        assert sorted((r["doc_ordinal"], r["shard_id"], r["shard_offset"], r["doc_from"], r["n"]) for r in got if r["split"] == split) == want


@pytest.mark.parametrize("call, message", [
    ("shard_pieces_of(TABLE(SELECT 1L AS n_tokens), 0)", "must be a constant above 0"),
    ("shard_pieces_of(5, 3)", "must be TABLE"),
    ("windows_of(TABLE(SELECT 1L AS total), 4, 8, 'jump')", "stride must not exceed"),
    ("windows_of(TABLE(SELECT 1L AS total), 8, 4, 'other')", "policy must be one of"),
    ("windows_of(TABLE(SELECT 1L AS n), 8, 4, 'jump')", "the table lacks total"),
])
def test_table_functions_refuse(spark, call, message):
    udtf.register(spark)
    with pytest.raises(Exception, match=message):
        spark.sql(f"SELECT * FROM {call}").collect()


def test_unreadable_results_are_listed(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("val_bpb\tartifact_bytes\tmemory_mb\tnotes\n1.36\t12\t10\tok\ncrash\t15\t11\tfailed\n1.2\n")
    assert [r["detail"] for r in check_results(spark, f"{tmp_path}/r.tsv").collect()] == ["crash\t15\t11\tfailed", "1.2"]
