import glob
import os
import re

import numpy as np
import pytest
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.shards import (
    blocks,
    check_spans,
    doc_spans,
    export_pieces,
    open_stream,
    place,
    shard_pieces,
    split_stats,
    with_previous,
)
from corpusloom.operators.tokenizers import Tokenizer, register_tokenizer, tokenize
from corpusloom.sources.token_shards import Shard, ShardIndex, ShardWriter, read_shards, read_spans, shard_files, span_reads, write_shards

# Lengths with BOS: 10 (fills a shard of 10 exactly), 26 (spans shards), 1, 4, 10, 7.
TEXTS = ["a" * 9, "b" * 25, "", "ccc", "d" * 9, "eéé "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_ordinal BIGINT, text STRING").repartition(3)


def stream_of(texts):
    return [t for text in texts for t in [1] + [b + 4 for b in text.encode()]]


def current(path):
    return re.sub("^file:/+", "/", shard_files(SparkSession.getActiveSession(), path))


def files(path):
    return {os.path.basename(f): open(f, "rb").read() for f in sorted(glob.glob(f"{current(path)}/*.bin"))}


@pytest.mark.parametrize("num_val", [0, 2, 3, len(TEXTS)])
def test_files_hold_the_stream(spark, docs, tmp_path, num_val):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, num_val, 10), path)
    got = files(path)
    want = {}
    for split, texts in (("val", TEXTS[:num_val]), ("train", TEXTS[num_val:])):
        toks = stream_of(texts)
        for i in range(0, len(toks), 10):
            part = toks[i : i + 10]
            header = np.zeros(256, "<i4")
            header[:3] = 20240520, 1, len(part)
            want[f"fineweb_{split}_{i // 10:06d}.bin"] = header.tobytes() + np.array(part, "<u2").tobytes()
    assert got == want
    assert not glob.glob(f"{path}/**/_attempt*", recursive=True)
    rows = read_shards(spark, path, blockTokens=4).collect()
    for split, texts in (("val", TEXTS[:num_val]), ("train", TEXTS[num_val:])):
        mine = sorted((r["shard_id"], r["block_offset"], r["tokens"]) for r in rows if r["split"] == split)
        assert [t for _, _, toks in mine for t in toks] == stream_of(texts)


def test_plain_arrays_and_packed_tokens_write_the_same(spark, docs, tmp_path):
    write_shards(shard_pieces(tokenize(docs), 2, 10), str(tmp_path / "a"))
    write_shards(export_pieces(docs, 2, 10), str(tmp_path / "b"))
    assert files(str(tmp_path / "a")) == files(str(tmp_path / "b"))


def test_any_tokenizer_exports(spark, docs, tmp_path):
    register_tokenizer("pairs", lambda: Tokenizer("pairs", "custom", "p", 300, 0, 2, encode_batch=lambda ts: [[len(t), 299] for t in ts]))
    write_shards(export_pieces(docs, 1, 4, "pairs"), str(tmp_path / "p"))
    rows = read_shards(spark, str(tmp_path / "p"), split="train").orderBy("shard_id", "block_offset").collect()
    assert [t for r in rows for t in r["tokens"]] == [x for t in TEXTS[1:] for x in (0, len(t), 299)]


def test_stale_shards_go_and_strangers_stay(docs, tmp_path):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, 2, 5), path)
    (tmp_path / "out" / "notes.txt").write_text("keep")
    write_shards(export_pieces(docs, 2, 1000), path)
    assert sorted(files(path)) == ["fineweb_train_000000.bin", "fineweb_val_000000.bin"]
    assert (tmp_path / "out" / "notes.txt").exists()


def _spoil(tmp_path, docs, change):
    path = str(tmp_path / "bad")
    write_shards(export_pieces(docs, 0, 1000), path)
    name = glob.glob(f"{current(path)}/*.bin")[0]
    data = bytearray(open(name, "rb").read())
    open(name, "wb").write(change(data))
    return path


@pytest.mark.parametrize(
    "change, message",
    [
        (lambda d: b"\0\0\0\0" + d[4:], "not a token shard"),
        (lambda d: d[:4] + b"\2\0\0\0" + d[8:], "not a token shard"),
        (lambda d: d[:-2], "size of shard"),
        (lambda d: d + b"\0\0", "size of shard"),
        (lambda d: d + b"\0", "size of shard"),
        (lambda d: d[:500], "size of shard"),
    ],
)
def test_damaged_shards_are_refused(spark, docs, tmp_path, change, message):
    path = _spoil(tmp_path, docs, change)
    with pytest.raises(Exception, match=message):
        read_shards(spark, path).collect()


def test_no_shards_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="No shards found"):
        read_shards(spark, str(tmp_path)).collect()


def test_filters_choose_files(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, 2, 5), path)
    chosen = read_shards(spark, path).filter("split = 'val' AND shard_id < 2")
    assert {(r["split"], r["shard_id"]) for r in chosen.collect()} == {("val", 0), ("val", 1)}
    # A damaged file outside the filter is never opened.
    open(f"{current(path)}/fineweb_train_000000.bin", "wb").write(b"\0" * 1030)
    assert chosen.count() == 2
    assert read_shards(spark, path).filter("split = 'none'").count() == 0


def test_pieces_partition_the_documents(spark, docs):
    plan = shard_pieces(tokenize(docs).withColumn("n_tokens", F.size("tokens").cast("bigint")).drop("tokens"), 2, 7)
    rows = plan.collect()
    by_doc = {}
    for r in rows:
        assert 0 < r["n"] <= 7 and r["shard_offset"] + r["n"] <= r["shard_tokens"] <= 7
        by_doc.setdefault(r["doc_ordinal"], []).append((r["doc_from"], r["n"]))
    for i, t in enumerate(TEXTS):
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(t.encode()) + 1


def test_files_total_is_the_sum_over_splits(spark):
    lengths = spark.createDataFrame([(i, 6) for i in range(4)], "doc_ordinal BIGINT, n_tokens BIGINT")
    got = {r["split"]: tuple(r)[1:] for r in split_stats(lengths, 1, 10).collect()}
    assert got == {"val": (1, 1, 6), "train": (3, 2, 18), "total": (4, 3, 24)}
    none = {r["split"]: tuple(r)[1:] for r in split_stats(lengths, 0, 10).collect()}
    assert none["val"] == (0, 0, 0)


@pytest.mark.parametrize("block, halo", [(4, 0), (4, 1), (4, 9), (64, 3)])
def test_blocks_with_halo(docs, block, halo):
    toks = stream_of(TEXTS)
    got = blocks(place(tokenize(docs), 0), block, halo=halo).collect()
    assert {r["block_id"]: r["tokens"] for r in got} == {
        b: toks[b * block : (b + 1) * block + halo] for b in range(-(-len(toks) // block))
    }


def test_spans_and_reopened_stream(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, 0, 10), path)
    stream = open_stream(read_shards(spark, path, blockTokens=3), 8)
    toks = stream_of(TEXTS)
    assert {r["block_id"]: r["tokens"] for r in stream.collect()} == {b: toks[b * 8 : b * 8 + 8] for b in range(-(-len(toks) // 8))}
    starts = [i for i, t in enumerate(toks) if t == 1]
    for include in (True, False):
        got = sorted((r["start"], r["length"]) for r in doc_spans(stream, 1, include_next_bos=include).collect())
        ends = [s + (1 if include else 0) for s in starts[1:]] + [len(toks)]
        assert got == [(s, e - s) for s, e in zip(starts, ends)]
    assert check_spans(doc_spans(stream, 1, include_next_bos=False)).count() == 1  # the empty document
    overlapping = open_stream(read_shards(spark, path, blockTokens=3), 8, halo=1)
    pairs = sorted((r["pos"], r["prev"], r["token"]) for r in with_previous(overlapping).collect())
    assert pairs == [(i, toks[i - 1] if i else None, t) for i, t in enumerate(toks)]


def test_tokens_before_the_first_bos_belong_to_no_document(spark):
    df = spark.createDataFrame([("val", 0, 0, [9, 9, 1, 5]), ("val", 1, 4, [6, 1, 7])], "split STRING, block_id BIGINT, base_offset BIGINT, tokens ARRAY<INT>")
    assert sorted((r["start"], r["length"]) for r in doc_spans(df, 1).collect()) == [(2, 4), (5, 2)]


def written(spark, path, texts, overwrite=True):
    """A writer whose tasks are done but whose job has not committed."""
    import pyarrow as pa

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_ordinal BIGINT, text STRING")
    rows = export_pieces(docs, 0, 10).select("split", F.col("shard_id").cast("int").alias("shard_id"), "shard_offset", "shard_tokens", "tokens")
    table = rows.orderBy("split", "shard_id", "shard_offset").toArrow()
    writer = ShardWriter({"path": f"file://{path}"}, overwrite)
    half = table.num_rows // 2
    while half < table.num_rows and half and table["shard_id"][half] == table["shard_id"][half - 1]:
        half += 1
    return writer, [writer.write(iter(part.combine_chunks().to_batches())) for part in (table.slice(0, half), table.slice(half)) if isinstance(part, pa.Table) and part.num_rows]


def test_a_write_that_dies_before_its_commit_changes_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, 2, 10), path)
    before, rows = files(path), sorted(read_shards(spark, path).collect())
    writer, messages = written(spark, path, ["zz" * 30, "y"])
    assert len(messages) == 2 and files(path) == before  # tasks have published, the job has not
    assert sorted(read_shards(spark, path).collect()) == rows
    writer.abort(messages)
    assert files(path) == before
    writer, messages = written(spark, path, ["zz" * 30, "y"])
    reading = read_shards(spark, path)
    writer.commit(messages)
    assert sorted(files(path)) == [f"fineweb_train_{i:06d}.bin" for i in range(7)]
    assert sorted(reading.collect()) != rows  # planned anew
    # The version before stays for readers that have begun, the one before that goes.
    versions = os.listdir(f"{path}/_versions")
    assert len(versions) == 2
    writer, messages = written(spark, path, ["x"])
    writer.commit(messages)
    assert len(os.listdir(f"{path}/_versions")) == 2 and len(set(os.listdir(f"{path}/_versions")) & set(versions)) == 1


def test_two_attempts_of_a_task_and_lost_files(spark, tmp_path):
    path = str(tmp_path / "out")
    os.makedirs(path)
    writer, messages = written(spark, path, ["a" * 40])
    with pytest.raises(ValueError, match="more than one task"):
        writer.commit([*messages, messages[0]])
    assert not os.path.exists(f"{path}/_commits")
    writer, messages = written(spark, path, ["a" * 40])
    os.remove(glob.glob(f"{path}/_versions/{os.path.basename(writer.version)}/*.bin")[0])
    with pytest.raises(ValueError, match="not those that its tasks wrote"):
        writer.commit(messages)


def test_append_keeps_what_is_there(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, len(TEXTS), 10), path)
    writer, messages = written(spark, path, ["q" * 15], overwrite=False)
    writer.commit(messages)
    got = {(r["split"], r["shard_id"]) for r in read_shards(spark, path).collect()}
    assert {s for s, _ in got} == {"train", "val"} and ("train", 1) in got
    writer, messages = written(spark, path, ["q"], overwrite=False)
    with pytest.raises(ValueError, match="exist already"):
        writer.commit(messages)


def test_a_plain_folder_is_read_and_replaced(spark, docs, tmp_path):
    made, path = str(tmp_path / "made"), str(tmp_path / "out")
    write_shards(export_pieces(docs, 2, 10), made)
    os.makedirs(path)
    for name, data in files(made).items():
        open(f"{path}/{name}", "wb").write(data)
    assert sorted(read_shards(spark, path).collect()) == sorted(read_shards(spark, made).collect())
    write_shards(export_pieces(docs, 0, 1000), path)
    assert sorted(files(path)) == ["fineweb_train_000000.bin"]
    assert read_shards(spark, path).select("split").distinct().count() == 1


def test_spans_are_read_by_position(spark, docs, tmp_path):
    path = str(tmp_path / "out")
    write_shards(export_pieces(docs, 0, 10), path)
    toks = stream_of(TEXTS)
    n = len(toks)
    spans = [(k, at, length) for k, (at, length) in enumerate([(0, 0), (0, 1), (9, 2), (3, 25), (n - 1, 3), (n, 4), (5 * n + 2, 7), (0, 2 * n + 5), (11, n)])]
    df = spark.createDataFrame(spans, "k INT, start BIGINT, length BIGINT").repartition(3)
    got = {r["k"]: r["tokens"] for r in read_spans(spark, path, df).collect()}
    assert got == {k: [toks[(at + i) % n] for i in range(length)] for k, at, length in spans}
    assert "Exchange" not in read_spans(spark, path, spark.range(3).select(F.col("id").alias("start"), F.lit(2).alias("length")))._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(Exception, match="no span"):
        read_spans(spark, path, spark.createDataFrame([(-1, 2)], "start BIGINT, length BIGINT")).collect()


def test_bytes_read_follow_the_spans():
    index = ShardIndex()
    index.extend([Shard(f"s{i}", "train", i, 10) for i in range(1000)])
    reads = list(span_reads(index, 4_995, 12))
    assert [(r.path, r.start, r.stop) for r in reads] == [("s499", 5, 10), ("s500", 0, 7)]
    assert sum(r.stop - r.start for r in span_reads(index, 9_990, 25)) == 25


def test_spans_assemble_each_block_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<int>")
    def block(i):
        made.add(1)
        return [1, 5, 6, 1, 7] if i < 9 else [8, 1, 9]

    ids = spark.range(10, numPartitions=3).select(F.lit("train").alias("split"), F.col("id").alias("block_id"), (F.col("id") * 5).alias("base_offset"))
    spans = doc_spans(ids.withColumn("tokens", block("block_id")), 1, include_next_bos=False).collect()
    assert sorted((r["start"], r["length"]) for r in spans)[-3:] == [(40, 3), (43, 3), (46, 2)] and len(spans) == 19
    assert made.value == 10


def test_reopened_stream_moves_tokens_once(spark, docs, tmp_path):
    from corpusloom.sources.token_shards import shard_sizes

    path = str(tmp_path / "moved")
    write_shards(export_pieces(docs, 2, 7), path)
    stream = open_stream(read_shards(spark, path), 8, sizes=shard_sizes(spark, path))
    plan = stream._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan, plan
