import random

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.shards import export_pieces
from corpusloom.sources.token_shards import Shard, ShardIndex, ShardStreamReader, list_shards, write_shards
from corpusloom.streaming import jobs

TEXTS = ["abc" * i for i in range(1, 9)]


@pytest.fixture(scope="module")
def shards(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("s") / "out")
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_ordinal BIGINT, text STRING")
    write_shards(export_pieces(docs, 0, 25), path)
    return path


STREAM = [t for text in TEXTS for t in [1] + [b + 4 for b in text.encode()]]


def read_back(spark, out):
    rows = spark.read.parquet(out).orderBy("epoch", "shard_id", "block_offset").collect()
    return [t for r in rows for t in r["tokens"]]


def test_endless_stream_resumes_where_it_stopped(spark, shards, tmp_path):
    out, checkpoint = str(tmp_path / "o"), str(tmp_path / "c")
    options = {"split": "train", "tokensPerBatch": 40, "blockTokens": 8}
    first = jobs.keep_batches(jobs.stream_shards(spark, shards, epochs=1, **options), out, checkpoint, processingTime="0 seconds")
    first.processAllAvailable()
    first.stop()
    assert read_back(spark, out) == STREAM
    second = jobs.keep_batches(jobs.stream_shards(spark, shards, epochs=3, **options), out, checkpoint, processingTime="0 seconds")
    second.processAllAvailable()
    second.stop()
    assert read_back(spark, out) == STREAM * 3


def test_offsets_walk_epochs(shards):
    reader = ShardStreamReader({"path": f"file:{shards}", "tokensPerBatch": "60", "blockTokens": "8"})
    start, seen = reader.initialOffset(), []
    for _ in range(6):
        end = reader.latestOffset()
        parts = reader.partitions(start, end)
        ranges = [r for p in parts for r in p.ranges]
        assert sum(r.stop - r.start for r in ranges) == 60
        seen += [(r.epoch, r.shard_id, r.start, r.stop) for r in ranges]
        start = end
    endless = [(p // len(STREAM) + 1, p % len(STREAM) // 25, p % len(STREAM) % 25) for p in range(360)]
    assert [(e, s, k) for e, s, a, b in seen for k in range(a, b)] == endless


def ingest(spark, tmp_path, parts):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "ck"))
    for step, rows in enumerate(parts):
        spark.createDataFrame(rows, "doc_ordinal BIGINT, n_tokens BIGINT").coalesce(1).write.mode("append").parquet(source)
        arriving = spark.readStream.schema("doc_ordinal BIGINT, n_tokens BIGINT").parquet(source)
        jobs.stream_ingest(arriving, out, checkpoint, 3).awaitTermination()
    return out


def test_ingest_continues_offsets(spark, tmp_path):
    rows = [(i, 10 + i) for i in range(10)]
    out = ingest(spark, tmp_path, [rows[:2], rows[2:7], rows[7:]])
    got = {r["doc_ordinal"]: (r["split"], r["split_ordinal"], r["offset"]) for r in spark.read.parquet(f"{out}/docs").collect()}
    want, at = {}, {"val": [0, 0], "train": [0, 0]}
    for i, n in rows:
        split = "val" if i < 3 else "train"
        want[i] = (split, *at[split])
        at[split] = [at[split][0] + 1, at[split][1] + n]
    assert got == want
    stats = {r["split"]: (r["docs"], r["files"], r["tokens"]) for r in jobs.ingest_stats(spark, out, 50).collect()}
    assert stats == {"val": (3, 1, 33), "train": (7, 3, 112)}


def test_replayed_batch_gives_the_same_numbers(spark):
    none = spark.createDataFrame([], "split STRING, docs BIGINT, tokens BIGINT, last_ordinal BIGINT")
    batch = spark.createDataFrame([(5, 7), (4, 3)], "doc_ordinal BIGINT, n_tokens BIGINT")
    placed, totals = jobs.ingest_batch(batch, none, 0, 0)
    again, _ = jobs.ingest_batch(batch, none, 0, 0)
    assert sorted(placed.collect()) == sorted(again.collect())
    row = totals.first()
    assert (row["docs"], row["tokens"], row["last_ordinal"]) == (2, 10, 5)


def test_late_documents_fail(spark):
    totals = spark.createDataFrame([("train", 2, 10, 5)], "split STRING, docs BIGINT, tokens BIGINT, last_ordinal BIGINT")
    batch = spark.createDataFrame([(5, 7)], "doc_ordinal BIGINT, n_tokens BIGINT")
    with pytest.raises(Exception, match="document out of order: 5"):
        jobs.ingest_batch(batch, totals, 0, 1)[0].collect()


def test_log_best_follows_growing_logs(spark, tmp_path):
    logs, out, checkpoint = (tmp_path / x for x in ("logs", "out", "ck"))
    line = "step:{s}/100 val_loss:2.0 val_bpb:{v} train_time:{s}ms step_avg:1.00ms\n"
    for batch in ([("a", 1, 1.5), ("b", 1, 1.6)], [("a", 2, 1.2), ("a", 3, 1.3)]):
        for run, step, value in batch:
            (logs / run).mkdir(parents=True, exist_ok=True)
            (logs / run / f"{step}.log").write_text(line.format(s=step, v=value) + "noise\n")
        updates = jobs.stream_log_best(spark, f"{logs}/*")
        jobs.keep_updates(updates, str(out), str(checkpoint)).awaitTermination()
    got = {r["run"]: (r["last_step"], r["last_bpb"], r["best_bpb"], r["n_points"]) for r in jobs.latest_updates(spark, str(out), "run").collect()}
    assert got == {"a": (3, 1.3, 1.2, 3), "b": (1, 1.6, 1.6, 1)}
    assert spark.read.parquet(str(out)).select(F.max("batch")).first()[0] == 1


def test_index_finds_places_and_takes_new_files(spark, shards):
    listed = [Shard(f"/x/s_{i}.bin", "train", i, n) for i, n in enumerate([5, 1, 7, 3])]
    index = ShardIndex()
    index.extend(listed[:2])
    index.extend(listed)
    assert index.ends == [5, 6, 13, 16] and index.total == 16
    for low in range(17):
        for high in range(low, 17):
            got = [(r.shard_id, p) for r in index.ranges(low, high, 4) for p in range(r.start, r.stop)]
            assert got == [(s.shard_id, p) for s in listed for p in range(s.n_tokens)][low:high]
    assert all(r.stop - r.start <= 4 for r in index.ranges(0, 16, 4))
    with pytest.raises(ValueError, match="came before others"):
        index.extend([listed[0], Shard("/x/s_0b.bin", "train", 9, 2), *listed[1:]])


def test_a_batch_does_not_list_or_walk_all_shards(spark, shards, monkeypatch):
    from corpusloom.sources import token_shards

    lists = []
    plain = token_shards.list_shards
    monkeypatch.setattr(token_shards, "list_shards", lambda *a, **k: lists.append(1) or plain(*a, **k))
    reader = ShardStreamReader({"path": f"file:{shards}", "tokensPerBatch": "3", "blockTokens": "1", "epochs": "1"})
    start, got = reader.initialOffset(), []
    total = sum(s.n_tokens for s in plain(f"file:{shards}", "fineweb", "train"))
    while True:
        end = reader.latestOffset()
        if end == start:
            break
        parts = [r for g in reader.partitions(start, end) for r in g.ranges]
        assert sum(r.stop - r.start for r in parts) <= 3
        got += [(r.shard_id, p) for r in parts for p in range(r.start, r.stop)]
        start = end
    assert len(got) == len(set(got)) == total
    assert len(lists) <= 5 < total // 3  # at the begin and where the epoch ends


def test_restarted_reader_plans_the_same(shards):
    options = {"path": f"file:{shards}", "tokensPerBatch": "7", "blockTokens": "2", "epochs": "2"}
    one = ShardStreamReader(options)
    offsets = [one.initialOffset()]
    while len(offsets) < 2 or offsets[-1] != offsets[-2]:
        offsets.append(one.latestOffset())
    for a, b in zip(offsets, offsets[1:]):
        again = ShardStreamReader(options)  # knows nothing but the offsets
        assert [g.value for g in again.partitions(a, b)] == [g.value for g in one.partitions(a, b)]
        follow = again.latestOffset()
        at = offsets.index(b)
        assert follow == offsets[min(at + 1, len(offsets) - 1)]


def test_all_there_is_in_one_batch(spark, shards, tmp_path):
    rows = jobs.stream_shards(spark, str(shards), epochs=2, split="train", tokensPerBatch="all", blockTokens=8)
    jobs.keep_batches(rows, f"{tmp_path}/out", f"{tmp_path}/ck", availableNow=True).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/out")
    total = sum(s.n_tokens for s in list_shards(f"file:{shards}", "fineweb", "train"))
    assert {(r["epoch"], r["n"]) for r in got.groupBy("epoch").agg(F.sum(F.size("tokens")).alias("n")).collect()} == {(1, total), (2, total)}
    assert got.select("batch").distinct().count() == 1
    with pytest.raises(ValueError, match="needs a number of epochs"):
        ShardStreamReader({"path": f"file:{shards}", "tokensPerBatch": "all"})


# --- ingest in any order


def steps_of(rows, n, seed):
    rng = random.Random(seed)
    rows = list(rows)
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)]


@pytest.mark.parametrize("bucket_rows, num_val", [(4, 6), (16, 0), (1000, 9), (5, 100)])
def test_reordered_arrival_gives_batch_offsets(spark, tmp_path, bucket_rows, num_val):
    rows = [(i, 3 + i * 7 % 11) for i in range(60)]
    got = None
    for k, step in enumerate(steps_of(rows, 4, bucket_rows)):
        spark.createDataFrame(step, "doc_ordinal BIGINT, n_tokens BIGINT").write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema("doc_ordinal BIGINT, n_tokens BIGINT").parquet(f"{tmp_path}/in")
        jobs.keep_batches(jobs.reordered(arriving, num_val, bucket_rows=bucket_rows), f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()
        got = jobs.ingested(spark.read.parquet(f"{tmp_path}/out"), num_val, bucket_rows=bucket_rows)
        want, at = {}, {"val": [0, 0], "train": [0, 0]}
        for i, n in rows:
            split = "val" if i < num_val else "train"
            want[i] = (split, n, *at[split])
            at[split] = [at[split][0] + 1, at[split][1] + n]
        found = {r["doc_ordinal"]: (r["split"], r["n_tokens"], r["split_ordinal"], r["offset"]) for r in got.collect()}
        assert all(want[i] == v for i, v in found.items())  # settled offsets are final
    assert found == want


def test_a_lost_document_is_reported_by_timer(spark, tmp_path):
    def step(rows):
        spark.createDataFrame(rows, "doc_ordinal BIGINT, n_tokens BIGINT").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema("doc_ordinal BIGINT, n_tokens BIGINT").parquet(f"{tmp_path}/in")
        jobs.keep_batches(jobs.reordered(arriving, 0, bucket_rows=10, patience_ms=1), f"{tmp_path}/out", f"{tmp_path}/ck", once=True).awaitTermination()
        return spark.read.parquet(f"{tmp_path}/out")

    step([(0, 5), (2, 5), (3, 5)])
    out = step([(11, 4), (10, 2)])  # another bucket; time passes for the first
    reports = {(r["bucket"], r["doc_ordinal"], r["n_tokens"]) for r in out.filter("kind = 'missing'").collect()}
    assert (0, 1, 2) in reports and all(r[0] == 0 for r in reports)
    assert {r["doc_ordinal"] for r in jobs.ingested(out, 0, bucket_rows=10).collect()} == {0}
    out = step([(1, 9), *[(i, 1) for i in range(4, 10)]])
    assert {r["doc_ordinal"]: r["offset"] for r in jobs.ingested(out, 0, bucket_rows=10).collect()} == {
        0: 0, 1: 5, 2: 14, 3: 19, **{i: 24 + i - 4 for i in range(4, 10)}, 10: 30, 11: 32,
    }


def test_a_document_that_comes_twice_fails(spark, tmp_path):
    for rows, fails in (([(0, 5), (1, 5)], False), ([(1, 5)], True)):
        spark.createDataFrame(rows, "doc_ordinal BIGINT, n_tokens BIGINT").write.mode("append").parquet(f"{tmp_path}/in")
        arriving = spark.readStream.schema("doc_ordinal BIGINT, n_tokens BIGINT").parquet(f"{tmp_path}/in")
        query = jobs.keep_batches(jobs.reordered(arriving, 0), f"{tmp_path}/out", f"{tmp_path}/ck", once=True)
        if fails:
            with pytest.raises(Exception, match="document 1 came twice"):
                query.awaitTermination()
        else:
            query.awaitTermination()
