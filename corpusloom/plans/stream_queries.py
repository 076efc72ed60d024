"""Queries that go through shard files and streams, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.runs import log_points
from ..operators.shards import cut_pieces, export_pieces, open_stream, place
from ..session import scratch_path
from ..sources.docs import read_docs, write_docs
from ..sources.token_shards import read_shards, shard_sizes, write_shards
from ..streaming import jobs
from .archive_queries import log_lines
from .corpus_oracle import placed, tokens
from .tables import BLOCK, SHARD, VAL_DOCS, docs, lengths, total_of, weighted_sum

INGEST_STEPS = 4
LOG_RUNS = 16


def _export_tokens(spark, sf) -> str:
    """Write the corpus as token shards; returns the folder."""
    path = scratch_path(spark, "shards")
    write_shards(export_pieces(docs(spark, sf), VAL_DOCS, SHARD), path)
    return path


def shards_roundtrip(spark, sf):
    rows = read_shards(spark, _export_tokens(spark, sf), blockTokens=4096)
    return rows.groupBy("split", "shard_id").agg(
        F.sum(F.size("tokens")).alias("n"),
        F.max("shard_tokens").alias("declared"),
        F.sum(weighted_sum(F.col("tokens")) + F.col("block_offset") * total_of(F.col("tokens"))).alias("wsum"),
        F.min_by(F.get("tokens", F.lit(0)), "block_offset").alias("first_token"),
    )


def shard_prefix(spark, sf):
    """Pushed filters: only the files of the first two training shards are opened."""
    rows = read_shards(spark, _export_tokens(spark, sf))
    chosen = rows.filter((F.col("split") == "train") & (F.col("shard_id") < 2))
    return chosen.groupBy("shard_id").agg(F.sum(F.size("tokens")).alias("n"), F.sum(total_of(F.col("tokens"))).alias("sum_tokens"))


def reopened_stream(spark, sf):
    path = _export_tokens(spark, sf)
    stream = open_stream(read_shards(spark, path), BLOCK, sizes=shard_sizes(spark, path))
    return stream.select(
        "split", "block_id", "base_offset", F.size("tokens").cast("bigint").alias("n"), weighted_sum(F.col("tokens")).alias("wsum")
    )


def jsonl_roundtrip(spark, sf):
    path = scratch_path(spark, "docs")
    write_docs(docs(spark, sf), path)
    return read_docs(spark, path).select("doc_ordinal", F.sha2("text", 256).alias("digest"))


def shard_stream(spark, sf):
    """Two epochs of the training shards as a stream, resumable between batches."""
    path = _export_tokens(spark, sf)
    out, checkpoint = scratch_path(spark, "stream"), scratch_path(spark, "stream-checkpoint")
    per_batch = max(int(lengths(spark, sf).agg(F.sum("n_tokens")).first()[0]) // 3, 1)
    rows = jobs.stream_shards(spark, path, epochs=2, split="train", tokensPerBatch=per_batch, blockTokens=BLOCK)
    query = jobs.keep_batches(rows, out, checkpoint, processingTime="0 seconds")
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.read.parquet(out).groupBy("epoch", "shard_id").agg(
        F.sum(F.size("tokens")).alias("n"), F.sum(total_of(F.col("tokens"))).alias("sum_tokens")
    )


def _runs(spark, sf):
    """Log lines of ``LOG_RUNS`` runs, each holding the events of many users."""
    lines = log_lines(spark, sf)
    return lines.withColumn("run", (F.col("run").cast("bigint") % LOG_RUNS).cast("string"))


def stream_log_best(spark, sf):
    """Progress lines of many runs, read as a stream of log files."""
    logs, out, checkpoint = (scratch_path(spark, x) for x in ("logs", "best", "best-checkpoint"))
    _runs(spark, sf).select("run", F.col("line").alias("value")).write.partitionBy("run").text(logs)
    updates = jobs.stream_log_best(spark, f"{logs}/*")
    jobs.keep_updates(updates, out, checkpoint).awaitTermination()
    return jobs.latest_updates(spark, out, "run")


def stream_ingest_stats(spark, sf):
    """Documents arriving in steps of several files each; offsets and split statistics
    per micro-batch. The files of a step come in any order: a step is one batch."""
    source, out, checkpoint = (scratch_path(spark, x) for x in ("incoming", "ingest", "ingest-checkpoint"))
    incoming = lengths(spark, sf)
    last = incoming.agg(F.max("doc_ordinal")).first()[0] + 1
    for step in range(INGEST_STEPS):
        low, high = last * step // INGEST_STEPS, last * (step + 1) // INGEST_STEPS
        part = incoming.filter((F.col("doc_ordinal") >= low) & (F.col("doc_ordinal") < high))
        part.repartition(4).write.mode("append").parquet(f"{source}/step={step}")
        arriving = spark.readStream.schema("doc_ordinal BIGINT, n_tokens BIGINT, step INT").parquet(source)
        jobs.stream_ingest(arriving.select("doc_ordinal", "n_tokens"), out, checkpoint, VAL_DOCS).awaitTermination()
    stats = jobs.ingest_stats(spark, out, SHARD)
    placed_docs = spark.read.parquet(f"{out}/docs")
    sums = placed_docs.groupBy("split").agg(F.sum("offset").alias("sum_offset"), F.max("split_ordinal").alias("last_ordinal"))
    return stats.join(sums, "split")


def stream_reordered_ingest(spark, sf):
    """Documents arriving in any order, a part of every stretch in each step: held until
    those before them have come, then placed as a batch job would."""
    source, out, checkpoint = (scratch_path(spark, x) for x in ("shuffled", "ordered", "ordered-checkpoint"))
    incoming = lengths(spark, sf).withColumn("step", F.pmod(F.xxhash64("doc_ordinal"), F.lit(INGEST_STEPS)).cast("int"))
    incoming.write.partitionBy("step").parquet(f"{source}/all")
    for step in range(INGEST_STEPS):
        spark.read.parquet(f"{source}/all/step={step}").write.mode("append").parquet(f"{source}/steps")
        arriving = spark.readStream.schema("doc_ordinal BIGINT, n_tokens BIGINT").parquet(f"{source}/steps")
        jobs.keep_batches(jobs.reordered(arriving, VAL_DOCS), out, checkpoint, once=True).awaitTermination()
    return jobs.ingested(spark.read.parquet(out), VAL_DOCS)


def batch_log_best(spark, sf):
    """The same table computed in batch."""
    points = log_points(_runs(spark, sf)).filter(F.col("kind") == "val")
    return points.groupBy("run").agg(
        F.max("step").alias("last_step"), F.max_by("bpb", "step").alias("last_bpb"), F.min("bpb").alias("best_bpb"), F.count(F.lit(1)).alias("n_points")
    )


def shard_blocks(spark, sf):
    """Pieces per cell when the cell is a block with a halo: a plan without tokens."""
    plan = cut_pieces(place(lengths(spark, sf), VAL_DOCS), BLOCK, halo=1)
    return plan.groupBy("split", "cell").agg(F.count(F.lit(1)).alias("pieces"), F.sum("n").alias("n"))


QUERIES = {
    "shards_roundtrip": shards_roundtrip,
    "shard_prefix": shard_prefix,
    "reopened_stream": reopened_stream,
    "jsonl_roundtrip": jsonl_roundtrip,
    "shard_stream": shard_stream,
    "shard_blocks": shard_blocks,
    "stream_log_best": stream_log_best,
    "batch_log_best": batch_log_best,
    "stream_ingest_stats": stream_ingest_stats,
    "stream_reordered_ingest": stream_reordered_ingest,
}

_IN_SHARDS = f"WITH {tokens(VAL_DOCS)}, s AS (SELECT split, (pos // {SHARD})::INTEGER AS shard_id, pos % {SHARD} AS k, tok FROM t)"
_LOG_BEST = f"""SELECT (user_id % {LOG_RUNS})::VARCHAR AS run, max(event_id) AS last_step, max_by(value, event_id) AS last_bpb, min(value) AS best_bpb,
  count(*)::BIGINT AS n_points FROM events WHERE event_type = 'click' GROUP BY 1"""

ORACLE = {
    "shards_roundtrip": f"""{_IN_SHARDS}
SELECT split, shard_id, count(*)::BIGINT AS n, count(*)::BIGINT AS declared, sum(tok * (k + 1))::BIGINT AS wsum, min_by(tok, k) AS first_token
FROM s GROUP BY ALL""",
    "shard_prefix": f"""{_IN_SHARDS}
SELECT shard_id, count(*)::BIGINT AS n, sum(tok)::BIGINT AS sum_tokens FROM s WHERE split = 'train' AND shard_id < 2 GROUP BY shard_id""",
    "reopened_stream": f"""WITH {tokens(VAL_DOCS)}
SELECT split, pos // {BLOCK} AS block_id, pos // {BLOCK} * {BLOCK} AS base_offset, count(*)::BIGINT AS n, sum(tok * (pos % {BLOCK} + 1))::BIGINT AS wsum
FROM t GROUP BY ALL""",
    "jsonl_roundtrip": "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS doc_ordinal, sha256(text) AS digest FROM documents",
    "shard_stream": f"""{_IN_SHARDS}
SELECT e AS epoch, shard_id, count(*)::BIGINT AS n, sum(tok)::BIGINT AS sum_tokens FROM s CROSS JOIN range(1, 3) q(e) WHERE split = 'train' GROUP BY ALL""",
    "shard_blocks": f"""WITH {placed(VAL_DOCS)},
c AS (SELECT split, off, n, unnest(range(greatest((off - 1) // {BLOCK}, 0), (off + n - 1) // {BLOCK} + 1)) AS cell FROM p),
e AS (SELECT split, cell, least(off + n, (cell + 1) * {BLOCK} + 1) - greatest(off, cell * {BLOCK}) AS n FROM c)
SELECT split, cell, count(*)::BIGINT AS pieces, sum(n)::BIGINT AS n FROM e WHERE n > 0 GROUP BY ALL""",
    "stream_log_best": _LOG_BEST,
    "batch_log_best": _LOG_BEST,
    "stream_reordered_ingest": f"""WITH {placed(VAL_DOCS)}
SELECT split, doc_id AS doc_ordinal, n AS n_tokens, ord AS split_ordinal, off AS "offset" FROM p""",
    "stream_ingest_stats": f"""WITH {placed(VAL_DOCS)}
SELECT split, count(*)::BIGINT AS docs, ceil(sum(n) / {SHARD})::BIGINT AS files, sum(n)::BIGINT AS tokens, sum(off)::BIGINT AS sum_offset, max(ord) AS last_ordinal
FROM p GROUP BY split""",
}
