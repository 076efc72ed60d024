"""Streaming forms: progress lines of running jobs, and document ingest."""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.corpus import split_of
from ..operators.order import ROWS_PER_BUCKET, Running, range_segments, running_offsets, scan
from ..operators.runs import log_points
from ..session import qualified
from ..sources.token_shards import register
from . import reorder


def stream_shards(spark: SparkSession, path: str, **options) -> DataFrame:
    """Endless resumable token stream (epoch, split, shard_id, block_offset, …)."""
    register(spark)
    reader = spark.readStream.format("token_shard_stream").option("path", qualified(spark, path))
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


def log_best(lines: DataFrame) -> DataFrame:
    """Last and best value per run over a stream of log lines (run, line); state is
    one small row per run."""
    points = log_points(lines, ["run"]).filter(F.col("kind") == "val")
    return points.groupBy("run").agg(
        F.max("step").alias("last_step"),
        F.max_by("bpb", "step").alias("last_bpb"),
        F.min("bpb").alias("best_bpb"),
        F.count(F.lit(1)).alias("n_points"),
    )


def stream_log_best(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Streaming :func:`log_best` over log files named ``<run>/<file>``."""
    lines = (
        spark.readStream.option("maxFilesPerTrigger", files_per_trigger)
        .format("text")
        .load(path)
        .select(
            F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -2), "^run=", "").alias("run"),
            F.col("value").alias("line"),
        )
    )
    return log_best(lines)


def keep_updates(updates: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write update-mode rows with their batch number; see :func:`latest_updates`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the batch's own folder makes a replay harmless.
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        updates.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def latest_updates(spark: SparkSession, out: str, key: str) -> DataFrame:
    """Newest state of every key among the written updates."""
    rows = spark.read.parquet(out)
    fields = [c for c in rows.columns if c not in (key, "batch")]
    newest = rows.groupBy(key).agg(F.max_by(F.struct(*fields), "batch").alias("s"))
    return newest.select(key, *[F.col(f"s.{c}") for c in fields])


def ingest_batch(batch: DataFrame, totals: DataFrame, num_val_docs: int, batch_id: int) -> tuple[DataFrame, DataFrame]:
    """Place one micro-batch behind ``totals`` (split, docs, tokens, last_ordinal; at
    most two rows). Returns the placed documents and the new totals.

    A document that arrives behind a later one would shift offsets already given
    out, so it fails the batch.
    """
    split = batch.withColumn("split", split_of(F.col("doc_ordinal"), num_val_docs))
    local = running_offsets(split, "n_tokens", "doc_ordinal", ["split"], ordinal="split_ordinal")
    known = totals.select(
        "split", F.col("docs").alias("_docs"), F.col("tokens").alias("_tokens"), F.col("last_ordinal").alias("_last")
    )
    late = F.raise_error(F.concat(F.lit("document out of order: "), F.col("doc_ordinal").cast("string"))).cast("bigint")
    placed = (
        local.join(F.broadcast(known), "split", "left")
        .withColumn("split_ordinal", F.col("split_ordinal") + F.coalesce("_docs", F.lit(0)))
        .withColumn("offset", F.col("offset") + F.coalesce("_tokens", F.lit(0)))
        .withColumn("offset", F.when(F.col("doc_ordinal") <= F.col("_last"), late).otherwise(F.col("offset")))
        .drop("_docs", "_tokens", "_last")
        .withColumn("batch", F.lit(batch_id).cast("bigint"))
    )
    added = split.groupBy("split").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"), F.max("doc_ordinal").alias("last_ordinal")
    )
    new = added.unionByName(totals.select(added.columns)).groupBy("split").agg(
        F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.max("last_ordinal").alias("last_ordinal")
    )
    return placed, new


def stream_ingest(docs: DataFrame, out: str, checkpoint: str, num_val_docs: int) -> StreamingQuery:
    """Continuous ingest of (doc_ordinal, n_tokens, …) with exact running offsets.

    Micro-batches must arrive in document order; within one the files may come in any
    order. Let a trigger take all files of a step (no maxFilesPerTrigger, which would
    follow modification times). Totals after batch n
    are kept per batch, so replaying a batch starts from the same numbers.
    """
    spark = docs.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch_id == 0:
            totals = spark.createDataFrame([], "split STRING, docs BIGINT, tokens BIGINT, last_ordinal BIGINT")
        else:
            totals = spark.read.parquet(f"{out}/totals/batch={batch_id - 1}")
        placed, new = ingest_batch(batch, totals, num_val_docs, batch_id)
        placed.drop("batch").write.mode("overwrite").parquet(f"{out}/docs/batch={batch_id}")
        new.coalesce(1).write.mode("overwrite").parquet(f"{out}/totals/batch={batch_id}")

    return (
        docs.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


# --- ingest in any order -----------------------------------------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ORDERED = "split STRING, bucket BIGINT, kind STRING, doc_ordinal BIGINT, n_tokens BIGINT, bucket_ordinal BIGINT, bucket_offset BIGINT"


def reordered(docs: DataFrame, num_val_docs: int, *, bucket_rows: int = ROWS_PER_BUCKET, patience_ms: int = 600_000) -> DataFrame:
    """Streaming (split, bucket, kind, doc_ordinal, n_tokens, bucket_ordinal, bucket_offset)
    of documents that arrive in any order.

    ``placed``: the documents of each ordinal bucket in their order, with their place in
    the bucket. ``missing``: a document that others have waited for ``patience_ms`` for
    (n_tokens then says how many). State is held per bucket, so no key grows with the
    stream and all tasks share the work; :func:`ingested` puts the buckets together.

    Timers ask for batches without end: run it with a time interval as trigger, or one
    batch at a time (``once``); a trigger that takes what is available never ends.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # The process that plans a stateful operator sees no shipped files, so it travels by value.
    cloudpickle.register_pickle_by_value(reorder)
    keyed = docs.select(
        split_of(F.col("doc_ordinal"), num_val_docs).alias("split"), F.expr(f"doc_ordinal div {bucket_rows}").alias("bucket"), "doc_ordinal", "n_tokens"
    )
    return keyed.groupBy("split", "bucket").transformWithStateInPandas(
        reorder.Reorder(bucket_rows, num_val_docs, patience_ms), ORDERED, outputMode="append", timeMode="ProcessingTime"
    )


def ingested(rows: DataFrame, num_val_docs: int, *, bucket_rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """(split, doc_ordinal, n_tokens, split_ordinal, offset) of the documents whose
    offset is settled: those up to the first gap of their split. ``rows`` is what
    :func:`reordered` has given out so far."""
    placed = rows.filter(F.col("kind") == "placed")
    sums = placed.groupBy("split", "bucket").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_tokens").alias("tokens"))
    low = F.when(F.col("split") == "train", F.greatest(F.col("bucket") * bucket_rows, F.lit(num_val_docs))).otherwise(F.col("bucket") * bucket_rows)
    high = F.when(F.col("split") == "val", F.least((F.col("bucket") + 1) * bucket_rows, F.lit(num_val_docs))).otherwise((F.col("bucket") + 1) * bucket_rows)
    first = F.when(F.col("split") == "train", F.expr(f"{num_val_docs} div {bucket_rows}")).otherwise(0)
    # One row a bucket. A bucket counts if all before it are full.
    sums = sums.withColumn("full", (F.col("docs") == high - low).cast("bigint")).withColumn("nth", F.col("bucket") - first)
    order = ["split", "bucket"]
    runs = [Running("sum", "docs", "docs_before", False), Running("sum", "tokens", "tokens_before", False), Running("sum", "full", "full_before", False)]
    bases = scan(range_segments(sums, order), ["split"], ["bucket"], runs).filter(F.col("full_before") == F.col("nth"))
    return placed.join(bases.select("split", "bucket", "docs_before", "tokens_before"), ["split", "bucket"]).select(
        "split", "doc_ordinal", "n_tokens", (F.col("docs_before") + F.col("bucket_ordinal")).alias("split_ordinal"),
        (F.col("tokens_before") + F.col("bucket_offset")).alias("offset"),
    )


def keep_batches(df: DataFrame, out: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append every micro-batch under its own folder, so a replay overwrites it."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        df.writeStream.option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(write)
        .start()
    )


def ingest_stats(spark: SparkSession, out: str, shard_size: int) -> DataFrame:
    """Split statistics after the newest batch."""
    totals = spark.read.parquet(f"{out}/totals")
    newest = totals.filter(F.col("batch") == totals.agg(F.max("batch")).scalar())
    return newest.select("split", "docs", F.expr(f"(tokens + {shard_size - 1}) div {shard_size}").alias("files"), "tokens")
