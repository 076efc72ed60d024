"""Documents: cleaning, prefix limits, splits, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import strip_text


def clean_training_text(docs: DataFrame, max_docs: int | None = None, *, text_col: str = "text") -> DataFrame:
    """Text for tokenizer training. The prefix limit counts input lines, so it is
    applied before empty texts are dropped."""
    if max_docs is not None:
        docs = docs.filter(F.col("doc_ordinal") < max_docs)
    return docs.withColumn(text_col, strip_text(F.col(text_col))).filter(F.col(text_col) != "")


def split_of(ordinal: Column, num_val_docs: int) -> Column:
    return F.when(ordinal < num_val_docs, "val").otherwise("train")


def with_split(docs: DataFrame, num_val_docs: int) -> DataFrame:
    return docs.withColumn("split", split_of(F.col("doc_ordinal"), num_val_docs))


def check_val_docs(docs: DataFrame, num_val_docs: int) -> DataFrame:
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return n.filter((F.lit(num_val_docs) < 0) | (F.lit(num_val_docs) > F.col("n"))).select(
        F.lit("num_val_docs").alias("rule"),
        F.format_string(f"cannot take {num_val_docs} validation documents of %d", "n").alias("detail"),
    )


def fingerprint(docs: DataFrame, rows_per_bucket: int = 1024, *, levels: int | None = None) -> DataFrame:
    """Order-sensitive corpus digest: row hashes, bucket hashes, then one root.

    A bucket is ``rows_per_bucket`` consecutive ordinals. Levels of buckets follow each
    other (three at least) until one bucket is left, so no list is longer than a bucket,
    whatever the number of documents. With ``levels`` fixed, the last of them hashes all
    that the others leave: one hash for ``rows_per_bucket ** (levels - 1)`` ordinals.
    Not comparable with a whole-file SHA-256, which cannot be computed in parallel.
    """
    rows = docs.select(F.col("doc_ordinal").alias("k"), F.sha2(F.col("text"), 256).alias("h"), F.lit(1).alias("n"))
    if levels is None:
        last = docs.agg(F.max("doc_ordinal")).first()[0] or 0
        levels = 3
        while last // rows_per_bucket**levels:
            levels += 1
    for _ in range(levels - 1):
        rows = _level(rows, F.expr(f"k div {rows_per_bucket}").cast("bigint").alias("k"))
    return _level(rows).select(F.coalesce("n", F.lit(0)).cast("bigint").alias("n_docs"), F.col("h").alias("root"))


def _level(rows: DataFrame, *key: Column) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("k", "h")))
    digest = F.sha2(F.concat_ws("", F.transform(ordered, lambda s: s["h"])), 256)
    return rows.groupBy(*key).agg(F.when(F.count("h") > 0, digest).alias("h"), F.sum("n").alias("n"))
