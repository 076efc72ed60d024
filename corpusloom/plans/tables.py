"""Shared inputs of the registered queries: the given tables in the engine's shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.shards import blocks, place
from ..operators.tokenizers import byte_length, token_counts, tokenize
from ..session import spread

VAL_DOCS = 100
SHARD = 100_000
BLOCK = 16_384
SEQ = 1024
STRIDE = 64
BATCH_TOKENS = 524_288


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    rows = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ordinal"), "text", *extra)
    return spread(rows, "doc_ordinal")


def lengths(spark: SparkSession, sf: str, *extra: str) -> DataFrame:
    rows = table(spark, sf, "documents")
    return rows.select(F.col("doc_id").alias("doc_ordinal"), *extra, byte_length(F.col("text")).alias("n_tokens"))


def total_tokens(spark: SparkSession, sf: str) -> int:
    return int(lengths(spark, sf).agg(F.sum("n_tokens")).first()[0])


def placed_tokens(spark: SparkSession, sf: str, num_val: int = 0, as_bytes: bool = False) -> DataFrame:
    """Documents at their stream offset, with tokens. Text travels through the
    shuffle, one byte per token; tokens are made behind it."""
    sized = docs(spark, sf).withColumn("n_tokens", byte_length(F.col("text")))
    return tokenize(place(sized, num_val), as_bytes=as_bytes)


def stream(spark: SparkSession, sf: str, num_val: int = 0, halo: int = 0) -> DataFrame:
    return blocks(placed_tokens(spark, sf, num_val), BLOCK, halo=halo)


def one_stream(spark: SparkSession, sf: str, halo: int = 0) -> DataFrame:
    """All documents as a single stream."""
    return blocks(placed_tokens(spark, sf, 0), BLOCK, by=None, halo=halo)


def unigram_table(spark: SparkSession, sf: str) -> list[float]:
    """Loss per token id of the corpus unigram model; as long as the vocabulary."""
    from ..operators.metrics import unigram_nll
    from ..schema import BYTE_VOCAB_SIZE

    rows = unigram_nll(token_counts(docs(spark, sf))).select("token_id", "nll").collect()
    out = [0.0] * BYTE_VOCAB_SIZE
    for row in rows:
        out[row["token_id"]] = row["nll"]
    return out


def matrices(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("tensor_"), F.col("label").cast("string")).alias("tensor"),
        F.col("vec_id").cast("int").alias("row_id"),
        F.col("embedding").alias("values"),
    )


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def r(col: Column | str, digits: int = 6) -> Column:
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def weighted_sum(values: Column) -> Column:
    """Order-sensitive check value of an integer array."""
    terms = F.transform(values, lambda v, i: v.cast("bigint") * (i + 1))
    return F.aggregate(terms, F.lit(0).cast("bigint"), lambda a, t: a + t)


def total_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("bigint"), lambda a, t: a + t)
