"""Catalog of exported datasets and tokenizers: selection and consistency checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dataset_with_tokenizer(datasets: DataFrame, tokenizers: DataFrame) -> DataFrame:
    """Datasets joined with the tokenizer they were made with."""
    toks = tokenizers.select(
        F.col("name").alias("tokenizer_name"), F.coalesce("model_path", "path").alias("tokenizer_path")
    )
    return datasets.join(toks, "tokenizer_name")


def select_shards(datasets: DataFrame, n_train: int, name: str | None = None) -> DataFrame:
    """(name, split, shard_id): all validation shards and the first ``n_train`` training
    shards of each dataset. Asking for more than exist is an error."""
    if n_train < 0:
        raise ValueError("a negative number of shards was asked for")
    chosen = datasets if name is None else datasets.filter(F.col("name") == name)
    has = F.col("stats.files_train")
    train = F.when(has >= n_train, F.lit(n_train).cast("bigint")).otherwise(
        F.raise_error(F.concat(F.col("name"), F.lit(" has too few training shards")))
    )
    parts = F.array(
        F.struct(F.lit("val").alias("split"), F.col("stats.files_val").alias("k")), F.struct(F.lit("train").alias("split"), train.alias("k"))
    )
    rows = chosen.select("name", F.inline(parts)).filter(F.col("k") > 0)
    return rows.select("name", "split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("k") - 1)).alias("shard_id"))


def check_catalog(datasets: DataFrame, tokenizers: DataFrame, files: DataFrame) -> DataFrame:
    """Violations (rule, detail): unknown tokenizer, tokenizer file of another name,
    more training shards on disk than the manifest declares. Fewer are fine.

    ``files`` has (dataset, split, n_files, tokenizer_file).
    """
    toks = tokenizers.select(F.col("name").alias("tokenizer_name"), F.coalesce("model_path", "path").alias("_path"))
    orphan = datasets.join(toks, "tokenizer_name", "left_anti").select(
        F.lit("unknown_tokenizer").alias("rule"), F.concat_ws(" -> ", "name", "tokenizer_name").alias("detail")
    )
    present = files.join(datasets.select(F.col("name").alias("dataset"), "tokenizer_name", "stats"), "dataset")
    surplus = present.filter((F.col("split") == "train") & (F.col("n_files") > F.col("stats.files_train"))).select(
        F.lit("surplus_shards").alias("rule"),
        F.concat("dataset", F.lit(": found "), F.col("n_files").cast("string"), F.lit(", manifest says "), F.col("stats.files_train").cast("string")).alias("detail"),
    )
    expected = F.element_at(F.split("_path", "/"), -1)
    wrong = (
        present.join(toks, "tokenizer_name")
        .filter((expected != "") & (F.element_at(F.split("tokenizer_file", "/"), -1) != expected))
        .select(
            F.lit("tokenizer_file").alias("rule"),
            F.concat("dataset", F.lit(" expects "), expected, F.lit(", got "), F.element_at(F.split("tokenizer_file", "/"), -1)).alias("detail"),
        )
        .distinct()
    )
    return orphan.unionByName(surplus).unionByName(wrong)


def missing_shards(expected: DataFrame, present: DataFrame) -> DataFrame:
    """Expected shard files that are not there, and files nobody expects."""
    cols = ["name", "split", "shard_id"]
    absent = expected.select(*cols).exceptAll(present.select(*cols)).withColumn("state", F.lit("missing"))
    extra = present.select(*cols).exceptAll(expected.select(*cols)).withColumn("state", F.lit("unexpected"))
    return absent.unionByName(extra)
