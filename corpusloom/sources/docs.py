"""JSONL documents in line order, and their optional sidecar."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import DEFAULT_VAL_DOCS, SIDECAR, as_struct
from ..session import small_side


def number_lines(spark: SparkSession, path: str) -> DataFrame:
    """(doc_ordinal, line): dense line numbers over all files in name order."""
    return _numbered(spark, path, by_file=False).select(F.col("number").alias("doc_ordinal"), "line")


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, line): dense line numbers from 0 in each file."""
    return _numbered(spark, path, by_file=True)


def _numbered(spark: SparkSession, path: str, by_file: bool) -> DataFrame:
    """Lines of one file split are read in order by one task, so a line's number is
    the start of its split plus its place in it: one small join, no sort, no
    shuffle of the text.
    """
    lines = spark.read.text(path).select(
        F.col("value").alias("line"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
    )
    splits = lines.groupBy("_file", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    # One row per file split, as a table of known size: while that is below Spark's
    # limit for broadcasts, the text stays where it is.
    earlier = Window.partitionBy(F.col("_file") if by_file else F.lit(0)).orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    bases = splits.select(
        F.col("_file").alias("_f"),
        F.col("_start").alias("_s"),
        "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"),
    )
    joined = lines.join(small_side(bases), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")), "left")
    lost = F.raise_error(F.lit("input splits changed between passes")).cast("bigint")
    ordinal = F.when(F.col("_base").isNull(), lost).otherwise(F.col("_base") + F.col("_id") - F.col("_first"))
    return joined.select(F.col("_file").alias("file"), ordinal.alias("number"), "line")


def read_docs(spark: SparkSession, path: str, text_col: str = "text") -> DataFrame:
    """(doc_ordinal, text) from JSONL; a line without ``text`` is an error."""
    parsed = number_lines(spark, path).select(
        "doc_ordinal", F.from_json("line", f"`{text_col}` STRING")[text_col].alias("text")
    )
    bad = F.raise_error(F.concat(F.lit("line without text at ordinal "), F.col("doc_ordinal").cast("string"))).cast("string")
    return parsed.select("doc_ordinal", F.coalesce("text", bad).alias("text"))


def write_docs(docs: DataFrame, path: str) -> None:
    """JSONL in ordinal order, one file per range of ordinals."""
    ordered = docs.repartitionByRange("doc_ordinal").sortWithinPartitions("doc_ordinal")
    ordered.select(F.to_json(F.struct("text")).alias("value")).write.mode("overwrite").text(path)


def read_sidecar(spark: SparkSession, path: str) -> DataFrame:
    """One row of the sidecar's known fields and, as the VARIANT ``raw``, all of it; no row
    when the file is absent."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.isFile(target):
        return spark.createDataFrame([], SIDECAR).withColumn("raw", F.parse_json(F.lit(None).cast("string")))
    text = spark.read.text(path, wholetext=True)
    body = F.trim("value")
    parsed = F.from_json(body, as_struct(SIDECAR))
    wrong = F.raise_error(F.lit("docs sidecar is not an object")).cast(as_struct(SIDECAR))
    return text.select(F.when(body.startswith("{"), parsed).otherwise(wrong).alias("s"), F.parse_json(body).alias("raw")).select("s.*", "raw")


def resolve_counts(docs: DataFrame, sidecar: DataFrame, num_val_docs: int | None = None) -> tuple[int, int]:
    """(number of documents, validation documents): the sidecar where it says so,
    else a count; the argument, else the sidecar, else the default."""
    row = sidecar.first()
    total = row["num_docs"] if row is not None and row["num_docs"] is not None else docs.count()
    val = num_val_docs
    if val is None:
        val = row["docs_val"] if row is not None and row["docs_val"] is not None else DEFAULT_VAL_DOCS
    if not 0 <= val <= total:
        raise ValueError(f"cannot take {val} validation documents of {total}")
    return int(total), int(val)
