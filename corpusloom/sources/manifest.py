"""Manifest, tokenizer specs and their export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import (
    BOS_ID,
    BYTE_OFFSET,
    BYTE_VOCAB_SIZE,
    CORPUS_VERSION,
    DATASET,
    EOS_ID,
    PAD_ID,
    SPEC,
    TOKENIZER,
    UNK_ID,
    as_struct,
)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def parse_specs(texts: DataFrame) -> DataFrame:
    """Tokenizer specs out of JSON text (value): a list, or an object holding the list
    as ``tokenizer_specs`` or else ``tokenizers``. Empty lists and entries that are
    not objects are errors. Besides the known fields every row has ``raw``, the whole
    spec as a VARIANT, with unknown keys and the types of all values."""
    whole = texts.select(F.parse_json(F.trim("value")).alias("v"))
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("ARRAY"), F.col("v"))
    for key in ("tokenizers", "tokenizer_specs"):
        inner = F.try_variant_get("v", f"$.{key}", "variant")
        listed = F.when(kind.startswith("OBJECT") & inner.isNotNull() & ~F.is_variant_null(inner), inner).otherwise(listed)
    entries = F.try_variant_get(listed, "$", "array<variant>")
    empty = F.raise_error(F.lit("no tokenizer specs: a non-empty list is needed")).cast("array<variant>")
    entries = F.when(F.coalesce(F.size(entries), F.lit(0)) > 0, entries).otherwise(empty)
    wrong = F.raise_error(F.lit("a tokenizer spec is not an object")).cast("string")
    rows = whole.select(F.explode(entries).alias("raw"))
    object_ = F.when(F.schema_of_variant("raw").startswith("OBJECT"), F.to_json("raw")).otherwise(wrong)
    return rows.select(F.from_json(object_, as_struct(SPEC)).alias("s"), "raw").select("s.*", "raw")


def read_specs(spark: SparkSession, path: str) -> DataFrame:
    return parse_specs(_whole(spark, path))


def spec_json(specs: DataFrame) -> Column:
    """A spec as JSON text: as it was read, or its columns if it was made here."""
    own = F.to_json(F.struct(*[c for c in specs.columns if c != "raw"]))
    return F.coalesce(F.to_json("raw"), own) if "raw" in specs.columns else own


def write_specs(specs: DataFrame, path: str) -> None:
    """The specs actually used, as one JSON object. A spec list is written by hand."""
    # In the order of the rows.
    rows = specs.select(F.monotonically_increasing_id().alias("at"), spec_json(specs).alias("spec"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "spec"))), lambda s: s["spec"]), ",")
    body = rows.agg(F.concat(F.lit('{"tokenizers":['), listed, F.lit("]}")).alias("value"))
    body.coalesce(1).write.mode("overwrite").text(path)


def write_byte_tokenizer(spark: SparkSession, path: str) -> None:
    """The byte tokenizer's own description, as the manifest points to it."""
    config = F.struct(
        F.lit(BOS_ID).alias("bos_id"),
        F.lit(BYTE_VOCAB_SIZE - BYTE_OFFSET).alias("byte_count"),
        F.lit(BYTE_OFFSET).alias("byte_offset"),
        F.lit(EOS_ID).alias("eos_id"),
        F.lit(PAD_ID).alias("pad_id"),
        F.lit(UNK_ID).alias("unk_id"),
    )
    body = F.struct(config.alias("config"), F.lit("pure_byte").alias("tokenizer_type"), F.lit(BYTE_VOCAB_SIZE).alias("vocab_size"))
    spark.range(1).select(F.to_json(body).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def relative_to(path: Column, root: str) -> Column:
    """Absolute paths below ``root`` become relative; others stay."""
    base = root.rstrip("/") + "/"
    return F.when(path.startswith(base), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def manifest_json(
    datasets: DataFrame,
    tokenizers: DataFrame,
    *,
    root: str,
    num_docs: int,
    num_val_docs: int,
    shard_size: int,
    docs_jsonl: str,
    specs: DataFrame | None = None,
    sidecar: DataFrame | None = None,
    sidecar_path: str | None = None,
    repo_id: str | None = None,
    remote_root: str | None = None,
    append_eos: bool = False,
) -> DataFrame:
    """(value): one JSON object describing the export; paths below ``root`` are relative.
    The sidecar, if there is one, is repeated in it with all its keys.

    A manifest lists datasets and tokenizers, a handful of rows each.
    """
    spark = datasets.sparkSession
    for c in ("path", "train_glob", "val_glob"):
        datasets = datasets.withColumn(c, relative_to(F.col(c), root))
    for c in ("path", "model_path", "vocab_path"):
        if c in tokenizers.columns:
            tokenizers = tokenizers.withColumn(c, relative_to(F.col(c), root))

    def listing(df: DataFrame) -> Column:
        return df.agg(F.array_sort(F.collect_list(F.struct(*df.columns)))).scalar()

    side = None
    if sidecar is not None:
        whole = F.to_json("raw") if "raw" in sidecar.columns else F.to_json(F.struct(*sidecar.columns))
        side = sidecar.select("docs_sha256", "shuffle_seed", whole.alias("whole")).first()
    meta = {
        "remote_repo_id": F.lit(repo_id).cast("string"),
        "remote_root": relative_to(F.lit(remote_root).cast("string"), root),
        "num_docs": F.lit(num_docs).cast("bigint"),
        "docs_sha256": F.lit(side["docs_sha256"] if side else None).cast("string"),
        "source_manifest": relative_to(F.lit(sidecar_path if side else None).cast("string"), root),
    }
    if side:
        meta["source_sidecar"] = F.parse_json(F.lit(side["whole"]))
    fields = {
        "version": F.lit(CORPUS_VERSION),
        "num_docs": F.lit(num_docs).cast("bigint"),
        "num_val_docs": F.lit(num_val_docs).cast("bigint"),
        "shuffle_seed": F.lit(side["shuffle_seed"] if side else None).cast("bigint"),
        "shard_size": F.lit(shard_size).cast("bigint"),
        "append_eos": F.lit(append_eos),
        "docs_jsonl": relative_to(F.lit(docs_jsonl), root),
        "docs_meta": F.struct(*[c.alias(n) for n, c in meta.items()]),
        "tokenizers": listing(tokenizers),
        "datasets": listing(datasets),
    }
    if specs is not None:
        # Maps have no order, so specs are listed by name.
        named = specs.select("name", F.parse_json(spec_json(specs)).alias("spec")).collect()
        texts = [r["spec"].toJson() for r in sorted(named, key=lambda r: (r["name"] is not None, r["name"]))]
        fields["tokenizer_specs"] = F.parse_json(F.lit(f"[{','.join(texts)}]"))
    one = F.struct(*[c.alias(n) for n, c in fields.items()])
    return spark.range(1).select(F.to_json(one, {"ignoreNullFields": "false"}).alias("value"))


def write_manifest(datasets: DataFrame, tokenizers: DataFrame, path: str, **about) -> None:
    """Write :func:`manifest_json` as text."""
    manifest_json(datasets, tokenizers, **about).coalesce(1).write.mode("overwrite").text(path)


def parse_manifest(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(datasets, tokenizers) catalog tables out of manifest JSON text (value)."""
    body = F.from_json(
        "value", f"STRUCT<datasets: ARRAY<{as_struct(DATASET)}>, tokenizers: ARRAY<{as_struct(TOKENIZER)}>>"
    )
    parsed = texts.select(body.alias("m"))
    return parsed.select(F.inline("m.datasets")), parsed.select(F.inline("m.tokenizers"))


def manifest_document(texts: DataFrame) -> DataFrame:
    """(manifest): the whole manifest as a VARIANT, with all keys and types."""
    return texts.select(F.parse_json(F.trim("value")).alias("manifest"))


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_manifest(_whole(spark, path))
