"""Tokenizer registry, tokenisation, vocabulary statistics."""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import bigram_buckets, tokenizer_kind
from ..functions.tokens import byte_ids, count_tokens, framed, packed, pair_counts
from ..schema import (
    BOS_ID,
    BYTE_OFFSET,
    BYTE_VOCAB_SIZE,
    EOS_ID,
    MAX_VOCAB_SIZE,
    PAD_ID,
    SPACE_MARK,
    UNK_ID,
)


@dataclass
class Tokenizer:
    """What a plug-in provides.

    Give ``encode_arrow`` (string array -> int32 list array), or the plain
    ``encode_batch`` / ``encode`` callables of a Python tokenizer.
    """

    name: str
    kind: str
    dataset_suffix: str
    vocab_size: int
    bos_id: int
    eos_id: int
    encode_arrow: Callable[[pa.Array], pa.Array] | None = None
    encode_batch: Callable[[list[str]], Sequence[Sequence[int]]] | None = None
    encode: Callable[[str], Sequence[int]] | None = None
    manifest: dict = field(default_factory=dict)

    def ids(self, texts: pa.Array) -> pa.Array:
        if self.encode_arrow is not None:
            return self.encode_arrow(texts)
        plain = texts.to_pylist()
        rows = self.encode_batch(plain) if self.encode_batch else [self.encode(t) for t in plain]
        offsets = np.zeros(len(rows) + 1, np.int32)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.empty(0, np.int32)
        return pa.ListArray.from_arrays(offsets, flat.astype(np.int32))


Factory = Callable[[], Tokenizer]
_FACTORIES: dict[str, Factory] = {}


def register_tokenizer(name: str, factory: Factory) -> None:
    """``factory`` must be picklable; every Python worker calls it once."""
    _FACTORIES[name] = factory


def tokenizer_factory(name: str) -> Factory:
    if name not in _FACTORIES:
        raise KeyError(f"no tokenizer registered as {name!r}")
    return _FACTORIES[name]


def byte_tokenizer() -> Tokenizer:
    return Tokenizer(
        name="pure_byte_260",
        kind="byte",
        dataset_suffix="byte260",
        vocab_size=BYTE_VOCAB_SIZE,
        bos_id=BOS_ID,
        eos_id=EOS_ID,
        encode_arrow=byte_ids,
        manifest={"pad_id": PAD_ID, "unk_id": UNK_ID},
    )


def sentencepiece_tokenizer(spark: SparkSession, model_path: str, name: str | None = None) -> str:
    """Ship a trained subword model to the executors and register it; returns its name."""
    spark.sparkContext.addFile(model_path)
    model_file = os.path.basename(model_path)

    def build() -> Tokenizer:
        import sentencepiece as spm
        from pyspark import SparkFiles

        model = spm.SentencePieceProcessor(model_file=SparkFiles.get(model_file))
        size = int(model.vocab_size())
        return Tokenizer(
            name=name or f"sp_bpe_{size}",
            kind="sentencepiece_bpe",
            dataset_suffix=f"sp{size}",
            vocab_size=size,
            bos_id=int(model.bos_id()),
            eos_id=int(model.eos_id()),
            encode_batch=lambda texts: model.encode(texts, out_type=int),
            manifest={"model_path": model_path},
        )

    key = name or build().name
    register_tokenizer(key, build)
    return key


register_tokenizer("pure_byte_260", byte_tokenizer)


def once_per_worker(factory: Factory) -> Factory:
    state: list[Tokenizer] = []

    def get() -> Tokenizer:
        if not state:
            state.append(factory())
        return state[0]

    return get


def tokenize(
    docs: DataFrame,
    tokenizer: str = "pure_byte_260",
    *,
    text_col: str = "text",
    out: str = "tokens",
    append_eos: bool = False,
    as_bytes: bool = False,
) -> DataFrame:
    """Replace the text by ``[bos] + ids (+ eos)``; other columns stay.

    ``as_bytes`` gives the 16-bit shard representation (BINARY) and checks that every
    id is inside the vocabulary; use it where tokens only travel to a shard.
    """
    get = once_per_worker(tokenizer_factory(tokenizer))

    @F.arrow_udf("binary" if as_bytes else "array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        tok = get()
        ids = framed(tok.ids(texts), tok.bos_id, tok.eos_id if append_eos else None)
        return packed(ids, tok.vocab_size) if as_bytes else ids

    kept = [c for c in docs.columns if c != text_col]
    return docs.select(*kept, encode(text_col).alias(out))


def byte_length(text: Column) -> Column:
    """Length of the byte sequence with BOS, without making the tokens."""
    return (F.octet_length(text) + 1).cast("bigint")


def token_counts(
    docs: DataFrame, tokenizer: str = "pure_byte_260", by: Sequence[str] = (), *, text_col: str = "text"
) -> DataFrame:
    """(by…, token_id, n) over whole texts, BOS included.

    Tokens are counted inside the Arrow batch they are made in, so a hot token
    or group reaches the shuffle as one row per batch.
    """
    by = list(by)
    factory = tokenizer_factory(tokenizer)
    get = once_per_worker(factory)
    vocab_size = factory().vocab_size

    def encode(texts: pa.Array) -> pa.Array:
        tok = get()
        return framed(tok.ids(texts), tok.bos_id, None)

    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in by], "token_id INT, n BIGINT"])
    partial = docs.select(*by, text_col).mapInArrow(count_tokens(encode, text_col, by, vocab_size), schema)
    return partial.groupBy(*by, "token_id").agg(F.sum("n").alias("n"))


def token_pair_counts(docs: DataFrame, tokenizer: str = "pure_byte_260", *, text_col: str = "text") -> DataFrame:
    """(prev, token, n) within whole texts, BOS included, which has no prev. Pairs are
    counted inside the Arrow batch, so at most vocabulary squared rows leave it."""
    factory = tokenizer_factory(tokenizer)
    get = once_per_worker(factory)
    vocab_size = factory().vocab_size

    def run(batches):
        for batch in filter(len, batches):
            tok = get()
            yield pair_counts(framed(tok.ids(batch.column(0)), tok.bos_id, None), vocab_size, True)

    counted = docs.select(text_col).mapInArrow(run, "prev INT, token INT, n BIGINT")
    return counted.groupBy("prev", "token").agg(F.sum("n").alias("n"))


def byte_vocab(spark: SparkSession) -> DataFrame:
    """Vocabulary rows of the byte tokenizer."""
    ids = spark.range(BYTE_VOCAB_SIZE).select(F.col("id").cast("int").alias("token_id"))
    special = F.element_at(F.array(*[F.lit(s) for s in ("<pad>", "<s>", "</s>", "<unk>")]), F.col("token_id") + 1)
    piece = F.format_string("<0x%02X>", F.col("token_id") - BYTE_OFFSET)
    return ids.select(
        "token_id",
        F.when(F.col("token_id") < BYTE_OFFSET, special).otherwise(piece).alias("piece"),
        F.when(F.col("token_id") == UNK_ID, "unknown")
        .when(F.col("token_id") < BYTE_OFFSET, "control")
        .otherwise("byte")
        .alias("kind"),
    )


def piece_stats(piece: Column, kind: Column) -> tuple[Column, Column, Column]:
    """(n_bytes, leading_space, boundary) of one piece."""
    silent = kind.isin("control", "unknown", "unused")
    marked = piece.startswith(SPACE_MARK)
    body = F.octet_length(piece) - F.when(marked, F.octet_length(F.lit(SPACE_MARK))).otherwise(0)
    n_bytes = F.when(silent, 0).when(kind == "byte", 1).otherwise(body)
    return n_bytes.cast("int"), ~silent & (kind != "byte") & marked, silent


def vocab_stats(vocab: DataFrame, declared_size: int | None = None) -> DataFrame:
    """(token_id, n_bytes, leading_space, boundary) for every id up to the larger
    of the model's and the declared vocabulary; ids past the model count nothing."""
    n_bytes, space, boundary = piece_stats(F.col("piece"), F.col("kind"))
    own = vocab.select("token_id", n_bytes.alias("n_bytes"), space.alias("leading_space"), boundary.alias("boundary"))
    if declared_size is None:
        return own
    extra = (
        vocab.sparkSession.range(declared_size)
        .select(F.col("id").cast("int").alias("token_id"))
        .join(own.select("token_id"), "token_id", "left_anti")
        .select("token_id", F.lit(0).alias("n_bytes"), F.lit(False).alias("leading_space"), F.lit(True).alias("boundary"))
    )
    return own.unionByName(extra)


def vocabulary_table(stats: DataFrame) -> DataFrame:
    """Side of a lookup join that is safe to broadcast: unique ids below 65,536. An id
    beyond that is an error, not a row less."""
    fits = (F.col("token_id") >= 0) & (F.col("token_id") < MAX_VOCAB_SIZE)
    wrong = F.raise_error(F.concat(F.lit("token id out of range: "), F.col("token_id").cast("string")))
    kind = stats.schema["token_id"].dataType
    return F.broadcast(stats.withColumn("token_id", F.when(fits, F.col("token_id")).otherwise(wrong.cast(kind))))


def check_vocab_size(specs: DataFrame) -> DataFrame:
    """Vocabularies that do not fit 16-bit shard storage."""
    return specs.filter(F.col("vocab_size") > MAX_VOCAB_SIZE).select(
        F.lit("vocab_too_large").alias("rule"), F.concat_ws("=", F.lit("vocab_size"), F.col("vocab_size")).alias("detail")
    )


def parse_reuse(values: DataFrame) -> DataFrame:
    """``VOCAB=MODEL`` strings (value) as (vocab_size, model_path); check the result
    with ``check_unique(…, ["vocab_size"])``, a size may be given once only."""
    return values.select(
        F.substring_index("value", "=", 1).cast("bigint").alias("vocab_size"),
        F.regexp_replace("value", "^[^=]*=", "").alias("model_path"),
    )


def apply_reuse(specs: DataFrame, reuse: DataFrame) -> DataFrame:
    """Fill ``reuse_model_path`` of subword specs from a (vocab_size, model_path) list."""
    kind = tokenizer_kind(*[F.col(c) for c in ("kind", "builder", "dataset_suffix", "vocab_size", "name")])
    given = reuse.select(F.col("vocab_size").alias("_v"), F.col("model_path").alias("_path"))
    hit = (F.col("vocab_size") == F.col("_v")) & (F.col("_kind") == "sentencepiece_bpe")
    return (
        specs.withColumn("_kind", kind)
        .join(given, hit, "left")
        .withColumn("reuse_model_path", F.coalesce("_path", "reuse_model_path"))
        .drop("_kind", "_v", "_path")
    )


def _given(specs: DataFrame) -> Column:
    """A spec's own bucket count: a column, or a key that only the whole spec has."""
    key = "recommended_bigram_vocab_size"
    if key in specs.columns:
        return F.col(key).cast("bigint")
    return F.variant_get("raw", f"$.{key}", "bigint") if "raw" in specs.columns else F.lit(None).cast("bigint")


def resolve_specs(specs: DataFrame, *, skip_byte: bool = False, train_docs: int | None = None) -> DataFrame:
    """Names, sizes and bigram buckets each spec resolves to."""
    kind = tokenizer_kind(*[F.col(c) for c in ("kind", "builder", "dataset_suffix", "vocab_size", "name")])
    out = specs.withColumn("_kind", kind)
    if skip_byte:
        out = out.filter(F.col("_kind") != "byte")
    is_byte = F.col("_kind") == "byte"
    size = F.when(is_byte, F.lit(BYTE_VOCAB_SIZE)).otherwise(F.col("vocab_size")).cast("bigint")
    limit = F.col("tokenizer_train_docs") if train_docs is None else F.lit(train_docs).cast("bigint")
    return (
        out.withColumn("_size", size)
        .withColumn("tokenizer_train_docs", F.when(is_byte, F.col("tokenizer_train_docs")).otherwise(limit))
        .select(
            F.coalesce(
                "name", F.when(is_byte, "pure_byte_260").otherwise(F.concat(F.lit("sp_bpe_"), F.col("_size").cast("string")))
            ).alias("name"),
            F.col("_kind").alias("kind"),
            F.coalesce(
                "dataset_suffix", F.when(is_byte, "byte260").otherwise(F.concat(F.lit("sp"), F.col("_size").cast("string")))
            ).alias("dataset_suffix"),
            F.col("_size").alias("vocab_size"),
            F.coalesce(_given(specs), bigram_buckets(F.col("_size"))).alias("recommended_bigram_vocab_size"),
            "tokenizer_train_docs",
            "reuse_model_path",
        )
    )
