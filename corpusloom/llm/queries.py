"""Registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.tables import table
from . import (
    bit_slices, bpe, conversation_repair, html_paths, language_id, lexical_search, mixing,
    quality_rules, secret_scan, sentence_spans, simhash, superminhash, toxicity,
)
from .oracle import ORACLE as ORACLE

TOXIC_CHAIN = {"low_quality": "quality = 0", "toxic": "toxic = 1"}


def sha256(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_policy(quality_rules.ledger(table(spark, sf_dir, "documents")))
    failed = ~quality_rules.passes(quality_rules.bits(quality_rules.BASE))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "fail_bits", failed.alias("base_failed"), "kept")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, *language_id.learn(docs))
    out = F.coalesce(language_id.held_out(F.col("doc_id")), F.lit(False)).alias("held_out")
    return found.select("doc_id", out, "lang_pred", "score")


def vocabulary() -> tuple[dict[bytes, int], str]:
    import public_tokenizers

    return bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = vocabulary()
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern), ranks)
    said = F.array_join(F.col("ids").cast("array<string>"), " ")
    return both.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"), sha256(said).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op5_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sentence_spans.deduplicate(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_sentences", "n_removed", "text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), TOXIC_CHAIN)
    return toxicity.predict(docs, chain)


def op7_html_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_paths.extract_pages(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_scan.scan(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", sha256(F.col("base")).alias("base_sha256"), "spans")


def op10_bit_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bit_slices.quantised(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    best = bit_slices.top_k(rows, rows.filter("id % 50 = 0"), k=5)
    return best.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op11_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return conversation_repair.repair(conversations, conversation_repair.damaged(conversations))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_language_id, op3_byte_bpe, op4_mixing, op5_sentence_spans,
        op6_toxicity, op7_html_paths, op8_simhash, op9_secret_scan, op10_bit_slices, op11_superminhash, op12_lexical_search, op13_conversation_repair,
    )
}
