"""Assertions as queries: every check returns its violations as (rule, detail)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_tokens(toks: DataFrame, vocab_size: int, key: str = "doc_ordinal", tokens: str = "tokens") -> DataFrame:
    """Sequences with an id outside ``[0, vocab_size)``: key, first bad id, its position."""
    outside = lambda t: (t < 0) | (t >= vocab_size)
    # Clean sequences drop out first; the first bad id is also the first of its kind.
    return (
        toks.filter(F.exists(tokens, outside))
        .select(key, tokens, F.get(F.filter(tokens, outside), F.lit(0)).alias("bad_id"))
        .select(key, "bad_id", (F.array_position(tokens, F.col("bad_id")) - 1).cast("int").alias("bad_pos"))
    )


def check_count(docs: DataFrame, declared: int) -> DataFrame:
    found = docs.agg(F.count(F.lit(1)).alias("n"))
    return found.filter(F.col("n") != declared).select(
        F.lit("doc_count").alias("rule"),
        F.format_string(f"expected {declared} docs, found %d", "n").alias("detail"),
    )


def check_unique(df: DataFrame, cols: Sequence[str], rule: str = "duplicate") -> DataFrame:
    return (
        df.groupBy(*cols)
        .agg(F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") > 1)
        .select(F.lit(rule).alias("rule"), F.concat_ws(",", *[F.col(c).cast("string") for c in cols]).alias("detail"))
    )


def check_not_empty(df: DataFrame, rule: str = "empty_result") -> DataFrame:
    return (
        df.agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") == 0)
        .select(F.lit(rule).alias("rule"), F.lit("nothing left after filtering").alias("detail"))
    )


def missing_rows(expected: DataFrame, present: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``expected`` that ``present`` lacks."""
    return expected.join(present.select(*on).distinct(), list(on), "left_anti")


def fail_on(violations: DataFrame) -> None:
    """Raise with one violation, if there is any."""
    first = violations.limit(1).collect()
    if first:
        raise ValueError(f"{first[0]['rule']}: {first[0]['detail']}")
