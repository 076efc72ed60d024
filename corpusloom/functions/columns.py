"""Column expressions: everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import (
    ARTIFACT_CAP_BYTES,
    CONTROL_NAME_PATTERNS,
    COOLDOWN_FRACTION,
    DATASET_PREFIX,
    FP16_SMALLEST_NORMAL,
)

# Unicode white space plus the four separators U+001C..U+001F.
_EDGE_SPACE = "(?U)^[\\s\\x1c-\\x1f]+|[\\s\\x1c-\\x1f]+$"


def idiv(a: Column, b: Column | int) -> Column:
    """Exact integer division (towards zero), without a detour over doubles."""
    return F.call_function("div", a, F.lit(b) if isinstance(b, int) else b)


def strip_text(col: Column) -> Column:
    """NUL becomes a space, then Unicode white space is cut at both ends."""
    return F.regexp_replace(F.replace(col, F.lit("\x00"), F.lit(" ")), _EDGE_SPACE, "")


def bits(nats: Column) -> Column:
    return nats / F.log(F.lit(2.0))


def tokenizer_kind(kind: Column, builder: Column, suffix: Column, vocab_size: Column, name: Column) -> Column:
    """Tokenizer family: explicit kind, builder name, dataset suffix, vocabulary size."""
    builder_name = F.element_at(F.split(F.coalesce(builder, F.lit("")), ":"), -1)
    return (
        F.when(kind.isin("byte", "pure_byte"), "byte")
        .when(kind.isin("sentencepiece_bpe", "sentencepiece"), "sentencepiece_bpe")
        .when(builder_name == "build_pure_byte_tokenizer", "byte")
        .when(builder_name == "build_sentencepiece_tokenizer", "sentencepiece_bpe")
        .when(suffix == "byte260", "byte")
        .when(vocab_size.isNotNull(), "sentencepiece_bpe")
        .otherwise(F.raise_error(F.concat(F.lit("cannot tell the tokenizer family of "), F.coalesce(name, F.lit("<unnamed>")))))
    )


def is_variant(variant: Column) -> Column:
    return (variant == "byte260") | variant.rlike("^sp[0-9]+$")


def dataset_name(variant: Column) -> Column:
    return F.when(is_variant(variant), F.concat(F.lit(DATASET_PREFIX), variant)).otherwise(
        F.raise_error(F.concat(F.lit("no dataset for variant "), variant))
    )


def bigram_buckets(vocab_size: Column, given: Column | None = None) -> Column:
    derived = idiv(vocab_size + 127, 128) * 128 * 5
    return derived if given is None else F.coalesce(given, derived)


def _int32(col: Column) -> Column:
    """Two's-complement wrap of a bigint to 32 bits."""
    return F.pmod(col + F.lit(2**31), F.lit(2**32)) - F.lit(2**31)


def bigram_hash_a(tokens: Column, buckets: int) -> Column:
    """Array of xor hashes of (previous, current); the first position is ``buckets-1``."""
    mod = buckets - 1
    prev, cur = F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, 2, F.size(tokens))
    tail = F.zip_with(
        prev,
        cur,
        lambda p, c: F.pmod(
            _int32(F.lit(36313) * c.cast("bigint")).bitwiseXOR(_int32(F.lit(27191) * p.cast("bigint"))), F.lit(mod)
        ),
    )
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(
        F.concat(F.array(F.lit(mod).cast("bigint")), tail)
    )


def bigram_hash_b(tokens: Column, buckets: int) -> Column:
    """Array of multiplicative hashes of (previous, current); the first previous is 0."""
    prev = F.concat(F.array(F.lit(0)), F.slice(tokens, 1, F.greatest(F.size(tokens) - 1, F.lit(0))))
    hashed = F.zip_with(
        prev, tokens, lambda p, c: (p.cast("bigint") * F.lit(92821) + c.cast("bigint")) % F.lit(buckets)
    )
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).otherwise(hashed)


def wrap(pos: Column, total: Column) -> tuple[Column, Column]:
    """Position in an endlessly repeated stream -> (epoch from 1, position)."""
    return idiv(pos, total) + 1, F.pmod(pos, total)


def pad(tokens: Column, width: int) -> Column:
    """Fixed-width window: zeros after the real tokens."""
    return F.concat(F.slice(tokens, 1, width), F.array_repeat(F.lit(0), F.greatest(F.lit(width) - F.size(tokens), F.lit(0))))


def lr_mul(step: Column, elapsed_ms: Column, iterations: int, warmdown: int, cap_ms: float | None) -> Column:
    """Learning-rate multiplier: linear cool-down by iterations, or by remaining time."""
    one = F.lit(1.0)
    if warmdown <= 0:
        return one
    if cap_ms is None:
        start = max(iterations - warmdown, 0)
        ramp = F.greatest((F.lit(iterations) - step) / F.lit(float(warmdown)), F.lit(0.0))
        return F.when((step >= start) & (step < iterations), ramp).otherwise(one)
    down = F.lit(float(warmdown)) * (elapsed_ms / F.greatest(step, F.lit(1)))
    left = F.greatest(F.lit(float(cap_ms)) - elapsed_ms, F.lit(0.0))
    return F.when(left <= down, left / F.greatest(down, F.lit(1e-9))).otherwise(one)


def lr_mul_fraction(elapsed_ms: Column, cap_ms: float, fraction: float = COOLDOWN_FRACTION) -> Column:
    """Cool-down over the last ``fraction`` of the time cap."""
    left = F.greatest(F.lit(float(cap_ms)) - elapsed_ms, F.lit(0.0))
    window = F.lit(float(cap_ms) * fraction)
    return F.when(left <= window, left / window).otherwise(F.lit(1.0))


def is_logged(step: Column, every: int, stopping: Column | None = None) -> Column:
    if every <= 0:
        return F.lit(False)
    rule = (step <= 10) | (step % every == 0)
    return rule if stopping is None else rule | stopping


def over_cap(artifact_bytes: Column, cap: int = ARTIFACT_CAP_BYTES) -> Column:
    return artifact_bytes > F.lit(cap)


def size_consistent(total: Column, code: Column, model: Column) -> Column:
    return total == code + model


def fp16(col: Column) -> Column:
    """Round to the nearest half-precision value, ties to even, without leaving the JVM."""
    x = col.cast("double")
    magnitude = F.abs(x)
    exponent = F.greatest(F.floor(F.log2(F.greatest(magnitude, F.lit(FP16_SMALLEST_NORMAL)))), F.lit(-14))
    ulp = F.pow(F.lit(2.0), exponent - 10)
    rounded = F.rint(x / ulp) * ulp
    return F.when(F.abs(rounded) > 65504.0, F.signum(x) * F.lit(float("inf"))).otherwise(rounded)


def fp32(col: Column) -> Column:
    """Round to single precision, keep as double for the next exact step."""
    return col.cast("float").cast("double")


def scale_as(col: Column, dtype: str) -> Column:
    if dtype == "float16":
        return fp16(fp32(col))
    if dtype == "float32":
        return fp32(col)
    if dtype == "double":
        return col
    raise ValueError(f"unknown scale dtype {dtype!r}")


def clamp(col: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(col, F.lit(float(low))), F.lit(float(high)))


def matrix_class(name: Column, variant: str = "plain") -> Column:
    """Class of a weight by name; the ``bigram`` variant adds one class before attn."""
    rule = F.when(name.contains("tok_emb") | name.contains("lm_head"), "embed").when(name.contains(".mlp."), "mlp")
    if variant == "bigram":
        rule = rule.when(name.contains("bigram"), "bigram")
    return rule.when(name.contains(".attn.") | name.contains(".proj."), "attn").otherwise("other")


def has_any(name: Column, patterns: Sequence[str] = CONTROL_NAME_PATTERNS) -> Column:
    rule = F.lit(False)
    for pattern in patterns:
        rule = rule | name.contains(pattern)
    return rule


def layer_number(name: Column) -> Column:
    """Layer of ``blocks.<n>.…``; -1 when there is none."""
    found = F.regexp_extract(name, r"blocks\.(\d+)\.", 1)
    return F.when(found == "", F.lit(-1)).otherwise(found.cast("int"))
