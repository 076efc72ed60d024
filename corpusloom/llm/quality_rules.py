"""Quality rules with a bitmask ledger, in DataFrame functions only.

``ledger`` evaluates every rule once per text and stores its measurements and one long
of failure bits. ``apply_policy`` keeps a row if none of the bits of a policy's version
is set; ``ablations`` tells, for every rule of a policy, how many rows it fails, fails
alone (they come back if the rule goes), and how many the policy keeps without it.
Rows are first counted by their bits, so ablations read at most 2^rules combinations.

Repeated words: the windows of a text are sorted with their places, so equal ones are
neighbours; the words they cover follow from the gaps between the places of the
repeated ones. Nothing is shuffled by ``ledger``.

Nulls: a null text has no words; a null doc_id is carried along. Empty texts fail the
rules on length and, having no words, no rule on shares. Repeated rows are measured
each; an empty table gives an empty ledger. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, words

WINDOW = 3
SYMBOLS = r"[^#*$%&|<>]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct_words")


@dataclass(frozen=True)
class Rule:
    """A failure condition over the measurements, as SQL; its place is its bit."""

    name: str
    fails: str


# Bits are never reused: a new rule is appended. Conditions are in whole numbers.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "n_words > 0 AND 10 * n_symbols > 3 * n_words"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 15 * n_words"),
    Rule("duplicate_lines", "n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines"),
    Rule("few_distinct_words", "10 * n_distinct_words < n_words AND n_words >= 200"),
)
BASE = ("few_words", "repeated_words")
# Versions stay as they are once used; a change is a new version.
POLICIES = {
    "v1": BASE,
    "v2": (*BASE, "symbols", "short_words", "long_words", "duplicate_lines"),
    "v3": tuple(r.name for r in RULES),
}
CURRENT = "v2"


def bits(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    at = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << at[n] for n in set(names))


def _repeated(found: Column) -> Column:
    """Words of the array ``found`` in windows that occur twice or more."""
    n = F.size(found)
    last = n - WINDOW + 1
    windows = F.arrays_zip(*[F.slice(found, i + 1, last).alias(f"w{i}") for i in range(WINDOW)], F.sequence(F.lit(1), last).alias("at"))
    ordered = F.sort_array(windows)

    def twins(a: Column, b: Column) -> Column:
        same = a["w0"] == b["w0"]
        for i in range(1, WINDOW):
            same = same & (a[f"w{i}"] == b[f"w{i}"])
        return F.when(same, F.array(a["at"], b["at"]))

    return ordered, twins


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, measurements), one row per row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", "text", words(F.col("text")).alias("w"))
    ordered, twins = _repeated(F.col("w"))
    enough = F.size("w") >= WINDOW
    step = base.select("id", "text", "w", F.when(enough, ordered).alias("s"))
    pairs = F.zip_with(F.slice("s", 1, F.size("s") - 1), F.slice("s", 2, F.size("s")), twins)
    step = step.select("id", "text", "w", F.when(F.size("s") > 1, pairs).alias("p"))
    places = F.array_sort(F.array_distinct(F.flatten(F.array_compact("p"))))
    step = step.select("id", "text", "w", F.coalesce(places, F.array().cast("array<int>")).alias("p"))
    gaps = F.zip_with(F.slice("p", 2, F.size("p")), F.slice("p", 1, F.greatest(F.size("p") - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.when(F.size("p") > 0, F.aggregate(gaps, F.lit(WINDOW), lambda a, b: a + b)).otherwise(F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    step = step.select("id", "text", "w", covered.alias("r"), lines.alias("l"))
    return step.select(
        F.col("id").alias(id_col),
        F.size("w").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("w", "")).cast("bigint").alias("word_chars"),
        F.char_length(F.regexp_replace("text", SYMBOLS, "")).cast("bigint").alias("n_symbols"),
        F.size("l").cast("bigint").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("bigint").alias("n_dup_lines"),
        F.col("r").cast("bigint").alias("n_repeat_words"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct_words"),
    )


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, measurements, fail_bits)."""
    if len(rules) > 63:
        raise ValueError("a ledger holds 63 rules at most")
    failed = F.lit(0).cast("bigint")
    for i, rule in enumerate(rules):
        failed = failed.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint"))
    return measured(docs, id_col, text_col).withColumn("fail_bits", failed)


def passes(mask: int) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")) == 0


def apply_policy(rows: DataFrame, version: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """A ledger with ``kept``: no rule of the policy fails."""
    return rows.withColumn("kept", passes(bits(POLICIES[version], rules)))


def ablations(rows: DataFrame, version: str = CURRENT, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(version, rule, n_failed, n_failed_alone, n_kept_without) for each rule of a policy."""
    mask = bits(POLICIES[version], rules)
    counts = rows.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("bigint")).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    listed = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(bits((n,), rules)).cast("bigint").alias("bit")) for n in POLICIES[version]]))
    spread = counts.select("b", "n", listed.alias("r")).select("b", "n", "r.*")
    set_ = F.col("b").bitwiseAND(F.col("bit")) != 0
    alone = F.col("b") == F.col("bit")

    def total(where: Column) -> Column:
        return F.sum(F.when(where, F.col("n")).otherwise(F.lit(0)))

    return spread.groupBy("rule").agg(
        total(set_).alias("n_failed"), total(alone).alias("n_failed_alone"), total(alone | (F.col("b") == 0)).alias("n_kept_without")
    ).select(F.lit(version).alias("version"), "rule", "n_failed", "n_failed_alone", "n_kept_without")
