"""Mixing sources to target weights by capped water-filling.

Sizes are summed by source. ``share`` of all sizes is dealt to the sources by weight;
a source whose part would exceed ``max_epochs`` times its size is clamped there, and
what is left is dealt again among the others, until no part is above its clamp. A
source's target over its size is the number of epochs: every document is taken whole
for the whole epochs, and for the fraction those with the smallest seeded hash are
taken once more, up to the document at which the target is met most nearly.

The hash border is found by counting words in 65,536 hash ranges a source and then,
in two more passes, within the border range only, so no source is ever sorted or
gathered. Rows of equal hash (the same id and text) are told apart by their place in the
input: if several stand at the border, more passes find how many of them are taken. Which
ones these are makes no difference to the mix.

Nulls: a null text has size 0; a null source is a source of its own, the last; a null
doc_id is hashed as such. Sources of size 0 have target 0. If all sources are clamped,
targets are the clamps. Ties, repeated rows and very long texts need no special care. Give a
table, or a DataFrame made durable: it is read twice, and places must agree. An empty table gives an empty result. Other columns are ignored by ``plan`` and kept by
``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.order import dense_ordinals
from ..session import durable
from .common import WORD, fresh, stored

DIGITS = 12  # hexadecimal digits of the hash that count
PLACE = 16  # and of the row's place behind them
STEP = 4  # digits settled by one pass: 16^4 ranges


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("bigint")


def seeded_hash(seed: int, doc_id: Column, text: Column) -> Column:
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit("?")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.concat(F.substring(F.md5(key.cast("binary")), 1, DIGITS), F.lpad(F.hex(F.monotonically_increasing_id()), PLACE, "0"))


def targets(sizes: DataFrame, *, share: tuple[int, int] = (3, 2), max_epochs: int = 2) -> DataFrame:
    """``sizes`` (source, weight, source_size; integers) with column ``target``.

    ``share`` is the fraction of all sizes to deal, as numerator and denominator. Each
    round clamps every source above its clamp, so there are at most as many rounds as
    sources, and no row leaves the executors but the sums.
    """
    table = sizes.withColumn("cap", F.col("source_size") * max_epochs)
    exact = "decimal(38,0)"
    clamped = F.lit(False)
    settled = -1
    while True:
        free = ~clamped
        row = table.agg(
            F.sum(F.col("source_size").cast(exact)).alias("all"),
            F.sum(F.when(clamped, F.col("cap")).cast(exact)).alias("held"),
            F.sum(F.when(free, F.col("weight")).cast(exact)).alias("weights"),
            F.count(F.when(clamped, 1)).alias("n"),
        ).first()
        left = share[0] * int(row["all"] or 0) - share[1] * int(row["held"] or 0)  # share[1] times what is left
        weights = int(row["weights"] or 0)
        if row["n"] == settled or not weights:
            break
        settled = row["n"]
        # cap < weight * left / (share[1] * weights), in whole numbers
        above = F.col("cap").cast(exact) * F.lit(share[1] * weights).cast(exact) < F.col("weight").cast(exact) * F.lit(left).cast(exact)
        clamped = clamped | above
    level = F.lit(float(left)) / F.lit(float(share[1] * weights)) if weights else F.lit(0.0)
    return table.withColumn("target", F.when(clamped, F.col("cap").cast("double")).otherwise(F.col("weight") * level)).drop("cap")


def cyclic_weights(sizes: DataFrame, weights: tuple[int, ...]) -> DataFrame:
    """Weights by the order of the sources, by code point with null last, repeating."""
    ranked = dense_ordinals(sizes.withColumn("none", F.col("source").isNull()), ["none", "source"], ordinal="place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    return ranked.withColumn("weight", weight.cast("bigint")).select("source", "source_size", "weight")


def _borders(sized: DataFrame, needs: DataFrame) -> DataFrame:
    """(source, border, inclusive): the hash at which a source's need is met, and
    whether its documents are still taken."""
    found = needs
    for done in range(0, DIGITS + PLACE, STEP):
        if done >= DIGITS and found.filter("rows > 1").isEmpty():
            break
        ranged = sized.select("source", F.substring("hash", 1, done).alias("prefix"), F.substring("hash", 1, done + STEP).alias("range"), "size")
        if done:  # rows of the border ranges only; the prefix spreads a large source
            open_ = found.select(F.col("source").alias("s"), F.col("range").alias("p"))
            ranged = ranged.join(open_, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p")), "left_semi")
        counted = ranged.groupBy("source", "range").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
        need = found.select(F.col("source").alias("s"), "need")
        order = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        left = F.col("need") - F.coalesce(F.sum("words").over(order), F.lit(0))
        met = counted.join(need, F.col("source").eqNullSafe(F.col("s"))).select("source", "range", "words", "rows", left.alias("need"))
        last = F.max(F.struct("range", "need", "words", "rows")).alias("r")
        found = durable(met.filter("need > 0").groupBy("source").agg(last).select("source", "r.*"))
    return found.select("source", F.col("range").alias("border"), (F.col("words") / 2 <= F.col("need")).alias("inclusive"))


def source_plan(docs: DataFrame, *, weights: tuple[int, ...] = (3, 1, 2), share: tuple[int, int] = (3, 2), max_epochs: int = 2, seed: int = 17) -> DataFrame:
    """(source, source_size, target, whole, border, inclusive): what decides about every document."""
    sized = durable(docs.select("source", size_of(F.col("text")).alias("size"), seeded_hash(seed, F.col("doc_id"), F.col("text")).alias("hash")))
    sources = durable(sized.groupBy("source").agg(F.sum("size").alias("source_size")))
    aimed = targets(cyclic_weights(sources, weights), share=share, max_epochs=max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    aimed = aimed.withColumn("whole", whole)
    aimed = durable(aimed.withColumn("need", F.col("target") - F.col("whole") * F.col("source_size")))
    borders = _borders(sized, aimed.filter("need > 0").select("source", "need"))
    to = aimed.alias("a").join(borders.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left")
    # As a table its size is known: Spark sends it to all tasks, or joins by shuffle.
    return stored(to.select("a.source", "a.source_size", "a.target", "a.whole", "b.border", "b.inclusive"), "sources")


def _decide(docs: DataFrame, table: DataFrame, seed: int, *columns: Column) -> DataFrame:
    name = fresh(docs, "_hash")[0]
    keyed = docs.withColumn(name, seeded_hash(seed, F.col("doc_id"), F.col("text"))).alias("d")
    own = F.substring(F.col(f"d.{name}"), F.lit(1), F.length("t.border"))
    more = (own < F.col("t.border")) | ((own == F.col("t.border")) & F.col("t.inclusive"))
    times = F.col("t.whole") + F.coalesce(more, F.lit(False)).cast("bigint")
    return keyed.join(table.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select(*columns, times.alias(fresh(docs, "_times")[0]))


def plan(docs: DataFrame, *, seed: int = 17, **settings) -> DataFrame:
    """(doc_id, size, source_size, target, times): how often each document is taken."""
    table = source_plan(docs, seed=seed, **settings)
    columns = (F.col("d.doc_id"), size_of(F.col("d.text")).alias("size"), F.col("t.source_size"), F.col("t.target"))
    return _decide(docs.select("doc_id", "source", "text"), table, seed, *columns).withColumnRenamed("_times", "times")


def mix(docs: DataFrame, *, seed: int = 17, **settings) -> DataFrame:
    """The rows of ``docs``, each as many times as the mix takes it."""
    table = source_plan(docs, seed=seed, **settings)
    times, copy = fresh(docs, "_times", "_copy")
    taken = _decide(docs, table, seed, *[F.col(f"d.`{c}`") for c in docs.columns])
    copies = F.explode(F.array_repeat(F.lit(True), F.col(times).cast("int")))
    return taken.withColumn(copy, copies).select(*[f"`{c}`" for c in docs.columns])
