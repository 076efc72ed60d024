"""Queries over weight tables (``embeddings``: label = tensor, vec_id = row or step)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import lr_mul
from ..functions.vectors import coarsen, prune_levels
from ..operators.matrices import (
    POLICIES,
    abs_max,
    averaged_steps,
    clip_search,
    dequantise,
    ema_checkpoints,
    matrix_quantiles as tensor_quantiles,
    mean_checkpoints,
    prune,
    quant_error,
    quantise,
    quantise_vectors,
    route_matrices,
    size_accounting,
)
from ..operators.order import running_offsets
from ..schema import EMA_DECAY, PRUNE_QUANTILE
from .tables import matrices, r, table, weighted_sum

# Values are scaled by a power of two (exact in floats), so that some rows lie
# above and some below the scale floor.
SCALE_UP = 4.0
# Weight names the rows of a label stand for.
NAMES = (
    "tok_emb.weight",
    "blocks.%d.attn.c_q.weight",
    "blocks.%d.attn.c_k.weight",
    "blocks.%d.attn.proj.weight",
    "blocks.%d.mlp.fc.weight",
    "blocks.%d.mlp.proj.weight",
    "blocks.%d.attn.q_gain",
    "skip_weights",
    "bigram.proj.weight",
    "lm_head.weight",
)
LAYERS = 12
# Small tensors that only some runs keep in full precision; in place of every fourth bigram weight.
CONTROLS = ("bigram.proj.weight", "bigram.scale", "smear.gate", "ve_shared.scale")


def weights(spark, sf) -> DataFrame:
    return matrices(spark, sf).withColumn(
        "values", F.transform("values", lambda v: (v * F.lit(SCALE_UP).cast("float")).cast("float"))
    )


def _levels(df: DataFrame) -> DataFrame:
    return df.select("tensor", "row_id", r("scale", 9).alias("scale"), weighted_sum(F.col("q")).alias("wsum_q"))


def row_quant_int8(spark, sf):
    return _levels(quantise(weights(spark, sf), "percentile", 127))


def row_quant_int6(spark, sf):
    return _levels(quantise(weights(spark, sf), "percentile", 31))


def row_quant_absmax(spark, sf):
    return _levels(quantise(weights(spark, sf), "absmax", 31))


def row_quant_absmax_int5(spark, sf):
    return _levels(quantise(weights(spark, sf), "absmax", 15))


def row_quant_floored(spark, sf):
    return _levels(quantise(weights(spark, sf), "absmax_floored", 31))


def vector_quant(spark, sf):
    return _levels(quantise_vectors(weights(spark, sf)))


def dequant_error(spark, sf):
    out = None
    for name, method, limit in (("int8", "percentile", 127), ("int6", "absmax", 31), ("int5", "absmax", 15)):
        errors = quant_error(quantise(weights(spark, sf), method, limit)).withColumn("scheme", F.lit(name))
        out = errors if out is None else out.unionByName(errors)
    return out.select("scheme", "tensor", r("mse", 9).alias("mse"), r("max_error").alias("max_error"))


def dequantised_rows(spark, sf):
    """Levels joined with their metadata: some tensors pass through, some have none."""
    q = quantise(weights(spark, sf), "absmax", 31)
    label = F.substring_index("tensor", "_", -1).cast("int")
    meta = weights(spark, sf).select("tensor").distinct().filter(label % 3 != 0)
    meta = meta.withColumn("scheme", F.when(label % 3 == 1, "passthrough").otherwise("int6"))
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + v)
    return dequantise(q, meta).select("tensor", "row_id", "scheme", r(total).alias("total"))


def clip_search_matrix(spark, sf):
    return clip_search(weights(spark, sf)).select("tensor", "pct", r("mse", 9).alias("mse"))


def clip_search_rows(spark, sf):
    return clip_search(weights(spark, sf), scope="row").select("tensor", "row_id", "pct", r("mse", 9).alias("mse"))


def prune_quantile(spark, sf):
    # The smallest tensors are left alone.
    out = prune(weights(spark, sf), PRUNE_QUANTILE, min_numel=3_000)
    zeros = F.size(F.filter("values", lambda v: v == 0.0)).cast("bigint")
    total = F.aggregate("values", F.lit(0.0), lambda a, v: a + F.abs(v))
    return out.select("tensor", "row_id", zeros.alias("zeros"), r(total).alias("abs_total"))


def pruned_levels(spark, sf):
    q = quantise(weights(spark, sf), "percentile", 127)
    kept = prune_levels(F.col("q"), 0.1)
    return q.select("tensor", "row_id", weighted_sum(kept).alias("wsum_q"))


def step_rounding(spark, sf):
    q = quantise(weights(spark, sf), "percentile", 127)
    return q.select(
        "tensor",
        "row_id",
        weighted_sum(coarsen(F.col("q"), 4, -128, 124)).alias("wsum_step4"),
        weighted_sum(coarsen(F.col("q"), 16)).alias("wsum_step16"),
    )


def matrix_quantiles(spark, sf):
    mats = weights(spark, sf)
    top = abs_max(mats, "matrix")
    both = tensor_quantiles(mats, [0.03, 0.999]).join(top, "tensor")
    q03, q999 = (r(F.col("quantiles")[i], 9) for i in (0, 1))
    return both.select("tensor", "n", q03.alias("q03"), q999.alias("q999"), r("abs_max", 9).alias("abs_max"))


def named_tensors(spark, sf) -> DataFrame:
    """One weight tensor per row of ``embeddings``, with a name and a size made from it."""
    e = table(spark, sf, "embeddings")
    label, vec = F.col("label"), F.col("vec_id")
    name: Column = F.lit(None).cast("string")
    for i, template in enumerate(NAMES):
        text = F.lit(template) if "%d" not in template else F.format_string(template, vec % LAYERS)
        name = F.when(label == i, text).otherwise(name)
    given = F.element_at(F.array(*[F.lit(c) for c in CONTROLS]), (vec % 4 + 1).cast("int"))
    name = F.when(name == CONTROLS[0], given).otherwise(name)
    return e.select(
        "vec_id",
        name.alias("tensor"),
        (vec % 17 != 0).alias("is_float"),
        F.when(label.isin(6, 7), 1).otherwise(2).alias("ndim"),
        (F.size("embedding") * (vec * 7 % 2003 + 1)).cast("bigint").alias("numel"),
        (vec * 7 % 2003 + 1).cast("bigint").alias("n_rows"),
        F.when(vec % 2 == 0, 4).otherwise(2).alias("width"),
    )


def matrix_routing(spark, sf):
    tensors = named_tensors(spark, sf)
    out = None
    for policy in POLICIES:
        routed = route_matrices(tensors, policy).withColumn("policy", F.lit(policy))
        out = routed if out is None else out.unionByName(routed)
    return out.select("policy", "vec_id", "tensor", "class", "layer", "scheme")


def matrix_sizes(spark, sf):
    return size_accounting(route_matrices(named_tensors(spark, sf), "int8")).withColumn("ratio", r("ratio"))


def checkpoints(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        F.concat(F.lit("tensor_"), F.col("label").cast("string")).alias("tensor"),
        F.lit(0).alias("row_id"),
        F.col("vec_id").alias("step"),
        F.col("embedding").alias("values"),
    )


def _cells(rows: DataFrame) -> DataFrame:
    return rows.select("tensor", F.posexplode("values").alias("pos", "v")).select("tensor", "pos", r("v").alias("v"))


def checkpoint_mean(spark, sf):
    taken = averaged_steps(checkpoints(spark, sf), lr_mul(F.col("step"), F.lit(0), 2000, 1900, None), 0.99, 5)
    return _cells(mean_checkpoints(taken))


def checkpoint_ema(spark, sf):
    one = checkpoints(spark, sf).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_offsets(one, "_one", "step", ["tensor"], ordinal="seq", offset="_o").drop("_one", "_o")
    return _cells(ema_checkpoints(ranked, EMA_DECAY))


QUERIES = {
    "row_quant_int8": row_quant_int8,
    "row_quant_int6": row_quant_int6,
    "row_quant_absmax_c31": row_quant_absmax,
    "row_quant_absmax_c15": row_quant_absmax_int5,
    "row_quant_floored": row_quant_floored,
    "vector_quant": vector_quant,
    "dequant_error": dequant_error,
    "dequantised_rows": dequantised_rows,
    "clip_search": clip_search_matrix,
    "clip_search_rows": clip_search_rows,
    "prune_quantile": prune_quantile,
    "prune_levels": pruned_levels,
    "step_rounding": step_rounding,
    "matrix_quantile": matrix_quantiles,
    "matrix_routing": matrix_routing,
    "size_accounting": matrix_sizes,
    "checkpoint_mean": checkpoint_mean,
    "checkpoint_ema": checkpoint_ema,
}
