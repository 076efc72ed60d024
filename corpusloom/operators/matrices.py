"""Weight tables: routing, quantisation, pruning, size accounting, averaging.

A matrix is a set of rows (tensor, row_id, values). Row-level work is done on whole
Arrow batches, never with a row per value; matrix-level values come from mergeable
aggregates, so a tensor that holds most of the rows is still reduced on the map side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import (
    clamp,
    fp16,
    fp32,
    has_any,
    layer_number,
    matrix_class,
    scale_as,
)
from ..schema import (
    ABSMAX_FLOOR,
    CLIP_CANDIDATES,
    CLIP_QUANTILE,
    CONTROL_NAME_PATTERNS,
    FP16_SMALLEST_NORMAL,
    KEEP_FLOAT_MAX_NUMEL,
    PRUNE_QUANTILE,
)
from ..functions.vectors import BITS_PER_PASS, cut_below, leading_bits, levels, restore, round_trip_error, row_quantiles, trial_errors, value_of_bits, vector_sums
from ..session import durable, small_side

# Routing policies of the archived runs. ``small`` is the largest
# kept-in-float size, ``fp16`` / ``fp16_names`` the tensors kept in half
# precision, ``low`` the class -> scheme map, ``rest`` everything else, and
# ``control_first`` whether control names win over size.
POLICIES: dict[str, dict] = {
    "int8": {"small": 65_536, "rest": "int8"},
    "int8_fp16_embed": {"small": 65_536, "fp16": ["tok_emb"], "rest": "int8"},
    "int6_late_keys": {"small": 65_536, "fp16_names": ["tok_emb.weight"], "late_keys": True, "rest": "int6"},
    "int6_mixed": {"small": 65_536, "control": True, "low": {"mlp": "int6", "attn": "int6"}, "rest": "int8"},
    "int6_mixed_fp16": {
        "small": 65_536,
        "control": True,
        "control_names": ["smear", "bigram.scale"],
        "fp16": ["tok_emb", "blocks.8.attn.c_k"],
        "low": {"mlp": "int6", "attn": "int6"},
        "rest": "int8",
    },
    "int6_mixed_smear": {
        "small": 65_536,
        "control": True,
        "control_names": ["smear"],
        "low": {"mlp": "int6", "attn": "int6"},
        "rest": "int8",
    },
    "int6_mixed_gates": {
        "small": 65_536,
        "control": True,
        "control_names": ["smear", "dtg_gate", "ve_layer_scales", "ve_shared.scale"],
        "low": {"mlp": "int6", "attn": "int6"},
        "rest": "int8",
    },
    "int5_mlp": {
        "small": 8_192,
        "control": True,
        "control_names": ["smear", "bigram.scale"],
        "fp16": ["tok_emb", "blocks.8.attn.c_k"],
        "low": {"mlp": "int5", "attn": "int6", "bigram": "int6"},
        "variant": "bigram",
        "rest": "int8",
    },
}


def abs_max(mats: DataFrame, per: str = "row") -> DataFrame:
    """Largest absolute value per row or per matrix."""
    top = F.array_max(F.transform("values", lambda v: F.abs(v.cast("double"))))
    rows = mats.select("tensor", "row_id", top.alias("abs_max"))
    return rows if per == "row" else rows.groupBy("tensor").agg(F.max("abs_max").alias("abs_max"))


def matrix_quantiles(mats: DataFrame, qs: Sequence[float]) -> DataFrame:
    """Exact linear-interpolation quantiles of |value| per tensor: (tensor, n, quantiles).

    The bits of a magnitude are a whole number of the same order. Values are counted by
    their leading 16 bits; the counts tell in which of these classes every wanted rank
    lies, and the next pass counts the next 16 bits there, until all bits are known: two
    passes for single precision, four for double, for all ranks of all tensors at once.
    Only counts are shuffled, at most 2^16 a tensor and rank.
    """
    values = mats.select("tensor", "values")
    width = 64 if values.schema["values"].dataType.elementType.simpleString() == "double" else 32
    if width == 32:
        values = values.withColumn("values", F.col("values").cast("array<float>"))
    rank = lambda q: F.lit(float(q)) * (F.col("n") - 1)
    open_, counted = None, values
    for drop in range(width - BITS_PER_PASS, -1, -BITS_PER_PASS):
        counts = leading_bits(counted, drop)
        if open_ is None:
            counts = durable(counts)
            sizes = counts.groupBy("tensor").agg(F.sum("c").alias("n"))
            ranks = []
            for i, q in enumerate(qs):
                low = F.floor(rank(q))
                for side, at in ((0, low), (1, F.least(low + 1, F.col("n") - 1))):
                    ranks.append(F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), at.alias("rank")))
            open_ = sizes.select("tensor", "n", F.lit(0).cast("bigint").alias("above"), F.inline(F.array(*ranks)))
        # Bounded groups: 2^16 counts below one entry.
        order = Window.partitionBy("tensor", "above").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)
        ranked = counts.withColumn("below", F.coalesce(F.sum("c").over(order), F.lit(0)))
        inside = (F.col("below") <= F.col("rank")) & (F.col("rank") < F.col("below") + F.col("c"))
        found = ranked.join(open_, ["tensor", "above"]).filter(inside)
        open_ = durable(found.select("tensor", "n", F.col("prefix").alias("above"), "i", "side", (F.col("rank") - F.col("below")).alias("rank")))
        entries = open_.groupBy("tensor").agg(F.collect_set("above").alias("above"))  # two a quantile at most
        counted = values.join(small_side(entries), "tensor") if drop else None
    ends = open_.select("tensor", "n", "i", "side", value_of_bits(F.col("above"), width).alias("v"))
    side = lambda i, s: F.max(F.when((F.col("i") == i) & (F.col("side") == s), F.col("v")))
    wide = ends.groupBy("tensor", "n").agg(*[side(i, s).alias(f"v{i}_{s}") for i in range(len(qs)) for s in (0, 1)])
    between = [F.col(f"v{i}_0") + (F.col(f"v{i}_1") - F.col(f"v{i}_0")) * (rank(q) - F.floor(rank(q))) for i, q in enumerate(qs)]
    return wide.select("tensor", "n", F.array(*between).alias("quantiles"))


def matrix_quantile(mats: DataFrame, q: float) -> DataFrame:
    """One of ``matrix_quantiles``: (tensor, n, quantile)."""
    return matrix_quantiles(mats, [q]).select("tensor", "n", F.col("quantiles")[0].alias("quantile"))


# --- quantisation ---------------------------------------------------------------------


def quantise(mats: DataFrame, method: str = "percentile", limit: int = 127, scale_dtype: str = "float16") -> DataFrame:
    """Row-wise quantisation: adds ``scale`` (as stored) and ``q``.

    percentile  clip to the row's 99.99984 % quantile; scale floored at 1/limit;
                levels use the scale before it is rounded for storage
    absmax      scale = |row|max / limit, rounded first; levels in [-limit-1, limit]
    absmax_floored  as absmax with the floor 1/limit and symmetric levels
    """
    exact = scale_dtype == "double"
    if method == "percentile":
        clip = row_quantiles(F.col("values"), [CLIP_QUANTILE])[0]
        out = mats.withColumn("clip_abs", clip if exact else fp32(clip))
        raw = F.greatest(F.col("clip_abs") / limit, F.lit(1.0) / limit)
        out = out.withColumn("_raw", raw if exact else fp32(raw))
        out = out.withColumn("q", levels(F.col("values"), F.col("_raw"), -limit, limit, F.col("clip_abs"), exact))
        return out.withColumn("scale", scale_as(F.col("_raw"), scale_dtype)).drop("_raw")
    top = F.array_max(F.transform("values", lambda v: F.abs(v.cast("double"))))
    out = mats.withColumn("clip_abs", top)
    ratio = F.col("clip_abs") / limit
    if method == "absmax":
        scale = scale_as(F.greatest(ratio, F.lit(ABSMAX_FLOOR)), scale_dtype)
        scale = F.greatest(scale, F.lit(FP16_SMALLEST_NORMAL)) if scale_dtype == "float16" else scale
        low = -limit - 1
    elif method == "absmax_floored":
        scale = scale_as(F.greatest(ratio, F.lit(1.0) / limit), scale_dtype)
        low = -limit
    else:
        raise ValueError(f"unknown method {method!r}")
    out = out.withColumn("scale", scale)
    return out.withColumn("q", levels(F.col("values"), F.col("scale"), low, limit, None, exact))


def quantise_vectors(mats: DataFrame, limit: int = 127) -> DataFrame:
    """One single-precision scale per tensor, without a floor; 1.0 for an all-zero tensor."""
    clips = matrix_quantile(mats, CLIP_QUANTILE).select("tensor", F.col("quantile").alias("clip_abs"))
    scale = F.when(F.col("clip_abs") > 0, fp32(F.col("clip_abs") / limit)).otherwise(F.lit(1.0))
    joined = mats.join(small_side(clips), "tensor").withColumn("scale", scale)
    return joined.withColumn("q", levels(F.col("values"), F.col("scale"), -limit, limit, F.col("clip_abs")))


def dequantise(q: DataFrame, meta: DataFrame, strict: bool = False) -> DataFrame:
    """Levels joined with (tensor, scheme, dtype). Rows without metadata are dropped,
    or fail the query in ``strict`` mode. Passthrough rows keep their values."""
    known = q.join(meta.select("tensor", "scheme"), "tensor", "left" if strict else "inner")
    if strict:
        missing = F.raise_error(F.concat(F.lit("no metadata for "), F.col("tensor"))).cast("string")
        known = known.withColumn("scheme", F.coalesce("scheme", missing))
    kept = F.transform("values", lambda v: v.cast("double"))
    return known.withColumn(
        "values", F.when(F.col("scheme").startswith("passthrough"), kept).otherwise(restore(F.col("q"), F.col("scale")))
    ).select("tensor", "row_id", "scheme", "values")


def quant_error(quantised: DataFrame, by: Sequence[str] = ("tensor",), exact: bool = False) -> DataFrame:
    """Mean squared and largest absolute round-trip error."""
    error = round_trip_error(F.col("values"), F.col("q"), F.col("scale"), exact)
    rows = quantised.select(*by, error.alias("_e"), F.size("values").alias("_n"))
    return rows.groupBy(*by).agg((F.sum("_e.total") / F.sum("_n")).alias("mse"), F.max("_e.worst").alias("max_error"))


def clip_search(
    mats: DataFrame,
    pcts: Sequence[float] = CLIP_CANDIDATES,
    limit: int = 31,
    scope: str = "matrix",
    scale_dtype: str = "float16",
) -> DataFrame:
    """Clip percentile with the least mean squared error, earliest on ties.

    ``scope="matrix"`` picks one percentile per tensor, ``"row"`` one per row. A row is
    sorted once for all candidates; sums are combined on the map side.
    """
    exact = scale_dtype == "double"
    clips = row_quantiles(F.col("values"), [min(p, 1.0) for p in pcts])
    scale = lambda c: scale_as(F.greatest((c if exact else fp32(c)) / limit, F.lit(1.0) / limit), scale_dtype)
    key = ["tensor"] if scope == "matrix" else ["tensor", "row_id"]
    rows = mats.filter(F.size("values") > 0).select(*key, "values", F.transform(clips, scale).alias("_s"))
    errors = rows.select(*key, F.size("values").alias("_n"), trial_errors(F.col("values"), F.col("_s"), limit, exact).alias("_e"))
    sums = errors.groupBy(*key).agg(F.sum("_n").alias("_n"), *[F.sum(F.col("_e")[i]).alias(f"_e{i}") for i in range(len(pcts))])
    choices = [
        F.struct((F.col(f"_e{i}") / F.col("_n")).alias("mse"), F.lit(i).alias("rank"), F.lit(float(p)).alias("pct")) for i, p in enumerate(pcts)
    ]
    best = sums.select(*key, F.array_min(F.array(*choices)).alias("b"))
    return best.select(*key, F.col("b.pct").alias("pct"), F.col("b.mse").alias("mse"))


# --- pruning -----------------------------------------------------------------------------


def prune(mats: DataFrame, q: float = PRUNE_QUANTILE, min_numel: int = KEEP_FLOAT_MAX_NUMEL) -> DataFrame:
    """Zero the values below the tensor's q-quantile of |value|, for tensors larger
    than ``min_numel``."""
    limits = matrix_quantile(mats, q).select("tensor", "n", F.col("quantile").alias("threshold"))
    # Nothing is below zero, so small tensors keep all their values.
    limit = F.when(F.col("n") > min_numel, F.col("threshold")).otherwise(F.lit(0.0))
    joined = mats.join(small_side(limits), "tensor")
    return joined.select("tensor", "row_id", cut_below(F.col("values"), limit).alias("values"))


# --- routing and sizes ----------------------------------------------------------------------


def layers_total(tensors: DataFrame) -> DataFrame:
    """One row: highest layer number + 1."""
    started = F.when(F.col("tensor").startswith("blocks."), layer_number(F.col("tensor")))
    return tensors.agg((F.coalesce(F.max(started), F.lit(0)) + 1).alias("layers"))


def route_matrices(tensors: DataFrame, policy: str | dict) -> DataFrame:
    """Storage scheme of every tensor (tensor, is_float, ndim, numel): adds
    ``class``, ``layer`` and ``scheme``."""
    rules = POLICIES[policy] if isinstance(policy, str) else policy
    name = F.col("tensor")
    control = has_any(name, [*CONTROL_NAME_PATTERNS, *rules.get("control_names", [])])
    cls = matrix_class(name, rules.get("variant", "plain"))
    scheme = F.when(~F.col("is_float"), "passthrough")
    layer = layer_number(name)
    fp16_rule = name.isin(rules["fp16_names"]) if rules.get("fp16_names") else F.lit(False)
    if rules.get("late_keys"):
        layers = layers_total(tensors).scalar()
        fp16_rule = fp16_rule | (name.endswith("c_k.weight") & (layer >= F.greatest(layers - 2, F.lit(0))))
    if not rules.get("control"):
        # These runs test the fp16 names before the size.
        for pattern in rules.get("fp16", []):
            fp16_rule = fp16_rule | name.contains(pattern)
        scheme = scheme.when(fp16_rule, "passthrough_fp16")
        small = F.when(control, "passthrough_ctrl").otherwise("passthrough_fp16")
        scheme = scheme.when(F.col("numel") <= rules["small"], small)
    else:
        scheme = scheme.when(F.col("numel") <= rules["small"], "passthrough")
        scheme = scheme.when(control, "passthrough_ctrl")
        for pattern in rules.get("fp16", []):
            fp16_rule = fp16_rule | name.contains(pattern)
        scheme = scheme.when(fp16_rule, "passthrough_fp16")
        for cls_name, low in rules.get("low", {}).items():
            scheme = scheme.when((cls == cls_name) & (F.col("ndim") >= 1), low)
    return tensors.withColumns({"class": cls, "layer": layer, "scheme": scheme.otherwise(rules["rest"])})


def size_accounting(routed: DataFrame, by: str = "class") -> DataFrame:
    """Values, tensors, raw and stored bytes per ``by`` and in total.

    Input: (tensor, is_float, ndim, numel, n_rows, width, class, scheme); ``width``
    is the bytes per value of the source type. Scales take two bytes per row of a
    matrix and four per vector.
    """
    numel, scheme = F.col("numel"), F.col("scheme")
    kept = F.when(~F.col("is_float"), numel * F.col("width")).when(scheme == "passthrough_ctrl", numel * 4).otherwise(numel * 2)
    scales = F.when(F.col("ndim") == 2, F.col("n_rows") * 2).otherwise(F.lit(4))
    payload = F.when(scheme.startswith("passthrough"), kept).otherwise(numel + scales)
    quantised = ~scheme.startswith("passthrough")
    sums = routed.rollup(by).agg(
        F.grouping(by).alias("_all"),
        F.sum(numel).cast("bigint").alias("param_count"),
        F.count(F.lit(1)).alias("num_tensors"),
        F.count_if(F.col("is_float") & quantised).alias("num_float_tensors"),
        F.count_if(~F.col("is_float")).alias("num_nonfloat_tensors"),
        F.sum(numel * F.col("width")).cast("bigint").alias("raw_bytes"),
        F.sum(payload).cast("bigint").alias("payload_bytes"),
    )
    return sums.withColumn(by, F.when(F.col("_all") == 1, "total").otherwise(F.col(by))).drop("_all").withColumn(
        "ratio", F.col("raw_bytes") / F.greatest(F.col("payload_bytes"), F.lit(1))
    )


# --- averaging --------------------------------------------------------------------------------


def averaged_steps(points: DataFrame, lr_scale: Column, threshold: float, every: int) -> DataFrame:
    """Steps whose checkpoint enters the uniform mean."""
    return points.filter((lr_scale < threshold) & (F.col("step") % every == 0))


def mean_checkpoints(ckpts: DataFrame) -> DataFrame:
    """Uniform mean over checkpoints (tensor, row_id, step, values), used only when
    more than one was taken. Whole vectors are added on the map side first."""
    sums = vector_sums(ckpts.select("tensor", "row_id", "values"), ["tensor", "row_id"])
    mean = F.transform("values", lambda v: v / F.col("n"))
    return sums.filter(F.col("n") > 1).select("tensor", "row_id", mean.alias("values"))


def ema_checkpoints(ckpts: DataFrame, decay: float) -> DataFrame:
    """Exponential average over steps in closed form, so no order is needed:
    weight ``d**n`` for the initial value, ``(1-d) * d**(n-i)`` for update i.

    ``ckpts`` has a dense ``seq`` from 0 (the initial value) per tensor.
    """
    last = ckpts.groupBy("tensor").agg(F.max("seq").alias("_last"))
    age = F.pow(F.lit(decay), F.col("_last") - F.col("seq"))
    weight = F.when(F.col("seq") == 0, age).otherwise(age * (1.0 - decay))
    weighted = ckpts.join(small_side(last), "tensor").select("tensor", "row_id", weight.alias("_w"), "values")
    return vector_sums(weighted, ["tensor", "row_id"]).select("tensor", "row_id", "values")


def stored(values: Column, scheme: Column) -> Column:
    """Passthrough values as stored: single precision for control tensors, else half."""
    return F.when(scheme == "passthrough_ctrl", F.transform(values, lambda v: fp32(v))).otherwise(
        F.transform(values, lambda v: fp16(v))
    )


