"""DuckDB forms of the weight-table queries."""

from __future__ import annotations

from ..schema import CLIP_CANDIDATES, CLIP_QUANTILE, EMA_DECAY
from .matrix_queries import SCALE_UP

X = f"""m AS (SELECT 'tensor_' || label AS tensor, vec_id::INTEGER AS row_id, embedding AS v FROM embeddings),
x AS (SELECT tensor, row_id, (unnest(v) * {SCALE_UP}::FLOAT)::DOUBLE AS val, unnest(range(len(v))) AS pos FROM m)"""


def f32(e: str) -> str:
    return f"(({e})::FLOAT::DOUBLE)"


def f16(e: str) -> str:
    ulp = f"pow(2.0::DOUBLE, greatest(floor(log2(greatest(abs({e}), pow(2.0::DOUBLE, -14)))), -14) - 10)"
    return f"(round_even(({e}) / {ulp}, 0)::DOUBLE * {ulp})"


def half_even(e: str) -> str:
    return f"round_even({e}, 0)::DOUBLE"


def clamp(e: str, low: int, high: int) -> str:
    return f"least(greatest({e}, {low}), {high})"


def percentile_levels(limit: int) -> str:
    """c: clip per row; s: raw and stored scale; q: levels."""
    return f"""WITH {X},
c AS (SELECT tensor, row_id, {f32(f'quantile_cont(abs(val), {CLIP_QUANTILE!r})')} AS clip FROM x GROUP BY ALL),
s AS (SELECT *, {f32(f'greatest(clip / {limit}, 1.0::DOUBLE / {limit})')} AS raw FROM c),
q AS (SELECT x.*, clip, raw, {clamp(half_even(f32('least(greatest(val, -clip), clip) / raw')), -limit, limit)}::INTEGER AS q,
             {f16('raw')} AS scale FROM x JOIN s USING (tensor, row_id))"""


def absmax_levels(limit: int, floored: bool = False) -> str:
    floor = f"1.0::DOUBLE / {limit}" if floored else "1e-12::DOUBLE"
    low = -limit if floored else -limit - 1
    stored = f16(f32(f"greatest(a / {limit}, {floor})"))
    return f"""WITH {X},
c AS (SELECT tensor, row_id, max(abs(val)) AS a FROM x GROUP BY ALL),
s AS (SELECT *, greatest({stored}, pow(2.0::DOUBLE, -14)) AS scale FROM c),
q AS (SELECT x.*, scale, {clamp(half_even(f32('val / scale')), low, limit)}::INTEGER AS q FROM x JOIN s USING (tensor, row_id))"""


LEVELS = """
SELECT tensor, row_id, round(any_value(scale), 9) AS scale, sum(q * (pos + 1))::BIGINT AS wsum_q FROM q GROUP BY ALL"""


def errors(name: str, levels: str) -> str:
    recon = f32("q * scale")
    return f"""({levels}
SELECT '{name}' AS scheme, tensor, round(avg(pow(val - {recon}, 2)), 9) AS mse, round(max(abs(val - {recon})), 6) AS max_error
FROM q GROUP BY tensor)"""


def _clip_search(scope: str) -> str:
    key = "tensor" if scope == "matrix" else "tensor, row_id"
    rows = " UNION ALL ".join(
        f"SELECT tensor, row_id, {i} AS rank, {p!r}::DOUBLE AS pct, "
        + (f32(f"quantile_cont(abs(val), {p!r})") if p < 1 else "max(abs(val))")
        + " AS clip FROM x GROUP BY ALL"
        for i, p in enumerate(CLIP_CANDIDATES)
    )
    recon = f32("q * scale")
    stored = f16(f32("greatest(clip / 31, 1.0::DOUBLE / 31)"))
    return f"""WITH {X}, c AS ({rows}),
s AS (SELECT *, {stored} AS scale FROM c),
q AS (SELECT x.tensor, x.row_id, rank, pct, val, scale, {clamp(half_even(f32('val / scale')), -31, 31)} AS q
      FROM x JOIN s ON x.tensor = s.tensor AND x.row_id = s.row_id),
e AS (SELECT {key}, rank, pct, avg(pow(val - {recon}, 2)) AS mse FROM q GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY mse, rank) AS rn FROM e)
SELECT {key}, pct, round(mse, 9) AS mse FROM o WHERE rn = 1"""


def _names() -> str:
    return f"""a AS (SELECT vec_id, CASE label WHEN 0 THEN 'tok_emb.weight' WHEN 1 THEN 'blocks.' || (vec_id % 12) || '.attn.c_q.weight'
    WHEN 2 THEN 'blocks.' || (vec_id % 12) || '.attn.c_k.weight' WHEN 3 THEN 'blocks.' || (vec_id % 12) || '.attn.proj.weight'
    WHEN 4 THEN 'blocks.' || (vec_id % 12) || '.mlp.fc.weight' WHEN 5 THEN 'blocks.' || (vec_id % 12) || '.mlp.proj.weight'
    WHEN 6 THEN 'blocks.' || (vec_id % 12) || '.attn.q_gain' WHEN 7 THEN 'skip_weights'
    WHEN 8 THEN ['bigram.proj.weight', 'bigram.scale', 'smear.gate', 've_shared.scale'][vec_id % 4 + 1] WHEN 9 THEN 'lm_head.weight' END AS tensor, vec_id % 17 <> 0 AS is_float,
  CASE WHEN label IN (6, 7) THEN 1 ELSE 2 END AS ndim, (64 * (vec_id * 7 % 2003 + 1))::BIGINT AS numel,
  (vec_id * 7 % 2003 + 1)::BIGINT AS n_rows, CASE WHEN vec_id % 2 = 0 THEN 4 ELSE 2 END AS width FROM embeddings),
b AS (SELECT *, coalesce(try_cast(regexp_extract(tensor, 'blocks\\.(\\d+)\\.', 1) AS INTEGER), -1) AS layer,
  (contains(tensor, 'attn_scale') OR contains(tensor, 'mlp_scale') OR contains(tensor, 'resid_mix') OR contains(tensor, 'q_gain') OR contains(tensor, 'skip_weight')) AS ctrl,
  contains(tensor, 'smear') AS smear, contains(tensor, 'bigram.scale') AS big_scale,
  (contains(tensor, 'dtg_gate') OR contains(tensor, 've_layer_scales') OR contains(tensor, 've_shared.scale')) AS gates FROM a),
g AS (SELECT coalesce(max(layer) FILTER (starts_with(tensor, 'blocks.')), 0) + 1 AS layers FROM b)"""


def _class(variant: str) -> str:
    big = "WHEN contains(tensor, 'bigram') THEN 'bigram'" if variant == "bigram" else ""
    return f"""CASE WHEN contains(tensor, 'tok_emb') OR contains(tensor, 'lm_head') THEN 'embed' WHEN contains(tensor, '.mlp.') THEN 'mlp'
 {big} WHEN contains(tensor, '.attn.') OR contains(tensor, '.proj.') THEN 'attn' ELSE 'other' END"""


_FP16_KEEP = "contains(tensor, 'tok_emb') OR contains(tensor, 'blocks.8.attn.c_k')"
_SMALL = "CASE WHEN ctrl THEN 'passthrough_ctrl' ELSE 'passthrough_fp16' END"
_ROUTES = {
    "int8": f"CASE WHEN NOT is_float THEN 'passthrough' WHEN numel <= 65536 THEN {_SMALL} ELSE 'int8' END",
    "int8_fp16_embed": f"""CASE WHEN NOT is_float THEN 'passthrough' WHEN contains(tensor, 'tok_emb') THEN 'passthrough_fp16'
        WHEN numel <= 65536 THEN {_SMALL} ELSE 'int8' END""",
    "int6_late_keys": f"""CASE WHEN NOT is_float THEN 'passthrough' WHEN tensor = 'tok_emb.weight' THEN 'passthrough_fp16'
        WHEN ends_with(tensor, 'c_k.weight') AND layer >= greatest(layers - 2, 0) THEN 'passthrough_fp16'
        WHEN numel <= 65536 THEN {_SMALL} ELSE 'int6' END""",
    "int6_mixed": """CASE WHEN NOT is_float OR numel <= 65536 THEN 'passthrough' WHEN ctrl THEN 'passthrough_ctrl'
        WHEN class IN ('mlp', 'attn') THEN 'int6' ELSE 'int8' END""",
    "int6_mixed_smear": """CASE WHEN NOT is_float OR numel <= 65536 THEN 'passthrough' WHEN ctrl OR smear THEN 'passthrough_ctrl'
        WHEN class IN ('mlp', 'attn') THEN 'int6' ELSE 'int8' END""",
    "int6_mixed_gates": """CASE WHEN NOT is_float OR numel <= 65536 THEN 'passthrough' WHEN ctrl OR smear OR gates THEN 'passthrough_ctrl'
        WHEN class IN ('mlp', 'attn') THEN 'int6' ELSE 'int8' END""",
    "int6_mixed_fp16": f"""CASE WHEN NOT is_float OR numel <= 65536 THEN 'passthrough' WHEN ctrl OR smear OR big_scale THEN 'passthrough_ctrl'
        WHEN {_FP16_KEEP} THEN 'passthrough_fp16' WHEN class IN ('mlp', 'attn') THEN 'int6' ELSE 'int8' END""",
    "int5_mlp": f"""CASE WHEN NOT is_float OR numel <= 8192 THEN 'passthrough' WHEN ctrl OR smear OR big_scale THEN 'passthrough_ctrl'
        WHEN {_FP16_KEEP} THEN 'passthrough_fp16' WHEN class = 'mlp' THEN 'int5' WHEN class IN ('attn', 'bigram') THEN 'int6' ELSE 'int8' END""",
}


def _route(policy: str) -> str:
    cls = _class("bigram" if policy == "int5_mlp" else "plain")
    return f"""SELECT '{policy}' AS policy, vec_id, tensor, class, layer, {_ROUTES[policy]} AS scheme
FROM (SELECT *, {cls} AS class FROM b CROSS JOIN g)"""


ORACLE = {
    "row_quant_int8": percentile_levels(127) + LEVELS,
    "row_quant_int6": percentile_levels(31) + LEVELS,
    "row_quant_absmax_c31": absmax_levels(31) + LEVELS,
    "row_quant_absmax_c15": absmax_levels(15) + LEVELS,
    "row_quant_floored": absmax_levels(31, floored=True) + LEVELS,
    "vector_quant": f"""WITH {X},
c AS (SELECT tensor, quantile_cont(abs(val), {CLIP_QUANTILE!r}) AS clip FROM x GROUP BY ALL),
s AS (SELECT *, CASE WHEN clip > 0 THEN {f32('clip / 127')} ELSE 1.0 END AS scale FROM c),
q AS (SELECT x.*, scale, {clamp(half_even(f32('least(greatest(val, -clip), clip) / scale')), -127, 127)}::INTEGER AS q FROM x JOIN s USING (tensor))"""
    + LEVELS,
    "dequant_error": " UNION ALL ".join(
        [errors("int8", percentile_levels(127)), errors("int6", absmax_levels(31)), errors("int5", absmax_levels(15))]
    ),
    "dequantised_rows": absmax_levels(31)
    + f""", d AS (SELECT *, split_part(tensor, '_', 2)::INTEGER % 3 AS k FROM q)
SELECT tensor, row_id, CASE WHEN k = 1 THEN 'passthrough' ELSE 'int6' END AS scheme,
       round(sum(CASE WHEN k = 1 THEN val ELSE {f32('q * scale')} END), 6) AS total
FROM d WHERE k <> 0 GROUP BY ALL""",
    "clip_search": _clip_search("matrix"),
    "clip_search_rows": _clip_search("row"),
    "prune_quantile": f"""WITH {X},
c AS (SELECT tensor, count(*) AS n, quantile_cont(abs(val), 0.03) AS th FROM x GROUP BY ALL),
y AS (SELECT tensor, row_id, CASE WHEN n > 3000 AND abs(val) < th THEN 0.0 ELSE abs(val) END AS a FROM x JOIN c USING (tensor))
SELECT tensor, row_id, count(*) FILTER (a = 0)::BIGINT AS zeros, round(sum(a), 6) AS abs_total FROM y GROUP BY ALL""",
    "prune_levels": percentile_levels(127)
    + " SELECT tensor, row_id, sum(CASE WHEN abs(q) <= 12 THEN 0 ELSE q * (pos + 1) END)::BIGINT AS wsum_q FROM q GROUP BY ALL",
    "step_rounding": percentile_levels(127)
    + f""" SELECT tensor, row_id,
  sum({clamp(half_even('q / 4.0::DOUBLE') + ' * 4', -128, 124)}::INTEGER * (pos + 1))::BIGINT AS wsum_step4,
  sum({clamp(half_even('q / 16.0::DOUBLE') + ' * 16', -127, 127)}::INTEGER * (pos + 1))::BIGINT AS wsum_step16 FROM q GROUP BY ALL""",
    "matrix_quantile": f"""WITH {X}
SELECT tensor, count(*)::BIGINT AS n, round(quantile_cont(abs(val), 0.03), 9) AS q03, round(quantile_cont(abs(val), 0.999), 9) AS q999,
       round(max(abs(val)), 9) AS abs_max FROM x GROUP BY tensor""",
    "matrix_routing": f"WITH {_names()} " + " UNION ALL ".join(_route(p) for p in _ROUTES),
    "size_accounting": f"""WITH {_names()}, rt AS ({_route('int8')}),
z AS (SELECT b.*, class, scheme, NOT starts_with(scheme, 'passthrough') AS quantised FROM b JOIN rt USING (vec_id)),
y AS (SELECT *, CASE WHEN quantised THEN numel + CASE WHEN ndim = 2 THEN n_rows * 2 ELSE 4 END
                     WHEN NOT is_float THEN numel * width WHEN scheme = 'passthrough_ctrl' THEN numel * 4 ELSE numel * 2 END AS payload FROM z)
SELECT CASE WHEN grouping(class) = 1 THEN 'total' ELSE class END AS class, sum(numel)::BIGINT AS param_count, count(*)::BIGINT AS num_tensors,
       count(*) FILTER (is_float AND quantised)::BIGINT AS num_float_tensors, count(*) FILTER (NOT is_float)::BIGINT AS num_nonfloat_tensors,
       sum(numel * width)::BIGINT AS raw_bytes, sum(payload)::BIGINT AS payload_bytes,
       round(sum(numel * width)::DOUBLE / greatest(sum(payload), 1), 6) AS ratio
FROM y GROUP BY ROLLUP (class)""",
    "checkpoint_mean": """WITH e AS (SELECT 'tensor_' || label AS tensor, vec_id AS step, embedding AS v FROM embeddings
  WHERE vec_id % 5 = 0 AND vec_id >= 100 AND vec_id < 2000 AND greatest((2000 - vec_id) / 1900.0::DOUBLE, 0) < 0.99),
x AS (SELECT tensor, unnest(v)::DOUBLE AS val, unnest(range(len(v)))::INTEGER AS pos FROM e)
SELECT tensor, pos, round(avg(val), 6) AS v FROM x GROUP BY ALL HAVING count(*) > 1""",
    "checkpoint_ema": f"""WITH e AS (SELECT 'tensor_' || label AS tensor, embedding AS v,
   row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) - 1 AS n FROM embeddings),
x AS (SELECT tensor, i, n, unnest(v)::DOUBLE AS val, unnest(range(len(v)))::INTEGER AS pos FROM e)
SELECT tensor, pos, round(sum(val * pow({EMA_DECAY}::DOUBLE, n - i) * CASE WHEN i = 0 THEN 1.0::DOUBLE ELSE 1 - {EMA_DECAY}::DOUBLE END), 6) AS v
FROM x GROUP BY ALL""",
}
