import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.columns import fp16
from corpusloom.functions.vectors import coarsen, prune_levels, row_quantiles
from corpusloom.operators.matrices import (
    clip_search,
    dequantise,
    ema_checkpoints,
    matrix_quantile,
    matrix_quantiles,
    mean_checkpoints,
    prune,
    quant_error,
    quantise,
    quantise_vectors,
    route_matrices,
    size_accounting,
    stored,
)

RNG = np.random.default_rng(3)
# Rows above and below the scale floor, all zero, one value, half-way values.
ROWS = {
    ("a", 0): RNG.normal(0, 3, 50).astype(np.float32),
    ("a", 1): (RNG.normal(0, 0.01, 50)).astype(np.float32),
    ("a", 2): np.zeros(50, np.float32),
    ("b", 0): np.array([127.0, -2.5, 2.5, -0.5, 0.5, 1.5, -127.0], np.float32),
    ("b", 1): np.array([-31.5, 30.5, 0.25, -0.75, 31.0, 1e-9, -1e-9], np.float32),
    ("c", 0): np.array([0.125], np.float32),
}


@pytest.fixture(scope="module")
def mats(spark):
    rows = [(t, r, [float(x) for x in v]) for (t, r), v in ROWS.items()]
    return spark.createDataFrame(rows, "tensor STRING, row_id INT, values ARRAY<FLOAT>").repartition(3)


def levels_of(df):
    return {(r["tensor"], r["row_id"]): (np.float64(r["scale"]), np.array(r["q"])) for r in df.collect()}


def test_fp16_rounding(spark):
    xs = np.concatenate([
        RNG.normal(0, 1, 400), RNG.normal(0, 1e-6, 300), RNG.normal(0, 3e4, 200), 2.0 ** np.arange(-26, 17),
        [0.0, 65504.0, 65519.99, 65520.0, -65536.0, 2049.0, 2051.0, 6.1e-5, 5.96e-8, 2.98e-8, 2.9802322387695312e-08],
    ])
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(xs)], "i INT, x DOUBLE").select("i", fp16(F.col("x")).alias("h"))
    got = np.array([r["h"] for r in df.orderBy("i").collect()])
    with np.errstate(over="ignore"):
        np.testing.assert_array_equal(got, xs.astype(np.float16).astype(np.float64))


@pytest.mark.parametrize("limit", [127, 31])
def test_percentile_levels(mats, limit):
    got = levels_of(quantise(mats, "percentile", limit))
    for key, v in ROWS.items():
        clip = np.float32(np.quantile(np.abs(v).astype(np.float64), 0.9999984))
        scale = np.float32(max(np.float32(clip / np.float32(limit)), np.float32(1.0 / limit)))
        q = np.clip(np.round(np.clip(v, -clip, clip) / scale), -limit, limit)
        assert got[key][0] == np.float64(np.float16(scale)), key
        np.testing.assert_array_equal(got[key][1], q, str(key))


@pytest.mark.parametrize("limit", [31, 15])
def test_absmax_levels(mats, limit):
    got = levels_of(quantise(mats, "absmax", limit))
    for key, v in ROWS.items():
        scale = np.float16(np.maximum(np.abs(v).max() / np.float32(limit), np.float32(1e-12)))
        scale = np.float32(max(scale, np.finfo(np.float16).tiny))
        q = np.clip(np.round(v / scale), -limit - 1, limit)
        assert got[key][0] == np.float64(scale), key
        np.testing.assert_array_equal(got[key][1], q, str(key))


def test_vector_levels(mats):
    got = levels_of(quantise_vectors(mats))
    for t in "abc":
        flat = np.concatenate([v for (k, _), v in sorted(ROWS.items()) if k == t]).astype(np.float64)
        clip = np.quantile(np.abs(flat), 0.9999984)
        for (k, r), v in ROWS.items():
            if k == t:
                scale = np.float32(clip / 127)
                assert got[k, r][0] == np.float64(scale)
                np.testing.assert_array_equal(got[k, r][1], np.clip(np.round(np.clip(v, -clip, clip).astype(np.float32) / scale), -127, 127))


def test_zero_tensor_has_scale_one(spark):
    df = spark.createDataFrame([("z", 0, [0.0, 0.0])], "tensor STRING, row_id INT, values ARRAY<FLOAT>")
    row = quantise_vectors(df).first()
    assert row["scale"] == 1.0 and row["q"] == [0, 0]


def test_round_trip_error_is_half_a_step(mats):
    q = quantise(mats, "absmax", 31)
    worst = q.select("scale", F.array_max(F.zip_with("values", "q", lambda v, k: F.abs(v.cast("double") - k * F.col("scale")))).alias("e"))
    # The stored scale is rounded to half precision, so the largest value may be off a little more.
    assert all(r["e"] <= r["scale"] * 0.55 + 1e-9 for r in worst.collect())
    errors = {r["tensor"]: r["mse"] for r in quant_error(q).collect()}
    assert set(errors) == set("abc")


@pytest.mark.parametrize("scope", ["matrix", "row"])
def test_clip_search(mats, scope):
    pcts = [0.5, 0.9, 0.999, 1.0]
    key = ["tensor"] if scope == "matrix" else ["tensor", "row_id"]
    got = {tuple(r[k] for k in key): (r["pct"], r["mse"]) for r in clip_search(mats, pcts, 31, scope).collect()}
    groups = {}
    for (t, r), v in ROWS.items():
        groups.setdefault((t,) if scope == "matrix" else (t, r), []).append(v)
    for k, rows in groups.items():
        best = None
        for p in pcts:
            err = []
            for v in rows:
                clip = np.float32(np.quantile(np.abs(v).astype(np.float64), p))
                s = np.float32(np.float16(max(np.float32(clip / np.float32(31)), np.float32(1 / 31))))
                recon = (np.clip(np.round(v / s), -31, 31).astype(np.float32) * s).astype(np.float64)
                err.append((v.astype(np.float64) - recon) ** 2)
            mse = np.concatenate(err).mean()
            if best is None or mse < best[1]:
                best = (p, mse)
        assert got[k][0] == best[0] and abs(got[k][1] - best[1]) < 1e-12, k


@pytest.mark.parametrize("q", [0.0, 0.03, 0.5, 0.9999984, 1.0])
def test_quantiles(mats, q):
    got = {r["tensor"]: r["quantile"] for r in matrix_quantile(mats, q).collect()}
    for t in "abc":
        flat = np.abs(np.concatenate([v for (k, _), v in ROWS.items() if k == t]).astype(np.float64))
        assert abs(got[t] - np.quantile(flat, q)) < 1e-12
    rows = {(r["tensor"], r["row_id"]): r["x"] for r in mats.select("tensor", "row_id", row_quantiles(F.col("values"), [q])[0].alias("x")).collect()}
    for k, v in ROWS.items():
        assert abs(rows[k] - np.quantile(np.abs(v).astype(np.float64), q)) < 1e-12


def test_pruning(mats):
    got = {(r["tensor"], r["row_id"]): r["values"] for r in prune(mats, 0.4, min_numel=14).collect()}
    flat = np.abs(np.concatenate([v for (k, _), v in ROWS.items() if k == "a"]).astype(np.float64))
    limit = np.quantile(flat, 0.4)
    for (t, r), v in ROWS.items():
        want = np.where(np.abs(v) < limit, 0.0, v) if t == "a" else v
        np.testing.assert_array_equal(got[t, r], want.astype(np.float64))


def test_level_columns(spark):
    df = spark.createDataFrame([([-127, -126, -6, -2, 0, 2, 6, 10, 12, 13, 126, 127],)], "q ARRAY<TINYINT>")
    row = df.select(coarsen(F.col("q"), 4, -128, 124).alias("c"), prune_levels(F.col("q"), 0.1).alias("p")).first()
    q = np.array([-127, -126, -6, -2, 0, 2, 6, 10, 12, 13, 126, 127])
    assert row["c"] == list(np.clip(np.round(q / 4) * 4, -128, 124).astype(int))
    assert row["p"] == [-127, -126, 0, 0, 0, 0, 0, 0, 0, 13, 126, 127]


NAMES = {
    # name: (numel, class, int8, int6_late_keys, int5_mlp)
    "tok_emb.weight": (10**6, "embed", "int8", "passthrough_fp16", "passthrough_fp16"),
    "blocks.10.attn.c_k.weight": (10**6, "attn", "int8", "passthrough_fp16", "int6"),
    "blocks.8.attn.c_k.weight": (10**6, "attn", "int8", "int6", "passthrough_fp16"),
    "blocks.9.attn.c_q.weight": (65_537, "attn", "int8", "int6", "int6"),
    "blocks.2.mlp.proj.weight": (65_536, "mlp", "passthrough_fp16", "passthrough_fp16", "int5"),
    "blocks.2.mlp_scale": (512, "other", "passthrough_ctrl", "passthrough_ctrl", "passthrough"),
    "blocks.3.attn.q_gain": (70_000, "attn", "int8", "int6", "passthrough_ctrl"),
    "bigram.proj.weight": (10**5, "attn", "int8", "int6", "int6"),
    "final.proj.weight": (10**5, "attn", "int8", "int6", "int6"),
    "lm_head.weight": (10**5, "embed", "int8", "int6", "int8"),
    "steps": (1, "other", "passthrough", "passthrough", "passthrough"),
}


def tensors(spark):
    rows = [(n, n != "steps", 2, v[0], max(v[0] // 512, 1), 4) for n, v in NAMES.items()]
    return spark.createDataFrame(rows, "tensor STRING, is_float BOOLEAN, ndim INT, numel BIGINT, n_rows BIGINT, width INT")


def test_routing(spark):
    t = tensors(spark)
    for i, policy in ((2, "int8"), (3, "int6_late_keys"), (4, "int5_mlp")):
        got = {r["tensor"]: r for r in route_matrices(t, policy).collect()}
        assert {n: r["scheme"] for n, r in got.items()} == {n: v[i] for n, v in NAMES.items()}, policy
    assert {n: r["class"] for n, r in got.items()}["bigram.proj.weight"] == "bigram"
    assert got["blocks.10.attn.c_k.weight"]["layer"] == 10 and got["steps"]["layer"] == -1


def test_sizes(spark):
    total = [r for r in size_accounting(route_matrices(tensors(spark), "int8")).collect() if r["class"] == "total"][0]
    assert total["param_count"] == sum(v[0] for v in NAMES.values()) and total["num_nonfloat_tensors"] == 1
    payload = 0
    for name, (n, _, scheme, _, _) in NAMES.items():
        rows = max(n // 512, 1)
        payload += 4 * n if name == "steps" or scheme == "passthrough_ctrl" else 2 * n if scheme.startswith("pass") else n + 2 * rows
    assert total["payload_bytes"] == payload and total["ratio"] == total["raw_bytes"] / payload


def test_dequantise_modes(spark, mats):
    q = quantise(mats, "absmax", 31)
    meta = spark.createDataFrame([("a", "int6"), ("b", "passthrough")], "tensor STRING, scheme STRING")
    got = {(r["tensor"], r["row_id"]): r["values"] for r in dequantise(q, meta).collect()}
    assert {k[0] for k in got} == {"a", "b"}
    np.testing.assert_array_equal(got["b", 0], ROWS["b", 0].astype(float))
    scale, lv = levels_of(q)["a", 0]
    np.testing.assert_array_equal(got["a", 0], (lv.astype(np.float32) * np.float32(scale)).astype(float))
    with pytest.raises(Exception, match="no metadata for c"):
        dequantise(q, meta, strict=True).collect()
    kept = spark.createDataFrame([([0.1, 70000.0], "passthrough"), ([0.1, 70000.0], "passthrough_ctrl")], "v ARRAY<DOUBLE>, s STRING")
    rows = [r[0] for r in kept.select(stored(F.col("v"), F.col("s"))).collect()]
    assert rows == [[float(np.float16(0.1)), float("inf")], [float(np.float32(0.1)), 70000.0]]


def test_averages(spark):
    steps = RNG.normal(0, 1, (6, 2, 3)).astype(np.float32)
    rows = [("t", r, i, [float(x) for x in steps[i, r]]) for i in range(6) for r in range(2)] + [("once", 0, 0, [1.0])]
    df = spark.createDataFrame(rows, "tensor STRING, row_id INT, seq INT, values ARRAY<FLOAT>").repartition(4)
    mean = {(r["tensor"], r["row_id"]): r["values"] for r in mean_checkpoints(df).collect()}
    assert set(mean) == {("t", 0), ("t", 1)}
    np.testing.assert_allclose([mean["t", 0], mean["t", 1]], steps.astype(float).mean(0), atol=1e-12)
    state = steps[0].astype(float)
    for i in range(1, 6):
        state = 0.9 * state + 0.1 * steps[i]
    ema = {(r["tensor"], r["row_id"]): r["values"] for r in ema_checkpoints(df, 0.9).collect()}
    np.testing.assert_allclose([ema["t", 0], ema["t", 1]], state, atol=1e-12)
    assert ema["once", 0] == [1.0]


def test_quantiles_of_double_values_and_ties(spark):
    values = {"x": np.round(RNG.normal(0, 1, 400), 2), "y": RNG.normal(0, 1e-300, 33), "z": np.zeros(5)}
    rows = [(t, i, [float(v) for v in part]) for t, all_ in values.items() for i, part in enumerate(np.array_split(all_, 4))]
    df = spark.createDataFrame(rows, "tensor STRING, row_id INT, values ARRAY<DOUBLE>").repartition(3)
    qs = [0.0, 0.03, 0.5, 0.999, 1.0]
    got = {r["tensor"]: r for r in matrix_quantiles(df, qs).collect()}
    for tensor, v in values.items():
        assert got[tensor]["n"] == len(v)
        np.testing.assert_allclose(got[tensor]["quantiles"], np.quantile(np.abs(v), qs), rtol=1e-12)


def test_quantiles_shuffle_no_values(mats):
    plan = matrix_quantiles(mats, [0.5])._jdf.queryExecution().executedPlan().toString()
    assert not any("values#" in line for line in plan.splitlines() if "Exchange" in line)


def test_vectors_are_added_across_batches_and_tasks(spark):
    rows = [(t, i % 3, s, [float(s + i + j) for j in range(4)]) for t in ("a", "b") for i in range(3) for s in range(40)]
    df = spark.createDataFrame(rows, "tensor STRING, row_id INT, step INT, values ARRAY<DOUBLE>").repartition(7)
    got = {(r["tensor"], r["row_id"]): r["values"] for r in mean_checkpoints(df).collect()}
    assert got == {(t, i): [19.5 + i + j for j in range(4)] for t in ("a", "b") for i in range(3)}


def test_vectors_of_different_lengths_are_refused(spark):
    df = spark.createDataFrame([("a", 0, 0, [1.0]), ("a", 0, 1, [1.0, 2.0])], "tensor STRING, row_id INT, step INT, values ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="values"):
        mean_checkpoints(df).collect()


def test_null_weights_are_refused(spark):
    df = spark.createDataFrame([("a", 0, [1.0, None])], "tensor STRING, row_id INT, values ARRAY<DOUBLE>")
    with pytest.raises(Exception, match="a weight is null"):
        matrix_quantile(df, 0.5).collect()
