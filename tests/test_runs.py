import glob
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.columns import is_logged, lr_mul, lr_mul_fraction, size_consistent
from corpusloom.functions.stats import student_tail
from corpusloom.operators.runs import (
    best_so_far,
    cap_status,
    check_archive,
    distinct_logs,
    board_gaps,
    deltas,
    rank_runs,
    required_mean,
    seed_stats,
    t_test,
    training_volume,
)
from corpusloom.sources.archive import read_log_bundles, write_log_bundles


def frame(spark, values):
    return spark.createDataFrame([("r", float(v)) for v in values], "run STRING, val_bpb DOUBLE")


# Published repeats: (values, null value, mean, sample deviation, t, p).
PUBLISHED = [
    ([1.20576485, 1.20617460, 1.20715923], required_mean(1.2243657), 1.20636623, 0.00071667, 31.417, 0.000506),
    ([1.20143417, 1.19945102, 1.20319508], required_mean(1.21613611), 1.20136009, 0.00187, 9.040, 0.00601),
    ([1.1927, 1.1935, 1.1921, 1.1929], 1.195, 1.1928, 0.000577, None, 0.00234486),
]


@pytest.mark.parametrize("values, mu, mean, sd, t, p", PUBLISHED)
def test_published_significance(spark, values, mu, mean, sd, t, p):
    for closed in (False, True):
        row = t_test(frame(spark, values), mu, closed_form=closed).first()
        assert abs(row["mean"] - mean) < 6e-9 and abs(row["std_samp"] - sd) < 5e-6
        assert t is None or abs(row["t"] - t) < 2e-3
        assert abs(row["p"] - p) < 6e-6 and row["accepted"]


def test_both_deviations(spark):
    row = seed_stats(frame(spark, [1.14271, 1.14298, 1.14260])).first()
    assert round(row["std_pop"], 5) == 0.00016 and round(row["std_samp"], 6) == 0.000196


def test_tail_against_closed_forms():
    t = np.linspace(-40, 40, 401)
    one = 0.5 - np.arctan(t) / math.pi
    two = 0.5 - t / (2 * np.sqrt(2 + t * t))
    np.testing.assert_allclose(student_tail(t, np.full_like(t, 1)), one, atol=1e-13)
    np.testing.assert_allclose(student_tail(t, np.full_like(t, 2)), two, atol=1e-13)
    # Large df approaches the normal tail.
    assert abs(student_tail(np.array([1.96]), np.array([1e6]))[0] - 0.0249979) < 1e-6


def test_no_spread_is_no_test(spark):
    row = t_test(frame(spark, [1.0, 1.0]), 2.0).first()
    assert row["t"] is None and row["p"] is None and row["accepted"] is None
    assert t_test(frame(spark, [1.0]), 2.0).first()["p"] is None


# A published ten-step experiment log: (value, bytes, status, delta to the best kept).
EXPERIMENTS = [
    (1.36330099, 12265862, "keep", None),
    (1.35919834, 15102915, "keep", -0.0041),
    (1.35355753, 17944610, "discard", -0.0056),
    (1.34958600, 15369302, "keep", -0.0096),
    (1.33357453, 16553858, "discard", -0.0160),
    (1.33591363, 15811633, "keep", -0.0137),
    (1.33052627, 15326871, "keep", -0.0054),
    (1.32814313, 15327112, "best", -0.0024),
    (1.32836253, 15325763, "discard", 0.0002),
    (1.37914359, 15066998, "discard", 0.0510),
]


def test_experiment_status(spark):
    rows = [("log", i, v, b) for i, (v, b, _, _) in enumerate(EXPERIMENTS)]
    df = spark.createDataFrame(rows, "run STRING, n INT, val_bpb DOUBLE, artifact_bytes BIGINT")
    got = cap_status(df, ["run"], ["n"], "val_bpb", "artifact_bytes").orderBy("n").collect()
    assert [r["status"] for r in got] == [e[2] for e in EXPERIMENTS]
    for r, e in zip(got, EXPERIMENTS):
        assert (r["delta"] is None) == (e[3] is None) and (e[3] is None or abs(r["delta"] - e[3]) < 6e-5)


def test_records_and_ranks(spark):
    rows = [(i, v) for i, v in enumerate([5.0, 4.0, 4.0, 6.0, 3.0])]
    df = spark.createDataFrame(rows, "n INT, val_bpb DOUBLE")
    got = best_so_far(df, ["n"]).orderBy("n").collect()
    assert [r["is_record"] for r in got] == [True, True, False, False, True]
    assert [r["improvement"] for r in got] == [None, 1.0, 0.0, -2.0, 1.0]
    ranks = {r["n"]: (r["row_number"], r["rank"]) for r in rank_runs(df, "val_bpb", "n").collect()}
    assert ranks == {4: (1, 1), 1: (2, 2), 2: (3, 2), 0: (4, 4), 3: (5, 5)}


def test_deltas(spark):
    df = spark.createDataFrame([("a", 1, 5.0), ("a", 2, 4.0), ("a", 3, 6.0), ("b", 1, 1.0)], "g STRING, n INT, v DOUBLE")
    got = {(r["g"], r["n"]): (r["delta_first"], r["delta_previous"]) for r in deltas(df, ["g"], ["n"], "v").collect()}
    assert got == {("a", 1): (0.0, None), ("a", 2): (-1.0, -1.0), ("a", 3): (1.0, 2.0), ("b", 1): (0.0, None)}
    assert "delta_previous" not in deltas(df, ["g"], ["n"], "v", base="first").columns


def test_volume(spark):
    df = spark.createDataFrame([(13780, 524288, 600_000.0)], "steps BIGINT, batch_tokens BIGINT, train_time_ms DOUBLE")
    row = training_volume(df).first()
    assert row["tokens_seen"] == 7_224_688_640 and round(row["ms_per_step"], 2) == 43.54
    ok = spark.createDataFrame([(15874829, 58340, 15816489)], "t INT, c INT, m INT")
    assert ok.select(size_consistent(F.col("t"), F.col("c"), F.col("m"))).first()[0]


# (steps of cool-down, time cap): multiplier at each step of a 2,000-step run of 43.5 ms per step.
SCHEDULES = {
    (0, None): {0: 1, 1999: 1, 2000: 1},
    (1200, None): {0: 1, 799: 1, 800: 1, 1000: 1000 / 1200, 1999: 1 / 1200, 2000: 1, 12_000: 1},
    (3000, None): {0: 2 / 3, 1: 1999 / 3000, 1999: 1 / 3000, 2000: 1},
    # 1,200 steps take 52,200 ms: the ramp starts that long before the cap.
    (1200, 600_000.0): {0: 1, 10: 1, 12_000: 1, 12_600: 51_900 / 52_200, 13_793: 4.5 / 52_200, 13_800: 0, 25_000: 0},
}


@pytest.mark.parametrize("down, cap", SCHEDULES)
def test_schedules(spark, down, cap):
    want = SCHEDULES[down, cap]
    df = spark.createDataFrame([(s, s * 43.5) for s in want], "step INT, ms DOUBLE")
    got = [r[0] for r in df.select(lr_mul(F.col("step"), F.col("ms"), 2000, down, cap)).collect()]
    np.testing.assert_allclose(got, list(want.values()), rtol=1e-9)


def test_fraction_and_cadence(spark):
    df = spark.createDataFrame([(0.0, 5), (479.0, 11), (480.0, 200), (540.0, 201), (600.0, 400), (700.0, 10)], "ms DOUBLE, step INT")
    rows = df.select(lr_mul_fraction(F.col("ms"), 600.0).alias("l"), is_logged(F.col("step"), 200).alias("k")).collect()
    np.testing.assert_allclose([r["l"] for r in rows], [1, 1, 1, 0.5, 0, 0])
    assert [r["k"] for r in rows] == [True, False, True, False, True, True]
    assert df.select(is_logged(F.col("step"), 0)).first()[0] is False


def test_archive_rules(spark):
    files = spark.createDataFrame(
        [("full", f) for f in ("README.md", "submission.json", "train_seed7.log", "train_v5.py")] + [("half", "README.md")],
        "run_dir STRING, file_name STRING",
    )
    folders = spark.createDataFrame([("empty",), ("full",)], "run_dir STRING")
    got = {}
    for r in check_archive(files, folders).collect():
        got.setdefault(r["run_dir"], set()).add(r["missing"])
    assert got == {"half": {"metadata", "log", "script"}, "empty": {"readme", "metadata", "log", "script"}}
    gaps = board_gaps(files, folders).collect()
    assert {(r["run_dir"], r["gap"]) for r in gaps} == {("half", "not_archived"), ("empty", "not_on_board")}


def test_equal_logs_count_once(spark):
    rows = [("r", f, i, line) for f, text in (("a", "xyz"), ("b", "xyz"), ("c", "xzy")) for i, line in enumerate(text)]
    lines = spark.createDataFrame(rows, "run STRING, file STRING, line_no BIGINT, line STRING")
    assert {(r["file"], r["copies"]) for r in distinct_logs(lines).collect()} == {("a", 2), ("c", 1)}


def test_bundled_logs_come_back_and_files_do_not_follow_the_runs(spark, tmp_path):
    logs = {f"r{i}": [f"a\tb {i}", "", "\u00e9 \t", f"end {i % 7}"][: i % 5] for i in range(200)}
    rows = [(run, 3 * i + 1, line) for run, lines in logs.items() for i, line in enumerate(lines)]
    path = str(tmp_path / "logs")
    write_log_bundles(spark.createDataFrame(rows, "run string, line_no bigint, line string").repartition(7), path)
    assert len(list((tmp_path / "logs").glob("*.txt"))) <= 8
    got = {}
    for r in read_log_bundles(spark, path).orderBy("run", "line_no").collect():
        got.setdefault(r["run"], []).append((r["line_no"], r["line"]))
    assert got == {run: list(enumerate(lines)) for run, lines in logs.items() if lines}
    for i, bad in enumerate([("a\tb", 0, "x"), ("a", 0, "x\ny")]):
        with pytest.raises(Exception, match="tab in a run"):
            write_log_bundles(spark.createDataFrame([bad], "run string, line_no bigint, line string"), str(tmp_path / f"bad{i}"))


def test_log_copies_writes_few_files(spark, sf):
    from corpusloom.plans.archive_queries import log_copies
    from corpusloom.session import scratch_root

    before = set(glob.glob(f"{scratch_root(spark)}/logs-*"))
    log_copies(spark, sf)
    (new,) = set(glob.glob(f"{scratch_root(spark)}/logs-*")) - before
    assert len(glob.glob(f"{new}/**/*.txt", recursive=True)) <= 8
