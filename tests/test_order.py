import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusloom.operators.order import Running, dense_ordinals, range_segments, running_offsets, scan


@pytest.fixture(scope="module")
def rows(spark):
    """5,000 rows in three groups, one of them with 80 % of the rows."""
    rng = np.random.default_rng(7)
    data = [(int(k), "hot" if rng.random() < 0.8 else str(rng.integers(2)), int(rng.integers(0, 50)), float(rng.integers(0, 30)))
            for k in rng.permutation(20_000)[:5_000]]
    return spark.createDataFrame(data, "k BIGINT, g STRING, n BIGINT, v DOUBLE").cache()


@pytest.mark.parametrize("per_bucket", [1, 7, 1024])
def test_running_offsets(rows, per_bucket):
    got = running_offsets(rows, "n", "k", ["g"], rows_per_bucket=per_bucket)
    w = Window.partitionBy("g").orderBy("k")
    want = rows.select("k", (F.row_number().over(w) - 1).alias("o"), (F.sum("n").over(w) - F.col("n")).alias("f"))
    bad = got.join(want, "k").filter((F.col("ordinal") != F.col("o")) | (F.col("offset") != F.col("f")))
    assert got.count() == 5_000 and bad.count() == 0


def test_scan_carries_over_segments(rows):
    segs = range_segments(rows, ["g", "k"], 13)
    # The hot group must be cut into several segments.
    assert segs.filter("g = 'hot'").select("_seg").distinct().count() > 3
    got = scan(
        segs, ["g"], ["k"],
        [Running("lag", "v", "lag"), Running("min", "v", "low"), Running("max", "v", "high", False),
         Running("sum", "v", "total"), Running("first", "v", "first"), Running("total", "n", "all_n"), Running("least", "v", "all_low")],
    )
    w = Window.partitionBy("g").orderBy("k")
    want = rows.select(
        "k", F.lag("v").over(w).alias("l"), F.min("v").over(w).alias("m"),
        F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("x"),
        F.sum("v").over(w).alias("s"), F.first("v").over(w).alias("f"),
        F.sum("n").over(Window.partitionBy("g")).alias("an"), F.min("v").over(Window.partitionBy("g")).alias("al"),
    )
    same = (
        F.col("lag").eqNullSafe(F.col("l")) & F.col("low").eqNullSafe(F.col("m")) & F.col("high").eqNullSafe(F.col("x"))
        & F.col("total").eqNullSafe(F.col("s")) & F.col("first").eqNullSafe(F.col("f"))
        & F.col("all_n").eqNullSafe(F.col("an")) & F.col("all_low").eqNullSafe(F.col("al"))
    )
    joined = got.join(want, "k")
    assert joined.count() == 5_000 and joined.filter(~same).count() == 0


def test_dense_ordinals(rows):
    got = dense_ordinals(rows, ["v", "k"]).orderBy("ordinal").select("ordinal", "v", "k").collect()
    assert [r["ordinal"] for r in got] == list(range(5_000))
    assert [(r["v"], r["k"]) for r in got] == sorted((r["v"], r["k"]) for r in got)


def test_null_group_fails_loudly(spark):
    df = spark.createDataFrame([(0, None, 1), (1, "a", 2)], "k BIGINT, g STRING, n BIGINT")
    with pytest.raises(Exception, match="null group"):
        running_offsets(df, "n", "k", ["g"]).collect()


KINDS = [
    Running("lag", "v", "lag"), Running("lag", "name", "lag_name"), Running("first", "name", "first_name"), Running("min", "v", "low"),
    Running("min", "n", "low_before", False), Running("max", "v", "high", False), Running("sum", "n", "sum_n"), Running("sum", "v", "sum_before", False),
    Running("total", "n", "all_n"), Running("least", "v", "all_low"), Running("total", "v", "all_v"),
]


def scan_loop(rows, by, runs):
    out = []
    for i, row in enumerate(rows):
        group = [r for r in rows if [r[c] for c in by] == [row[c] for c in by]]
        upto = [r for r in rows[: i + 1] if r in group]
        values = {}
        for run in runs:
            seen = [r[run.column] for r in (group if run.kind in ("total", "least") else upto if run.inclusive else upto[:-1])]
            there = [v for v in seen if v is not None]
            kind = {"total": "sum", "least": "min"}.get(run.kind, run.kind)
            values[run.out] = (
                (upto[-2][run.column] if len(upto) > 1 else None) if kind == "lag" else upto[0][run.column] if kind == "first"
                else sum(there) if kind == "sum" else {"min": min, "max": max}[kind](there, default=None)
            )
        out.append({**row, **values})
    return out


@pytest.mark.parametrize("groups, segments, batch", [(1, 7, 16), (3, 5, 4), (40, 6, 1000), (400, 9, 3), (2, 300, 2)])
def test_scan_against_a_loop(spark, groups, segments, batch):
    """Groups within a segment, over many segments, and ending at borders; nulls; small batches."""
    rng = np.random.default_rng(groups)
    data = sorted(
        (int(rng.integers(groups)), i, None if rng.random() < 0.2 else int(rng.integers(-9, 9)), None if rng.random() < 0.2 else float(rng.integers(0, 30)), None if rng.random() < 0.2 else f"x{i}")
        for i in range(400)
    )
    df = spark.createDataFrame(data, "g BIGINT, k BIGINT, n BIGINT, v DOUBLE, name STRING").repartition(4)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = scan(range_segments(df, ["g", "k"], segments), ["g"], ["k"], KINDS).drop("_seg").orderBy("g", "k").collect()
        alone = scan(range_segments(df, ["k"], segments), [], ["k"], KINDS).drop("_seg").orderBy("k").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = [dict(zip(("g", "k", "n", "v", "name"), r)) for r in data]
    assert [r.asDict() for r in got] == scan_loop(rows, ["g"], KINDS)
    assert [r.asDict() for r in alone] == scan_loop(sorted(rows, key=lambda r: r["k"]), [], KINDS)


def test_scan_of_nothing_and_null_groups(spark):
    empty = spark.createDataFrame([], "g BIGINT, k BIGINT, n BIGINT")
    assert scan(range_segments(empty, ["g", "k"]), ["g"], ["k"], [Running("total", "n", "t")]).count() == 0
    df = spark.createDataFrame([(None, 1, 1)], "g BIGINT, k BIGINT, n BIGINT")
    with pytest.raises(Exception, match="null group"):
        scan(range_segments(df, ["g", "k"]), ["g"], ["k"], [Running("sum", "n", "t")]).collect()
