"""As-of join of two tables against a plain loop."""

import random

import pytest

from corpusloom.operators.asof import asof_join

L, R = "g STRING, t BIGINT, a BIGINT", "g STRING, t BIGINT, u BIGINT, v DOUBLE"


def loop(left, right, by, strict):
    out = []
    for row in left:
        g, t, _ = row
        fits = [r for r in right if t is not None and r[1] is not None and (r[1] < t if strict else r[1] <= t) and (not by or g is not None and r[0] == g)]
        best = max(fits, key=lambda r: (r[1], r[2]), default=(None,) * 4)
        out.append((*row, *best))
    return sorted(out, key=repr)


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("groups, n, partitions", [(1, 300, 8), (3, 400, 8), (150, 300, 8), (2, 500, 40)])
def test_against_loop(spark, by, strict, groups, n, partitions):
    rng = random.Random(n + groups)
    pick = lambda: rng.choice([*(f"g{i}" for i in range(groups)), "g0"])
    left = [(pick(), rng.randrange(n // 4), i) for i in range(n)] + [(None, 3, -1), ("g0", None, -2)]
    right = [(pick(), rng.randrange(n // 4), i, i / 7) for i in range(n // 3)] + [("g0", None, 999, 1.0)] + ([(None, 2, 998, 1.0)] if by else [])
    left += left[:5]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = asof_join(spark.createDataFrame(left, L), spark.createDataFrame(right, R), "t", by=by, ties=["u"], strict=strict)
        assert got.columns == ["g", "t", "a", "right_g", "right_t", "u", "v"]
        rows = sorted((tuple(r) for r in got.collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert rows == loop(left, right, by, strict)


def test_empty_sides_and_empty_segments(spark):
    left, right = spark.createDataFrame([("a", 5, 1)], L), spark.createDataFrame([("a", 1, 1, 1.0)], R)
    assert [tuple(r)[3:] for r in asof_join(left, right.limit(0), "t", ties=["u"]).collect()] == [(None,) * 4]
    assert asof_join(left.limit(0), right, "t", ties=["u"]).count() == 0
    # Far more range cuts than keys: the right row comes over empty segments.
    many = spark.createDataFrame([("a", 10_000 + i, i) for i in range(50)], L).repartition(30)
    assert {r["u"] for r in asof_join(many, right, "t", ties=["u"]).collect()} == {1}


def test_rows_move_once(spark):
    left, right = spark.createDataFrame([("a", 5, 1)], L), spark.createDataFrame([("a", 1, 1, 1.0)], R)
    plan = asof_join(left, right, "t", ties=["u"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan  # all behind the range layout
