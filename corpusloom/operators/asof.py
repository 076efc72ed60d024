"""As-of join of two tables: each left row with the latest right row that is not after it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import SEGMENT, Running, range_segments, scan


def asof_join(
    left: DataFrame, right: DataFrame, on: str, *, by: Sequence[str] = (), ties: Sequence[str] = (), strict: bool = False, prefix: str = "right_"
) -> DataFrame:
    """``left`` with the columns of the latest ``right`` row of the same ``by`` group whose
    ``on`` is not greater (``strict``: is smaller); null where there is none.

    Of right rows with equal ``on`` the last by ``ties`` is taken (columns of ``right``;
    end them with a unique one). Both tables are dealt by one set of range cuts and lie
    sorted in their segments; one pass hands the latest right row down to the left rows
    behind it, over segment borders too. A group that holds most of the rows is cut like
    any other. Right rows with a null in ``by`` or ``on`` match nothing; a left row with
    one has null right columns.
    """
    by, ties = list(by), list(ties)
    keys = [*by, on]
    whole_l, whole_r = F.struct(*[F.col(f"`{c}`") for c in left.columns]), F.struct(*[F.col(f"`{c}`") for c in right.columns])
    named = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keys)]
    sorted_by = [f"t{i}" for i in range(len(ties))]
    no_left, no_right = F.lit(None).cast(left.select(whole_l.alias("x")).schema["x"].dataType), F.lit(None).cast(right.select(whole_r.alias("x")).schema["x"].dataType)
    # Right rows come before left rows of the same key, or behind them if equal keys do not count.
    side_l, side_r = (0, 1) if strict else (1, 0)
    none = [F.lit(None).cast(right.schema[c].dataType).alias(s) for c, s in zip(ties, sorted_by)]
    there = F.lit(True)
    for c in keys:
        there = there & F.col(f"`{c}`").isNotNull()
    rows_l = left.select(*named, F.lit(side_l).alias("side"), *none, whole_l.alias("l"), no_right.alias("r"), there.alias("there"))
    rows_r = right.filter(there).select(*named, F.lit(side_r).alias("side"), *[F.col(f"`{c}`").alias(s) for c, s in zip(ties, sorted_by)], no_left.alias("l"), whole_r.alias("r"), F.lit(True).alias("there"))
    names = [f"k{i}" for i in range(len(keys))]
    both = rows_l.filter("there").unionByName(rows_r).drop("there")
    order = [names[-1], "side", *sorted_by]
    segments = range_segments(both, [*names[:-1], *order])
    found = scan(segments, names[:-1], order, [Running("last", "r", "match")]).filter(F.col("l").isNotNull()).drop(SEGMENT)
    lone = rows_l.filter(~F.col("there")).select("l", F.col("r").alias("match"))
    out = found.select("l", "match").unionByName(lone)
    taken = set(left.columns)
    return out.select("l.*", *[F.col(f"match.`{c}`").alias(f"{prefix}{c}" if c in taken else c) for c in right.columns])
