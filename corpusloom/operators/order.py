"""Order-dependent operators that never need a single-task window.

Two schemes are offered.

* ``running_offsets``: the order key is an integer ordinal. Rows fall into
  fixed-width ordinal buckets; per-bucket totals are summed hierarchically and
  joined back, so each window sees one bucket only.
* ``range_segments`` + ``scan``: any order key. Rows are range-partitioned and sorted
  once, the layout is made durable (all passes must see the same cuts, also after an
  executor is lost), and each task walks its segment with the state that the segments
  before it hand over.

A group that holds a third of all rows is split over many buckets or segments in
both schemes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import default_parallelism, durable
from .segment_scan import SEGMENT, Running, walk

ROWS_PER_BUCKET = 1024
FAN_OUT = 1024


def _same_keys(left: str, right: str, keys: Sequence[str], right_prefix: str) -> Column:
    """Plain equality, so the join keeps the window's partitioning of the left side."""
    cond = F.lit(True)
    for key in keys:
        cond = cond & (F.col(f"{left}.{key}") == F.col(f"{right}.{right_prefix}{key}"))
    return cond


def _found(carry_key: str, value: Column) -> Column:
    """A row without a matching carry has a null group key: fail, never drop it."""
    return F.when(F.col(carry_key).isNull(), F.raise_error(F.lit("null group or order key"))).otherwise(value)


def _exclusive_prefix(totals: DataFrame, sums: Sequence[str], bucket: str, by: Sequence[str]) -> DataFrame:
    """Exclusive running sums of per-bucket totals, in two levels, and the groups' sums.

    The top window sees one row per ``FAN_OUT`` buckets, i.e. one row per
    ``ROWS_PER_BUCKET * FAN_OUT`` input ordinals.
    """
    leaves = totals.withColumn("_top", F.expr(f"`{bucket}` div {FAN_OUT}"))
    tops = leaves.groupBy(*by, "_top").agg(*[F.sum(c).alias(c) for c in sums])
    over_tops = Window.partitionBy(*by, F.lit(0)).orderBy("_top").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(
        *[F.col(k).alias(f"_t_{k}") for k in by],
        F.col("_top").alias("_t_top"),
        *[F.coalesce(F.sum(c).over(over_tops), F.lit(0)).alias(f"_t_{c}") for c in sums],
        *[F.sum(c).over(Window.partitionBy(*by, F.lit(0))).alias(f"_all_{c}") for c in sums],
    )
    in_top = Window.partitionBy(*by, "_top").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    leaves = leaves.select(
        *by, bucket, "_top",
        *[F.coalesce(F.sum(c).over(in_top), F.lit(0)).alias(c) for c in sums],
    )
    # Null-safe on these small tables: no inferred null filter, so both levels
    # reuse one aggregation of the input.
    cond = F.col("l._top").eqNullSafe(F.col("t._t_top"))
    for key in by:
        cond = cond & F.col(f"l.{key}").eqNullSafe(F.col(f"t._t_{key}"))
    return leaves.alias("l").join(tops.alias("t"), cond).select(
        *[F.col(f"l.{k}").alias(f"_b_{k}") for k in by],
        F.col(f"l.{bucket}").alias("_b_bucket"),
        *[(F.col(f"l.{c}") + F.col(f"t._t_{c}")).alias(f"_base_{c}") for c in sums],
        *[F.col(f"t._all_{c}").alias(f"_all_{c}") for c in sums],
    )


def bucket_totals(df: DataFrame, length_col: str, order_col: str, by: Sequence[str] = (), *, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Rows and summed lengths of every ordinal bucket."""
    keyed = df.withColumn("_bucket", F.expr(f"`{order_col}` div {rows_per_bucket}"))
    return keyed.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_rows"), F.sum(length_col).alias("_length"))


def running_offsets(
    df: DataFrame,
    length_col: str,
    order_col: str,
    by: Sequence[str] = (),
    *,
    ordinal: str = "ordinal",
    offset: str = "offset",
    total: str | None = None,
    totals: DataFrame | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add a dense 0-based ``ordinal``, the exclusive running sum ``offset`` and, if named,
    the group's sum ``total``. ``totals`` are the :func:`bucket_totals`, if they are at hand.

    ``order_col`` is an integer ordinal, unique within ``by`` (gaps are fine).
    Rows are shuffled once, by bucket; the join with the bucket bases reuses
    that partitioning.
    """
    by = list(by)
    keyed = df.withColumn("_bucket", F.expr(f"`{order_col}` div {rows_per_bucket}"))
    if totals is None:
        totals = bucket_totals(df, length_col, order_col, by, rows_per_bucket=rows_per_bucket)
    bases = _exclusive_prefix(totals, ["_rows", "_length"], "_bucket", by)
    here = Window.partitionBy(*by, "_bucket").orderBy(order_col)
    local = keyed.withColumn("_rank", F.row_number().over(here) - 1).withColumn(
        "_sum", F.coalesce(F.sum(length_col).over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    cond = (F.col("x._bucket") == F.col("b._b_bucket")) & _same_keys("x", "b", by, "_b_")
    return local.alias("x").join(bases.alias("b"), cond, "left").select(
        *[F.col(f"x.{c}") for c in df.columns],
        _found("b._b_bucket", F.col("b._base__rows") + F.col("x._rank")).cast("bigint").alias(ordinal),
        (F.col("b._base__length") + F.col("x._sum")).cast("bigint").alias(offset),
        *([F.col("b._all__length").cast("bigint").alias(total)] if total else []),
    )


def range_segments(df: DataFrame, order: Sequence[str], partitions: int | None = None) -> DataFrame:
    """Range-partition by ``order`` (end it with a unique column), sort, and fix the cuts.

    Segment numbers are stored with the rows, so later passes agree on them no matter
    how often a task is retried. There are at least as many segments as input splits.
    """
    n = partitions or max(default_parallelism(df.sparkSession), df.rdd.getNumPartitions())
    by = [F.col(f"`{c}`") for c in order]
    return durable(df.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn(SEGMENT, F.spark_partition_id()))


def scan(segments: DataFrame, by: Sequence[str], order: Sequence[str], runs: Sequence[Running]) -> DataFrame:
    """Running values over ``order`` within each ``by`` group of range segments.

    ``order`` is ascending; the leading columns of the range layout must be
    ``by + order`` (or ``order`` alone when ``by`` is monotone in it). The rows stay
    where the range layout has put them: no second shuffle.
    """
    return walk(segments, list(by), list(order), list(runs))


def dense_ordinals(df: DataFrame, order: Sequence[str], ordinal: str = "ordinal", partitions: int | None = None) -> DataFrame:
    """Number rows 0,1,2,… in ``order`` (end it with a unique column)."""
    segs = range_segments(df.withColumn("_one", F.lit(1).cast("bigint")), order, partitions)
    out = scan(segs, [], order, [Running("sum", "_one", ordinal, inclusive=False)])
    return out.drop("_one", SEGMENT)
