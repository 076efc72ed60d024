"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

# Splits on these six characters only; other Unicode white space is part of a word.
WORD = r"[^\x20\x09-\x0D]+"
# Rows handed back to Spark at once; a long text counts as many rows.
OUT_ROWS = 512
OUT_CHARS = 8_000_000
# Keys that hold more than one row in HOT_KEYS (and HOT_ROWS) are split in joins.
HOT_KEYS = 10_000
HOT_ROWS = 256


def per_row(df: DataFrame, columns: list, make: Callable[[], Callable[..., tuple]], schema: str, arrow: pa.Schema) -> DataFrame:
    """Map every row of ``columns`` to one row, in Arrow batches, without a shuffle.

    ``make`` is called once per task and returns the function of one row.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            rows = [function(*row) for row in zip(*(c.to_pylist() for c in batch.columns))]
            yield batch_of(rows, arrow)

    return df.select(*columns).mapInArrow(run, schema)


def batch_of(rows: list[tuple], arrow: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(arrow)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, arrow.types)], schema=arrow)


def groups(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of runs of equal keys."""
    if not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return starts, np.append(starts[1:], len(keys))


def words(text) -> F.Column:
    """Words of a text column; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: computed once, of known size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, changed where ``df`` has a column of that name."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def deal(rows: DataFrame, side: DataFrame, key: str, copies: str, salt: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` and ``side`` with a column ``salt``, to be joined on ``key`` and ``salt``.

    ``side`` has one row for each ``key`` and, in ``copies``, how many rows hold that key
    at most. Rows of a hot key are dealt to several copies of its entry. There are fewer
    than ``HOT_KEYS`` hot keys at any size, so their list is sent to all tasks. ``rows``
    must be a table or durable: they are dealt by their place.
    """
    total = side.agg(F.sum(copies)).first()[0] or 0
    limit = max(total // HOT_KEYS, HOT_ROWS)
    counted = side.withColumn("_slices", F.ceil(F.col(copies) / limit))
    hot = counted.filter("_slices > 1").select(F.col(key).alias("_hot"), F.col("_slices").alias("_of"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
    dealt = dealt.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.coalesce(F.col("_of"), F.lit(1).cast("bigint")))).drop("_hot", "_of")
    every = counted.withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("_slices"), F.lit(1)) - 1))).drop("_slices")
    return dealt, every


def join_side(rows: DataFrame, side: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` left joined with ``side`` on ``key``, hot keys dealt out (see :func:`deal`)."""
    salt = fresh(rows, "_salt")[0]
    dealt, every = deal(rows, side, key, copies, salt)
    return dealt.join(every, [key, salt], "left").drop(salt)
