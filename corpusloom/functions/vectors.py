"""Arrow functions over rows of weights (list columns): whole batches at a time, no row
per value. An empty or null row gives an empty or null result; a null weight is an error."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import _codes, _sparse_counts

BITS_PER_PASS = 16
# Bytes of partial sums a task holds before it hands them on.
HELD_BYTES = 128 << 20


def _flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of all rows back to back, and their offsets (from 0)."""
    offsets = col.offsets.to_numpy().astype(np.int64)
    values = col.values.slice(offsets[0], offsets[-1] - offsets[0])
    if values.null_count:
        raise ValueError("a weight is null")
    return values.to_numpy(zero_copy_only=False), offsets - offsets[0]


def _listed(flat: np.ndarray, offsets: np.ndarray, like: pa.Array) -> pa.Array:
    missing = like.is_null() if like.null_count else None
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat), mask=missing)


def _doubles(col: pa.Array) -> np.ndarray:
    return col.to_numpy(zero_copy_only=False).astype(np.float64)


def row_quantiles(values: Column, qs: Sequence[float]) -> Column:
    """Exact linear-interpolation quantiles of the absolute values of a row, from one
    partial sort; null for an empty row."""
    qs = np.asarray(qs, np.float64)

    @F.arrow_udf("array<double>")
    def run(col: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        flat, widths = np.abs(flat), np.diff(offsets)
        out = np.zeros((len(widths), len(qs)))
        for width in np.unique(widths[widths > 0]):
            at = np.flatnonzero(widths == width)
            block = flat[offsets[at, None] + np.arange(width)]
            rank = qs * (width - 1)
            low = np.floor(rank).astype(np.int64)
            high = np.minimum(low + 1, width - 1)
            block.partition(np.unique(np.concatenate([low, high])), axis=1)
            lower, upper = block[:, low].astype(np.float64), block[:, high].astype(np.float64)
            out[at] = lower + (upper - lower) * (rank - low)
        bounds = np.arange(len(widths) + 1, dtype=np.int32) * len(qs)
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.ravel()), mask=pa.array(widths == 0))

    return run(values)


def _levels(x: np.ndarray, scale: np.ndarray, low: int, high: int, exact: bool) -> np.ndarray:
    ratio = x / scale if exact else (x / scale).astype(np.float32).astype(np.float64)
    # Not-a-number counts as larger than any number, as in SQL.
    return np.nan_to_num(np.clip(np.rint(ratio), low, high), nan=high)


def levels(values: Column, scale: Column, low: int, high: int, clip: Column | None = None, exact: bool = False) -> Column:
    """Round-half-even levels of ``values / scale``, clamped."""
    clipped = clip is not None

    @F.arrow_udf("array<tinyint>")
    def run(col: pa.Array, scales: pa.Array, clips: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        widths = np.diff(offsets)
        x = flat.astype(np.float64)
        if clipped:
            bound = np.repeat(_doubles(clips), widths)
            x = np.clip(x, -bound, bound)
        return _listed(_levels(x, np.repeat(_doubles(scales), widths), low, high, exact).astype(np.int8), offsets, col)

    return run(values, scale.cast("double"), (clip if clipped else scale).cast("double"))


def restore(q: Column, scale: Column, exact: bool = False) -> Column:
    """Values back from levels; single precision unless ``exact``."""

    @F.arrow_udf("array<double>")
    def run(col: pa.Array, scales: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        return _listed(_restored(flat, np.repeat(_doubles(scales), np.diff(offsets)), exact), offsets, col)

    return run(q, scale.cast("double"))


def _restored(q: np.ndarray, scale: np.ndarray, exact: bool) -> np.ndarray:
    x = q.astype(np.float64) * scale
    return x if exact else x.astype(np.float32).astype(np.float64)


def _row_sums(x: np.ndarray, offsets: np.ndarray, add=np.add) -> np.ndarray:
    filled = np.diff(offsets) > 0
    out = np.zeros(len(filled))
    if filled.any():
        out[filled] = add.reduceat(x, offsets[:-1][filled])
    return out


def round_trip_error(values: Column, q: Column, scale: Column, exact: bool = False) -> Column:
    """Struct (total, worst): squared error of a row and its largest absolute error."""

    @F.arrow_udf("struct<total: double, worst: double>")
    def run(col: pa.Array, qs: pa.Array, scales: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        diff = flat.astype(np.float64) - _restored(_flat(qs)[0], np.repeat(_doubles(scales), np.diff(offsets)), exact)
        parts = [_row_sums(diff * diff, offsets), _row_sums(np.abs(diff), offsets, np.maximum)]
        return pa.StructArray.from_arrays([pa.array(p) for p in parts], names=["total", "worst"])

    return run(values, q, scale.cast("double"))


def trial_errors(values: Column, scales: Column, limit: int, exact: bool = False) -> Column:
    """Squared errors of a row quantised with each scale of the array ``scales``."""

    @F.arrow_udf("array<double>")
    def run(col: pa.Array, trials: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        widths, x = np.diff(offsets), flat.astype(np.float64)
        table = _flat(trials)[0].reshape(len(widths), -1)
        out = np.empty(table.shape)
        for i in range(table.shape[1]):
            scale = np.repeat(table[:, i], widths)
            diff = x - _restored(_levels(x, scale, -limit, limit, exact), scale, exact)
            out[:, i] = _row_sums(diff * diff, offsets)
        bounds = np.arange(len(widths) + 1, dtype=np.int32) * table.shape[1]
        return pa.ListArray.from_arrays(pa.array(bounds), pa.array(out.ravel()))

    return run(values, scales)


def _each(change: Callable[[np.ndarray], np.ndarray], values: Column, kind: str) -> Column:
    @F.arrow_udf(f"array<{kind}>")
    def run(col: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        return _listed(change(flat), offsets, col)

    return run(values)


def coarsen(q: Column, step: int, low: int = -127, high: int = 127) -> Column:
    """Round quantised levels to multiples of ``step``, half to even."""
    return _each(lambda v: np.clip(np.rint(v / float(step)) * step, low, high).astype(np.int8), q, "tinyint")


def prune_levels(q: Column, ratio: float) -> Column:
    """Zero the levels whose size is at most ``int(127 * ratio)``."""
    limit = int(127 * ratio)
    return _each(lambda v: np.where(np.abs(v.astype(np.int16)) <= limit, 0, v).astype(np.int8), q, "tinyint")


def cut_below(values: Column, threshold: Column) -> Column:
    """``values`` as doubles, those smaller in size than ``threshold`` zeroed."""

    @F.arrow_udf("array<double>")
    def run(col: pa.Array, limits: pa.Array) -> pa.Array:
        flat, offsets = _flat(col)
        x = flat.astype(np.float64)
        return _listed(np.where(np.abs(x) < np.repeat(_doubles(limits), np.diff(offsets)), 0.0, x), offsets, col)

    return run(values, threshold.cast("double"))


# --- histograms of the bits of |value| ---------------------------------------------------------


def _magnitude_bits(flat: np.ndarray) -> np.ndarray:
    """Bits of |value| as a whole number of the same order; not-a-number comes last."""
    size = flat.dtype.itemsize
    bits = np.abs(flat).view(f"<u{size}")
    return bits.astype(np.int64)


def leading_bits(mats: DataFrame, drop: int) -> DataFrame:
    """(tensor, above, prefix, c): how many values have a magnitude whose bits without
    the last ``drop`` are ``prefix``; ``above`` is the part of it that was known before.

    With a column ``above`` (array of longs) in ``mats`` only values that begin with
    one of its entries are counted. Counts combine inside every Arrow batch, so at
    most 2^16 rows for a tensor and entry leave it.
    """
    narrowed = "above" in mats.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            flat, offsets = _flat(batch.column("values"))
            codes, firsts = _codes(pa.StructArray.from_arrays([batch.column("tensor")], names=["tensor"]))
            rows = np.repeat(codes, np.diff(offsets))
            prefix = _magnitude_bits(flat) >> drop
            entries = [batch.column("above")[int(i)].as_py() for i in firsts] if narrowed else [[0]] * len(firsts)
            for slot in range(max(map(len, entries))):
                wanted = np.array([e[slot] if slot < len(e) else -1 for e in entries], np.int64)
                own = prefix >> BITS_PER_PASS == wanted[rows]
                cells, counts = _sparse_counts((rows[own] << BITS_PER_PASS) | (prefix[own] & ((1 << BITS_PER_PASS) - 1)))
                code, low = cells >> BITS_PER_PASS, cells & ((1 << BITS_PER_PASS) - 1)
                above = wanted[code]
                columns = [pa.array(above), pa.array(low | (above << BITS_PER_PASS)), pa.array(counts)]
                tensors = batch.column("tensor").take(pa.array(firsts[code]))
                yield pa.RecordBatch.from_arrays([tensors, *columns], names=["tensor", "above", "prefix", "c"])

    kind = mats.schema["tensor"].dataType.simpleString()
    counted = mats.mapInArrow(run, f"tensor {kind}, above bigint, prefix bigint, c bigint")
    return counted.groupBy("tensor", "above", "prefix").agg(F.sum("c").alias("c"))


def value_of_bits(bits: Column, width: int) -> Column:
    @F.arrow_udf("double")
    def run(col: pa.Array) -> pa.Array:
        whole = col.to_numpy(zero_copy_only=False).astype(f"<u{width // 8}")
        return pa.array(whole.view(f"<f{width // 8}").astype(np.float64))

    return run(bits)


# --- sums of whole vectors ------------------------------------------------------------------------


def vector_sums(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys…, n, values): per key the number of rows and the sum of ``values * _w``.

    Tasks add their own rows first and hand on one vector per key (more only when they
    hold more than ``HELD_BYTES``), then vectors of a key meet in one task, which adds
    them one after the other. Vectors of different lengths under a key are an error.
    """
    keys = list(keys)
    types = [rows.schema[k].dataType.simpleString() for k in keys]
    schema = ", ".join([*[f"`{k}` {t}" for k, t in zip(keys, types)], "n bigint, values array<double>"])

    def emit(held: dict, arrow: pa.Schema) -> pa.RecordBatch:
        columns = [pa.array([k[i] for k in held], arrow.field(name).type) for i, name in enumerate(keys)]
        vectors = [v for _, v in held.values()]
        bounds = np.concatenate([[0], np.cumsum([len(v) for v in vectors])]).astype(np.int32)
        listed = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(vectors)))
        return pa.RecordBatch.from_arrays([*columns, pa.array([n for n, _ in held.values()], pa.int64()), listed], names=[*keys, "n", "values"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, arrow = {}, 0, None
        for batch in batches:
            arrow = batch.schema
            flat, offsets = _flat(batch.column("values"))
            names = list(zip(*(batch.column(k).to_pylist() for k in keys)))
            counts, weights = batch.column("n").to_pylist(), batch.column("_w").to_pylist()
            for i, key in enumerate(names):
                vector = flat[offsets[i] : offsets[i + 1]].astype(np.float64) * weights[i]
                before = held.get(key)
                if before is None:
                    if size > HELD_BYTES:
                        # A new key: behind the shuffle, where keys come in order, all others are whole.
                        yield emit(held, arrow)
                        held, size = {}, 0
                    held[key] = (counts[i], vector)
                    size += vector.nbytes
                elif len(before[1]) != len(vector):
                    raise ValueError(f"rows of {key} have {len(before[1])} and {len(vector)} values")
                else:
                    held[key] = (before[0] + counts[i], before[1] + vector)
        if held:
            yield emit(held, arrow)

    weight = F.col("_w").cast("double") if "_w" in rows.columns else F.lit(1.0)
    single = rows.select(*keys, F.lit(1).cast("bigint").alias("n"), weight.alias("_w"), "values")
    partial = single.mapInArrow(add, schema)
    met = partial.repartition(*keys).sortWithinPartitions(*keys)
    return met.select(*keys, "n", F.lit(1.0).alias("_w"), "values").mapInArrow(add, schema)
