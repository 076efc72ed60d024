"""Arrow functions that turn text into token ids and count them in place.

Each function works on whole Arrow buffers, so there is no per-row Python.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import BYTE_OFFSET


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts back to back, and their offsets (from 0)."""
    binary = texts.cast(pa.binary())
    buffers = binary.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(binary) + 1, binary.offset * 4)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def byte_ids(texts: pa.Array) -> pa.Array:
    """Byte token ids of every text."""
    data, offsets = text_bytes(texts)
    return pa.ListArray.from_arrays(offsets.astype(np.int32), data.astype(np.int32) + BYTE_OFFSET)


def framed(ids: pa.Array, bos: int, eos: int | None) -> pa.Array:
    """Put ``bos`` before every sequence and, when given, ``eos`` after it."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    extra = 1 if eos is None else 2
    out_offsets = offsets + extra * np.arange(len(offsets))
    out = np.empty(out_offsets[-1], np.int32)
    body = np.ones(len(out), bool)
    body[out_offsets[:-1]] = False
    out[out_offsets[:-1]] = bos
    if eos is not None:
        body[out_offsets[1:] - 1] = False
        out[out_offsets[1:] - 1] = eos
    out[body] = values
    return pa.ListArray.from_arrays(out_offsets.astype(np.int32), out)


def packed(ids: pa.Array, vocab_size: int) -> pa.Array:
    """Token lists as 16-bit little-endian bytes, the shard representation; a third of
    the size of an integer array and sliced without looking at elements."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    outside = (values < 0) | (values >= vocab_size)
    if outside.any():
        raise ValueError(f"token id {int(values[outside][0])} is not below the vocabulary size {vocab_size}")
    bounds = ((offsets - offsets[0]) * 2).astype(np.int32)
    data = values.astype("<u2").tobytes()
    return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data)])


def packed_values(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all :func:`packed` lists back to back, and their offsets (from 0)."""
    buffers = ids.buffers()
    offsets = np.frombuffer(buffers[1], np.int32, len(ids) + 1, ids.offset * 4)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]].view("<u2"), (offsets - offsets[0]).astype(np.int64) // 2


def lookup_sums(ids: pa.Array, tables: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Per sequence, the sum of each ``table[token]``."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    values = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    starts, filled = (offsets - offsets[0])[:-1], np.diff(offsets) > 0
    out = []
    for table in tables:
        sums = np.zeros(len(ids), table.dtype)
        if filled.any():
            sums[filled] = np.add.reduceat(table[values], starts[filled])
        out.append(sums)
    return out


def count_tokens(
    encode: Callable[[pa.Array], pa.Array], text_col: str, by: Sequence[str], vocab_size: int
) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Map-side combine: one output row per (group, token) of an Arrow batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = encode(batch.column(text_col))
            offsets = ids.offsets.to_numpy()
            tokens = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
            if by:
                keys = pa.StructArray.from_arrays([batch.column(k) for k in by], names=list(by))
                codes, firsts = _codes(keys)
                tokens = tokens + np.repeat(codes, np.diff(offsets)) * vocab_size
            counts = _sparse_counts(tokens)
            group, token = np.divmod(counts[0], vocab_size)
            columns = [batch.column(k).take(pa.array(firsts[group])) for k in by] if by else []
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(token.astype(np.int32)), pa.array(counts[1])], names=[*by, "token_id", "n"]
            )

    return run


def pair_counts(ids: pa.Array, vocab_size: int, first: bool) -> pa.RecordBatch:
    """(prev, token, n) over all sequences of a batch; with ``first`` the first token of
    each counts too, with no prev."""
    offsets = ids.offsets.to_numpy().astype(np.int64)
    tokens = ids.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.int64)
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1] + 1
    before[(offsets[:-1] - offsets[0])[np.diff(offsets) > 0]] = 0
    keys, counts = _sparse_counts(before * vocab_size + tokens)
    prev, token = np.divmod(keys, vocab_size)
    kept = slice(None) if first else prev > 0
    prev, token, counts = prev[kept], token[kept], counts[kept]
    columns = [pa.array((prev - 1).astype(np.int32), mask=prev == 0), pa.array(token.astype(np.int32)), pa.array(counts)]
    return pa.RecordBatch.from_arrays(columns, names=["prev", "token", "n"])


def _codes(keys: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.zeros(len(keys), np.int64)
    for i in range(keys.type.num_fields):
        encoded = keys.field(i).dictionary_encode(null_encoding="encode")
        codes = codes * max(len(encoded.dictionary), 1) + encoded.indices.to_numpy(zero_copy_only=False)
    _, firsts, codes = np.unique(codes, return_index=True, return_inverse=True)
    return codes, firsts


def _sparse_counts(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(values) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    if values.max() < max(8 * len(values), 1 << 20):
        counts = np.bincount(values)
        present = np.flatnonzero(counts)
        return present, counts[present].astype(np.int64)
    present, counts = np.unique(values, return_counts=True)
    return present, counts.astype(np.int64)


def slice_sums(tokens: Column, start: Column, stop: Column, table: Sequence[float]) -> Column:
    """Sum of ``table[token]`` over ``tokens[start:stop]`` (0-based, half-open).

    ``table`` has one entry per vocabulary id, so it is at most 65,536 long.
    """
    values = np.asarray(table, np.float64)

    @F.arrow_udf("double")
    def run(toks: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
        offsets = toks.offsets.to_numpy().astype(np.int64)
        flat = values[toks.values.to_numpy(zero_copy_only=False)]
        begin = offsets[:-1] + first.to_numpy(zero_copy_only=False)
        end = offsets[:-1] + last.to_numpy(zero_copy_only=False)
        bounds = np.stack([begin, end], axis=1).reshape(-1)
        sums = np.add.reduceat(np.append(flat, 0.0), bounds)[::2] if len(begin) else np.empty(0)
        return pa.array(np.where(end > begin, sums, 0.0))

    return run(tokens, start, stop)


def positions_of(tokens: Column, token: int) -> Column:
    """0-based places of ``token`` in every sequence."""

    @F.arrow_udf("array<int>")
    def run(toks: pa.Array) -> pa.Array:
        offsets = toks.offsets.to_numpy()
        flat = toks.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        hits = np.flatnonzero(flat == token)
        bounds = np.searchsorted(hits, offsets)
        rows = np.repeat(np.arange(len(toks)), np.diff(bounds))
        return pa.ListArray.from_arrays(bounds.astype(np.int32), (hits - offsets[rows]).astype(np.int32))

    return run(tokens)


def normalise_nfkc(text: Column) -> Column:
    """Unicode NFKC, which Spark has no built-in for; ASCII texts pass through.

    (Arrow's own NFKC kernel leaves characters decomposed, so it is not used.)
    """

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        import unicodedata

        return pa.array(
            [t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string()
        )

    return run(text)


