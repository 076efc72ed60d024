"""Running values over sorted range segments, one pass of Arrow batches per segment.

Each task walks its own segment in order and keeps one state per running column; nothing
is shuffled. What a group brings along from earlier segments comes from a summary of
two states per segment (its first and its last group), so what the driver holds grows
with the number of segments, not with rows or groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

SEGMENT = "_seg"
NULL_GROUP = "null group or order key"


@dataclass(frozen=True)
class Running:
    """One scanned column.

    ``kind``: ``sum``, ``min``, ``max`` (running aggregate), ``lag`` (previous row),
    ``first`` (first row of the group), ``last`` (last value that is not null), ``total``
    or ``least`` (sum or minimum of the whole group). ``inclusive`` counts the current row
    (not for lag, first and last).
    """

    kind: str
    column: str
    out: str
    inclusive: bool = True


WHOLE = {"total": "sum", "least": "min"}
_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def out_type(run: Running, schema: T.StructType) -> T.DataType:
    kind, given = WHOLE.get(run.kind, run.kind), schema[run.column].dataType
    if kind in ("lag", "first", "last"):
        return given
    if not isinstance(given, (*_INTEGERS, T.DoubleType)):
        raise ValueError(f"running {run.kind} of {run.column}: {given.simpleString()} is not bigint, int or double")
    return T.LongType() if kind == "sum" and isinstance(given, _INTEGERS) else given


def _merge(kind: str, earlier, later):
    """State of a group from two parts of it, either of which may hold no value (None)."""
    if kind == "lag":
        return later
    if kind == "first":
        return earlier
    if earlier is None or later is None:
        return later if earlier is None else earlier
    if kind == "last":
        return later
    return earlier + later if kind == "sum" else (np.fmin if kind == "min" else np.maximum)(earlier, later)


def _starts(batch: pa.RecordBatch, by: Sequence[int], before: tuple | None) -> np.ndarray:
    """Where a new group begins; ``before`` is the key of the row ahead of the batch."""
    new = np.zeros(batch.num_rows, bool)
    for n, i in enumerate(by):
        col = batch.column(i)
        if col.null_count:
            raise ValueError(NULL_GROUP)
        new[1:] |= pc.not_equal(col[1:], col[:-1]).to_numpy(zero_copy_only=False)
        if before is not None and before[n] != col[0].as_py():
            new[0] = True
    if before is None:
        new[0] = True
    return new


def _numbers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and whether they are there."""
    there = col.is_valid().to_numpy(zero_copy_only=False)
    if col.null_count:
        col = pc.fill_null(col, pa.scalar(0, col.type))
    return col.to_numpy(zero_copy_only=False), there


def _running(kind: str, values: np.ndarray, there: np.ndarray, start: np.ndarray, state) -> tuple[np.ndarray, np.ndarray]:
    """Inclusive running aggregate; ``start`` is where a row's group begins (-1: before the
    batch, where ``state`` stands)."""
    n = len(values)
    if kind == "sum":
        values = np.where(there, values, 0)
        if values.dtype.kind == "i":
            ends = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
            out = ends[1:] - ends[np.maximum(start, 0)]
            if state is not None:
                out = np.where(start < 0, out + state, out)
        else:
            # One number after the other, as a single task would.
            out = np.empty(n)
            edges = np.flatnonzero(np.diff(start, prepend=-2, append=n))
            for low, high in zip(edges[:-1], edges[1:]):
                if start[low] < 0 and state is not None:
                    values[low] = state + values[low]
                out[low:high] = np.cumsum(values[low:high])
    else:
        take = np.fmin if kind == "min" else np.maximum
        if values.dtype.kind == "i":
            values = np.where(there, values, np.iinfo(values.dtype).max if kind == "min" else np.iinfo(values.dtype).min)
        else:
            values = np.where(there, values, np.inf if kind == "min" else -np.inf)
        out, at, step = values.copy(), np.arange(n), 1
        while step < n:  # twice as far back each time, within the group
            inside = at - step >= np.maximum(start, 0)
            out[inside] = take(out[inside], out[at[inside] - step])
            step *= 2
        if state is not None:
            out = np.where(start < 0, take(out, state), out)
    # A value is there from the first one of the group on.
    count = np.concatenate([[0], np.cumsum(there)])
    known = count[1:] > count[np.maximum(start, 0)]
    return out, known if state is None else known | (start < 0)


class _Walk:
    """States of all running columns along one segment."""

    def __init__(self, runs: Sequence[Running], columns: Sequence[int], by: Sequence[int], carry: tuple | None = None):
        self.runs, self.columns, self.by = runs, columns, by
        self.key, self.states = carry or (None, [None] * len(runs))
        self.first: tuple | None = None  # key and states of the first group, once it is over
        self.any = False

    def _one(self, run: Running, col: pa.Array, state, new: np.ndarray, start: np.ndarray) -> tuple[pa.Array, Callable[[int], object]]:
        """The running column, and the state behind a row."""
        n = len(col)
        if run.kind == "lag":
            moved = pa.concat_arrays([pa.array([state], col.type), col.slice(0, n - 1)])
            return moved.take(pa.array(np.arange(n), mask=new)), lambda row: col[row].as_py()
        if run.kind == "first":
            value = pa.concat_arrays([pa.array([state], col.type), col]).take(pa.array(start + 1))
            return value, lambda row: value[row].as_py()
        if run.kind == "last":
            there = col.is_valid().to_numpy(zero_copy_only=False)
            at = np.maximum.accumulate(np.where(there, np.arange(n), -1))
            # Only values of the row's own group; -1 takes what the group brought along.
            at = np.where(at >= np.maximum(start, 0), at, -1)
            value = pa.concat_arrays([pa.array([state], col.type), col]).take(pa.array(at + 1, mask=(at < 0) & (start >= 0)))
            return value, lambda row: value[row].as_py()
        own = None if new[0] else state
        total, known = _running(run.kind, *_numbers(col), start, own)
        shown, there = total, known
        if not run.inclusive:
            shown = np.where(new, 0, np.concatenate([[0 if own is None else own], total[:-1]])).astype(total.dtype)
            there = ~new & np.concatenate([[own is not None], known[:-1]])
        if run.kind == "sum":
            shown, there = np.where(there, shown, 0), np.ones(n, bool)
        return pa.array(shown, mask=~there), lambda row: total[row].item() if known[row] else None

    def step(self, batch: pa.RecordBatch) -> list[pa.Array]:
        new = _starts(batch, self.by, self.key)
        start = np.maximum.accumulate(np.where(new, np.arange(batch.num_rows), -1))
        done = [self._one(run, batch.column(i), state, new, start) for run, i, state in zip(self.runs, self.columns, self.states)]
        border = np.flatnonzero(new)[0 if self.any else 1 :]
        if self.first is None and len(border):
            row = int(border[0]) - 1
            self.first = (self.key, self.states) if row < 0 else (self._key(batch, row), [state(row) for _, state in done])
        last = batch.num_rows - 1
        self.any, self.key, self.states = True, self._key(batch, last), [state(last) for _, state in done]
        return [value for value, _ in done]

    def _key(self, batch: pa.RecordBatch, row: int) -> tuple:
        return tuple(batch.column(i)[row].as_py() for i in self.by)


def _summary(segments: DataFrame, by: Sequence[str], runs: Sequence[Running]) -> list[tuple]:
    """For each segment with rows: its number, and key and states of its first and last group."""
    need = list(dict.fromkeys([SEGMENT, *by, *(r.column for r in runs)]))
    part = [segments.schema[c].dataType for c in by] + [out_type(r, segments.schema) for r in runs]
    fields = [("segment", T.IntegerType()), *[(f"{end}{i}", t) for end in ("first", "last") for i, t in enumerate(part)]]
    arrow = pa.schema([(name, to_arrow_type(t)) for name, t in fields])
    columns, keys = [need.index(r.column) for r in runs], [need.index(c) for c in by]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, segment = _Walk(runs, columns, keys), None
        for batch in filter(len, batches):
            segment = batch.column(0)[0].as_py()
            walk.step(batch)
        if segment is not None:
            first = walk.first or (walk.key, walk.states)
            row = [segment, *first[0], *first[1], *walk.key, *walk.states]
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, arrow.types)], schema=arrow)

    schema = T.StructType([T.StructField(name, t) for name, t in fields])
    found = segments.select(*[f"`{c}`" for c in need]).mapInArrow(run, schema).toArrow().to_pylist()
    out = []
    for row in sorted(found, key=lambda r: r["segment"]):
        first, last = ([row[f"{end}{i}"] for i in range(len(part))] for end in ("first", "last"))
        out.append((row["segment"], tuple(first[: len(by)]), first[len(by) :], tuple(last[: len(by)]), last[len(by) :]))
    return out


def _chain(summary: list[tuple], kinds: Sequence[str]) -> tuple[dict, dict]:
    """{segment: (key, states)}: what its first group brings along, and with which states
    its last group ends, maybe segments later."""
    carries, ends, firsts, lasts = {}, {}, [], []
    key, states = None, []
    for segment, first_key, first, last_key, last in summary:
        if first_key == key:
            carries[segment] = (key, states)
            first = [_merge(kind, a, b) for kind, a, b in zip(kinds, states, first)]
        key, states = last_key, first if first_key == last_key else last
        firsts.append(first)
        lasts.append(states)
    for i in range(len(summary) - 1, -1, -1):
        segment, _, _, last_key, _ = summary[i]
        if i + 1 < len(summary) and summary[i + 1][1] == last_key:
            # The group goes on: to the end of the next segment's first group, or beyond.
            lasts[i] = lasts[i + 1] if summary[i + 1][1] == summary[i + 1][3] else firsts[i + 1]
        ends[segment] = (last_key, lasts[i])
    return carries, ends


def _walked(rows: DataFrame, by: Sequence[str], runs: Sequence[Running], carries: dict) -> DataFrame:
    """``rows`` with the running columns; every partition holds one segment, in order."""
    schema = T.StructType([*rows.schema.fields, *[T.StructField(r.out, out_type(r, rows.schema)) for r in runs]])
    names = rows.columns
    at, columns, keys = names.index(SEGMENT), [names.index(r.column) for r in runs], [names.index(c) for c in by]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = None
        for batch in filter(len, batches):
            if walk is None:
                walk = _Walk(runs, columns, keys, carries.get(batch.column(at)[0].as_py()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *walk.step(batch)], names=schema.names)

    return rows.mapInArrow(run, schema)


def walk(segments: DataFrame, by: Sequence[str], order: Sequence[str], runs: Sequence[Running]) -> DataFrame:
    """All columns of ``segments`` and the running ones.

    Values of whole groups are running values first; a second walk, backwards, hands the
    last one to all rows of the group. It needs a sort within each segment, no shuffle.
    """
    forward = [Running(WHOLE.get(r.kind, r.kind), r.column, r.out, r.inclusive or r.kind in WHOLE) for r in runs]
    summary = _summary(segments, by, forward)
    carries, ends = _chain(summary, [r.kind for r in forward])
    out = _walked(segments, by, forward, carries)
    whole = [(i, r) for i, r in enumerate(runs) if r.kind in WHOLE]
    if not whole:
        return out
    back = [Running("first", r.out, f"_whole{i}") for i, r in whole]
    later = {segment: (key, [states[i] for i, _ in whole]) for segment, (key, states) in ends.items()}
    turned = out.sortWithinPartitions(*[F.col(f"`{c}`").desc() for c in [*by, *order]])
    done = _walked(turned, by, back, later)
    renamed = {f"_whole{i}": r.out for i, r in whole}
    return done.drop(*renamed.values()).withColumnsRenamed(renamed).select(*[f"`{c}`" for c in out.columns])
