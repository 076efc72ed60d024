"""Exact top-k search by inner product with a bit-sliced index.

Components are quantised to whole numbers. The index keeps blocks of rows, ordered by
id; each attribute of a block is kept as bit slices: bitmap b has a bit for every row
whose value (less the block's least) has bit b set. A query's score of all rows of a
block is added up with bitmaps alone: each weight is written in signed digits (so that
few are not zero), every digit shifts the attribute's slices, and a carry-save adder
adds the slices of each power of two, three to two. The slices of the sum are then
read from the most significant one downward: rows are kept that are certainly among
the best, until the rows that could be are settled. Rows still equal after the last
slice have the same score, and the smallest ids among them are taken.

Queries go to the blocks in groups: each group meets each block once (a stated query
set against all rows), a copy of a block serves a few groups, and a query has at most
k rows from a block.

Nulls: rows whose id or vector is null, or whose vector holds a null or a component
that is not finite, take no part. Shorter vectors count as filled up with zeros.
Repeated ids: rows with the query's own id are not its candidates; other repeated rows
are candidates each; rows of one id lie in several blocks. Large components are exact (their
slices are more); a component of 2^61 or more, quantised, or one of the best scores that
fits no long, is an error. Ties go to the smaller id. Empty tables give an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SCALE = 256
LIMIT = 1 << 61
BLOCK_ROWS = 16_384
GROUP_ROWS = 128
TASK_GROUPS = 8  # query groups that one copy of a block serves


def quantised(rows: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v): rows that take part, components as whole numbers."""
    found = rows.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    bad = F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    size = F.lit(float(LIMIT) / scale)
    value = F.transform("x", lambda c: F.when(F.abs(c) < size, F.floor(c * scale)).otherwise(F.raise_error(F.lit("component too large for exact scores"))).cast("bigint"))
    return found.filter("id IS NOT NULL AND x IS NOT NULL").filter(~F.coalesce(bad, F.lit(True))).select("id", value.alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), int(sizes.max(initial=0))), np.int64)
    inside = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[inside] = column.flatten().to_numpy()
    return out


def _digits(weight: int) -> list[tuple[int, int]]:
    """(power of two, +1 or -1): a number in signed digits, no two adjacent."""
    out, power = [], 0
    while weight:
        if weight & 1:
            digit = 2 - (weight & 3)
            out.append((power, digit))
            weight -= digit
        weight >>= 1
        power += 1
    return out


class Slices:
    """Bit slices of a block of rows, ordered by id."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        self.ids = ids
        self.low = values.min(axis=0) if len(values) else np.zeros(values.shape[1], np.int64)
        self.first, maps = [0], []
        pad = -len(ids) % 64
        for d in range(values.shape[1]):
            raised = values[:, d] - self.low[d]
            for b in range(int(raised.max(initial=0)).bit_length()):
                maps.append(np.packbits(np.pad((raised >> b) & 1, (0, pad)).astype(np.uint8), bitorder="little").view("<u8"))
            self.first.append(len(maps))
        words = (len(ids) + pad) // 64
        # Behind the slices stand their complements: a negative digit adds those.
        plain = np.stack(maps) if maps else np.zeros((0, words), np.uint64)
        self.count = len(plain)
        self.maps = np.concatenate([plain, ~plain])
        self.rows = np.packbits(np.arange(len(ids) + pad) < len(ids), bitorder="little").view("<u8")

    def add(self, weights: list[int]) -> tuple[list[np.ndarray], int]:
        """Slices of the sum from the least significant one, and what the score has besides."""
        columns: dict[int, list[int]] = {}
        rest = 0
        for d, weight in enumerate(weights[: len(self.low)]):
            rest += weight * int(self.low[d])
            first, last = self.first[d], self.first[d + 1]
            for power, sign in _digits(weight):
                for b in range(last - first):
                    columns.setdefault(power + b, []).append(first + b + (0 if sign > 0 else self.count))
                if sign < 0:  # -x = (all ones - x) - all ones
                    rest -= ((1 << (last - first)) - 1) << power
        out: list[np.ndarray] = []
        carried: list[np.ndarray] = []
        power, top = 0, max(columns, default=-1)
        while power <= top or carried:
            stack = self.maps[columns.get(power, [])]
            if carried:
                stack = np.concatenate([stack, *carried])
            carried = []
            while len(stack) > 2:
                n = len(stack) // 3
                a, b, c = stack[:n], stack[n : 2 * n], stack[2 * n : 3 * n]
                half = a ^ b
                carried.append((a & b) | (half & c))
                stack = np.concatenate([half ^ c, stack[3 * n :]])
            if len(stack) == 2:
                carried.append((stack[:1] & stack[1:]))
                stack = stack[:1] ^ stack[1:]
            out.append(stack[0] if len(stack) else np.zeros_like(self.rows))
            power += 1
        return out, rest

    def top(self, slices: list[np.ndarray], k: int, candidates: np.ndarray) -> np.ndarray:
        """Places of the k best candidates, ties to the smaller place."""
        sure, open_ = np.zeros_like(candidates), candidates
        for s in reversed(slices):
            with_bit = sure | (open_ & s)
            n = int(np.bitwise_count(with_bit).sum())
            if n > k:
                open_ = open_ & s
            else:
                sure, open_ = with_bit, open_ & ~s
                if n == k:
                    return _places(sure)
        best = _places(sure)
        return np.concatenate([best, _places(open_)[: k - len(best)]])

    def search(self, query_id: int, weights: list[int], k: int) -> tuple[np.ndarray, list[int]]:
        slices, rest = self.add(weights)
        own = slice(*np.searchsorted(self.ids, [query_id, query_id + 1]))
        candidates = self.rows.copy()
        for at in range(own.start, own.stop):
            candidates[at >> 6] &= ~np.uint64(1 << (at & 63))
        found = self.top(slices, k, candidates)
        scores = [sum(int(s[at >> 6] >> np.uint64(at & 63)) & 1 and 1 << p for p, s in enumerate(slices)) + rest for at in found.tolist()]
        return self.ids[found], scores


def _places(bitmap: np.ndarray) -> np.ndarray:
    words = np.flatnonzero(bitmap)
    bits = np.unpackbits(bitmap[words].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return words[row] * 64 + bit


def _narrow(matrix: np.ndarray) -> np.ndarray:
    """The numbers in 4 bytes each where they fit, else in 8."""
    fits = not matrix.size or -(1 << 31) <= matrix.min() and matrix.max() < 1 << 31
    return matrix.astype("<i4" if fits else "<i8")


def _wide(packed: bytes, rows: int, width: int) -> np.ndarray:
    return np.frombuffer(packed, "<i8" if len(packed) > 4 * rows * width else "<i4").reshape(rows, width).astype(np.int64)


def _packed(df: DataFrame, part: str) -> DataFrame:
    """One row per ``part``: its ids in order, and their vectors."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def out():
            table = pa.concat_batches(held).sort_by([("id", "ascending")])
            ids, matrix = table.column("id").to_numpy(), _matrix(table.column("v"))
            yield pa.RecordBatch.from_arrays(
                [pa.array([now]), pa.array([ids.astype("<i8").tobytes()]), pa.array([_narrow(matrix).tobytes()]), pa.array([matrix.shape[1]], pa.int32())],
                [part, "ids", "vectors", "width"],
            )

        for batch in batches:
            keys = batch.column(0).to_numpy()
            for cut in np.split(np.arange(len(keys)), np.flatnonzero(np.diff(keys)) + 1):
                if not len(cut):
                    continue
                if keys[cut[0]] != now:
                    if held:
                        yield from out()
                    now, held = int(keys[cut[0]]), []
                held.append(batch.slice(cut[0], len(cut)).select(["id", "v"]))
        if held:
            yield from out()

    return df.select(part, "id", "v").repartition(part).sortWithinPartitions(part).mapInArrow(run, f"{part} bigint, ids binary, vectors binary, width int")


def top_k(rows: DataFrame, queries: DataFrame, *, k: int = 5, block_rows: int = BLOCK_ROWS, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(query_id, rank, id, score): for each row of ``queries`` (id, v) the k best of
    ``rows`` (id, v) with another id, ties to the smaller id."""
    n = rows.count()
    blocks = max(1, -(-n // block_rows))
    asked = max(1, -(-queries.count() // group_rows))

    def dealt(df: DataFrame, parts: int, part: str) -> DataFrame:
        # By place as well: rows of a repeated id do not meet in one part.
        return _packed(df.withColumn(part, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(parts))), part)

    copies = F.explode(F.sequence(F.lit(0), F.lit((asked - 1) // TASK_GROUPS))).alias("copy")
    index = dealt(rows, blocks, "block").select("*", copies)
    groups = dealt(queries, asked, "query_group").select(
        "query_group", F.col("ids").alias("q_ids"), F.col("vectors").alias("q_vectors"), F.col("width").alias("q_width"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"),
        F.expr(f"cast(query_group div {TASK_GROUPS} as int)").alias("copy"),
    )
    met = groups.join(index, ["block", "copy"]).select("block", "q_ids", "q_vectors", "q_width", "ids", "vectors", "width")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, slices = None, None
        for batch in batches:
            for block, q_ids, q_vectors, q_width, ids, vectors, width in zip(*(c.to_pylist() for c in batch.columns)):
                if block != now:
                    own = np.frombuffer(ids, "<i8")
                    now, slices = block, Slices(own, _wide(vectors, len(own), width))
                asked_ids = np.frombuffer(q_ids, "<i8")
                weights = _wide(q_vectors, len(asked_ids), q_width)
                out: list[tuple] = []
                for query, weight in zip(asked_ids.tolist(), weights.tolist()):
                    out += [(query, int(i), s) for i, s in zip(*slices.search(query, weight, k))]
                columns = list(zip(*out)) or [()] * 3
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "id", "score"])

    found = met.mapInArrow(run, "query_id bigint, id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "id", "score")
