"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit fingerprint; texts link when their fingerprints differ in at
most ``max_bits`` bits. The bits are cut into blocks with thresholds t such that the
sum of (t + 1) exceeds ``max_bits``: linked fingerprints differ by at most t bits in
at least one block. In each block the words of a covering code (covering radius R)
are the anchors, and a fingerprint is sent to every anchor within R + t of it. If
two fingerprints are within t, the anchor nearest to the first is within R of it and
within R + t of the second, so they meet. The full distance is checked there.

Links leave an anchor as stars only (a member and the smallest member it is
connected with), so a group of n copies makes at most n rows per anchor. Components
are found from the stars by alternating large-star and small-star steps.

Nulls: a null text has no words and, like an empty one, fingerprint zero, which links
like any other. Rows with a null doc_id take part; they never name a component unless
it has no other row, and then component_id is null. Repeated rows share a fingerprint
and stay repeated. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import fresh, groups, join_side, per_row, stored
from .components import components, stars

SEED = 42
CHUNK = 65_536  # shingles whose bits are counted at once


@dataclass(frozen=True)
class Block:
    """``width`` bits; the first 2^parity - 1 are covered by a Hamming code (radius 1),
    the others by all words (radius 0). ``parity`` 0: all words."""

    width: int
    parity: int
    threshold: int

    @property
    def radius(self) -> int:
        return 1 if self.parity else 0


# 23 + 23 + 18 bits; (1 + 1) + (1 + 1) + (0 + 1) = 5 > 4. About 35 anchors a fingerprint.
LAYOUT = (Block(23, 4, 1), Block(23, 4, 1), Block(18, 0, 0))
# Members of an anchor that are compared by one task; a larger anchor is cut into
# slices, and every pair of slices is a task of its own.
SLICE = 20_000
# Rows read before anchors are compared, at least.
GATHER = 200_000
SMALL = 48


def fingerprint(text: str | None, shingle: int) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    found = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not found:
        return 0
    size = min(shingle, len(found))
    ones = np.zeros(64, np.int64)
    total = len(found) - size + 1
    digest = xxhash.xxh64_intdigest
    for low in range(0, total, CHUNK):
        part = found[low : low + CHUNK + size - 1]
        hashes = np.array([digest(b" ".join(s), SEED) for s in zip(*(part[i:] for i in range(size)))], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, *keep: str, shingle: int = 4, text_col: str = "text") -> DataFrame:
    """Columns ``keep`` and ``fp`` (the fingerprint's bits as a long), one row per row."""
    kept = [f"k{i}" for i in range(len(keep))]
    source = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept)], F.col(text_col).alias("t"))
    types = [source.schema[k].dataType.simpleString() for k in kept]
    if set(types) - {"bigint", "int", "string"}:
        raise ValueError(f"cannot carry columns of types {types}")
    arrow = pa.schema([(k, {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[t]) for k, t in zip(kept, types)] + [("fp", pa.int64())])
    schema = ", ".join([f"{k} {t}" for k, t in zip(kept, types)] + ["fp bigint"])
    out = per_row(source, [*kept, "t"], lambda: lambda *row: (*row[:-1], fingerprint(row[-1], shingle)), schema, arrow)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "fp")


def _patterns(block: Block) -> list[np.ndarray]:
    """For each syndrome of the code: what to flip in a block's value to reach the
    anchors within radius + threshold of it."""
    reach = block.radius + block.threshold
    coded = (1 << block.parity) - 1 if block.parity else 0
    free = [0]
    for n in range(1, reach + 1):
        free += [sum(1 << (coded + b) for b in bits) for bits in combinations(range(block.width - coded), n)]
    out: list[list[int]] = [[] for _ in range(1 << block.parity)]
    for n in range(reach + 1):
        for bits in combinations(range(coded), n):
            syndrome, low = 0, 0
            for b in bits:
                syndrome ^= b + 1
                low |= 1 << b
            out[syndrome] += [low | f for f in free if n + f.bit_count() <= reach]
    return [np.array(p, np.int64) for p in out]


def anchor_keys(fps: np.ndarray, layout: tuple[Block, ...] = LAYOUT) -> tuple[np.ndarray, np.ndarray]:
    """(anchor key, index of the fingerprint) for every anchor of every fingerprint."""
    keys, index, start = [], [], 0
    for number, block in enumerate(layout):
        value = ((fps.view(np.uint64) >> np.uint64(start)) & np.uint64((1 << block.width) - 1)).astype(np.int64)
        start += block.width
        syndrome = np.zeros(len(fps), np.int64)
        for b in range((1 << block.parity) - 1):
            syndrome ^= np.where((value >> b) & 1, b + 1, 0)
        for s, flips in enumerate(_patterns(block)):
            at = np.flatnonzero(syndrome == s)
            keys.append(((number << 40) | (value[at, None] ^ flips[None, :])).ravel())
            index.append(np.repeat(at, len(flips)))
    return np.concatenate(keys), np.concatenate(index)


def _check(layout: tuple[Block, ...], max_bits: int) -> None:
    if sum(b.width for b in layout) != 64 or sum(b.threshold + 1 for b in layout) <= max_bits:
        raise ValueError("blocks must hold 64 bits and thresholds that cover max_bits")


def _differing(x: np.ndarray) -> np.ndarray:
    """Bits set; of a negative number numpy would count those of its absolute value."""
    return np.bitwise_count(x.view(np.uint64))


def _near(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of one large group: search from each member among those not reached yet."""
    rest, links = fps, []
    while len(rest):
        root, rest, todo = rest[0], rest[1:], [rest[0]]
        while todo and len(rest):
            near = _differing(rest ^ todo.pop()) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                todo.extend(found)
                links.append((found, np.full(len(found), root)))
    if not links:
        return fps[:0], fps[:0]
    return tuple(np.concatenate(x) for x in zip(*links))


def _compare(keys: np.ndarray, fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over whole groups of equal, adjacent keys."""
    starts, ends = groups(keys)
    size = ends - starts
    a, b = [fps[:0]], [fps[:0]]
    small = np.repeat(size <= SMALL, size)
    k, f = keys[small], fps[small]
    for step in range(1, int(size[size <= SMALL].max(initial=1))):
        hit = (k[step:] == k[:-step]) & (_differing(f[step:] ^ f[:-step]) <= max_bits)
        a.append(f[step:][hit])
        b.append(f[:-step][hit])
    for g in np.flatnonzero(size > SMALL):
        x, y = _near(fps[starts[g] : ends[g]], max_bits)
        a.append(x)
        b.append(y)
    return stars(np.concatenate(a), np.concatenate(b))


def links(fps: DataFrame, *, max_bits: int = 4, layout: tuple[Block, ...] = LAYOUT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp``, enough to connect all that
    are within ``max_bits`` of each other directly or through others."""
    _check(layout, max_bits)

    def spread_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False)
            if len(values):
                keys, index = anchor_keys(values, layout)
                for low in range(0, len(keys), 65_536):
                    part = slice(low, low + 65_536)
                    yield pa.RecordBatch.from_arrays([pa.array(keys[part]), pa.array(values[index[part]])], ["key", "fp"])

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            _, group = np.unique(np.stack([cols[0], cols[1]], 1), axis=0, return_inverse=True) if cols[1].any() else (None, cols[0])
            a, b = _compare(group.ravel(), cols[2], max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append(tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns))
            rows += batch.num_rows
            if rows < GATHER:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            whole = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            if cut:
                yield from out([c[:cut] for c in cols])
            held, rows = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if held:
            yield from out([np.concatenate(c) for c in zip(*held)])

    rows = fps.select("fp").mapInArrow(spread_out, "key bigint, fp bigint")
    large = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("slices")).filter("slices > 1")
    # One row per slice pair that a member belongs to: just one unless the anchor is large.
    one = F.pmod(F.xxhash64("fp"), F.col("slices"))
    pairs = F.when(F.col("slices").isNull(), F.array(F.lit(0).cast("bigint"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1), lambda j: F.least(one, j) * F.col("slices") + F.greatest(one, j) + 1)
    )
    cut = rows.join(large, "key", "left").select("key", F.explode(pairs).alias("part"), "fp")
    met = cut.repartition("key", "part").sortWithinPartitions("key", "part")
    return met.mapInArrow(meet, "a bigint, b bigint").distinct()


def membership(fps: DataFrame, *, id_col: str = "doc_id", max_bits: int = 4, layout: tuple[Block, ...] = LAYOUT) -> DataFrame:
    """(fp, component_id, copies) for every distinct ``fp``: the smallest id of its
    component, and how many rows have that fingerprint."""
    classes = durable(fps.groupBy("fp").agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies")))
    roots = components(links(classes, max_bits=max_bits, layout=layout))
    linked = classes.join(roots, F.col("fp") == F.col("node")).select("fp", "first_id", "root")
    named = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    inside = roots.join(named, "root").select(F.col("node").alias("fp"), "component_id")
    return classes.join(inside.withColumn("inside", F.lit(True)), "fp", "left").select(
        "fp", F.when(F.col("inside"), F.col("component_id")).otherwise(F.col("first_id")).alias("component_id"), "copies"
    )


def near_duplicates(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, layout: tuple[Block, ...] = LAYOUT) -> DataFrame:
    """(doc_id, fp, component_id), one row per row of ``docs``."""
    fps = durable(fingerprints(docs, "doc_id", shingle=shingle))
    member = stored(membership(fps, max_bits=max_bits, layout=layout), "member")
    return join_side(fps, member, "fp", "copies").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, *, shingle: int = 4, max_bits: int = 4, layout: tuple[Block, ...] = LAYOUT) -> DataFrame:
    """The rows of ``docs`` without all but one row of each component: the smallest
    doc_id stays (a null one only if there is no other), ties go to the smaller hash of
    the row, and of fully identical rows one stays."""
    content = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in docs.columns])
    row = fresh(docs, "_row")[0]
    keyed = docs.withColumn(row, content)
    fps = durable(fingerprints(keyed, "doc_id", row, shingle=shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row"))).alias("first")
    # Roots, not component_id: components without any id must stay apart.
    classes = durable(fps.groupBy("fp").agg(first))
    roots = components(links(classes, max_bits=max_bits, layout=layout))
    firsts = classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("root"), "first")
    stay = firsts.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_key"))
    same = keyed["doc_id"].eqNullSafe(stay["_id"]) & (keyed[row] == stay["_key"])
    return keyed.join(stay, same, "left_semi").dropDuplicates(["doc_id", row]).select(*[f"`{c}`" for c in docs.columns])
