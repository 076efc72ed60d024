"""Near-duplicate groups by SuperMinHash signatures, banding, verification and union-find.

A text's set holds its distinct runs of ``shingle`` words (fewer words: one run of all),
each named by a 64-bit hash. Every element of a set throws one permutation of the
registers: at rank j it offers the value (j, random) to one register that it has not
offered to yet. A register keeps the least value. Because the ranks of an element are
spread over all registers without repetition, signatures vary less than those of
independent hashes. Ranks are walked from 0 upwards for all elements at once; a text
stops as soon as no register holds a value of this rank or more, mostly after a few.

80 registers make 20 bands of four. Texts that share a band and agree in 48 registers
(by one byte each) are candidates. At a similarity of 0.8 a pair shares no band with
probability 2.6e-5 and fails the 48 with about 1e-5. Candidates are connected first;
inside such a group every pair that agrees in 48 registers is confirmed on the whole
sets and joined (union-find), unless it is connected already. A band of more than
``SLICE`` texts, or a group of more than ``SET_SLICE`` elements, is cut into slices, and
every pair of slices is a task of its own. Only band keys of two or more texts are
shuffled with signatures, and only texts of candidates are read again.

Texts of equal sets are one class from the start. Nulls: a null text is empty; an empty
set is linked with nothing. A null doc_id counts as larger than all others; a component
without any doc_id has a null component_id. Very long texts: the elements are
taken in pieces of ``PIECE``, so memory is their hashes. Ties and repeated rows give
equal results; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import deal, fresh, groups, join_side, stored
from .components import components, stars

SEED = 42
BANDS, ROWS = 20, 4
REGISTERS = BANDS * ROWS
AGREE = 48
SIMILARITY = (4, 5)  # as a fraction, so that the check has no rounding
SLICE = 20_000
SET_SLICE = 2_000_000
GATHER = 200_000  # rows read before bands are compared, at least
PIECE = 65_536  # elements that are walked together
KNOWN = 1 << 17  # words whose hashes a task remembers
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted hashes of a text's distinct word runs."""

    def __init__(self, size: int):
        self.size = size
        self.known: dict[bytes, int] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # bytes: A-Z only, and the six ASCII spaces
        known = self.known
        if len(known) > KNOWN:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(one))
        if not size:
            return one
        runs = np.full(len(one) - size + 1, size, np.uint64)
        for i in range(size):
            runs = _mix(runs * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - size + 1 + i])
        return np.unique(runs)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Registers of every set: the rank in the upper, the random part in the lower 32 bits."""
    m = REGISTERS
    best = np.full((len(sets), m), _FULL)
    flat = best.reshape(-1)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    for low in range(0, len(elements), PIECE):
        seed, own = elements[low : low + PIECE], owner[low : low + PIECE]
        place = np.tile(np.arange(m, dtype=np.uint8), (len(seed), 1))
        live = np.arange(len(seed))
        for rank in range(m):
            here = own[live]
            first = here[0]
            open_ = best[first : here[-1] + 1].max(1) >= np.uint64(rank << 32)
            live = live[open_[here - first]]
            if not len(live):
                break
            draw = _mix(seed[live] + np.uint64((rank + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            swap = rank + ((draw >> np.uint64(32)) % np.uint64(m - rank)).astype(np.int64)
            register = place[live, swap]
            place[live, swap] = place[live, rank]
            np.minimum.at(flat, own[live] * m + register, np.uint64(rank << 32) | (draw & np.uint64(0xFFFFFFFF)))
    return best


def marked(docs: DataFrame, *keep: str, shingle: int) -> DataFrame:
    """Columns ``keep``, fp (names the set), n (its size), keys (of the bands) and low
    (the lowest byte of each register), one row per row."""
    types = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    kept = [(f"k{i}", docs.schema[c].dataType.simpleString()) for i, c in enumerate(keep)]
    if {t for _, t in kept} - set(types):
        raise ValueError(f"cannot carry columns of types {kept}")
    own = [("fp", pa.int64()), ("n", pa.int64()), ("keys", pa.list_(pa.int64())), ("low", pa.binary())]
    arrow = pa.schema([*[(k, types[t]) for k, t in kept], *own])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(shingle)
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            sets = [cut(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            all_ = signatures(sets)
            fps = np.array([digest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            keys = [digest(all_[d, b * ROWS : (b + 1) * ROWS].tobytes(), b) for d in range(len(sets)) for b in range(BANDS)]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(np.array(keys, np.uint64).view(np.int64)))
            low = [row.tobytes() for row in (all_ & np.uint64(255)).astype(np.uint8)]
            columns = [*batch.columns[:-1], pa.array(fps), pa.array([len(s) for s in sets], pa.int64()), lists, pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    source = [*[F.col(c).alias(k) for c, (k, _) in zip(keep, kept)], F.col("text").alias("t")]
    out = docs.select(*source).mapInArrow(run, ", ".join([f"{k} {t}" for k, t in kept] + ["fp bigint, n bigint, keys array<bigint>, low binary"]))
    return out.select(*[F.col(k).alias(c) for c, (k, _) in zip(keep, kept)], "fp", "n", "keys", "low")


def _parts(slices) -> F.Column:
    """Slice pairs that a member ``fp`` of a key belongs to: just one unless it is cut."""
    one = F.pmod(F.xxhash64("fp"), slices)
    every = F.sequence(F.lit(0).cast("bigint"), slices - 1)
    return F.explode(F.transform(every, lambda j: F.least(one, j) * slices + F.greatest(one, j)))


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    a, b = stars(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _agreeing(fps: np.ndarray, low: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links of one band's members: search from each among those not reached yet."""
    rest, links = np.arange(1, len(fps)), []
    root, todo = 0, [0]
    while len(rest):
        if not todo:
            root, rest = rest[0], rest[1:]
            todo = [root]
            continue
        near = (low[rest] == low[todo.pop()]).sum(1) >= AGREE
        if near.any():
            found, rest = rest[near], rest[~near]
            todo.extend(found)
            links.append((fps[found], np.full(len(found), fps[root])))
    return links


def candidates(classes: DataFrame) -> DataFrame:
    """Links (a, b) that connect all candidates among ``classes`` (fp, n, keys, low)."""

    def meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        rows = 0

        def out(key, part, fps, low) -> pa.RecordBatch:
            edge = np.concatenate([[True], (key[1:] != key[:-1]) | (part[1:] != part[:-1])])
            starts, ends = groups(np.cumsum(edge))
            links = [(fps[:0], fps[:0])]
            for g in np.flatnonzero(ends - starts > 1):
                links += _agreeing(fps[starts[g] : ends[g]], low[starts[g] : ends[g]])
            return _links(*(np.concatenate(x) for x in zip(*links)))

        for batch in batches:
            if not batch.num_rows:
                continue
            low = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(-1, REGISTERS)
            held.append((*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)), low))
            rows += batch.num_rows
            if rows < GATHER:
                continue
            cols = [np.concatenate(c) for c in zip(*held)]
            whole = np.flatnonzero((cols[0] != cols[0][-1]) | (cols[1] != cols[1][-1]))
            cut = whole[-1] + 1 if len(whole) else 0
            if cut:
                yield out(*[c[:cut] for c in cols])
            held, rows = [tuple(c[cut:] for c in cols)], len(cols[0]) - cut
        if held:
            yield out(*[np.concatenate(c) for c in zip(*held)])

    bands = classes.filter("n > 0").select(F.explode("keys").alias("key"), "fp")
    busy = stored(bands.groupBy("key").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "bands")
    # Sides that grow with the documents are joined by shuffle at every size.
    met = bands.join(busy.hint("merge"), "key").join(classes.select("fp", "low"), "fp")
    cut = met.select("key", _parts(F.ceil(F.col("members") / SLICE)).alias("part"), "fp", "low")
    together = cut.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return together.mapInArrow(meet, "a bigint, b bigint").distinct()


def _similar(fps: np.ndarray, sets: list[np.ndarray], low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all pairs of similar sets directly or through others. A pair is
    compared on its sets if it agrees in ``AGREE`` registers and is not connected yet."""
    up, down = SIMILARITY
    a, b = [], []
    rest, todo = np.arange(len(fps)), []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
            continue
        now = todo.pop()
        near = np.zeros(len(rest), bool)
        for i in np.flatnonzero((low[rest] == low[now]).sum(1) >= AGREE):
            x, y = sets[now], sets[rest[i]]
            if down * min(len(x), len(y)) < up * max(len(x), len(y)):
                continue
            common = np.intersect1d(x, y, assume_unique=True).size
            near[i] = common * (up + down) >= up * (len(x) + len(y))
        if near.any():
            found, rest = rest[near], rest[~near]
            a.append(fps[found])
            b.append(np.full(len(found), fps[now]))
            todo.extend(found)
    if not a:
        return fps[:0], fps[:0]
    return np.concatenate(a), np.concatenate(b)


def checked(need: DataFrame, docs: DataFrame, *, shingle: int) -> DataFrame:
    """Links (a, b) that connect all similar texts of a group. ``need`` has key (the
    group), fp, n, low, the row whose text is read (_id, _own) and how many rows (copies)
    are like it at most; ``docs`` has the rows' names (_doc, _own) and text."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Shingler(shingle)
        now, fps, sets, low = None, [], [], []

        def out():
            own = np.frombuffer(b"".join(low), np.uint8).reshape(-1, REGISTERS)
            return _links(*_similar(np.array(fps, np.int64), sets, own))

        for batch in batches:
            for key, part, fp, mark, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (key, part) != now:
                    if len(fps) > 1:
                        yield out()
                    now, fps, sets, low = (key, part), [], [], []
                fps.append(fp)
                sets.append(cut(text))
                low.append(mark)
        if len(fps) > 1:
            yield out()

    weight = stored(need.groupBy("key").agg(F.ceil(F.sum("n") / SET_SLICE).alias("slices")).filter("slices > 1"), "groups")
    # Identical rows are all read as the text of their class: they are dealt out.
    # Only names meet the documents.
    source, entries = deal(docs, need.select("_own", "_id", "fp", "copies"), "_own", "copies", "_salt")
    same = (source["_own"] == entries["_own"]) & (source["_salt"] == entries["_salt"]) & source["_doc"].eqNullSafe(entries["_id"])
    texts = source.join(entries.hint("merge"), same).select("fp", "text").dropDuplicates(["fp"]).join(need.select("fp", "key", "low"), "fp")
    cut = texts.join(weight, "key", "left").withColumn("slices", F.coalesce("slices", F.lit(1).cast("bigint")))
    parts = cut.select("key", _parts(F.col("slices")).alias("part"), "fp", "low", "text")
    together = parts.repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    return together.mapInArrow(compare, "a bigint, b bigint").distinct()


def roots(classes: DataFrame, docs: DataFrame, *, shingle: int) -> DataFrame:
    """(node, root) of every class that is linked; ``classes`` has fp, n, keys, low, copies
    and first (a struct with doc_id and row), ``docs`` has _doc, _own and text."""
    grouped = components(candidates(classes))
    named = classes.join(grouped, F.col("fp") == F.col("node"))
    need = stored(named.select(F.col("root").alias("key"), "fp", "n", "low", "copies", F.col("first.doc_id").alias("_id"), F.col("first.row").alias("_own")), "need")
    return components(checked(need, docs, shingle=shingle))


def first_row(row: str) -> F.Column:
    """The row that stands for a class: the smallest doc_id, a null one last."""
    return F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row).alias("row")))


def near_duplicates(docs: DataFrame, *, shingle: int = 2) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``: a component
    holds the texts that reach each other over pairs of a similarity of 0.8 or more."""
    row = fresh(docs, "_row")[0]
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias(row))
    rows = durable(marked(keyed, "doc_id", row, shingle=shingle))
    classes = rows.filter("n > 0").groupBy("fp").agg(
        first_row(row).alias("first"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("low").alias("low")
    )
    classes = durable(classes)
    linked = roots(classes, keyed.select(F.col("doc_id").alias("_doc"), F.col(row).alias("_own"), "text"), shingle=shingle)
    of = classes.select("fp", "copies", F.col("first.doc_id").alias("least")).join(linked, F.col("fp") == F.col("node"), "left")
    of = of.select("fp", "copies", "least", F.col("root").alias("root"))
    named = of.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    inside = of.join(named.withColumn("inside", F.lit(True)), "root", "left")
    member = inside.select("fp", "copies", F.when(F.col("inside"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    out = join_side(rows.select("doc_id", "fp", "n"), stored(member, "member"), "fp", "copies")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
