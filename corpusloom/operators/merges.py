"""Vocabulary learning: word, character and pair counts, and merge selection.

The corpus is read once, to count distinct words. Merges then change only the words that
an index names, and pair counts by what these words gain and lose. Ids and counts follow the usual
byte-pair scheme; the result is not bit-equal to any C++ trainer.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schema import SPACE_MARK
from ..session import default_parallelism, durable, scratch_path
from .corpus import clean_training_text

# Symbols are written <OPEN>symbol<CLOSE>, so a merge is one literal replacement. The two
# are noncharacters, which Unicode keeps out of texts; a text that holds one is refused.
OPEN, CLOSE = "\ufdd0", "\ufdd1"
COVERAGE = 0.999
# A bound on what a pass brings to the driver; fewer or more give the same merges.
MAX_MERGES_PER_PASS = 64
FOLDERS = 32  # of the pair index
PASSES_PER_CHECK = 6
SPARSE = 16
REBUILD = 4
FIXED = r"^<(0x[0-9A-F]{2}|unk)>$"
# Numbers of symbols: code points, then byte pieces, the unknown symbol, merged pieces.
BYTES, UNK, MERGED = 0x110000, 0x110100, 0x110200
KNOWN = 1 << 18  # distinct pieces that a task holds before it hands them on
GATHER = 1 << 17  # words that a task merges together
SCHEMA = "word BIGINT, symbols ARRAY<INT>, n BIGINT, hit BOOLEAN, left STRING, right STRING"
COLUMNS = ["word", "symbols", "n", "hit", "left", "right"]


def words(text: Column, split_digits: bool = True) -> Column:
    """Words of a text: a word starts with the mark that stands for the space before
    it (none at the start of the text); digits are cut apart."""
    marked = F.regexp_replace(text, r"\s+", SPACE_MARK)
    pattern = f"(?={SPACE_MARK})"
    if split_digits:
        pattern += r"|(?<=\p{Nd})|(?=\p{Nd})"
    return F.filter(F.split(marked, pattern), lambda w: w != "")


def word_counts(docs: DataFrame, split_digits: bool = True, normalise: bool = True) -> DataFrame:
    """(word, n) over whole cleaned texts. Texts are cut at white space and counted in the
    tasks; the pattern for words sees distinct pieces only. No word reaches over white
    space, so the words are those of whole texts."""
    pieces = docs.select("text").mapInArrow(_pieces(normalise), "piece STRING, n BIGINT").groupBy("piece").agg(F.sum("n").alias("n"))
    return pieces.select(F.explode(words(F.col("piece"), split_digits)).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n"))


def _pieces(normalise: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces between white space, with the mark of the space before them, and their counts."""
    mark, space = SPACE_MARK.encode(), b" \t\n\x0b\f\r"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, later = Counter(), Counter()

        def out() -> pa.RecordBatch:
            found = [*first, *(mark + piece for piece in later)]
            counts = pa.array([*first.values(), *later.values()], pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(found, pa.binary()).cast(pa.string()), counts], names=["piece", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                if normalise and not text.isascii():
                    text = unicodedata.normalize("NFKC", text)
                raw = text.encode()
                parts = raw.split()  # bytes: the six ASCII spaces, those of the pattern
                if parts and raw[0] not in space:
                    first[parts[0]] += 1
                    del parts[0]
                later.update(parts)
                if raw[-1] in space:
                    later[b""] += 1
            if len(first) + len(later) > KNOWN:
                yield out()
                first.clear()
                later.clear()
        yield out()

    return run


def char_counts(counted_words: DataFrame) -> DataFrame:
    chars = F.explode(F.split("word", ""))
    return counted_words.select(chars.alias("char"), "n").groupBy("char").agg(F.sum("n").alias("n"))


def alphabet(counted_words: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """(char, n): most frequent characters until ``coverage`` of the text is reached.
    The window sees distinct characters only, at most the size of Unicode."""
    reserved = F.raise_error(F.lit("a text holds a noncharacter that delimits symbols")).cast("string")
    chars = char_counts(counted_words).select(F.when(F.col("char").isin(OPEN, CLOSE), reserved).otherwise(F.col("char")).alias("char"), "n")
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "char")
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return chars.select("char", "n", before.alias("_b"), total.alias("_t")).filter(
        F.col("_b") < F.lit(coverage) * F.col("_t")
    ).select("char", "n")


def spell(counted_words: DataFrame, chars: DataFrame, byte_fallback: bool = True) -> DataFrame:
    """(symbols, n): words as symbol strings; characters outside the alphabet become
    byte pieces, or one unknown symbol."""
    # The alphabet is a bounded set (Unicode); as one string it is a scalar, and
    # deleting its characters from a word tells whether the word has a rare one.
    known = chars.agg(F.array_join(F.sort_array(F.collect_list("char")), "")).scalar()
    rare_part = lambda c: F.call_function("translate", c, F.col("_known"), F.lit(""))
    plain = F.regexp_replace("word", "(?s)(.)", f"{OPEN}$1{CLOSE}")

    def symbol(c: Column) -> Column:
        as_bytes = F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", f"{OPEN}<0x$1>{CLOSE}")
        fallback = as_bytes if byte_fallback else F.lit(f"{OPEN}<unk>{CLOSE}")
        return F.when(rare_part(c) == "", F.concat(F.lit(OPEN), c, F.lit(CLOSE))).otherwise(fallback)

    mixed = F.concat_ws("", F.transform(F.split("word", ""), symbol))
    spelled = counted_words.withColumn("_known", known)
    return spelled.select(F.when(rare_part(F.col("word")) == "", plain).otherwise(mixed).alias("symbols"), "n")


def _symbols(col: str) -> Column:
    return F.split(F.expr(f"substring({col}, 2, length({col}) - 2)"), f"{CLOSE}{OPEN}")


def pair_counts(spelled: DataFrame) -> DataFrame:
    """(left, right, n): adjacent symbol pairs, weighted by word count. A byte piece
    never takes part in a merge."""
    s = spelled.select(_symbols("symbols").alias("s"), "n").filter(F.size("s") > 1)
    pairs = F.zip_with(
        F.expr("slice(s, 1, size(s) - 1)"),
        F.expr("slice(s, 2, size(s) - 1)"),
        lambda a, b: F.struct(a.alias("left"), b.alias("right")),
    )
    counted = s.select(F.explode(pairs).alias("p"), "n").groupBy("p.left", "p.right").agg(F.sum("n").alias("n"))
    # The patterns look at distinct pairs only, behind the aggregation.
    return counted.filter(~F.col("left").rlike(FIXED) & ~F.col("right").rlike(FIXED))


def _batch(top: list, room: int, complete: bool) -> list:
    """Longest prefix of the ranked pairs that one-by-one merging would also take.

    Two pairs can only touch each other where the right symbol of one is the left
    symbol of the other. In a prefix without such a chain no count changes, and
    every new pair (z, ab), (ab, z) or (ab, cd) occurs at most as often as some old
    pair that would chain, i.e. one ranked behind the prefix. So the prefix is safe
    as long as its last count is strictly above the next one's; the first pair
    always is. ``complete`` says that no pair is ranked behind ``top``.
    """
    lefts, rights, length = set(), set(), 0
    for row in top[: room if complete else min(room, len(top) - 1)]:
        left, right = row["left"], row["right"]
        chained = left in rights or right in lefts
        if length and chained:
            break
        lefts.add(left)
        rights.add(right)
        length += 1
        if left == right:
            # (aa, aa) may occur nearly as often as (a, a) itself: merge alone or last.
            break
    while length > 1 and length < len(top) and top[length]["n"] == top[length - 1]["n"]:
        length -= 1
    return top[: max(length, 1)]


def _fixed_id(piece: str) -> int | None:
    """The number of a piece that never merges."""
    if re.fullmatch(FIXED, piece):
        return UNK if piece == "<unk>" else BYTES + int(piece[3:5], 16)
    return None


def _numbered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words (symbols as a string, n) with numbered symbols, and the counts of their pairs."""
    for rows in _gathered(batches):
        known: dict[str, int] = {}
        words = [t[1:-1].split(CLOSE + OPEN) for t in rows.column(0).to_pylist()]
        for symbol in {x for w in words for x in w}:
            known[symbol] = ord(symbol) if len(symbol) == 1 else _fixed_id(symbol)
        ends = np.cumsum([0, *map(len, words)])
        values = np.fromiter((known[x] for w in words for x in w), np.int32, ends[-1])
        n = rows.column(1).to_numpy()
        owner = np.repeat(np.arange(len(n)), np.diff(ends))
        yield _rows(np.full(len(n), -1), values, ends, n, np.zeros(len(n), bool))
        yield _changes(*_weighted(values, owner, n), [])


def _merged(batch: Sequence[tuple[int, int, int]], names: Sequence[str], only_hit: bool) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words (word, symbols, n) after the merges (left, right, new) of ``batch``, one after
    the other, and how the counts of pairs change."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _gathered(batches):
            word, symbols, n = rows.column(0).to_numpy(), rows.column(1), rows.column(2).to_numpy()
            ends = symbols.offsets.to_numpy().astype(np.int64)
            values = symbols.values.to_numpy()[ends[0] : ends[-1]].copy()
            owner = np.repeat(np.arange(len(n)), np.diff(ends))
            old, old_owner, hit = values.copy(), owner, np.zeros(len(n), bool)
            for left, right, new in batch:
                at = np.flatnonzero((values[:-1] == left) & (values[1:] == right) & (owner[:-1] == owner[1:]))
                if left == right and len(at):
                    # In a run of equal symbols every other pair, from the left.
                    place = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, place, 0))
                    at = at[(place - begin) % 2 == 0]
                hit[owner[at]] = True
                values[at] = new
                values, owner = np.delete(values, at + 1), np.delete(owner, at + 1)
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(n)))])
            before, after = hit[old_owner], hit[owner]
            gone = _weighted(old[before], old_owner[before], -n)
            come = _weighted(values[after], owner[after], n)
            yield _changes(*(np.concatenate(x) for x in zip(gone, come)), names)
            if only_hit:
                lengths = np.diff(ends)[hit]
                yield _rows(word[hit], values[after], np.concatenate([[0], np.cumsum(lengths)]), n[hit], hit[hit])
            else:
                yield _rows(word, values, ends, n, hit)

    return run


def _gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about ``GATHER`` rows."""
    held, rows = [], 0
    for batch in filter(len, batches):
        held.append(batch)
        rows += batch.num_rows
        if rows >= GATHER:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _weighted(values: np.ndarray, owner: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjacent pairs that may merge, as left << 32 | right, and the counts of their words."""
    free = (values < BYTES) | (values >= MERGED)
    inside = (owner[:-1] == owner[1:]) & free[:-1] & free[1:]
    wide = values.astype(np.int64)
    return (wide[:-1] << 32 | wide[1:])[inside], n[owner[:-1][inside]]


def _changes(keys: np.ndarray, counts: np.ndarray, names: Sequence[str]) -> pa.RecordBatch:
    """Rows of the changed pair counts, with their symbols as text."""
    pairs, at = np.unique(keys, return_inverse=True)
    sums = np.zeros(len(pairs), np.int64)
    np.add.at(sums, at, counts)
    pairs, sums = pairs[sums != 0], sums[sums != 0]
    name = lambda i: chr(i) if i < BYTES else names[i - MERGED]
    sides = [pa.array([name(i) for i in side.tolist()], pa.string()) for side in (pairs >> 32, pairs & 0xFFFFFFFF)]
    none = [pa.nulls(len(pairs), t) for t in (pa.int64(), pa.list_(pa.int32()), pa.bool_())]
    return pa.RecordBatch.from_arrays([none[0], none[1], pa.array(sums), none[2], *sides], names=COLUMNS)


def _rows(word: np.ndarray, values: np.ndarray, ends: np.ndarray, n: np.ndarray, hit: np.ndarray) -> pa.RecordBatch:
    symbols = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))
    none = pa.nulls(len(n), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), symbols, pa.array(n.astype(np.int64)), pa.array(hit), none, none], names=COLUMNS)


class _Words:
    """Words, an index from pairs to the words that hold them, and pair counts, kept up
    to date merge by merge. Counts change by what the touched words lose and gain.

    Symbols are numbers: code points, byte pieces, merged pieces in order; equal pieces
    have equal numbers. The first merges touch most words: each rewrites the word table,
    without a shuffle. Once a pass touches fewer than ``1 / SPARSE`` of the words, the
    index is written: the words by pair, in folders. From then on a pass opens only the
    folders of the pairs that it merges. Words that have changed since are kept beside it,
    the newest form of a word counts. When they make up more than ``1 / REBUILD`` of all
    words, they go back into the word table.
    """

    def __init__(self, spelled: DataFrame):
        self.spark = spelled.sparkSession
        self.names: list[str] = []  # of merged pieces
        self.ids: dict[str, int] = {}
        made = spelled.select("symbols", "n").mapInArrow(_numbered, SCHEMA)
        # A word is named by its place in the table as first written.
        word = F.when(F.col("symbols").isNotNull(), F.monotonically_increasing_id())
        made = self._written(made.withColumn("word", word))
        self.base = made.filter("word is not null").select("word", "symbols", "n")
        self.counts = durable(made.filter("word is null").groupBy("left", "right").agg(F.sum("n").alias("n")))
        self.total = self.base.count()
        self.passes: list[DataFrame] = []  # words touched by each pass since, with their new symbols
        self.index: DataFrame | None = None

    def _written(self, df: DataFrame) -> DataFrame:
        path = scratch_path(self.spark, "words")
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _id(self, piece: str) -> int:
        if len(piece) == 1:
            return ord(piece)
        fixed = _fixed_id(piece)
        if fixed is not None:
            return fixed
        if piece not in self.ids:
            self.ids[piece] = MERGED + len(self.names)
            self.names.append(piece)
        return self.ids[piece]

    def top(self, limit: int) -> list:
        """Pairs by falling count."""
        return self.counts.orderBy(F.desc("n"), "left", "right").limit(limit).select("left", "right", "n").collect()

    def _changed(self) -> DataFrame:
        """Newest form of the words that passes have touched."""
        all_ = None
        for i, touched in enumerate(self.passes):
            own = touched.select("word", F.struct(F.lit(i).alias("pass"), "symbols", "n").alias("s"))
            all_ = own if all_ is None else all_.unionByName(own)
        return all_.groupBy("word").agg(F.max("s").alias("s")).select("word", "s.symbols", "s.n")

    def _write_index(self) -> None:
        path = scratch_path(self.spark, "pairs")
        inner = F.greatest(F.size("symbols") - 1, F.lit(0))
        both = F.zip_with(F.slice("symbols", F.lit(1), inner), F.slice("symbols", F.lit(2), inner), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
        free = lambda c: (c < BYTES) | (c >= MERGED)
        pairs = F.array_distinct(F.filter(both, lambda p: free(p["left"]) & free(p["right"])))
        rows = self.base.select("word", "symbols", "n", F.explode(pairs).alias("p"))
        rows = rows.select(_folder(F.col("p.left"), F.col("p.right")).alias("folder"), "p.left", "p.right", "word", "symbols", "n")
        # A folder with a pair of most words is cut into several tasks, small ones share one.
        rows.hint("rebalance", F.col("folder")).write.partitionBy("folder").parquet(path)
        self.index = self.spark.read.schema(rows.schema).parquet(path)

    def merge(self, batch: list) -> None:
        """Apply ``batch`` (at most ``MAX_MERGES_PER_PASS`` rows) to the words that hold its pairs."""
        merges = [(self._id(r["left"]), self._id(r["right"]), self._id(r["left"] + r["right"])) for r in batch]
        if self.index is None:
            rows, holds = self.base, None
        else:
            folders = sorted({(left * 31 + right) % FOLDERS for left, right, _ in merges})
            holds = F.lit(False)
            for left, right, _ in merges:
                holds = holds | ((F.col("left") == left) & (F.col("right") == right))
            rows = self.index.filter(F.col("folder").isin(folders) & holds).select("word", "symbols", "n").dropDuplicates(["word"])
            if self.passes:
                changed = self._changed()
                rows = rows.join(changed.select("word"), "word", "left_anti").unionByName(changed)
        done = self._written(rows.mapInArrow(_merged(merges, list(self.names), holds is not None), SCHEMA))
        words = done.filter("word is not null")
        delta = done.filter("word is null").select("left", "right", "n")
        self.counts = durable(self.counts.unionByName(delta).groupBy("left", "right").agg(F.sum("n").alias("n")).filter("n > 0"))
        if holds is None:
            self.base = words.select("word", "symbols", "n")
            if words.filter("hit").count() * SPARSE < self.total:
                self._write_index()
            return
        self.passes.append(words.select("word", "symbols", "n"))
        if len(self.passes) >= PASSES_PER_CHECK:
            self._tidy()

    def _tidy(self) -> None:
        """One table for the passes so far; the index anew if they touched many words."""
        changed = self._written(self._changed())
        if changed.count() * REBUILD > self.total:
            self.base = self._written(self.base.join(changed.select("word"), "word", "left_anti").unionByName(changed))
            self.passes, self.index = [], None
        else:
            self.passes = [changed]


def _folder(left: Column, right: Column) -> Column:
    return ((left * 31 + right) % FOLDERS).cast("int")


def learn_merges(
    docs: DataFrame,
    n_merges: int,
    *,
    max_docs: int | None = None,
    split_digits: bool = True,
    byte_fallback: bool = True,
    coverage: float = COVERAGE,
    normalise: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(merges, alphabet): merges are (rank, left, right, piece, n), ties by lowest pair.

    Only the top pairs of a pass (at most ``MAX_MERGES_PER_PASS`` + 1 rows) reach the
    driver; words stay distributed, and a pass works on the words that hold its pairs.
    """
    spark = docs.sparkSession
    counted = durable(word_counts(clean_training_text(docs, max_docs), split_digits, normalise))
    chars = alphabet(counted, coverage)
    table = _Words(spell(counted, chars, byte_fallback).groupBy("symbols").agg(F.sum("n").alias("n")))
    learned: list[tuple[int, str, str, str, int]] = []
    while len(learned) < n_merges:
        top = table.top(MAX_MERGES_PER_PASS + 1)
        if not top:
            break
        room = min(MAX_MERGES_PER_PASS, n_merges - len(learned))
        batch = _batch(top, room, complete=len(top) <= MAX_MERGES_PER_PASS)
        learned += [(len(learned) + i, r["left"], r["right"], r["left"] + r["right"], r["n"]) for i, r in enumerate(batch)]
        if len(learned) < n_merges:
            table.merge(batch)
    schema = "rank BIGINT, left STRING, right STRING, piece STRING, n BIGINT"
    return spark.createDataFrame(learned, schema), chars


def vocabulary(spark: SparkSession, merges: DataFrame, chars: DataFrame) -> DataFrame:
    """(token_id, piece, kind): special ids 0..3, 256 byte pieces, merges by rank, then
    characters by frequency."""
    special = spark.createDataFrame(
        [(0, "<pad>", "control"), (1, "<s>", "control"), (2, "</s>", "control"), (3, "<unk>", "unknown")],
        "token_id INT, piece STRING, kind STRING",
    )
    byte_pieces = spark.range(256).select(
        (F.col("id") + 4).cast("int").alias("token_id"),
        F.format_string("<0x%02X>", "id").alias("piece"),
        F.lit("byte").alias("kind"),
    )
    # Pieces are bounded by the requested vocabulary, characters by Unicode.
    ranked = merges.select(F.lit(0).alias("g"), F.col("rank").alias("r"), "piece").unionByName(
        chars.select(F.lit(1).alias("g"), (-F.col("n")).alias("r"), F.col("char").alias("piece"))
    )
    position = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("g", "r", "piece"))
    pieces = ranked.select((position + 259).cast("int").alias("token_id"), "piece", F.lit("normal").alias("kind"))
    return special.unionByName(byte_pieces).unionByName(pieces)
