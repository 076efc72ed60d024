"""Ranked lexical search, reversed: the queries are indexed, the documents stream through.

The items' terms form an inverted index (term -> items). It is sent to all tasks in
blocks of at most ``MAX_POSTINGS`` postings, so its size is bounded; more items mean more
blocks, each with a pass of its own over the documents. A first pass counts documents,
terms and, for the terms of the index, the documents that hold them. A second pass
streams each document's term counts through the index, which adds up the scores of all
items it touches, and keeps the ``k`` best documents of every item in a bounded heap per
task. The heaps, k rows an item and task, are merged by a window limited to k.

Terms are runs of ASCII letters and digits and of all characters beyond ASCII; only A-Z
are lower-cased. Weights and scores are those of the contract: integers, except for one
logarithm per term.

Items: rows of one item id are one item that asks for all their terms. A null id is an
item too; an item without terms gets no rows. Nulls: a null text has no terms. Documents
with a null id rank behind equal scores. Repeated rows are documents of their own, with
consecutive ranks. Empty tables on either side give an empty result. Very long texts are
counted in pieces of ``PIECE`` bytes. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MAX_POSTINGS = 2_000_000
MAX_ITEM_BYTES = 64_000_000  # of the items' texts read by the driver
PIECE = 1 << 20
CELLS = 2_000_000  # scores held at once: documents times items
SCALE = 1_000_000_000
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
# A byte that is no part of a term becomes a space; A-Z become a-z.
_FOLD = bytes((bytes([b]).lower()[0] if b in _KEPT else 0x20) for b in range(256))


def term_counts(text: str | None) -> Counter:
    """How often each term (UTF-8) occurs."""
    folded = (text or "").encode().translate(_FOLD)
    if len(folded) <= PIECE:
        return Counter(folded.split())
    out, low = Counter(), 0
    while low < len(folded):
        high = folded.find(b" ", low + PIECE)
        high = len(folded) if high < 0 else high
        out.update(folded[low:high].split())
        low = high
    return out


class Index:
    """Numbered terms and, for each, the items that ask for it."""

    def __init__(self, asked: list[tuple[int, set[bytes]]]):
        self.items = [item for item, _ in asked]
        self.terms: dict[bytes, int] = {}
        lists: list[list[int]] = []
        for at, (_, terms) in enumerate(asked):
            for t in sorted(terms):
                number = self.terms.setdefault(t, len(lists))
                if number == len(lists):
                    lists.append([])
                lists[number].append(at)
        self.size = np.array([len(x) for x in lists], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.postings = np.array([i for x in lists for i in x], np.int64)

    def found(self, text: str | None) -> tuple[int, np.ndarray, np.ndarray]:
        """A text's number of terms, and numbers and counts of those in the index."""
        counts = term_counts(text)
        known = counts.keys() & self.terms.keys()
        number = np.fromiter((self.terms[t] for t in known), np.int64, len(known))
        times = np.fromiter((counts[t] for t in known), np.int64, len(known))
        return counts.total(), number, times


def blocks(items: DataFrame, id_col: str, text_col: str, max_postings: int = MAX_POSTINGS) -> list[Index]:
    """The items' index in blocks. Items are queries: a table whose texts exceed
    ``MAX_ITEM_BYTES`` is refused, not cut."""
    size = items.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    if size > MAX_ITEM_BYTES:
        raise ValueError(f"items of {size} bytes are too large for the driver")
    asked: dict[int | None, set[bytes]] = {}
    for item, text in items.select(F.col(id_col).cast("bigint"), text_col).collect():
        asked.setdefault(item, set()).update(term_counts(text))
    out: list[Index] = []
    now: list[tuple[int | None, set[bytes]]] = []
    postings = 0
    for item in sorted(asked, key=lambda i: (i is None, i)):
        terms = asked[item]
        if terms and now and postings + len(terms) > max_postings:
            out.append(Index(now))
            now, postings = [], 0
        if terms:
            now.append((item, terms))
            postings += len(terms)
    return out + ([Index(now)] if now else [])


def statistics(docs: DataFrame, index: Index, text_col: str = "text") -> tuple[int, int, np.ndarray]:
    """Documents with a term, all terms with repeats, and documents per term of the index."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    arrow = pa.schema([("term", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        holding, documents, total = np.zeros(len(index.size), np.int64), 0, 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, number, _ = index.found(text)
                documents += n > 0
                total += n
                holding[number] += 1
        terms = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([terms, [-1, -2]])), pa.array(np.concatenate([holding[terms], [documents, total]]).astype(np.int64))], schema=arrow
        )

    # One row a term of the index at most: bounded by MAX_POSTINGS.
    rows = docs.select(text_col).mapInArrow(run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    counted = {r["term"]: r["n"] for r in rows}
    holding = np.zeros(len(index.size), np.int64)
    for term, n in counted.items():
        if term >= 0:
            holding[term] = n
    return counted.get(-1, 0), counted.get(-2, 0), holding


def weights(documents: int, holding: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of a term's rarity, rounded down."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(h) + 1))) for h in holding], np.int64)


def top_documents(docs: DataFrame, items: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", max_postings: int = MAX_POSTINGS) -> DataFrame:
    """(item_col, rank, id_col, score): the ``k`` best documents of every item, none
    with a score of 0."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("t"))
    heaps = texts.sparkSession.createDataFrame([], "item bigint, none boolean, id bigint, score bigint")
    for index in blocks(items, item_col, item_text_col, max_postings):
        documents, total, holding = statistics(texts, index, "t")
        heaps = heaps.unionByName(_heaps(texts, index, weights(documents, holding), documents, total, k))
    best = Window.partitionBy("item").orderBy(F.desc("score"), "none", "id")
    ranked = heaps.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _heaps(texts: DataFrame, index: Index, weight: np.ndarray, documents: int, total: int, k: int) -> DataFrame:
    shared = texts.sparkSession.sparkContext.broadcast((index, weight))
    arrow = pa.schema([("item", pa.int64()), ("none", pa.bool_()), ("id", pa.int64()), ("score", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, weight = shared.value
        items = len(index.items)
        step = max(1, CELLS // items)
        # The heaps, as columns ordered by item; ``least`` is the score a newcomer must reach.
        heap = [np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64), np.empty(0, np.int64)]
        least = np.ones(items, np.int64)

        def add(keys: list[int | None], rows: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
            nonlocal heap
            number = np.concatenate([r[1] for r in rows])
            times = np.concatenate([r[2] for r in rows])
            own = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
            # Longer documents count each occurrence for less. Whole numbers of any size.
            damp = np.array([100 - 90 + (90 * r[0] * documents) // total for r in rows], np.int64)
            part = weight[number] * ((SCALE * times) // (1000 * times + 8 * damp[own]))
            reach = index.size[number]
            ends = np.cumsum(reach)
            posting = np.repeat(index.first[number] - ends + reach, reach) + np.arange(ends[-1] if len(ends) else 0)
            score = np.zeros(len(rows) * items, np.int64)
            np.add.at(score, np.repeat(own, reach) * items + index.postings[posting], np.repeat(part, reach))
            row, item = np.nonzero(score.reshape(len(rows), items) >= least)
            if not len(row):
                return
            none = np.array([x is None for x in keys])
            ids = np.array([0 if x is None else x for x in keys], np.int64)
            new = (item, none[row], ids[row], score.reshape(len(rows), items)[row, item])
            cols = [np.concatenate(pair) for pair in zip(heap, new)]
            order = np.lexsort((cols[2], cols[1], -cols[3], cols[0]))
            cols = [c[order] for c in cols]
            starts = np.flatnonzero(np.diff(cols[0], prepend=-1))
            place = np.arange(len(order)) - np.repeat(starts, np.diff(np.append(starts, len(order))))
            heap = [c[place < k] for c in cols]
            full = np.bincount(heap[0], minlength=items) == k
            last = np.append(np.flatnonzero(np.diff(heap[0])), len(heap[0]) - 1)
            lowest = np.ones(items, np.int64)
            lowest[heap[0][last]] = heap[3][last]
            least[full] = lowest[full]

        for batch in batches:
            keys, rows = [], []
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = index.found(text)
                if not len(found[1]):
                    continue
                keys.append(key)
                rows.append(found)
                if len(rows) >= step:
                    add(keys, rows)
                    keys, rows = [], []
            if rows:
                add(keys, rows)
        names = [index.items[i] for i in heap[0]]
        ids = pa.array(heap[2], mask=heap[1])
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(heap[1]), ids, pa.array(heap[3])], schema=arrow)

    return texts.mapInArrow(run, "item bigint, none boolean, id bigint, score bigint")
