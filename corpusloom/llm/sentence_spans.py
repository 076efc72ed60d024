"""Substring dedup by sliding sentence spans.

A text is cut into sentences: after a full stop, an exclamation or question mark that
white space follows, behind those of scripts without spaces, and at line ends. (Two letters
of such scripts count as a word.) From every sentence the shortest run of
consecutive sentences is hashed that has at least ``min_sentences`` sentences and
``min_words`` words, and to every sentence likewise the shortest run that ends there,
so a passage is covered to both its ends wherever it stands. (A single sentence of
``long_sentence`` words is a run by itself.) Runs are joined globally by hash; a run
that occurs more than once keeps its first occurrence, by doc_id and place, and the
sentences of all others are removed.

Hashes are counted with map-side aggregation and joined back, so no occurrence list is
ever gathered; only a document's own removals are, and those are bounded by its
sentences. Words compare in lower case, white space between them does not matter.

Nulls: a null text stays null and has no sentences. Rows with a null doc_id take part and come
last in the order. Rows with the same doc_id and text count as one document and get
the same result. Overlapping repeats within one text are removed like any other. Very
long texts are cut in time in proportion to their length; ties go to the smaller hash. An
empty table gives an empty result. Other columns are ignored by ``removals`` and kept by
``deduplicate``.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import fresh

MIN_SENTENCES = 2
MIN_WORDS = 24
LONG_SENTENCE = 40
# A sentence with the white space behind it; sentences of a text add up to the text.
SENTENCE = re.compile(r"(?:[^\n.!?。！？]++|[.!?]++(?![\s]|\Z))*+(?:[.!?]++\s*+|[。！？]++[”’」』]*+\s*+|\n\s*+|\Z)")
# Letters of scripts without spaces: two count as a word.
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002fa1f]")


def sentences(text: str) -> list[str]:
    return [s for s in SENTENCE.findall(text) if s]


def runs(text: str, min_sentences: int, min_words: int, long_sentence: int) -> list[tuple[int, int, int]]:
    """(hash, first sentence, last sentence) of the runs of a text."""
    found = [s.lower().split() for s in sentences(text)]
    counts = [len(w) for w in found]
    if not text.isascii() and UNSPACED.search(text):
        counts = [n + len(UNSPACED.findall("".join(w))) // 2 for n, w in zip(counts, found)]
    full = [i for i, n in enumerate(counts) if n]  # blank pieces stand between sentences
    before = np.concatenate([[0], np.cumsum([counts[i] for i in full])]).tolist()
    spans = {(i, i) for i, at in enumerate(full) if counts[at] >= long_sentence}
    end = 0
    for start in range(len(full)):
        end = max(end, start + min_sentences - 1)
        while end < len(full) and before[end + 1] - before[start] < min_words:
            end += 1
        if end >= len(full):
            break
        spans.add((start, end))
    start = len(full) - 1
    for end in range(len(full) - 1, -1, -1):
        start = min(start, end - min_sentences + 1)
        while start >= 0 and before[end + 1] - before[start] < min_words:
            start -= 1
        if start < 0:
            break
        spans.add((start, end))
    joined = [" ".join(found[at]) for at in full]
    return [(xxhash.xxh64_intdigest("\n".join(joined[a : b + 1])) - (1 << 63), full[a], full[b]) for a, b in spans]


def removals(docs: DataFrame, *, min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS, long_sentence: int = LONG_SENTENCE) -> DataFrame:
    """(doc_id, text_hash, gone): the numbers of the sentences to remove from a text, as
    an array; texts that lose nothing have no row."""
    schema = pa.schema([("hash", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text_hash, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(h, doc_id, text_hash, a, b) for h, a, b in runs(text, min_sentences, min_words, long_sentence)]
                if len(rows) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    source = docs.filter("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    spans = source.mapInArrow(run, "hash bigint, doc_id bigint, text_hash bigint, first int, last int")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "first")
    counted = spans.groupBy("hash").agg(F.min(place).alias("least"), F.max(place).alias("most"))
    # Durable, so that the join has a shuffle of its own on both sides: Spark can then
    # split a run that a third of all texts share over many tasks.
    repeated = durable(counted.filter("least <> most").select("hash", "least"))
    again = spans.join(repeated, "hash").filter(place != F.col("least"))
    gone = again.select("doc_id", "text_hash", F.explode(F.sequence("first", "last")).alias("s"))
    return gone.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("s")).alias("gone"))


def deduplicate(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with the covered sentences taken out of ``text``, and the columns
    n_sentences and n_removed."""

    @F.pandas_udf("text string, n_sentences bigint, n_removed bigint")
    def cut(texts, gone):
        import pandas as pd

        rows = []
        for text, out in zip(texts, gone):
            found = sentences(text) if text is not None else []
            lost = set() if out is None else set(out.tolist())
            kept = text if not lost else "".join(s for i, s in enumerate(found) if i not in lost)
            rows.append((kept, sum(1 for s in found if s.strip()), sum(1 for i in lost if found[i].strip())))
        return pd.DataFrame(rows, columns=["text", "n_sentences", "n_removed"])

    lost = durable(removals(docs, **settings)).alias("g")
    same = F.col("d.doc_id").eqNullSafe(F.col("g.doc_id")) & (F.xxhash64("d.text") == F.col("g.text_hash"))
    joined = docs.alias("d").join(lost, same, "left")
    others = [c for c in docs.columns if c not in ("text", "n_sentences", "n_removed")]
    name = fresh(docs, "_cut")[0]
    out = joined.select(*[F.col(f"d.`{c}`") for c in others], cut(F.col("d.text"), F.col("g.gone")).alias(name))
    return out.select(*[f"`{c}`" for c in others], f"{name}.text", f"{name}.n_sentences", f"{name}.n_removed")
