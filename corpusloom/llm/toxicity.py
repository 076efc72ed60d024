"""Toxicity by a classifier chain over hashed word features.

Categories are predicted one after the other by linear models (logistic regression).
Each model sees the text's features and the probabilities of the categories before it.
In training these probabilities are out-of-fold: every labelled row gets them from a
model that was fitted without the row's fold, so later models learn how good earlier
ones are on texts they have not seen. For prediction each category's model is fitted
on all training rows; its threshold is the one that separates the out-of-fold
probabilities best.

Features are the distinct words of a text, lower-cased, and their beginnings of five
letters (which stand for all inflected forms), and three shape measures. Of the
words, those are kept that differ most in frequency between the classes of some
category, ``FEATURES`` in all. Fitting takes a bounded sample: ``MAX_TRAIN`` labelled rows,
those with the smallest hash of their id (all, if there are fewer). The sample and
its features are a few megabytes and are fitted on the driver; prediction reads
every text.

Nulls: a null or empty text has no words and is predicted like any other; labels that
are null, and labels without a document, teach nothing; a null doc_id matches no label.
A document with several labels teaches each. Without labelled rows of both
classes a category's probability is 0. An empty table gives an empty result. Other
columns are ignored. Repeated rows are predicted each.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import per_row, stored

MAX_TRAIN = 10_000
FEATURES = 512
FOLDS = 3
PREFIX = 5
LEAST_TEXTS = 5  # training texts that hold a feature
LEAST_ERRORS = 4.0  # standard errors between the classes
SHAPES = 3
LETTERS = re.compile(r"[^\W\d_]+")


def features(text: str | None) -> set[str]:
    found = set(LETTERS.findall((text or "").lower()))
    return found | {w[:PREFIX] + "*" for w in found if len(w) > PREFIX}


def shapes(text: str | None) -> list[float]:
    """Share of repeated words, symbols for each word (up to 1), and length, all 0 to 1."""
    words = (text or "").split()
    n = max(len(words), 1)
    symbols = sum(map((text or "").count, "#*$%&|<>"))
    return [1 - len(set(words)) / n if words else 0.0, min(symbols / n, 1.0), min(math.log1p(n) / 12, 1.0)]


@dataclass
class Linear:
    weights: np.ndarray
    bias: float
    threshold: float = 0.5

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights + self.bias, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 200, ridge: float = 1e-3) -> Linear:
    """Logistic regression, classes weighted equally, by accelerated gradient steps."""
    positive = y.sum()
    if not positive or positive == len(y):
        return Linear(np.zeros(x.shape[1], np.float32), -30.0)
    share = np.where(y > 0, 0.5 / positive, 0.5 / (len(y) - positive)).astype(np.float32)
    w = np.zeros(x.shape[1] + 1, np.float32)
    ahead = w.copy()
    step = np.float32(4 / (1 + float(np.max(share @ (x * x).sum(1)))))
    for n in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ ahead[:-1] + ahead[-1], -30, 30)))
        g = share * (p - y)
        slope = np.append(x.T @ g + ridge * ahead[:-1], g.sum()).astype(np.float32)
        new = ahead - step * slope
        ahead = new + np.float32(n / (n + 3)) * (new - w)
        w = new
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Categories in order, and the model of each over features and earlier probabilities."""

    categories: tuple[str, ...]
    vocabulary: dict[str, int]
    models: list[Linear]

    def row(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(self.vocabulary) + SHAPES, np.float32)
        out[[self.vocabulary[w] for w in features(text) if w in self.vocabulary]] = 1
        out[len(self.vocabulary) :] = shapes(text)
        return out

    def probabilities(self, text: str | None) -> list[float]:
        x = self.row(text)
        for model in self.models:
            x = np.append(x, np.float32(model.probability(x)))
        return [round(float(p), 6) for p in x[len(x) - len(self.models) :]]


def border(p: np.ndarray, y: np.ndarray) -> float:
    """The probability that separates the classes best (F1), half way to the next one."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    last = np.append(p[order][1:] != p[order][:-1], True)  # ties stay together
    f1 = np.where(last, 2 * hits / (np.arange(1, len(y) + 1) + max(y.sum(), 1)), -1)
    at = int(f1.argmax())
    below = p[order][at + 1] if at + 1 < len(p) else 0.0
    return float(min(max((p[order][at] + below) / 2, 0.1), 0.9))


def fit_chain(x: np.ndarray, labels: np.ndarray, fold: np.ndarray, folds: int = FOLDS) -> list[Linear]:
    """Models of the chain; ``labels`` has one column a category, ``fold`` a number a row."""
    models = []
    for k in range(labels.shape[1]):
        y = labels[:, k].astype(np.float32)
        models.append(fit(x, y))
        unseen = np.zeros(len(y), np.float32)
        for f in range(folds):
            out = fold == f
            if out.any():
                unseen[out] = fit(x[~out], y[~out]).probability(x[out])
        models[-1].threshold = border(unseen, y)
        x = np.column_stack([x, unseen])
    return models


def _place(doc_id: Column) -> Column:
    return F.xxhash64(F.lit("toxicity"), doc_id)


def train(docs: DataFrame, labels: DataFrame, categories: dict[str, str], *, max_train: int = MAX_TRAIN, n_features: int = FEATURES) -> Chain:
    """``categories``: name to SQL condition over the columns of ``labels``, in order."""
    names = tuple(categories)
    marks = [F.expr(sql).cast("int").alias(f"y{i}") for i, sql in enumerate(categories.values())]
    marked = labels.select(F.col("doc_id").cast("bigint").alias("key"), *marks).dropna()
    ys = [f"y{i}" for i in range(len(names))]
    # Repeated rows and labels without a document take no places of the sample.
    texts = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.xxhash64("text").alias("text_hash")).distinct()
    known = texts.join(marked.distinct(), "key")
    # max_train rows of a few numbers: bounded whatever the tables hold.
    sample = stored(known.orderBy(_place(F.col("key")), "text_hash", *ys).limit(max_train), "sample")
    named = docs.select(F.col("doc_id").cast("bigint").alias("key"), F.xxhash64("text").alias("text_hash"), "text").join(F.broadcast(sample), ["key", "text_hash"])
    text_of = named.dropDuplicates(["key", "text_hash", *ys]).select("key", "text", *ys)
    schema = pa.schema([("word", pa.string()), ("key", pa.int64()), *[(f"y{i}", pa.int64()) for i in range(len(names))], ("n", pa.int64()), ("shape", pa.list_(pa.float64()))])
    fields = ", ".join(f"y{i} bigint" for i in range(len(names)))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for _, text, *y in zip(*(c.to_pylist() for c in batch.columns)):
                found = features(text)
                for i, one in enumerate(y):
                    if one:
                        seen.update((i, w) for w in found)
                seen.update((-1, w) for w in found)
        words = {w for _, w in seen}
        rows = [(w, None, *[seen[(i, w)] for i in range(len(names))], seen[(-1, w)], None) for w in words]
        for low in range(0, len(rows), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[low : low + 20_000]), schema.types)], schema=schema)

    counted = text_of.mapInArrow(count, f"word string, key bigint, {fields}, n bigint, shape array<double>")
    sums = durable(counted.groupBy("word").agg(F.sum("n").alias("n"), *[F.sum(y).alias(y) for y in ys]))
    total = sample.agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"y{i}").alias(f"y{i}") for i in range(len(names))]).first()
    chosen: dict[str, int] = {}
    for i in range(len(names)):
        with_, without = float(total[f"y{i}"] or 0), float((total["n"] or 0) - (total[f"y{i}"] or 0))
        if not with_ or not without:
            continue
        a, b, all_ = F.col(f"y{i}") / with_, (F.col("n") - F.col(f"y{i}")) / without, F.col("n") / (with_ + without)
        # difference of the two shares in standard errors
        spread = F.abs(a - b) / F.sqrt(F.greatest(all_ * (1 - all_), F.lit(1e-9)) * (1 / with_ + 1 / without))
        best = sums.filter(f"n >= {LEAST_TEXTS}").filter(spread >= LEAST_ERRORS).orderBy(F.desc(F.round(spread, 9)), "word").limit(n_features // len(names)).select("word").collect()
        for row in best:
            chosen.setdefault(row["word"], len(chosen))
    chain = Chain(names, chosen, [])

    def vectors():
        return lambda key, text, *y: (key, *y, chain.row(text).tolist())

    arrow = pa.schema([("key", pa.int64()), *[(f"y{i}", pa.int64()) for i in range(len(names))], ("x", pa.list_(pa.float32()))])
    columns = ["key", "text", *[F.col(f"y{i}").cast("bigint") for i in range(len(names))]]
    rows = per_row(text_of, columns, vectors, f"key bigint, {fields}, x array<float>", arrow).toArrow()
    if not rows.num_rows:
        chain.models = [Linear(np.zeros(len(chosen) + SHAPES + i, np.float32), -30.0) for i in range(len(names))]
        return chain
    rows = rows.sort_by([("key", "ascending"), *[(f"y{i}", "ascending") for i in range(len(names))]]).combine_chunks()
    x = rows.column("x").combine_chunks().values.to_numpy().reshape(rows.num_rows, -1)
    y = np.column_stack([rows.column(f"y{i}").to_numpy() for i in range(len(names))])
    fold = np.array([xxhash.xxh32_intdigest(str(k)) % FOLDS for k in rows.column("key").to_pylist()])
    chain.models = fit_chain(x, y, fold)
    return chain


def predict(docs: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, for each category its probability ``p_name`` and verdict ``name``)."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)
    names = [f"p_{c}" for c in chain.categories]

    def make():
        model = shared.value
        return lambda key, text: (key, *model.probabilities(text))

    arrow = pa.schema([("k", pa.int64()), *[(n, pa.float64()) for n in names]])
    schema = ", ".join(["k bigint", *[f"{n} double" for n in names]])
    out = per_row(docs, [F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")], make, schema, arrow)
    verdicts = [(F.col(n) >= m.threshold).alias(c) for c, n, m in zip(chain.categories, names, chain.models)]
    return out.select(F.col("k").alias(id_col), *names, *verdicts)
