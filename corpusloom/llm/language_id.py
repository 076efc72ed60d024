"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. The vector of an n-gram binds the
vectors of its letters, each permuted (rotated) by its place, by multiplication; a
text's vector is the bundle (sum) of its n-grams, a language's prototype the bundle of
all texts of the language. A text gets the language with the largest cosine between
its vector and the prototype; the score is that cosine, 0 if negative.

Letters are lower-cased; any run of other characters is one word border, which has a
vector of its own. Letter vectors follow from the seed and the code point alone, so
every task makes the same ones. Prototypes are whole sums over all training rows:
each task bundles its own rows, and the sums are added by (language, dimension).

Nulls: a text that is null or has no letter gets language ``und`` and score 0; rows
with null text or language teach nothing, and neither do rows with a null doc_id, as
nobody can tell whether they are held out. Ties go to the language first by code
point. Repeated rows are predicted each and learned each. With nothing to learn from
(an empty table, say) every text is ``und``. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import per_row

DIMENSIONS = 1024
NGRAM = 3
SEED = 7
UNKNOWN = "und"
MAX_LANGUAGES = 10_000  # prototypes are sent to every task: at most 80 MB
NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
TRAIN_CHARS = 4_000_000  # characters bundled at once when learning
CACHE = 40_000  # n-gram vectors kept by a task: 40 MB


class Space:
    """Vectors of letters and n-grams."""

    def __init__(self, dimensions: int = DIMENSIONS, ngram: int = NGRAM, seed: int = SEED):
        self.dimensions, self.ngram, self.seed = dimensions, ngram, seed
        self.letters: dict[int, np.ndarray] = {}
        self.known: dict[int, int] = {}
        self.vectors = np.empty((0, dimensions), np.int8)

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dimensions, np.int8)
            self.letters[code] = 2 * bits - 1
        return self.letters[code]

    def grams(self, text: str) -> np.ndarray:
        """One number per n-gram of a text; letters and borders as 21-bit digits."""
        clean = NO_LETTERS.sub(" ", f" {text.lower()} ")
        codes = np.frombuffer(clean.encode("utf-32-le"), "<u4").astype(np.int64)
        n = len(codes) - self.ngram + 1
        out = np.zeros(max(n, 0), np.int64)
        for i in range(self.ngram):
            out = (out << 21) | codes[i : i + max(n, 0)]
        return out

    def gram(self, number: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.ngram):
            code = (number >> (21 * (self.ngram - 1 - place))) & 0x1FFFFF
            out = out * np.roll(self.letter(int(code)), self.ngram - 1 - place)
        return out

    def rows(self, numbers: np.ndarray) -> np.ndarray:
        """Vectors of distinct n-grams; the frequent ones come from a bounded cache."""
        if len(numbers) > CACHE:
            return np.stack([self.gram(n) for n in numbers.tolist()])
        if len(self.known) + len(numbers) > CACHE:
            self.known, self.vectors = {}, self.vectors[:0]
        new = [n for n in numbers.tolist() if n not in self.known]
        if new:
            if len(self.known) + len(new) > len(self.vectors):
                more = max(2 * len(self.vectors), len(self.known) + len(new), 1024)
                grown = np.empty((min(more, CACHE), self.dimensions), np.int8)
                grown[: len(self.known)] = self.vectors[: len(self.known)]
                self.vectors = grown
            for n in new:
                self.vectors[len(self.known)] = self.gram(n)
                self.known[n] = len(self.known)
        return self.vectors[[self.known[n] for n in numbers.tolist()]]

    def bundle(self, grams: np.ndarray) -> np.ndarray:
        """Sum of the vectors of all n-grams given, whole numbers."""
        numbers, counts = np.unique(grams, return_counts=True)
        out = np.zeros(self.dimensions, np.float64)
        # Whole numbers that the type holds exactly are added without error in any order.
        kind = np.float32 if len(grams) < 1 << 24 else np.float64
        for low in range(0, len(numbers), 4096):
            part = slice(low, low + 4096)
            out += counts[part].astype(kind) @ self.rows(numbers[part]).astype(kind)
        return np.rint(out).astype(np.int64)


def prototypes(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """(lang, dim, value): the bundle of all texts of each language."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, sums, held, chars = Space(dimensions, ngram, seed), {}, {}, 0

        def add() -> None:
            for lang, grams in held.items():
                sums[lang] = sums.get(lang, 0) + space.bundle(np.concatenate(grams))
            held.clear()

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if not LETTER.search(text):
                    continue
                held.setdefault(lang, []).append(space.grams(text))
                chars += len(text)
                if chars > TRAIN_CHARS:
                    add()
                    chars = 0
        add()
        for lang, total in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * dimensions), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(total)], ["lang", "dim", "value"]
            )

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    return rows.mapInArrow(run, "lang string, dim int, value bigint").groupBy("lang", "dim").agg(F.sum("value").alias("value"))


def profile(prototype_rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages by code point, and their prototypes at length one; bounded by MAX_LANGUAGES."""
    whole = prototype_rows.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("v"))
    rows = sorted(whole.limit(MAX_LANGUAGES + 1).collect(), key=lambda r: r["lang"].encode())
    if len(rows) > MAX_LANGUAGES:
        raise ValueError("too many languages")
    if not rows:
        return [], np.empty((0, 0))
    table = np.array([r["v"] for r in rows], np.float64)
    return [r["lang"] for r in rows], table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-12)


def predictor(languages: list[str], table: np.ndarray, ngram: int = NGRAM, seed: int = SEED) -> Callable[[str | None], tuple[str, float]]:
    space = Space(table.shape[1], ngram, seed) if len(languages) else None

    def predict(text: str | None) -> tuple[str, float]:
        if space is None or not text or not LETTER.search(text):
            return UNKNOWN, 0.0
        vector = space.bundle(space.grams(text)).astype(np.float64)
        length = np.linalg.norm(vector)
        if not length:
            return UNKNOWN, 0.0
        cosines = np.round(table @ vector / length, 9)
        best = int(cosines.argmax())
        return languages[best], float(min(max(cosines[best], 0.0), 1.0))

    return predict


def identify(docs: DataFrame, languages: list[str], table: np.ndarray, *, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM, seed: int = SEED) -> DataFrame:
    """(id_col, lang_pred, score), one row per row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))

    def make():
        predict = predictor(*shared.value, ngram, seed)
        return lambda key, text: (key, *predict(text))

    arrow = pa.schema([("k", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    out = per_row(docs, [F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t")], make, "k bigint, lang_pred string, score double", arrow)
    return out.select(F.col("k").alias(id_col), "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    """Null for a null id: such rows neither teach nor count as held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Profiles from the rows of ``docs`` that are not held out."""
    return profile(prototypes(docs.filter(~held_out(F.col("doc_id")))))


# A text of some length in no known language has a cosine of about 0 with all prototypes.
# A shorter one has too few n-grams to tell, and counts as known if it has letters.
MIN_SCORE = 0.1
MIN_LETTERS = 60


def accepted(docs: DataFrame, languages: list[str], table: np.ndarray, min_score: float = MIN_SCORE, min_letters: int = MIN_LETTERS) -> DataFrame:
    """The rows of ``docs`` whose language is known: not ``und`` and, from ``min_letters``
    letters on, with a score of at least ``min_score``."""
    shared = docs.sparkSession.sparkContext.broadcast((languages, table))

    @F.pandas_udf("boolean")
    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = predictor(*shared.value)

        def one(text: str | None) -> bool:
            lang, score = predict(text)
            return lang != UNKNOWN and (score >= min_score or len(NO_LETTERS.sub("", text)) < min_letters)

        for texts in batches:
            yield pd.Series([one(t) for t in texts], dtype="bool")

    return docs.filter(known("text"))
