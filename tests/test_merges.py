"""Merge learning against a plain one-at-a-time loop."""

import random
import unicodedata
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import merges as M
from corpusloom.operators.tokenizers import vocab_stats

random.seed(5)
VOCAB = ["low", "lower", "newest", "wider", "aaaa", "abab", "banana", "x12y", "éa", "ﬁne", "ｆｕｌｌ", "\U0001f600"]
TEXTS = [" ".join(random.choice(VOCAB) for _ in range(30)) for _ in range(40)] + ["  ", "odd\x02char \x00 two  spaces"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_ordinal BIGINT, text STRING").repartition(3)


def brute_words():
    out = Counter()
    for text in TEXTS:
        text = unicodedata.normalize("NFKC", text.replace("\x00", " ").strip())
        word = ""
        for c in "▁".join(text.split()):
            if c == "▁" or c.isdecimal() or word[-1:].isdecimal():
                out[word] += 1
                word = ""
            word += c
        out[word] += 1
    del out[""]
    return out


def brute_merges(words, alphabet, n):
    split = {w: [c if c in alphabet else None for c in w] for w in words}
    learned = []
    while len(learned) < n:
        pairs = Counter()
        for w, k in words.items():
            for a, b in zip(split[w], split[w][1:]):
                if a and b:
                    pairs[a, b] += k
        if not pairs:
            break
        (a, b), count = min(pairs.items(), key=lambda p: (-p[1], p[0]))
        learned.append((len(learned), a, b, a + b, count))
        for w, s in split.items():
            out, i = [], 0
            while i < len(s):
                if s[i : i + 2] == [a, b]:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            split[w] = out
    return learned


def test_word_counts(docs):
    from corpusloom.operators.corpus import clean_training_text

    got = {r["word"]: r["n"] for r in M.word_counts(clean_training_text(docs)).collect()}
    assert got == brute_words()


@pytest.mark.parametrize("coverage, sparse, rebuild", [(1.0, 16, 4), (0.97, 16, 4), (1.0, 0, 4), (1.0, 0, 0)])
def test_merges_equal_the_plain_loop(docs, monkeypatch, coverage, sparse, rebuild):
    # With 0 the index is used from the second pass on, and with a rebuild of 0 never written again.
    monkeypatch.setattr(M, "SPARSE", sparse)
    monkeypatch.setattr(M, "REBUILD", rebuild)
    learned, chars = M.learn_merges(docs, 60, coverage=coverage)
    words = brute_words()
    alphabet = {r["char"] for r in chars.collect()}
    if coverage == 1.0:
        assert alphabet == {c for w in words for c in w}
    assert [tuple(r) for r in learned.orderBy("rank").collect()] == brute_merges(words, alphabet, 60)


@pytest.mark.parametrize("seed", range(4))
def test_merge_batches_keep_the_order_of_the_plain_loop(spark, seed):
    """Short words over few letters: many ties, chains and repeated symbols."""
    rng = random.Random(seed)
    letters = "abcd"[: 2 + seed % 3]
    words = Counter("".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(60))
    words = {w: rng.randint(1, 5) * n for w, n in words.items()}
    texts = [(i, w) for i, w in enumerate(w for w, n in words.items() for _ in range(n))]
    docs = spark.createDataFrame(texts, "doc_ordinal BIGINT, text STRING").coalesce(2)
    learned, _ = M.learn_merges(docs, 40, coverage=1.0)
    assert [tuple(r) for r in learned.orderBy("rank").collect()] == brute_merges(words, set(letters), 40)


def test_a_repeated_symbol_ends_its_batch(spark):
    texts = ["aaaa"] * 10 + ["xy"] * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_ordinal BIGINT, text STRING")
    learned, _ = M.learn_merges(docs, 3, coverage=1.0)
    assert [r["piece"] for r in learned.orderBy("rank").collect()] == ["aa", "aaaa", "xy"]


def test_prefix_limits_training_text(docs):
    few, _ = M.learn_merges(docs, 5, max_docs=0)
    assert few.count() == 0


def test_rare_characters_become_bytes(spark):
    words = spark.createDataFrame([("aé\U0001f600", 2)], "word STRING, n BIGINT")
    chars = spark.createDataFrame([("a", 9)], "char STRING, n BIGINT")
    row = M.spell(words, chars).first()
    assert row["symbols"] == f"{M.OPEN}a{M.CLOSE}" + "".join(f"{M.OPEN}<0x{b:02X}>{M.CLOSE}" for b in "é\U0001f600".encode())
    assert M.spell(words, chars, byte_fallback=False).first()["symbols"] == f"{M.OPEN}a{M.CLOSE}" + 2 * f"{M.OPEN}<unk>{M.CLOSE}"


def test_vocabulary_layout(spark, docs):
    learned, chars = M.learn_merges(docs, 10)
    vocab = M.vocabulary(spark, learned, chars).orderBy("token_id").collect()
    assert [r["token_id"] for r in vocab] == list(range(len(vocab)))
    assert [r["kind"] for r in vocab[:4]] == ["control", "control", "control", "unknown"]
    assert {r["kind"] for r in vocab[4:260]} == {"byte"} and vocab[4]["piece"] == "<0x00>"
    assert [r["piece"] for r in vocab[260:270]] == [r["piece"] for r in learned.orderBy("rank").collect()]
    assert len(vocab) == 270 + chars.count()
    stats = vocab_stats(M.vocabulary(spark, learned, chars))
    assert stats.filter(F.col("boundary")).count() == 4


@pytest.mark.parametrize("text", ["a1b22 c", "x▁y ▁ z", " lead\t\n two  ", " nb sp", "½ ٣٤x", "one", " \x0b\x0c ", "ﬁ 　é"])
@pytest.mark.parametrize("normalise", [True, False])
def test_words_of_pieces_are_those_of_whole_texts(spark, text, normalise):
    import unicodedata

    docs = spark.createDataFrame([(text,), (text,), (None,)], "text string")
    whole = unicodedata.normalize("NFKC", text) if normalise else text
    want = Counter(spark.createDataFrame([(whole,)], "t string").select(M.words(F.col("t"))).first()[0])
    got = {r["word"]: r["n"] for r in M.word_counts(docs, normalise=normalise).collect()}
    assert got == {w: 2 * n for w, n in want.items()}


def test_a_pass_writes_words_as_numbers(docs):
    table = M._Words(M.spell(M.word_counts(docs), M.char_counts(M.word_counts(docs))))
    table.merge(table.top(2)[:1])
    assert dict(table.base.dtypes) == {"word": "bigint", "symbols": "array<int>", "n": "bigint"}
