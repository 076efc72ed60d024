"""Operators that compare or count over the whole table, against plain loops."""

import base64
import random
import re
import time

import numpy as np
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import bit_slices, bpe, mixing, sentence_spans, simhash, superminhash
from corpusloom.llm.components import components
from corpusloom.llm.queries import vocabulary
from llm_loops import jaccard_loop


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- byte-level BPE


@pytest.fixture(scope="module")
def vocab():
    ranks, pattern = vocabulary()
    return ranks, pattern, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_rank_file(vocab):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        assert vocab[0] == {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def test_encodes_like_the_library(spark, sf, edges, vocab):
    ranks, pattern, library = vocab
    rng = random.Random(5)
    parts = ["the", " ", "  ", "\n", "\t", "'s", "'S", "don't", "12", "½", "é", "日本", "👍", " x", "\x00", "\x1c", "\x85", "　", "!?", "a" * 3000]
    odd = [(1000 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 25)))) for i in range(400)]
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text"))
    docs = docs.union(spark.createDataFrame(odd, "doc_id bigint, text string"))
    want = sorted(((r["doc_id"], tuple(library.encode_ordinary(r["text"] or "")), (r["text"] or "").encode()) for r in docs.collect()), key=repr)
    for size in (bpe.BLOCK_CHARS, 2_000):
        got = bpe.decode(bpe.encode(docs, ranks, pattern, block_chars=size), ranks)
        assert sorted(((r["doc_id"], tuple(r["ids"]), bytes(r["decoded"])) for r in got.collect()), key=repr) == want


def test_bpe_edges(spark, edges, vocab):
    ranks, pattern, _ = vocab
    assert bpe.encode(edges.limit(0), ranks, pattern).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id bigint, ids array<int>")
    assert [None if r["decoded"] is None else bytes(r["decoded"]) for r in bpe.decode(ids, ranks).orderBy("doc_id").collect()] == [None, b""]


# --- mixing


def fill(sizes, weights, total, epochs):
    target, open_ = {}, set(sizes)
    while open_:
        left = total - sum(target.values())
        level = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > epochs * sizes[s]}
        if not over:
            target.update({s: weights[s] * level for s in open_})
            break
        target.update({s: float(epochs * sizes[s]) for s in over})
        open_ -= over
    return target


def test_water_filling(spark):
    sizes = {f"s{i}": n for i, n in enumerate([5, 1000, 30, 0, 7, 400, 90])}
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    table = spark.createDataFrame([(s, n, weights[s]) for s, n in sizes.items()], "source string, source_size bigint, weight bigint")
    for share in ((3, 2), (1, 10), (2, 1), (5, 1)):
        got = {r["source"]: r["target"] for r in mixing.targets(table, share=share).collect()}
        want = fill(sizes, weights, sum(sizes.values()) * share[0] / share[1], 2)
        assert got == pytest.approx(want)


def test_mix_takes_what_is_aimed_at(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    plan = mixing.plan(docs).join(docs.select("doc_id", "source"), "doc_id").cache()
    for r in plan.groupBy("source").agg(F.sum(F.col("times") * F.col("size")).alias("taken"), F.max("size").alias("largest"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= r["largest"] / 2 + 1
    assert plan.filter("times > 2").count() == 0
    assert rows(mixing.plan(docs.repartition(3))) == rows(mixing.plan(docs))
    times = {r["doc_id"]: r["times"] for r in plan.collect()}
    copies = {r["doc_id"]: r["count"] for r in mixing.mix(docs).groupBy("doc_id").count().collect()}
    assert copies == {k: v for k, v in times.items() if v}
    other = {r["doc_id"]: r["times"] for r in mixing.plan(docs, seed=18).collect()}
    assert other != times


def test_equal_rows_are_taken_in_part(spark):
    """400 equal rows hold much of a source: the target is met to half a document all the same."""
    docs = [(1, "w " * 10, "a")] * 400 + [(i, "x " * (i % 9 + 1), "a") for i in range(2, 80)] + [(i, "y " * 30, "b") for i in range(100, 400)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string, source string").repartition(7, "doc_id", "text")
    for weights in ((3, 1, 2), (1, 7, 1), (2, 3, 1)):
        rows_ = mixing.plan(table, weights=weights).collect()
        assert len(rows_) == len(docs)
        for source in "ab":
            ids = {d for d, _, s in docs if s == source}
            own = [r for r in rows_ if r["doc_id"] in ids]
            taken = sum(r["times"] * r["size"] for r in own)
            assert abs(taken - own[0]["target"]) <= max(r["size"] for r in own) / 2
            assert len({r["times"] for r in own if r["doc_id"] == 1}) <= 2
        assert mixing.mix(table, weights=weights).count() == sum(r["times"] for r in rows_)


def test_mixing_edges(edges):
    plan = mixing.plan(edges)
    assert plan.count() == edges.count() and plan.filter("size = 0 AND target IS NULL").count() == 0
    assert mixing.mix(edges).columns == edges.columns
    assert mixing.plan(edges.limit(0)).count() == 0 and mixing.mix(edges.limit(0)).count() == 0


# --- sentence spans


def dedup_loop(docs, min_sentences, min_words, long_sentence):
    runs, cut = {}, {}
    for key, text in sorted(docs, key=lambda d: (d[0] is None, d[0])):
        found = cut[key] = [s for s in re.split(r"(?<=\n)|(?<=[.!?])(?=\s)", text)]
        merged = []
        for piece in found:  # white space behind a sentence belongs to it
            if merged and not merged[-1].endswith("\n") and re.match(r"\s", piece) and re.search(r"[.!?]$", merged[-1]):
                space = re.match(r"\s*", piece)[0]
                merged[-1] += space
                piece = piece[len(space) :]
            if piece:
                merged.append(piece)
        cut[key] = merged
        full = [i for i, s in enumerate(merged) if s.strip()]
        words = [merged[i].lower().split() for i in full]
        spans = set()
        for a in range(len(full)):
            for b in range(a, len(full)):
                n = sum(map(len, words[a : b + 1]))
                ok = lambda x, y: y - x + 1 >= min_sentences and sum(map(len, words[x : y + 1])) >= min_words
                if a == b and n >= long_sentence or ok(a, b) and (not ok(a, b - 1) or not ok(a + 1, b)):
                    spans.add((a, b))
        for a, b in sorted(spans):  # the first place counts
            runs.setdefault(tuple(map(tuple, words[a : b + 1])), []).append((key, full[a], full[b]))
    gone = {}
    for places in runs.values():
        for key, a, b in places[1:] if len(places) > 1 else []:
            if (key, a) != places[0][:2]:
                gone.setdefault(key, set()).update(range(a, b + 1))
    return {key: "".join(s for i, s in enumerate(found) if i not in gone.get(key, ())) for key, found in cut.items()}


def test_spans_against_loop(spark):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("aeiou") + rng.choice("lmnr")
    sentence = lambda: " ".join(word() for _ in range(rng.randint(1, 9))) + rng.choice([". ", "! ", ".\n", "\n"])
    passages = ["".join(sentence() for _ in range(rng.randint(3, 8))) for _ in range(4)]
    docs = []
    for i in range(40):
        parts = [rng.choice(passages) if rng.random() < 0.3 else sentence() for _ in range(rng.randint(0, 9))]
        docs.append((i, "".join(parts).strip(" ")))
    got = sentence_spans.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string"), min_words=10, long_sentence=9)
    assert {r["doc_id"]: r["text"] for r in got.collect()} == dedup_loop(docs, 2, 10, 9)


def test_passages_go_and_clean_texts_stay(spark):
    passage = " ".join(f"Word{i} is number {i} of this passage." for i in range(12))
    docs = [(i, f"Own beginning number {i}.\n{passage}\nOwn end number {i}.") for i in range(5)] + [(9, "A clean text. It has two sentences, and nothing else.")]
    got = {r["doc_id"]: r for r in sentence_spans.deduplicate(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()}
    assert passage in got[0]["text"] and got[9]["n_removed"] == 0 and got[9]["text"] == docs[-1][1]
    for i in range(1, 5):
        assert got[i]["text"] == f"Own beginning number {i}.\nOwn end number {i}." and got[i]["n_removed"] == 12


def test_scripts_without_spaces_and_long_runs_of_marks():
    text = "今天天气很好。我们去公园散步吧！你想一起来吗？" * 7
    assert len(sentence_spans.sentences(text)) == 21 and "".join(sentence_spans.sentences(text)) == text
    assert sentence_spans.runs(text, 2, 24, 40)
    for text in ("!" * 100_000 + "x", "." * 100_000, "a." * 50_000 + " b", "\n" * 100_000, "?! " * 50_000):
        begin = time.perf_counter()
        assert "".join(sentence_spans.sentences(text)) == text
        assert time.perf_counter() - begin < 2
    for text in ("One. Two!  Three?\nFour", "a.b c. d", "x...  y", " lead. ", "end.", "end.\n", "v1.2 is out.Now. Done"):
        plain = [m for m in re.findall(r"[^\n]*?(?:[.!?]+(?=\s)\s*|\n\s*|$)", text, re.DOTALL) if m]
        assert sentence_spans.sentences(text) == plain


def test_span_edges(edges):
    got = sentence_spans.deduplicate(edges)
    assert got.count() == edges.count() and set(edges.columns) <= set(got.columns)
    assert got.filter("doc_id = 1").first()["text"] is None
    assert len({r["text"] for r in got.filter("doc_id = 4").collect()}) == 1
    assert sentence_spans.deduplicate(edges.limit(0)).count() == 0


# --- SimHash


def plain_components(fps):
    values = np.array(fps, np.int64).view(np.uint64)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= 4) + i + 1:
            a, b = sorted((root(i), root(int(j))))
            label[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprint_bits():
    import xxhash

    text = "The quick  brown fox\tjumps over the lazy dog Éa"
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 4]).encode(), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert simhash.fingerprint(text, 4) & (1 << 64) - 1 == want
    assert simhash.fingerprint(None, 4) == simhash.fingerprint(" \n", 4) == 0
    assert simhash.fingerprint("One two", 4) & (1 << 64) - 1 == xxhash.xxh64_intdigest("one two", 42)


@pytest.mark.parametrize("slice_rows, small", [(20_000, 48), (20_000, 2), (3, 2)])
def test_no_link_is_lost(spark, monkeypatch, slice_rows, small):
    monkeypatch.setattr(simhash, "SLICE", slice_rows)
    rng = np.random.default_rng(8)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, 25)
    fps = []
    for _ in range(600):
        value = int(base[rng.integers(25)]) & (1 << 64) - 1
        for bit in rng.choice(64, rng.integers(0, 9), replace=False):
            value ^= 1 << int(bit)
        fps.append(value - (1 << 64) if value >> 63 else value)
    table = spark.createDataFrame([(i, v) for i, v in enumerate(fps)], "doc_id bigint, fp bigint")
    got = table.join(simhash.membership(table), "fp").orderBy("doc_id").collect()
    assert [r["component_id"] for r in got] == plain_components(fps)


def test_anchors_meet_within_threshold():
    rng = np.random.default_rng(4)
    for _ in range(200):
        x = rng.integers(-(1 << 63), (1 << 63) - 1, 1)
        flip = np.array([np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, 4, replace=False).astype(np.uint64))]).view(np.int64)
        assert set(simhash.anchor_keys(x)[0]) & set(simhash.anchor_keys(x ^ flip)[0])


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000), (2000, 2001), (2001, 1999)]
    got = dict(rows(components(spark.createDataFrame(links, "a bigint, b bigint"))))
    assert got == {**{i: 0 for i in range(301)}, 1999: 1999, 2000: 1999, 2001: 1999}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_simhash_edges(edges):
    got = simhash.near_duplicates(edges).collect()
    assert len(got) == edges.count()
    assert {r["component_id"] for r in got if r["fp"] == 0} == {1}
    kept = simhash.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert simhash.keep_one(edges.limit(0)).count() == 0 and simhash.near_duplicates(edges.limit(0)).count() == 0


# --- bit slices


def top_loop(table, k):
    out = []
    for q, x in table:
        if q % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(x, y)), c) for c, y in table if c != q))[:k]
            out += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    return sorted(set(out))


@pytest.mark.parametrize("block_rows, spread", [(16_384, 300), (64, 300), (64, 2)])
def test_top_k_against_loop(spark, block_rows, spread):
    rng = np.random.default_rng(spread)
    table = [(i, rng.integers(-spread, spread + 1, 5).tolist()) for i in range(230)] + [(300, []), (301, [7]), (350, [0] * 5)]
    df = spark.createDataFrame(table, "id bigint, v array<int>")
    got = bit_slices.top_k(df, df.filter("id % 50 = 0"), k=5, block_rows=block_rows, group_rows=2)
    assert sorted(tuple(r) for r in got.collect()) == top_loop(table, 5)


def test_bit_slice_edges(spark):
    bad = [(1, None), (2, [0.5, None]), (3, [float("nan")]), (4, [float("inf")]), (None, [1.0]), (0, [1.0, -0.001]), (50, [0.5, 0.5]), (51, [0.5, 0.5])]
    df = spark.createDataFrame([(*r, 1, 2) for r in bad], "vec_id bigint, embedding array<double>, id int, v int")
    part = bit_slices.quantised(df, "vec_id", "embedding")
    assert rows(part) == [(0, [256, -1]), (50, [128, 128]), (51, [128, 128])]
    got = bit_slices.top_k(part, part.filter("id % 50 = 0"), k=5)
    assert sorted(tuple(r) for r in got.collect()) == [(0, 1, 50, 32640), (0, 2, 51, 32640), (50, 1, 51, 32768), (50, 2, 0, 32640)]
    assert bit_slices.top_k(part.limit(0), part.limit(0)).count() == 0
    wide = spark.createDataFrame([(0, [70_000.0, 1.0]), (50, [-65_536.0, 3e9]), (51, [1e6, -2.5])], "vec_id bigint, embedding array<double>")
    part = bit_slices.quantised(wide, "vec_id", "embedding")
    table = [(r["id"], r["v"]) for r in part.collect()]
    assert table == [(0, [17_920_000, 256]), (50, [-16_777_216, 768_000_000_000]), (51, [256_000_000, -640])]
    assert sorted(tuple(r) for r in bit_slices.top_k(part, part.filter("id % 50 = 0"), k=5).collect()) == top_loop(table, 5)
    large = spark.createDataFrame([(1, [1e30])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        bit_slices.quantised(large, "vec_id", "embedding").collect()


def test_a_repeated_id_lies_in_many_blocks(spark):
    table = [(7, [i % 13, 1]) for i in range(300)] + [(50, [3, 1]), (100, [0, 2])]
    df = spark.createDataFrame(table, "id bigint, v array<int>").repartition(5)
    got = sorted(tuple(r) for r in bit_slices.top_k(df, df.filter("id % 50 = 0"), k=5, block_rows=16, group_rows=2).collect())
    want = []
    for q, x in table[-2:]:
        best = sorted((-sum(a * b for a, b in zip(x, y)), c) for c, y in table if c != q)[:5]
        want += [(q, n, c, -s) for n, (s, c) in enumerate(best, 1)]
    assert got == sorted(want)


# --- near copies of the pipeline


@pytest.mark.parametrize("slice_rows, set_slice", [(20_000, 2_000_000), (2, 300)])
def test_stage_removes_what_jaccard_links(spark, monkeypatch, slice_rows, set_slice):
    import corpus_pipeline
    monkeypatch.setattr(superminhash, "SLICE", slice_rows)
    monkeypatch.setattr(superminhash, "SET_SLICE", set_slice)
    rng = random.Random(9)
    docs = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(60, 300))]
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(500)}"
            docs.append((len(docs), " ".join(copy)))
    docs += [(len(docs) + i, t) for i, t in enumerate(["", " ", "one two", "One  two", "one two three"])]
    table = spark.createDataFrame(docs, "doc_id bigint, text string")
    want = jaccard_loop(docs)
    got = sorted(r["doc_id"] for r in corpus_pipeline.remove_near_duplicates(spark, table, "").collect())
    assert got == want
    assert simhash.keep_one(table).count() > len(want)


def test_near_copy_edges(edges):
    from corpusloom.llm import near_copies

    kept = near_copies.keep_one(edges)
    assert kept.columns == edges.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 4, 5, 6]
    assert near_copies.keep_one(edges.limit(0)).count() == 0
