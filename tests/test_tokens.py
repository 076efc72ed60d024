import hashlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.functions.columns import bigram_hash_a, bigram_hash_b, bits, idiv, pad, strip_text, tokenizer_kind
from corpusloom.functions.tokens import byte_ids, framed, packed
from corpusloom.operators.checks import check_count, check_tokens, check_unique, fail_on
from corpusloom.operators.corpus import clean_training_text, fingerprint
from corpusloom.operators.tokenizers import (
    Tokenizer,
    byte_vocab,
    register_tokenizer,
    sentencepiece_tokenizer,
    token_counts,
    tokenize,
    vocab_stats,
)

TEXTS = ["", "a", "héllo wörld", "𝄞 \U0001f600 x", "nul\x00in", "日本語", "  edge \x1c"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_ordinal BIGINT, text STRING")


def test_byte_tokens(docs):
    got = {r["doc_ordinal"]: r["tokens"] for r in tokenize(docs).collect()}
    assert got == {i: [1] + [b + 4 for b in t.encode()] for i, t in enumerate(TEXTS)}


def test_eos_and_packed(docs):
    got = {r["doc_ordinal"]: bytes(r["tokens"]) for r in tokenize(docs, append_eos=True, as_bytes=True).collect()}
    for i, t in enumerate(TEXTS):
        ids = [1] + [b + 4 for b in t.encode()] + [2]
        assert got[i] == b"".join(int(k).to_bytes(2, "little") for k in ids)


def test_sliced_arrow_input():
    texts = pa.array(["drop", "ab", "", "c"])[1:]
    assert framed(byte_ids(texts), 1, None).to_pylist() == [[1, 101, 102], [1], [1, 103]]
    with pytest.raises(ValueError, match="token id 103"):
        packed(framed(byte_ids(texts), 1, None), 103)


def test_token_counts_by_group(spark):
    df = spark.createDataFrame([("x", "aab"), ("y", "b"), (None, "a"), ("x", "")], "g STRING, text STRING")
    got = {(r["g"], r["token_id"]): r["n"] for r in token_counts(df, by=["g"]).collect()}
    assert got == {("x", 1): 2, ("x", 101): 2, ("x", 102): 1, ("y", 1): 1, ("y", 102): 1, (None, 1): 1, (None, 101): 1}


def test_plug_in_tokenizer(docs):
    def make():
        return Tokenizer("chars", "custom", "chars", 70_000, 0, 2, encode=lambda text: [ord(c) % 1000 + 3 for c in text])

    register_tokenizer("chars", make)
    got = {r["doc_ordinal"]: r["tokens"] for r in tokenize(docs, "chars").collect()}
    assert got == {i: [0] + [ord(c) % 1000 + 3 for c in t] for i, t in enumerate(TEXTS)}
    with pytest.raises(KeyError):
        tokenize(docs, "unknown")


def test_subword_model(spark, sf, tmp_path):
    spm = pytest.importorskip("sentencepiece")
    texts = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(60).collect()]
    prefix = str(tmp_path / "m600")
    spm.SentencePieceTrainer.train(
        sentence_iterator=iter(texts), model_prefix=prefix, vocab_size=600, model_type="bpe", byte_fallback=True,
        hard_vocab_limit=False, pad_id=0, bos_id=1, eos_id=2, unk_id=3, minloglevel=2, max_sentence_length=100_000,
    )
    model = spm.SentencePieceProcessor(model_file=prefix + ".model")
    df = spark.createDataFrame(list(enumerate(texts)), "doc_ordinal BIGINT, text STRING").repartition(4)
    name = sentencepiece_tokenizer(spark, prefix + ".model")
    got = {r["doc_ordinal"]: r["tokens"] for r in tokenize(df, name).collect()}
    assert got == {i: [1] + model.encode(t) for i, t in enumerate(texts)}


def test_strip_matches_python(spark):
    cases = TEXTS + ["\x1f x y　\x85", "\t\n", "\x00 a \x00", "​keep​"]
    df = spark.createDataFrame([(c,) for c in cases], "t STRING").select("t", strip_text(F.col("t")).alias("s"))
    for r in df.collect():
        assert r["s"] == r["t"].replace("\x00", " ").strip()


def test_prefix_counts_lines_before_empties_drop(spark):
    df = spark.createDataFrame([(0, " "), (1, "a"), (2, "b"), (3, "c")], "doc_ordinal BIGINT, text STRING")
    assert sorted(r["text"] for r in clean_training_text(df, 3).collect()) == ["a", "b"]


def _wrap(x):
    return (x + 2**31) % 2**32 - 2**31


def test_bigram_hashes_near_the_16_bit_limit(spark):
    toks = [65535, 0, 59139, 60000, 1, 65535, 65535]
    df = spark.createDataFrame([(toks,), ([5],), ([],)], "t ARRAY<INT>")
    rows = df.select(bigram_hash_a(F.col("t"), 4096).alias("a"), bigram_hash_b(F.col("t"), 2048).alias("b")).collect()
    want = [4095] + [(_wrap(36313 * c) ^ _wrap(27191 * p)) % 4095 for p, c in zip(toks, toks[1:])]
    assert rows[0]["a"] == want
    assert rows[0]["b"] == [(p * 92821 + c) % 2048 for p, c in zip([0] + toks, toks)]
    assert rows[1]["a"] == [4095] and rows[2]["a"] == [] and rows[2]["b"] == []


def test_vocab_stats(spark):
    vocab = spark.createDataFrame(
        [(0, "<pad>", "control"), (1, "▁", "normal"), (2, "▁the", "normal"), (3, "é", "normal"), (4, "<0x41>", "byte"), (5, "u", "unused")],
        "token_id INT, piece STRING, kind STRING",
    )
    got = {r["token_id"]: tuple(r)[1:] for r in vocab_stats(vocab, 8).collect()}
    assert got == {
        0: (0, False, True), 1: (0, True, False), 2: (3, True, False), 3: (2, False, False),
        4: (1, False, False), 5: (0, False, True), 6: (0, False, True), 7: (0, False, True),
    }
    own = {r["token_id"]: r["n_bytes"] for r in vocab_stats(byte_vocab(spark)).collect()}
    assert len(own) == 260 and sum(own.values()) == 256


def test_checks(spark, docs):
    bad = check_tokens(tokenize(docs), 200).collect()
    assert {r["doc_ordinal"] for r in bad} == {i for i, t in enumerate(TEXTS) if any(b + 4 >= 200 for b in t.encode())}
    first = {r["doc_ordinal"]: (r["bad_id"], r["bad_pos"]) for r in bad}
    ids = [b + 4 for b in TEXTS[5].encode()]
    at = next(i for i, v in enumerate(ids) if v >= 200)
    assert first[5] == (ids[at], at + 1)
    assert check_count(docs, len(TEXTS)).count() == 0 and check_count(docs, 1).count() == 1
    twice = docs.unionByName(docs.limit(1))
    with pytest.raises(ValueError, match="duplicate"):
        fail_on(check_unique(twice, ["doc_ordinal"]))
    fail_on(check_unique(docs, ["doc_ordinal"]))


def test_kind_of_unknown_spec_fails(spark):
    cols = "name STRING, kind STRING, builder STRING, dataset_suffix STRING, vocab_size BIGINT"
    df = spark.createDataFrame([("odd", "wordpiece", None, None, None)], cols)
    rule = tokenizer_kind(*[F.col(c) for c in ("kind", "builder", "dataset_suffix", "vocab_size", "name")])
    with pytest.raises(Exception, match="cannot tell the tokenizer family of odd"):
        df.select(rule).collect()


def test_fingerprint_depends_on_order_and_text(spark, docs):
    base = fingerprint(docs, 2).first()
    swapped = docs.withColumn("doc_ordinal", F.when(F.col("doc_ordinal") < 2, 1 - F.col("doc_ordinal")).otherwise(F.col("doc_ordinal")))
    assert base["n_docs"] == len(TEXTS)
    assert fingerprint(docs.repartition(5), 2).first()["root"] == base["root"]
    assert fingerprint(swapped, 2).first()["root"] != base["root"]
    one = fingerprint(docs.filter("doc_ordinal = 1"), 2).first()["root"]
    h = hashlib.sha256(b"a").hexdigest()
    for _ in range(3):
        h = hashlib.sha256(h.encode()).hexdigest()
    assert one == h


def test_fingerprint_of_fixed_levels_has_one_root_list(spark):
    from harness import connect, difference

    from corpusloom.plans.registry import ORACLE

    # Ordinals beyond 64 ** 3, and a bucket without any text.
    many = spark.createDataFrame([(i, None if i < 64 else f"t{i}") for i in [*range(130), 262_143, 262_144, 600_000]], "doc_ordinal bigint, text string")
    con = connect("/nowhere")
    for rows in (many, many.limit(0)):
        documents = rows.withColumnRenamed("doc_ordinal", "doc_id").toArrow()
        con.register("documents", documents)
        assert difference(fingerprint(rows, 64, levels=3), con, ORACLE["corpus_fingerprint"]) is None
    assert fingerprint(many, 64).first()["root"] != fingerprint(many, 64, levels=3).first()["root"]


def test_small_columns(spark):
    df = spark.createDataFrame([([7, 8],)], "t ARRAY<INT>")
    row = df.select(pad(F.col("t"), 4).alias("p"), bits(F.log(F.lit(8.0))).alias("b"), idiv(F.lit(2**60 + 1), 2).alias("d")).first()
    assert row["p"] == [7, 8, 0, 0] and abs(row["b"] - 3) < 1e-12 and row["d"] == 2**59
