"""Plans against position-by-position definitions on small streams."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.operators.sequences import (
    POLICIES,
    as_rows,
    assign_worker,
    coverage,
    doc_chunks,
    epochs_started,
    eval_sequences,
    gather_spans,
    length_buckets,
    micro_chunks,
    policy_segments,
    scored_segments,
    single_spans,
    train_spans,
    usable_tokens,
    window_count,
    window_tokens,
    windows,
)


def brute_windows(total, seq, stride, policy):
    """(start, length, first scored) straight from the definitions."""
    out, seen = [], 0
    if policy == "jump":
        starts = [0] + list(range(seq - stride, total + 1, stride))
        return [(s, seq, 0 if s == 0 else seq - stride) for s in starts if s + seq <= total]
    if policy == "full_only":
        n = max((total - seq) // stride + 1, 1)
        return [(k * stride, min(seq, total - k * stride), max(min(seq, total - k * stride) - stride, 0)) for k in range(n)]
    for s in range(0, total, stride):
        e = min(s + seq, total)
        if policy == "full_first" and s + seq > total:
            break
        if policy == "exact_once":
            if e > seen:
                out.append((s, e - s, seen - s))
            seen = e
        else:
            out.append((s, e - s, 0 if s == 0 else max(e - s - stride, 0)))
    return out


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("total", [40, 64, 65, 120, 640, 645])
def test_windows(spark, policy, total):
    got = [tuple(r)[1:] for r in windows(spark, total, 64, 8, policy).orderBy("window_id").collect()]
    assert got == brute_windows(total, 64, 8, policy)


@pytest.mark.parametrize("total, stride", [(640, 8), (645, 8), (645, 10), (300, 64)])
def test_coverage(spark, total, stride):
    frames = [windows(spark, total, 64, stride, p).withColumn("policy", F.lit(p)) for p in POLICIES if not (p == "jump" and stride == 64)]
    wins = frames[0]
    for f in frames[1:]:
        wins = wins.unionByName(f)
    policies = [p for p in POLICIES if not (p == "jump" and stride == 64)]
    closed = {tuple(r) for r in coverage(policy_segments(spark, total, 64, stride, policies), ["policy"]).collect()}
    got = {}
    for r in coverage(scored_segments(wins.withColumn("total", F.lit(total)), ["policy"]), ["policy"]).collect():
        got.setdefault(r["policy"], {})[r["times"]] = r["positions"]
    for policy in got:
        times = Counter()
        for s, n, f in brute_windows(total, 64, stride, policy):
            times.update(range(s + f, s + n))
        want = Counter(times.values())
        want[0] = total - len(times)
        assert got[policy] == {k: v for k, v in want.items() if v}, policy
    assert got["exact_once"] == {1: total}
    assert closed == {(p, t, n) for p, counts in got.items() for t, n in counts.items()}


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("total, seq, stride", [(5, 8, 3), (8, 8, 3), (16, 8, 3), (61, 8, 3), (64, 8, 1), (63, 8, 7)])
def test_closed_form_stretches_match_all_windows(spark, policy, total, seq, stride):
    times = Counter()
    for s, n, f in brute_windows(total, seq, stride, policy):
        times.update(range(s + f, s + n))
    rows = policy_segments(spark, total, seq, stride, [policy]).collect()
    got = [r["times"] for r in sorted(rows) for _ in range(r["seg_from"], r["seg_to"])]
    assert got == [times[p] for p in range(total)] if window_count(total, seq, stride, policy) else not got


@pytest.mark.parametrize("coarse", [1, 3, 1 << 16])
def test_long_stretches_are_cut_before_they_are_spread(spark, coarse):
    from corpusloom.operators.sequences import _spread_cells

    rows = spark.createDataFrame([(0, 0, 9), (1, 5, 5), (2, 2, 7)], "k INT, a BIGINT, b BIGINT")
    got = sorted((r["k"], r["cell"]) for r in _spread_cells(rows, F.col("a"), F.col("b"), "cell", coarse).collect())
    assert got == [(k, c) for k, a, b in ((0, 0, 9), (1, 5, 5), (2, 2, 7)) for c in range(a, b + 1)]


def test_published_window_count():
    assert window_count(62_021_632, 2048, 64, "all_starts") == 969_088
    assert window_count(62_021_632, 1024, 64, "all_starts") == 969_088


def test_bad_window_arguments(spark):
    for args in [(10, 0, 1), (10, 4, 0), (10, 4, 5)]:
        with pytest.raises(ValueError):
            windows(spark, *args)
    with pytest.raises(ValueError):
        windows(spark, 100, 8, 8, "jump")
    with pytest.raises(ValueError):
        windows(spark, 100, 8, 4, "other")
    with pytest.raises(ValueError):
        usable_tokens(8, 8)
    assert usable_tokens(9, 8) == 8 and usable_tokens(33, 16) == 32


def stream(spark, tokens, block, halo=0):
    rows = [("all", b // block, b, tokens[b : b + block + halo]) for b in range(0, len(tokens), block)]
    return spark.createDataFrame(rows, "split STRING, block_id BIGINT, base_offset BIGINT, tokens ARRAY<INT>").repartition(3)


TOKENS = [(i * 37 + 5) % 251 for i in range(203)]


@pytest.mark.parametrize("n", [203, 193, 192, 17])
def test_eval_sequences(spark, n):
    toks = TOKENS[:n]
    got = {r["seq_id"]: (r["x"], r["y"]) for r in eval_sequences(stream(spark, toks, 32, 1), 16, 32).collect()}
    assert got == {i: (toks[i * 16 : i * 16 + 16], toks[i * 16 + 1 : i * 16 + 17]) for i in range((n - 1) // 16)}


@pytest.mark.parametrize("world, accum", [(1, 1), (3, 2), (4, 1)])
def test_training_spans_wrap_and_stay_disjoint(spark, world, accum):
    local = 24 // (world * accum) if 24 % (world * accum) == 0 else 4
    spans = train_spans(spark, len(TOKENS), 40, local * world * accum, world, accum, local)
    got = gather_spans(spans, stream(spark, TOKENS, 16), 16, len(TOKENS), ["call", "worker"])
    endless = TOKENS * 12
    for r in got.collect():
        at = (r["call"] * world + r["worker"]) * (local + 1)
        assert r["tokens"] == endless[at : at + local + 1]
    assert got.count() == 40 * world
    rows = as_rows(got, local, ["call", "worker"]).filter("call = 1 AND worker = 0").first()
    at = world * (local + 1)
    assert rows["x"] == endless[at : at + local] and rows["y"] == endless[at + 1 : at + local + 1]


def test_warm_up_tokens_are_seen_again(spark):
    spans = train_spans(spark, 1000, 4, 32, 2, 1, 16, warmup_calls=2).orderBy("phase", "call", "worker").collect()
    starts = {p: [r["start"] for r in spans if r["phase"] == p] for p in ("train", "warmup")}
    assert starts == {"train": [k * 17 for k in range(8)], "warmup": [k * 17 for k in range(4)]}
    with pytest.raises(ValueError):
        train_spans(spark, 1000, 1, 30, 2, 1, 16)


def test_span_longer_than_the_stream(spark):
    spans = spark.createDataFrame([(0, 5, 100)], "k BIGINT, start BIGINT, length BIGINT")
    toks = TOKENS[:30]
    got = gather_spans(spans, stream(spark, toks, 8), 8, 30, ["k"]).first()["tokens"]
    assert got == (toks * 5)[5:105]


def test_epoch_notices(spark):
    spans = single_spans(spark, 100, 12, 32, 16)
    got = sorted((r["call"], r["epoch"]) for r in epochs_started(spans, 100).collect())
    want = sorted({(p // 33, p // 100 + 1) for p in range(12 * 33) if p % 100 == 0 and p})
    assert got == want


def test_micro_chunks(spark):
    df = spark.createDataFrame([(1000,), (63,), (64,), (897,)], "n BIGINT")
    got = [r[0] for r in df.select(micro_chunks(F.col("n"), 64, 500)).collect()]
    assert got == [[448, 448, 64], [], [64], [448, 448]]
    assert df.select(micro_chunks(F.col("n"), 64, 10)).first()[0] == [64] * 15


def test_window_tokens(spark):
    wins = windows(spark, len(TOKENS) - 1, 40, 13, "all_starts")
    for r in window_tokens(stream(spark, TOKENS, 32, 40), wins, 32).collect():
        s, n = r["win_start"], r["win_len"]
        assert r["x"] == TOKENS[s : s + n] and r["y"] == TOKENS[s + 1 : s + n + 1]


def test_doc_chunks_cover_each_prediction_once(spark):
    spans = spark.createDataFrame([(i, n) for i, n in enumerate([2, 3, 17, 33, 34, 100, 1])], "doc_ordinal BIGINT, length BIGINT")
    got = {}
    for r in doc_chunks(spans, 16, 40).collect():
        assert r["win_len"] <= 40 and r["chunk_offset"] + r["chunk_len"] == r["win_len"]
        got.setdefault(r["doc_ordinal"], []).extend(range(r["win_start"] + r["chunk_offset"], r["win_start"] + r["win_len"]))
    assert {k: sorted(v) for k, v in got.items()} == {i: list(range(n - 1)) for i, n in enumerate([2, 3, 17, 33, 34, 100])}


def test_length_buckets_with_a_hot_length(spark):
    rows = [(i, 10 if i % 10 else 10 + i) for i in range(4000)]
    spans = spark.createDataFrame(rows, "doc_ordinal BIGINT, length BIGINT").repartition(5)
    got = {r["doc_ordinal"]: (r["rank"], r["batch_id"]) for r in length_buckets(spans, 16, 32).collect()}
    order = sorted(rows, key=lambda r: ((r[1] - 2) // 16, r[0]))
    assert got == {doc: (k, k // 32) for k, (doc, _) in enumerate(order)}


@pytest.mark.parametrize("n, world", [(100, 7), (5, 8), (64, 8), (1, 1)])
def test_workers(spark, n, world):
    modes = ["contiguous", "interleaved", "floor_rest", "ceiling"]
    rows = spark.range(n).select("id", *[assign_worker(F.col("id"), n, world, m).alias(m) for m in modes]).orderBy("id").collect()
    per, up = n // world, -(-n // world)
    want = {
        "contiguous": [range(n * r // world, n * (r + 1) // world) for r in range(world)],
        "interleaved": [range(r, n, world) for r in range(world)],
        "floor_rest": [range(r * per, (r + 1) * per if r < world - 1 else n) for r in range(world)],
        "ceiling": [range(r * up, min((r + 1) * up, n)) for r in range(world)],
    }
    for mode, parts in want.items():
        assert [r[mode] for r in rows] == [next(w for w, p in enumerate(parts) if i in p) for i in range(n)], mode


def test_totals_of_the_scoring_batch_are_those_of_its_rows(spark):
    from corpusloom.operators.metrics import score, score_totals, scored_totals

    rows = [(i, 5 * i, 5, i % 3, [j % 7 for j in range(5 * i, 5 * i + 5)], [j % 7 for j in range(5 * i + 1, 5 * i + 6)]) for i in range(40)]
    wins = spark.createDataFrame(rows, "window_id bigint, win_start bigint, win_len bigint, score_from bigint, x array<int>, y array<int>")
    make = lambda: lambda x, y, lengths: y * 0.5 + x
    got = score_totals(wins, make, 16)
    assert sorted(got.collect()) == sorted(scored_totals(score(wins, make), 16).collect())
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("policy, block, every", [("exact_once", 32, 7), ("all_starts", 64, 100), ("full_only", 32, 1), ("jump", 16, 1000)])
def test_totals_of_blocks_are_those_of_their_windows(spark, policy, block, every):
    from corpusloom.functions.tokens import packed
    from corpusloom.operators.metrics import score_blocks, score_totals
    from corpusloom.operators.sequences import window_blocks
    from corpusloom.operators.shards import blocks, cut_pieces

    lengths = [1, 70, 3, 200, 1, 1, 90, 65]  # one document in many blocks, many in one
    rows = [(i, sum(lengths[:i]), n, [(7 * j + i) % 50 for j in range(n)]) for i, n in enumerate(lengths)]
    placed = spark.createDataFrame(rows, "doc_ordinal bigint, offset bigint, n_tokens bigint, tokens array<int>").repartition(3)
    as_bytes = placed.withColumn("tokens", F.arrow_udf(lambda t: packed(t, 50), "binary")("tokens"))
    wins = windows(spark, sum(lengths) - 1, 40, 13, policy)
    make = lambda: lambda x, y, n: y * 0.5 + x * x + n[:, None]
    want = score_totals(window_tokens(blocks(placed, block, by=None, halo=40), wins, block), make, every)
    pieces = cut_pieces(as_bytes, block, by=None, halo=40)
    for at_once in (1, 5, 256):
        got = score_blocks(window_blocks(pieces, wins, block), make, block, every, windows_at_once=at_once)
        assert sorted(got.collect()) == sorted(want.collect())
    for beyond in (windows(spark, sum(lengths), 40, 13, "all_starts"), windows(spark, sum(lengths) + 500, 40, 13, policy)):
        with pytest.raises(Exception, match="a window reaches beyond"):
            score_blocks(window_blocks(pieces, beyond, block), make, block, every).collect()


def test_score_windows_sends_a_token_once(spark, sf):
    from corpusloom.plans.corpus_queries import score_windows

    plan = score_windows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "slice(" not in plan  # no x and y cut out for every window


@pytest.mark.parametrize("policy", POLICIES)
@pytest.mark.parametrize("seq_len, stride, block", [(40, 13, 32), (16, 5, 64), (24, 20, 8), (7, 1, 16)])
def test_windows_of_a_block_follow_from_its_number(spark, policy, seq_len, stride, block):
    from corpusloom.operators.sequences import policy_blocks

    for total in (1, seq_len - 1, seq_len, 3 * block, 400):
        cells = spark.range(total // block + 1).select(F.col("id").alias("cell"), F.lit(0).cast("bigint").alias("cell_offset"), F.lit(b"").alias("tokens"))
        blocks = policy_blocks(cells, total, seq_len, stride, policy, block)
        got = [(r["block_id"], tuple(w)) for r in blocks.collect() for w in r["windows"]]
        want = [tuple(r)[1:] for r in windows(spark, total, seq_len, stride, policy).collect()]
        assert sorted(got) == sorted((w[0] // block, w) for w in want)


def test_score_windows_moves_no_window(spark, sf):
    from corpusloom.plans.corpus_queries import score_windows

    plan = score_windows(spark, sf)._jdf.queryExecution().optimizedPlan()
    assert "Range" not in plan.toString() and plan.toString().count("collect_list") == 1
