"""Training batches, evaluation sequences and scoring windows over a token stream.

Plans are closed-form over ``spark.range``; tokens are fetched only where a
consumer needs them. Positions count from 0 in one split's stream of ``n``
tokens; ``total`` is ``n - 1``, the number of (input, target) pairs.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import idiv
from ..session import default_parallelism, small_side
from .order import SEGMENT, Running, range_segments, running_offsets, scan

POLICIES = ("all_starts", "full_only", "full_first", "jump", "exact_once")


def _range(spark: SparkSession, n: int, name: str) -> DataFrame:
    parts = max(1, min(n, default_parallelism(spark)))
    return spark.range(0, n, 1, parts).select(F.col("id").alias(name))


# --- evaluation sequences ------------------------------------------------------------


def usable_tokens(n_tokens: int, seq_len: int) -> int:
    """Whole sequences only; the stream keeps one token more for the last target."""
    usable = (n_tokens - 1) // seq_len * seq_len
    if usable <= 0:
        raise ValueError(f"stream is too short for seq_len={seq_len}")
    return usable


def eval_sequences(stream: DataFrame, seq_len: int, block_size: int, *, by: str = "split") -> DataFrame:
    """(by, seq_id, x, y): inputs of ``seq_len`` tokens, targets shifted by one.

    ``stream`` holds blocks of ``block_size`` (a multiple of ``seq_len``) with a
    halo of one token, so each block yields its sequences without a join.
    """
    if block_size % seq_len:
        raise ValueError("block_size must be a multiple of seq_len")
    whole = F.expr(f"(size(tokens) - 1) div {seq_len}")
    seqs = F.transform(
        F.sequence(F.lit(0).cast("bigint"), whole - 1),
        lambda i: F.struct(
            (F.col("block_id") * (block_size // seq_len) + i).alias("seq_id"),
            F.slice("tokens", (i * seq_len + 1).cast("int"), F.lit(seq_len)).alias("x"),
            F.slice("tokens", (i * seq_len + 2).cast("int"), F.lit(seq_len)).alias("y"),
        ),
    )
    return stream.filter(whole > 0).select(by, F.inline(seqs))


# --- training spans ------------------------------------------------------------------


def train_spans(
    spark: SparkSession,
    total_tokens: int,
    calls: int,
    global_tokens: int,
    world: int,
    accum: int,
    seq_len: int,
    warmup_calls: int = 0,
) -> DataFrame:
    """(phase, call, worker, start, length, epoch, pos): disjoint spans of ``local + 1``
    tokens. After the warm-up calls the stream starts again, so their tokens are
    seen a second time."""
    local = global_tokens // (world * accum)
    if local <= 0 or local % seq_len:
        raise ValueError("local token count must be a positive multiple of seq_len")
    span = local + 1

    def phase(name: str, n_calls: int) -> DataFrame:
        return _range(spark, n_calls * world, "k").select(F.lit(name).alias("phase"), "k")

    keys = phase("train", calls)
    if warmup_calls:
        keys = phase("warmup", warmup_calls).unionByName(keys)
    return (
        keys.select(
            "phase",
            idiv(F.col("k"), world).alias("call"),
            (F.col("k") % world).alias("worker"),
            (F.col("k") * span).alias("start"),
            F.lit(span).cast("bigint").alias("length"),
        )
        .withColumn("epoch", F.expr(f"start div {total_tokens}") + 1)
        .withColumn("pos", F.col("start") % total_tokens)
    )


def single_spans(spark: SparkSession, total_tokens: int, calls: int, batch_tokens: int, seq_len: int) -> DataFrame:
    """Single-worker batches: every call takes ``usable + 1`` tokens."""
    usable = batch_tokens // seq_len * seq_len
    if usable <= 0:
        raise ValueError(f"a batch of {batch_tokens} tokens holds no sequence of {seq_len}")
    return train_spans(spark, total_tokens, calls, usable, 1, 1, seq_len)


def micro_chunks(total_tokens: Column, seq_len: int, max_chunk: int) -> Column:
    """Array of chunk sizes that spends the whole-sequence part of a budget."""
    chunk = max(max_chunk // seq_len * seq_len, seq_len)
    usable = idiv(total_tokens, seq_len) * seq_len
    count = idiv(usable + (chunk - 1), chunk)
    sizes = F.transform(
        F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.least(usable - i * chunk, F.lit(chunk).cast("bigint"))
    )
    return F.when(usable > 0, sizes).otherwise(F.array().cast("array<bigint>"))


def epochs_started(spans: DataFrame, total_tokens: int) -> DataFrame:
    """Wrap-around notices: (call, epoch) for every epoch that begins inside a span."""
    first = F.col("start").cast("bigint")
    last = first + F.col("length") - 1
    ep = F.sequence(F.expr(f"(start + {total_tokens - 1}) div {total_tokens}"), idiv(last, total_tokens))
    begins = F.expr(f"(start + length - 1) div {total_tokens} >= (start + {total_tokens - 1}) div {total_tokens}")
    return (
        spans.filter(begins)
        .select("call", "worker", F.explode(ep).alias("_e"))
        .filter(F.col("_e") > 0)
        .select("call", "worker", (F.col("_e") + 1).alias("epoch"))
    )


def gather_spans(
    spans: DataFrame, stream: DataFrame, block_size: int, total_tokens: int, key: list[str]
) -> DataFrame:
    """Fetch the tokens of arbitrary spans (start, length), wrapping at the end.

    A span becomes one row per block it touches, an equi-join on the block number
    fetches the slices, and they are put together again per span. A span touches
    at most ``length / block_size + 2`` blocks per epoch.
    """
    begin, end = F.col("start"), F.col("start") + F.col("length")
    epochs = F.sequence(F.expr(f"start div {total_tokens}"), F.expr(f"(start + length - 1) div {total_tokens}"))
    laps = spans.select(*key, "start", "length", F.explode(epochs).alias("_lap"))
    laps = laps.select(
        *key,
        (F.greatest(begin, F.col("_lap") * total_tokens)).alias("_order"),
        (F.greatest(begin, F.col("_lap") * total_tokens) - F.col("_lap") * total_tokens).alias("_from"),
        (F.least(end, (F.col("_lap") + 1) * total_tokens) - F.col("_lap") * total_tokens).alias("_to"),
    )
    cells = F.sequence(F.expr(f"_from div {block_size}"), F.expr(f"(_to - 1) div {block_size}"))
    wanted = laps.select("*", F.explode(cells).alias("block_id"))
    low = F.greatest(F.col("_from"), F.col("block_id") * block_size)
    high = F.least(F.col("_to"), (F.col("block_id") + 1) * block_size)
    slices = wanted.join(stream.select("block_id", "tokens"), "block_id").select(
        *key,
        (F.col("_order") + low - F.col("_from")).alias("_order"),
        F.slice("tokens", (low - F.col("block_id") * block_size + 1).cast("int"), (high - low).cast("int")).alias("_part"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("_order", "_part")))
    return slices.groupBy(*key).agg(F.flatten(F.transform(ordered, lambda s: s["_part"])).alias("tokens"))


def as_rows(tokens: DataFrame, seq_len: int, key: list[str]) -> DataFrame:
    """Spans of ``k * seq_len + 1`` tokens as (key, row, x, y)."""
    n = F.expr(f"(size(tokens) - 1) div {seq_len}")
    rows = F.transform(
        F.sequence(F.lit(0), n.cast("int") - 1),
        lambda i: F.struct(
            i.alias("row"),
            F.slice("tokens", i * seq_len + 1, F.lit(seq_len)).alias("x"),
            F.slice("tokens", i * seq_len + 2, F.lit(seq_len)).alias("y"),
        ),
    )
    return tokens.filter(n > 0).select(*key, F.inline(rows))


# --- sliding windows -------------------------------------------------------------------


def window_count(total: int, seq_len: int, stride: int, policy: str) -> int:
    if policy == "all_starts":
        return -(-total // stride) if total > 0 else 0
    if policy == "full_only":
        return max((total - seq_len) // stride + 1, 1)
    if policy == "full_first":
        return (total - seq_len) // stride + 1 if total >= seq_len else 0
    if policy == "jump":
        if stride >= seq_len:
            raise ValueError("the jump policy needs stride < seq_len")
        if total < seq_len:
            return 0
        rest = total - seq_len - (seq_len - stride)
        return 1 + (rest // stride + 1 if rest >= 0 else 0)
    if policy == "exact_once":
        if total <= 0:
            return 0
        return 1 if total <= seq_len else -(-(total - seq_len) // stride) + 1
    raise ValueError(f"unknown window policy {policy!r}")


def windows(spark: SparkSession, total: int, seq_len: int, stride: int, policy: str = "all_starts") -> DataFrame:
    """(window_id, win_start, win_len, score_from) over ``total`` (x, y) pairs.

    all_starts  every stride, tail windows clipped; scores the last ``stride``
    full_only   full windows; every window scores its last ``stride``
    full_first  full windows; the first scores everything
    jump        the second window starts ``seq_len - stride`` after the first
    exact_once  clipped tail scores only positions no earlier window scored
    """
    start, length, score_from = _window(F.col("window_id"), total, seq_len, stride, policy)
    return _range(spark, window_count(total, seq_len, stride, policy), "window_id").select(
        "window_id", start.alias("win_start"), length.alias("win_len"), score_from.alias("score_from")
    )


def _window(k: Column, total: int, seq_len: int, stride: int, policy: str) -> tuple[Column, Column, Column]:
    """(win_start, win_len, score_from) of window ``k``, as expressions."""
    if seq_len <= 0 or stride <= 0 or stride > seq_len:
        raise ValueError("need 0 < stride <= seq_len")
    start = k * stride
    if policy == "jump":
        start = F.when(k == 0, F.lit(0).cast("bigint")).otherwise(F.lit(seq_len - stride) + (k - 1) * stride)
    end = F.least(start + seq_len, F.lit(total).cast("bigint"))
    length = end - start
    tail = F.greatest(length - stride, F.lit(0).cast("bigint"))
    if policy == "full_only":
        score_from = tail
    elif policy == "exact_once":
        done = F.least((k - 1) * stride + seq_len, F.lit(total).cast("bigint"))
        score_from = F.when(k == 0, F.lit(0).cast("bigint")).otherwise(done - start)
    else:
        score_from = F.when(k == 0, F.lit(0).cast("bigint")).otherwise(tail)
    return start, length, score_from


def window_at(k: int, total: int, seq_len: int, stride: int, policy: str) -> tuple[int, int, int]:
    """(win_start, win_len, score_from) of window ``k``, as ``windows`` lays it out."""
    start = k * stride if policy != "jump" or k == 0 else seq_len - stride + (k - 1) * stride
    low, high = _scored(k, total, seq_len, stride, policy)
    return start, min(start + seq_len, total) - start, low - start


def _scored(k: int, total: int, seq_len: int, stride: int, policy: str) -> tuple[int, int]:
    """Positions window ``k`` of a policy scores, as ``windows`` lays it out."""
    start = k * stride if policy != "jump" or k == 0 else seq_len - stride + (k - 1) * stride
    end = min(start + seq_len, total)
    if k == 0 and policy != "full_only":
        return start, end
    if policy == "exact_once":
        return min((k - 1) * stride + seq_len, total), end
    return max(end - stride, start), end


def window_counts(total: np.ndarray, seq_len: int, stride: int, policy: str) -> np.ndarray:
    """``window_count`` of many sequences."""
    full = (total - seq_len) // stride + 1
    if policy == "all_starts":
        return np.maximum(-(-total // stride), 0)
    if policy == "full_only":
        return np.maximum(full, 1)
    if policy == "full_first":
        return np.maximum(full, 0)
    if policy == "jump":
        if stride >= seq_len:
            raise ValueError("the jump policy needs stride < seq_len")
        rest = total - seq_len - (seq_len - stride)
        return np.where(total < seq_len, 0, 1 + np.maximum(rest // stride + 1, 0))
    if policy == "exact_once":
        return np.where(total <= 0, 0, 1 + np.maximum(-(-(total - seq_len) // stride), 0))
    raise ValueError(f"unknown window policy {policy!r}")


def windows_at(k: np.ndarray, total: np.ndarray, seq_len: int, stride: int, policy: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``window_at`` of many windows; ``total`` is that of each one's sequence."""
    start = k * stride if policy != "jump" else np.where(k == 0, 0, seq_len - stride + (k - 1) * stride)
    end = np.minimum(start + seq_len, total)
    low = np.minimum((k - 1) * stride + seq_len, total) if policy == "exact_once" else np.maximum(end - stride, start)
    if policy != "full_only":
        low = np.where(k == 0, start, low)
    return start, end - start, low - start


def policy_segments(spark: SparkSession, total: int, seq_len: int, stride: int, policies: Sequence[str]) -> DataFrame:
    """``scored_segments`` of whole policies in closed form: (policy, seg_from, seg_to, times).

    All full windows but the first score ``stride`` positions each, one after the other:
    a single stretch. With it only the first window and the clipped ones at the end
    (``seq_len / stride`` at most) are laid over each other, whatever the length.
    """
    rows = []
    for policy in policies:
        n = window_count(total, seq_len, stride, policy)
        if not n:
            continue
        lead = seq_len - stride if policy == "jump" else stride
        full = max(min((total - seq_len - lead) // stride + 1, n - 1), 0)  # full windows after the first
        scored = [_scored(k, total, seq_len, stride, policy) for k in (0, *range(full + 1, n))]
        if full:
            scored.append((_scored(1, total, seq_len, stride, policy)[0], _scored(full, total, seq_len, stride, policy)[1]))
        change = Counter({0: 0, total: 0})
        for begin, end in scored:
            change[begin] += 1
            change[end] -= 1
        marks = [p for p in sorted(change) if change[p] or p in (0, total)]
        times = 0
        for begin, end in zip(marks, marks[1:]):
            times += change[begin]
            rows.append((policy, begin, end, times))
    return spark.createDataFrame(rows, "policy string, seg_from bigint, seg_to bigint, times bigint")


def scored_segments(wins: DataFrame, by: list[str]) -> DataFrame:
    """Stretches of equal multiplicity: (by, seg_from, seg_to, times), zero included.

    Window edges are summed per position first, so adjoining windows cancel
    before anything is ordered. ``wins`` carries ``total`` next to the windows.
    """
    edge = lambda pos, d: F.struct(pos.cast("bigint").alias("pos"), F.lit(d).alias("d"))
    own = [
        edge(F.col("win_start") + F.col("score_from"), 1),
        edge(F.col("win_start") + F.col("win_len"), -1),
    ]
    # The first window also marks both ends of the stream.
    ends = [edge(F.lit(0), 0), edge(F.col("total"), 0)]
    marks = F.when(F.col("window_id") == 0, F.array(*own, *ends)).otherwise(F.array(*own))
    edges = (
        wins.select(*by, "total", F.inline(marks))
        .groupBy(*by, "total", "pos")
        .agg(F.sum("d").alias("delta"))
        .filter((F.col("delta") != 0) | (F.col("pos") == 0) | (F.col("pos") == F.col("total")))
    )
    order = [*by, "pos"]
    runs = [Running("lag", "pos", "seg_from"), Running("sum", "delta", "times", inclusive=False)]
    out = scan(range_segments(edges, order), by, ["pos"], runs).drop(SEGMENT)
    return out.filter(F.col("seg_from").isNotNull() & (F.col("seg_from") < F.col("pos"))).select(
        *by, "seg_from", F.col("pos").alias("seg_to"), F.col("times").cast("bigint").alias("times")
    )


def coverage(segments: DataFrame, by: list[str]) -> DataFrame:
    """How often positions are scored: (by, times, positions)."""
    return segments.groupBy(*by, "times").agg(F.sum(F.col("seg_to") - F.col("seg_from")).alias("positions"))


def _spread_cells(rows: DataFrame, first: Column, last: Column, name: str, coarse: int = 1 << 16) -> DataFrame:
    """One row per cell ``first..last``. A stretch may span the whole stream, so it is
    first cut into coarse cells that go to different tasks."""
    parts = default_parallelism(rows.sparkSession)
    cut = rows.withColumns({"_first": first, "_last": last})
    cut = cut.select("*", F.explode(F.sequence(idiv(F.col("_first"), coarse), idiv(F.col("_last"), coarse))).alias("_coarse"))
    cut = cut.repartition(parts, "_coarse", "_first")
    low = F.greatest("_first", F.col("_coarse") * coarse)
    high = F.least("_last", F.col("_coarse") * coarse + (coarse - 1))
    return cut.withColumn(name, F.explode(F.sequence(low, high))).drop("_first", "_last", "_coarse")


def segment_slices(segments: DataFrame, stream: DataFrame, block_size: int, by: list[str]) -> DataFrame:
    """Scored stretches met with the blocks that hold their targets.

    x position p scores target p + 1. Yields (by, times, tokens, lo, hi), with
    lo / hi relative to the block.
    """
    low, high = F.col("seg_from") + 1, F.col("seg_to") + 1
    scored = segments.filter(F.col("times") > 0).select(*by, "times", low.alias("_lo"), high.alias("_hi"))
    wanted = _spread_cells(scored, idiv(F.col("_lo"), block_size), idiv(F.col("_hi") - 1, block_size), "block_id")
    base = F.col("block_id") * block_size
    return wanted.join(stream.select("block_id", "tokens"), "block_id").select(
        *by,
        "times",
        "tokens",
        (F.greatest("_lo", base) - base).alias("lo"),
        (F.least("_hi", base + block_size) - base).alias("hi"),
    )


def window_tokens(stream: DataFrame, wins: DataFrame, block_size: int) -> DataFrame:
    """Tokens of windows for a model: ``stream`` blocks carry a halo of ``seq_len``
    tokens, so one equi-join on the block of the window's start fetches x and y."""
    at = (F.col("win_start") - F.col("block_id") * block_size + 1).cast("int")
    return (
        wins.withColumn("block_id", F.expr(f"win_start div {block_size}"))
        .join(stream.select("block_id", "tokens"), "block_id")
        .select(
            "window_id", "win_start", "win_len", "score_from",
            F.slice("tokens", at, F.col("win_len").cast("int")).alias("x"),
            F.slice("tokens", at + 1, F.col("win_len").cast("int")).alias("y"),
        )
    )


def window_blocks(pieces: DataFrame, wins: DataFrame, block_size: int) -> DataFrame:
    """(block_id, parts, windows): the pieces of a block and the windows that begin in it.

    ``pieces`` are packed tokens as ``cut_pieces`` makes them, with a halo of at least the
    longest window. A block's pieces are put in order where its windows are read; a window
    whose block has no tokens is kept, so that its reader refuses it.
    """
    listed = F.collect_list(F.struct("win_start", "win_len", "score_from")).alias("windows")
    grouped = wins.groupBy(F.expr(f"win_start div {block_size}").alias("block_id")).agg(listed)
    return grouped.join(_block_parts(pieces), "block_id", "left")


def _block_parts(pieces: DataFrame) -> DataFrame:
    listed = F.collect_list(F.struct("cell_offset", "tokens")).alias("parts")
    return pieces.groupBy(F.col("cell").alias("block_id")).agg(listed)


def policy_blocks(pieces: DataFrame, total: int, seq_len: int, stride: int, policy: str, block_size: int) -> DataFrame:
    """:func:`window_blocks` of a whole policy. Which windows begin in a block follows from
    its number, so no window is shuffled, gathered or joined. ``pieces`` are those of the
    stream that has the ``total`` pairs; blocks in which no window begins are left out."""
    lead = seq_len - 2 * stride if policy == "jump" else 0  # window k > 0 begins at lead + k * stride
    n = F.lit(window_count(total, seq_len, stride, policy)).cast("bigint")

    def before(at: Column) -> Column:
        """Number of windows that begin before ``at``."""
        k = F.greatest(idiv(at - lead + (stride - 1), stride), F.lit(1).cast("bigint"))
        return F.least(F.when(at > 0, k).otherwise(F.lit(0).cast("bigint")), n)

    def window(k: Column) -> Column:
        fields = _window(k, total, seq_len, stride, policy)
        return F.struct(*[c.alias(name) for c, name in zip(fields, ("win_start", "win_len", "score_from"))])

    begin = F.col("block_id") * block_size
    low, high = before(begin), before(begin + block_size)
    found = _block_parts(pieces).filter(low < high)
    return found.withColumn("windows", F.transform(F.sequence(low, high - 1), window))


# --- documents ---------------------------------------------------------------------------


def doc_chunks(spans: DataFrame, chunk: int, seq_len: int, *, tokens: str | None = None) -> DataFrame:
    """Per-document scoring chunks with at most ``seq_len`` context, none of it from
    other documents. ``spans`` has (…, length); a document of n tokens has n-1
    predictions.

    With ``tokens`` the chunk also gets its inputs ``x`` and targets ``y``, sliced
    inside the array expression: a long document is not copied per chunk.
    """
    pred = F.col("length") - 1
    count = idiv(pred + (chunk - 1), chunk)

    def one(i: Column) -> Column:
        begin = i * chunk
        end = F.when(i == count - 1, pred).otherwise((i + 1) * chunk)
        win = F.greatest(end - seq_len, F.lit(0).cast("bigint"))
        fields = [
            i.alias("chunk_id"),
            win.alias("win_start"),
            (end - win).alias("win_len"),
            (begin - win).alias("chunk_offset"),
            (end - begin).alias("chunk_len"),
        ]
        if tokens:
            at, n = (win + 1).cast("int"), (end - win).cast("int")
            fields += [F.slice(tokens, at, n).alias("x"), F.slice(tokens, at + 1, n).alias("y")]
        return F.struct(*fields)

    kept = [c for c in spans.columns if c != tokens]
    chunks = F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), one)
    return spans.filter(pred > 0).select(*kept, F.inline(chunks))


def length_buckets(spans: DataFrame, chunk: int, batch: int, order_col: str = "doc_ordinal") -> DataFrame:
    """Batches of documents with like chunk counts: sort by (number of chunks,
    ordinal), cut every ``batch``. Adds (num_chunks, rank, batch_id).

    The sort key is counted per (num_chunks, ordinal bucket), so a chunk count
    that most documents share is still spread over many tasks.
    """
    keyed = spans.withColumn("num_chunks", F.expr(f"(length - 2) div {chunk}")).withColumn("_one", F.lit(1).cast("bigint"))
    ranked = running_offsets(keyed, "_one", order_col, ["num_chunks"], ordinal="_in_class", offset="_o")
    classes = keyed.groupBy("num_chunks").agg(F.sum("_one").alias("_n"))
    # One row per distinct chunk count, at most the longest document / chunk.
    bases = running_offsets(classes, "_n", "num_chunks", ordinal="_c", offset="_before")
    return (
        ranked.join(small_side(bases.select("num_chunks", "_before")), "num_chunks")
        .withColumn("rank", F.col("_before") + F.col("_in_class"))
        .withColumn("batch_id", F.expr(f"rank div {batch}"))
        .drop("_one", "_in_class", "_o", "_before")
    )


def assign_worker(index: Column, n: int | Column, world: int, mode: str) -> Column:
    """Worker of item ``index`` of ``n``: how runs divide sequences or windows.

    contiguous   [n*r div w, n*(r+1) div w)
    interleaved  index mod w
    floor_rest   blocks of n div w, the last worker takes the rest
    ceiling      blocks of ceil(n / w)
    """
    n = F.lit(n).cast("bigint") if isinstance(n, int) else n
    if mode == "contiguous":
        return idiv((index + 1) * world - 1, n)
    if mode == "interleaved":
        return index % world
    if mode == "floor_rest":
        size = idiv(n, world)
        return F.when(size == 0, F.lit(world - 1)).otherwise(
            F.least(idiv(index, size), F.lit(world - 1))
        ).cast("bigint")
    if mode == "ceiling":
        return idiv(index, idiv(n + (world - 1), world))
    raise ValueError(f"unknown mode {mode!r}")
