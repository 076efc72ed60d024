"""Bits per byte and the per-token tables it is made of."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import bits
from ..functions.tokens import framed, lookup_sums, packed_values
from .order import SEGMENT, Running, range_segments, scan
from .tokenizers import once_per_worker, tokenizer_factory, vocabulary_table


def target_bytes(n_bytes: Column, leading_space: Column, prev_boundary: Column) -> Column:
    """Bytes a target stands for; the space mark counts unless a boundary precedes."""
    return n_bytes + F.when(leading_space & ~prev_boundary, 1).otherwise(0)


def with_target_bytes(scored: DataFrame, stats: DataFrame) -> DataFrame:
    """Add ``target_bytes`` to rows of (prev, token, …) by two vocabulary lookups."""
    target = vocabulary_table(stats.select("token_id", "n_bytes", "leading_space")).alias("t")
    before = vocabulary_table(stats.select("token_id", "boundary")).alias("p")
    return (
        scored.alias("s")
        .join(target, F.col("s.token") == F.col("t.token_id"), "left")
        .join(before, F.col("s.prev") == F.col("p.token_id"), "left")
        .select(
            "s.*",
            target_bytes(F.col("t.n_bytes"), F.col("t.leading_space"), F.col("p.boundary")).alias("target_bytes"),
        )
    )


def unigram_nll(counts: DataFrame) -> DataFrame:
    """(token_id, n, nll): negative log share of each token in nats.

    ``counts`` has a row per vocabulary id (at most 65,536), so one window over it is
    cheaper than a second pass over the text for the total.
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.select("token_id", "n", (-F.log(F.col("n") / total)).alias("nll"))


def bits_per_byte(scored: DataFrame, by: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """(by…, n_tokens, n_bytes, loss_sum, val_loss, bpb) from (nll, target_bytes).

    ``weight`` multiplies a row that stands for many equal positions.
    """
    w = F.col(weight) if weight else F.lit(1)
    sums = scored.groupBy(*by).agg(
        F.sum(w).cast("bigint").alias("n_tokens"),
        F.sum(F.col("target_bytes") * w).cast("bigint").alias("n_bytes"),
        F.sum(F.col("nll").cast("double") * w).alias("loss_sum"),
    )
    return with_bpb(sums)


def text_losses(
    docs: DataFrame,
    nll: Sequence[float],
    n_bytes: Sequence[int],
    tokenizer: str = "pure_byte_260",
    *,
    text_col: str = "text",
) -> DataFrame:
    """Replace the text by its (n_tokens, n_bytes, loss_sum) under a context-free model.

    One row per document and no shuffle; ``nll`` and ``n_bytes`` have an entry per
    vocabulary id.
    """
    get = once_per_worker(tokenizer_factory(tokenizer))
    loss, width = np.asarray(nll, np.float64), np.asarray(n_bytes, np.int64)

    @F.arrow_udf("struct<n_tokens: bigint, n_bytes: bigint, loss_sum: double>")
    def run(texts: pa.Array) -> pa.Array:
        tok = get()
        ids = framed(tok.ids(texts), tok.bos_id, None)
        loss_sum, byte_sum = lookup_sums(ids, [loss, width])
        n = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        return pa.StructArray.from_arrays(
            [pa.array(n), pa.array(byte_sum), pa.array(loss_sum)], names=["n_tokens", "n_bytes", "loss_sum"]
        )

    kept = [c for c in docs.columns if c != text_col]
    return docs.select(*kept, run(text_col).alias("_s")).select(*kept, "_s.n_tokens", "_s.n_bytes", "_s.loss_sum")


def with_bpb(sums: DataFrame) -> DataFrame:
    """Add ``val_loss`` and ``bpb`` to (n_tokens, n_bytes, loss_sum)."""
    return sums.withColumn("val_loss", F.col("loss_sum") / F.col("n_tokens")).withColumn(
        "bpb", bits(F.col("val_loss")) * F.col("n_tokens") / F.col("n_bytes")
    )


def running_bpb(batches: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Running bits per byte over (loss_sum, n_tokens, n_bytes) batches in order."""
    segs = range_segments(batches, [*by, *order])
    runs = [Running("sum", c, f"run_{c}") for c in ("loss_sum", "n_tokens", "n_bytes")]
    out = scan(segs, by, order, runs).drop(SEGMENT)
    return out.withColumn("running_bpb", bits(F.col("run_loss_sum") / F.col("run_n_tokens")) * F.col("run_n_tokens") / F.col("run_n_bytes"))


PredictFactory = Callable[[], Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]]


def _scorer(make_predict: PredictFactory, keep: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches with x and y to batches with y and nll."""

    def dense(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        offsets = col.offsets.to_numpy()
        lengths = np.diff(offsets)
        out = np.zeros((len(lengths), int(lengths.max(initial=0))), np.int64)
        flat = col.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
        out[np.arange(out.shape[1]) < lengths[:, None]] = flat
        return out, lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x, lengths = dense(batch.column("x"))
            y, _ = dense(batch.column("y"))
            nll = np.asarray(predict(x, y, lengths), np.float64)[np.arange(x.shape[1]) < lengths[:, None]]
            offsets = np.zeros(len(lengths) + 1, np.int32)
            np.cumsum(lengths, out=offsets[1:])
            losses = pa.ListArray.from_arrays(offsets, nll)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keep], batch.column("y"), losses], names=[*keep, "y", "nll"]
            )

    return run


def score(windows_with_tokens: DataFrame, make_predict: PredictFactory, *, keep: Sequence[str] = ("window_id", "win_start", "score_from")) -> DataFrame:
    """Score windows with a user's model: adds ``nll``, one value per position.

    ``make_predict()`` runs once per worker and returns ``f(x, y, lengths)`` that
    maps zero-padded (batch, width) inputs and targets to losses of that shape.
    """
    keep = list(keep)
    fields = {f.name: f.dataType.simpleString() for f in windows_with_tokens.schema.fields}
    schema = ", ".join([*[f"`{k}` {fields[k]}" for k in keep], "y ARRAY<INT>", "nll ARRAY<DOUBLE>"])
    return windows_with_tokens.select(*keep, "x", "y").mapInArrow(_scorer(make_predict, keep), schema)


TOTALS = "part bigint, n bigint, sum_token bigint, loss_sum double"


def _part_sums(low: np.ndarray, high: np.ndarray, tokens: np.ndarray, losses: np.ndarray, every: int) -> pa.RecordBatch:
    """Sums by stretches of ``every`` positions. ``low`` and ``high`` bound the positions each
    window scores; ``tokens`` and ``losses`` go through them window by window. A window is
    cut where a stretch ends, so nothing is sorted or counted by position."""
    n = np.maximum(high - low, 0)
    cells = np.where(n > 0, (high - 1) // every - low // every + 1, 0)
    window = np.repeat(np.arange(len(n)), cells)
    part = low[window] // every + np.arange(len(window)) - (np.cumsum(cells) - cells)[window]
    begin, end = np.maximum(part * every, low[window]), np.minimum((part + 1) * every, high[window])
    at = (np.cumsum(n) - n)[window] + begin - low[window]
    parts, index = np.unique(part, return_inverse=True)
    pieces = [end - begin, *(np.add.reduceat(v, at) if len(at) else at for v in (tokens.astype(np.float64), losses))]
    sums = [np.bincount(index, w, len(parts)) for w in pieces]
    columns = [pa.array(parts), *(pa.array(s.astype(np.int64)) for s in sums[:2]), pa.array(sums[2])]
    return pa.RecordBatch.from_arrays(columns, names=["part", "n", "sum_token", "loss_sum"])


def _totals(batch: pa.RecordBatch, every: int) -> pa.RecordBatch:
    """Sums of a scored batch by stretches of ``every`` positions."""
    y, nll = batch.column("y"), batch.column("nll")
    offsets = y.offsets.to_numpy().astype(np.int64)
    widths = np.diff(offsets)
    at = np.arange(offsets[-1] - offsets[0]) - np.repeat(offsets[:-1] - offsets[0], widths)
    start, scores = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("win_start", "score_from"))
    counts = at >= np.repeat(scores, widths)
    tokens, losses = (c.flatten().to_numpy(zero_copy_only=False)[counts] for c in (y, nll))
    return _part_sums(start + scores + 1, start + widths + 1, tokens, losses, every)


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("part").agg(*[F.sum(c).alias(c) for c in ("n", "sum_token", "loss_sum")])


def scored_totals(scored: DataFrame, every: int) -> DataFrame:
    """(part, n, sum_token, loss_sum) of the positions windows score, by stretches of
    ``every`` positions; summed inside the Arrow batch, without a row per position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in filter(len, batches):
            yield _totals(batch, every)

    return _summed(scored.select("win_start", "score_from", "y", "nll").mapInArrow(run, TOTALS))


def score_totals(windows_with_tokens: DataFrame, make_predict: PredictFactory, every: int) -> DataFrame:
    """:func:`scored_totals` of :func:`score`, summed in the batch that is scored: targets
    and losses do not leave the task."""
    keep = ["win_start", "score_from"]
    scored = _scorer(make_predict, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scored(batches):
            yield _totals(batch, every)

    return _summed(windows_with_tokens.select(*keep, "x", "y").mapInArrow(run, TOTALS))


def _block_tokens(parts: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of blocks back to back, and where each block begins. ``parts`` are the pieces
    of every block, in any order."""
    bounds, items = parts.offsets.to_numpy().astype(np.int64), parts.flatten()
    block = np.repeat(np.arange(len(parts)), np.diff(bounds))
    order = np.lexsort((items.field("cell_offset").to_numpy(zero_copy_only=False), block))
    data, offsets = packed_values(items.field("tokens").take(pa.array(order)))
    return data, offsets[bounds - bounds[0]]


def score_blocks(blocks: DataFrame, make_predict: PredictFactory, block_size: int, every: int, *, windows_at_once: int = 256) -> DataFrame:
    """:func:`score_totals` of the windows of whole blocks, as
    :func:`~corpusloom.operators.sequences.window_blocks` lays them out: a token goes to its
    task once, not once per window that holds it. The model gets up to ``windows_at_once``
    windows a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = make_predict()
        for batch in filter(len, batches):
            data, first = _block_tokens(batch.column("parts"))
            wins = batch.column("windows")
            block = np.repeat(np.arange(len(wins)), np.diff(wins.offsets.to_numpy()))
            start, lengths, scores = (wins.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("win_start", "win_len", "score_from"))
            begin = first[block] + start - batch.column("block_id").to_numpy()[block] * block_size
            if (begin + lengths + 1 > first[block + 1]).any():
                raise ValueError("a window reaches beyond its block and the tokens that follow it")
            data = np.append(data, np.zeros(int(lengths.max(initial=0)), data.dtype))
            for k in range(0, len(begin), windows_at_once):
                at = slice(k, k + windows_at_once)
                size = lengths[at]
                width = int(size.max())
                cut = np.lib.stride_tricks.sliding_window_view(data, width)
                x, y = (cut[begin[at] + i].astype(np.int64) for i in (0, 1))
                low = int(scores[at][0])
                alike = (size == width).all() and (scores[at] == low).all()  # all but the first and the last windows
                if not alike:
                    places = np.arange(width)
                    live = places < size[:, None]
                    x[~live] = y[~live] = 0
                nll = np.asarray(predict(x, y, size), np.float64)
                scored = (slice(None), slice(low, None)) if alike else live & (places >= scores[at][:, None])
                yield _part_sums(start[at] + scores[at] + 1, start[at] + size + 1, y[scored].ravel(), nll[scored].ravel(), every)

    return _summed(blocks.select("block_id", "parts", "windows").mapInArrow(run, TOTALS))


def scored_positions(scored: DataFrame) -> DataFrame:
    """(pos, token, nll) of the positions a window may score; pos is the target's."""
    n = F.size("nll") - F.col("score_from").cast("int")
    at = (F.col("score_from") + 1).cast("int")
    pairs = F.arrays_zip(F.slice("y", at, n).alias("token"), F.slice("nll", at, n).alias("nll"))
    return scored.filter(n > 0).select(
        "win_start", "score_from", F.posexplode(pairs).alias("_i", "_p")
    ).select(
        (F.col("win_start") + F.col("score_from") + F.col("_i") + 1).alias("pos"),
        F.col("_p")["token"].alias("token"),
        F.col("_p")["nll"].alias("nll"),
    )
