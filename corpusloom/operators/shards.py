"""Documents to fixed-size token shards, and shards back to addressable blocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions.columns import idiv
from ..functions.tokens import pair_counts, positions_of
from ..schema import MAX_VOCAB_SIZE, SHARD_SIZE
from ..session import durable, small_side
from .corpus import with_split
from .order import Running, bucket_totals, range_segments, running_offsets, scan
from .tokenizers import byte_length, tokenize


def split_stats(doc_lengths: DataFrame, num_val_docs: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """Docs, tokens and files per split and in total; both splits always appear.

    ``doc_lengths`` is (doc_ordinal, n_tokens). The total number of files is the
    sum over splits, because a split change always starts a new file.
    """
    val = F.col("doc_ordinal") < num_val_docs
    sums = doc_lengths.agg(
        *[
            f(val if name == "val" else ~val).alias(f"{what}_{name}")
            for name in ("val", "train")
            for what, f in (
                ("docs", lambda c: F.coalesce(F.count_if(c), F.lit(0))),
                ("tokens", lambda c: F.coalesce(F.sum(F.when(c, F.col("n_tokens"))), F.lit(0))),
            )
        ]
    )
    files = {s: F.expr(f"(tokens_{s} + {shard_size - 1}) div {shard_size}") for s in ("val", "train")}
    rows = F.array(
        *[
            F.struct(
                F.lit(s).alias("split"),
                F.col(f"docs_{s}").alias("docs"),
                files[s].alias("files"),
                F.col(f"tokens_{s}").alias("tokens"),
            )
            for s in ("val", "train")
        ],
        F.struct(
            F.lit("total").alias("split"),
            (F.col("docs_val") + F.col("docs_train")).alias("docs"),
            (files["val"] + files["train"]).alias("files"),
            (F.col("tokens_val") + F.col("tokens_train")).alias("tokens"),
        ),
    )
    return sums.select(F.inline(rows))


def cut_pieces(placed: DataFrame, size: int, *, by: str | None = "split", halo: int = 0, keep: Sequence[str] = ()) -> DataFrame:
    """Cut sequences placed at ``offset`` into pieces of ``size``-token cells.

    A cell also receives the ``halo`` tokens that follow it. Every piece is sliced
    inside one array expression, so a sequence spanning many cells is not copied
    once per cell. Input: (by, doc_ordinal, offset, n_tokens[, tokens]), tokens as an
    array or in the 16-bit shard representation.
    """
    has_tokens = "tokens" in placed.columns
    as_bytes = has_tokens and placed.schema["tokens"].dataType == BinaryType()
    last = F.expr(f"(offset + n_tokens - 1) div {size}")
    first = F.greatest(idiv(F.col("offset") - halo, size), F.lit(0).cast("bigint")) if halo else F.expr(
        f"offset div {size}"
    )

    def piece(cell):
        begin = F.greatest(F.col("offset"), cell * size)
        end = F.least(F.col("offset") + F.col("n_tokens"), cell * size + size + halo)
        fields = [
            cell.alias("cell"),
            (begin - cell * size).alias("cell_offset"),
            (begin - F.col("offset")).alias("doc_from"),
            (end - begin).alias("n"),
        ]
        if has_tokens:
            at, n = (begin - F.col("offset")).cast("int"), (end - begin).cast("int")
            part = F.substring(F.col("tokens"), at * 2 + 1, n * 2) if as_bytes else F.slice(F.col("tokens"), at + 1, n)
            fields.append(part.alias("tokens"))
        return F.struct(*fields)

    pieces = F.inline(F.transform(F.sequence(first, last), piece))
    lost = F.raise_error(F.concat(F.lit("document without text: "), F.col("doc_ordinal").cast("string"))).cast("bigint")
    out = placed.filter(F.coalesce(F.col("n_tokens"), lost) > 0).select(*([by] if by else []), *keep, "doc_ordinal", pieces)
    return out.filter(F.col("n") > 0) if halo else out


def _sized(token_docs: DataFrame) -> DataFrame:
    if "n_tokens" in token_docs.columns:
        return token_docs
    return token_docs.withColumn("n_tokens", F.size("tokens").cast("bigint"))


def place(token_docs: DataFrame, num_val_docs: int, *, total: str | None = None, totals: DataFrame | None = None) -> DataFrame:
    """Offset of every document in its split's token stream; see :func:`running_offsets`."""
    split = with_split(_sized(token_docs), num_val_docs)
    return running_offsets(split, "n_tokens", "doc_ordinal", ["split"], ordinal="split_ordinal", total=total, totals=totals)


def shard_pieces(token_docs: DataFrame, num_val_docs: int, shard_size: int = SHARD_SIZE) -> DataFrame:
    """(split, shard_id, doc_ordinal, shard_offset, doc_from, n[, tokens], shard_tokens).

    With lengths only this is a plan; with tokens it is what the shard sink takes.
    """
    return pieces_of(place(token_docs, num_val_docs, total="split_tokens"), shard_size)


def pieces_of(placed: DataFrame, shard_size: int) -> DataFrame:
    """Shard pieces of placed documents; ``split_tokens`` gives the size of the last shard."""
    rest = F.col("split_tokens") - F.col("cell") * shard_size
    cut = cut_pieces(placed, shard_size, keep=["split_tokens"])
    sized = cut.withColumn("shard_tokens", F.least(F.lit(shard_size), rest).cast("bigint")).drop("split_tokens")
    return sized.withColumnsRenamed({"cell": "shard_id", "cell_offset": "shard_offset"})


def export_plan(
    docs: DataFrame, num_val_docs: int, shard_size: int = SHARD_SIZE, tokenizer: str = "pure_byte_260"
) -> tuple[DataFrame, DataFrame]:
    """Pieces of whole documents for the shard sink, and (split, docs, tokens).

    Byte lengths are known from the text, so text is what travels to its place and
    tokens are made behind that shuffle: one scan for the lengths of ordinal buckets,
    whose sums are durable, and one for the pieces. Other tokenizers run once, into a
    durable table of packed tokens.
    """
    if tokenizer == "pure_byte_260":
        sized = docs.select("doc_ordinal", "text", byte_length(F.col("text")).alias("n_tokens"))
    else:
        made = tokenize(docs.select("doc_ordinal", "text"), tokenizer, as_bytes=True)
        sized = durable(made.withColumn("n_tokens", idiv(F.octet_length("tokens").cast("bigint"), 2)))
    totals = durable(bucket_totals(with_split(sized, num_val_docs), "n_tokens", "doc_ordinal", ["split"]))
    placed = place(sized, num_val_docs, total="split_tokens", totals=totals)
    if tokenizer == "pure_byte_260":
        placed = tokenize(placed, tokenizer, as_bytes=True)
    counted = totals.groupBy("split").agg(F.sum("_rows").alias("docs"), F.sum("_length").alias("tokens"))
    return pieces_of(placed, shard_size), counted


def export_pieces(
    docs: DataFrame, num_val_docs: int, shard_size: int = SHARD_SIZE, tokenizer: str = "pure_byte_260"
) -> DataFrame:
    """Pieces of whole documents for the shard sink."""
    return export_plan(docs, num_val_docs, shard_size, tokenizer)[0]


def blocks(placed: DataFrame, block_size: int, *, by: str | None = "split", halo: int = 0) -> DataFrame:
    """Token stream as ([by,] block_id, base_offset, tokens), ``halo`` tokens of overlap.

    A block collects at most ``block_size + halo`` tokens, whatever the documents
    look like, so no group grows with the data. For a single stream pass
    ``by=None``: the blocks are then partitioned by block number alone, which is
    the key everything that fetches tokens joins on, so they are not moved again.
    """
    keys = [by] if by else []
    pieces = cut_pieces(placed, block_size, by=by, halo=halo)
    ordered = F.array_sort(F.collect_list(F.struct("cell_offset", "tokens")))
    return pieces.groupBy(*keys, F.col("cell").alias("block_id")).agg(
        F.flatten(F.transform(ordered, lambda p: p["tokens"])).alias("tokens")
    ).select(*keys, "block_id", (F.col("block_id") * block_size).alias("base_offset"), "tokens")


def open_stream(shards: DataFrame, block_size: int, *, halo: int = 0, sizes: DataFrame | None = None) -> DataFrame:
    """Shards read from files, joined into one stream per split in shard order.

    ``shards`` holds (split, shard_id, block_offset, shard_tokens, tokens) as the
    shard source returns it; a shard's base is the sum of the shards before it.
    ``sizes`` (split, shard_id, n_tokens), from the file listing, saves the pass
    over the shards that finds their sizes.
    """
    if sizes is None:
        sizes = shards.select("split", "shard_id", F.col("shard_tokens").alias("n_tokens")).distinct()
    # One row per shard, as a table of known size: while that is below Spark's limit for
    # broadcasts, the tokens are shuffled once only, into blocks.
    bases = small_side(running_offsets(sizes, "n_tokens", "shard_id", ["split"]).select("split", "shard_id", F.col("offset").alias("_base")))
    placed = (
        shards.join(bases, ["split", "shard_id"])
        .withColumn("offset", F.col("_base") + F.col("block_offset"))
        .withColumn("n_tokens", F.size("tokens").cast("bigint"))
        .withColumn("doc_ordinal", F.col("shard_id").cast("bigint"))
    )
    return blocks(placed, block_size, halo=halo)


def doc_spans(stream: DataFrame, bos: int, *, by: str = "split", include_next_bos: bool = True) -> DataFrame:
    """(by, start, length) of every document in a token stream, found by BOS.

    Tokens before the first BOS belong to no document. ``stream`` is made of
    blocks without halo.
    """
    # Blocks are assembled once: both branches read their few positions from a durable table.
    marks = durable(stream.select(by, "base_offset", positions_of(F.col("tokens"), bos).alias("_at"), F.size("tokens").alias("_n")))
    found = marks.select(by, "base_offset", F.explode("_at").alias("_at"))
    starts = found.select(by, (F.col("base_offset") + F.col("_at")).alias("start")).withColumn("_desc", -F.col("start"))
    order = [by, "_desc"]
    ends = scan(range_segments(starts, order), [by], ["_desc"], [Running("lag", "start", "_next")])
    totals = marks.groupBy(by).agg(F.max(F.col("base_offset") + F.col("_n")).alias("_total"))
    # One row per split.
    length = F.when(F.col("_next").isNull(), F.col("_total")).otherwise(
        F.col("_next") + (1 if include_next_bos else 0)
    ) - F.col("start")
    return ends.join(F.broadcast(totals), by).select(by, "start", length.alias("length"))


def check_spans(spans: DataFrame) -> DataFrame:
    return spans.filter(F.col("length") < 2).select(
        F.lit("document_too_short").alias("rule"), F.col("start").cast("string").alias("detail")
    )


def stream_pair_counts(stream: DataFrame) -> DataFrame:
    """(prev, token, n) of neighbours in a stream whose blocks carry a halo of one token,
    counted inside the Arrow batch."""

    def run(batches):
        for batch in filter(len, batches):
            yield pair_counts(batch.column(0), MAX_VOCAB_SIZE, False)

    counted = stream.select("tokens").mapInArrow(run, "prev INT, token INT, n BIGINT")
    return counted.groupBy("prev", "token").agg(F.sum("n").alias("n"))


def with_previous(stream: DataFrame, *, by: str = "split") -> DataFrame:
    """Long form (by, pos, prev, token): the shift by one between input and target.

    ``stream`` blocks carry a halo of one token, so each block holds its own pairs
    and nothing is joined; the very first token has no predecessor.
    """
    n = F.size("tokens")
    lead = F.when(F.col("block_id") == 0, F.array(F.lit(None).cast("int"))).otherwise(F.array().cast("array<int>"))
    skip = F.when(F.col("block_id") == 0, F.lit(0)).otherwise(F.lit(1))
    pairs = F.arrays_zip(
        F.concat(lead, F.slice("tokens", 1, n - 1)).alias("prev"),
        F.slice("tokens", skip + 1, n).alias("token"),
    )
    return stream.select(by, (F.col("base_offset") + skip).alias("_at"), F.posexplode(pairs).alias("_i", "_p")).select(
        by, (F.col("_at") + F.col("_i")).alias("pos"), F.col("_p")["prev"].alias("prev"), F.col("_p")["token"].alias("token")
    )
