"""SQL table functions over the closed-form plans, for users who work in SQL.

Large plans should use the DataFrame functions, which run on ``spark.range``; a
table function yields the rows of one call from one task. A function over a table walks
each partition of its argument in one task, row by row, with a state of a few numbers;
where one partition is most of the table, the DataFrame functions cut it.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, arrow_udtf, udtf

from ..operators.sequences import window_at, window_count, window_counts, windows_at

POLICY_NAMES = "all_starts, full_only, full_first, jump, exact_once"
#: Windows in an Arrow batch of ``windows_of`` for a known schema.
WINDOW_ROWS = 1 << 16


def _table(arg: AnalyzeArgument, function: str, *columns: str) -> list[T.StructField]:
    """The fields of a table argument that has ``columns``."""
    if not arg.isTable:
        raise ValueError(f"{function}: the first argument must be TABLE(...)")
    missing = [c for c in columns if c not in arg.dataType.names]
    if missing:
        raise ValueError(f"{function}: the table lacks {', '.join(missing)}")
    return list(arg.dataType.fields)


def _positive(arg: AnalyzeArgument, function: str, name: str) -> int:
    if not arg.isConstantExpression or not isinstance(arg.value, int) or arg.value <= 0:
        raise ValueError(f"{function}: {name} must be a constant above 0")
    return arg.value


def _bigint(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


@udtf(returnType="doc_shard: bigint, shard_offset: bigint, doc_from: bigint, n: bigint")
class ShardPieces:
    """``shard_pieces(offset, n_tokens, shard_size)`` of one document; use LATERAL."""

    def eval(self, offset: int, n_tokens: int, shard_size: int):
        end = offset + n_tokens
        for shard in range(offset // shard_size, -(-end // shard_size)):
            low, high = max(offset, shard * shard_size), min(end, (shard + 1) * shard_size)
            yield shard, low % shard_size, low - offset, high - low


@udtf(returnType="chunk_id: bigint, tokens: bigint")
class MicroChunks:
    """``micro_chunks(total, seq_len, max_chunk)``."""

    def eval(self, total: int, seq_len: int, max_chunk: int):
        rows = total // seq_len
        rows_per_chunk = max(max_chunk // seq_len, 1)
        for chunk_id in range(-(-rows // rows_per_chunk)):
            yield chunk_id, min(rows_per_chunk, rows - chunk_id * rows_per_chunk) * seq_len


@udtf(returnType="win_start: bigint, win_len: bigint, score_from: bigint")
class Windows:
    """``windows(total, seq_len, stride[, policy])`` of one sequence."""

    def eval(self, total: int, seq_len: int, stride: int, policy: str = "all_starts"):
        for k in range(window_count(total, seq_len, stride, policy)):
            yield window_at(k, total, seq_len, stride, policy)


@udtf(useArrow=True)
class ShardPiecesOf:
    """``shard_pieces_of(TABLE(docs) PARTITION BY … ORDER BY (…), shard_size)``: the columns
    of every document (with n_tokens) and its pieces in the stream of its partition. The
    offset is carried from row to row."""

    @staticmethod
    def analyze(docs: AnalyzeArgument, shard_size: AnalyzeArgument) -> AnalyzeResult:
        fields = _table(docs, "shard_pieces_of", "n_tokens")
        _positive(shard_size, "shard_pieces_of", "shard_size")
        return AnalyzeResult(T.StructType([*fields, *_bigint("shard_id", "shard_offset", "doc_from", "n")]))

    def __init__(self):
        self.offset = 0

    def eval(self, row: Row, shard_size: int):
        end = self.offset + row["n_tokens"]
        for shard in range(self.offset // shard_size, -(-end // shard_size)):
            low, high = max(self.offset, shard * shard_size), min(end, (shard + 1) * shard_size)
            yield (*row, shard, low % shard_size, low - self.offset, high - low)
        self.offset = end


@udtf(useArrow=True)
class WindowsOf:
    """``windows_of(TABLE(sequences), seq_len, stride, policy)``: the columns of every
    sequence (with total, its number of pairs) and its windows under a policy."""

    @staticmethod
    def analyze(sequences: AnalyzeArgument, seq_len: AnalyzeArgument, stride: AnalyzeArgument, policy: AnalyzeArgument) -> AnalyzeResult:
        fields = _table(sequences, "windows_of", "total")
        if _positive(stride, "windows_of", "stride") > _positive(seq_len, "windows_of", "seq_len"):
            raise ValueError("windows_of: stride must not exceed seq_len")
        if not policy.isConstantExpression or policy.value not in POLICY_NAMES.split(", "):
            raise ValueError(f"windows_of: policy must be one of {POLICY_NAMES}")
        return AnalyzeResult(T.StructType([*fields, *_bigint("window_id", "win_start", "win_len", "score_from")]))

    def eval(self, row: Row, seq_len: int, stride: int, policy: str):
        for k in range(window_count(row["total"], seq_len, stride, policy)):
            yield (*row, k, *window_at(k, row["total"], seq_len, stride, policy))


class ArrowWindowsOf:
    """:class:`WindowsOf` on Arrow batches, without Python's work for each window. A long
    sequence fills several batches of at most ``WINDOW_ROWS`` windows."""

    def eval(self, rows: pa.RecordBatch, seq_len: pa.Array, stride: pa.Array, policy: pa.Array):
        if not rows.num_rows:
            return
        plan = seq_len[0].as_py(), stride[0].as_py(), policy[0].as_py()
        if not 0 < plan[1] <= plan[0]:
            raise ValueError("windows_of: need 0 < stride <= seq_len")
        total = rows.column("total")
        if total.null_count:
            raise ValueError("windows_of: a sequence without total")
        total = total.to_numpy(zero_copy_only=False).astype(np.int64)
        counts = window_counts(total, *plan)
        ends = np.cumsum(counts)
        for low in range(0, int(ends[-1]), WINDOW_ROWS):
            at = np.arange(low, min(low + WINDOW_ROWS, int(ends[-1])))
            row = np.searchsorted(ends, at, side="right")
            k = at - (ends - counts)[row]
            made = [pa.array(a) for a in (k, *windows_at(k, total[row], *plan))]
            names = [*rows.schema.names, "window_id", "win_start", "win_len", "score_from"]
            yield pa.RecordBatch.from_arrays([*rows.take(pa.array(row)).columns, *made], names=names)


def register_windows_of(spark: SparkSession, name: str, schema: T.StructType) -> None:
    """Register ``name`` as ``windows_of`` for tables of ``schema``. Spark's functions on
    Arrow batches must know their columns beforehand; ``windows_of`` itself takes any
    table, at the price of one Python row a window."""
    if "total" not in schema.names:
        raise ValueError("windows_of: the table lacks total")
    made = _bigint("window_id", "win_start", "win_len", "score_from")
    spark.udtf.register(name, arrow_udtf(ArrowWindowsOf, returnType=T.StructType([*schema.fields, *made])))


def register(spark: SparkSession) -> None:
    spark.udtf.register("shard_pieces", ShardPieces)
    spark.udtf.register("micro_chunks", MicroChunks)
    spark.udtf.register("windows", Windows)
    spark.udtf.register("shard_pieces_of", ShardPiecesOf)
    spark.udtf.register("windows_of", WindowsOf)
