"""``token_shards``: batch source, sink and stream source for binary token shards.

A shard is 256 little-endian int32 header words (magic, version, token count) and
16-bit little-endian tokens. Files are split into byte ranges, so one large shard
is read by many tasks; the sink streams the rows of a shard in offset order, tasks
publish their own files in a fresh version of the folder, and the job's commit is one
small file that makes this version current (:mod:`commits`).
"""

from __future__ import annotations

import re
import sys
import uuid
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    In,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from ..schema import (
    MAX_VOCAB_SIZE,
    SHARD_HEADER_BYTES,
    SHARD_HEADER_WORDS,
    SHARD_MAGIC,
    SHARD_PREFIX,
    SHARD_ROWS,
    SHARD_SIZE,
    SHARD_TOKEN_BYTES,
    SHARD_VERSION,
)
from ..session import qualified
from . import commits
from .commits import current, filesystem, new_version, publish, put_whole

DEFAULT_BLOCK = 1 << 16
DEFAULT_SPLIT = 1 << 24
ROWS_PER_ARROW_BATCH = 64


@dataclass
class Shard:
    path: str
    split: str
    shard_id: int
    n_tokens: int


@dataclass
class ShardRange(InputPartition):
    path: str
    split: str
    shard_id: int
    n_tokens: int
    start: int
    stop: int
    epoch: int = 1

    def __post_init__(self):
        self.value = (self.path, self.start, self.stop)


@dataclass
class ShardGroup(InputPartition):
    """Ranges one task reads: a piece of a large shard, or several small shards."""

    ranges: list

    def __post_init__(self):
        self.value = tuple(r.value for r in self.ranges)


def group_ranges(ranges: list[ShardRange], tokens: int) -> list[ShardGroup]:
    groups, filled = [], tokens
    for part in ranges:
        n = part.stop - part.start
        if filled + n > tokens:
            groups.append(ShardGroup([]))
            filled = 0
        groups[-1].ranges.append(part)
        filled += n
    return [ShardGroup(g.ranges) for g in groups]


def shard_name(prefix: str, split: str, shard_id: int) -> str:
    return f"{prefix}_{split}_{shard_id:06d}.bin"


def _name_pattern(prefix: str) -> re.Pattern:
    return re.compile(rf"^{re.escape(prefix)}_(train|val)_(\d+)\.bin$")


def read_header(system: pafs.FileSystem, path: str, size: int) -> int:
    """Token count of a shard after checking header and file size."""
    with system.open_input_file(path) as f:
        header = np.frombuffer(f.read(SHARD_HEADER_BYTES), "<i4")
    if len(header) != SHARD_HEADER_WORDS or header[0] != SHARD_MAGIC or header[1] != SHARD_VERSION:
        raise ValueError(f"not a token shard (header): {path}")
    n = int(header[2])
    if size != SHARD_HEADER_BYTES + n * SHARD_TOKEN_BYTES:
        raise ValueError(f"size of shard {path} is {size} bytes, its header counts {n} tokens")
    return n


def list_shards(path: str, prefix: str, split: str | None, keep=lambda split, shard_id: True) -> list[Shard]:
    """Current shards of a folder in file-name order. Sizes come from the listing;
    headers are checked by the tasks that read them."""
    system, root = filesystem(path)
    pattern = _name_pattern(prefix)
    found = []
    for info in (i for folder in current(system, root) for i in system.get_file_info(pafs.FileSelector(folder))):
        match = pattern.match(info.base_name)
        if not match or (split and match.group(1) != split) or not keep(match.group(1), int(match.group(2))):
            continue
        payload = info.size - SHARD_HEADER_BYTES
        if payload < 0 or payload % SHARD_TOKEN_BYTES:
            raise ValueError(f"size of shard {info.path} is {info.size} bytes, no whole number of tokens")
        found.append(Shard(info.path, match.group(1), int(match.group(2)), payload // SHARD_TOKEN_BYTES))
    return sorted(found, key=lambda s: s.path.rsplit("/", 1)[-1])


def read_range(root: str, part: ShardRange, block: int) -> Iterator[tuple[int, np.ndarray]]:
    """(offset in shard, tokens) of one byte range, ``block`` tokens at a time."""
    system, _ = filesystem(root)
    size = system.get_file_info(part.path).size
    if read_header(system, part.path, size) != part.n_tokens:
        raise ValueError(f"size of shard {part.path} changed while it was read")
    with system.open_input_file(part.path) as f:
        at = part.start
        while at < part.stop:
            n = min(block - at % block, part.stop - at)
            data = f.read_at(n * SHARD_TOKEN_BYTES, SHARD_HEADER_BYTES + at * SHARD_TOKEN_BYTES)
            tokens = np.frombuffer(data, "<u2")
            if len(tokens) != n:
                raise ValueError(f"shard {part.path} ends early")
            yield at, tokens.astype(np.int32)
            at += n


def _batches(root: str, part: ShardRange, block: int, with_epoch: bool) -> Iterator[pa.RecordBatch]:
    offsets, arrays = [], []

    def flush() -> pa.RecordBatch:
        n = len(offsets)
        bounds = np.zeros(n + 1, np.int32)
        np.cumsum([len(a) for a in arrays], out=bounds[1:])
        columns = {
            "split": pa.array([part.split] * n),
            "shard_id": pa.array([part.shard_id] * n, pa.int32()),
            "block_offset": pa.array(offsets, pa.int64()),
            "shard_tokens": pa.array([part.n_tokens] * n, pa.int64()),
            "tokens": pa.ListArray.from_arrays(bounds, np.concatenate(arrays)),
        }
        if with_epoch:
            columns = {"epoch": pa.array([part.epoch] * n, pa.int64()), **columns}
        return pa.RecordBatch.from_pydict(columns)

    for at, tokens in read_range(root, part, block):
        offsets.append(at)
        arrays.append(tokens)
        if len(offsets) == ROWS_PER_ARROW_BATCH:
            yield flush()
            offsets, arrays = [], []
    if offsets:
        yield flush()


class TokenShards(DataSource):
    """Options: ``path``, ``split``, ``prefix``, ``blockTokens`` (tokens per row),
    ``splitTokens`` (most tokens per task), ``minPartitions`` (spread small inputs)."""

    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SHARD_ROWS

    def reader(self, schema) -> DataSourceReader:
        return ShardReader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ShardWriter(self.options, overwrite)


class ShardReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.split = options.get("split")
        self.prefix = options.get("prefix", SHARD_PREFIX)
        self.block = int(options.get("blockTokens", DEFAULT_BLOCK))
        self.split_tokens = max(int(options.get("splitTokens", DEFAULT_SPLIT)) // self.block, 1) * self.block
        self.min_partitions = int(options.get("minPartitions", 1))
        self.rules: list[tuple[str, str, object]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = f.attribute[0] if getattr(f, "attribute", None) else None
            if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)) and column in ("split", "shard_id"):
                self.rules.append((column, type(f).__name__, f.value))
            else:
                yield f

    def _keep(self, split: str, shard_id: int) -> bool:
        tests = {
            "EqualTo": lambda a, b: a == b,
            "In": lambda a, b: a in b,
            "LessThan": lambda a, b: a < b,
            "LessThanOrEqual": lambda a, b: a <= b,
        }
        value = {"split": split, "shard_id": shard_id}
        return all(tests[op](value[column], wanted) for column, op, wanted in self.rules)

    def partitions(self):
        shards = list_shards(self.path, self.prefix, self.split, self._keep)
        if not shards and not self.rules:
            raise FileNotFoundError(f"No shards found below {self.path}")
        share = -(-sum(s.n_tokens for s in shards) // max(self.min_partitions, 1))
        target = max(min(self.split_tokens, -(-share // self.block) * self.block), self.block)
        ranges = [
            ShardRange(s.path, s.split, s.shard_id, s.n_tokens, at, min(at + target, s.n_tokens))
            for s in shards
            for at in range(0, max(s.n_tokens, 1), target)
        ]
        return group_ranges(ranges, target)

    def read(self, partition):
        # A reader whose filters leave no file still gets one empty partition.
        if partition is None or partition.value is None:
            return
        for part in partition.ranges:
            yield from _batches(self.path, part, self.block, with_epoch=False)


def _as_uint16(tokens: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and 16-bit tokens of a column of integer lists or packed bytes."""
    if pa.types.is_binary(tokens.type):
        offsets = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1, tokens.offset * 4)
        data = tokens.buffers()[2]
        used = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
        return (offsets - offsets[0]) // 2, used.view("<u2")
    offsets = tokens.offsets.to_numpy()
    values = tokens.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]]
    if len(values) and (values.min() < 0 or values.max() >= MAX_VOCAB_SIZE):
        raise ValueError("token id does not fit 16 bits")
    return offsets - offsets[0], values.astype("<u2")


@dataclass
class ShardsWritten(WriterCommitMessage):
    files: list


class ShardWriter(DataSourceArrowWriter):
    """Rows: (split, shard_id, shard_offset, shard_tokens, tokens), each shard whole in
    one task and sorted by offset (see ``write_shards``).

    A task writes to a folder of its own and, once all its shards are whole, gives them
    their names in the new version. The driver's commit is one small file."""

    def __init__(self, options, overwrite: bool):
        self.path = options["path"].rstrip("/")
        self.prefix = options.get("prefix", SHARD_PREFIX)
        self.overwrite = overwrite
        self.version = new_version(self.path)

    def write(self, iterator):
        system, version = filesystem(self.version)
        attempt = f"{version}/_attempt-{uuid.uuid4().hex}"
        system.create_dir(attempt, recursive=True)
        done, current, out, filled, expected = [], None, None, 0, 0

        def close():
            if out is None:
                return
            out.close()
            if filled != expected:
                raise ValueError(f"shard {current} has {filled} tokens, its plan says {expected}")
            name = shard_name(self.prefix, *current)
            done.append((name, filled))

        for batch in iterator:
            splits, ids = batch.column("split").to_pylist(), batch.column("shard_id").to_pylist()
            at, sizes = batch.column("shard_offset").to_pylist(), batch.column("shard_tokens").to_pylist()
            bounds, values = _as_uint16(batch.column("tokens"))
            for i in range(batch.num_rows):
                if (splits[i], ids[i]) != current:
                    close()
                    current, filled, expected = (splits[i], ids[i]), 0, sizes[i]
                    if expected >= 2**31:
                        raise ValueError("a shard holds fewer than 2**31 tokens")
                    out = system.open_output_stream(f"{attempt}/{shard_name(self.prefix, *current)}")
                    header = np.zeros(SHARD_HEADER_WORDS, "<i4")
                    header[:3] = SHARD_MAGIC, SHARD_VERSION, expected
                    out.write(header.tobytes())
                if at[i] != filled:
                    raise ValueError(f"shard {current}: piece at {at[i]}, expected {filled}")
                piece = values[bounds[i] : bounds[i + 1]]
                out.write(piece.tobytes())
                filled += len(piece)
        close()
        for name, _ in done:
            # Another attempt of this task may have put the same file there.
            put_whole(system, f"{attempt}/{name}", f"{version}/{name}")
        system.delete_dir(attempt)
        return ShardsWritten(done)

    def commit(self, messages):
        system, root = filesystem(self.path)
        version = filesystem(self.version)[1]
        system.create_dir(version, recursive=True)
        files = [f for m in messages if m is not None for f in m.files]
        names = [name for name, _ in files]
        try:
            if len(names) != len(set(names)):
                raise ValueError("a shard was written by more than one task")
            sizes = {i.base_name: i.size for i in system.get_file_info(pafs.FileSelector(version)) if i.type == pafs.FileType.File}
            if sizes != {name: SHARD_HEADER_BYTES + n * SHARD_TOKEN_BYTES for name, n in files}:
                raise ValueError("the shards of this version are not those that its tasks wrote")
            if not self.overwrite:
                there = {s.path.rsplit("/", 1)[-1] for s in list_shards(self.path, self.prefix, None)} & set(names)
                if there:
                    raise ValueError(f"shards exist already: {sorted(there)[:3]}")
        except ValueError:
            self.abort(messages)
            raise
        publish(system, root, version, keep=not self.overwrite)

    def abort(self, messages):
        system, version = filesystem(self.version)
        if system.get_file_info(version).type == pafs.FileType.Directory:
            system.delete_dir(version)


class TokenShardStream(DataSource):
    """Endless, resumable reading of the shards of a split, in file-name order.

    The offset is (epoch, file, pos). ``epochs`` bounds the repetition, and each
    micro-batch advances by at most ``tokensPerBatch`` tokens.
    """

    @classmethod
    def name(cls) -> str:
        return "token_shard_stream"

    def schema(self) -> str:
        return "epoch BIGINT, " + SHARD_ROWS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return ShardStreamReader(self.options)


class ShardIndex:
    """Shards of a split in file-name order, with running sums of their tokens.

    A place in the stream is found by binary search. Files that are there stay as they
    are; ``extend`` adds those that have come since, behind them.
    """

    def __init__(self):
        self.shards: list[Shard] = []
        self.ends: list[int] = []

    def extend(self, listed: list[Shard]) -> None:
        known = len(self.shards)
        name = lambda s: s.path.rsplit("/", 1)[-1]
        if [name(s) for s in listed[:known]] != [name(s) for s in self.shards]:
            raise ValueError("a shard came before others that have been read, or one is gone")
        for shard in listed[known:]:
            self.shards.append(shard)
            self.ends.append((self.ends[-1] if self.ends else 0) + shard.n_tokens)

    @property
    def total(self) -> int:
        return self.ends[-1] if self.ends else 0

    def start(self, file: int) -> int:
        return self.ends[file - 1] if file else 0

    def ranges(self, low: int, high: int, step: int, epoch: int = 1) -> list[ShardRange]:
        """The stretch [low, high) of the stream, in ranges of at most ``step`` tokens."""
        out = []
        file = bisect_right(self.ends, low)
        while low < high:
            shard, base = self.shards[file], self.start(file)
            stop = min(high, self.ends[file])
            for at in range(low, stop, step):
                out.append(ShardRange(shard.path, shard.split, shard.shard_id, shard.n_tokens, at - base, min(at + step, stop) - base, epoch))
            low, file = stop, file + 1
        return out


class ShardStreamReader(DataSourceStreamReader):
    """``tokensPerBatch`` tokens a batch, or all there are (``all``, for a trigger that
    takes what is available in one batch; needs ``epochs``)."""

    def __init__(self, options):
        self.path = options["path"]
        self.prefix = options.get("prefix", SHARD_PREFIX)
        self.split = options.get("split", "train")
        self.block = int(options.get("blockTokens", DEFAULT_BLOCK))
        per_batch = options.get("tokensPerBatch", SHARD_SIZE)
        self.per_batch = None if per_batch == "all" else int(per_batch)
        self.split_tokens = max(int(options.get("splitTokens", DEFAULT_SPLIT)) // self.block, 1) * self.block
        epochs = options.get("epochs")
        self.epochs = int(epochs) if epochs else None
        if self.per_batch is None and self.epochs is None:
            raise ValueError("tokensPerBatch=all needs a number of epochs")
        self.at: dict | None = None
        self.index = ShardIndex()

    def _list(self) -> None:
        shards = [s for s in list_shards(self.path, self.prefix, self.split) if s.n_tokens]
        if not shards:
            raise FileNotFoundError(f"No shards found below {self.path}")
        self.index.extend(shards)

    def initialOffset(self) -> dict:
        return {"epoch": 1, "file": 0, "pos": 0}

    def _advance(self, at: dict, tokens: int | None) -> tuple[int, int]:
        """(epoch, place) ``tokens`` behind ``at``. The folder is listed again only where
        an epoch ends, so a batch costs the files that it reads."""
        epoch, file = at["epoch"], at["file"]
        if file >= len(self.index.shards):
            self._list()
        place = self.index.start(file) + at["pos"]
        while tokens is None or tokens > 0:
            if place == self.index.total:
                self._list()
            if place == self.index.total:
                if self.epochs is not None and epoch >= self.epochs:
                    break
                epoch, place = epoch + 1, 0
            step = self.index.total - place if tokens is None else min(tokens, self.index.total - place)
            place += step
            tokens = None if tokens is None else tokens - step
        return epoch, place

    def _offset(self, epoch: int, place: int) -> dict:
        file = bisect_right(self.index.ends, place)
        return {"epoch": epoch, "file": file, "pos": place - self.index.start(file)}

    def latestOffset(self) -> dict:
        self.at = self._offset(*self._advance(self.at or self.initialOffset(), self.per_batch))
        return self.at

    def partitions(self, start: dict, end: dict):
        if self.at is None or _later(end, self.at):
            # After a restart the first planned batch tells where the stream stands.
            self.at = end
        if not self.index.shards or max(start["file"], end["file"]) > len(self.index.shards):
            self._list()
        ranges, epoch, low = [], start["epoch"], self.index.start(start["file"]) + start["pos"]
        last = self.index.start(end["file"]) + end["pos"]
        while epoch <= end["epoch"]:
            high = last if epoch == end["epoch"] else self.index.total
            ranges += self.index.ranges(low, high, self.split_tokens, epoch)
            epoch, low = epoch + 1, 0
        return group_ranges(ranges, self.split_tokens)

    def read(self, partition):
        for part in partition.ranges:
            yield from _batches(self.path, part, self.block, with_epoch=True)

    def commit(self, end: dict) -> None:
        if self.at is None or _later(end, self.at):
            self.at = end


def _later(a: dict, b: dict) -> bool:
    return (a["epoch"], a["file"], a["pos"]) > (b["epoch"], b["file"], b["pos"])


def register(spark: SparkSession) -> None:
    # The process that plans a streaming source sees no shipped files, so the source
    # classes travel by value.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    cloudpickle.register_pickle_by_value(commits)
    spark.dataSource.register(TokenShards)
    spark.dataSource.register(TokenShardStream)


def write_shards(pieces: DataFrame, path: str, prefix: str = SHARD_PREFIX, mode: str = "overwrite") -> None:
    """Publish ``shard_pieces`` (with tokens) as shard files.

    One shuffle brings the pieces of a shard together; a shard is at most
    ``shard_size`` tokens and is streamed, never held. Until the commit readers find
    the shards that were there before.
    """
    spark = pieces.sparkSession
    register(spark)
    path = qualified(spark, path)
    system, root = filesystem(path)
    system.create_dir(root, recursive=True)
    rows = pieces.select("split", F.col("shard_id").cast("int").alias("shard_id"), "shard_offset", "shard_tokens", "tokens")
    ready = rows.repartition("split", "shard_id").sortWithinPartitions("split", "shard_id", "shard_offset")
    ready.write.format("token_shards").option("path", path).option("prefix", prefix).mode(mode).save()


def shard_sizes(spark: SparkSession, path: str, prefix: str = SHARD_PREFIX, split: str | None = None) -> DataFrame:
    """(split, shard_id, n_tokens) from the file listing; no file is opened."""
    rows = [(s.split, s.shard_id, s.n_tokens) for s in list_shards(qualified(spark, path), prefix, split)]
    return spark.createDataFrame(rows, "split STRING, shard_id INT, n_tokens BIGINT")


def shard_files(spark: SparkSession, path: str) -> str:
    """URI of the folder in which the current shards lie, for readers that list files."""
    path = qualified(spark, path)
    system, root = filesystem(path)
    folders = current(system, root)
    if len(folders) != 1:
        raise ValueError(f"the shards of {path} lie in {len(folders)} folders")
    return path.rstrip("/") + folders[0][len(root) :]


def read_spans(spark: SparkSession, path: str, spans: DataFrame, *, split: str = "train", prefix: str = SHARD_PREFIX) -> DataFrame:
    """``spans`` (start, length and further columns) with their ``tokens``, read by position.

    Each task looks up the files of its spans in the shards' running sums and reads just
    their bytes; nothing is shuffled and no block is assembled. Spans wrap at the end of
    the stream. The running sums come from the listing: as many entries as files.
    """
    root = qualified(spark, path)
    index = ShardIndex()
    index.extend([s for s in list_shards(root, prefix, split) if s.n_tokens])
    if not index.total:
        raise FileNotFoundError(f"No shards found below {path}")
    shared = spark.sparkContext.broadcast(index)
    names = spans.columns
    start, length = names.index("start"), names.index("length")
    schema = T.StructType([*spans.schema.fields, T.StructField("tokens", T.ArrayType(T.IntegerType()))])

    def run(batches):
        index = shared.value
        system, _ = filesystem(root)
        checked: set[str] = set()
        for batch in filter(len, batches):
            found = []
            for at, n in zip(batch.column(start).to_pylist(), batch.column(length).to_pylist()):
                if at < 0 or n < 0:
                    raise ValueError(f"no span: start {at}, length {n}")
                found.append(_span(system, index, at % index.total, n, checked))
            sizes = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(sizes, np.concatenate(found))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=schema.names)

    return spans.mapInArrow(run, schema)


def span_reads(index: ShardIndex, at: int, n: int) -> Iterator[ShardRange]:
    """Ranges of files that hold ``n`` tokens from ``at`` on, from the begin again at the end."""
    while n > 0:
        take = min(n, index.total - at)
        yield from index.ranges(at, at + take, index.total)
        at, n = 0, n - take


def _span(system: pafs.FileSystem, index: ShardIndex, at: int, n: int, checked: set[str]) -> np.ndarray:
    parts = [np.empty(0, np.int32)]
    for part in span_reads(index, at, n):
        if part.path not in checked:
            if read_header(system, part.path, system.get_file_info(part.path).size) != part.n_tokens:
                raise ValueError(f"size of shard {part.path} changed while it was read")
            checked.add(part.path)
        with system.open_input_file(part.path) as f:
            data = f.read_at((part.stop - part.start) * SHARD_TOKEN_BYTES, SHARD_HEADER_BYTES + part.start * SHARD_TOKEN_BYTES)
        parts.append(np.frombuffer(data, "<u2").astype(np.int32))
    return np.concatenate(parts)


def read_shards(spark: SparkSession, path: str, **options) -> DataFrame:
    register(spark)
    reader = spark.read.format("token_shards").option("path", qualified(spark, path))
    reader = reader.option("minPartitions", spark.sparkContext.defaultParallelism)
    for key, value in options.items():
        reader = reader.option(key, value)
    return reader.load()


