"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are read in blocks of about ``block_chars`` characters. A block's pre-tokens are
exploded into positions: a block keeps every distinct word once, and every text as
the sequence of the numbers of its words. Words go to buckets by hash, so that equal
words of all blocks meet in one bucket; there each distinct word is encoded once. The
ids go back to the blocks, are joined with the positions and reassembled in order.

A block is named by a digest of its words, so it needs no row numbers: if a lost task
reads other rows in another order, its blocks get other names, and a text whose block
has no ids fails with an error. Give a table, or a DataFrame made durable.

Decoding joins the ids with the token-byte table, which holds one row per vocabulary
entry and is sent to all tasks (a vocabulary of more than ``MAX_VOCABULARY`` entries
is refused).

Nulls: a null text is encoded like an empty one, to no ids; null ids decode to null. Any
doc_id, null and repeated ones too, is carried along. Very long texts make a block of
their own; a word of any length is merged in n log n steps. An empty table gives an
empty result. Other columns are ignored, or kept if named in ``keep``.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import default_parallelism
from .common import OUT_ROWS

BLOCK_CHARS = 16_000_000
MAX_VOCABULARY = 1_000_000
ROW_WORDS = 64_000  # words of the texts that travel in one row, about
WORDS, TEXT = 0, 1
CHANGED = "words of a block are missing: its input changed between two reads"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary of {len(ranks)} entries is too large to send to every task")
    return ranks


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Merge the adjacent pair of lowest rank, the leftmost first, until none has a rank."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))  # neighbours of the part that starts at i
    queue = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(queue)
    alive = bytearray(b"\1") * n
    while queue:
        _, i, end = heapq.heappop(queue)
        if not alive[i] or right[i] >= n or right[right[i]] != end:
            continue  # a part of this pair has been merged since
        alive[right[i]] = 0
        right[i] = end
        if end < n:
            left[end] = i
            pair = word[i : right[end]]
            if pair in ranks:
                heapq.heappush(queue, (ranks[pair], i, right[end]))
        if left[i] >= 0:
            pair = word[left[i] : end]
            if pair in ranks:
                heapq.heappush(queue, (ranks[pair], left[i], end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : right[i]]])
        i = right[i]
    return out


class Splitter:
    """Pre-tokens of texts. A piece between single spaces splits the same way wherever it
    stands, so each distinct piece is matched against the pattern once."""

    def __init__(self, pattern: str):
        self.find = regex.compile(pattern).findall
        self.words: dict[str, int] = {}
        self.heads: dict[str, int] = {}  # pieces at the start of a text, without a space before them
        self.tails: dict[str, int] = {}
        # Words of each piece, one piece after the other.
        self.sizes, self.flat = array("I"), array("I")

    def _learn(self, piece: str) -> int:
        words = self.words
        found = [words.setdefault(w, len(words)) for w in self.find(piece)]
        self.sizes.append(len(found))
        self.flat.extend(found)
        return len(self.sizes) - 1

    def learn(self, text: str) -> tuple[str, list[str]]:
        """The text's first piece and the others, all known afterwards. A piece that is
        empty or touches other white space hangs together with its neighbours."""
        head, *tail = text.split(" ")
        new = set(tail).difference(self.tails)
        bad = {p for p in new if not p or p[0].isspace() or p[-1].isspace()}
        if bad or head[-1:].isspace():
            joined, hang = [[head]], head[-1:].isspace()
            for piece in tail:
                if hang or piece in bad:
                    joined[-1].append(piece)
                else:
                    joined.append([piece])
                hang = piece in bad
            head, *tail = map(" ".join, joined)
            new = set(tail).difference(self.tails)
        if head not in self.heads:
            self.heads[head] = self._learn(head)
        # In a fixed order, so that every reading of the same texts numbers words alike.
        for piece in sorted(new):
            self.tails[piece] = self._learn(" " + piece)
        return head, tail

    def pieces(self, text: str) -> np.ndarray:
        """The text as numbers of pieces."""
        head, tail = self.learn(text)
        return np.array([self.heads[head], *map(self.tails.__getitem__, tail)], np.uint32)

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of words, place of the first, and the words' numbers, of every piece."""
        size = np.array(self.sizes, np.int64)
        return size, np.cumsum(size) - size, np.array(self.flat, np.uint32)


def _named(splitter: Splitter) -> tuple[bytes, list[bytes]]:
    """A block's digest and its words."""
    words = [w.encode() for w in splitter.words]
    sizes = np.fromiter(map(len, words), "<u4", len(words))
    return hashlib.blake2b(sizes.tobytes() + b"".join(words), digest_size=16).digest(), words


def _blocks(batches: Iterable[pa.RecordBatch], pattern: str, block_chars: int, read: Callable) -> Iterator[tuple[Splitter, list, list]]:
    """Splitter, ids and what ``read`` makes of the texts, block by block."""
    splitter, keys, found, chars = Splitter(pattern), [], [], 0
    for batch in batches:
        for key, text in zip(*(c.to_pylist() for c in batch.columns)):
            keys.append(key)
            found.append(read(splitter, text) if text else None)
            chars += len(text or "")
            if chars >= block_chars:
                yield splitter, keys, found
                splitter, keys, found, chars = Splitter(pattern), [], [], 0
    if keys:
        yield splitter, keys, found


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _planes(values: np.ndarray) -> bytes:
    """Numbers with their low bytes first, then the next, and so on: they pack better."""
    return np.ascontiguousarray(values.astype("<u4")).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, *, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(id_col, ids): the token ids of every text, in the order of the text."""
    spark = docs.sparkSession
    if len(ranks) > MAX_VOCABULARY:
        raise ValueError("vocabulary too large")
    shared = spark.sparkContext.broadcast(ranks)
    texts = docs.select(F.col(id_col).cast("bigint").alias("k"), F.col(text_col).alias("t"))
    # Tasks behind both shuffles grow in number with the input.
    buckets = max(default_parallelism(spark), texts.rdd.getNumPartitions())
    word_rows = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("packed", pa.binary())])
    block_rows = pa.schema([("block", pa.binary()), ("kind", pa.int32()), ("keys", pa.list_(pa.int64())), ("packed", pa.binary())])
    result = pa.schema([("k", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def words_of(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        # What a text is cut into is not kept, only its words.
        for splitter, _, _ in _blocks(batches, pattern, block_chars, lambda s, text: s.learn(text) and None):
            name, words = _named(splitter)
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1)) if words else []
            rows = []
            for low, high in zip(edges[:-1], edges[1:]):
                numbers = order[low:high]
                own = [words[i] for i in numbers]
                steps, sizes = np.diff(numbers, prepend=0).astype("<u4"), np.array([len(w) for w in own], "<u4")
                rows.append((int(bucket[numbers[0]]), name, pack(np.array([len(own)], "<u4").tobytes() + steps.tobytes() + sizes.tobytes() + b"".join(own))))
            if rows:
                yield _table(rows, word_rows)

    def positions_of(batches):
        pack = zstandard.ZstdCompressor(level=3).compress
        for splitter, keys, found in _blocks(batches, pattern, block_chars, Splitter.pieces):
            name, table = _named(splitter)[0], splitter.table()
            rows, some, codes, n = [], [], [], 0
            for key, pieces in zip(keys, found):
                some.append(key)
                codes.append(_gather(pieces, *table) if pieces is not None else table[2][:0])
                n += len(codes[-1])
                if n >= ROW_WORDS or len(some) >= OUT_ROWS:
                    rows.append((name, TEXT, some, pack(_sized(codes))))
                    some, codes, n = [], [], 0
                if len(rows) >= 8:
                    yield _table(rows, block_rows)
                    rows = []
            if some:
                rows.append((name, TEXT, some, pack(_sized(codes))))
            if rows:
                yield _table(rows, block_rows)

    def encode_bucket(batches):
        table, unpack, pack = shared.value, zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=3).compress
        now, known = None, {}
        for batch in batches:
            rows = []
            for bucket, name, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if bucket != now:
                    now, known = bucket, {}
                packed = unpack(packed)
                n = int.from_bytes(packed[:4], "little")
                ids, at = [], 4 + 8 * n
                for size in np.frombuffer(packed, "<u4", n, 4 + 4 * n).tolist():
                    word = packed[at : at + size]
                    at += size
                    if word not in known:
                        known[word] = encode_word(word, table)
                    ids.append(known[word])
                sizes = np.fromiter(map(len, ids), "<u4", n)
                flat = np.fromiter((i for one in ids for i in one), "<u4", int(sizes.sum()))
                rows.append((name, WORDS, None, pack(packed[: 4 + 4 * n] + sizes.tobytes() + flat.tobytes())))
            if rows:
                yield _table(rows, block_rows)

    def reassemble(batches):
        unpack = zstandard.ZstdDecompressor().decompress
        now, parts, table = None, [], None
        for batch in batches:
            for name, kind, keys, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if name != now:
                    now, parts, table = name, [], None
                raw = unpack(packed)
                if kind == WORDS:
                    parts.append(np.frombuffer(raw, "<u4"))
                    continue
                if table is None:
                    table = _word_table(parts)
                words = np.frombuffer(raw, "<u4", len(keys))
                codes = _from_planes(raw[4 * len(keys) :])
                ids = _gather(codes, *table)
                ends = np.concatenate([[0], np.cumsum(table[0][codes])])[np.concatenate([[0], np.cumsum(words, dtype=np.int64)])]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), lists], schema=result)

    packed_words = texts.mapInArrow(words_of, "bucket int, block binary, packed binary")
    by_bucket = packed_words.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    block_schema = "block binary, kind int, keys array<bigint>, packed binary"
    coded = by_bucket.mapInArrow(encode_bucket, block_schema)
    positions = texts.mapInArrow(positions_of, block_schema)
    met = coded.unionByName(positions).repartition(buckets, "block").sortWithinPartitions("block", "kind")
    return met.mapInArrow(reassemble, "k bigint, ids array<int>").select(F.col("k").alias(id_col), "ids")


def _sized(codes: list[np.ndarray]) -> bytes:
    return np.array([len(c) for c in codes], "<u4").tobytes() + _planes(np.concatenate(codes))


def _word_table(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number of ids, place of the first id, and the ids of a block's words."""
    counts = [int(p[0]) for p in parts]
    numbers = [np.cumsum(p[1 : n + 1], dtype=np.int64) for p, n in zip(parts, counts)]
    total = max((int(x[-1]) + 1 for x in numbers), default=0)
    size, first = np.full(total, -1, np.int64), np.zeros(total, np.int64)
    flat, at = [], 0
    for part, n, number in zip(parts, counts, numbers):
        own = part[n + 1 : 2 * n + 1].astype(np.int64)
        # Two blocks of the same words send the same parts twice.
        size[number], first[number] = own, at + np.cumsum(own) - own
        flat.append(part[2 * n + 1 :])
        at += len(flat[-1])
    if (size < 0).any():
        raise RuntimeError(CHANGED)
    return size, first, np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)


def _gather(codes: np.ndarray, size: np.ndarray, first: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """What ``codes`` stand for, one after the other."""
    if not len(codes):
        return flat[:0]
    if codes.max() >= len(size):
        raise RuntimeError(CHANGED)
    n = size[codes]
    ends = np.cumsum(n)
    return flat[np.repeat(first[codes] - ends + n, n) + np.arange(ends[-1])]


def decode(encoded: DataFrame, ranks: dict[bytes, int], *, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` that are long or array<int>, and the bytes of its ids."""
    names = encoded.columns
    kinds = {"bigint": pa.int64(), "array<int>": pa.list_(pa.int32())}
    types = [encoded.schema[c].dataType.simpleString() for c in names]
    tokens: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        tokens[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    schema = pa.schema([(c, kinds[t]) for c, t in zip(names, types)] + [(out_col, pa.binary())])
    at = names.index(ids_col)

    def run(batches):
        table = shared.value
        for batch in batches:
            lists = batch.column(at)
            texts = [None if not ids.is_valid else b"".join(map(table.__getitem__, ids.values.to_numpy().tolist())) for ids in lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.binary())], schema=schema)

    return encoded.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in zip(names, types)) + f", `{out_col}` binary")


