"""Conversation structure repair by weighted CYK interval parsing.

A conversation is sound if the initials of its roles read ``(s?(ua)+)?``. The repair
grammar is in Chomsky normal form: its nonterminals are the pairs (p, q) of states of
that form's automaton, read "these rows, once edited, lead from p to q", with the rules
(p, q) -> (p, r) (r, q). A row is a terminal: kept, given the role user or assistant, or
deleted. Inserted turns are derivations of nothing; their closure (cheapest insertions
from p to q) is put around every terminal, so no rule with an empty side is left. A cell
holds, for a span of rows and a nonterminal, the least (cost, audit): the audit is the
edits' initials. Cells of a span are combined bottom-up, from spans of one row to pairs
of neighbouring spans, until one covers the conversation.

Every derivation crosses every border between two rows in some state, so each way to
split a span gives the same cells, and one split a span is enough: spans are halved, and
a conversation of n rows takes n combinations instead of n^3. Minima of (cost, audit) may
be taken cell by cell, because an audit's letters fix its cost: of two equally cheap
audits of one span neither is a prefix of the other. State and letter fix the role
that an edit gives, so the audit says how the repaired rows are made.

Long conversations: faults and parsing need no texts, only names of rows (turn, role and
a digest). These are dealt by ranges of (conversation, turn), so one conversation may lie
in many tasks. Each task parses its stretch in blocks of ``BLOCK`` rows and hands on a
row a block; blocks are joined in order. Equal rows of one turn travel as one row with a
count. The digest of a repaired conversation is a running hash by its definition: one
task reads the texts of a conversation in order, a batch at a time. The largest thing
held is a conversation's audit, a letter a row, which is also a field of the result.

Nulls: a null conversation is one too; a null turn comes first; a null role or text is
one space. Ties: rows of the same turn are ordered by role, then by the digest of the text.
Empty texts are blank. Very long texts are held one Arrow batch at a time. An empty table
gives an empty result; a conversation whose rows are all dropped keeps its row. Other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import default_parallelism, durable

BLOCK = 256
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
STATES = 4  # nothing yet, after s, after u, after a
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPT = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
SPACES = "\\x20\\x09-\\x0D"

Cell = tuple[int, str]
Cells = tuple[tuple[Cell | None, ...], ...]


def combine(left: Cells, right: Cells) -> Cells:
    """The rules (p, q) -> (p, r) (r, q): cells of two neighbouring spans together."""
    out = []
    for p in range(STATES):
        row: list[Cell | None] = [None] * STATES
        for r in range(STATES):
            first = left[p][r]
            if first is None:
                continue
            for q in range(STATES):
                second = right[r][q]
                if second is None:
                    continue
                cost = first[0] + second[0]
                best = row[q]
                if best is None or cost <= best[0]:
                    cell = (cost, first[1] + second[1])
                    if best is None or cell < best:
                        row[q] = cell
        out.append(tuple(row))
    return tuple(out)


def _least(*cells: Cells) -> Cells:
    return tuple(tuple(min((c[p][q] for c in cells if c[p][q] is not None), default=None) for q in range(STATES)) for p in range(STATES))


def _closure() -> Cells:
    """Cheapest insertions that lead from one state to another; none if they are equal."""
    none = tuple(tuple((0, "") if p == q else None for q in range(STATES)) for p in range(STATES))
    one = tuple(tuple((INSERT, "I") if any(STEP.get((p, c)) == q for c in NAMES) else None for q in range(STATES)) for p in range(STATES))
    closed = none
    while (wider := _least(closed, combine(closed, one))) != closed:
        closed = wider
    return closed


NOTHING = _closure()


@lru_cache(maxsize=None)
def terminal(symbol: str) -> Cells:
    """Cells of one row. ``symbol``: the role's initial (``-`` for any but s, u and a),
    in upper case if the row is truncated, or ``!`` if it must go."""
    role, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    out = []
    for p in range(STATES):
        row: list[Cell | None] = [None] * STATES
        edits = [(DELETE, "D", p)]
        if symbol != "!":
            edits += [(KEEP + extra, "K", STEP.get((p, role)))] + [(REROLE + extra, "R", STEP.get((p, c))) for c in NAMES]
        for cost, letter, q in edits:
            if q is not None and (row[q] is None or (cost, letter) < row[q]):
                row[q] = (cost, letter)
        out.append(tuple(row))
    return combine(combine(NOTHING, tuple(out)), NOTHING)


@lru_cache(maxsize=100_000)
def _short(symbols: str) -> Cells:
    if not symbols:
        return NOTHING
    if len(symbols) == 1:
        return terminal(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combine(_short(symbols[:half]), _short(symbols[half:]))


def parse(symbols: str) -> Cells:
    """Cells of a span of rows. Spans of up to 8 rows are remembered: they recur."""
    if len(symbols) <= 8:
        return _short(symbols)
    half = 1 << (len(symbols) - 1).bit_length() - 1
    return combine(parse(symbols[:half]), parse(symbols[half:]))


def verdict(cells: Cells) -> Cell:
    """Least cost and audit that make a whole conversation sound."""
    return min(cells[0][q] for q in ACCEPT if cells[0][q] is not None)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) after damage that a checksum of conversation and
    turn chooses; a row that is repeated has a ``copies`` of 2."""
    space = F.lit(" ")
    name = [F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")]
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", space).alias("role"),
        F.coalesce("text", space).alias("text"), (F.crc32(F.concat_ws(":", *name).cast("binary")) % 20).alias("fate"),
    )
    text = F.when(F.col("fate") == 1, F.lit("")).when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("fate") == 4, F.lit("user")).otherwise(F.col("role"))
    copies = F.when(F.col("fate") == 3, 2).otherwise(1).cast("bigint")
    return rows.filter("fate <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


ORDER = ("conv_id", "turn", "role", "digest")


def faulty(rows: DataFrame) -> DataFrame:
    """Names of rows (conv_id, turn, role, digest), equal ones as one with ``copies``, and
    their faults ``blank``, ``truncated`` and ``first`` (not seen in an earlier turn)."""
    named = rows.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "copies",
        (~F.col("text").rlike(f"[^{SPACES}]")).alias("blank"), (~F.col("text").rlike(f"[.!?][{SPACES}]*\\z")).alias("truncated"),
    )
    one = durable(named.groupBy(*ORDER, "blank", "truncated").agg(F.sum("copies").alias("copies")))
    # A null turn is the smallest. Only the earliest row of a text finds an entry under its
    # whole name, so a text that recurs often does not meet in one task.
    turn = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
    earliest = one.groupBy("conv_id", "role", "digest").agg(F.min(turn).alias("o"))
    earliest = earliest.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("o.turn").alias("t"), F.lit(True).alias("first"))
    same = one["conv_id"].eqNullSafe(earliest["c"]) & one["turn"].eqNullSafe(earliest["t"]) & (one["role"] == earliest["r"]) & (one["digest"] == earliest["d"])
    return one.join(earliest, same, "left").select(*ORDER, "copies", F.coalesce("first", F.lit(False)).alias("first"), "blank", "truncated")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def _symbols(role: str, copies: int, first: bool, blank: bool, truncated: bool) -> str:
    """One symbol a copy: of equal rows all but the first are duplicates."""
    if blank or not first:
        return "!" * copies
    initial = role[:1] if role[:1] in ("s", "u", "a") else "-"
    # "-" has no upper case; X is a truncated row of another role.
    return (initial if not truncated else {"-": "X"}.get(initial, initial.upper())) + "!" * (copies - 1)


def ordered(faults: DataFrame) -> DataFrame:
    """Names of rows, dealt by ranges of conversation and turn and sorted, with their
    place (segment, block, pos) and symbols."""
    by = [F.asc_nulls_first(c) for c in ORDER]
    own = [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("blank", pa.bool_()), ("truncated", pa.bool_())]
    arrow = pa.schema([*own, ("segment", pa.int32()), ("block", pa.int64()), ("pos", pa.int32()), ("symbols", pa.string())])

    def number(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block, pos = (None, None), 0, 0
        for batch in batches:
            rows = []
            for conv, turn, role, digest, copies, first, blank, truncated, segment in zip(*(c.to_pylist() for c in batch.columns)):
                if (True, conv) != now:
                    now, block, pos = (True, conv), 0, 0
                elif pos == BLOCK:
                    block, pos = block + 1, 0
                rows.append((conv, turn, role, digest, blank, truncated, segment, block, pos, _symbols(role, copies, first, blank, truncated)))
                pos += 1
            if rows:
                yield _batch(rows, arrow)

    n = default_parallelism(faults.sparkSession)
    dealt = faults.select(*ORDER, "copies", "first", "blank", "truncated").repartitionByRange(n, *by).sortWithinPartitions(*by)
    schema = "conv_id bigint, turn bigint, role string, digest string, blank boolean, truncated boolean, segment int, block bigint, pos int, symbols string"
    return durable(dealt.withColumn("segment", F.spark_partition_id()).mapInArrow(number, schema))


COUNTS = ("blank", "duplicate", "truncated", "illegal")


def _pack(cells: Cells) -> str:
    return "\n".join("" if c is None else f"{c[0]} {c[1]}" for row in cells for c in row)


def _unpack(packed: str) -> Cells:
    found = [(int(x[: x.index(" ")]), x[x.index(" ") + 1 :]) if x else None for x in packed.split("\n")]
    return tuple(tuple(found[p * STATES : (p + 1) * STATES]) for p in range(STATES))


def blocks(rows: DataFrame) -> DataFrame:
    """One row for each block of a conversation: its border roles, faults, symbols and cells."""
    arrow = pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int32()), ("block", pa.int64()), ("head", pa.string()), ("tail", pa.string()),
        *[(c, pa.int64()) for c in COUNTS], ("symbols", pa.list_(pa.string())), ("cells", pa.string()),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        now, symbols, head, tail, counts = None, [], "", "", [0, 0, 0, 0]
        for batch in batches:
            for conv, segment, block, role, blank, truncated, own in zip(*(c.to_pylist() for c in batch.columns)):
                initial, copies = role[:1], len(own)
                if (conv, segment, block) != now:
                    if now is not None:
                        out.append((*now, head, tail, *counts, symbols, _pack(parse("".join(symbols)))))
                    now, symbols, head, tail, counts = (conv, segment, block), [], initial, None, [0, 0, 0, 0]
                counts[3] += (tail is not None and tail + initial not in LEGAL) + (copies - 1 if 2 * initial not in LEGAL else 0)
                tail = initial
                must_go = own.count("!")
                counts[0 if blank else 1] += must_go
                counts[2] += truncated and must_go < copies
                symbols.append(own)
            if len(out) >= 512:
                yield _batch(out, arrow)
                out = []
        if now is not None:
            out.append((*now, head, tail, *counts, symbols, _pack(parse("".join(symbols)))))
            yield _batch(out, arrow)

    schema = "conv_id bigint, segment int, block bigint, head string, tail string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, symbols array<string>, cells string"
    return rows.select("conv_id", "segment", "block", "role", "blank", "truncated", "symbols").mapInArrow(run, schema)


def edits(audit: str, rows: list[str]) -> list[str]:
    """For each row (its symbols) what to write: u or a an inserted turn, K the row as it
    is, U or A the row under another role, D nothing."""
    state, at, out = 0, 0, []

    def inserted() -> str:
        nonlocal state, at
        made = ""
        while at < len(audit) and audit[at] == "I":
            c = next(c for c in NAMES if (state, c) in STEP)
            state, at, made = STEP[state, c], at + 1, made + c
        return made

    for symbols in rows:
        code = ""
        for symbol in symbols:
            code += inserted()
            letter, at = audit[at], at + 1
            if letter != "D":
                c = symbol.lower() if letter == "K" else next(c for c in NAMES if (state, c) in STEP)
                state = STEP[state, c]
                code += "K" if letter == "K" else c.upper()
            else:
                code += "D"
        out.append(code)
    if out:
        out[-1] += inserted()
    return out


def joined(parts: DataFrame) -> DataFrame:
    """A row a block with the ``codes`` of its rows (see :func:`edits`); a conversation's
    first block also has its faults, cost and audit."""
    arrow = pa.schema([
        ("conv_id", pa.int64()), ("segment", pa.int32()), ("block", pa.int64()), *[(c, pa.int64()) for c in (*COUNTS, "cost")],
        ("audit", pa.string()), ("codes", pa.list_(pa.string())),
    ])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counts, tail = (None, None), [0, 0, 0, 0], ""
        spans: list[tuple[int, Cells]] = []  # of falling sizes: neighbours of one size are combined
        places: list[tuple[int, int, list[str]]] = []

        def close() -> list[tuple]:
            cells = spans[-1][1]
            for _, left in reversed(spans[:-1]):
                cells = combine(left, cells)
            cost, audit = verdict(cells)
            codes = edits(audit, [s for _, _, own in places for s in own])
            out, at = [], 0
            for i, (segment, block, own) in enumerate(places):
                result = (*counts, cost, audit) if i == 0 else (None,) * 6
                out.append((now[1], segment, block, *result, codes[at : at + len(own)]))
                at += len(own)
            return out

        for batch in batches:
            rows = []
            for conv, segment, block, head, last, *own, symbols, packed in zip(*(c.to_pylist() for c in batch.columns)):
                if (True, conv) != now:
                    if spans:
                        rows += close()
                    now, counts, spans, places = (True, conv), [0, 0, 0, 0], [], []
                elif tail + head not in LEGAL:
                    counts[3] += 1
                counts = [a + b for a, b in zip(counts, own)]
                tail = last
                places.append((segment, block, symbols))
                span = (1, _unpack(packed))
                while spans and spans[-1][0] == span[0]:
                    size, left = spans.pop()
                    span = (2 * size, combine(left, span[1]))
                spans.append(span)
            if rows:
                yield _batch(rows, arrow)
        if spans:
            yield _batch(close(), arrow)

    together = parts.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "segment", "block")
    schema = "conv_id bigint, segment int, block bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, codes array<string>"
    return durable(together.mapInArrow(run, schema))


def digests(lines: DataFrame, texts: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256). ``lines``: names of rows and their code, ``texts``: names
    and texts. A row's code comes right before its text, equal texts after it are passed over."""
    arrow = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher, lines, code = (None, None), None, 0, None

        def write(code: str, role: str, text: str) -> None:
            nonlocal lines
            for c in code:
                if c == "D":
                    continue
                line = f"{NAMES[c]}:" if c in NAMES else f"{role if c == 'K' else NAMES[c.lower()]}:{text}"
                hasher.update((("\n" if lines else "") + line).encode())
                lines += 1

        for batch in batches:
            out = []
            for conv, role, given, text in zip(*(c.to_pylist() for c in batch.columns)):
                if (True, conv) != now:
                    if hasher is not None:
                        out.append((now[1], hasher.hexdigest()))
                    now, hasher, lines, code = (True, conv), hashlib.sha256(), 0, None
                if given is None:
                    if code is not None:
                        write(code, role, text)
                    code = None
                elif set(given) & {"K", "U", "A"}:
                    code = given
                else:
                    write(given, role, "")
            if out:
                yield _batch(out, arrow)
        if hasher is not None:
            yield _batch([(now[1], hasher.hexdigest())], arrow)

    both = lines.select(*ORDER, "code", F.lit(None).cast("string").alias("text")).unionByName(texts.select(*ORDER, F.lit(None).cast("string").alias("code"), "text"))
    by = [F.asc_nulls_first(c) for c in ORDER]
    together = both.repartition("conv_id").sortWithinPartitions(*by, F.col("code").isNull())
    return together.select("conv_id", "role", "code", "text").mapInArrow(run, "conv_id bigint, repaired_sha256 string")


def repair(conversations: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """One row for each conv_id of ``conversations``: gaps, faults, cost, audit and the
    digest of its repaired rows. ``rows`` (conv_id, turn, role, text, copies) are those to
    be repaired; by default the conversations' own, without damage."""
    if rows is None:
        space = F.lit(" ")
        ids = [F.col(c).cast("bigint").alias(c) for c in ("conv_id", "turn")]
        rows = conversations.select(*ids, F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.lit(1).cast("bigint").alias("copies"))
    names = ordered(faulty(rows))
    found = joined(blocks(names))
    turns = names.groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    at = names["conv_id"].eqNullSafe(found["conv_id"]) & (names["segment"] == found["segment"]) & (names["block"] == found["block"])
    lines = names.join(found.filter(F.exists("codes", lambda c: c.rlike("[uaKUA]"))), at).select(*[names[c] for c in ORDER], F.get("codes", F.col("pos")).alias("code"))
    texts = rows.filter(F.col("text").rlike(f"[^{SPACES}]")).select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    hashes = digests(lines.filter("code rlike '[uaKUA]'"), texts)
    out = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id")).distinct()
    for part, name in ((turns, "t"), (found.filter("cost is not null").drop("segment", "block", "codes"), "f"), (hashes, "h")):
        own = part.withColumnRenamed("conv_id", name)
        out = out.join(own, out["conv_id"].eqNullSafe(own[name]), "left").drop(name)
    zero = F.lit(0).cast("bigint")
    return out.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in ("gaps", *COUNTS, "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
