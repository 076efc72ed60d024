"""Secret scans by a worklist of recursively decoded layers.

A text is scanned for the base patterns. Then every encoded layer in it is unwrapped
and scanned again, and so on until no new layer appears: URL escapes and Unicode
escapes of a line (decoded together with what stands around them), and base64 runs, on one line or
wrapped over several, whose bytes may in turn be compressed (zlib or gzip, all members).
Of escapes, what is no character stays escaped; compressed bytes written with escapes
are unpacked too. Every find is mapped back to the text: through escapes character by
character, through base64 and compressed bytes to the whole run.

A run counts as base64 if its bytes, decompressed where they begin like compressed
data, are UTF-8 without control characters. A layer equal to one that it lies in is
not opened again, so cycles end. Layers in runs are inflated and scanned in windows of
about ``WINDOW`` characters that end at a line end, so their size is not limited; only a
line, or lines of one wrapped run, are held whole.

Nulls: a null text is scanned like an empty one; a null doc_id is carried along. Repeated rows
are scanned each. An empty table gives an empty result. Other columns are ignored by
``scan`` and kept by ``redact``. Very long texts are scanned whole, in time and memory in
proportion to their length.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from array import array
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

# The kinds in their order, and their patterns.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # a run of 16 or more is the whole match of [0-9a-f]+ there

ESCAPE = re.compile(r"(?:%[0-9A-Fa-f]{2})+|\\u[0-9A-Fa-f]{4}(?:\\u[0-9A-Fa-f]{4})*|(?:\\x[0-9A-Fa-f]{2})+")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
# A base64 run that goes on over line ends, real or written as \n; lines may be indented or quoted.
WRAP = re.compile(r"[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t>]*")
FIRST, RUN, PAD = re.compile(r"[A-Za-z0-9+/_-]{16,}"), re.compile(r"[A-Za-z0-9+/_-]+"), re.compile(r"={0,2}")
TAIL = re.compile(r"[A-Za-z0-9+/_-]*={0,2}$")
STANDARD = str.maketrans("-_", "+/")
# Bytes as they are written with escapes of one sort, plain characters between them.
# First, how such bytes begin if they are compressed.
BYTES = tuple(
    (re.compile(start), re.compile(unit))
    for start, unit in (
        (r"%1[fF]%8[bB]|(?:%[0-7]8|[xhXH8(])%[0-9A-Fa-f]{2}|%[0-7]8[!-$&-~]", r"%(?P<byte>[0-9A-Fa-f]{2})|(?P<plain>[!-$&-~])"),
        (r"\\(?:x|u00)1[fF]\\(?:x|u00)8[bB]|(?:\\(?:x|u00)[0-7]8|\\b|[xhXH8(])\\(?:x|u00)[0-9A-Fa-f]{2}|\\(?:x|u00)[0-7]8|x\^", r"\\(?:x|u00)(?P<byte>[0-9A-Fa-f]{2})|\\(?P<short>[nrtbfva0'\"/\\])|(?P<plain>[ -\[\]-~])"),
    )
)
SHORT = dict(zip("nrtbfva0", b"\n\r\t\b\f\v\a\0"))
CONTROL = re.compile(r"[\x00-\x08\x0e-\x1f\x7f]")
WINDOW = 1 << 22  # characters of a layer that are scanned at once, about
PIECE = 1 << 16  # bytes read at once
MASK = "[REDACTED]"

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """(start, end, kind) of the base patterns, matches that fail their length dropped."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


class Places:
    """Where the characters of a decoded line come from, kept as pieces: stretches that were
    copied, and single characters that stand for several."""

    def __init__(self):
        self.to, self.start, self.width = array("q"), array("q"), array("q")

    def add(self, to: int, start: int, width: int) -> None:
        """From character ``to`` on, copied from ``start`` (width 0) or one character
        made of ``width``."""
        self.to.append(to)
        self.start.append(start)
        self.width.append(width)

    def __call__(self, start: int, end: int) -> tuple[int, int]:
        first, last = bisect_right(self.to, start) - 1, bisect_right(self.to, end - 1) - 1
        begin = self.start[first] + (0 if self.width[first] else start - self.to[first])
        return begin, self.start[last] + (self.width[last] or end - self.to[last])


def _unescape(line: str) -> tuple[str, Places] | None:
    """``line`` with one level of escapes undone, and the places of its characters; None
    if nothing changes."""
    parts, places, last, to = [], Places(), 0, 0

    def copy(until: int) -> None:
        nonlocal to, last
        if until > last:
            parts.append(line[last:until])
            places.add(to, last, 0)
            to += until - last
        last = until

    changed = False
    for m in ESCAPE.finditer(line):
        code = m[0]
        if code[0] == "%":
            raw, step = bytes.fromhex(code.replace("%", "")), 3
        elif code[1] == "x":
            raw, step = bytes.fromhex(code.replace("\\x", "")), 4
        else:
            raw, step = bytes.fromhex(code.replace("\\u", "")), 6
        # Each unit of the escape may be a byte or half a character; units that are
        # no part of a character stay escaped.
        decoded = raw.decode("utf-16-be", "surrogatepass") if step == 6 else raw.decode("utf-8", "surrogateescape")
        place = m.start()
        for char in decoded:
            if "\ud800" <= char <= "\udfff":
                place += step
                continue
            units = len(char.encode("utf-16-be")) // 2 if step == 6 else len(char.encode())
            copy(place)
            parts.append(char)
            places.add(to, place, units * step)
            to += 1
            place += units * step
            last, changed = place, True
    if not changed:
        return None
    copy(len(line))
    return "".join(parts), places


def _packed(raw: bytes) -> bool:
    """Whether ``raw`` begins like a gzip or zlib stream."""
    return raw[:2] == b"\x1f\x8b" or len(raw) > 2 and raw[0] & 15 == 8 and int.from_bytes(raw[:2]) % 31 == 0


class Found:
    """What a layer holds: how many finds of each kind, and a digest of its content."""

    def __init__(self, kinds: Counter, digest: bytes):
        self.kinds, self.digest = kinds, digest

    def __eq__(self, other) -> bool:
        return self.digest == other.digest or self.kinds == other.kinds


class _Text:
    """Takes a text in pieces and scans it in windows that end where no find can lie."""

    def __init__(self, seen: frozenset):
        self.seen, self.kinds, self.digest = seen, Counter(), hashlib.sha256()
        self.decode = codecs.getincrementaldecoder("utf-8")("strict").decode
        self.parts: list[str] = []
        self.size, self.due, self.good, self.empty = 0, WINDOW, True, True

    def feed(self, data: bytes) -> None:
        if not self.good:
            return
        try:
            text = self.decode(data)
        except UnicodeDecodeError:
            text = "\0"
        if CONTROL.search(text):
            self.good, self.parts = False, []
            return
        self.digest.update(data)
        self.parts.append(text)
        self.size += len(text)
        if self.size >= self.due:
            held = "".join(self.parts)
            cut = _border(held)
            if cut:
                self.kinds += _kinds(held[:cut], self.seen)
            self.parts, self.size = [held[cut:]], len(held) - cut
            self.due = max(WINDOW, 2 * self.size)

    def close(self) -> Found | None:
        if not self.good:
            return None
        try:
            self.decode(b"", True)
        except UnicodeDecodeError:
            return None
        held = "".join(self.parts)
        self.kinds += _kinds(held, self.seen)
        return Found(self.kinds, self.digest.digest())


def _border(text: str) -> int:
    """A place behind a line end that no wrapped run goes over; 0 if there is none."""
    at = text.rfind("\n")
    while at >= 0:
        before = text.rfind("\n", 0, at)
        line = text[before + 1 : at].rstrip(" \t\r")
        end = TAIL.search(line[-17:])[0]
        # A run begins with 16 characters in a line, and goes on in lines that hold nothing else.
        if "\\" not in line and (not end or len(end) < 16 and line.lstrip(" \t>") != end):
            return at + 1
        at = before
    return 0


class _Layer:
    """Takes the bytes of a layer in pieces: a text, or compressed streams in a row."""

    def __init__(self, seen: frozenset):
        self.seen, self.head, self.inner = seen, b"", None

    def feed(self, data: bytes) -> None:
        if self.inner is None:
            self.head += data
            if len(self.head) < 3:
                return
            data, self.inner = self.head, (_Streams if _packed(self.head) else _Text)(self.seen)
        self.inner.feed(data)

    def close(self) -> Found | None:
        if self.inner is None:
            self.inner = _Text(self.seen)
            self.inner.feed(self.head)
        return self.inner.close()


class _Streams:
    """Compressed streams in a row. Together they are one layer; if that is no text, each
    is a layer of its own. A broken stream is passed over with all that follows."""

    def __init__(self, seen: frozenset):
        self.seen, self.whole, self.each = seen, _Layer(seen), []
        self.single, self.ended, self.broken, self.any, self.rest = None, False, False, False, b""
        self.taken = self.began = 0  # bytes of sound streams

    def feed(self, data: bytes) -> None:
        data = self.rest + data
        self.rest = b""
        while data and not self.ended:
            if self.single is None:
                bare = data.lstrip(b"\0") if self.each else data  # gzip files may be padded
                if len(bare) < 3:
                    self.rest = data
                    return
                if not _packed(bare[:3]):
                    self.ended = True
                    return
                self.began = self.taken
                self.taken += len(data) - len(bare)
                data, self.stream, self.single = bare, zlib.decompressobj(47), _Layer(self.seen)
            try:
                while data and not self.stream.eof:
                    part = self.stream.decompress(data[:PIECE], WINDOW)
                    self.taken += min(PIECE, len(data)) - len(self.stream.unconsumed_tail) - len(self.stream.unused_data)
                    data = self.stream.unused_data + data[PIECE:] if self.stream.eof else self.stream.unconsumed_tail + data[PIECE:]
                    self._put(part)
                while not self.stream.eof and (part := self.stream.decompress(b"", WINDOW)):
                    self._put(part)
            except zlib.error:
                self.ended = self.broken = True
                self.single, self.taken = None, self.began
                return
            if self.stream.eof:
                self.each.append(self.single.close())
                self.single = None

    def _put(self, part: bytes) -> None:
        self.any |= bool(part)
        self.single.feed(part)
        self.whole.feed(part)

    def close(self) -> Found | None:
        if self.single is not None and not self.broken:
            self.each.append(self.single.close())
        if not self.any:
            return None
        whole = None if self.broken else self.whole.close()
        if whole is not None:
            return whole
        parts = [f for f in self.each if f is not None]
        if not parts:
            return None
        return Found(sum((f.kinds for f in parts), Counter()), hashlib.sha256(b"".join(f.digest for f in parts)).digest())


def _inside(raw: bytes, seen: frozenset) -> Found | None:
    """What the layer ``raw`` holds, layers in it included; None if it is no text."""
    if not raw:
        return None
    if len(raw) <= PIECE and not _packed(raw[:3]):  # mostly: no text, and no need to go on
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return None
        if CONTROL.search(text):
            return None
    name = hashlib.sha256(raw).digest()
    if name in seen:
        return None
    layer = _Layer(seen | {name})
    for low in range(0, len(raw), PIECE):
        layer.feed(raw[low : low + PIECE])
    return layer.close()


def _open(run: str, seen: frozenset) -> Found | None:
    """What a base64 run holds."""
    body = run.rstrip("=").translate(STANDARD)
    if len(body) % 4 == 1:
        return None
    try:
        raw = base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except binascii.Error:
        return None
    return _inside(raw, seen)


def _wrapped(content: str) -> Iterator[list[tuple[int, int]]]:
    """Lines of base64 runs that go on over line ends."""
    at = 0
    while m := FIRST.search(content, at):
        lines, at = [m.span()], m.end()
        while (gap := WRAP.match(content, at)) and (more := RUN.match(content, gap.end())):
            lines.append(more.span())
            at = more.end()
        if len(lines) > 1:
            lines[-1] = (lines[-1][0], PAD.match(content, at).end())
            yield lines


def _joined(content: str, seen: frozenset) -> Iterator[tuple[int, int, Found]]:
    """(start, end, what is inside) of base64 runs wrapped over lines: lines of one length and
    a shorter one at the end, the first may have begun within its line; else all lines."""
    for lines in _wrapped(content):
        size = [e - s for s, e in lines]
        any_opened, first = False, 0
        while first < len(lines) - 1:
            last = first + 1
            while last + 1 < len(lines) and size[last + 1] == size[first + 1]:
                last += 1
            for a in (first, first + 1) if size[first] != size[first + 1] else (first,):
                before: Found | None = None
                for b in sorted({last - 1 if size[last] < size[first] else last, last, min(last + 1, len(lines) - 1)}):
                    if b <= a:
                        before = _open(content[slice(*lines[a])], seen) if b == a else before
                        continue
                    start, end = lines[a][0], lines[b][1]
                    found = _open("".join(content[s:e] for s, e in lines[a : b + 1]), seen)
                    # A word of the next line that adds nothing is no part of the run.
                    if before and re.match(r"[ \t]*\w", content[end : end + 80]) and (found is None or found == before):
                        continue
                    before = found or before
                    if found:
                        any_opened = True
                        yield start, end, found
            first = last
        if not any_opened and (found := _open("".join(content[s:e] for s, e in lines), seen)):
            yield lines[0][0], lines[-1][1], found


class _Probe:
    """Whether bytes that are still coming can be compressed streams."""

    def __init__(self):
        self.streams = _Streams(frozenset())
        self.streams._put = self._seen
        self.any = False

    def _seen(self, part: bytes) -> None:
        self.any |= bool(part)


def _escaped(line: str, seen: frozenset) -> Iterator[tuple[int, int, Found]]:
    """(start, end, what is inside) of compressed streams written with escapes. They are read
    in pieces, each twice the one before, until they end or prove to be none."""
    for start, unit in BYTES:
        last = 0
        for m in start.finditer(line):
            if m.start() < last:
                continue
            raw, ends, probe, at, fed, piece = bytearray(), array("q"), _Probe(), m.start(), 0, 512
            while not probe.streams.ended:
                for u in unit.finditer(line, at):
                    if u.start() != at or len(raw) >= fed + piece:
                        break
                    said = u[u.lastgroup]
                    raw.append(int(said, 16) if u.lastgroup == "byte" else SHORT.get(said, ord(said)) if u.lastgroup == "short" else ord(said))
                    at = u.end()
                    ends.append(at)
                if len(raw) == fed:
                    break
                probe.streams.feed(bytes(raw[fed:]))
                fed, piece = len(raw), 2 * piece
            if not probe.any:
                continue
            taken = probe.streams.taken
            found = _inside(bytes(raw[:taken]), seen)
            if taken and found:
                last = ends[taken - 1]
                yield m.start(), last, found


def _runs(content: str, seen: frozenset) -> Iterator[tuple[int, int, Found]]:
    """(start, end, what is inside) of the base64 runs and escaped streams of ``content``."""
    for m in BASE64.finditer(content):
        if found := _open(m[0], seen):
            yield *m.span(), found
    yield from _joined(content, seen)
    for offset, line in _escape_lines(content):
        for start, end, found in _escaped(line, seen):
            yield offset + start, offset + end, found


def _escape_lines(content: str) -> Iterator[tuple[int, str]]:
    if "%" in content or "\\" in content:
        offset = 0
        for line in content.split("\n"):
            if "%" in line or "\\" in line:
                yield offset, line
            offset += len(line) + 1


def _name(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


def _worklist(text: str, seen: frozenset) -> Iterator[tuple[str, frozenset, Callable[[int, int], tuple[int, int]]]]:
    """``text`` and, level by level, its lines with escapes undone: content, the layers
    around it and itself, and the place of a part of it in ``text``."""
    work = [(text, seen | {_name(text)}, lambda start, end: (start, end))]
    while work:
        content, outer, place = work.pop()
        yield content, outer, place
        for offset, line in _escape_lines(content):
            inner = _unescape(line)
            if inner and (name := _name(inner[0])) not in outer:

                def within(start, end, places=inner[1], offset=offset, place=place):
                    first, last = places(start, end)
                    return place(offset + first, offset + last)

                work.append((inner[0], outer | {name}, within))


def _kinds(text: str, seen: frozenset) -> Counter:
    """How many finds of each kind ``text`` holds, in all its layers."""
    out: Counter = Counter()
    for content, outer, _ in _worklist(text, seen):
        out.update(k for _, _, k in base_spans(content))
        for _, _, found in _runs(content, outer):
            out += found.kinds
    return out


def all_spans(text: str, base: list[Span]) -> list[Span]:
    """The base spans and those found in decoded layers, by start, then kind, then end."""
    out = set(base)
    for content, outer, place in _worklist(text, frozenset()):
        if content is not text:
            out.update((*place(s, e), k) for s, e, k in base_spans(content))
        for start, end, found in _runs(content, outer):
            where = place(start, end)
            out.update((*where, k) for k in found.kinds)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _said(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def _scan(doc_id: int | None, text: str | None) -> tuple:
    base = base_spans(text or "")
    kinds = [k for _, _, k in base]
    counts = [kinds.count(k) for k in KINDS]
    return (doc_id, *counts, _said(base), _said(all_spans(text or "", base)))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base, spans): spans as ``kind:start:end``, comma-joined."""
    arrow = pa.schema([("doc_id", pa.int64()), *[(f"n_{k}", pa.int64()) for k in KINDS], ("base", pa.string()), ("spans", pa.string())])
    schema = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base string, spans string"
    columns = [F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text")]
    return per_row(docs, columns, lambda: _scan, schema, arrow)


def masked(text: str | None) -> str | None:
    """``text`` with every span replaced by a mask; overlapping spans by one."""
    if not text:
        return text
    spans = all_spans(text, base_spans(text))
    if not spans:
        return text
    out, last = [], 0
    for start, end, _ in spans:
        if start >= last:
            out += [text[last:start], MASK]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets masked in ``text`` and, if there, ``n_chars`` brought into line."""

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(masked, na_action="ignore").astype(object)

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        same = F.col("n_chars").isNull()
        out = out.withColumn("n_chars", F.when(~same, F.char_length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
