"""Main text of web pages by tag-path ratios.

A page's text is cut into blocks at block-level tags. Each block has a tag path from
the root to the tag it stands in (class names are part of the path). Per path the
length of text, the punctuation and the share of text in links are added up over all
its blocks; the paths, in page order, are smoothed with their neighbours; length and
punctuation per block are fused by their product; paths at or above the page's
threshold (a share of the mean, so that one long paragraph does not raise it past the
rest) are content. The nearest article or main element around the heaviest content path
bounds the article; without one, its root and those of content paths and of headings with
short unlinked blocks around it. All blocks in it are the result, but for those in
boilerplate tags (menus, headers and footers of the page, sidebars, scripts, ...), in
forms, and in elements named like adverts, notices or comments. A name, or a form, does
not count on html, body, main and article, on what holds one of these or a first heading,
and on an element with most of the page's unlinked text. Inside an article a vague word
that is only a part of a name ("social-history") counts on mostly linked text alone.

Nulls: a null html is an empty page, whose text is empty; page_id and url may be
null. Repeated pages are extracted each; an empty table gives an empty result; other
columns are ignored. Very long pages are read whole, in time and memory in proportion to
their length; tags and quotes that are never closed, or closed without being open, do no harm.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import per_row

# Tags of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
CUTS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
BOILERPLATE = frozenset("nav footer aside button select option input dialog head svg canvas object audio video map menu".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
# Words of class, id and role that name a part beside the article; the second list also
# stands in names of what an article is about ("social-history").
SURE = (
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|popup|modal|comments?|respond|disqus|replies"
    r"|sidebar|navbar|navigation|breadcrumbs?|masthead|pagination|complementary|contentinfo"
)
VAGUE = r"notices?|side|menu|nav|header|footer|social|share|sharing|related|recommend\w*|widget|login|signup|search|copyright|skip"
BESIDE = re.compile(rf"(?:^|[\s_-])(?:{SURE}|{VAGUE})(?=$|[\s_\d-])", re.IGNORECASE)
INSIDE = re.compile(rf"(?:^|[\s_-])(?:{SURE})(?=$|[\s_\d-])|(?:^|\s)(?:{VAGUE})(?=$|\s)", re.IGNORECASE)
READERS = re.compile(r"(?:^|\s)(?:comments?|respond|disqus|replies)(?=$|\s)", re.IGNORECASE)
WHOLE = frozenset("html body main article".split())
NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.IGNORECASE)
START = re.compile(r"<(?:!--|[!?]|(/?)([a-zA-Z][^\s/>]*))")
STOP = re.compile(r"""[>"']""")
PUNCTUATION = re.compile(r"[.,;:!?…。、，！？；：]")
SHARE = 0.35
# A named element with so many times the unlinked text of all the rest is no part beside it.
MOST = 10
SHORT = 100  # characters of a byline, a date, an item


@dataclass
class Element:
    tag: str
    path: int  # of the nearest block element
    block: str  # its tag
    block_at: int  # and its place on the stack
    beside: bool
    link: bool
    inner: bool  # inside article or main
    named: int = -1  # the innermost named element around it


@dataclass
class Text:
    path: int
    tag: str
    beside: bool
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    named: int = -1


class Paths:
    """Tag paths as numbers: a path is its parent and a label. Parents come first."""

    def __init__(self):
        self.parent, self.label, self.depth = [-1], [""], [0]
        self.known: dict[tuple[int, str], int] = {}

    def child(self, parent: int, label: str) -> int:
        number = self.known.setdefault((parent, label), len(self.parent))
        if number == len(self.parent):
            self.parent.append(parent)
            self.label.append(label)
            self.depth.append(self.depth[parent] + 1)
        return number

    def tag(self, path: int) -> str:
        return self.label[path].partition(".")[0]

    def below(self, root: int) -> list[bool]:
        """For each path, whether it is ``root`` or below it."""
        out = [False] * len(self.parent)
        for i, parent in enumerate(self.parent):
            out[i] = i == root or parent >= 0 and out[parent]
        return out


class Names:
    """Elements with a name that tells of a part beside the article, and forms: a tree."""

    def __init__(self):
        self.parent: list[int] = []
        self.readers: list[bool] = []
        self.vague: list[bool] = []
        self.holds: list[bool] = []  # main, article or the first heading

    def add(self, parent: int, readers: bool, vague: bool) -> int:
        self.parent.append(parent)
        self.readers.append(readers)
        self.vague.append(vague)
        self.holds.append(False)
        return len(self.parent) - 1


class Parser:
    """Tags of a page, one after the other; each step costs what it opens and closes."""

    def __init__(self):
        self.paths, self.names = Paths(), Names()
        self.stack = [Element("", 0, "", 0, False, False, False)]
        self.open: dict[str, list[int]] = {}
        self.out: list[Text] = []
        self.now: Text | None = None

    def say(self, raw: str) -> None:
        if not raw:
            return
        text = html.unescape(raw) if "&" in raw else raw
        top = self.stack[-1]
        if self.now is None:
            if not text.strip():
                return
            self.now = Text(top.path, top.block, top.beside, named=top.named)
        self.now.parts.append(text)
        if top.link:
            self.now.linked += len(text)

    def end(self) -> None:
        if self.now is not None:
            self.out.append(self.now)
            self.now = None

    def _cut(self, at: int) -> None:
        for e in self.stack[at:]:
            self.open[e.tag].pop()
        del self.stack[at:]

    def close(self, tag: str) -> None:
        places = self.open.get(tag)
        if places and (tag not in INLINE or places[-1] > self.stack[-1].block_at):
            self._cut(places[-1])

    def begin(self, tag: str, attributes: str) -> None:
        stack = self.stack
        # Open elements that end where this one begins.
        for ends, until in ENDS:
            if tag in ends:
                at = stack[-1].block_at
                while tag == "tr" and stack[at].tag in ("td", "th"):
                    at = stack[at - 1].block_at
                if at and stack[at].tag in until:
                    self._cut(at)
        found = {k.lower(): v.strip("\"'") for k, v in NAMES.findall(attributes)} if attributes else {}
        up = stack[-1]
        beside = up.beside or tag in BOILERPLATE or tag == "header" and not up.inner
        named = up.named
        if tag in WHOLE:
            if named >= 0:
                self.names.holds[named] = True
        elif tag == "form" or any(BESIDE.search(v) for v in found.values()):
            vague = tag != "form" and up.inner and not any(INSIDE.search(v) for v in found.values())
            named = self.names.add(named, any(READERS.search(v) for v in found.values()), vague)
        if tag in INLINE:
            path, block, block_at = up.path, up.block, up.block_at
        else:
            classes = found.get("class", "").split()
            path = self.paths.child(up.path, tag + (f".{classes[0]}" if classes else ""))
            block, block_at = tag, len(stack)
        self.open.setdefault(tag, []).append(len(stack))
        stack.append(Element(tag, path, block, block_at, beside, up.link or tag == "a", up.inner or tag in ("article", "main"), named))


ENDS = ((CUTS_P, ("p",)), (frozenset(["li"]), ("li",)), (frozenset(["dt", "dd"]), ("dt", "dd")), (frozenset(["td", "th"]), ("td", "th")), (frozenset(["tr"]), ("tr",)))


def blocks(page: str) -> tuple[list[Text], Paths]:
    """Blocks of text in page order, white space inside turned into single spaces."""
    parser = Parser()
    unclosed: set[str] = set()  # quotes that do not occur any more
    at = 0
    while True:
        m = START.search(page, at)
        if m is None:
            parser.say(page[at:])
            break
        if not m[2]:
            parser.say(page[at : m.start()])
            mark = "-->" if m[0] == "<!--" else ">"
            close = page.find(mark, m.end())
            at = len(page) if close < 0 else close + len(mark)
            continue
        stop = m.end()
        while (sign := STOP.search(page, stop)) and sign[0] != ">":
            close = -1 if sign[0] in unclosed else page.find(sign[0], sign.end())
            if close < 0:
                unclosed.add(sign[0])  # it stands for itself
            stop = max(close + 1, sign.end())
        if sign is None:
            parser.say(page[at:])
            break
        parser.say(page[at : m.start()])
        attributes, at = page[m.end() : sign.start()], sign.end()
        tag = m[2].lower()
        if tag == "br":
            parser.say(" ")
            continue
        if tag not in INLINE:
            parser.end()
        if m[1]:
            parser.close(tag)
            continue
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = len(page) if end < 0 else end + 1
            continue
        if tag in VOID or attributes.endswith("/") and tag in INLINE:
            continue
        parser.begin(tag, attributes)
    parser.end()
    for block in parser.out:
        block.parts = [" ".join("".join(block.parts).split())]
    out = [b for b in parser.out if b.parts[0]]
    clear = _clear(out, parser.names)
    for block in out:
        block.beside |= block.named >= 0 and not clear[block.named]
    return out, parser.paths


def _clear(found: list[Text], names: Names) -> list[bool]:
    """Whether a named element, and all named ones around it, are part of the article, by
    their text and links."""
    n = len(names.parent)
    own, plain, linked, holds = [0] * n, [0] * n, [0] * n, list(names.holds)
    rest = 0  # unlinked text in no named element that is beside
    for block in found:
        if block.beside:
            continue
        text = max(len(block.parts[0]) - block.linked, 0)
        if block.named < 0:
            rest += text
            continue
        own[block.named] += text
        linked[block.named] += block.linked
        if block.tag == "h1" and text > block.linked:
            holds[block.named] = True
    plain = list(own)
    inner: list[list[int]] = [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if (up := names.parent[i]) >= 0:
            plain[up] += plain[i]
            linked[up] += linked[i]
            holds[up] |= holds[i]
            inner[up].append(i)
    released, clear = [False] * n, [False] * n

    def release(i: int) -> int:
        released[i] = True
        gained, work = 0, [i] if names.parent[i] < 0 or clear[names.parent[i]] else []
        while work:
            one = work.pop()
            clear[one] = True
            gained += own[one]
            work += [c for c in inner[one] if released[c]]
        return gained

    for i in range(n):
        if holds[i] and not names.readers[i]:
            rest += release(i)
    for i in sorted((i for i in range(n) if not released[i]), key=lambda i: (names.readers[i], -plain[i], i)):
        if plain[i] > linked[i] and (names.vague[i] or (not rest if names.readers[i] else plain[i] >= MOST * rest)):
            rest += release(i)
    return clear


def path_sums(found: list[Text]) -> dict[int, list[float]]:
    """Per path, in page order: length, punctuation and linked text of its blocks, and their number."""
    paths: dict[int, list[float]] = {}
    for block in found:
        text = block.parts[0]
        row = paths.setdefault(block.path, [0.0, 0.0, 0.0, 0.0])
        row[0] += len(text)
        row[1] += len(PUNCTUATION.findall(text))
        row[2] += block.linked
        row[3] += 1
    return paths


def content_root(found: list[Text], paths: Paths, share: float = SHARE) -> int | None:
    """Path of the element that holds the article."""
    sums = path_sums(found)
    if not sums:
        return None
    numbers = list(sums)
    length = [max(v[0] - v[2], 0.0) / v[3] for v in sums.values()]
    points = [v[1] / v[3] for v in sums.values()]

    def smooth(values: list[float]) -> list[float]:
        padded = [values[0], *values, values[-1]]
        return [(padded[i] + 2 * padded[i + 1] + padded[i + 2]) / 4 for i in range(len(values))]

    fused = [a * (1 + b) for a, b in zip(smooth(length), smooth(points))]
    line = share * sum(fused) / len(fused)
    content = {p for p, score in zip(numbers, fused) if score >= line}
    weight = {p: max(v[0] - v[2], 0.0) * (1 + v[1] / v[3]) for p, v in sums.items()}
    heaviest = max([p for p in numbers if p in content] or numbers, key=lambda p: weight[p])
    chain = [heaviest]
    while paths.depth[chain[-1]] > 1:
        chain.append(paths.parent[chain[-1]])
    for path in chain:
        if paths.tag(path) in ("article", "main"):
            return path
    # Where the way up from each path meets that from the heaviest.
    place = {p: i for i, p in enumerate(chain)}
    meets = [len(chain)] * len(paths.parent)
    for i, parent in enumerate(paths.parent):
        meets[i] = place.get(i, meets[parent] if parent >= 0 else len(chain))
    joining: dict[int, list[int]] = {}
    for p in numbers:
        joining.setdefault(meets[p], []).append(p)
    root = chain[min(1, len(chain) - 1)]
    # Upwards, as long as all that is new is content, headings or, around a heading and
    # below the body, short unlinked text.
    tags = {b.path: b.tag for b in found}
    short, heading = False, False
    for at in range(min(1, len(chain) - 1) + 1, len(chain)):
        above, new = chain[at], joining.get(at, [])
        heading |= any(tags[p] in HEADING for p in new)
        odd = [p for p in new if p not in content and tags[p] not in HEADING]
        inside = paths.tag(above) not in ("html", "body")
        if any(not inside or sums[p][0] > SHORT * sums[p][3] or 2 * sums[p][2] > sums[p][0] for p in odd):
            break
        short = short or bool(odd)
        if not short or heading:
            root, short = above, False
    return root


def extract(page: str | None) -> str:
    """Main text of a page: blocks joined by an empty line."""
    all_, paths = blocks(page or "")
    found = [b for b in all_ if not b.beside]
    root = content_root(found, paths)
    if root is None:
        return ""
    inside = paths.below(root)
    return "\n\n".join(b.parts[0] for b in found if inside[b.path])


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars), one row per row."""

    def row(page_id, url, page):
        text = extract(page)
        return page_id, url, text, len(text)

    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    columns = [F.col("page_id").cast("bigint").alias("page_id"), "url", "html"]
    return per_row(pages, columns, lambda: row, "page_id bigint, url string, text string, n_chars bigint", arrow)
