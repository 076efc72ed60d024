"""Operators that look at one text at a time, against plain loops."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import html_paths, language_id, quality_rules, secret_scan, toxicity


def rows(df, *keys):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- quality rules


def measures(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, t in enumerate(zip(w, w[1:], w[2:])) if seen[t] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(covered), len(set(w)))


TEXTS = ["a b c a b c", "x\ny\nx\n\n \n", "a a a a", "a b", "# $ x|y <z>", "the cat sat. the cat sat on the cat sat", "ñ\x1cé 日本 a\x0bb"]


def test_ledger_measures(spark, edges):
    docs = edges.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(TEXTS, 100)), "doc_id bigint, text string"))
    got = quality_rules.measured(docs).select("doc_id", *quality_rules.MEASURES)
    want = [(r["doc_id"], *measures(r["text"])) for r in docs.collect()]
    assert rows(got) == sorted(want, key=repr)


def test_policies_and_ablations(edges):
    ledger = quality_rules.ledger(edges)
    found = ledger.collect()
    for version, names in quality_rules.POLICIES.items():
        mask = quality_rules.bits(names)
        kept = quality_rules.apply_policy(ledger, version).filter("kept").count()
        assert kept == sum(not r["fail_bits"] & mask for r in found)
        got = {r["rule"]: r for r in quality_rules.ablations(ledger, version).collect()}
        assert set(got) == set(names)
        for name in names:
            bit = quality_rules.bits((name,))
            assert got[name]["n_failed"] == sum(bool(r["fail_bits"] & bit) for r in found)
            assert got[name]["n_failed_alone"] == sum(r["fail_bits"] & mask == bit for r in found)
            assert got[name]["n_kept_without"] == sum(not r["fail_bits"] & mask & ~bit for r in found)
    assert quality_rules.ledger(edges.limit(0)).count() == 0


def test_ledger_is_native(edges):
    plan = quality_rules.ledger(edges)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


# --- language ID


def test_language_vectors_equal_plain_bundling():
    space = language_id.Space(256, 3, 7)
    text = "Ñandú, the the cat!"
    clean = re.sub(r"[^a-zñú]+", " ", f" {text.lower()} ")
    want = np.zeros(256, np.int64)
    for a, b, c in zip(clean, clean[1:], clean[2:]):
        want += (np.roll(space.letter(ord(a)), 2) * np.roll(space.letter(ord(b)), 1) * space.letter(ord(c))).astype(np.int64)
    assert (space.bundle(space.grams(text)) == want).all()
    assert (language_id.Space(256, 3, 7).bundle(space.grams(text)) == want).all()


def test_prototypes_do_not_depend_on_layout(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a = language_id.profile(language_id.prototypes(docs.repartition(1)))
    b = language_id.profile(language_id.prototypes(docs.repartition(7)))
    assert a[0] == b[0] == ["de", "en", "es", "fr"] and (a[1] == b[1]).all()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs, *language_id.learn(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    share = found.filter(language_id.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert share >= 0.97


def test_language_edges(spark, edges):
    empty = edges.limit(0)
    assert language_id.learn(empty)[0] == []
    model = language_id.learn(edges)
    assert model[0] == ["en", "es"]
    got = language_id.identify(edges, *model).collect()
    assert len(got) == edges.count()
    by_text = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert all((r["lang_pred"], r["score"]) == ("und", 0.0) for r in by_text)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.identify(edges, *language_id.learn(empty)).filter("lang_pred <> 'und'").count() == 0
    kept = language_id.accepted(edges, *model)
    assert kept.columns == edges.columns
    assert {r["doc_id"] for r in kept.select("doc_id").collect()} == {None, 4, 5, 6, 7}
    odd = spark.createDataFrame([(1, "жщ " * 200), (2, "the cat"), (3, "...")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in language_id.accepted(odd, *model).collect()] == [2]


# --- HTML


PAGE = """<html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><p>Site name, a long line of the header, with commas, and more words, to be long.</p></header>
<nav><ul><li><a href="/a">Menu one</a><li><a href="/b">Menu two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, as everybody does, on this page, and you may accept or reject them.</p></div>
<div id="content"><h1>Head&shy;line &amp; more</h1>
<p>First <b>bold</b> paragraph, of some length,
  with &lt;tags&gt; &#8212; and a reference. It goes on for a while, as paragraphs do.
<p>Second paragraph, never closed, and with a <a href="/x">link</a> in it. It goes on for a while, too.
<p>Short.</p>
<div class="ad">Buy this, buy that, and buy more, today, as long as stocks last, in every shop.</div>
<script>var x = "<p>not text</p>";</script>
<ul><li>One point, made in a sentence, that is long enough.</li><li>Two points, made in a sentence, that is long.</li></ul>
<form><p>Name, please:</p><input></form></div>
<aside><p>Related: something else, which is long as well, and full of commas, really.</p></aside>
<section id="comments"><p>I do not agree, said a reader, at great length, and with many commas, as they do.</p></section>
<footer><p>Copyright, imprint, and a long text about the rights of all, reserved, as ever.</p></footer></body></html>"""


def test_extracts_article_only():
    assert html_paths.extract(PAGE) == "\n\n".join([
        "Head\xadline & more", "First bold paragraph, of some length, with <tags> — and a reference. It goes on for a while, as paragraphs do.",
        "Second paragraph, never closed, and with a link in it. It goes on for a while, too.", "Short.",
        "One point, made in a sentence, that is long enough.", "Two points, made in a sentence, that is long.",
    ])


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("no tags at all", "no tags at all"), ("<p>a<p>b", "a\n\nb"), ("</p></div>x", "x"), ("<script>var a;", ""),
    ("<!-- open", ""), ("<article><h1>T</h1><p>w</p></article><footer>f</footer>", "T\n\nw"), ("<div>" * 3000 + "deep", "deep"), ("a < b", "a < b"),
    ("<p>x<br>y&nbsp;z</p>", "x y z"),
])
def test_html_edges(page, text):
    assert html_paths.extract(page) == text


BODY = "".join(f"<p>Paragraph {w}, of some length, goes on for a while, as paragraphs do, and ends here.</p>" for w in ("one", "two", "three"))
SAID = re.sub("<p>", "", BODY).replace("</p>", "\n\n").strip()
ASIDE = '<div class="sidebar"><ul><li><a href="/a">Other things</a></li><li><a href="/b">More</a></li></ul></div>'
NOTICE = '<div class="cookie-notice"><p>We use cookies, as everybody does, on this page, and you may accept or reject them.</p></div>'


@pytest.mark.parametrize("page, text", [
    (f"<html class='has-menu'><body class='page right-sidebar'><h1>Head</h1>{BODY}{ASIDE}</body></html>", f"Head\n\n{SAID}"),
    (f"<body>{NOTICE}<div class='content has-sidebar'>{BODY}{ASIDE}</div></body>", SAID),
    (f"<body><div class='wrap no-sidebar'><div class='content has-sidebar'><h1>Head</h1>{BODY}</div>{ASIDE}</div></body>", f"Head\n\n{SAID}"),
    (f"<body><article class='post no-sidebar'><header class='entry-header'><h1>Head</h1></header>{BODY}{NOTICE}</article></body>", f"Head\n\n{SAID}"),
    (f"<body><main class='with-comments'>{BODY}<section id='comments'>{BODY * 9}</section></main></body>", SAID),
    (f"<body><article><h1>Head</h1><p class='by'>By A</p><p class='date'>1 May</p><div class='body'>{BODY}</div><ul><li>Point</li></ul></article></body>", f"Head\n\nBy A\n\n1 May\n\n{SAID}\n\nPoint"),
    (f"<body><div class='post'><h1>Head</h1><p class='by'>By A</p><p class='date'>1 May</p><div class='body'>{BODY}</div><ul><li>Point</li></ul></div><div>Imprint</div></body>", f"Head\n\nBy A\n\n1 May\n\n{SAID}\n\nPoint"),
    (f"<body>{NOTICE}<div class='ad'><p>Buy.</p></div><div>{BODY}</div></body>", SAID),
])
def test_names_and_short_blocks_do_not_lose_text(page, text):
    assert html_paths.extract(page) == text


def peak(function):
    """Seconds, and MB of Python objects at the highest point."""
    import time
    import tracemalloc

    tracemalloc.start()
    begin = time.perf_counter()
    out = function()
    seconds, (_, most) = time.perf_counter() - begin, tracemalloc.get_traced_memory()
    tracemalloc.stop()
    return out, seconds, most / 1e6


@pytest.mark.parametrize("page", [
    f"<html><body><form action='/post'><div><h2>Titel</h2>{BODY}</div><input name=q><select><option>x</option></select></form></body></html>",
    f"<body><form id=aspnet><div class=head><a href=/>Home</a><a href=/b>B</a></div><div class=text>{BODY}</div></form></body>",
])
def test_a_page_inside_a_form(page):
    assert SAID in html_paths.extract(page)


@pytest.mark.parametrize("name, kept", [
    ("social-history", True), ("share-price-table", True), ("header-notes", True), ("related-work", True), ("social", False), ("ad-slot", False), ("newsletter-box", False),
])
def test_names_inside_the_article(name, kept):
    page = f"<body><article><h1>T</h1>{BODY}<div class='{name}'><p>Words of this very part.</p></div>{BODY}</article></body>"
    assert ("Words of this very part." in html_paths.extract(page)) == kept
    links = f"<body><article><h1>T</h1>{BODY}<div class='{name}'><a href=/x>Words of this very part.</a></div></article></body>"
    assert "very part" not in html_paths.extract(links)


@pytest.mark.parametrize("page", [
    "<div>x " * 100_000, "<b>x " * 100_000, "<p>a <b>b " * 50_000, "<div class='ad box'>x " * 100_000, "<a href=\"x> y " * 50_000, "<a title='x\">y " * 50_000,
    "<i><div>" + "<b>" * 50_000 + "</i>" * 50_000, "</x>" * 100_000, "<td>x<tr>" * 50_000, "<table>" + "<td>x" * 50_000 + "<tr>" * 10, "<script>" + "</script " * 50_000,
    "<!-- " * 50_000, "< " * 100_000, "<div" * 50_000, "<ul><li>x" * 50_000, "&amp;" * 200_000, "<form><div>x" * 50_000,
])
def test_pages_of_any_shape_take_time_in_proportion(page):
    got, seconds, most = peak(lambda: html_paths.extract(page))
    assert seconds < 15 and most < 400, (seconds, most)  # with memory tracing, which slows the run several times


def test_path_sums_equal_a_plain_parser():
    """Length, punctuation and links of every tag path, against paths written out as text."""
    from html.parser import HTMLParser

    class Plain(HTMLParser):
        def __init__(self):
            super().__init__()
            self.stack, self.sums = [], {}

        def handle_starttag(self, tag, attrs):
            self.stack.append(tag + "".join(f".{v.split()[0]}" for k, v in attrs if k == "class"))

        def handle_endtag(self, tag):
            self.stack.pop()

        def handle_data(self, data):
            if data.strip():
                block = [t for t in self.stack if t.split(".")[0] not in html_paths.INLINE]
                row = self.sums.setdefault("/" + "/".join(block), [0, 0, 0])
                text = " ".join(data.split())
                row[0] += len(text)
                row[1] += sum(c in ".,;:!?" for c in text)
                row[2] += len(text) if any(t.startswith("a") and t.split(".")[0] == "a" for t in self.stack) else 0

    rng = random.Random(3)
    for _ in range(40):
        def tree(depth):
            if not depth or rng.random() < 0.2:
                text = " ".join(rng.choice(["word", "and,", "end.", "x!"]) for _ in range(rng.randint(1, 9)))
                return f"<a href=#>{text}</a>" if rng.random() < 0.3 else text
            tag = rng.choice(["div", "section", "ul", "div class='c1 c2'"])
            return "".join(f"<{tag}><p>{tree(0)}</p>{tree(depth - 1)}</{tag.split()[0]}>" for _ in range(rng.randint(1, 3)))

        page = f"<html><body>{''.join('<div>' + tree(3) + '</div>' for _ in range(3))}</body></html>"
        plain = Plain()
        plain.feed(page)
        found, paths = html_paths.blocks(page)

        def name(p):
            return f"{name(paths.parent[p])}/{paths.label[p]}" if paths.parent[p] >= 0 else ""

        got = {name(p): [int(v) for v in row[:3]] for p, row in html_paths.path_sums(found).items()}
        assert got == plain.sums


def test_pages_of_the_table(spark, sf):
    import html

    for r in html_paths.extract_pages(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        article = r["html"].split("<article>")[1].split("</article>")[0].replace("<br>", " ")
        parts = [" ".join(html.unescape(re.sub("<[^>]*>", "", p)).split()) for p in re.split("</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(p for p in parts if p) and r["n_chars"] == len(r["text"])


def test_html_table_edges(spark):
    pages = spark.createDataFrame([(None, None, None, 1), (1, "u", "<p>x</p>", 2), (1, "u", "<p>x</p>", 2)], "page_id bigint, url string, html string, text int")
    assert rows(html_paths.extract_pages(pages)) == [(1, "u", "x", 1), (1, "u", "x", 1), (None, None, "", 0)]
    assert html_paths.extract_pages(pages.limit(0)).count() == 0


# --- secrets


def base_loop(text):
    out = []
    for kind, pattern, least in (("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12), ("access", "(AKIA[A-Z0-9]+)", 18), ("hex", "([0-9a-f]+)", 16)):
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text) if len(m[1]) >= least]
    return out


SECRET = "password: hunter2hunter2"
B64 = base64.b64encode(SECRET.encode()).decode()
PACKED = base64.b64encode(zlib.compress(gzip.compress(SECRET.encode()))).decode()
NESTED = base64.b64encode(f"see {B64} there".encode()).decode()
URL = "api%5Fkey%3Dabcdefghijkl"
TWICE = URL.replace("%", "%25")
UNICODE = r"token=ABCDEFGHIJKLMN"


@pytest.mark.parametrize("layer", [B64, PACKED, NESTED, URL, TWICE, UNICODE])
def test_layers_are_unwrapped_and_mapped(layer):
    text = f"ñ before {layer} after\nand {layer} again"
    spans = secret_scan.all_spans(text, secret_scan.base_spans(text))
    found = [text[s:e] for s, e, k in spans if k == "assign"]
    assert found == [layer, layer]
    assert secret_scan.masked(text) == "ñ before [REDACTED] after\nand [REDACTED] again"


def wrapped(raw, width, line="\n"):
    run = base64.b64encode(raw).decode()
    return line.join(run[i : i + width] for i in range(0, len(run), width))


FILLER = " ".join(hashlib.sha1(str(i).encode()).hexdigest()[:7] for i in range(40))
WHOLE = f"{FILLER}\n{SECRET}\n{FILLER}"


@pytest.mark.parametrize("layer", [
    *(wrapped(raw, width, line) for raw in (WHOLE.encode(), gzip.compress(WHOLE.encode()), zlib.compress(WHOLE.encode())) for width, line in ((64, "\n"), (76, "\r\n"), (64, "\n  "), (76, r"\n"))),
    wrapped((FILLER[:40] + " " + SECRET + " " + FILLER[:30]).encode(), 64),
])
def test_wrapped_base64_is_opened_whole(layer):
    for text in (f"ñ before {layer}", f"ñ\n{layer}\nand more words here", f"key: {layer[:20]}{layer[20:]}\n\nmore"):
        spans = secret_scan.all_spans(text, secret_scan.base_spans(text))
        assert layer in [text[s:e].rstrip() for s, e, k in spans if k == "assign"]
        assert secret_scan.masked(text) == text.replace(layer, "[REDACTED]")


@pytest.mark.parametrize("raw", [
    gzip.compress(b"first member") + gzip.compress(SECRET.encode()),
    gzip.compress(SECRET[:14].encode()) + b"\0" * 5 + gzip.compress(SECRET[14:].encode()),
    zlib.compress(gzip.compress(b"a, ") + gzip.compress(b"b, ") + gzip.compress(SECRET.encode())),
    gzip.compress(bytes(range(256))) + gzip.compress(SECRET.encode()),
    gzip.compress(gzip.compress(b"one")) + gzip.compress(gzip.compress(SECRET.encode())),
])
def test_all_members_are_read(raw):
    layer = base64.b64encode(raw).decode()
    text = f"ñ before {layer} after"
    assert secret_scan.masked(text) == "ñ before [REDACTED] after"


@pytest.mark.parametrize("text, want", [
    ("a %E9%70%61%73%73%77%6F%72%64%3Dabcdefghijkl b", "a %E9[REDACTED] b"),
    (r"a \xff\x70\x61\x73\x73word=abcdefghijkl\xfe b", r"a \xff[REDACTED]\xfe b"),
    (r"a \ud800\u0070\u0061ssword=abcdefghijkl b", r"a \ud800[REDACTED] b"),
])
def test_valid_part_of_an_escape_run(text, want):
    assert secret_scan.masked(text) == want


@pytest.mark.parametrize("pack", [gzip.compress, zlib.compress, lambda b: zlib.compress(b, 1), lambda b: zlib.compress(b, 9), lambda b: gzip.compress(b"x") + gzip.compress(b)])
def test_escaped_compressed_bytes(pack):
    import json
    from urllib.parse import quote

    raw = pack(SECRET.encode())
    for layer in ("".join(f"%{b:02x}" for b in raw), quote(raw), "".join(f"\\x{b:02x}" for b in raw), repr(raw)[2:-1], json.dumps(raw.decode("latin-1"))[1:-1]):
        got = secret_scan.masked(f"ñ 'before' {layer} after")
        assert got.startswith("ñ 'before' [REDACTED]") and got.endswith(" after") and len(got) < 60, layer


def test_base_spans():
    for text in ["token=short secret = 'longenough12'", "AKIA1 AKIAABCDEFGHIJ1234 AKIAAKIAAKIAAKIA", "deadbeefdeadbeef beef", "PassWord:\"aaaaaaaaaaaa\"", "ſecret=aaaaaaaaaaaa", "toKen=aaaaaaaaaaaa", "token=abc password=abcdefghijklm", "token:token=abcdefghijklmn"]:
        assert sorted(secret_scan.base_spans(text)) == sorted(base_loop(text)), text


def test_secrets_on_table(spark, sf, edges):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(edges.select("doc_id", "text"))
    want = []
    for r in docs.collect():
        spans = sorted(base_loop(r["text"] or ""), key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))
        want.append((r["doc_id"], *[sum(k == n for *_, k in spans) for n in ("assign", "access", "hex")], ",".join(f"{k}:{s}:{e}" for s, e, k in spans)))
    assert rows(secret_scan.scan(docs).drop("spans")) == sorted(want, key=repr)
    clean = secret_scan.redact(edges)
    assert clean.columns == edges.columns and rows(clean.drop("n_chars")) == rows(edges.drop("n_chars"))
    assert secret_scan.scan(edges.limit(0)).count() == 0
    left = secret_scan.scan(secret_scan.redact(docs.withColumn("n_chars", F.length("text"))))
    assert left.agg(F.sum(F.col("n_assign") + F.col("n_access") + F.col("n_hex"))).first()[0] == 0


# --- toxicity


def test_toxicity_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    chain = toxicity.train(docs, labels.filter("doc_id % 3 <> 0"), {"low_quality": "quality = 0", "toxic": "toxic = 1"})
    assert [len(m.weights) for m in chain.models] == [len(chain.vocabulary) + 3, len(chain.vocabulary) + 4]
    held = toxicity.predict(docs, chain).join(labels.withColumnRenamed("toxic", "is"), "doc_id").filter("doc_id % 3 = 0").collect()
    right = sum((r["is"] == 1) == r["toxic"] for r in held)
    # About 30 toxic texts to learn from here.
    assert right >= 0.92 * len(held) and sum(r["toxic"] for r in held if not r["is"]) <= 3


def test_chain_gets_out_of_fold_probabilities():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 4)).astype(np.float32)
    y = np.column_stack([x[:, 0] > 0, x[:, 0] + x[:, 1] > 0])
    fold = np.arange(300) % 3
    first, second = toxicity.fit_chain(x, y, fold)
    unseen = np.zeros(300, np.float32)
    for f in range(3):
        unseen[fold == f] = toxicity.fit(x[fold != f], y[fold != f, 0].astype(np.float32)).probability(x[fold == f])
    again = toxicity.fit(np.column_stack([x, unseen]), y[:, 1].astype(np.float32))
    assert np.allclose(second.weights, again.weights) and len(first.weights) == 4


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(4, 1, 0), (5, 1, 1), (6, 0, None), (None, 1, 1), (99, 1, 1), (5, 1, 1)], "doc_id bigint, quality int, toxic int")
    for some in (labels, labels.limit(0)):
        chain = toxicity.train(edges, some, {"toxic": "toxic = 1"})
        got = toxicity.predict(edges, chain)
        assert got.columns == ["doc_id", "p_toxic", "toxic"] and got.count() == edges.count()
    assert toxicity.predict(edges, chain).filter("toxic").count() == 0
    assert toxicity.predict(edges.limit(0), chain).count() == 0


def test_sha_of_no_span_is_that_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_long_runs_and_lines_take_time_and_memory_in_proportion():
    rng = random.Random(4)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    run = "".join(rng.choices(letters, k=1_000_000))
    for text in (f"data:image/png;base64,{run} end {B64}", f"{run[:500_000]}\n{run[500_000:]}\n{B64}", "\n".join(run[i : i + 76] for i in range(0, 999_932, 76)) + f"\n\n{B64}"):
        got, seconds, most = peak(lambda: secret_scan.masked(text))
        assert got.endswith("[REDACTED]") and seconds < 20 and most < 60, (seconds, most)
    line = "word " * 2_000_000 + f"%41 {URL} " + "word " * 10
    got, seconds, most = peak(lambda: secret_scan.masked(line))
    assert got == "word " * 2_000_000 + "%41 [REDACTED] " + "word " * 10
    assert seconds < 30 and most < 250, (seconds, most)


def test_gzip_with_a_long_header_and_bombs():
    import struct

    body = gzip.compress(SECRET.encode())
    raw = body[:3] + b"\x04" + body[4:10] + struct.pack("<H", 600) + b"\x01" * 600 + body[10:]
    assert gzip.decompress(raw) == SECRET.encode()
    for layer in ("".join(f"%{b:02x}" for b in raw), base64.b64encode(raw).decode()):
        assert secret_scan.masked(f"a {layer} b") == "a [REDACTED] b"
    # Far more than a window behind the layer's begin, and behind a line of binary zeros nothing counts.
    large = gzip.compress(b"some words of a line\n" * 2_000_000 + SECRET.encode())
    got, seconds, most = peak(lambda: secret_scan.masked("x " + base64.b64encode(large).decode()))
    assert got == "x [REDACTED]" and seconds < 60 and most < 120, (seconds, most)
    bomb = base64.b64encode(gzip.compress(b"\0" * 200_000_000 + SECRET.encode(), 9)).decode()
    got, seconds, most = peak(lambda: secret_scan.masked(bomb))
    assert got == bomb and most < 60, (seconds, most)


@pytest.mark.parametrize("text", ["a%20b%20c", "%E2%82%AC x %41%42", "\\u00e9\\u0041 z", "plain", "%25%32%35", "x%F0%9F%98%80y%41", r"😀 \xc3\xa9"])
def test_places_of_unescaped_characters(text):
    inner = secret_scan._unescape(text)
    if inner is None:
        assert text == "plain"
        return
    said, places = inner
    for i in range(len(said)):
        start, end = places(i, i + 1)
        piece = text[start:end]
        again = secret_scan._unescape(piece)
        assert piece == said[i] or again is not None and again[0] == said[i]
    assert places(0, len(said)) == (0, len(text))
