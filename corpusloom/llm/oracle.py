"""DuckDB forms of the registered queries, where SQL can express them."""

from __future__ import annotations

OP1 = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
        row_number() OVER () AS r
    FROM documents
), windows AS (
    SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
    FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
), twins AS (
    SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM windows) WHERE n > 1
), covered AS (
    SELECT r, count(DISTINCT i + step) AS n FROM twins, (SELECT unnest([0, 1, 2]) AS step) GROUP BY r
), lines AS (
    SELECT r, [x for x in string_split(t, chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] AS l FROM d
), measured AS (
    SELECT d.doc_id, len(w)::BIGINT AS n_words,
        length(array_to_string(w, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(l)::BIGINT AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
        len(list_distinct(w))::BIGINT AS n_distinct_words
    FROM d JOIN lines USING (r) LEFT JOIN covered USING (r)
), bits AS (
    SELECT *, (
        CASE WHEN n_words < 50 THEN 1 ELSE 0 END
        + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
        + CASE WHEN n_words > 0 AND 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
        + CASE WHEN word_chars < 2 * n_words THEN 8 ELSE 0 END
        + CASE WHEN word_chars > 15 * n_words THEN 16 ELSE 0 END
        + CASE WHEN n_lines >= 4 AND 10 * n_dup_lines > 3 * n_lines THEN 32 ELSE 0 END
        + CASE WHEN 10 * n_distinct_words < n_words AND n_words >= 200 THEN 64 ELSE 0 END
    )::BIGINT AS fail_bits
    FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits,
    fail_bits & 3 <> 0 AS base_failed, fail_bits & 63 = 0 AS kept
FROM bits
"""

OP4 = r"""
WITH d AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
        substr(md5('17|' || coalesce(doc_id::VARCHAR, '?') || '|' || coalesce(text, '')), 1, 12) AS h
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS source_size,
        ([3, 1, 2])[(row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight
    FROM d GROUP BY source
), ordered AS (
    -- sources in the order in which a rising level reaches their clamps
    SELECT *, sum(2 * source_size) OVER o AS caps, sum(weight) OVER o AS weights,
        sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weights
    FROM s
    WINDOW o AS (ORDER BY source_size::DOUBLE / weight, encode(source) NULLS LAST ROWS UNBOUNDED PRECEDING)
), levels AS (
    -- the level if this source is the last that is clamped
    SELECT *, caps - 2 * source_size AS caps_before, weights - weight AS weights_before FROM ordered
), clamped AS (
    SELECT *, 2 * (2 * source_size)::HUGEINT * (all_weights - weights_before) < weight * (3 * total - 2 * caps_before) AS is_clamped
    FROM levels
), level AS (
    SELECT (3 * any_value(total) - 2 * coalesce(sum(2 * source_size) FILTER (is_clamped), 0))::DOUBLE
        / (2 * sum(weight) FILTER (NOT is_clamped))::DOUBLE AS v
    FROM clamped
), aimed AS (
    SELECT source, source_size, CASE WHEN is_clamped THEN (2 * source_size)::DOUBLE ELSE weight * v END AS target
    FROM clamped, level
), needs AS (
    SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM aimed
), summed AS (
    SELECT d.doc_id, d.size, n.source_size, n.target, n.whole, n.target - n.whole * n.source_size AS need,
        sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.size ROWS UNBOUNDED PRECEDING) AS upto, d.size AS own
    FROM d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source
)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN need > 0 AND upto - own < need AND upto - own + own / 2 <= need THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""

OP10 = r"""
WITH x AS (
    SELECT vec_id AS id, [floor(256 * c::DOUBLE)::BIGINT for c in embedding] AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len([c for c in embedding if c IS NULL OR NOT isfinite(c)]) = 0
), pairs AS (
    SELECT q.id AS query_id, c.id AS vec_id, list_sum([p[1] * p[2] for p in list_zip(q.v, c.v)])::BIGINT AS score
    FROM x q, x c WHERE q.id % 50 = 0 AND c.id <> q.id
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM pairs QUALIFY rank <= 5
"""

OP11 = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) END AS s FROM d
), shingles AS (
    SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), links AS (
    SELECT a.doc_id AS a, b.doc_id AS b
    FROM shingles a JOIN shingles b ON a.x = b.x AND a.doc_id <> b.doc_id AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))
), reached AS (
    SELECT a AS x, b AS y FROM links
    UNION
    SELECT r.x, l.b FROM reached r JOIN links l ON r.y = l.a
), least_of AS (
    SELECT x, min(y) AS y FROM reached GROUP BY x
)
SELECT doc_id, len(s)::BIGINT AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM sets LEFT JOIN least_of ON x = doc_id
"""

OP12 = r"""
WITH d AS (
    SELECT doc_id, row_number() OVER () AS r,
        regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), asked AS (
    SELECT DISTINCT item_id,
        unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), counted AS (
    SELECT r, doc_id, len(terms) AS n, term, count(*) AS tf
    FROM (SELECT r, doc_id, terms, unnest(terms) AS term FROM d) GROUP BY ALL
), corpus AS (
    SELECT count(*)::BIGINT AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0
), weights AS (
    SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, corpus GROUP BY term, docs
), scored AS (
    SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term), corpus GROUP BY item_id, r, doc_id
)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST))::INT AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""

# Cheapest edits that lead to each state of the sound form, row by row. A state is a
# struct of cost, audit and repaired text, or null if it cannot be reached; structs
# compare by cost, then by audit.

def _edit(state: str, cost: str, letter: str, line: str) -> str:
    text = "''" if not line else f"CASE WHEN {state}.t IS NULL THEN {line} ELSE {state}.t || chr(10) || {line} END"
    text = f"{state}.t" if not line else text
    return f"CASE WHEN {state} IS NOT NULL THEN {{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}} END"


def _op13() -> str:
    states = ("z", "s", "u", "a")

    def closed(columns: dict[str, str]) -> dict[str, str]:
        """States after any insertions: user after z, s and a, assistant after u; twice, as more never pays."""
        for _ in range(2):
            insert = {"u": [_edit(x, "5", "I", "'user:'") for x in ("z", "s", "a")], "a": [_edit("u", "5", "I", "'assistant:'")]}
            columns = {x: f"list_min([{', '.join([x, *insert.get(x, [])])}])" for x in states}
            yield columns

    def level(columns: dict[str, str], source: str, more: str) -> str:
        return f"SELECT {more}, {', '.join(f'{v} AS {k}' for k, v in columns.items())} FROM ({source})"

    keep = {"z": [], "s": [("z", "s")], "u": [("z", "u"), ("s", "u"), ("a", "u")], "a": [("u", "a")]}
    rerole = {"u": ("z", "s", "a"), "a": ("u",)}
    names = {"u": "user", "a": "assistant"}
    step = {}
    for x in states:
        ways = [_edit(x, "2", "D", "")]
        for before, initial in keep[x]:
            ways.append(f"CASE WHEN NOT must_go AND role[1] = '{initial}' THEN {_edit(before, '5 * late', 'K', line='role || chr(58) || text')} END")
        for before in rerole.get(x, ()):
            ways.append(f"CASE WHEN NOT must_go THEN {_edit(before, '1 + 5 * late', 'R', line=f'{chr(39)}{names[x]}:{chr(39)} || text')} END")
        step[x] = f"list_min([{', '.join(ways)}])"
    one, two = closed({})
    start = "SELECT conv, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': NULL::VARCHAR} AS z, " + ", ".join(
        f"NULL::STRUCT(c BIGINT, a VARCHAR, t VARCHAR) AS {x}" for x in states[1:]) + " FROM convs"
    first = level(two, level(one, start, "conv, i"), "conv, i")
    moved = f"SELECT p.conv, p.i + 1 AS i, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM parsed p JOIN numbered n ON n.conv = p.conv AND n.i = p.i + 1"
    onward = level(two, level(one, moved, "conv, i"), "conv, i")
    return rf"""
WITH RECURSIVE table_(b, k, v) AS (
    SELECT b, 0, b FROM (SELECT unnest(range(256))::BIGINT AS b)
    UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM table_ WHERE k < 8
), crc AS (
    SELECT list(v ORDER BY b) AS t FROM table_ WHERE k = 8
), fated AS (
    SELECT conv_id AS id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT for x in string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '')]),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
    FROM conversations, crc
), convs AS (
    SELECT id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id AS id FROM conversations)
), damaged AS (
    SELECT conv, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fate = 3 THEN 2 ELSE 1 END)) AS copy
    FROM fated JOIN convs ON convs.id IS NOT DISTINCT FROM fated.id WHERE fate <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, encode(role), md5(text), copy) AS i FROM damaged
), faults AS (
    SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again,
        NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS open_end, lag(role[1]) OVER (PARTITION BY conv ORDER BY i) || role[1] AS pair
    FROM placed
), numbered AS (
    SELECT *, blank OR again AS must_go, (open_end AND NOT blank AND NOT again)::BIGINT AS late FROM faults
), counted AS (
    SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum(blank::BIGINT)::BIGINT AS blank,
        sum((again AND NOT blank)::BIGINT)::BIGINT AS duplicate, sum(late)::BIGINT AS truncated,
        sum((pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au'))::BIGINT)::BIGINT AS illegal, count(*) AS n
    FROM numbered GROUP BY conv
), parsed AS (
    {first}
    UNION ALL
    {onward}
), ends AS (
    SELECT conv, list_min([z, a]) AS best FROM parsed JOIN counted USING (conv) WHERE i = n
)
SELECT id AS conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, sha256(coalesce(best.t, '')) AS repaired_sha256
FROM convs LEFT JOIN counted USING (conv) LEFT JOIN ends USING (conv)
"""


OP13 = _op13()

ORACLE = {"op1_quality_rules": OP1, "op4_mixing": OP4, "op10_bit_slices": OP10, "op11_superminhash": OP11, "op12_lexical_search": OP12, "op13_conversation_repair": OP13}
