"""DuckDB forms of the corpus and token-stream queries."""

from __future__ import annotations

from ..operators.sequences import POLICIES
from .corpus_queries import CHUNK, HASH_BUCKETS
from .tables import SEQ, SHARD, STRIDE, VAL_DOCS


def placed(num_val: int) -> str:
    return f"""
d AS (SELECT doc_id, source, lang, text, strlen(text)::BIGINT + 1 AS n,
             CASE WHEN doc_id < {num_val} THEN 'val' ELSE 'train' END AS split FROM documents),
p AS (SELECT *, (sum(n) OVER (PARTITION BY split ORDER BY doc_id) - n)::BIGINT AS off,
             row_number() OVER (PARTITION BY split ORDER BY doc_id) - 1 AS ord FROM d)"""


def tokens(num_val: int = 0) -> str:
    return placed(num_val) + """,
l AS (SELECT doc_id, split, source, lang, off,
             list_prepend(1, list_transform(regexp_extract_all(hex(encode(text)), '..'),
                                            lambda h: ('0x' || h)::INTEGER + 4)) AS ids FROM p),
t AS (SELECT doc_id, split, source, lang, off + i AS pos, i, tok
      FROM (SELECT doc_id, split, source, lang, off, unnest(ids) AS tok, unnest(range(len(ids))) AS i FROM l))"""


NLL = """,
c AS (SELECT tok, count(*) AS n FROM t GROUP BY tok),
m AS (SELECT tok, -ln(n / (sum(n) OVER ())) AS nll, CASE WHEN tok >= 4 THEN 1 ELSE 0 END AS b FROM c)"""


def _bpb(*by: str) -> str:
    keys = ", ".join(by)
    head = f"{keys}, " if by else ""
    tail = f" GROUP BY {keys}" if by else ""
    return f"""WITH {tokens()}{NLL}
SELECT {head.replace('doc_id', 'doc_id AS doc_ordinal')}count(*)::BIGINT AS n_tokens, sum(b)::BIGINT AS n_bytes, round(sum(nll), 3) AS loss_sum,
       round(sum(nll) / count(*), 6) AS val_loss,
       round(sum(nll) / count(*) / ln(2) * count(*) / sum(b), 9) AS bpb
FROM t JOIN m USING (tok){tail}"""


PER_DOC = f"""WITH {tokens()}{NLL},
e AS (SELECT doc_id, count(*) AS nt, sum(b) AS nb, sum(nll) AS ls FROM t JOIN m USING (tok) GROUP BY doc_id)"""

WEIGHTED = "sum(tok * (k + 1))::BIGINT"


def window_rows(policy: str) -> str:
    """(window_id, win_start, win_len, score_from) from a recursive-free enumeration."""
    seq, stride = SEQ, STRIDE
    starts = {
        "all_starts": f"SELECT range AS s FROM range(0, (SELECT total FROM n), {stride})",
        "full_only": f"SELECT range * {stride} AS s FROM range((SELECT greatest(cast(floor((total - {seq}) / {stride}) AS BIGINT) + 1, 1) FROM n))",
        "full_first": f"SELECT range AS s FROM range(0, (SELECT greatest(total - {seq} + 1, 0) FROM n), {stride})",
        "jump": f"""SELECT 0 AS s WHERE (SELECT total FROM n) >= {seq} UNION ALL
                    SELECT range AS s FROM range({seq - stride}, (SELECT greatest(total - {seq} + 1, {seq - stride}) FROM n), {stride})""",
        "exact_once": f"SELECT range AS s FROM range(0, (SELECT total FROM n), {stride}) WHERE range = 0 OR range + {seq - stride} < (SELECT total FROM n)",
    }[policy]
    score = {
        "all_starts": f"CASE WHEN s = 0 THEN 0 ELSE greatest(len - {stride}, 0) END",
        "full_only": f"greatest(len - {stride}, 0)",
        "full_first": f"CASE WHEN s = 0 THEN 0 ELSE {seq - stride} END",
        "jump": f"CASE WHEN s = 0 THEN 0 ELSE {seq - stride} END",
        "exact_once": f"CASE WHEN s = 0 THEN 0 ELSE {seq - stride} END",
    }[policy]
    return f"""SELECT '{policy}' AS policy, (row_number() OVER (ORDER BY s) - 1)::BIGINT AS window_id, s::BIGINT AS win_start,
       len::BIGINT AS win_len, ({score})::BIGINT AS score_from
FROM (SELECT s, least(s + {seq}, (SELECT total FROM n)) - s AS len FROM ({starts}))"""


TOTAL = "n AS (SELECT sum(strlen(text) + 1)::BIGINT - 1 AS total FROM documents)"
ALL_WINDOWS = " UNION ALL ".join(f"({window_rows(p)})" for p in POLICIES)
SCORED = f"""{TOTAL}, w AS ({ALL_WINDOWS}),
x AS (SELECT policy, unnest(range(win_start + score_from, win_start + win_len)) AS xp FROM w)"""

WORDS = r"""
z AS (SELECT regexp_replace(regexp_replace(replace(text, chr(0), ' '), '^[\s\x1c-\x1f\x85\p{Z}\x0b]+|[\s\x1c-\x1f\x85\p{Z}\x0b]+$', '', 'g'),
                            '[\s\x0b]+', '▁', 'g') AS x FROM documents),
w AS (SELECT word, count(*)::BIGINT AS n FROM
        (SELECT unnest(regexp_extract_all(x, '\p{Nd}|▁?[^▁\p{Nd}]+|▁')) AS word FROM z WHERE x <> '') GROUP BY word)"""

# Words as symbols between two noncharacters; what the alphabet leaves out becomes byte
# pieces. Then one merge a step: the most frequent pair, ties by the lowest pair.
def merges(n: int) -> str:
    o, c = "chr(64976)", "chr(64977)"
    return rf"""WITH RECURSIVE {WORDS},
c AS (SELECT ch, sum(n)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch, n FROM w) GROUP BY ch),
q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, ch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM c),
alphabet AS (SELECT ch, n FROM q WHERE b < 0.999::DOUBLE * t),
known AS (SELECT list(ch) AS chars FROM alphabet),
spelled AS (
  SELECT array_to_string([CASE WHEN list_contains(chars, x) THEN {o} || x || {c}
      ELSE array_to_string([{o} || '<0x' || h || '>' || {c} for h in regexp_extract_all(hex(encode(x)), '..')], '') END for x in regexp_extract_all(word, '(?s).')], '') AS s,
    sum(n)::BIGINT AS n
  FROM w, known GROUP BY 1
), steps(step, s, n, l, r, c) AS (
  SELECT 0, s, n, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT FROM spelled
  UNION ALL
  SELECT step + 1, replace(s, {o} || b.l || {c} || {o} || b.r || {c}, {o} || b.l || b.r || {c}), n, b.l, b.r, b.c
  FROM steps, (
    SELECT y[i] AS l, y[i + 1] AS r, sum(n)::BIGINT AS c
    FROM (SELECT y, n, unnest(range(1, len(y))) AS i FROM (SELECT string_split(s[2:len(s) - 1], {c} || {o}) AS y, n FROM steps))
    WHERE NOT regexp_matches(y[i], '^<(0x[0-9A-F]{{2}}|unk)>$') AND NOT regexp_matches(y[i + 1], '^<(0x[0-9A-F]{{2}}|unk)>$')
    GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1
  ) AS b WHERE step < {n}
), learned AS (SELECT DISTINCT (step - 1)::BIGINT AS rank, l, r, l || r AS piece, c FROM steps WHERE step > 0)"""


VOCABULARY = merges(16) + """,
pieces AS (SELECT piece, row_number() OVER (ORDER BY g, r, piece) + 259 AS id
  FROM (SELECT 0 AS g, rank AS r, piece FROM learned UNION ALL SELECT 1, -n, ch FROM alphabet)),
sized AS (SELECT id, piece, starts_with(piece, '▁') AS marked FROM pieces)
SELECT i::INTEGER AS token_id, (i >= 4)::INTEGER AS n_bytes, false AS leading_space, i < 4 AS boundary FROM range(260) q(i)
UNION ALL
SELECT id::INTEGER, (strlen(piece) - CASE WHEN marked THEN 3 ELSE 0 END)::INTEGER, marked, false FROM sized"""

ORACLE = {
    "bpe_merges": merges(48) + """ SELECT rank, l AS "left", r AS "right", piece, c AS n FROM learned""",
    "bpe_vocabulary": VOCABULARY,
    "corpus_bpb_unigram": _bpb(),
    "bpb_by_source_lang": _bpb("source", "lang"),
    "bpb_by_document": _bpb("doc_id"),
    "bpb_by_label": PER_DOC + """
SELECT quality, toxic, count(*)::BIGINT AS n_docs, sum(nb)::BIGINT AS n_bytes,
       round(avg(ls / ln(2) / nb), 6) AS mean_doc_bpb, round(sum(ls) / ln(2) / sum(nb), 6) AS bpb
FROM e LEFT JOIN labels USING (doc_id) GROUP BY quality, toxic""",
    "running_bpb": PER_DOC + """
SELECT doc_id AS doc_ordinal, (sum(nt) OVER q)::BIGINT AS run_n_tokens, (sum(nb) OVER q)::BIGINT AS run_n_bytes,
       round((sum(ls) OVER q) / ln(2) / (sum(nb) OVER q), 6) AS running_bpb
FROM e WINDOW q AS (ORDER BY doc_id)""",
    "target_bytes": f"""WITH {tokens()},
s AS (SELECT tok, lag(tok) OVER (ORDER BY pos) AS prev FROM t)
SELECT tok AS token, count(*)::BIGINT AS n,
       sum(CASE WHEN tok >= 4 THEN 1 ELSE 0 END + CASE WHEN tok BETWEEN 101 AND 126 AND prev >= 4 THEN 1 ELSE 0 END)::BIGINT AS n_bytes
FROM s WHERE prev IS NOT NULL GROUP BY tok""",
    "token_histogram": f"WITH {tokens()} SELECT tok AS token_id, count(*)::BIGINT AS n FROM t GROUP BY tok",
    "bad_token_check": f"""WITH {tokens()}
SELECT doc_id AS doc_ordinal, min_by(tok, i) AS bad_id, min(i)::INTEGER AS bad_pos FROM t WHERE tok < 0 OR tok >= 150 GROUP BY doc_id""",
    "split_stats": f"""WITH {placed(VAL_DOCS)},
s AS (SELECT split, count(*)::BIGINT AS docs, ceil(sum(n) / {SHARD})::BIGINT AS files, sum(n)::BIGINT AS tokens FROM d GROUP BY split),
a AS (SELECT k AS split, coalesce(docs, 0) AS docs, coalesce(files, 0) AS files, coalesce(tokens, 0) AS tokens
      FROM (VALUES ('val'), ('train')) v(k) LEFT JOIN s ON s.split = v.k)
SELECT * FROM a UNION ALL SELECT 'total', sum(docs)::BIGINT, sum(files)::BIGINT, sum(tokens)::BIGINT FROM a""",
    "shard_plan": f"""WITH {placed(VAL_DOCS)},
s AS (SELECT *, unnest(range(off // {SHARD}, (off + n - 1) // {SHARD} + 1)) AS k, sum(n) OVER (PARTITION BY split) AS total FROM p)
SELECT split, k AS shard_id, doc_id AS doc_ordinal, greatest(off, k * {SHARD}) - k * {SHARD} AS shard_offset,
       greatest(off, k * {SHARD}) - off AS doc_from, least(off + n, (k + 1) * {SHARD}) - greatest(off, k * {SHARD}) AS n,
       least({SHARD}, total - k * {SHARD})::BIGINT AS shard_tokens FROM s""",
    "placed_documents": f"""WITH {placed(VAL_DOCS)}
SELECT split, doc_id AS doc_ordinal, ord AS split_ordinal, off AS "offset", n AS n_tokens, n AS n_made FROM p""",
    "doc_spans": f"""WITH {tokens(VAL_DOCS)},
b AS (SELECT split, pos, lead(pos) OVER (PARTITION BY split ORDER BY pos) AS nxt FROM t WHERE tok = 1),
z AS (SELECT split, max(pos) + 1 AS total FROM t GROUP BY split)
SELECT split, pos AS start, coalesce(nxt + 1, total) - pos AS length FROM b JOIN z USING (split)""",
    "clean_training_text": r"""
SELECT doc_id AS doc_ordinal, length(x)::BIGINT AS n_chars, sha256(x) AS digest FROM
 (SELECT doc_id, regexp_replace(replace(text, chr(0), ' '), '^[\s\x1c-\x1f\x85\p{Z}\x0b]+|[\s\x1c-\x1f\x85\p{Z}\x0b]+$', '', 'g') AS x FROM documents)
WHERE x <> ''""",
    "prefix_docs": r"""
SELECT count(*)::BIGINT AS n_docs, sum(strlen(x))::BIGINT AS n_bytes, max(doc_id) AS last_ordinal FROM
 (SELECT doc_id, regexp_replace(replace(text, chr(0), ' '), '^[\s\x1c-\x1f\x85\p{Z}\x0b]+|[\s\x1c-\x1f\x85\p{Z}\x0b]+$', '', 'g') AS x FROM documents
  WHERE doc_id < (SELECT count(*) // 2 FROM documents)) WHERE x <> ''""",
    "vocab_piece_stats": """WITH s AS (SELECT string_split(text, ' ') AS ws FROM documents),
u AS (SELECT unnest(ws) AS w, unnest(range(len(ws))) AS i FROM s),
q AS (SELECT DISTINCT CASE WHEN i > 0 THEN '▁' || w ELSE w END AS piece FROM u WHERE w <> '')
SELECT piece, (strlen(piece) - CASE WHEN starts_with(piece, '▁') THEN 3 ELSE 0 END)::INTEGER AS n_bytes,
       starts_with(piece, '▁') AS leading_space, false AS boundary FROM q""",
    "bigram_hash_a": f"""WITH {tokens()},
s AS (SELECT tok::BIGINT AS cur, (lag(tok) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS prev FROM t)
SELECT (CASE WHEN prev IS NULL THEN {HASH_BUCKETS - 1} ELSE xor(36313 * cur, 27191 * prev) % {HASH_BUCKETS - 1} END)::BIGINT AS bucket,
       count(*)::BIGINT AS n FROM s GROUP BY 1""",
    "bigram_hash_b": f"""WITH {tokens()},
s AS (SELECT tok::BIGINT AS cur, (lag(tok, 1, 0) OVER (PARTITION BY doc_id ORDER BY i))::BIGINT AS prev FROM t)
SELECT (prev * 92821 + cur) % {HASH_BUCKETS} AS bucket, count(*)::BIGINT AS n FROM s GROUP BY 1""",
    "eval_sequences": f"""WITH {tokens(VAL_DOCS)},
u AS (SELECT split, (max(pos) // {SEQ}) * {SEQ} AS usable FROM t GROUP BY split),
x AS (SELECT split, pos // {SEQ} AS seq_id, sum(tok)::BIGINT AS sum_x FROM t JOIN u USING (split) WHERE pos < usable GROUP BY ALL),
y AS (SELECT split, (pos - 1) // {SEQ} AS seq_id, sum(tok * ((pos - 1) % {SEQ} + 1))::BIGINT AS wsum_y, max_by(tok, pos) AS last_y
      FROM t JOIN u USING (split) WHERE pos >= 1 AND pos <= usable GROUP BY ALL)
SELECT split, seq_id, sum_x, wsum_y, last_y FROM x JOIN y USING (split, seq_id)""",
    "train_batches": f"""WITH {tokens()},
z AS (SELECT count(*) AS total FROM t),
k AS (SELECT range AS k FROM range((SELECT (total // 4100 + 3) * 4 FROM z))),
s AS (SELECT k // 4 AS call, k % 4 AS worker, k * 1025 AS start FROM k),
v AS (SELECT call, worker, unnest(range(1025)) AS j, start FROM s),
g AS (SELECT call, worker, j, tok FROM v CROSS JOIN z JOIN t ON t.pos = (start + j) % total),
x AS (SELECT call, worker, j // 256 AS r, sum(tok)::BIGINT AS sum_x FROM g WHERE j < 1024 GROUP BY ALL),
y AS (SELECT call, worker, (j - 1) // 256 AS r, sum(tok * ((j - 1) % 256 + 1))::BIGINT AS wsum_y FROM g WHERE j >= 1 GROUP BY ALL)
SELECT call, worker, r AS row, sum_x, wsum_y FROM x JOIN y USING (call, worker, r)""",
    "train_batches_single": f"""WITH {tokens()},
z AS (SELECT count(*) AS total FROM t),
k AS (SELECT range AS call FROM range((SELECT total // 4097 + 3 FROM z))),
v AS (SELECT call, unnest(range(4097)) AS j FROM k)
SELECT call, count(*)::BIGINT AS n, sum(tok * (j + 1))::BIGINT AS wsum
FROM v CROSS JOIN z JOIN t ON t.pos = (call * 4097 + j) % total GROUP BY call""",
    "train_epochs": """WITH z AS (SELECT sum(strlen(text) + 1)::BIGINT AS total FROM documents),
k AS (SELECT range AS call, range * 4097 AS start FROM range((SELECT 3 * (total // 4097) + 3 FROM z)))
SELECT call, e + 1 AS epoch FROM k CROSS JOIN z CROSS JOIN range(1, 6) r(e)
WHERE e * total BETWEEN start AND start + 4096""",
    "microbatch_plan": """WITH d AS (SELECT doc_id, (strlen(text) + 1)::BIGINT // 64 * 64 AS usable FROM documents)
SELECT doc_id AS doc_ordinal, k AS chunk_id, least(usable - k * 960, 960) AS tokens
FROM (SELECT doc_id, usable, unnest(range((usable + 959) // 960)) AS k FROM d)""",
    "wrap_positions": """WITH z AS (SELECT sum(strlen(text) + 1)::BIGINT AS total FROM documents)
SELECT doc_id AS doc_ordinal, doc_id * 104729 // total + 1 AS epoch, doc_id * 104729 % total AS pos FROM documents CROSS JOIN z""",
    **{
        f"windows_{p}": f"WITH {TOTAL} SELECT window_id, win_start, win_len, score_from FROM ({window_rows(p)})"
        for p in POLICIES
    },
    "windows_per_doc": f"""WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS pred FROM documents WHERE strlen(text) > 0),
q AS (SELECT doc_id, pred, (pred + {CHUNK - 1}) // {CHUNK} AS nc, unnest(range((pred + {CHUNK - 1}) // {CHUNK})) AS ci FROM d),
e AS (SELECT *, ci * {CHUNK} AS cs, CASE WHEN ci = nc - 1 THEN pred ELSE (ci + 1) * {CHUNK} END AS ce FROM q)
SELECT doc_id AS doc_ordinal, ci AS chunk_id, greatest(0, ce - {SEQ}) AS win_start, ce - greatest(0, ce - {SEQ}) AS win_len,
       cs - greatest(0, ce - {SEQ}) AS chunk_offset, ce - cs AS chunk_len FROM e""",
    "window_coverage": f"""WITH {SCORED},
h AS (SELECT policy, xp, count(*) AS times FROM x GROUP BY ALL),
a AS (SELECT policy, times::BIGINT AS times, count(*)::BIGINT AS positions FROM h GROUP BY ALL)
SELECT * FROM a UNION ALL
SELECT policy, 0, (SELECT total FROM n) - sum(positions)::BIGINT FROM a GROUP BY policy HAVING (SELECT total FROM n) > sum(positions)""",
    "sliding_bpb": f"""WITH {tokens()}{NLL}, {SCORED}
SELECT policy, count(*)::BIGINT AS n_tokens, sum(b)::BIGINT AS n_bytes, round(sum(nll) / ln(2) / sum(b), 8) AS bpb
FROM x JOIN t ON t.pos = xp + 1 JOIN m USING (tok) GROUP BY policy""",
    "padded_windows": f"""WITH {tokens()},
g AS (SELECT doc_id, i // {CHUNK} AS ci, i, tok, max(i) OVER (PARTITION BY doc_id) AS pred FROM t),
e AS (SELECT doc_id, pred, unnest(range((pred + {CHUNK - 1}) // {CHUNK})) AS ci FROM (SELECT DISTINCT doc_id, pred FROM g)),
f AS (SELECT doc_id, ci, pred, greatest(0, least(pred, (ci + 1) * {CHUNK}) - {CHUNK}) AS ws, least(pred, (ci + 1) * {CHUNK}) AS ce FROM e)
SELECT f.doc_id AS doc_ordinal, f.ci AS chunk_id, (ce - ws)::BIGINT AS win_len, {CHUNK}::BIGINT AS width, sum(tok * (i - ws + 1))::BIGINT AS wsum
FROM f JOIN t ON t.doc_id = f.doc_id AND t.i >= ws AND t.i < ce GROUP BY ALL""",
    "length_buckets": f"""WITH d AS (SELECT doc_id, (strlen(text)::BIGINT - 1) // {CHUNK} AS nc FROM documents),
q AS (SELECT *, row_number() OVER (ORDER BY nc, doc_id) - 1 AS rk FROM d)
SELECT doc_id AS doc_ordinal, nc AS num_chunks, rk AS rank, rk // 64 AS batch_id FROM q""",
    "worker_assignment": """WITH z AS (SELECT count(*) AS n FROM documents),
b AS (SELECT r, n * r // 7 AS lo, n * (r + 1) // 7 AS hi FROM z CROSS JOIN range(7) q(r))
SELECT doc_id AS doc_ordinal, r AS contiguous, doc_id % 7 AS interleaved, least(doc_id // (n // 7), 6) AS floor_rest,
       doc_id // ((n + 6) // 7) AS ceiling
FROM documents CROSS JOIN z JOIN b ON doc_id >= lo AND doc_id < hi""",
    "score_windows": f"""WITH {tokens()}{NLL}
SELECT pos // {SHARD} AS part, count(*)::BIGINT AS n, sum(tok)::BIGINT AS sum_token, round(sum(nll), 3) AS loss_sum
FROM t JOIN m USING (tok) WHERE pos >= 1 GROUP BY 1""",
    "corpus_fingerprint": """WITH a AS (SELECT doc_id AS k, sha256(text) AS h FROM documents),
b AS (SELECT k // 64 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM a GROUP BY k // 64),
c AS (SELECT k // 64 AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM b GROUP BY k // 64)
SELECT (SELECT count(*) FROM documents)::BIGINT AS n_docs, sha256(string_agg(h, '' ORDER BY k)) AS root FROM c""",
    "word_frequency": f"WITH {WORDS} SELECT word, n FROM w",
    "alphabet_coverage": f"""WITH {WORDS},
c AS (SELECT ch AS char, sum(n)::BIGINT AS n FROM (SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch, n FROM w) GROUP BY ch),
q AS (SELECT *, coalesce(sum(n) OVER (ORDER BY n DESC, char ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(n) OVER () AS t FROM c)
SELECT char, n FROM q WHERE b < 0.999::DOUBLE * t""",
    "pair_frequency": f"""WITH {WORDS},
c AS (SELECT regexp_extract_all(word, '(?s).') AS s, n FROM w),
e AS (SELECT unnest(s[1:len(s) - 1]) AS "left", unnest(s[2:len(s)]) AS "right", n FROM c WHERE len(s) > 1)
SELECT "left", "right", sum(n)::BIGINT AS n FROM e GROUP BY ALL""",
}
