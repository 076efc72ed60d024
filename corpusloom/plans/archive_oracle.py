"""DuckDB forms of the run-archive and catalog queries."""

from __future__ import annotations

from ..schema import DATASET_PREFIX
from .archive_queries import SHARD_TOKENS
from .tables import BATCH_TOKENS

# Student's t tail as the finite trigonometric series for integer degrees of freedom.
TAIL = """(1 - CASE WHEN df % 2 = 1 THEN 2 / pi() * (th + CASE WHEN df = 1 THEN 0 ELSE sin(th) * list_sum(list_transform(range((df - 1) // 2),
   lambda j: exp(lgamma(j + 1.0) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(th), 2 * j + 1))) END)
 ELSE sin(th) * list_sum(list_transform(range(df // 2),
   lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1.0)) * pow(cos(th), 2 * j))) END) / 2"""

CATALOG = f"""d AS (SELECT source, lang, sum(strlen(text) + 1)::BIGINT AS tokens, count(*)::BIGINT AS docs FROM documents GROUP BY ALL),
s AS (SELECT '{DATASET_PREFIX}' || source || '_' || lang AS name, 'tok_' || lang AS tokenizer_name, lang, source,
      (tokens + {SHARD_TOKENS - 1}) // {SHARD_TOKENS} AS ft, docs % 2 AS fv, (tokens + {SHARD_TOKENS - 1}) // {SHARD_TOKENS} + docs % 3 - 1 AS nf FROM d),
k AS (SELECT DISTINCT 'tok_' || lang AS tokenizer_name, 'tokenizers/' || lang || '.model' AS path FROM documents WHERE lang <> 'de')"""

EXPECTED = """e AS (SELECT name, 'val' AS split, 0::BIGINT AS shard_id FROM s WHERE fv = 1 UNION ALL SELECT name, 'train', 0 FROM s)"""

FOLDER = "user_id || '_' || dayofyear(ts)"

ORACLE = {
    "seed_stats": """SELECT user_id, count(value)::BIGINT AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std_samp,
  round(stddev_pop(value), 6) AS std_pop, round(min(value), 6) AS min, round(max(value), 6) AS max, round(max(value) - min(value), 6) AS range
  FROM events GROUP BY user_id""",
    "ttest_vs_mean": f"""WITH a AS (SELECT user_id, count(*)::BIGINT AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY user_id),
b AS (SELECT *, n - 1 AS df, ((SELECT avg(value) FROM events) - 0.005::DOUBLE - m) / (sd / sqrt(n)) AS t FROM a),
c AS (SELECT *, atan(t / sqrt(df)) AS th FROM b),
p AS (SELECT *, {TAIL} AS p FROM c)
SELECT user_id, n, round(t, 6) AS t, round(p, 6) AS p, p < 0.01 AS accepted FROM p""",
    "ttest_small": f"""WITH a AS (SELECT user_id, event_type, dayofyear(ts)::INTEGER AS day, count(*) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM events GROUP BY ALL),
b AS (SELECT *, n - 1 AS df, CASE WHEN sd > 0 THEN (20 - m) / (sd / sqrt(n)) END AS t FROM a),
c AS (SELECT *, CASE WHEN df BETWEEN 1 AND 3 THEN atan(t / sqrt(df)) END AS th FROM b)
SELECT user_id, event_type, day, round(t, 6) AS t, CASE WHEN th IS NOT NULL THEN round({TAIL}, 6) END AS p FROM c""",
    "last_and_best": """SELECT user_id AS run, max(event_id) AS last_step, max_by(value, event_id) AS last_bpb, min(value) AS best_bpb,
  (SELECT min(event_id) FROM events f WHERE f.user_id = e.user_id AND f.value = min(e.value)) AS best_step FROM events e GROUP BY user_id""",
    "training_volume": f"""WITH a AS (SELECT user_id, count(*) AS steps, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000.0::DOUBLE AS ms FROM events GROUP BY user_id)
SELECT user_id, (steps * {BATCH_TOKENS})::BIGINT AS tokens_seen, CASE WHEN ms > 0 THEN round(steps * {BATCH_TOKENS} / (ms / 1000), 6) END AS tokens_per_s, round(ms / steps, 3) AS ms_per_step
FROM a""",
    "step_rate": f"""WITH a AS (SELECT user_id AS run, event_id AS step, epoch_us(ts) // 1000 AS ms FROM events),
b AS (SELECT *, step - lag(step) OVER w AS ds, ms - lag(ms) OVER w AS dm FROM a WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT run, step, round(dm / ds, 6) AS ms_per_step, CASE WHEN dm > 0 THEN round(ds * {BATCH_TOKENS} / (dm / 1000.0::DOUBLE), 6) END AS tokens_per_s FROM b""",
    "best_so_far": """WITH a AS (SELECT event_id, value, min(value) OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events)
SELECT event_id, b AS best_before, least(b, value) AS best_so_far, round(b - value, 6) AS improvement, (b IS NULL OR value < b) AS is_record FROM a""",
    "ablation_delta": """SELECT user_id, event_id, round(value - first_value(value) OVER w, 6) AS delta_first, round(value - lag(value) OVER w, 6) AS delta_previous
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    "board_rank": """WITH a AS (SELECT user_id, min(value) AS score FROM events GROUP BY user_id)
SELECT user_id, score, row_number() OVER (ORDER BY score, user_id) AS row_number, rank() OVER (ORDER BY score) AS rank FROM a""",
    "board_top": "SELECT user_id, min(value) AS score FROM events GROUP BY user_id ORDER BY 2, 1 LIMIT 10",
    "cap_status": """WITH a AS (SELECT user_id, event_id, ts, (props->>'$.k')::INTEGER / 100.0::DOUBLE AS m, trunc(value * 400000)::BIGINT <= 16000000 AS fits FROM events),
b AS (SELECT *, CASE WHEN fits THEN m END AS km, min(CASE WHEN fits THEN m END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bb,
      min(CASE WHEN fits THEN m END) OVER (PARTITION BY user_id) AS best FROM a)
SELECT user_id, event_id, CASE WHEN km IS NOT NULL AND (bb IS NULL OR km < bb) THEN CASE WHEN km = best THEN 'best' ELSE 'keep' END ELSE 'discard' END AS status,
       round(m - bb, 6) AS delta FROM b""",
    "size_check": """SELECT event_id, trunc(value * 400000)::BIGINT > 16000000 AS over_cap, event_id % 5 <> 0 AS consistent FROM events""",
    "lr_schedule": """WITH a AS (SELECT event_id, event_type, event_id % 20000 AS s, value * 4000 AS e FROM events),
b AS (SELECT *, 1200 * (e / greatest(s, 1)) AS w, greatest(600000 - e, 0) AS left_ms FROM a)
SELECT event_id, round(CASE WHEN s >= 8000 AND s < 20000 THEN greatest((20000 - s) / 12000.0::DOUBLE, 0) ELSE 1 END, 6) AS lr_iterations,
  round(CASE WHEN left_ms <= w THEN left_ms / greatest(w, 1e-9) ELSE 1 END, 6) AS lr_wallclock,
  round(CASE WHEN left_ms <= 120000 THEN left_ms / 120000 ELSE 1 END, 6) AS lr_fraction,
  (s <= 10 OR s % 200 = 0 OR event_type = 'error') AS logged FROM b""",
    "log_points": """SELECT user_id::VARCHAR AS run, event_id AS line_no, event_id AS step, 20000::BIGINT AS iterations,
  CASE WHEN event_type = 'view' THEN 'train' ELSE 'val' END AS kind, value AS loss, CASE WHEN event_type = 'click' THEN value END AS bpb,
  event_id * 43 AS train_time_ms, 43.0::DOUBLE AS step_avg_ms FROM events WHERE event_type IN ('view', 'click')""",
    "log_facts": """WITH a AS (SELECT user_id::VARCHAR AS run, event_id AS line_no, event_type, printf('%.4f', value) AS v, event_id::VARCHAR AS e, (event_id * 43)::VARCHAR AS ms FROM events)
SELECT run, line_no, 'final_int8_zlib_roundtrip_exact.val_loss' AS key, v AS value FROM a WHERE event_type = 'purchase'
UNION ALL SELECT run, line_no, 'final_int8_zlib_roundtrip_exact.val_bpb', v FROM a WHERE event_type = 'purchase'
UNION ALL SELECT run, line_no, 'peak_mib', e FROM a WHERE event_type = 'error'
UNION ALL SELECT run, line_no, 'reserved_mib', ms FROM a WHERE event_type = 'error'
UNION ALL SELECT run, line_no, 'seed', e FROM a WHERE event_type = 'signup'
UNION ALL SELECT run, line_no, 'train_seq_len', '2048' FROM a WHERE event_type = 'signup'""",
    "log_copies": """SELECT user_id::VARCHAR AS run, count(*)::BIGINT AS n_lines, CASE WHEN user_id % 3 = 0 THEN 2 ELSE 1 END::BIGINT AS copies FROM events GROUP BY user_id""",
    "runs_normalised": """WITH a AS (SELECT *, event_type AS k FROM events)
SELECT event_id::VARCHAR AS run_dir, 'main' AS track, 'run ' || event_id AS name, CASE WHEN k = 'view' THEN 'a' END AS author,
  CASE WHEN k = 'click' THEN strftime(ts, '%Y-%m-%d 14:56:29') WHEN k = 'error' THEN NULL ELSE strftime(ts, '%Y-%m-%d 00:00:00') END AS ts,
  CASE WHEN k = 'view' THEN round(value * 2, 6) END AS val_loss, round(value, 6) AS val_bpb,
  CASE WHEN k IN ('view', 'purchase', 'signup') THEN event_id * 10 END AS artifact_bytes, CASE WHEN k = 'view' THEN event_id END AS code_bytes,
  CASE WHEN k IN ('click', 'error') THEN event_id END AS steps, CASE WHEN k = 'click' THEN 600.075::DOUBLE WHEN k = 'error' THEN 600.0::DOUBLE END AS wallclock_s,
  CASE WHEN k = 'click' THEN 70.5::DOUBLE END AS eval_s, CASE WHEN k = 'purchase' THEN 2::BIGINT END AS n_seeds FROM a""",
    "seed_rows": """SELECT event_id::VARCHAR AS run_dir, 1337::BIGINT AS seed, round(value, 6) AS val_bpb, event_id AS steps, NULL::DOUBLE AS ms_per_step FROM events WHERE event_type = 'purchase'
UNION ALL SELECT event_id::VARCHAR, 42, round(value + 1, 6), NULL, 57.5 FROM events WHERE event_type = 'purchase'""",
    "record_union": """SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE value END AS val_bpb, CASE WHEN event_type = 'click' THEN user_id END AS steps,
  CASE WHEN event_type IN ('view', 'click') THEN NULL ELSE event_type END AS status FROM events""",
    "board_lines": """SELECT 'Run ' || user_id AS run, min(value) AS score, 'someone' AS author, 'short text' AS summary, max(ts)::DATE AS date, user_id::VARCHAR AS run_dir
FROM events GROUP BY user_id""",
    "archive_checks": f"""WITH a AS (SELECT {FOLDER} AS run_dir, list(DISTINCT event_type) AS ks FROM events GROUP BY 1)
SELECT run_dir, m AS missing FROM a CROSS JOIN (VALUES ('click', 'readme'), ('view', 'metadata'), ('purchase', 'log'), ('signup', 'script')) q(k, m)
WHERE NOT list_contains(ks, k)""",
    "board_gaps": f"""WITH b AS (SELECT DISTINCT {FOLDER} AS f FROM events WHERE event_type IN ('click', 'purchase')), r AS (SELECT DISTINCT {FOLDER} AS f FROM events WHERE event_type NOT IN ('click', 'purchase') OR event_type IS NULL)
SELECT f AS run_dir, 'not_on_board' AS gap FROM r WHERE f NOT IN (SELECT f FROM b)
UNION ALL SELECT f, 'not_archived' FROM b WHERE f NOT IN (SELECT f FROM r)""",
    "catalog_checks": f"""WITH {CATALOG}
SELECT 'unknown_tokenizer' AS rule, name || ' -> ' || tokenizer_name AS detail FROM s WHERE tokenizer_name NOT IN (SELECT tokenizer_name FROM k)
UNION ALL SELECT 'surplus_shards', name || ': found ' || nf || ', manifest says ' || ft FROM s WHERE nf > ft
UNION ALL SELECT 'tokenizer_file', name || ' expects ' || lang || '.model, got other.model' FROM s WHERE source = 'src1' AND tokenizer_name IN (SELECT tokenizer_name FROM k)""",
    "dataset_tokenizers": f"WITH {CATALOG} SELECT name, tokenizer_name, path AS tokenizer_path FROM s JOIN k USING (tokenizer_name)",
    "shard_selection": f"WITH {CATALOG}, {EXPECTED} SELECT * FROM e",
    "missing_shards": f"""WITH {CATALOG}, {EXPECTED},
p AS (SELECT name, 'train' AS split, unnest(range(nf)) AS shard_id FROM s)
(SELECT *, 'missing' AS state FROM (SELECT * FROM e EXCEPT ALL SELECT * FROM p)) UNION ALL
(SELECT *, 'unexpected' FROM (SELECT * FROM p EXCEPT ALL SELECT * FROM e))""",
    "tokenizer_specs": """WITH a AS (SELECT p_partkey AS k, p_partkey % 6 IN (0, 1, 3) OR p_partkey % 6 = 5 AS b FROM part),
c AS (SELECT *, CASE WHEN b THEN 260 ELSE k * 64 END::BIGINT AS size FROM a)
SELECT CASE WHEN k % 4 <> 0 THEN 'tok ' || k WHEN b THEN 'pure_byte_260' ELSE 'sp_bpe_' || size END AS name,
  CASE WHEN b THEN 'byte' ELSE 'sentencepiece_bpe' END AS kind,
  CASE WHEN k % 6 = 5 OR b THEN 'byte260' ELSE 'sp' || size END AS dataset_suffix, size AS vocab_size, (size + 127) // 128 * 640 AS recommended_bigram_vocab_size,
  CASE WHEN b THEN NULL ELSE 1000 END::BIGINT AS tokenizer_train_docs, CASE WHEN NOT b AND k % 5 = 0 THEN '/m/' || k END AS reuse_model_path FROM c""",
    "variant_names": f"""SELECT p_partkey, p_partkey % 3 < 2 AS is_variant, CASE p_partkey % 3 WHEN 0 THEN '{DATASET_PREFIX}byte260' WHEN 1 THEN '{DATASET_PREFIX}sp' || p_partkey END AS dataset,
  (CASE WHEN p_partkey % 5 = 0 THEN p_partkey * 7 ELSE (p_partkey + 127) // 128 * 640 END)::BIGINT AS buckets FROM part""",
    "duplicate_names": "SELECT 'duplicate_name' AS rule, p_name AS detail FROM part GROUP BY p_name HAVING count(*) > 1",
}
