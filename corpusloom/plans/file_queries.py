"""Queries that write files out of the given tables and read them back, with their DuckDB
forms. Each has a branch for input that must be refused."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import udtf
from ..operators.asof import asof_join
from ..operators.checks import check_count
from ..operators.export import export_corpus
from ..operators.sequences import as_rows, train_spans
from ..operators.tokenizers import resolve_specs
from ..session import durable, scratch_path
from ..sources.archive import check_results, read_results
from ..sources.docs import read_sidecar, resolve_counts
from ..sources.manifest import manifest_document, parse_specs, read_specs, write_specs
from ..sources.token_shards import read_shards, read_spans, shard_sizes
from .corpus_oracle import placed, tokens
from .stream_queries import _export_tokens
from .tables import SEQ, SHARD, STRIDE, VAL_DOCS, docs, events, lengths, table, total_of, weighted_sum

SQL_SHARD = 5_000


def refusal(action, *phrases: str) -> str:
    """Which of ``phrases`` the error of ``action`` says; ``accepted`` if there is none."""
    try:
        action()
    except Exception as error:  # noqa: BLE001 - whatever it is, it must say one of the phrases
        return next((p for p in phrases if p in str(error)), f"another error: {error}"[:200])
    return "accepted"


def _write_text(spark: SparkSession, rows: DataFrame, label: str) -> str:
    path = scratch_path(spark, label)
    rows.coalesce(1).write.text(path)
    return path


def spec_files(spark, sf):
    """A tokenizer spec for each nation (25 at any scale), with keys and types that the
    engine does not know: JSON to specs to JSON and back."""
    n = table(spark, sf, "nation")
    key = F.col("n_nationkey")
    overrides = F.struct(key.cast("int").alias("seed"), (F.col("n_regionkey") / 4).alias("share"), F.col("n_name").alias("tag"), (key % 2 == 0).alias("even"))
    spec = F.struct(
        F.col("n_name").alias("name"), (key * 64 + 1024).alias("vocab_size"), overrides.alias("trainer_overrides"),
        F.struct(F.array(key, F.col("n_regionkey")).alias("keys")).alias("maker"),
        F.when(key % 3 == 0, key * 7).alias("recommended_bigram_vocab_size"),
    )
    listed = n.agg(F.to_json(F.struct(F.collect_list(spec).alias("tokenizer_specs"))).alias("value"))
    first = read_specs(spark, _write_text(spark, listed, "specs"))
    out = scratch_path(spark, "specs-used")
    write_specs(first, out)
    again = read_specs(spark, out)
    sizes = resolve_specs(again).select(F.col("name").alias("of"), F.col("recommended_bigram_vocab_size").alias("buckets"))
    rows = again.join(sizes, F.col("name") == F.col("of")).select(
        "name", "vocab_size", F.variant_get("raw", "$.trainer_overrides.seed", "int").alias("seed"), F.variant_get("raw", "$.trainer_overrides.share", "double").alias("share"),
        F.concat_ws(" ", *[F.schema_of_variant(F.variant_get("raw", f"$.trainer_overrides.{k}", "variant")) for k in ("seed", "tag", "even")]).alias("types"), F.variant_get("raw", "$.maker.keys[1]", "bigint").alias("region"),
        F.to_json(F.variant_get("raw", "$.trainer_overrides", "variant")).alias("overrides"), "buckets", F.lit(None).cast("string").alias("refused"),
    )
    names = n.agg(F.to_json(F.collect_list("n_name")).alias("value"))  # a list, but not of objects
    none = n.filter("n_nationkey < 0").agg(F.to_json(F.struct(F.collect_list(spec).alias("tokenizers"))).alias("value"))
    phrases = ("is not an object", "a non-empty list is needed")
    refused = [(f"refused {i}", refusal(lambda bad=bad: parse_specs(bad).collect(), *phrases)) for i, bad in enumerate((names, none))]
    bad = spark.createDataFrame(refused, "name string, refused string")
    return rows.unionByName(bad, allowMissingColumns=True)


def sidecar_counts(spark, sf):
    """Counts by sidecar, by argument and by counting; declared against counted."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ordinal"))
    said = d.agg(F.count(F.lit(1)).alias("num_docs"), F.lit(VAL_DOCS).alias("docs_val"), F.max("doc_ordinal").alias("shuffle_seed"), F.sha2(F.sum("doc_ordinal").cast("string"), 256).alias("docs_sha256"))
    body = said.select(F.to_json(F.struct("*", F.struct(F.lit("x").alias("name"), F.lit(1.5).alias("level")).alias("maker"))).alias("value"))
    path = scratch_path(spark, "sidecar")
    body.coalesce(1).write.text(path)
    file = next(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    side, absent = read_sidecar(spark, file), read_sidecar(spark, f"{path}/none.json")
    cases = [("sidecar", *resolve_counts(d, side)), ("argument", *resolve_counts(d, side, 7)), ("absent", *resolve_counts(d, absent, 3))]
    rows = spark.createDataFrame(cases, "name string, num_docs bigint, num_val bigint")
    facts = side.select(F.lit("fields").alias("name"), "num_docs", F.col("shuffle_seed").alias("num_val"), F.concat_ws(" ", "docs_sha256", F.variant_get("raw", "$.maker.level", "string")).alias("detail"))
    declared = cases[0][1]
    wrong = check_count(d, declared + 1).unionByName(check_count(d, declared)).select(F.col("rule").alias("name"), "detail")
    refused = refusal(lambda: resolve_counts(d, side, declared + 1), f"cannot take {declared + 1} validation documents of {declared}")
    spoiled = refusal(lambda: read_sidecar(spark, _one_file(spark, said.select(F.to_json(F.array("num_docs")).alias("value")))).collect(), "docs sidecar is not an object")
    bad = spark.createDataFrame([("refused", refused), ("refused", spoiled)], "name string, detail string")
    return rows.unionByName(facts, allowMissingColumns=True).unionByName(wrong, allowMissingColumns=True).unionByName(bad, allowMissingColumns=True)


def _one_file(spark: SparkSession, rows: DataFrame) -> str:
    path = _write_text(spark, rows, "file")
    return next(r["path"] for r in spark.read.format("binaryFile").load(path).select("path").collect())


def export_manifest(spark, sf):
    """Documents and a spec to shards, statistics and manifest, and back through the
    manifest; an export whose declared count is wrong leaves the manifest as it was."""
    root = scratch_path(spark, "export")
    d = docs(spark, sf)
    spec = parse_specs(table(spark, sf, "region").agg(F.to_json(F.array(F.struct(F.lit("byte").alias("kind"), F.sum("r_regionkey").alias("own")))).alias("value")))
    manifest = export_corpus(d, spec, root, num_val_docs=VAL_DOCS, shard_size=SHARD, repo_id="some/where", docs_jsonl="docs.jsonl")
    declared = spark.createDataFrame([(-1, VAL_DOCS, None, None)], "num_docs bigint, docs_val bigint, shuffle_seed bigint, docs_sha256 string")
    refused = refusal(lambda: export_corpus(d, spec, root, num_val_docs=-1, shard_size=SHARD, sidecar=declared), "cannot take -1 validation documents")
    said = manifest_document(spark.read.text(manifest, wholetext=True)).select("manifest").first()["manifest"].toPython()
    dataset = said["datasets"][0]
    shards = read_shards(spark, f"{root}/{dataset['path']}", blockTokens=4096)
    rows = shards.groupBy("split").agg(F.sum(F.size("tokens")).alias("tokens"), F.sum(weighted_sum(F.col("tokens")) + F.col("block_offset") * total_of(F.col("tokens"))).alias("wsum"))
    stats = [(s, dataset["stats"][f"docs_{s}"], dataset["stats"][f"files_{s}"], dataset["stats"][f"tokens_{s}"]) for s in ("val", "train")]
    known = spark.createDataFrame(stats, "of string, docs bigint, files bigint, declared bigint")
    about = json.dumps([dataset["name"], said["num_docs"], said["docs_meta"]["remote_repo_id"], said["tokenizer_specs"][0]["own"], refused])
    return rows.join(known, F.col("split") == F.col("of")).select("split", "docs", "files", "declared", "tokens", "wsum", F.lit(about).alias("about"))


def train_batches_files(spark, sf):
    """Training batches read by position from the shards of the training split."""
    path = _export_tokens(spark, sf)
    total = shard_sizes(spark, path, split="train").agg(F.sum("n_tokens")).first()[0]
    spans = train_spans(spark, total, total // 4100 + 3, global_tokens=8192, world=4, accum=2, seq_len=256)
    rows = as_rows(read_spans(spark, path, spans.select("call", "worker", "start", "length")), 256, ["call", "worker"])
    return rows.select("call", "worker", F.col("row").cast("bigint").alias("row"), total_of(F.col("x")).alias("sum_x"), weighted_sum(F.col("y")).alias("wsum_y"))


def results_files(spark, sf):
    """Result tables as TSV, and the lines that cannot be read as results."""
    e = events(spark, sf)
    size = F.when(F.col("event_id") % 50 == 0, F.lit("large")).otherwise((F.col("event_id") * 1000).cast("string"))
    line = F.concat_ws("\t", F.format_string("%.6f", "value"), size, (F.col("event_id") % 500).cast("string"), F.concat(F.lit("run "), F.col("user_id").cast("string")))
    path = scratch_path(spark, "results")
    e.select(F.col("event_type").alias("kind"), line.alias("value")).write.option("header", "false").partitionBy("kind").text(path)
    read = read_results(spark, f"{path}/*", header=False)
    sums = read.groupBy("notes").agg(F.count(F.lit(1)).alias("n"), F.round(F.min("val_bpb"), 6).alias("best"), F.sum("artifact_bytes").alias("bytes"), F.max("memory_mb").alias("memory"))
    wrong = check_results(spark, f"{path}/*", header=False).groupBy("rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("rule").alias("notes"), "n")
    return sums.unionByName(wrong, allowMissingColumns=True)


def board_asof(spark, sf):
    """Each purchase with the record of its time: the best view so far on its day's board, kept
    in a table of its own. Ties on the board go to the later event."""
    e = events(spark, sf)
    day = F.dayofyear("ts")
    board = e.filter("event_type = 'view'").select(day.alias("day"), "ts", F.col("event_id").alias("entry"), F.col("value").alias("score"))
    runs = e.filter("event_type = 'purchase'").select(day.alias("day"), "ts", "event_id", "value")
    found = asof_join(runs, board, "ts", by=["day"], ties=["entry"])
    earlier = asof_join(runs, board, "ts", by=["day"], ties=["entry"], strict=True).select(F.col("event_id").alias("of"), F.col("entry").alias("entry_before"))
    return found.join(earlier, F.col("event_id") == F.col("of")).select("event_id", "entry", F.col("right_ts").alias("since"), F.round(F.col("value") - F.col("score"), 6).alias("behind"), "entry_before")


def sql_shard_pieces(spark, sf):
    """Shard pieces by a table function: every source is a stream of its own, the offset is
    carried along its documents. Arguments that cannot be are refused before a row is read."""
    udtf.register(spark)
    lengths(spark, sf, "source").createOrReplaceTempView("source_lengths")
    call = f"SELECT source, doc_ordinal, shard_id, shard_offset, doc_from, n FROM shard_pieces_of(TABLE(source_lengths) PARTITION BY (source) ORDER BY (doc_ordinal), {SQL_SHARD})"
    refused = [
        refusal(lambda: spark.sql("SELECT * FROM shard_pieces_of(TABLE(source_lengths) PARTITION BY (source), 0)"), "shard_size must be a constant above 0"),
        refusal(lambda: spark.sql("SELECT * FROM shard_pieces_of(TABLE(SELECT source FROM source_lengths), 5)"), "the table lacks n_tokens"),
    ]
    bad = spark.createDataFrame([(r,) for r in refused], "source string")
    return spark.sql(call).unionByName(bad, allowMissingColumns=True)


def sql_windows(spark, sf):
    """Windows of every document under all policies, by a table function on Arrow batches.
    The lengths are a durable table: texts are read once, not once per policy."""
    pairs = durable(lengths(spark, sf).select("doc_ordinal", (F.col("n_tokens") - 1).alias("total")))
    pairs.createOrReplaceTempView("doc_pairs")
    udtf.register_windows_of(spark, "doc_windows_of", pairs.schema)
    parts = [f"SELECT '{p}' AS policy, * FROM doc_windows_of(TABLE(doc_pairs), {SEQ}, {STRIDE}, '{p}')" for p in udtf.POLICY_NAMES.split(", ")]
    rows = spark.sql(" UNION ALL ".join(parts))
    return rows.groupBy("policy", "doc_ordinal").agg(
        F.count(F.lit(1)).alias("n"), F.sum("win_start").alias("starts"), F.sum("win_len").alias("lens"), F.sum(F.col("score_from") * (F.col("window_id") + 1)).alias("scores")
    )


QUERIES = {f.__name__: f for f in (spec_files, sidecar_counts, export_manifest, train_batches_files, results_files, board_asof, sql_shard_pieces, sql_windows)}

_PLACED = placed(VAL_DOCS)
ORACLE = {
    "spec_files": """SELECT n_name AS name, (n_nationkey * 64 + 1024)::BIGINT AS vocab_size, n_nationkey::INTEGER AS seed, n_regionkey / 4.0::DOUBLE AS share,
  'BIGINT STRING BOOLEAN' AS types,
  n_regionkey::BIGINT AS region,
  '{"even":' || (n_nationkey % 2 = 0) || ',"seed":' || n_nationkey || ',"share":' || CASE n_regionkey WHEN 0 THEN '0' WHEN 1 THEN '0.25' WHEN 2 THEN '0.5' WHEN 3 THEN '0.75' ELSE '1' END || ',"tag":"' || n_name || '"}' AS overrides,
  (CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey * 7 ELSE (n_nationkey * 64 + 1024 + 127) // 128 * 128 * 5 END)::BIGINT AS buckets, NULL::VARCHAR AS refused FROM nation
UNION ALL SELECT 'refused 0', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'is not an object'
UNION ALL SELECT 'refused 1', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'a non-empty list is needed'""",
    "sidecar_counts": f"""WITH n AS (SELECT count(*)::BIGINT AS n, max(doc_id)::BIGINT AS seed, sha256(sum(doc_id)::VARCHAR) AS digest FROM documents)
SELECT 'sidecar' AS name, n AS num_docs, {VAL_DOCS}::BIGINT AS num_val, NULL::VARCHAR AS detail FROM n UNION ALL SELECT 'argument', n, 7, NULL FROM n
UNION ALL SELECT 'absent', n, 3, NULL FROM n UNION ALL SELECT 'fields', n, seed, digest || ' 1.5' FROM n
UNION ALL SELECT 'doc_count', NULL, NULL, 'expected ' || (n + 1) || ' docs, found ' || n FROM n
UNION ALL SELECT 'refused', NULL, NULL, 'cannot take ' || (n + 1) || ' validation documents of ' || n FROM n
UNION ALL SELECT 'refused', NULL, NULL, 'docs sidecar is not an object'""",
    "export_manifest": f"""WITH {tokens(VAL_DOCS)}, n AS (SELECT count(*) AS n FROM documents), o AS (SELECT sum(r_regionkey) AS own FROM region)
SELECT split, count(DISTINCT doc_id)::BIGINT AS docs, ceil(count(*) / {SHARD})::BIGINT AS files, count(*)::BIGINT AS declared, count(*)::BIGINT AS tokens,
  sum(tok * (pos % {SHARD} + 1))::BIGINT AS wsum,
  '["fineweb10B_byte260", ' || any_value(n) || ', "some/where", ' || any_value(own) || ', "cannot take -1 validation documents"]' AS about
FROM t, n, o GROUP BY split""",
    "train_batches_files": f"""WITH {tokens(VAL_DOCS)}, r AS (SELECT pos, tok FROM t WHERE split = 'train'),
z AS (SELECT count(*) AS total FROM r),
k AS (SELECT range AS k FROM range((SELECT (total // 4100 + 3) * 4 FROM z))),
s AS (SELECT k // 4 AS call, k % 4 AS worker, k * 1025 AS start FROM k),
v AS (SELECT call, worker, unnest(range(1025)) AS j, start FROM s),
g AS (SELECT call, worker, j, tok FROM v CROSS JOIN z JOIN r ON r.pos = (start + j) % total),
x AS (SELECT call, worker, j // 256 AS r, sum(tok)::BIGINT AS sum_x FROM g WHERE j < 1024 GROUP BY ALL),
y AS (SELECT call, worker, (j - 1) // 256 AS r, sum(tok * ((j - 1) % 256 + 1))::BIGINT AS wsum_y FROM g WHERE j >= 1 GROUP BY ALL)
SELECT call, worker, r AS row, sum_x, wsum_y FROM x JOIN y USING (call, worker, r)""",
    "results_files": """WITH e AS (SELECT *, event_id % 50 = 0 AS bad FROM events)
SELECT 'run ' || user_id AS notes, count(*)::BIGINT AS n, round(min(printf('%.6f', value)::DOUBLE), 6) AS best, sum(CASE WHEN NOT bad THEN event_id * 1000 END)::BIGINT AS bytes,
  max(event_id % 500)::BIGINT AS memory FROM e GROUP BY user_id
UNION ALL SELECT 'unreadable_result', count(*)::BIGINT, NULL, NULL, NULL FROM e WHERE bad HAVING count(*) > 0""",
    "sql_shard_pieces": f"""WITH d AS (SELECT source, doc_id, strlen(text)::BIGINT + 1 AS len FROM documents),
o AS (SELECT *, (sum(len) OVER (PARTITION BY source ORDER BY doc_id) - len)::BIGINT AS off FROM d),
c AS (SELECT *, unnest(range(off // {SQL_SHARD}, (off + len - 1) // {SQL_SHARD} + 1)) AS shard_id FROM o),
e AS (SELECT *, greatest(off, shard_id * {SQL_SHARD}) AS low, least(off + len, (shard_id + 1) * {SQL_SHARD}) AS high FROM c)
SELECT source, doc_id AS doc_ordinal, shard_id::BIGINT AS shard_id, (low % {SQL_SHARD})::BIGINT AS shard_offset, (low - off)::BIGINT AS doc_from, (high - low)::BIGINT AS n FROM e
UNION ALL SELECT 'shard_size must be a constant above 0', NULL, NULL, NULL, NULL, NULL UNION ALL SELECT 'the table lacks n_tokens', NULL, NULL, NULL, NULL, NULL""",
    "sql_windows": f"""WITH d AS (SELECT doc_id, strlen(text)::BIGINT AS total FROM documents),
s AS (
  SELECT 'all_starts' AS policy, doc_id, total, range(0, total, {STRIDE}) AS starts FROM d
  UNION ALL SELECT 'full_only', doc_id, total, range(0, greatest(total - {SEQ}, 0) + 1, {STRIDE}) FROM d
  UNION ALL SELECT 'full_first', doc_id, total, range(0, greatest(total - {SEQ} + 1, 0), {STRIDE}) FROM d
  UNION ALL SELECT 'jump', doc_id, total, [0] || range({SEQ - STRIDE}, greatest(total - {SEQ} + 1, {SEQ - STRIDE}), {STRIDE}) FROM d WHERE total >= {SEQ}
  UNION ALL SELECT 'exact_once', doc_id, total, [x for x in range(0, total, {STRIDE}) if x = 0 OR x + {SEQ - STRIDE} < total] FROM d
), w AS (SELECT policy, doc_id, total, unnest(starts)::BIGINT AS s, unnest(range(len(starts))) AS k FROM s),
x AS (SELECT *, least(s + {SEQ}, total) - s AS len FROM w)
SELECT policy, doc_id AS doc_ordinal, count(*)::BIGINT AS n, sum(s)::BIGINT AS starts, sum(len)::BIGINT AS lens,
  sum((k + 1) * CASE WHEN policy = 'full_only' THEN greatest(len - {STRIDE}, 0) WHEN s = 0 THEN 0 WHEN policy = 'all_starts' THEN greatest(len - {STRIDE}, 0) ELSE {SEQ - STRIDE} END)::BIGINT AS scores
FROM x GROUP BY policy, doc_id""",
    "board_asof": """WITH b AS (SELECT dayofyear(ts) AS day, ts, event_id AS entry, value AS score FROM events WHERE event_type = 'view'),
u AS (SELECT day, ts, max(entry) AS entry, max_by(score, entry) AS score FROM b GROUP BY ALL),
r AS (SELECT dayofyear(ts) AS day, ts, event_id, value FROM events WHERE event_type = 'purchase')
SELECT r.event_id, u.entry, u.ts AS since, round(r.value - u.score, 6) AS behind, w.entry AS entry_before
FROM r ASOF LEFT JOIN u ON r.day = u.day AND r.ts >= u.ts ASOF LEFT JOIN u AS w ON r.day = w.day AND r.ts > w.ts""",
}
