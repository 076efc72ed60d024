"""Run analytics: logs, metadata, boards, statistics, progress over time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import over_cap
from ..functions.stats import t_tail, t_tail_closed
from ..schema import ARTIFACT_CAP_BYTES, REQUIRED_MARGIN, REQUIRED_P
from .order import SEGMENT, Running, range_segments, scan

# --- Fixed values: log line patterns ----------------------------------------------------
POINT = (
    r"^step:(\d+)/(\d+) (train|val)_loss:([\d.]+)(?: val_bpb:([\d.]+))? "
    r"train_time:(\d+)ms step_avg:([\d.]+)ms"
)
STOP = r"^stopping_early: (\S+) train_time:(\d+)ms step:(\d+)/(\d+)"
MEMORY = r"^peak memory allocated: (\d+) MiB reserved: (\d+) MiB"
SIZE = r"^(Serialized model|Total submission size)(?: (\S+))?: (\d+) bytes(?: \(payload:(\d+) raw_torch:(\d+) payload_ratio:([\d.]+)x\))?"
CODE_SIZE = r"^Code size: (\d+) bytes"
FINAL = r"^(final_\S+) val_loss:([\d.]+) val_bpb:([\d.]+)(?: stride:(\d+))?(?: eval_time:(\d+)ms)?"
PROGRESS = r"^\s*sliding_eval \[\s*([\d.]+)%\] (\d+)/(\d+) windows running_bpb=([\d.]+)"
HEADER_PAIR = r"^[A-Za-z_][A-Za-z0-9_]*:\S+$"


def _group(pattern: str, i: int) -> Column:
    found = F.regexp_extract("line", pattern, i)
    return F.when(found != "", found)


def log_points(lines: DataFrame, keep: Sequence[str] = ("run", "file", "line_no")) -> DataFrame:
    """Typed (step, loss, …) points out of log lines; other lines are skipped."""
    g = lambda i: _group(POINT, i)
    return lines.filter(F.col("line").rlike(POINT)).select(
        *keep,
        g(1).cast("bigint").alias("step"),
        g(2).cast("bigint").alias("iterations"),
        g(3).alias("kind"),
        g(4).cast("double").alias("loss"),
        g(5).cast("double").alias("bpb"),
        g(6).cast("bigint").alias("train_time_ms"),
        g(7).cast("double").alias("step_avg_ms"),
    )


def log_facts(lines: DataFrame, keep: Sequence[str] = ("run",)) -> DataFrame:
    """(keep…, key, value) of everything that is not a step line."""
    line = F.col("line")

    def facts(pattern: str, pairs: dict[str, int], prefix: Column | None = None) -> Column:
        entries = [
            F.struct(
                (F.lit(k) if prefix is None else F.concat(prefix, F.lit(k))).alias("key"), _group(pattern, i).alias("value")
            )
            for k, i in pairs.items()
        ]
        return F.when(line.rlike(pattern), F.array(*entries))

    size_label = F.concat_ws(
        ".", F.when(_group(SIZE, 1) == "Serialized model", "model_bytes").otherwise("total_bytes"), _group(SIZE, 2)
    )
    size_entries = F.array(
        F.struct(size_label.alias("key"), _group(SIZE, 3).alias("value")),
        *[
            F.struct(F.concat(size_label, F.lit(s)).alias("key"), _group(SIZE, i).alias("value"))
            for s, i in ((".payload", 4), (".raw", 5), (".ratio", 6))
        ],
    )
    words = F.filter(F.split(F.trim(line), r"\s+"), lambda w: w.rlike(HEADER_PAIR))
    header = F.transform(
        words,
        lambda w: F.struct(
            F.substring_index(w, ":", 1).alias("key"), F.regexp_replace(w, r"^[^:]*:", "").alias("value")
        ),
    )
    entries = F.coalesce(
        facts(STOP, {"stop_reason": 1, "stop_time_ms": 2, "stop_step": 3}),
        facts(MEMORY, {"peak_mib": 1, "reserved_mib": 2}),
        F.when(line.rlike(SIZE), size_entries),
        facts(CODE_SIZE, {"code_bytes": 1}),
        facts(FINAL, {".val_loss": 2, ".val_bpb": 3, ".stride": 4, ".eval_time_ms": 5}, _group(FINAL, 1)),
        facts(PROGRESS, {"progress_pct": 1, "progress_done": 2, "progress_windows": 3, "progress_bpb": 4}),
        F.when(~line.rlike(r"^step:\d+/"), header),
    )
    return (
        lines.select(*keep, F.inline(entries))
        .filter(F.col("value").isNotNull())
        .select(*keep, "key", "value")
    )


# --- metadata ------------------------------------------------------------------------------

_TS_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd")


def parse_time(col: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(col, F.lit(f)) for f in _TS_FORMATS])


# Names one target field goes by in run metadata, best first.
FIELD_NAMES: dict[str, tuple[str, ...]] = {
    "val_loss": ("val_loss", "mean_val_loss", "val_loss_sliding"),
    "val_bpb": ("val_bpb", "mean_val_bpb"),
    "artifact_bytes": ("bytes_total", "artifact_bytes", "artifact_size_bytes", "artifact_bytes_mean"),
    "code_bytes": ("bytes_code", "code_bytes"),
    "steps": ("step_stop", "train_steps", "train_steps_mean", "steps"),
    "wallclock_s": ("wallclock_seconds", "train_time_seconds"),
    "eval_s": ("eval_time_seconds",),
}
SEED_RESULTS = "MAP<STRING, STRUCT<val_loss: DOUBLE, val_bpb: DOUBLE, steps: BIGINT, ms_per_step: DOUBLE>>"


def parse_runs(raw: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Normalise (run_dir, track, json) metadata whose keys differ from run to run.

    Numbers may be quoted or carry a comparison sign. ``corrections`` is a table
    (run_dir, field, value, reason): a value replaces the field, null clears it. Any
    metric or name can be corrected; another field is an error. Whole-number fields
    that hold a mean are rounded.
    """
    names = ["name", "run_name", "author", "github_id", "date", "track", "seeds", "seed_results", "p_value"]
    names += [n for options in FIELD_NAMES.values() for n in options]
    # "date" holds two timestamp shapes and metrics may be strings: read all as text.
    text = F.from_json("json", "STRUCT<" + ", ".join(f"`{n}`: STRING" for n in dict.fromkeys(names)) + ">")
    parsed = raw.withColumn("_j", text)

    def number(field: str, as_type: str) -> Column:
        options = [F.regexp_replace(F.col(f"_j.{n}"), r"^[<>=~ ]+", "") for n in FIELD_NAMES[field]]
        found = F.coalesce(*[o.try_cast("decimal(38,6)" if as_type == "bigint" else as_type) for o in options])
        return F.round(found).cast(as_type) if as_type == "bigint" else found

    runs = parsed.select(
        "run_dir",
        F.coalesce("_j.track", "track").alias("track"),
        F.coalesce("_j.name", "_j.run_name").alias("name"),
        F.col("_j.author").alias("author"),
        F.col("_j.github_id").alias("github_id"),
        parse_time(F.col("_j.date")).alias("ts"),
        *[number(f, "double").alias(f) for f in ("val_loss", "val_bpb")],
        *[number(f, "bigint").alias(f) for f in ("artifact_bytes", "code_bytes", "steps")],
        *[number(f, "double").alias(f) for f in ("wallclock_s", "eval_s")],
        F.from_json("_j.seeds", "ARRAY<BIGINT>").alias("seeds"),
        F.from_json("_j.seed_results", SEED_RESULTS).alias("seed_results"),
    )
    if corrections is None:
        return runs
    fields = ["name", "author", "github_id", *FIELD_NAMES]
    fields = [f for f in runs.columns if f in fields]
    unknown = F.raise_error(F.concat(F.lit("no such field to correct: "), F.col("field")))
    corrections = corrections.withColumn("field", F.when(F.col("field").isin(fields), F.col("field")).otherwise(unknown))
    # A correction table is written by hand, one row per wrong field.
    fixes = corrections.groupBy("run_dir").agg(
        F.map_from_entries(F.collect_list(F.struct("field", F.struct("value")))).alias("_fix")
    )
    runs = runs.join(fixes, "run_dir", "left")
    for field in fields:
        fixed, kind = F.col("_fix")[field], runs.schema[field].dataType
        runs = runs.withColumn(field, F.when(fixed.isNotNull(), fixed["value"].cast(kind)).otherwise(F.col(field)))
    return runs.drop("_fix")


def seed_rows(runs: DataFrame) -> DataFrame:
    """Per-seed results out of the nested map."""
    return runs.select("run_dir", F.explode("seed_results").alias("seed", "r")).select(
        "run_dir", F.col("seed").cast("bigint").alias("seed"), "r.val_loss", "r.val_bpb", "r.steps", "r.ms_per_step"
    )


def _cells(line: str) -> Column:
    """Cells of a pipe-table line; an escaped pipe is part of its cell."""
    return F.transform(F.split(F.trim(line), r"(?<!\\)\|"), lambda c: F.trim(F.replace(c, F.lit("\\|"), F.lit("|"))))


def _is_board_row(cells: Column) -> Column:
    return (F.size(cells) == 8) & F.get(cells, F.lit(2)).rlike(r"^[\d.]+$")


def check_board(lines: DataFrame) -> DataFrame:
    """(rule, detail) of every pipe-table line that ``parse_board`` cannot read: lines
    before the separator head a table and are not meant to be read; a header is told by
    its first score cell not holding a digit."""
    cells = _cells("line")
    header = ~F.coalesce(F.get(cells, F.lit(2)), F.lit("")).rlike(r"\d") & (F.size(cells) == 8)
    separator = F.trim("line").rlike(r"^\|[\s:|-]+$")
    rejected = F.trim("line").startswith("|") & ~_is_board_row(cells) & ~header & ~separator
    return lines.filter(rejected).select(F.lit("unreadable_row").alias("rule"), F.trim("line").alias("detail"))


def parse_board(lines: DataFrame) -> DataFrame:
    """Pipe-table lines (line) -> (run, score, author, summary, date, info). Lines that
    look like a row and are none are listed by ``check_board``."""
    rows = lines.select(_cells("line").alias("c")).filter(_is_board_row(F.col("c")))
    names = ["run", "score", "author", "summary", "date", "info"]
    out = rows.select(*[F.get("c", F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    link = F.regexp_extract("info", r"\((\S+)\)", 1)
    return out.withColumns(
        {
            "score": F.col("score").cast("double"),
            "date": F.to_date("date"),
            "run_dir": F.regexp_extract(link, r"([^/]+)/[^/]+$", 1),
        }
    ).drop("info")


def union_records(*frames: DataFrame) -> DataFrame:
    """Differently shaped records under each other."""
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


# --- statistics -----------------------------------------------------------------------------


def seed_stats(values: DataFrame, by: Sequence[str] = ("run",), value: str = "val_bpb") -> DataFrame:
    """Count, mean, both deviations, range per run."""
    v = F.col(value)
    return values.groupBy(*by).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std_samp"),
        F.stddev_pop(v).alias("std_pop"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        (F.max(v) - F.min(v)).alias("range"),
    )


def t_test(
    values: DataFrame,
    mu0: Column | float,
    by: Sequence[str] = ("run",),
    value: str = "val_bpb",
    side: str = "less",
    closed_form: bool = False,
) -> DataFrame:
    """One-sided one-sample t-test of each run's mean against ``mu0``.

    The p-value is a function of the aggregated row, so no group of values is
    gathered in Python. ``accepted`` is the archive's p < 0.01 rule.
    """
    stats = seed_stats(values, by, value)
    mu = F.lit(float(mu0)) if isinstance(mu0, (int, float)) else mu0
    gap = (mu - F.col("mean")) if side == "less" else (F.col("mean") - mu)
    t = F.when(F.col("std_samp") > 0, gap / (F.col("std_samp") / F.sqrt(F.col("n").cast("double"))))
    df = F.col("n") - 1
    tail = t_tail_closed if closed_form else t_tail
    out = stats.withColumn("t", t).withColumn("df", df)
    return out.withColumn("p", tail(F.col("t"), F.col("df"))).withColumn("accepted", F.col("p") < REQUIRED_P)


def required_mean(sota: float | Column, margin: float = REQUIRED_MARGIN) -> float | Column:
    """Null value a new record is tested against."""
    return sota - margin


def last_and_best(points: DataFrame, by: Sequence[str] = ("run",)) -> DataFrame:
    """Last and best value per run, and the step of the best (earliest on ties)."""
    return points.groupBy(*by).agg(
        F.max("step").alias("last_step"),
        F.max_by("bpb", "step").alias("last_bpb"),
        F.min("bpb").alias("best_bpb"),
        F.min_by("step", F.struct("bpb", "step")).alias("best_step"),
    )


def training_volume(runs: DataFrame) -> DataFrame:
    """Tokens seen, tokens per second (null for no time) and mean step time from
    (steps, batch_tokens, train_time_ms)."""
    tokens = F.col("steps") * F.col("batch_tokens")
    return runs.withColumns(
        {
            "tokens_seen": tokens,
            "tokens_per_s": tokens / (F.nullif(F.col("train_time_ms").cast("double"), F.lit(0.0)) / 1000.0),
            "ms_per_step": F.col("train_time_ms") / F.col("steps"),
        }
    )


# --- progress, ranks, deltas ------------------------------------------------------------------


def step_rate(points: DataFrame, batch_tokens: int, by: Sequence[str] = ("run",)) -> DataFrame:
    """Step time and tokens/s between neighbouring log points of a run."""
    order = [*by, "step"]
    runs = [Running("lag", "step", "_ps"), Running("lag", "train_time_ms", "_pt")]
    out = scan(range_segments(points, order), by, ["step"], runs).drop(SEGMENT)
    steps, ms = F.col("step") - F.col("_ps"), F.col("train_time_ms") - F.col("_pt")
    return out.withColumn("ms_per_step", ms / steps).withColumn(
        "tokens_per_s", F.when(ms > 0, steps * batch_tokens / (ms / 1000.0))
    ).drop("_ps", "_pt")


def best_so_far(runs: DataFrame, order: Sequence[str], value: str = "val_bpb") -> DataFrame:
    """Best earlier value and the improvement on it (the as-of join of each run with
    the record before it). ``order`` ends with a unique column."""
    segs = range_segments(runs, order)
    out = scan(
        segs, [], order,
        [Running("min", value, "best_before", inclusive=False), Running("min", value, "best_so_far")],
    ).drop(SEGMENT)
    return out.withColumn("improvement", F.col("best_before") - F.col(value)).withColumn(
        "is_record", F.col("best_before").isNull() | (F.col(value) < F.col("best_before"))
    )


def rank_runs(runs: DataFrame, value: str, key: str) -> DataFrame:
    """Board position: ``row_number`` and tie-aware ``rank`` by ascending value.

    Ties may be many: their rank is carried over segments like any other group.
    """
    order = [value, key]
    segs = range_segments(runs.withColumn("_one", F.lit(1).cast("bigint")), order)
    numbered = scan(segs, [], order, [Running("sum", "_one", "row_number")])
    return scan(numbered, [value], [key], [Running("first", "row_number", "rank")]).drop("_one", SEGMENT)


def top_runs(runs: DataFrame, value: str, key: str, k: int) -> DataFrame:
    return runs.orderBy(value, key).limit(k)


def deltas(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, base: str = "both") -> DataFrame:
    """Difference to the first row and to the row before, within each group."""
    runs = []
    if base in ("first", "both"):
        runs.append(Running("first", value, "_first"))
    if base in ("previous", "both"):
        runs.append(Running("lag", value, "_prev"))
    out = scan(range_segments(df, [*by, *order]), by, order, runs).drop(SEGMENT)
    for col, name in (("_first", "delta_first"), ("_prev", "delta_previous")):
        if col in out.columns:
            out = out.withColumn(name, F.col(value) - F.col(col)).drop(col)
    return out


def cap_status(
    runs: DataFrame, by: Sequence[str], order: Sequence[str], value: str, size: str, cap: int = ARTIFACT_CAP_BYTES
) -> DataFrame:
    """Experiment log: over the cap or no improvement -> discard, improvement -> keep,
    the last improvement of a group -> best; ``delta`` is against the best kept so far."""
    fits = runs.withColumn("_kept", F.when(~over_cap(F.col(size), cap), F.col(value)))
    segs = range_segments(fits, [*by, *order])
    out = scan(
        segs, by, order, [Running("min", "_kept", "best_before", inclusive=False), Running("least", "_kept", "_best")]
    ).drop(SEGMENT)
    improves = F.col("_kept").isNotNull() & (F.col("best_before").isNull() | (F.col("_kept") < F.col("best_before")))
    status = F.when(improves & (F.col("_kept") == F.col("_best")), "best").when(improves, "keep").otherwise("discard")
    return (
        out.withColumn("status", status)
        .withColumn("delta", F.col(value) - F.col("best_before"))
        .drop("_kept", "_best")
    )


# --- archive checks ------------------------------------------------------------------------------


def board_gaps(board: DataFrame, runs: DataFrame, key: str = "run_dir") -> DataFrame:
    """Runs on one side only: ``not_on_board`` or ``not_archived``."""
    b = board.select(key).distinct().withColumn("_b", F.lit(True))
    r = runs.select(key).distinct().withColumn("_r", F.lit(True))
    return (
        b.join(r, key, "full_outer")
        .filter(F.col("_b").isNull() | F.col("_r").isNull())
        .select(key, F.when(F.col("_b").isNull(), "not_on_board").otherwise("not_archived").alias("gap"))
    )


# What a run folder must hold.
REQUIRED_FILES = {"readme": r"^README\.md$", "metadata": r"^submission\.json$", "log": r"\.log$", "script": r"\.py$"}


def check_archive(files: DataFrame, folders: DataFrame | None = None) -> DataFrame:
    """(run_dir, missing) for every required kind of file a folder lacks.

    ``files`` has (run_dir, file_name); ``folders`` (run_dir) adds folders that hold
    nothing at all. One aggregate, no product of folders and kinds.
    """
    seen = files.select("run_dir", "file_name")
    if folders is not None:
        seen = seen.unionByName(folders.select("run_dir", F.lit("").alias("file_name")))
    kinds = seen.groupBy("run_dir").agg(
        *[F.bool_or(F.col("file_name").rlike(p)).alias(k) for k, p in REQUIRED_FILES.items()]
    )
    gaps = F.array_compact(F.array(*[F.when(~F.col(k), F.lit(k)) for k in REQUIRED_FILES]))
    return kinds.select("run_dir", F.explode(gaps).alias("missing"))


def distinct_logs(lines: DataFrame, by: Sequence[str] = ("run", "file")) -> DataFrame:
    """Logs with equal content counted once: (by…, digest, copies), the first kept.

    The digest adds up per-line hashes, so a long log is never gathered in one place.
    """
    digest = lines.groupBy(*by).agg(
        F.sum(F.xxhash64("line_no", "line").cast("decimal(38,0)")).alias("digest"), F.count(F.lit(1)).alias("n_lines")
    )
    first = F.min(F.struct(*by)).alias("k")
    return digest.groupBy("digest", "n_lines").agg(first, F.count(F.lit(1)).alias("copies")).select("k.*", "n_lines", "copies")
