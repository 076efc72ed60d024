"""Row shapes and the fixed values of the corpus and run-archive formats."""

from __future__ import annotations

# --- Fixed values: token shard file format -------------------------------------
SHARD_MAGIC = 20240520
SHARD_VERSION = 1
SHARD_HEADER_WORDS = 256
SHARD_HEADER_BYTES = SHARD_HEADER_WORDS * 4
SHARD_TOKEN_BYTES = 2
SHARD_PREFIX = "fineweb"
SHARD_SIZE = 100_000_000
MAX_VOCAB_SIZE = 65_536

# --- Fixed values: corpus defaults ----------------------------------------------
CORPUS_VERSION = "10B"
DATASET_PREFIX = "fineweb10B_"
DEFAULT_VAL_DOCS = 50_000
ENCODE_BATCH_ROWS = 1024
DEFAULT_TRAIN_SHARDS = 80

# --- Fixed values: byte vocabulary ------------------------------------------------
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
UNK_ID = 3
BYTE_OFFSET = 4
BYTE_VOCAB_SIZE = 260
SPACE_MARK = "▁"

# --- Fixed values: matrix compression ----------------------------------------------
CONTROL_NAME_PATTERNS = (
    "attn_scale",
    "attn_scales",
    "mlp_scale",
    "mlp_scales",
    "resid_mix",
    "resid_mixes",
    "q_gain",
    "skip_weight",
    "skip_weights",
)
KEEP_FLOAT_MAX_NUMEL = 65_536
CLIP_QUANTILE = 99.99984 / 100.0
CLIP_CANDIDATES = (0.999, 0.9995, 0.9999, 0.99999, 1.0)
PRUNE_QUANTILE = 0.03
ABSMAX_FLOOR = 1e-12
FP16_SMALLEST_NORMAL = 2.0**-14

# --- Fixed values: run rules ---------------------------------------------------------
ARTIFACT_CAP_BYTES = 16_000_000
REQUIRED_MARGIN = 0.005
REQUIRED_P = 0.01
EMA_DECAY = 0.997
COOLDOWN_FRACTION = 0.2

# --- Row shapes -------------------------------------------------------------------------
DOCS = "doc_ordinal BIGINT, text STRING"
SIDECAR = "num_docs BIGINT, docs_val BIGINT, shuffle_seed BIGINT, docs_sha256 STRING"
SPEC = (
    "name STRING, kind STRING, builder STRING, dataset_suffix STRING, vocab_size BIGINT, "
    "reuse_model_path STRING, tokenizer_train_docs BIGINT, trainer_overrides MAP<STRING,STRING>, "
    "model_prefix STRING, filename STRING"
)
VOCAB = "token_id INT, piece STRING, kind STRING"
SHARD_ROWS = (
    "split STRING, shard_id INT, block_offset BIGINT, shard_tokens BIGINT, tokens ARRAY<INT>"
)
STATS = (
    "docs_total BIGINT, docs_val BIGINT, docs_train BIGINT, files_total BIGINT, files_val BIGINT, "
    "files_train BIGINT, tokens_total BIGINT, tokens_val BIGINT, tokens_train BIGINT"
)
DATASET = (
    "name STRING, tokenizer_name STRING, tokenizer_kind STRING, path STRING, train_glob STRING, "
    "val_glob STRING, vocab_size BIGINT, bos_id BIGINT, eos_id BIGINT, "
    f"recommended_bigram_vocab_size BIGINT, stats STRUCT<{STATS.replace(' BIGINT', ': BIGINT')}>"
)
TOKENIZER = (
    "name STRING, kind STRING, vocab_size BIGINT, bos_id BIGINT, eos_id BIGINT, "
    "recommended_bigram_vocab_size BIGINT, source_spec STRING, path STRING, model_path STRING, "
    "vocab_path STRING, pad_id BIGINT, unk_id BIGINT"
)
RESULTS = "val_bpb DOUBLE, artifact_bytes BIGINT, memory_mb BIGINT, notes STRING"
MATRIX_ROWS = "tensor STRING, row_id INT, values ARRAY<FLOAT>"


def as_struct(fields: str) -> str:
    """``a INT, b STRING`` -> ``STRUCT<a: INT, b: STRING>`` for flat field lists."""
    depth, out, current = 0, [], ""
    for ch in fields:
        depth += ch == "<"
        depth -= ch == ">"
        if ch == "," and depth == 0:
            out.append(current.strip())
            current = ""
        else:
            current += ch
    out.append(current.strip())
    return "STRUCT<" + ", ".join(f.replace(" ", ": ", 1) for f in out) + ">"
