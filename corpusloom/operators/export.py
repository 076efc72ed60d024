"""Documents and tokenizer specs to shards, statistics and manifest, as one transaction."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dataset_name
from ..schema import DATASET, SHARD_PREFIX, SHARD_SIZE, TOKENIZER
from ..session import durable, qualified
from ..sources.commits import filesystem, put_file
from ..sources.docs import resolve_counts
from ..sources.manifest import manifest_json, spec_json
from ..sources.token_shards import shard_files, shard_sizes, write_shards
from .checks import check_unique, fail_on
from .shards import export_plan
from .tokenizers import check_vocab_size, resolve_specs, tokenizer_factory

MANIFEST = "manifest.json"


def export_corpus(
    docs: DataFrame,
    specs: DataFrame,
    root: str,
    *,
    num_val_docs: int | None = None,
    shard_size: int = SHARD_SIZE,
    sidecar: DataFrame | None = None,
    sidecar_path: str | None = None,
    docs_jsonl: str = "",
    repo_id: str | None = None,
    remote_root: str | None = None,
    skip_byte: bool = False,
    prefix: str = SHARD_PREFIX,
) -> str:
    """Export ``docs`` (doc_ordinal, text) once for every tokenizer of ``specs``; returns the
    manifest's path.

    Every export writes its datasets to a folder of its own below ``root``; replacing
    ``manifest.json`` is the last step and the only one that readers see. If the job
    dies before, the manifest and the shards it names are as they were. The datasets
    that the replaced manifest names stay until the next export.

    A byte spec needs nothing; any other tokenizer must be registered under the
    spec's resolved name. A declared number of documents that differs from those
    exported is an error, and so are tokenizers or datasets of the same name.
    """
    spark = docs.sparkSession
    root = qualified(spark, root)
    total, val = resolve_counts(docs, sidecar if sidecar is not None else docs.limit(0).select(*[F.lit(None).cast("bigint").alias(c) for c in ("num_docs", "docs_val")]), num_val_docs)
    resolved = durable(resolve_specs(specs, skip_byte=skip_byte))
    named = resolved.withColumn("dataset_name", dataset_name(F.col("dataset_suffix")))
    fail_on(check_vocab_size(resolved))
    fail_on(check_unique(named, ["name"], "duplicate tokenizer name"))
    fail_on(check_unique(named, ["dataset_name"], "duplicate dataset name"))
    export = uuid.uuid4().hex
    datasets, tokenizers = [], []
    # A handful of tokenizers; the corpus stays distributed.
    for spec in named.orderBy("name").collect():
        key = "pure_byte_260" if spec["kind"] == "byte" else spec["name"]
        tok = tokenizer_factory(key)()
        folder = f"{root}/datasets/{spec['dataset_name']}/{export}"
        pieces, counted = export_plan(docs, val, shard_size, key)
        done = {r["split"]: r for r in counted.collect()}
        n_docs = {s: done[s]["docs"] if s in done else 0 for s in ("val", "train")}
        if sum(n_docs.values()) != total:
            raise ValueError(f"doc_count: expected {total} docs, exported {sum(n_docs.values())}")
        write_shards(pieces, folder, prefix)
        files = {r["split"]: (r["files"], r["tokens"]) for r in shard_sizes(spark, folder, prefix).groupBy("split").agg(F.count(F.lit(1)).alias("files"), F.sum("n_tokens").alias("tokens")).collect()}
        stats = {"docs_total": total}
        for s in ("val", "train"):
            stats |= {f"docs_{s}": n_docs[s], f"files_{s}": files.get(s, (0, 0))[0], f"tokens_{s}": files.get(s, (0, 0))[1]}
            if stats[f"tokens_{s}"] != (done[s]["tokens"] if s in done else 0):
                raise ValueError(f"shards of {s} hold {stats[f'tokens_{s}']} tokens, planned were {done[s]['tokens']}")
        stats |= {f"{what}_total": stats[f"{what}_val"] + stats[f"{what}_train"] for what in ("files", "tokens")}
        at = shard_files(spark, folder)
        common = {"vocab_size": spec["vocab_size"], "bos_id": tok.bos_id, "eos_id": tok.eos_id, "recommended_bigram_vocab_size": spec["recommended_bigram_vocab_size"]}
        datasets.append({
            "name": spec["dataset_name"], "tokenizer_name": spec["name"], "tokenizer_kind": spec["kind"], "path": at,
            "train_glob": f"{at}/{prefix}_train_*.bin", "val_glob": f"{at}/{prefix}_val_*.bin", **common, "stats": stats,
        })
        tokenizers.append({"name": spec["name"], "kind": spec["kind"], **common, "source_spec": None, **tok.manifest})
    if not datasets:
        raise ValueError("no tokenizer is left to export with")
    given = {r["name"]: r["spec"] for r in specs.select("name", spec_json(specs).alias("spec")).collect()}
    for t in tokenizers:
        t["source_spec"] = given.get(t["name"])
    body = manifest_json(
        spark.createDataFrame(datasets, DATASET), spark.createDataFrame(tokenizers, TOKENIZER), root=root, num_docs=total, num_val_docs=val,
        shard_size=shard_size, docs_jsonl=docs_jsonl, specs=specs, sidecar=sidecar, sidecar_path=sidecar_path, repo_id=repo_id, remote_root=remote_root,
    ).first()["value"]
    _commit(root, body)
    return f"{root}/{MANIFEST}"


def _exports(body: str) -> set[str]:
    """Export folders that a manifest names, relative to the root."""
    return {"/".join(d["path"].split("/")[:3]) for d in json.loads(body)["datasets"]}


def _commit(root: str, body: str) -> None:
    """Replace the manifest; then drop what only the manifest before the replaced one names."""
    system, at = filesystem(root)

    def text(path: str) -> str | None:
        if system.get_file_info(path).type != pafs.FileType.File:
            return None
        with system.open_input_file(path) as f:
            return f.read().decode()

    path, earlier = f"{at}/{MANIFEST}", f"{at}/_manifests/replaced.json"
    replaced, oldest = text(path), text(earlier)
    put_file(system, path, body.encode())
    if replaced is None:
        return
    alive = _exports(body) | _exports(replaced)
    for folder in (_exports(oldest) if oldest else set()) - alive:
        if system.get_file_info(f"{at}/{folder}").type == pafs.FileType.Directory:
            system.delete_dir(f"{at}/{folder}")
    put_file(system, earlier, replaced.encode())
