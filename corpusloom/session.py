"""Session settings and the durable scratch area shared by all executors."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Settings the operators rely on. Parallelism knobs are left to the cluster.
ENGINE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Documents are long: small Arrow batches keep Python workers' memory flat.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(64 << 20),
    # Lets the token-shard reader skip whole files on split / shard_id filters.
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build_session(master: str | None = None, app: str = "corpusloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's checkpoint directory.

    Only a local master may fall back to a temporary folder; on a cluster a
    machine-local folder would lose data with the executor that wrote it.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = os.path.join(tempfile.gettempdir(), f"corpusloom-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", configured)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(configured)
    return configured.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh, never reused path below the shared scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` as Spark's own readers and writers resolve it: a full URI on the default
    file system. On a cluster a machine-local folder is refused, unless it lies in the
    folder that is configured as shared."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString()
    shared = spark.conf.get("spark.checkpoint.dir", None)
    inside = shared and f"{uri}/".startswith(qualified_root(spark, shared))
    if uri.startswith("file:") and not spark.sparkContext.master.startswith("local") and not inside:
        raise ValueError(f"{uri} is local to each machine; give a folder that all executors share")
    return uri


def qualified_root(spark: SparkSession, path: str) -> str:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(target).toString().rstrip("/") + "/"


def durable(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage."""
    scratch_root(df.sparkSession)
    return df.checkpoint(eager=True)


def small_side(df: DataFrame) -> DataFrame:
    """A join side written as a table, so Spark knows its size in bytes and decides by
    it whether to send it to all tasks. Computed once."""
    path = scratch_path(df.sparkSession, "side")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def default_parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores when the input has fewer splits than there are cores.

    A table of many splits passes through untouched, so nothing is shuffled where
    the data is large. Rows are placed by key, which stays the same when a task is
    run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, *keys)


def prepare(spark: SparkSession) -> SparkSession:
    """Bring a session somebody else made into the state the operators need: engine
    settings that are still unset, and the package on every Python worker."""
    for key in ("spark.sql.session.timeZone", "spark.sql.python.filterPushdown.enabled"):
        spark.conf.set(key, ENGINE_CONF[key])
    # What somebody has set, stays.
    chosen = spark.conf.getAll
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        if key not in chosen:
            spark.conf.set(key, ENGINE_CONF[key])
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not root.endswith(".zip"):
        base = os.path.join(tempfile.mkdtemp(prefix="corpusloom-"), "corpusloom")
        sc.addPyFile(shutil.make_archive(base, "zip", root, "corpusloom"))
    sc._corpusloom_shipped = True
