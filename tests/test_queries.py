"""Every registered query against its DuckDB form on the small tables."""

import os
import subprocess
import sys

import pytest
from harness import connect, difference

import __spark_entry__ as entry_point

# The optional training-data operators are tested in tests/llm.
QUERIES = {name: fn for name, fn in entry_point.queries().items() if name in entry_point.QUERIES}
ORACLE = dict(entry_point.ORACLE)


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_oracle_names_are_registered():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, sf, con, name):
    assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None


def test_entry(spark):
    row = entry_point.entry(spark).collect()
    assert len(row) == 1 and 0 < row[0]["bpb"] < 8


# Names whose ordering, cutting or carrying must not depend on the layout.
LAYOUT = ["shard_plan", "doc_spans", "length_buckets", "best_so_far", "ablation_delta", "board_rank", "window_coverage", "matrix_quantile"]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_result_does_not_depend_on_partitions(spark, sf, con, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        for name in LAYOUT:
            assert difference(QUERIES[name](spark, sf), con, ORACLE[name]) is None, name
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_queries_run_from_another_folder(sf, tmp_path):
    """The package reaches every Python worker, also where it is not importable."""
    root = os.path.dirname(os.path.abspath(entry_point.__file__))
    code = f"""
import importlib.util
from pyspark.sql import SparkSession
spec = importlib.util.spec_from_file_location("entry_elsewhere", {os.path.join(root, "__spark_entry__.py")!r})
module = importlib.util.module_from_spec(spec)
spec.loader.exec_module(module)
spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").getOrCreate()
assert module.queries()["shard_stream"](spark, {sf!r}).count() > 0
assert module.queries()["stream_reordered_ingest"](spark, {sf!r}).count() > 0
assert module.queries()["token_histogram"](spark, {sf!r}).count() > 0
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "fine" in done.stdout, done.stderr[-2000:]
