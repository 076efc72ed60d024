"""Shape of the physical plans the operators are meant to have."""

import re

import pytest

import __spark_entry__ as entry_point
from corpusloom.plans import tables

QUERIES = entry_point.queries()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Everything whose plan can be inspected without running a stream.
STATIC = sorted(set(QUERIES) - {"stream_log_best", "stream_ingest_stats", "shard_stream", "bpe_merges", "bpe_vocabulary"})


@pytest.mark.parametrize("name", STATIC)
def test_no_product_and_no_row_udf(spark, sf, name):
    text = plan_of(QUERIES[name](spark, sf))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "BatchEvalPython" not in text
    assert "FlatMapGroupsInPandas" not in text and "AggregateInPandas" not in text


def scanned(df):
    return re.findall(r"ReadSchema: struct<([^>]*)", plan_of(df))


def test_scans_read_only_what_they_need(spark, sf):
    assert set(scanned(QUERIES["split_stats"](spark, sf))) == {"doc_id:bigint,text:string"}
    assert set(scanned(QUERIES["seed_stats"](spark, sf))) == {"user_id:bigint,value:double"}
    assert set(scanned(QUERIES["board_rank"](spark, sf))) == set()  # behind a checkpoint
    assert set(scanned(QUERIES["last_and_best"](spark, sf))) == {"event_id:bigint,user_id:bigint,value:double"}


def test_filters_reach_the_scan(spark, sf):
    text = plan_of(QUERIES["record_union"](spark, sf))
    assert "EqualTo(event_type,view)" in text and "EqualTo(event_type,click)" in text


def test_running_offsets_shuffle_wide_rows_once(spark, sf):
    from pyspark.sql import functions as F

    from corpusloom.operators.shards import place
    from corpusloom.operators.tokenizers import byte_length

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = tables.table(spark, sf, "documents").select(F.col("doc_id").alias("doc_ordinal"), "text")
        text = plan_of(place(docs.withColumn("n_tokens", byte_length(F.col("text"))), 100))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # Without any broadcast the rows with text still cross one exchange only.
    lines = text.splitlines()
    wide = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line and any("text#" in x for x in lines[i + 1 : i + 2])]
    assert len(wide) == 1


def test_single_task_windows_see_bucket_totals_only(spark, sf):
    for name in ("shard_plan", "placed_documents", "length_buckets"):
        lines = plan_of(QUERIES[name](spark, sf)).splitlines()
        for i, line in enumerate(lines):
            if "Exchange SinglePartition" in line:
                assert "HashAggregate" in lines[i + 1], (name, lines[i + 1])


SCANNED = ["board_rank", "best_so_far", "ablation_delta", "cap_status", "step_rate", "running_bpb"]


@pytest.mark.parametrize("name", SCANNED)
def test_a_scan_does_not_move_rows_behind_its_checkpoint(spark, sf, name):
    text = plan_of(QUERIES[name](spark, sf))
    assert "ExistingRDD" in text and "MapInArrow" in text
    assert "Exchange" not in text and "Window" not in text


def test_segments_follow_the_input(spark):
    from corpusloom.operators.order import range_segments

    rows = spark.range(0, 4000, 1, 40)
    assert range_segments(rows, ["id"]).rdd.getNumPartitions() == 40
