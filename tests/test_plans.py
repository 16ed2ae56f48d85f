"""What the physical plans must and must not contain."""

import re

import pytest
from pyspark.sql import functions as F

from parley.functions.ordered import broadcast_if_small
from parley.operators.changes import apply_patch
from parley.plans.queries import QUERIES
from tests.conftest import SF_DIR


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(
        frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


BATCH = [n for n in QUERIES if not n.startswith("stream_")]
@pytest.mark.parametrize("name", BATCH)
def test_no_pairing_and_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF_DIR))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["hourly_messages"](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts,2024-01-29T12:30)" in plan
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan


def test_bursts_take_one_shuffle(spark):
    plan = plan_of(QUERIES["merge_bursts"](spark, SF_DIR))
    assert len(re.findall(r"\+- Exchange", plan)) == 1


@pytest.mark.parametrize("name", ["validity_state", "expire_members", "next_fire", "cron_fires", "repair_json"])
def test_row_wise_operators_do_not_shuffle(spark, name):
    assert "Exchange" not in plan_of(QUERIES[name](spark, SF_DIR))


def test_a_reply_is_repaired_once(spark):
    for name in ("repair_json", "reply_messages", "reply_task_ops", "reply_summaries"):
        assert plan_of(QUERIES[name](spark, SF_DIR)).count("json_object_keys") <= 4


def test_tables_are_not_broadcast_by_hint(spark):
    """With automatic broadcast off, joins of whole tables are not broadcast."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("task_eligibility", "patch_members", "resolve_targets",
                     "set_message_status", "burst_status", "schedule_diff"):
            assert "BroadcastHashJoin" not in plan_of(QUERIES[name](spark, SF_DIR)), name
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_broadcast_depends_on_a_count(spark):
    df = spark.range(50)
    other = spark.range(50).withColumnRenamed("id", "k")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small = other.join(broadcast_if_small(df, 50), F.col("id") == F.col("k"))
        large = other.join(broadcast_if_small(df, 49), F.col("id") == F.col("k"))
        assert "BroadcastHashJoin" in plan_of(small) and "BroadcastHashJoin" not in plan_of(large)
        patches = broadcast_if_small(df.withColumn("v", F.lit(1)).withColumn("seq", F.lit(1)))
        table = spark.range(60).withColumn("v", F.lit(0))
        assert "BroadcastHashJoin" in plan_of(apply_patch(table, patches, "id", ["v"], seq="seq"))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
