"""Lists, prompts and log rows keep one row a key beyond ten thousand rows."""

import duckdb
from pyspark.sql import functions as F

from parley.operators import listings, prompts, tasks
from parley.plans.oracle import ORACLE
from parley.plans.queries import QUERIES

MANY = 20_050


def test_a_long_exchange_is_one_log_row(spark, tmp_path):
    turns = spark.range(MANY).select(
        F.lit(7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") < 10_000, "first").otherwise("later").alias("role"),
        F.format_string("t%d", "id").alias("text"),
    )
    short = turns.where("turn < 3").withColumn("conv_id", F.lit(8).cast("long"))
    turns.unionByName(short).write.parquet(str(tmp_path / "conversations.parquet"))
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    frame = QUERIES["exchange_log_rows"](spark, str(tmp_path))
    cursor = duck.execute(ORACLE["exchange_log_rows"])
    columns = [d[0] for d in cursor.description]
    want = sorted(cursor.fetchall())
    assert sorted(tuple(r) for r in frame.select(*columns).collect()) == want and len(want) == 2


def test_lists_of_many_tasks_are_one_row(spark):
    many = spark.range(MANY).select(
        F.col("id").cast("int").alias("id"), F.lit(1).alias("friend_id"),
        F.lit("0 0 8 * * *").alias("cron_expression"), F.lit("t").alias("task_name"),
        F.lit(1).alias("is_active"), F.lit("").alias("end_date"), F.lit(None).cast("string").alias("start_date"),
    )
    (listed,) = tasks.active_task_json(many).collect()
    assert (list(listed.part), listed.task_count, listed["items"].count('"id":')) == ([], MANY, MANY)
    friends = spark.createDataFrame([(1, "a")], "id int, nickname string")
    (nested,) = listings.friends_with_tasks(friends, many).collect()
    assert (list(nested.part), [t.id for t in nested.tasks]) == ([], list(range(MANY)))


def test_prompts_of_many_turns_are_one_row(spark):
    turns = spark.range(MANY).select(
        F.lit(1).alias("request_id"), F.lit(0).alias("section"), (F.col("id") * 100).alias("create_time"),
        F.col("id").alias("message_id"), F.array().cast("array<bigint>").alias("piece"),
        F.lit("user").alias("role"), F.format_string("t%d", "id").alias("content"),
    )
    (packed,) = prompts.packed_prompts(turns).collect()
    assert list(packed.part) == [] and [t.content for t in packed.turns] == [f"t{n}" for n in range(MANY)]


def test_a_system_text_with_many_lists_is_one_row(spark):
    filled = spark.createDataFrame([(1, 1, [], "A {{task_list}} B")], "request_id int, friend_id int, piece array<long>, prompt string")
    many = spark.range(MANY).select(
        F.col("id").cast("int").alias("id"), F.lit(1).alias("friend_id"),
        *(F.lit("").alias(c) for c in ("cron_expression", "task_name", "end_date", "start_date")),
        F.lit(1).alias("is_active"),
    )
    lists = tasks.active_task_json(many).select("friend_id", "part", "items")
    (row,) = prompts._insert_lists(filled, lists, "friend_id", "task_list").collect()
    assert row.prompt.startswith("A [{") and row.prompt.endswith("}] B") and row.prompt.count('"id":') == MANY
