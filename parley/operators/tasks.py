"""Eligibility, send targets and texts of scheduled tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import validity_state
from parley.functions.ordered import first_per_key, id_block, split_large_groups
from parley.functions.values import blank, or_else, raw_json, send_delay_ms


def with_validity(tasks: DataFrame, as_of) -> DataFrame:
    """Tasks with their state against `as_of`."""
    state = validity_state(F.col("start_date"), F.col("end_date"), as_of)
    return tasks.withColumn("validity", state)


# Verdicts that fail a run; the other ones end it quietly.
FAILING = ("friend_missing", "friend_inactive", "friend_ai_off")


def task_eligibility(
    tasks: DataFrame, friends: DataFrame, as_of, due: DataFrame | None = None
) -> DataFrame:
    """Whether each task may run, as `verdict`: `ok` or the first reason against it.

    `due` holds the `task_id`s that fire; without it all tasks are judged.
    Rows carry the contact's fields that sending needs.
    """
    state = validity_state(F.col("start_date"), F.col("end_date"), as_of)
    contact = friends.select(
        F.col("id").alias("friend_id"),
        F.lit(True).alias("_friend"),
        F.col("is_active").alias("_friend_active"),
        F.col("ai_active").alias("_friend_ai"),
        "wxid",
        "account_id",
        F.col("my_remark").alias("friend_remark"),
    )
    known = tasks.withColumnRenamed("id", "task_id").withColumn("_task", F.lit(True))
    if due is not None:
        known = due.select("task_id").join(known, "task_id", "left")

    def is_not_one(column: Column) -> Column:
        return ~F.coalesce(column == 1, F.lit(False))

    verdict = (
        F.when(F.col("_task").isNull(), F.lit("task_missing"))
        .when(is_not_one(F.col("is_active")), F.lit("task_inactive"))
        .when(state != 1, F.lit("out_of_range"))
        .when(F.col("_friend").isNull(), F.lit("friend_missing"))
        .when(is_not_one(F.col("_friend_active")), F.lit("friend_inactive"))
        .when(is_not_one(F.col("_friend_ai")), F.lit("friend_ai_off"))
        .otherwise(F.lit("ok"))
    )
    return (
        known.join(contact, "friend_id", "left")
        .withColumn("verdict", verdict)
        .drop("_task", "_friend", "_friend_active", "_friend_ai")
    )


def run_outcomes(eligible: DataFrame) -> DataFrame:
    """Runs that end in the log: `ok` ones, and those failed by their contact."""
    logged = eligible.where(F.col("verdict").isin("ok", *FAILING))
    outcome = F.when(F.col("verdict") == "ok", F.lit("ok")).otherwise(F.lit("failed"))
    return logged.withColumn("outcome", outcome)


def task_messages(eligible: DataFrame) -> DataFrame:
    """What to send for tasks that may run, and after which delay."""
    greeting = F.when(
        ~blank(F.col("friend_remark")), F.concat("friend_remark", F.lit("，"))
    ).otherwise(F.lit(""))
    return eligible.where(F.col("verdict") == "ok").select(
        "task_id",
        "account_id",
        "wxid",
        F.concat(greeting, F.coalesce("task_name", F.lit("null"))).alias("content"),
        send_delay_ms(F.col("task_id")).alias("delay_ms"),
    )


def resolve_targets(
    requests: DataFrame, tasks: DataFrame, friends: DataFrame, accounts: DataFrame
) -> DataFrame:
    """Contact and sending account of send requests.

    Requests have `request_id, task_id, account_id, wxid`. With an account the
    contact is the account's contact of that name; without, task, contact and
    account follow from the task.
    """
    by_task = (
        requests.where(F.col("account_id").isNull())
        .select("request_id", "task_id", "wxid")
        .join(tasks.select(F.col("id").alias("task_id"), "friend_id"), "task_id", "left")
        .join(
            friends.select(F.col("id").alias("friend_id"), "account_id"), "friend_id", "left"
        )
    )
    contacts = friends.select("account_id", "wxid", F.col("id").alias("friend_id"))
    contacts = first_per_key(
        contacts.where(F.col("account_id").isNotNull()), ["account_id", "wxid"], ["friend_id"]
    )
    by_account = (
        requests.where(F.col("account_id").isNotNull())
        .select("request_id", "task_id", "wxid", "account_id")
        .join(contacts, ["account_id", "wxid"], "left")
    )
    sender = accounts.select(
        F.col("id").alias("account_id"), F.col("auth_key"), F.col("wx_id").alias("sender_wxid")
    )
    columns = ["request_id", "task_id", "wxid", "friend_id", "account_id"]
    found = by_task.select(*columns).unionByName(by_account.select(*columns))
    return found.join(sender, "account_id", "left").select(*columns, "auth_key", "sender_wxid")


# Columns of a task as a prompt lists it.
TASK_LIST_COLUMNS = (
    "id", "friend_id", "cron_expression", "task_name", "is_active", "end_date", "start_date",
)


def active_task_items(tasks: DataFrame) -> DataFrame:
    """Active tasks, each as JSON text: `friend_id, id, item`."""
    return tasks.where(F.col("is_active") == 1).select(
        "friend_id", "id", raw_json(F.struct(*TASK_LIST_COLUMNS)).alias("item")
    )


def active_task_json(tasks: DataFrame, size: int | None = None) -> DataFrame:
    """The active tasks of each contact as JSON list items in id order.

    `items` is the inside of the list, in one row per contact. Only if a `size` is
    asked for, a contact with more tasks comes in several rows by `part`, to be
    joined with commas.
    """
    parts = split_large_groups(
        active_task_items(tasks), ["friend_id"], [id_block("id", size)], size
    )
    return parts.groupBy("friend_id", "part").agg(
        F.count(F.lit(1)).alias("task_count"),
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct("id", "item"))), lambda x: x["item"]
            ),
            ",",
        ).alias("items"),
    )


def display_remark() -> Column:
    return or_else(F.col("my_remark"), F.lit(""))
