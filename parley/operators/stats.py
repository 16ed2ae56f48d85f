"""Counts, time series and distributions of messages and tasks (A*, J2, U1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import hours_before, moment
from parley.functions.values import literal_map
from parley.operators.filters import with_pair_key


def overview_counts(friends: DataFrame, accounts: DataFrame, messages: DataFrame) -> DataFrame:
    """Totals for the overview: contacts, accounts online, messages, messages sent (A1)."""
    people = friends.agg(F.count(F.lit(1)))
    online = accounts.agg(F.count("onlineTime"))
    talk = messages.agg(
        F.count(F.lit(1)).alias("messages_all"),
        F.count_if(F.col("type") == 1).alias("messages_sent"),
    )
    return talk.select(
        people.scalar().alias("friends"), online.scalar().alias("online"), "*"
    )


def day_spine(df: DataFrame, as_of, days: int) -> DataFrame:
    """The `days` dates up to `as_of`, one row each, as `stat_date`."""
    back = df.sparkSession.range(0, days, 1, 1)
    return back.select(F.date_sub(F.to_date(moment(as_of)), F.col("id").cast("int")).alias("stat_date"))


def with_day_spine(stats: DataFrame, as_of, days: int) -> DataFrame:
    """All days with their counts, 0 where there are none, newest first.

    `stats` has at most one row per day of the spine.
    """
    counts = [c for c in stats.columns if c != "stat_date"]
    return (
        day_spine(stats, as_of, days)
        .join(F.broadcast(stats), "stat_date", "left")
        .select("stat_date", *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])
        .orderBy(F.desc("stat_date"))
    )


def _by_day(df: DataFrame, time: str, as_of, days: int, *counts: Column) -> DataFrame:
    today = F.to_date(moment(as_of))
    first = F.date_sub(today, days - 1).cast("timestamp_ntz")
    # Days after `as_of` are not in the spine: leaving them out early keeps one row per day.
    end = F.date_add(today, 1).cast("timestamp_ntz")
    in_range = df.where((F.col(time) >= first) & (F.col(time) < end))
    return in_range.groupBy(F.to_date(time).alias("stat_date")).agg(*counts)


def daily_messages(messages: DataFrame, as_of, days: int = 20) -> DataFrame:
    """Per day: messages by AI and messages sent (A2)."""
    stats = _by_day(
        messages, "create_at", as_of, days,
        F.count_if(F.col("is_ai") == 1).alias("ai_msg_count"),
        F.count_if(F.col("type") == 1).alias("total_msg_count"),
    )
    return with_day_spine(stats, as_of, days)


def daily_tasks(tasks: DataFrame, as_of, days: int = 20) -> DataFrame:
    """Per day: new tasks (A3)."""
    stats = _by_day(
        tasks, "create_time", as_of, days, F.count(F.lit(1)).alias("new_task_count")
    )
    return with_day_spine(stats, as_of, days)


def _hour_spine(df: DataFrame, as_of, oldest: int, newest: int) -> DataFrame:
    """Hour starts from `oldest` to `newest` hours before `as_of`."""
    back = df.sparkSession.range(newest, oldest + 1, 1, 1)
    return back.select(
        F.date_trunc("hour", hours_before(as_of, F.col("id"))).cast("timestamp_ntz").alias("hour_start")
    )


def _by_hour(df: DataFrame, time: str, as_of, hours: int, *counts: Column) -> DataFrame:
    start = F.date_trunc("hour", F.col(time)).cast("timestamp_ntz")
    # Hours after the one of `as_of` have no label, so no result row.
    end = F.date_trunc("hour", moment(as_of)).cast("timestamp_ntz") + F.expr("INTERVAL '1' HOUR")
    in_range = df.where((F.col(time) >= hours_before(as_of, hours)) & (F.col(time) < end))
    return in_range.groupBy(start.alias("hour_start")).agg(*counts)


def hourly_messages(messages: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Per hour before the current one: all messages and messages by AI (A4).

    The cut-off is exactly `hours` before `as_of`, so the first hour is partial.
    """
    stats = _by_hour(
        messages, "create_at", as_of, hours,
        F.count(F.lit(1)).alias("message_count"),
        F.count_if(F.col("is_ai") == 1).alias("ai_count"),
    )
    return (
        _hour_spine(messages, as_of, hours, 1)
        .join(F.broadcast(stats), "hour_start", "left")
        .select(
            "hour_start",
            F.date_format("hour_start", "MM-dd HH:mm").alias("label"),
            F.coalesce("message_count", F.lit(0)).alias("message_count"),
            F.coalesce("ai_count", F.lit(0)).alias("ai_count"),
        )
        .orderBy("hour_start")
    )


def message_summary(hourly: DataFrame) -> DataFrame:
    """Totals over the hours and the share of AI messages, 0 without messages."""
    totals = hourly.agg(
        F.coalesce(F.sum("message_count"), F.lit(0)).alias("total_messages"),
        F.coalesce(F.sum("ai_count"), F.lit(0)).alias("ai_messages"),
    )
    ratio = F.coalesce(F.try_divide("ai_messages", "total_messages"), F.lit(0.0))
    return totals.withColumn("ai_message_ratio", ratio)


def hourly_tasks(tasks: DataFrame, as_of, hours: int = 3) -> DataFrame:
    """Per hour up to the current one: tasks created and executions of tasks last run then (A5)."""
    created = _by_hour(
        tasks, "create_time", as_of, hours, F.count(F.lit(1)).alias("created")
    )
    executed = _by_hour(
        tasks, "last_execution_time", as_of, hours,
        F.sum("execution_count").cast("long").alias("executions"),
    )
    return (
        _hour_spine(tasks, as_of, hours, 0)
        .join(F.broadcast(created), "hour_start", "left")
        .join(F.broadcast(executed), "hour_start", "left")
        .select(
            "hour_start",
            F.date_format("hour_start", "HH:mm").alias("label"),
            F.coalesce("created", F.lit(0)).alias("created"),
            F.coalesce("executions", F.lit(0)).alias("executions"),
        )
        .orderBy("hour_start")
    )


# Codes of the message kinds that have their own name, and the
# labels kinds and task states are shown with.
MESSAGE_KINDS = {1: "text", 3: "image", 34: "voice"}
KIND_LABELS = {"text": "文本", "image": "图片", "voice": "语音", "other": "其他"}
STATUS_LABELS = {
    "running": "执行中", "pending": "待启动", "finished": "已结束", "inactive": "未激活",
}


def with_labels(df: DataFrame, column: str, labels: dict[str, str]) -> DataFrame:
    """Codes with the label they are shown with, as `label`."""
    return df.withColumn("label", F.try_element_at(literal_map(labels), F.col(column)))


def message_kind(msg_type: Column) -> Column:
    named = F.lit(None).cast("string")
    for code, name in MESSAGE_KINDS.items():
        named = F.when(msg_type == code, F.lit(name)).otherwise(named)
    return F.coalesce(named, F.lit("other"))


def message_kind_distribution(messages: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Messages of the last hours by kind."""
    recent = messages.where(F.col("create_at") >= hours_before(as_of, hours))
    return recent.groupBy(message_kind(F.col("msg_type")).alias("kind")).agg(
        F.count(F.lit(1)).alias("message_count")
    )


def task_status(is_active: Column, last_run: Column, runs: Column) -> Column:
    return (
        F.when((is_active == 1) & last_run.isNotNull(), F.lit("running"))
        .when((is_active == 1) & last_run.isNull(), F.lit("pending"))
        .when((is_active == 0) & (runs > 0), F.lit("finished"))
        .otherwise(F.lit("inactive"))
    )


def task_status_distribution(tasks: DataFrame) -> DataFrame:
    """Tasks by state."""
    state = task_status(
        F.col("is_active"), F.col("last_execution_time"), F.col("execution_count")
    )
    return tasks.groupBy(state.alias("task_status")).agg(F.count(F.lit(1)).alias("task_count"))


def conversation_volume(messages: DataFrame) -> DataFrame:
    """Messages, first and last time per conversation, both directions together."""
    return (
        with_pair_key(messages)
        .groupBy("party_low", "party_high")
        .agg(
            F.count(F.lit(1)).alias("message_count"),
            F.min("create_at").alias("first_at"),
            F.max("create_at").alias("last_at"),
        )
    )
