"""Listings with owners, tasks, counts and redaction."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import from_epoch, local_time, time_text
from parley.functions.ordered import id_block, is_small, no_part, split_large_groups
from parley.functions.values import raw_json
from parley.operators.calendar import describe_cron
from parley.operators.filters import apply_filters, paginate, search_contains

# Fixed value: shown in place of a login time of 0.
NEVER_LOGGED_IN = "还没登录过"

FLAGS = ("is_active", "ai_active", "ai_reply")


def flags_as_text(df: DataFrame, flags=FLAGS) -> DataFrame:
    """Numeric flags as text, for output."""
    return df.withColumns({c: F.col(c).cast("string") for c in flags if c in df.columns})


def with_owner(friends: DataFrame, accounts: DataFrame) -> DataFrame:
    """Contacts with nickname and avatar of the account they belong to."""
    owner = accounts.select(
        F.col("id").alias("account_id"),
        F.col("nickname").alias("ow_nickname"),
        F.col("avatar").alias("ow_avatar"),
    )
    return friends.join(owner, "account_id", "left").select(
        *friends.columns, "ow_nickname", "ow_avatar"
    )


FRIEND_ORDER = ("is_active", "account_id", "nickname")


def friend_order() -> list[Column]:
    """Active first, then account and nickname descending; ids break ties (O1)."""
    return [*[F.desc(c) for c in FRIEND_ORDER], F.asc("id")]


def friend_listing(
    friends: DataFrame,
    accounts: DataFrame,
    params: Mapping[str, object] | None = None,
    page: int | None = 1,
    size: int = 10,
) -> DataFrame:
    """Filtered contacts with their owner, a page of them or all (`page=None`).

    A page is cut before the join, so owners are looked up for its rows alone.
    """
    wanted = apply_filters(friends, params or {})
    if page is None:
        return flags_as_text(with_owner(wanted, accounts))
    rows = paginate(wanted, friend_order(), page, size)
    return flags_as_text(with_owner(rows, accounts).orderBy(*friend_order()))


def active_tasks(tasks: DataFrame) -> DataFrame:
    """Active tasks with their cron in words."""
    return describe_cron(tasks.where(F.col("is_active") == 1))


def tasks_of_friend(tasks: DataFrame, friend_id: int) -> DataFrame:
    """Active tasks of one contact, newest first."""
    mine = tasks.where((F.col("friend_id") == friend_id) & (F.col("is_active") == 1))
    return mine.orderBy(F.desc("is_active"), F.desc("create_time"), F.asc("id"))


def friends_with_tasks(
    friends: DataFrame, tasks: DataFrame, size: int | None = None
) -> DataFrame:
    """Every contact with its active tasks, nested in id order.

    A contact is one row, however many tasks it has. Only if a `size` is asked for,
    one with more tasks comes in several rows, one per `part`, which in order hold
    all its tasks. For a page or another small set of contacts only their tasks are
    shuffled.
    """
    people = friends.select(F.col("id").alias("friend_id"))
    if is_small(people):
        tasks = tasks.join(F.broadcast(people), "friend_id", "left_semi")
    listed = split_large_groups(
        active_tasks(tasks), ["friend_id"], [id_block("id", size)], size
    )
    columns = ["id", *[c for c in listed.columns if c not in ("id", "friend_id", "part")]]
    nested = listed.groupBy("friend_id", "part").agg(
        F.array_sort(F.collect_list(F.struct(*columns))).alias("tasks")
    )
    none = F.array().cast(nested.schema["tasks"].dataType)
    return (
        friends.join(nested.withColumnRenamed("friend_id", "id"), "id", "left")
        .withColumn("tasks", F.coalesce("tasks", none))
        .withColumn("part", F.coalesce("part", no_part()))
        .select(*friends.columns, "part", "tasks")
    )


def account_friend_counts(accounts: DataFrame, friends: DataFrame) -> DataFrame:
    """Accounts with the number of their contacts."""
    counts = friends.groupBy("account_id").agg(F.count(F.lit(1)).alias("_friends"))
    kept = [c for c in accounts.columns if c != "friend_count"]
    return accounts.join(
        counts.withColumnRenamed("account_id", "id"), "id", "left"
    ).select(*kept, F.coalesce("_friends", F.lit(0)).alias("friend_count"))


def admin_listing(
    admins: DataFrame, offset_hours: int = 8, zone: str | Column | None = None
) -> DataFrame:
    """Admins not deleted, without password, with the login time as text.

    The time is that of a named `zone`, or at a fixed offset from UTC.
    """
    login = F.col("last_login_time")
    time = from_epoch(login, offset_hours) if zone is None else local_time(login, zone)
    shown = F.when(login != 0, time_text(time))
    return (
        admins.where(F.col("is_delete") == 0)
        .withColumn("last_login_time", F.coalesce(shown, F.lit(NEVER_LOGGED_IN)))
        .withColumn("password", F.lit(""))
    )


def search_logs(
    logs: DataFrame,
    params: Mapping[str, str | None],
    page: int = 1,
    size: int = 10,
    collation: str = "UTF8_LCASE",
    escape: bool = True,
) -> DataFrame:
    """Logged exchanges containing the given texts, newest id first."""
    found = search_contains(logs, params, collation, escape)
    return paginate(found, [F.desc("id")], page, size)


def exchange_log_rows(exchanges: DataFrame) -> DataFrame:
    """Log rows of model exchanges: `turns, reasoning, reply`.

    The text of a log row is what the last turn says.
    """
    last = F.try_element_at("turns", F.lit(-1))
    return exchanges.withColumns(
        {
            "msg": raw_json(F.coalesce("turns", F.array().cast(exchanges.schema["turns"].dataType))),
            "text": F.coalesce(last["content"], F.lit("")),
            "reson": F.coalesce("reasoning", F.lit("")),
            "reply": F.coalesce("reply", F.lit("")),
        }
    ).drop("turns", "reasoning")
