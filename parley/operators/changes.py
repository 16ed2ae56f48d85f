"""Changes applied to snapshots: snapshot + changes -> new snapshot (M*, J10).

Each change is one keyed join. Changes are reduced to one per key before the
join, by aggregates that combine ahead of the shuffle. Results are new tables;
nothing is overwritten in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import moment, validity_state
from parley.functions.ordered import last_per_key, left_join_unique, numbered_ids
from parley.functions.values import literal_map
from parley.schemas import conform

# Columns that record when a row was last changed.
TOUCHED = ("update_time", "update_at")


def _touched(df: DataFrame, as_of, changed: Column) -> dict[str, Column]:
    if as_of is None:
        return {}
    return {
        c: F.when(changed, moment(as_of)).otherwise(F.col(c)) for c in TOUCHED if c in df.columns
    }


def apply_patch(
    df: DataFrame,
    patches: DataFrame,
    key: str | Sequence[str],
    cols: Sequence[str],
    as_of=None,
    seq: str | None = None,
) -> DataFrame:
    """Rows with `cols` taken from the patch of their key, nulls included (M1).

    If `seq` is given, keys may have several patches and the highest `seq`
    wins; otherwise they must be unique. Rows without a patch stay as they
    are. Changed rows get `as_of` as their update time. Few patches for a large
    table may be passed through `broadcast_if_small`: then it is not shuffled.
    """
    keys = [key] if isinstance(key, str) else list(key)
    wanted = patches.select(*keys, *cols, *([seq] if seq and seq not in cols else []))
    if seq:
        wanted = last_per_key(wanted, keys, [seq])
    incoming = wanted.select(*keys, F.struct(*cols).alias("_patch"))
    matched = F.col("_patch").isNotNull()
    new = {
        c: F.when(matched, F.col("_patch")[c].cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c in cols
    }
    new.update({c: v for c, v in _touched(df, as_of, matched).items() if c not in new})
    return df.join(incoming, keys, "left").withColumns(new).select(*df.columns)


def empty_to_null(df: DataFrame, *cols: str) -> DataFrame:
    """Empty text as null, for the time columns of a patch."""
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in cols})


def _max_id(df: DataFrame) -> Column:
    return F.coalesce(df.agg(F.max("id").cast("long")).scalar(), F.lit(0))


def _insert(df: DataFrame, rows: DataFrame, keys: Sequence[str], table: str, as_of) -> DataFrame:
    """`rows` shaped like `df`, with defaults and new ids in order of `keys`."""
    numbered = numbered_ids(rows, keys, _max_id(df))
    full = conform(numbered, table, as_of)
    return full.select(*[F.col(c).cast(df.schema[c].dataType).alias(c) for c in df.columns])


# Columns a contact snapshot carries.
CONTACT_COLUMNS = (
    "account_id", "wxid", "nickname", "avatar", "remark", "signature", "province", "city",
    "country",
)


def upsert_contacts(
    friends: DataFrame, contacts: DataFrame, as_of=None, seq: str = "position"
) -> DataFrame:
    """Contacts of a snapshot added or updated by account and contact name.

    Matched rows take the profile columns, empty text included; flags, prompt,
    role and times stay. New rows get defaults, and new ids by account in order of `seq`. Of a contact listed
    twice for an account the last by `seq` counts. If several stored rows match,
    the one with the lowest id is updated.
    """
    keys = ["account_id", "wxid"]
    profile = [c for c in CONTACT_COLUMNS if c not in keys and c in friends.columns]
    once = last_per_key(contacts.select(*keys, *profile, seq), keys, [seq])
    # Only stored rows a contact matches are grouped; each contact finds the one it updates.
    named = friends.select(*keys, "id").join(once, keys, "left_semi")
    target = named.groupBy(*keys).agg(F.min("id").alias("id"))
    patches = target.join(once, keys).select("id", *profile)
    updated = apply_patch(friends, patches, "id", profile, as_of)
    added = once.join(target, keys, "left_anti")
    return updated.unionByName(_insert(friends, added, ["account_id", seq, "wxid"], "friends", as_of))


def set_friend_count(accounts: DataFrame, counts: DataFrame) -> DataFrame:
    """`friend_count` of accounts as their snapshot states it: `auth_key, friend_count` (M3)."""
    return apply_patch(accounts, counts, "auth_key", ["friend_count"])


def upsert_accounts(accounts: DataFrame, patches: DataFrame, as_of=None, seq: str = "seq") -> DataFrame:
    """Accounts added or updated by their `wx_id` (M4). The last patch by `seq` wins; new ids are in
    its order."""
    cols = [c for c in patches.columns if c not in ("wx_id", seq)]
    once = last_per_key(patches, ["wx_id"], [seq])
    updated = apply_patch(accounts, once, "wx_id", cols, as_of)
    added = once.join(accounts, "wx_id", "left_anti")
    return updated.unionByName(_insert(accounts, added, [seq, "wx_id"], "accounts", as_of))


def upsert_by_id(df: DataFrame, rows: DataFrame, table: str, seq: str, as_of=None) -> DataFrame:
    """Rows with an id update, rows without are added (M17). `seq` orders and is unique."""
    cols = [c for c in rows.columns if c not in ("id", seq)]
    updates = rows.where(F.col("id").isNotNull())
    updated = apply_patch(df, updates, "id", cols, as_of, seq)
    added = rows.where(F.col("id").isNull()).drop("id")
    return updated.unionByName(_insert(df, added, [seq], table, as_of))


# --- task operations --------------------------------------------------------

TASK_OP_COLUMNS = (
    "friend_id", "task_name", "cron_expression", "start_date", "end_date", "is_active",
)
# A cron that would fire every second is replaced.
EVERY_SECOND = "* * * * * *"
EVERY_SECOND_REPLACEMENT = "* 1 * * * *"


def normal_cron(cron: Column) -> Column:
    """`?` as `*`, and the all-stars cron replaced (M5)."""
    stars = F.replace(cron, F.lit("?"), F.lit("*"))
    return F.when(stars == EVERY_SECOND, F.lit(EVERY_SECOND_REPLACEMENT)).otherwise(stars)


def apply_task_ops(tasks: DataFrame, ops: DataFrame, as_of=None) -> DataFrame:
    """Operations of model replies applied to the tasks, in order of `op_seq` (M5).

    `ops` has `op_seq` (unique, of any type that has an order), `id`, `operate`,
    the task columns and `given`, the names of the columns the operation states.
    `add` needs id -1. `update` sets the columns it states. A deleted task stays
    deleted. Other operations do nothing.
    """
    ops = ops.withColumn("cron_expression", normal_cron(F.col("cron_expression")))
    deleted = ops.where(F.col("operate") == "delete").select("id")
    edits = ops.where(F.col("operate") == "update")

    def last_stated(name: str) -> Column:
        stated = F.array_contains("given", name)
        return F.max_by(F.struct(F.col(name).alias("v")), F.when(stated, F.col("op_seq"))).alias(name)

    patches = edits.groupBy("id").agg(*[last_stated(c) for c in TASK_OP_COLUMNS])
    patch = F.struct(*TASK_OP_COLUMNS)
    edited = tasks.join(deleted, "id", "left_anti").join(
        patches.select("id", patch.alias("_patch")), "id", "left"
    )
    new = {
        c: F.when(
            F.col("_patch")[c].isNotNull(),
            F.col("_patch")[c]["v"].cast(tasks.schema[c].dataType),
        ).otherwise(F.col(c))
        for c in TASK_OP_COLUMNS
    }
    new.update(_touched(tasks, as_of, F.col("_patch").isNotNull()))
    kept = edited.withColumns(new).select(*tasks.columns)
    added = ops.where((F.col("operate") == "add") & (F.col("id") == -1))
    new_rows = added.select("op_seq", *TASK_OP_COLUMNS)
    return kept.unionByName(_insert(tasks, new_rows, ["op_seq"], "friends_task", as_of))


def record_executions(tasks: DataFrame, runs: DataFrame) -> DataFrame:
    """Runs (`task_id, run_time`) added to the count, the last one to the time (M6)."""
    totals = runs.groupBy(F.col("task_id").alias("id")).agg(
        F.count(F.lit(1)).alias("_runs"), F.max("run_time").alias("_last")
    )
    count = F.coalesce("execution_count", F.lit(0)) + F.col("_runs")
    ran = F.col("_runs").isNotNull()
    return (
        tasks.join(totals, "id", "left")
        .withColumn(
            "execution_count",
            F.when(ran, count.cast(tasks.schema["execution_count"].dataType)).otherwise(
                F.col("execution_count")
            ),
        )
        .withColumn(
            "last_execution_time",
            F.when(ran, F.col("_last")).otherwise(F.col("last_execution_time")),
        )
        .select(*tasks.columns)
    )


def record_errors(tasks: DataFrame, errors: DataFrame) -> DataFrame:
    """The last error (`task_id, run_time, error_message`) of each task kept on it (M7)."""
    patches = errors.select(
        F.col("task_id").alias("id"),
        F.col("run_time").alias("last_execution_time"),
        "error_message",
        F.struct("run_time", "error_message").alias("_seq"),
    )
    return apply_patch(tasks, patches, "id", ["last_execution_time", "error_message"], seq="_seq")


def retire_tasks(tasks: DataFrame, as_of) -> DataFrame:
    """Active tasks past their end made inactive (M8, Q1)."""
    over = (F.col("is_active") == 1) & (
        validity_state(F.col("start_date"), F.col("end_date"), as_of) == 2
    )
    over = F.coalesce(over, F.lit(False))
    new = {"is_active": F.when(over, 0).otherwise(F.col("is_active"))}
    new.update(_touched(tasks, as_of, over))
    return tasks.withColumns(new)


def close_tasks(tasks: DataFrame, friend_ids: DataFrame, as_of=None) -> DataFrame:
    """All tasks of the given contacts made inactive (M9)."""
    named = friend_ids.select("friend_id").distinct().withColumn("_close", F.lit(True))
    closing = F.coalesce("_close", F.lit(False))
    new = {"is_active": F.when(closing, 0).otherwise(F.col("is_active"))}
    new.update(_touched(tasks, as_of, closing))
    return left_join_unique(tasks, named, ["friend_id"]).withColumns(new).select(*tasks.columns)


ONLINE_COLUMNS = ("onlineTime", "expiryTime", "loginErrMsg", "onlineDays", "totalOnline")


def reset_online(accounts: DataFrame, keys: DataFrame, as_of=None) -> DataFrame:
    """Online columns of accounts (`auth_key`) set to null after logout or a failed status."""
    nulls = [F.lit(None).cast("string").alias(c) for c in ONLINE_COLUMNS]
    patches = keys.select("auth_key").distinct().select("auth_key", *nulls)
    return apply_patch(accounts, patches, "auth_key", ONLINE_COLUMNS, as_of)


def delete_rows(
    df: DataFrame, keys: DataFrame, key: str = "id", guard: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """Rows left after deleting `keys`, and the rows a guard kept from deletion."""
    named = keys.select(key).distinct()
    if guard is None:
        return df.join(named, key, "left_anti"), df.limit(0)
    marked = df.join(named.withColumn("_named", F.lit(True)), key, "left")
    asked, guarded = F.col("_named").isNotNull(), F.coalesce(guard, F.lit(False))
    return (
        marked.where(~asked | guarded).select(*df.columns),
        marked.where(asked & guarded).select(*df.columns),
    )


def set_message_status(messages: DataFrame, patches: DataFrame, as_of=None) -> DataFrame:
    """Status of messages by `msg_id` (M12). If a message has several, `failed` wins."""
    once = patches.groupBy("msg_id").agg(F.min("status").alias("status"))
    return apply_patch(messages, once, "msg_id", ["status"], as_of)


def set_all(df: DataFrame, **values) -> DataFrame:
    """Columns set on every row."""
    return df.withColumns({c: F.lit(v).cast(df.schema[c].dataType) for c, v in values.items()})


# Status labels of task runs.
RUN_LABELS = {"ok": "执行完成", "failed": "执行失败"}


def task_log_rows(runs: DataFrame, as_of=None) -> DataFrame:
    """Log rows of task runs (`task_id, task_name, outcome`) with a status label."""
    label = F.try_element_at(literal_map(RUN_LABELS), F.col("outcome"))
    rows = runs.select("task_id", "task_name", label.alias("status"))
    return conform(rows, "task_logs", as_of).drop("id")


def schedule_diff(active_tasks: DataFrame, scheduled: DataFrame) -> DataFrame:
    """What to do with each task id: `new`, `changed`, `removed` or `unchanged`.

    `scheduled` has `id, cron`: the cron each task is scheduled with now.
    """
    wanted = active_tasks.select("id", F.col("cron_expression").alias("new_cron"), F.lit(True).alias("_active"))
    present = scheduled.select("id", F.col("cron").alias("old_cron"), F.lit(True).alias("_scheduled"))
    action = (
        F.when(F.col("_scheduled").isNull(), F.lit("new"))
        .when(F.col("_active").isNull(), F.lit("removed"))
        .when(F.col("old_cron").eqNullSafe(F.col("new_cron")), F.lit("unchanged"))
        .otherwise(F.lit("changed"))
    )
    return wanted.join(present, "id", "full_outer").select(
        "id", "old_cron", "new_cron", action.alias("action")
    )
