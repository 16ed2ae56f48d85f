"""Model replies: repair, unpacking into messages, task operations and records, sent rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import epoch_of, moment
from parley.functions.ordered import first_per_key, left_join_unique
from parley.functions.replies import repaired
from parley.operators.changes import TASK_OP_COLUMNS
from parley.schemas import DEFAULTS

# Operations are read as maps: an absent column and a null one mean different things.
REPLY_SCHEMA = (
    "`continue` string, message array<string>, cron array<map<string,string>>, "
    "summarize array<map<string,string>>"
)
# Columns of a summary record; numbers may come as text or with a fraction.
SUMMARY_COLUMNS = {
    "friend_id": "int", "task_name": "string", "result": "string", "summarize": "string",
    "suggestion": "string", "date": "string", "score": "int",
}


def repair_json(df: DataFrame, col: str) -> DataFrame:
    """Add `cleaned`, `parsed` (valid JSON, else null) and `status` (K5).

    Status is `ok` if the cleaned text is valid, `balanced` if it is after
    braces were added, else `JSON_PARSE_FAILED`.
    """
    found = df.withColumn("_repaired", repaired(F.col(col)))
    parts = {c: F.col("_repaired")[c] for c in ("cleaned", "status", "parsed")}
    return found.withColumns(parts).drop("_repaired")


def parse_replies(df: DataFrame, col: str) -> DataFrame:
    """Repaired replies with their document in `reply_doc`, null if not repairable."""
    return repair_json(df, col).withColumn("reply_doc", F.from_json("parsed", REPLY_SCHEMA))


def reply_messages(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per message to send, in order; null and empty ones are left out (K6)."""
    # Outer here and below: else a filter on the list is pushed down, and each reply repaired twice.
    listed = replies.select(*keys, F.posexplode_outer("reply_doc.message").alias("position", "content"))
    return listed.where(F.coalesce("content", F.lit("")) != "")


def reply_task_ops(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per task operation, in order, with the columns it states in `given` (K6).

    The form is the one `apply_task_ops` takes: operations apply in the order
    of `keys`, then of their place in the reply.
    """
    listed = replies.select(*keys, F.posexplode_outer("reply_doc.cron").alias("position", "_op"))
    op = F.col("_op")
    kinds = {"friend_id": "int", "is_active": "int"}
    stated = [
        F.try_element_at(op, F.lit(c)).try_cast(kinds.get(c, "string")).alias(c)
        for c in TASK_OP_COLUMNS
    ]
    return listed.where(op.isNotNull()).select(
        *keys,
        "position",
        F.try_element_at(op, F.lit("id")).try_cast("long").alias("id"),
        F.try_element_at(op, F.lit("operate")).alias("operate"),
        *stated,
        F.array_sort(F.map_keys(op)).alias("given"),
        F.struct(*keys, "position").alias("op_seq"),
    )


def reply_summaries(replies: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per summary record, as the record table takes it (K6).

    A number may be text; a fraction is rounded, and what is no number is null.
    """
    listed = replies.select(*keys, F.posexplode_outer("reply_doc.summarize").alias("position", "_record"))

    def value(name: str, kind: str) -> Column:
        text = F.try_element_at("_record", F.lit(name))
        return F.round(text.try_cast("double")).try_cast("int") if kind == "int" else text

    return listed.where(F.col("_record").isNotNull()).select(
        *keys, "position", *(value(c, kind).alias(c) for c, kind in SUMMARY_COLUMNS.items())
    )


# The wording of the notice.
NOTICE_START = "当前"
NOTICE_MIDDLE = "的cron任务列表已更新："


def task_change_notices(replies: DataFrame, friends: DataFrame, friend_id: str = "friend_id") -> DataFrame:
    """A notice per reply that has task operations, naming the contact."""
    names = friends.select(F.col("id").alias(friend_id), "remark")
    changed = replies.where(F.size("reply_doc.cron") > 0)
    listed = F.get_json_object("parsed", "$.cron")
    name = F.coalesce("remark", F.lit("null"))
    return changed.join(names, friend_id).withColumn(
        "content", F.concat(F.lit(NOTICE_START), name, F.lit(NOTICE_MIDDLE), listed)
    )


# Fixed values of a message that was sent: its direction, and that it is text.
SENT, TEXT_KIND = 1, 1


def _sent_rows(sent: DataFrame, keys: Sequence[str], as_of) -> DataFrame:
    """Rows of the message table for texts an account (`wx_id`) sent to a contact (`wxid`).

    Type, kind and time are filled, so that sent rows count and stand in histories (Q8). A text that
    has no account with a key, no contact or no content is not sent.
    """
    given = [F.coalesce(F.col(c), F.lit("")) != "" for c in ("auth_key", "wxid", "content")]
    return sent.where(given[0] & given[1] & given[2]).select(
        *keys,
        F.col("wx_id").alias("from_user"),
        F.col("wxid").alias("to_user"),
        "content",
        F.lit(DEFAULTS["messages"]["status"]).alias("status"),
        F.lit(1).alias("is_ai"),
        F.lit(SENT).alias("type"),
        F.lit(TEXT_KIND).alias("msg_type"),
        epoch_of(moment(as_of)).alias("create_time"),
        moment(as_of).alias("create_at"),
        moment(as_of).alias("update_at"),
    )


def sent_message_rows(
    messages: DataFrame, friends: DataFrame, accounts: DataFrame, as_of
) -> DataFrame:
    """Rows of the replies that are sent to their bursts, one per message.

    `messages` is what `reply_messages` gives with the keys of bursts: `from_user, to_user, burst_start`,
    then `position, content`. They go out from the account the burst came to, if the contact is active
    with AI and its `ai_reply` is 1. Of several contacts or accounts of a name the lowest id counts.
    """
    talking = friends.where((F.col("is_active") == 1) & (F.col("ai_active") == 1))
    contacts = first_per_key(talking.select("wxid", "id", "ai_reply"), ["wxid"], ["id"])
    senders = first_per_key(accounts.select("wx_id", "id", "auth_key"), ["wx_id"], ["id"])
    answered = messages.withColumnsRenamed({"from_user": "wxid", "to_user": "wx_id"})
    # All replies of an account, or to a contact, may be a third of all: these joins spread them.
    allowed = left_join_unique(answered, contacts.drop("id"), ["wxid"]).where(F.col("ai_reply") == 1)
    sent = left_join_unique(allowed.drop("ai_reply"), senders.drop("id"), ["wx_id"])
    return _sent_rows(sent, ["burst_start", "position"], as_of)


def sent_task_rows(copies: DataFrame, targets: DataFrame, as_of) -> DataFrame:
    """Rows of the task messages that are sent, one per request.

    `copies` holds `request_id, content`, the edited texts; `targets` is what `resolve_targets` gives.
    """
    sent = copies.select("request_id", "content").join(targets, "request_id")
    return _sent_rows(sent.withColumnRenamed("sender_wxid", "wx_id"), ["request_id"], as_of)
