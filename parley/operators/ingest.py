"""Incoming messages: dedup, routing, storing, bursts, connection states (J5, J8, T*, A11)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.clock import epoch_of, moment
from parley.functions.ordered import (
    PART_ROWS,
    WINDOW_ROWS,
    broadcast_if_small,
    first_per_key,
    latest_value,
    left_join_unique,
    split_groups,
    time_levels,
    with_previous,
)
from parley.functions.values import literal_map

# Message kind that is never stored; routes.
STATUS_KIND = 51
IGNORED, OWN, MEMBER, MEMBER_AI = 0, 1, 2, 3

BURST_GAP_SECONDS = 10


def dedup_messages(batch: DataFrame, order: Sequence[str] = ("create_time",)) -> DataFrame:
    """The first message of each `msg_id` (T2, Q11); messages without one are all kept."""
    # A number of its own for each message without an id, which also spreads them.
    own = F.when(F.col("msg_id").isNull(), F.monotonically_increasing_id())
    marked = batch.withColumn("_own", own)
    return first_per_key(marked, ["msg_id", "_own"], order).drop("_own")


def new_messages(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Messages not stored yet.

    The store is far larger than a batch, so it is first reduced to the ids of
    the batch: only its `msg_id` column is read, and it is not shuffled if the
    ids of the batch are few enough for a broadcast.
    """
    asked = broadcast_if_small(batch.select("msg_id").distinct())
    seen = stored.select("msg_id").join(asked, "msg_id", "left_semi").distinct()
    return batch.join(seen, "msg_id", "left_anti")


def route_messages(messages: DataFrame, accounts: DataFrame, friends: DataFrame) -> DataFrame:
    """Messages with their `route`; the first rule that holds decides.

    1 own message: the sender is an account and the connection key is its key.
    2 from an active contact, AI off. 3 the same, AI on. 0 anything else. Of
    several contacts of one name the lowest id counts (Q9). Works on streams.
    """
    own = (
        accounts.select(F.col("wx_id").alias("from_user"), "auth_key")
        .distinct()
        .withColumn("_own", F.lit(True))
    )
    members = friends.where(F.col("is_active") == 1).select(
        F.col("wxid").alias("from_user"), F.col("id").alias("_id"), F.col("ai_active").alias("_ai")
    )
    members = first_per_key(members, ["from_user"], ["_id"]).drop("_id")
    route = (
        F.when(F.col("_own"), OWN)
        .when(F.col("_ai") == 0, MEMBER)
        .when(F.col("_ai") == 1, MEMBER_AI)
        .otherwise(IGNORED)
    )
    known = left_join_unique(messages, own, ["from_user", "auth_key"])
    known = left_join_unique(known, members, ["from_user"])
    return known.withColumn("route", route).drop("_own", "_ai")


def drop_senderless(frames: DataFrame) -> DataFrame:
    """Frames that name a sender."""
    return frames.where(F.coalesce("from_user", F.lit("")) != "")


def to_message_rows(routed: DataFrame, as_of) -> DataFrame:
    """Routed frames as rows of the message table.

    Ignored messages, status messages and empty ones are not stored.
    """
    own = F.col("route") == OWN
    stored = routed.where(
        (F.col("route") != IGNORED)
        & (F.coalesce("msg_type", F.lit(-1)) != STATUS_KIND)
        & (F.coalesce("content", F.lit("")) != "")
    )
    return stored.select(
        "msg_id",
        "from_user",
        F.coalesce("to_user", F.lit("")).alias("to_user"),
        "content",
        F.when(own, F.lit("done")).otherwise(F.lit("queued")).alias("status"),
        F.lit(0).alias("is_ai"),
        F.when(own, 1).otherwise(0).alias("type"),
        "msg_type",
        F.coalesce(F.nullif("create_time", F.lit(0).cast("long")), epoch_of(moment(as_of))).alias(
            "create_time"
        ),
        moment(as_of).alias("create_at"),
        moment(as_of).alias("update_at"),
        "raw_data",
    )


# --- bursts -----------------------------------------------------------------


def assign_bursts(
    messages: DataFrame,
    gap: int = BURST_GAP_SECONDS,
    keys: Sequence[str] = ("from_user", "to_user"),
    id_col: str = "id",
    window_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Messages with the burst they belong to: `burst_start`, and their place in it (T4).

    A burst ends when its sender is quiet for more than `gap` seconds.
    `burst_position` counts from 0 in order of `create_time`, then `id_col`, a
    unique whole number. A message without a time is a burst of its own;
    `burst_number`, the place of a burst's first message among the sender's, tells
    such bursts apart. Senders of more than `window_rows` messages are worked on in
    parts.
    """
    order = ["create_time", id_col]
    rows, split = split_groups(
        messages, keys, time_levels("create_time", id_col, window_rows), window_rows
    )
    rows = with_previous(rows, keys, order, "create_time", split)
    time = F.col("create_time")
    begins = F.col("_previous").isNull() | (time - F.col("_previous") > gap)
    first = F.when(begins, F.struct(time.alias("time"), F.col("_number").alias("number")))
    rows = latest_value(rows.withColumn("_begins", first), keys, order, "_begins", "_burst", split)
    return rows.select(
        *messages.columns,
        F.col("_burst.time").alias("burst_start"),
        F.col("_burst.number").alias("burst_number"),
        (F.col("_number") - F.col("_burst.number")).alias("burst_position"),
    )


def merge_bursts(
    messages: DataFrame,
    gap: int = BURST_GAP_SECONDS,
    keys: Sequence[str] = ("from_user", "to_user"),
    id_col: str = "id",
    size: int = PART_ROWS,
) -> DataFrame:
    """One row per burst with its texts joined by newlines in time order.

    A burst of more than `size` messages comes in several rows, `part` 0 and up,
    whose texts joined by newlines are the whole text.
    """
    return merge_assigned(assign_bursts(messages, gap, keys, id_col), keys, size)


def merge_assigned(
    bursts: DataFrame, keys: Sequence[str] = ("from_user", "to_user"), size: int = PART_ROWS
) -> DataFrame:
    """The messages of `assign_bursts`, merged. `burst_number` tells bursts without a time apart.

    Places in a burst are known, so a long one is cut without a look at sizes,
    and the grouping goes on in the partitions the bursts were found in.
    """
    part = F.floor(F.col("burst_position") / size)
    text = F.struct("burst_position", F.coalesce("content", F.lit("")).alias("content"))
    number = [c for c in ("burst_number",) if c in bursts.columns]
    merged = bursts.groupBy(*keys, "burst_start", *number, part.alias("part")).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.max("create_time").alias("last_received"),
        F.array_sort(F.collect_list(text)).alias("_texts"),
    )
    content = F.array_join(F.transform("_texts", lambda x: x["content"]), "\n")
    return merged.withColumn("content", content).drop("_texts")


def burst_status(bursts: DataFrame, friends: DataFrame, replies: DataFrame) -> DataFrame:
    """Status patches (`msg_id, status`) of the messages of handled bursts (T5).

    `bursts` is the output of `assign_bursts`. `replies` has a row per handled
    burst (`from_user, to_user, burst_start`, and `burst_number` if `bursts` has it) and
    `failed`. Missing receivers and times are equal to missing ones. Bursts of senders
    without an active AI contact, and bursts not handled yet, give no patch.
    """
    ai_members = (
        friends.where((F.col("is_active") == 1) & (F.col("ai_active") == 1))
        .select(F.col("wxid").alias("from_user"))
        .distinct()
    )
    status = F.when(F.col("failed"), F.lit("failed")).otherwise(F.lit("processed"))
    keys = ["from_user", "to_user", "burst_start"]
    if "burst_number" in bursts.columns and "burst_number" in replies.columns:
        keys.append("burst_number")
    handled = replies.select(*[F.col(k).alias(f"_{k}") for k in keys], "failed").join(
        ai_members, F.col("_from_user") == F.col("from_user"), "left_semi"
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    return bursts.join(handled, same).select("msg_id", status.alias("status"))


# --- connections ------------------------------------------------------------

# State names and their codes.
STATE_CODES = {"CONNECTING": 0, "OPEN": 1, "CLOSING": 2, "CLOSED": 3, "ERROR": 4}
NOT_FOUND = "NOT_FOUND"
UNKNOWN_STATE_CODE = -1
STORED_UNKNOWN_CODE = 3
# The names codes are read back as.
STATE_NAMES = {0: "CONNECTING", 1: "OPEN", 2: "CLOSING", 3: "CLOSED"}
UNKNOWN_STATE = "UNKNOWN"


def state_code(state: Column, unknown: int) -> Column:
    return F.coalesce(F.try_element_at(literal_map(STATE_CODES), state), F.lit(unknown))


def state_name(code: Column) -> Column:
    return F.coalesce(F.try_element_at(literal_map(STATE_NAMES), code), F.lit(UNKNOWN_STATE))


def connection_status(state_events: DataFrame) -> DataFrame:
    """Per connection: the state now, its code, first and last event.

    Events have `url, state, timestamp` and a unique `event_id` for ties.
    """
    latest = F.max_by("state", F.struct("timestamp", "event_id"))
    return (
        state_events.groupBy("url")
        .agg(
            latest.alias("state"),
            F.min("timestamp").alias("since"),
            F.max("timestamp").alias("last_updated"),
        )
        .withColumn("state_code", state_code(F.col("state"), UNKNOWN_STATE_CODE))
    )


def state_changes(state_events: DataFrame, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Events that change the state of their connection, the first one included."""
    second = epoch_of(F.col("timestamp"))
    micro = F.date_part(F.lit("SECOND"), F.col("timestamp")) * 1_000_000
    levels = [F.floor(second / 3600), second, micro, F.floor(F.col("event_id") / window_rows)]
    parts, split = split_groups(state_events, ["url"], levels, window_rows)
    order = ["timestamp", "event_id"]
    following = with_previous(parts, ["url"], order, "state", split, "previous_state")
    changed = ~F.col("state").eqNullSafe(F.col("previous_state"))
    return following.where(changed).drop("part", "_number")


def ws_status_patches(accounts: DataFrame, status: DataFrame, url_col: str = "auth_key") -> DataFrame:
    """Accounts whose stored connection status differs from the tracked one."""
    tracked = status.select(F.col("url").alias(url_col), "state")
    found = accounts.select("id", url_col, "ws_status").join(tracked, url_col, "left")
    state = F.coalesce("state", F.lit(NOT_FOUND))
    code = state_code(state, STORED_UNKNOWN_CODE)
    return (
        found.withColumn("state", state)
        .withColumn("new_status", code.cast("string"))
        .where(~F.col("ws_status").try_cast("int").eqNullSafe(code))
        .select("id", "ws_status", "new_status", "state")
    )
