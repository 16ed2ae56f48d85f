"""Memberships: lapsed, about to lapse, expired, and their reminders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.clock import hours_after, moment
from parley.functions.ordered import PART_ROWS
from parley.functions.values import or_else

# The wording of the reminders.
REMINDER_START = "注意："
EXPIRED_END = " 会员已到期"
EXPIRING_END = " 会员将在24小时内到期"


def _lapsed(as_of) -> Column:
    return (F.col("is_active") == 1) & (F.col("end_time") < moment(as_of))


def expired_members(friends: DataFrame, as_of) -> DataFrame:
    """Active members whose time ended strictly before `as_of`."""
    return friends.where(_lapsed(as_of))


def expiring_members(friends: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Active members whose time ends from `as_of` to `hours` later, both included."""
    ends = F.col("end_time").between(moment(as_of), hours_after(as_of, hours))
    return friends.where((F.col("is_active") == 1) & ends)


def expire_members(friends: DataFrame, as_of) -> DataFrame:
    """The contacts with lapsed memberships closed (M2)."""
    lapsed = F.coalesce(_lapsed(as_of), F.lit(False))
    changes = {
        "is_active": F.when(lapsed, 0).otherwise(F.col("is_active")),
        "ai_active": F.when(lapsed, 0).otherwise(F.col("ai_active")),
    }
    if "update_time" in friends.columns:
        changes["update_time"] = F.when(lapsed, moment(as_of)).otherwise(F.col("update_time"))
    return friends.withColumns(changes)


def display_name() -> Column:
    return or_else(F.col("remark"), F.col("nickname"))


def member_reminder(members: DataFrame, block_ids: int = PART_ROWS) -> DataFrame:
    """Names for a reminder, joined with commas in id order (A10).

    The list covers all members and has no bound, so it comes in blocks of
    consecutive ids: the lists of the blocks, in order and joined with commas,
    are the whole list. Only one block is ever put together in one place.
    `reminder_pieces` makes the one message of them.
    """
    block = F.floor(F.col("id") / block_ids).cast("long")
    # A missing name still takes its place in the list, as empty text.
    name = F.struct("id", F.coalesce(display_name(), F.lit("")).alias("name"))
    listed = members.groupBy(block.alias("block")).agg(
        F.array_sort(F.collect_list(name)).alias("listed")
    )
    return listed.select(
        "block",
        F.size("listed").cast("long").alias("member_count"),
        F.array_join(F.transform("listed", lambda x: x["name"]), ",").alias("names"),
    )


def reminder_pieces(listed: DataFrame, ending: str = EXPIRED_END) -> DataFrame:
    """The blocks of `member_reminder` as pieces of one message: `piece, member_count, content`.

    In order of `piece` the contents, put together, are the message: it opens once and ends once.
    Pieces are numbered from the block ids alone; the names stay where they were put together.
    """
    order = Window.orderBy("block")
    places = listed.select(
        F.col("block").alias("_block"),
        (F.row_number().over(order) - 1).cast("long").alias("piece"),
        F.lead(F.lit(True)).over(order).isNull().alias("_last"),
    )
    start = F.when(F.col("piece") == 0, REMINDER_START).otherwise(",")
    end = F.when(F.col("_last"), ending).otherwise("")
    return listed.join(places, F.col("block").eqNullSafe(F.col("_block"))).select(
        "piece",
        "member_count",
        F.concat(start, F.col("names"), end).alias("content"),
    )


def reminder_text(names: Column, ending: str = EXPIRED_END) -> Column:
    """The reminder message around a list of names."""
    return F.concat(F.lit(REMINDER_START), names, F.lit(ending))
