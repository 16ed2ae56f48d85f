"""Collapse of logged conversations that are snapshots of longer ones, and rendering (operator 2).

A log that stores a conversation again after each exchange holds many prefixes of the same
conversation. The digest of a prefix is a sum of digests of its turns, each with its place, so that it
rolls on from turn to turn and can be summed in stretches: all turns are put in one order and dealt over
tasks by ranges of it, whatever their turn numbers and ids, and one row a stretch is carried on. A
conversation of any length is rendered in blocks of so many turns, and no task needs all of it. A
conversation whose digest is found among the proper prefixes is left out by an anti-join; of equal
conversations the lowest id stays. All of it is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm.common import stash

#: Turns that are rendered into one text.
BLOCK_TURNS = 256
#: Four digests of 32 bits: sums of two thousand million turns stay whole numbers.
_SEEDS = (1, 2, 3, 4)
_SUMS = [f"h{s}" for s in _SEEDS]
#: Ranges are cut by so much of a text; rows that begin alike in one turn and role share a range.
_CUT_CHARS = 64
#: `monotonically_increasing_id` counts the rows of a partition in so many bits.
_PLACE_BITS = 33

OPEN, MIDDLE, CLOSE = "<|", "|>\n", "<|end|>\n"


def ordered_turns(conversations: DataFrame) -> DataFrame:
    """The distinct turns, with `at`, which grows in order of conversation, turn, role and text.

    `at` counts the rows of a range one by one; `stretch` is the range. What a conversation has in a
    range lies side by side. Written once, as ranges are cut by a sample.
    """
    turns = conversations.select(
        F.col("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-1)).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).distinct()
    begins = F.substring("text", 1, _CUT_CHARS)
    ranged = turns.repartitionByRange("conv_id", "turn", "role", begins).sortWithinPartitions(
        "conv_id", "turn", "role", "text"
    )
    placed = stash(ranged.withColumn("at", F.monotonically_increasing_id()), "turns")
    return placed.withColumn("stretch", F.shiftright("at", _PLACE_BITS))


def _digested(turns: DataFrame) -> DataFrame:
    digests = [
        F.pmod(F.xxhash64("turn", "role", "text", F.lit(s)), F.lit(1 << 32)).alias(f"d{s}")
        for s in _SEEDS
    ]
    return turns.select("conv_id", "stretch", "at", *digests)


def stretches(turns: DataFrame) -> DataFrame:
    """For each conversation and stretch the place before its first turn, and the sums before it.

    The number of a turn in its conversation is `at` - `shift`; `n_turns` is that of the last.
    """
    sums = [F.sum(f"d{s}").alias(f"b{s}") for s in _SEEDS]
    each = _digested(turns).groupBy("conv_id", "stretch").agg(
        F.count("*").alias("turns"), F.min("at").alias("first"), *sums
    )
    whole = Window.partitionBy("conv_id")
    earlier = whole.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return each.select(
        F.col("conv_id").alias("_conv"),
        F.col("stretch").alias("_stretch"),
        (F.col("first") - 1 - F.coalesce(F.sum("turns").over(earlier), zero)).alias("shift"),
        F.sum("turns").over(whole).alias("n_turns"),
        *(F.coalesce(F.sum(f"b{s}").over(earlier), zero).alias(f"before{s}") for s in _SEEDS),
    )


def _of_stretch() -> Column:
    return F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("stretch") == F.col("_stretch"))


def prefix_digests(turns: DataFrame, starts: DataFrame) -> DataFrame:
    """For each turn its number `n`, the digests of the prefix up to it, and `n_turns` of the whole."""
    within = (
        Window.partitionBy("conv_id", "stretch")
        .orderBy("at")
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    rolled = _digested(turns).select(
        "conv_id", "stretch", "at", *(F.sum(f"d{s}").over(within).alias(f"r{s}") for s in _SEEDS)
    )
    return rolled.join(starts, _of_stretch()).select(
        "conv_id",
        (F.col("at") - F.col("shift")).alias("n"),
        "n_turns",
        *((F.col(f"r{s}") + F.col(f"before{s}")).alias(f"h{s}") for s in _SEEDS),
    )


def maximal_conversations(turns: DataFrame, starts: DataFrame) -> DataFrame:
    """`conv_id`, `n_turns` and `n_logged` of conversations that no longer one starts with.

    `n_logged` is the number of equal conversations, of which the one with the lowest id is given.
    """
    prefixes = stash(prefix_digests(turns, starts), "prefixes")
    whole = (
        prefixes.filter(F.col("n") == F.col("n_turns"))
        .groupBy("n", *_SUMS)
        .agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_logged"))
    )
    inner = prefixes.filter(F.col("n") < F.col("n_turns")).select("n", *_SUMS).distinct()
    return whole.join(inner, ["n", *_SUMS], "left_anti").select(
        "conv_id", F.col("n").alias("n_turns"), "n_logged"
    )


def render(role: Column, text: Column) -> Column:
    """One turn in the chat form."""
    return F.concat(F.lit(OPEN), role, F.lit(MIDDLE), text, F.lit("\n" + CLOSE))


def chat_texts(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The maximal conversations rendered, one row for each `block_turns` turns.

    Gives `conv_id`, `part` (from 0), `n_turns` and `n_logged` of the whole conversation, and `text`; the
    texts of a conversation in order of `part` are the whole. A null role or text counts as empty, a null
    turn number as -1; rows with the same number go in order of role and text, and rows that are the same
    count once. Turns are counted, so no part has more than `block_turns` of them, whatever their numbers.
    A null id is an id. Other columns are ignored; an empty table gives no rows.
    """
    turns = ordered_turns(conversations)
    starts = stash(stretches(turns), "stretches")
    kept = maximal_conversations(turns, starts).select(
        F.col("conv_id").alias("_kept"), "n_logged"
    )
    # By conversation and stretch, so that no conversation is joined in one place.
    places = stash(
        starts.join(kept, F.col("_conv").eqNullSafe(F.col("_kept"))).select(
            "_conv", "_stretch", "shift", "n_turns", "n_logged"
        ),
        "maximal",
    )
    shown = turns.join(places, _of_stretch()).withColumn(
        "part", F.floor((F.col("at") - F.col("shift") - 1) / block_turns)
    )
    ordered = F.array_sort(F.collect_list(F.struct("at", "role", "text")))
    return shown.groupBy("conv_id", "part").agg(
        F.any_value("n_turns").alias("n_turns"),
        F.any_value("n_logged").alias("n_logged"),
        F.array_join(F.transform(ordered, lambda t: render(t["role"], t["text"])), "").alias(
            "text"
        ),
    )
