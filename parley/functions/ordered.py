"""Ordered work within groups that stays spread out when one group is very large.

A window over a key puts all rows of the key in one task, and a collected list
puts them in one row. Here the sizes of the groups are checked first, and a
group over a limit is split along its order: by stretches of time, then by
blocks of ids, until no part is over the limit. Windows then run per part, and
one value per part is carried from part to part.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.sources.tables import shared_dir

# Rows of a burst or reminder in one row, and groups up to this size sorted in one task.
PART_ROWS = 10_000
WINDOW_ROWS = 1_000_000
# Tables of up to this many rows are broadcast, after they have been counted.
BROADCAST_ROWS = 100_000
# Stands for a missing level: sorts first, as nulls do.
_NULL_LEVEL = -(2**63)


def no_part() -> Column:
    """The part of a group that is not split."""
    return F.array().cast("array<bigint>")


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True if a count that stops at `max_rows` finds no more rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if it has at most `max_rows` rows.

    Worth its count where the other side of the join is a large table that
    would be shuffled otherwise. A larger `df` is left to the planner.
    """
    return F.broadcast(df) if is_small(df, max_rows) else df


def kept(rows: DataFrame, purpose: str) -> DataFrame:
    """`rows`, worked out once: written to the shared folder and read again.

    Rows with columns that Parquet has no type for are left as they are.
    """
    if re.search(r"[:<](void|interval|variant)\b", rows.schema.simpleString()):
        return rows
    spark = rows.sparkSession
    path = shared_dir(spark, purpose)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def left_join_unique(
    rows: DataFrame,
    side: DataFrame,
    keys: Sequence[str],
    broadcast_rows: int = BROADCAST_ROWS,
    heavy_rows: int = WINDOW_ROWS,
) -> DataFrame:
    """Left join to a table that is unique by `keys`, spread out when keys are heavy.

    Adaptive execution does not split skewed partitions of a join to an
    aggregate. So a small `side` is broadcast, and for a large one the rows of
    keys with more than `heavy_rows` rows, and of null keys, are joined to the
    few side rows of just those keys, by broadcast. The rows are counted and then
    joined, so with a large `side` they are kept in the shared folder, and what they
    come from, such as parsed text, is worked out once. A stream is joined plainly.
    """
    columns = [*rows.columns, *[c for c in side.columns if c not in keys]]
    if rows.isStreaming:
        return rows.join(side, list(keys), "left").select(*columns)
    if is_small(side, broadcast_rows):
        return rows.join(F.broadcast(side), list(keys), "left").select(*columns)
    rows = kept(rows, "joined-rows")
    heavy = (
        rows.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > heavy_rows)
        .select(*keys)
    )
    count = heavy.limit(broadcast_rows + 1).count()
    if count == 0 or count > broadcast_rows:
        return rows.join(side, list(keys), "left").select(*columns)
    flag = heavy.withColumn("_heavy", F.lit(True))
    marked = rows.join(F.broadcast(flag), list(keys), "left")
    null_key = reduce(or_, [F.col(k).isNull() for k in keys])
    is_heavy = F.col("_heavy").isNotNull() | null_key
    heavy_side = side.join(F.broadcast(heavy), list(keys), "left_semi")
    spread = marked.where(is_heavy).join(F.broadcast(heavy_side), list(keys), "left")
    plain = marked.where(~is_heavy).join(side, list(keys), "left")
    return plain.select(*columns).unionByName(spread.select(*columns))


def _left_join_same(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left"
) -> DataFrame:
    """Left join in which null keys are equal, as they are in a grouping."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys]
    return left.join(renamed, reduce(and_, same), how).drop(*[f"_right_{k}" for k in keys])


def split_groups(
    rows: DataFrame, keys: Sequence[str], levels: Sequence[Column], size: int
) -> tuple[DataFrame, bool]:
    """Add `part`, an array that splits every group of more than `size` rows.

    A group of up to `size` rows has the empty part. A larger one is split by
    the first level, what is then still too large by the next, and so on. Levels
    are whole numbers that do not decrease along the order of the group, so the
    parts of a group, sorted, keep that order. If the last level is a block of
    at most `size` unique ids, no (keys, part) holds more than `size` rows.

    The sizes come from an aggregate over the keys alone, combined before its
    shuffle. In the usual case it finds no large group, the rows are not
    touched, and the second result is False.
    """
    part = no_part()
    names = [f"_level{i}" for i in range(len(levels))]
    leveled = rows.withColumns(
        {
            n: F.coalesce(level.cast("long"), F.lit(_NULL_LEVEL))
            for n, level in zip(names, levels)
        }
    )
    marked, judged, found = leveled, leveled, False
    for depth, name in enumerate(names):
        group = [*keys, *names[:depth]]
        flag = f"_large{depth}"
        large = (
            judged.groupBy(*group)
            .agg(F.count(F.lit(1)).alias("_rows"))
            .where(F.col("_rows") > size)
            .select(*group, F.lit(True).alias(flag))
        )
        count = large.limit(BROADCAST_ROWS + 1).count()
        if count == 0:
            break
        found = True
        side = F.broadcast(large) if count <= BROADCAST_ROWS else large
        marked = _left_join_same(marked, side, group)
        # Only rows of large groups are judged by the next level.
        judged = _left_join_same(judged, side, group, "left_semi")
        part = F.when(F.col(flag), F.concat(part, F.array(F.col(name)))).otherwise(part)
    return marked.withColumn("part", part).select(*rows.columns, "part"), found


def split_large_groups(
    rows: DataFrame, keys: Sequence[str], levels: Sequence[Column], size: int | None = None
) -> DataFrame:
    """`split_groups` for callers that treat all groups alike; without `size` none is split."""
    if size is None:
        return rows.withColumn("part", no_part())
    return split_groups(rows, keys, levels, size)[0]


def with_previous(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    split: bool,
    out: str = "_previous",
    number: str = "_number",
) -> DataFrame:
    """Add `lag(value)` and `row_number()` within `keys` by `order`.

    With `split`, `rows` has the `part` column of `split_groups`. What a part
    takes from the parts before it, their last value and their row count, comes
    from an aggregate of the rows as they are, ahead of any window.
    """
    group = [*keys, "part"] if split else list(keys)
    window = Window.partitionBy(*group).orderBy(*order)
    if not split:
        return rows.withColumns(
            {out: F.lag(value).over(window), number: F.row_number().over(window).cast("long")}
        )
    one = F.struct(F.col(value).alias("v"))
    ends = rows.groupBy(*group).agg(
        F.max_by(one, F.struct(*order)).alias("_end"), F.count(F.lit(1)).alias("_rows")
    )
    following = Window.partitionBy(*keys).orderBy("part")
    earlier = following.rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(
        *group,
        F.lag("_end").over(following).alias("_end"),
        F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_rows"),
    )
    before = F.coalesce(F.lag(one).over(window), F.col("_end"))
    return _left_join_same(rows, carried, group).select(
        *rows.columns,
        before["v"].alias(out),
        (F.col("_rows") + F.row_number().over(window)).alias(number),
    )


def latest_value(
    rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, out: str, split: bool
) -> DataFrame:
    """The last non-null `value` up to each row within `keys` by `order`."""
    start = Window.unboundedPreceding
    if not split:
        window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(start, Window.currentRow)
        return rows.withColumn(out, F.last(value, ignorenulls=True).over(window))
    inner = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(start, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(start, -1)
    ends = rows.groupBy(*keys, "part").agg(
        F.max_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_end")
    )
    carried = ends.select(
        *keys, "part", F.last("_end", ignorenulls=True).over(earlier).alias("_carried")
    )
    known = rows.withColumn("_so_far", F.last(value, ignorenulls=True).over(inner))
    return _left_join_same(known, carried, [*keys, "part"]).select(
        *rows.columns, F.coalesce("_so_far", "_carried").alias(out)
    )


def pack_ordered(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: Column,
    levels: Sequence[Column] = (),
    size: int | None = None,
) -> DataFrame:
    """One row per group with its values as an ordered array: `keys, part, items`.

    With `size`, groups of more rows than that come in several rows, ordered by `part`.
    """
    parts = split_large_groups(rows, keys, levels, size)
    listed = F.array_sort(F.collect_list(F.struct(*order, value.alias("_value"))))
    return (
        parts.groupBy(*keys, "part")
        .agg(listed.alias("_listed"))
        .select(*keys, "part", F.transform("_listed", lambda x: x["_value"]).alias("items"))
    )


def time_levels(time: str, id_col: str, size: int | None) -> list[Column]:
    """Levels for rows in order of epoch seconds, then unique id: hour, second, block of ids."""
    return [F.floor(F.col(time) / 3600), F.col(time), id_block(id_col, size)]


def id_block(column: str, size: int | None = None) -> Column:
    """Block of `size` consecutive ids a row falls in."""
    return F.floor(F.col(column) / (size or PART_ROWS))


def part_text(part: Column) -> Column:
    return F.array_join(part, ".")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The lowest row by `order` for every key, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    row = F.min_by(F.struct(*others), F.struct(*order))
    return (
        df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)
    )


def last_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The highest row by `order` for every key, combined before the shuffle."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    row = F.max_by(F.struct(*others), F.struct(*order))
    return (
        df.groupBy(*keys).agg(row.alias("_row")).select(*keys, "_row.*").select(*df.columns)
    )


def numbered_ids(
    rows: DataFrame, keys: Sequence[str], highest: Column, partitions: int | None = None
) -> DataFrame:
    """Give new rows consecutive ids after the highest id in use, in order of `keys`, in column `id`.

    `keys` must be unique in `rows`; nulls come first. Rows are dealt by ranges of the keys, sorted, and
    written to the shared folder with their place in the range; each range starts after the rows of the
    ranges before it. Only the counts of the ranges are put in one place. As the rows are written once,
    a task that runs again finds the same ids.
    """
    spark = rows.sparkSession
    dealt = (
        rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    )
    # A number of the partition in the upper bits, of the row in it in the lower 33.
    placed = dealt.sortWithinPartitions(*keys).withColumn("_place", F.monotonically_increasing_id())
    path = shared_dir(spark, "new-rows")
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).withColumn(
        "_range", F.shiftright("_place", 33)
    )
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")
    )
    number = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return (
        stored.join(F.broadcast(offsets), "_range")
        .withColumn("id", highest + F.col("_offset") + number)
        .drop("_range", "_place", "_offset")
    )
