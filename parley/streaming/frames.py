"""Message frames as a stream: the ingest operators on Structured Streaming.

Storing takes no state: copies are found in the batch and in the table, however
late they come, and a batch that runs again replaces what it wrote. Bursts need event time: for them, frames are deduplicated as far
back as the watermark reaches, later ones are left out, and only the bounds and
counts of open bursts are state. The texts of a burst are joined from the routed
messages once it is closed, so no long text is held in state.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parley.functions.ordered import (
    WINDOW_ROWS,
    id_block,
    latest_value,
    split_groups,
    with_previous,
)
from parley.operators.ingest import (
    BURST_GAP_SECONDS,
    IGNORED,
    MEMBER_AI,
    dedup_messages,
    drop_senderless,
    merge_assigned,
    new_messages,
    route_messages,
    to_message_rows,
)
from parley.sources.documents import parse_frames
from parley.sources.store import stored_copies, version_for, write_batch
from parley.sources.tables import newest_version

DEFAULT_WATERMARK = "1 minute"


def route_stream(
    raw: DataFrame, accounts: DataFrame, friends: DataFrame, strict: bool = True
) -> DataFrame:
    """Raw frames to routed messages, copies included, without the ignored ones."""
    good, _ = parse_frames(raw, strict)
    routed = route_messages(drop_senderless(good), accounts, friends)
    return routed.where(F.col("route") != IGNORED)


def dedup_stream(
    frames: DataFrame, watermark: str = DEFAULT_WATERMARK, received: Column | None = None
) -> DataFrame:
    """Frames seen once by `msg_id`, as far back as the watermark reaches (T2). Frames without an
    id are told apart by their `arrival`.

    A frame without a time counts as sent at `received` (epoch seconds), by
    default when it is processed. A replay should pass the time of recording.
    """
    now = F.unix_timestamp() if received is None else received
    sent = F.coalesce(F.nullif("create_time", F.lit(0).cast("long")), now)
    timed = frames.withColumn("create_time", sent).withColumn(
        "event_time", F.timestamp_seconds("create_time")
    )
    own = F.when(F.col("msg_id").isNull(), F.col("arrival"))
    once = timed.withColumn("_own", own).withWatermark("event_time", watermark)
    return once.dropDuplicatesWithinWatermark(["msg_id", "_own"]).drop("_own")


def process_stream(
    raw: DataFrame,
    accounts: DataFrame,
    friends: DataFrame,
    watermark: str = DEFAULT_WATERMARK,
    strict: bool = True,
    received: Column | None = None,
    ignored: bool = False,
) -> DataFrame:
    """Raw frames to routed messages, once each, for the bursts.

    With `ignored`, messages that are not routed are kept: where the result is stored and read
    as a stream again, they too move the time on.
    """
    good, _ = parse_frames(raw, strict)
    once = dedup_stream(drop_senderless(good), watermark, received)
    routed = route_messages(once, accounts, friends)
    return routed if ignored else routed.where(F.col("route") != IGNORED)


def read_routed(
    spark: SparkSession, path: str, schema, watermark: str = DEFAULT_WATERMARK
) -> DataFrame:
    """The stored output of `process_stream` as a stream again.

    Bursts of it see the frames, and the times of those without one, just as they were stored.
    """
    stored = spark.readStream.schema(schema).parquet(path)
    return stored.withWatermark("event_time", watermark)


def burst_ranges_stream(
    routed: DataFrame,
    gap: int = BURST_GAP_SECONDS,
    keys: Sequence[str] = ("from_user", "to_user"),
) -> DataFrame:
    """Closed bursts of messages for the AI: `keys`, bounds and count (T4, Q10).

    A burst is closed when the watermark has passed its end.
    """
    # With the time in it, the condition is not pushed below the watermark, which other messages move on.
    answered = F.when(F.col("event_time").isNotNull(), F.col("route")) == MEMBER_AI
    bursts = routed.where(answered).groupBy(
        *[F.coalesce(k, F.lit("")).alias(k) for k in keys],
        F.session_window("event_time", f"{gap} seconds").alias("_session"),
    )
    return bursts.agg(
        F.count(F.lit(1)).alias("message_count"),
        F.min("create_time").alias("burst_start"),
        F.max("create_time").alias("last_received"),
    ).drop("_session")


def merge_closed_bursts(
    ranges: DataFrame,
    routed: DataFrame,
    id_col: str = "arrival",
    keys: Sequence[str] = ("from_user", "to_user"),
) -> DataFrame:
    """Texts of closed bursts, from the routed messages between their bounds.

    Each message takes the latest burst that began at or before it, so
    messages and bursts of one sender are never paired up.
    """
    keys = list(keys)
    members = routed.where(F.col("route") == MEMBER_AI).select(
        *[F.coalesce(k, F.lit("")).alias(k) for k in keys],
        "create_time",
        F.col(id_col).cast("long").alias(id_col),
        "content",
        F.lit(1).alias("_kind"),
    )
    starts = ranges.select(
        *keys,
        F.col("burst_start").alias("create_time"),
        F.lit(0).alias("_kind"),
        F.struct("burst_start", "last_received").alias("_bounds"),
    )
    both = members.unionByName(starts, allowMissingColumns=True)
    order = ["create_time", "_kind", id_col]
    levels = [
        F.floor(F.col("create_time") / 3600),
        F.col("create_time"),
        F.col("_kind"),
        id_block(id_col, WINDOW_ROWS),
    ]
    rows, split = split_groups(both, keys, levels, WINDOW_ROWS)
    rows = with_previous(rows, keys, order, "_kind", split)
    mark = F.when(F.col("_kind") == 0, F.struct("_bounds", "_number"))
    known = latest_value(rows.withColumn("_mark", mark), keys, order, "_mark", "_burst", split)
    bounds = F.col("_burst._bounds")
    inside = (F.col("_kind") == 1) & (F.col("create_time") <= bounds["last_received"])
    found = known.where(inside).select(
        *keys,
        "create_time",
        "content",
        bounds["burst_start"].alias("burst_start"),
        (F.col("_number") - F.col("_burst._number") - 1).alias("burst_position"),
    )
    return merge_assigned(found, keys)


def store_batch(
    batch: DataFrame,
    messages_path: str,
    as_of,
    look_back_hours: int | None = None,
    writer: str = "batch",
    batch_id: int = 0,
) -> None:
    """Write one micro-batch of routed messages to the message store.

    Of copies in the batch the first to arrive counts; ids already stored are left out, and only partitions
    that hold the hash of one of the ids are read for that. A batch (`writer`, `batch_id`) that runs again
    replaces its rows, so it adds nothing, with ids or without.
    With `look_back_hours`, only rows stored since then are compared: for long
    tables of which copies cannot come later than that.
    """
    rows = to_message_rows(dedup_messages(batch, ["arrival"]), as_of).persist()
    try:
        stored = stored_copies(rows, messages_path, writer, batch_id, as_of, look_back_hours)
        # Written twice, as hashes and as rows.
        fresh = rows if stored is None else new_messages(rows, stored).persist()
        try:
            write_batch(fresh, messages_path, writer, batch_id)
        finally:
            fresh.unpersist()
    finally:
        rows.unpersist()


def _writer(batch: DataFrame) -> str:
    """The id of the stream a batch is of. It stays the same for one checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def _moment_of(as_of):
    """`as_of`, what it gives when called, or the present (UTC)."""
    if as_of is None:
        return datetime.now(timezone.utc).replace(tzinfo=None)
    return as_of() if callable(as_of) else as_of


def _trigger(every: str | None) -> dict:
    """Go on with a batch `every` so long, or else stop after all the data there is now."""
    return {"processingTime": every} if every else {"availableNow": True}


def store_stream(
    routed: DataFrame,
    messages_path: str,
    checkpoint: str,
    as_of=None,
    look_back_hours: int | None = None,
    every: str | None = None,
) -> StreamingQuery:
    """Start storing the messages of `route_stream` batch by batch.

    `as_of` is a moment, a function that gives one for each batch, or by default the present. With
    `every`, such as `10 seconds`, the stream keeps running.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        store_batch(
            batch, messages_path, _moment_of(as_of), look_back_hours, _writer(batch), batch_id
        )

    return (
        routed.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def store_frames(
    raw: DataFrame,
    tables: Mapping[str, str],
    messages_path: str,
    checkpoint: str,
    as_of=None,
    look_back_hours: int | None = None,
    strict: bool = True,
    every: str | None = None,
    load: Callable[[SparkSession, str], DataFrame] | None = None,
) -> StreamingQuery:
    """Start routing and storing raw frames with tables that change.

    `tables` names the folders of versions (`write_version`) of `accounts` and `friends`. Each batch is
    routed by the newest version there is when it first runs; if it runs again, by the same one. `load` reads
    a version, by default as Parquet.
    """
    read = load or (lambda spark, path: spark.read.parquet(path))

    def store(batch: DataFrame, batch_id: int) -> None:
        spark, writer = batch.sparkSession, _writer(batch)
        newest = {name: newest_version(spark, root) for name, root in tables.items()}
        used = version_for(spark, messages_path, writer, batch_id, newest)
        good, _ = parse_frames(batch, strict)
        routed = route_messages(
            drop_senderless(good), read(spark, used["accounts"]), read(spark, used["friends"])
        )
        store_batch(
            routed.where(F.col("route") != IGNORED), messages_path, _moment_of(as_of),
            look_back_hours, writer, batch_id,
        )

    return (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )


def run_stream(
    df: DataFrame, path: str, checkpoint: str, every: str | None = None
) -> StreamingQuery:
    """Start writing a stream to a Parquet table: all data there is now, or a batch `every` so long."""
    return (
        df.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**_trigger(every))
        .start(path)
    )
