"""Connection states as a stream: state per connection, of which only changes come out."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from parley.functions.clock import epoch_of, from_epoch
from parley.operators.ingest import UNKNOWN_STATE_CODE, state_code, ws_status_patches
from parley.streaming.frames import _trigger

_CHANGE = (
    "url string, event_id long, state string, previous_state string, at_us long, since_us long"
)
_COLUMNS = ["url", "event_id", "state", "previous_state", "at_us", "since_us"]


#: The state now, the last event counted, and the time of the first one.
_NOW = "state string, at_us long, event_id long, since_us long"


def _changes(key, batches: Iterator[pd.DataFrame], now: GroupState) -> Iterator[pd.DataFrame]:
    """The events of a connection that change its state."""
    state, last, since = None, (), None
    if now.exists:
        state, *last, since = now.get
    rows = sorted(
        row for b in batches for row in zip(b["at_us"], b["event_id"], b["state"], strict=True)
    )
    out = []
    for at, event_id, found in rows:
        if last and (at, event_id) <= tuple(last):
            # Comes late, or again: what is known is newer.
            continue
        since = at if since is None else since
        if not last or found != state:
            out.append((key[0], event_id, found, state, at, since))
        state, last = found, (at, event_id)
    if last:
        now.update((state, *map(int, last), int(since)))
    if out:
        yield pd.DataFrame(out, columns=_COLUMNS)


def state_changes_stream(state_events: DataFrame) -> DataFrame:
    """The events that change the state of their connection, the first one included.

    `state_events` is a stream of `url, state, timestamp` (without zone) and a unique `event_id`. Gives
    the event with `previous_state`, `state_code`, and `since`, the time of the connection's first event.
    Events of a batch count in order of time and id. An event that is not later than the last one seen
    of its connection in a batch before changes nothing, so a batch that comes again gives nothing. Events
    without a connection, a state or a time are left out.
    """
    time = F.col("timestamp").cast("timestamp_ntz")
    micros = F.date_format(time, "SSSSSS").cast("long")
    events = state_events.where(
        F.col("url").isNotNull() & F.col("state").isNotNull() & time.isNotNull()
    ).select(
        "url", "state", F.col("event_id").cast("long").alias("event_id"),
        (epoch_of(time) * 1_000_000 + micros).alias("at_us"),
    )
    found = events.groupBy("url").applyInPandasWithState(
        _changes, _CHANGE, _NOW, "append", GroupStateTimeout.NoTimeout
    )

    def wall(us: str) -> Column:
        rest = (F.col(us) % 1_000_000).cast("decimal(18,6)") / 1_000_000
        seconds = from_epoch(F.floor(F.col(us) / 1_000_000))
        return seconds + F.make_dt_interval(secs=rest.cast("decimal(18,6)"))

    return found.select(
        "url", "event_id", "state", "previous_state", wall("at_us").alias("timestamp"),
        wall("since_us").alias("since"), state_code(F.col("state"), UNKNOWN_STATE_CODE).alias("state_code"),
    )


def newest_states(changes: DataFrame) -> DataFrame:
    """`url, state` of each connection after the given changes."""
    latest = F.max_by("state", F.struct("timestamp", "event_id"))
    return changes.groupBy("url").agg(latest.alias("state"))


def write_status_patches(
    changes: DataFrame, accounts, path: str, checkpoint: str, url_col: str = "auth_key",
    every: str | None = None,
) -> StreamingQuery:
    """Start writing, for each batch of changes, the accounts whose stored status is another.

    `accounts` is called for each batch, so that it sees what was patched before. Only accounts whose
    connection changes in the batch are looked at. A batch is written by its number, in place of what it
    wrote before. What `ws_status_patches` makes of accounts without a connection is left to it.
    """

    def patch(batch: DataFrame, batch_id: int) -> None:
        now = newest_states(batch).persist()
        try:
            asked = accounts().join(
                now.select(F.col("url").alias(url_col)), url_col, "left_semi"
            )
            ws_status_patches(asked, now, url_col).write.mode("overwrite").parquet(
                f"{path.rstrip('/')}/batch={batch_id}"
            )
        finally:
            now.unpersist()

    return (
        changes.writeStream.foreachBatch(patch)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(every))
        .start()
    )
