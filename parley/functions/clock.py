"""Times without zone: every operator takes its 'now' as an argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_SECONDS = 86400

# Weekday names, Sunday first.
WEEKDAY_NAMES = ("星期日", "星期一", "星期二", "星期三", "星期四", "星期五", "星期六")


def moment(as_of: datetime | str | Column) -> Column:
    """A point in time as a zone-less timestamp column."""
    if isinstance(as_of, Column):
        return as_of.cast("timestamp_ntz")
    text = as_of.isoformat(sep=" ") if isinstance(as_of, datetime) else as_of
    return F.lit(text).cast("timestamp_ntz")


def hours_before(as_of, hours) -> Column:
    """`hours` (a number or a column) before `as_of`."""
    count = hours if isinstance(hours, Column) else F.lit(hours)
    return moment(as_of) - F.make_dt_interval(hours=count.cast("int"))


def hours_after(as_of, hours: int) -> Column:
    return moment(as_of) + F.make_dt_interval(hours=F.lit(hours))


def epoch_of(time: Column) -> Column:
    """Seconds since 1970 of a zone-less timestamp, whatever the session zone."""
    return (
        F.unix_date(F.to_date(time)).cast("long") * DAY_SECONDS
        + F.hour(time) * 3600
        + F.minute(time) * 60
        + F.second(time)
    )


def from_epoch(seconds: Column, offset_hours: int = 0) -> Column:
    """Zone-less timestamp of epoch seconds, read at a fixed offset from UTC."""
    shifted = seconds.cast("long") + offset_hours * 3600
    days = F.floor(shifted / DAY_SECONDS).cast("int")
    return F.lit("1970-01-01").cast("timestamp_ntz") + F.make_dt_interval(
        days=days, secs=F.pmod(shifted, F.lit(DAY_SECONDS)).cast("decimal(18,6)")
    )


def local_time(seconds: Column, zone: str | Column) -> Column:
    """What clocks of a named zone show at epoch seconds, as a zone-less timestamp."""
    return F.convert_timezone(F.lit("UTC"), _zone(zone), from_epoch(seconds))


def instant_of(local: Column, zone: str | Column) -> Column:
    """Epoch seconds at which clocks of a named zone show `local`.

    A time that clocks show twice, as they are set back, is the first of the two. One they leave out, as
    they are set forward, is no instant, and gives null.
    """
    there = F.convert_timezone(_zone(zone), F.lit("UTC"), local)
    shown = F.convert_timezone(F.lit("UTC"), _zone(zone), there)
    return F.when(shown == local, epoch_of(there))


def _zone(zone: str | Column) -> Column:
    return zone if isinstance(zone, Column) else F.lit(zone)


def epoch_seconds(value: Column) -> Column:
    """Epoch values come in seconds or milliseconds; give seconds (Q7)."""
    return F.when(value > 100_000_000_000, F.floor(value / 1000)).otherwise(value).cast("long")


def time_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def spoken_now(as_of) -> Column:
    """Date, time and weekday name as one text, in a fixed pattern."""
    now = moment(as_of)
    names = F.array(*[F.lit(n) for n in WEEKDAY_NAMES])
    return F.concat_ws(
        " ", F.date_format(now, "yyyy/M/d HH:mm:ss"), F.element_at(names, F.dayofweek(now))
    )


def parsed_time(text: Column) -> Column:
    """Time in a text column; empty and unreadable text give null."""
    return F.nullif(text, F.lit("")).try_cast("timestamp_ntz")


def validity_state(start: Column, end: Column, as_of) -> Column:
    """0 not yet valid, 1 valid, 2 over, for text bounds against `as_of`.

    An empty bound is open, both bounds are inclusive, a ten-character end is
    the whole day, and text that is no time satisfies neither bound.
    """
    now = moment(as_of)
    opens = parsed_time(start)
    closes = parsed_time(end)
    closes = F.when(
        F.length(end) == 10, closes + F.expr("INTERVAL '1' DAY") - F.expr("INTERVAL '0.000001' SECOND")
    ).otherwise(closes)
    no_start = F.coalesce(start, F.lit("")) == ""
    no_end = F.coalesce(end, F.lit("")) == ""
    return (
        F.when(F.coalesce(now > closes, F.lit(False)), 2)
        .when(
            (no_start | F.coalesce(now >= opens, F.lit(False)))
            & (no_end | F.coalesce(now <= closes, F.lit(False))),
            1,
        )
        .otherwise(0)
    )
