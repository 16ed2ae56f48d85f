"""Cron rows of six fields (second minute hour day month weekday) as expressions (K7-K9).

Lists, ranges, steps, `*` and `?` are understood; weekdays 0 and 7 are Sunday.
When day and weekday are both restricted, a date matches if either does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parley.functions.values import BLANKS, literal_map

# Field names with their lowest and highest number.
FIELDS = {
    "second": (0, 59),
    "minute": (0, 59),
    "hour": (0, 23),
    "day": (1, 31),
    "month": (1, 12),
    "weekday": (0, 7),
}

# Words of the readable form.
WEEKDAYS = {
    "0": "周日", "1": "周一", "2": "周二", "3": "周三", "4": "周四", "5": "周五", "6": "周六",
    "7": "周日",
}
WEEKDAYS_SHORT = {
    "0": "日", "1": "一", "2": "二", "3": "三", "4": "四", "5": "五", "6": "六", "7": "日",
}
MONTHS = {str(n): f"{n}月" for n in range(1, 13)}
INVALID = "无效的Cron表达式: "

TERM = r"^(\*|\?|[0-9]{1,4}(-[0-9]{1,4})?)(/[0-9]{1,4})?$"


def split_fields(cron: Column) -> Column:
    """The blank-separated fields of a cron text."""
    return F.split(F.btrim(cron, F.lit(BLANKS)), f"[{BLANKS}]+")


def named_fields(fields: Column) -> dict[str, Column]:
    return {name: F.get(fields, i) for i, name in enumerate(FIELDS)}


# --- values and dates -------------------------------------------------------


def _listed_values(text: Column, low: int, high: int) -> Column:
    """Numbers of a field made of lists, ranges and steps; null if it is not valid."""

    def bounds(term: Column) -> tuple[Column, Column, Column]:
        base = F.substring_index(term, "/", 1)
        step = F.when(F.contains(term, F.lit("/")), F.substring_index(term, "/", -1).try_cast("int"))
        every = base.isin("*", "?")
        start = F.when(every, F.lit(low)).otherwise(F.substring_index(base, "-", 1).try_cast("int"))
        single = step.isNull() & ~F.contains(base, F.lit("-"))
        stop = (
            F.when(every, F.lit(high))
            .when(F.contains(base, F.lit("-")), F.substring_index(base, "-", -1).try_cast("int"))
            .when(single, start)
            .otherwise(F.lit(high))
        )
        return start, stop, F.coalesce(step, F.lit(1))

    def numbers(term: Column) -> Column:
        start, stop, step = bounds(term)
        valid = term.rlike(TERM) & (start >= low) & (stop <= high) & (start <= stop) & (step > 0)
        return F.when(valid, F.sequence(start, stop, step))

    # A term that is not valid is null, and makes the flattened list null.
    return F.array_sort(F.array_distinct(F.flatten(F.transform(F.split(text, ","), numbers))))


def field_values(text: Column, low: int, high: int) -> Column:
    """The numbers a field stands for, ascending; null if the field is not valid.

    Wildcards and single numbers, which most fields are, take no list functions.
    """
    number = text.try_cast("int")
    return (
        F.when(text.isin("*", "?"), F.array(*[F.lit(n) for n in range(low, high + 1)]))
        .when(text.rlike("^[0-9]{1,4}$"), F.when(number.between(low, high), F.array(number)))
        .otherwise(_listed_values(text, low, high))
    )


Plan = dict[str, Column]


def schedule_columns(fields: Column) -> Plan:
    """The value arrays of all fields of a cron split in fields; null where not valid."""
    six = F.size(fields) == len(FIELDS)
    parts = named_fields(fields)
    values = {
        name: F.when(six, field_values(parts[name], low, high))
        for name, (low, high) in FIELDS.items()
    }
    sunday = F.array_contains(values["weekday"], 7)
    zero_based = F.array_sort(F.array_distinct(F.transform(values["weekday"], lambda x: x % 7)))
    values["weekday"] = F.when(sunday, zero_based).otherwise(values["weekday"])
    return values


def is_valid(plan: Plan) -> Column:
    """True if all fields of a schedule are valid."""
    ok = F.lit(True)
    for name in FIELDS:
        ok = ok & plan[name].isNotNull()
    return ok


def runs_on(plan: Plan, date: Column) -> Column:
    """True if the schedule has fires on a date."""
    day = F.array_contains(plan["day"], F.dayofmonth(date))
    weekday = F.array_contains(plan["weekday"], F.dayofweek(date) - 1)
    any_day = F.size(plan["day"]) == 31
    any_weekday = F.size(plan["weekday"]) == 7
    in_month = F.array_contains(plan["month"], F.month(date))
    return in_month & F.when(any_day, weekday).when(any_weekday, day).otherwise(day | weekday)


def at_second(date: Column, second_of_day: Column) -> Column:
    return F.timestamp_add("SECOND", second_of_day, date.cast("timestamp_ntz"))


NEAR_DAYS = 31


def next_after(plan: Plan, now: Column, horizon_days: int) -> Column:
    """The first fire after `now`, null if there is none within the horizon."""
    today = F.to_date(now)
    hour, minute, second = F.hour(now), F.minute(now), F.second(now)

    def first(name: str, above: Column | None = None) -> Column:
        values = plan[name]
        return F.array_min(values if above is None else F.filter(values, lambda x: x > above))

    start = first("hour") * 3600 + first("minute") * 60 + first("second")
    same_hour = F.array_contains(plan["hour"], hour)
    same_minute = same_hour & F.array_contains(plan["minute"], minute)
    later_second = first("second", second)
    later_minute = first("minute", minute)
    later_hour = first("hour", hour)
    rest_of_today = (
        F.when(same_minute & later_second.isNotNull(), hour * 3600 + minute * 60 + later_second)
        .when(
            same_hour & later_minute.isNotNull(),
            hour * 3600 + later_minute * 60 + first("second"),
        )
        .when(
            later_hour.isNotNull(),
            later_hour * 3600 + first("minute") * 60 + first("second"),
        )
    )

    def first_day(after: int, until: int) -> Column:
        days = F.sequence(F.date_add(today, after), F.date_add(today, until))
        return F.array_min(F.filter(days, lambda d: runs_on(plan, d)))

    # Most schedules run within a month, so the far days are looked at only if need be.
    near = min(NEAR_DAYS, horizon_days)
    later_day = first_day(1, near)
    if horizon_days > near:
        later_day = F.coalesce(later_day, first_day(near + 1, horizon_days))
    # A schedule for every day needs no search.
    every_day = (
        (F.size(plan["day"]) == 31) & (F.size(plan["month"]) == 12) & (F.size(plan["weekday"]) == 7)
    )
    later_day = F.when(every_day, F.date_add(today, 1)).otherwise(later_day)
    second_today = F.when(runs_on(plan, today), rest_of_today)
    return F.when(
        is_valid(plan),
        F.coalesce(at_second(today, second_today), at_second(later_day, start)),
    )


# --- readable form ----------------------------------------------------------


def _is_set(part: Column) -> Column:
    return ~part.isin("*", "?")


def _named(value: Column, names: dict[str, str]) -> Column:
    if not names:
        return value
    return F.coalesce(F.try_element_at(literal_map(names), value), value)


def _list_text(part: Column, names: dict[str, str]) -> Column:
    return F.array_join(F.transform(F.split(part, ","), lambda v: _named(v, names)), "、")


def _range_text(part: Column, names: dict[str, str]) -> Column:
    ends = F.split(part, "-")
    return F.concat(_named(F.get(ends, 0), names), F.lit("到"), _named(F.get(ends, 1), names))


def _has(part: Column, mark: str) -> Column:
    return F.contains(part, F.lit(mark))


def _numbers_text(part: Column, names: dict[str, str]) -> Column:
    return (
        F.when(_has(part, ","), _list_text(part, names))
        .when(_has(part, "-"), _range_text(part, names))
        .otherwise(_named(part, names))
    )


def _part_text(part: Column, unit: str, names: dict[str, str]) -> Column:
    return (
        F.when(part.rlike("^[0-9]+$"), F.concat(_named(part, names), F.lit(unit)))
        .when(_has(part, ","), F.concat(_list_text(part, names), F.lit(unit)))
        .when(_has(part, "-"), F.concat(_range_text(part, names), F.lit(unit)))
        .when(_has(part, "/"), F.concat(F.lit("每"), F.get(F.split(part, "/"), 1), F.lit(unit)))
        .otherwise(part)
    )


def _two_digits(part: Column) -> Column:
    return F.when(F.length(part) < 2, F.lpad(part, 2, "0")).otherwise(part)


def _time_text(f: dict[str, Column]) -> Column:
    clock = F.concat_ws(":", _two_digits(f["hour"]), _two_digits(f["minute"]))
    seconds = F.concat(clock, F.lit(":"), _two_digits(f["second"]))
    return F.when(f["second"].isin("0", "00"), clock).otherwise(seconds)


def _full_date_text(f: dict[str, Column]) -> Column:
    return F.concat(
        _numbers_text(f["month"], MONTHS),
        _numbers_text(f["day"], {}),
        F.lit("日"),
        _numbers_text(f["weekday"], WEEKDAYS),
        F.lit(" "),
        _time_text(f),
        F.lit("执行"),
    )


def _timed_text(f: dict[str, Column]) -> Column:
    on_day = F.concat(F.lit("每月"), _numbers_text(f["day"], {}), F.lit("日"))
    on_weekday = F.concat(F.lit("每周"), _numbers_text(f["weekday"], WEEKDAYS))
    in_month = F.concat(F.lit("每年"), _numbers_text(f["month"], MONTHS))
    conditions = F.array_compact(
        F.array(
            F.when(_is_set(f["day"]), on_day),
            F.when(_is_set(f["weekday"]), on_weekday),
            F.when(_is_set(f["month"]), in_month),
        )
    )
    limited = F.when(
        F.size(conditions) > 0, F.concat(F.lit("，"), F.array_join(conditions, "且"))
    ).otherwise(F.lit(""))
    return F.concat(F.lit("每天"), _time_text(f), limited, F.lit("执行"))


def _general_text(f: dict[str, Column]) -> Column:
    second = F.when(f["second"].isin("0", "*"), F.lit("")).otherwise(
        F.concat(f["second"], F.lit("秒"))
    )
    minute = F.when(f["minute"] == "*", F.lit("每分钟")).otherwise(_part_text(f["minute"], "分", {}))
    hour = F.when(f["hour"] == "*", F.lit("每小时")).otherwise(_part_text(f["hour"], "点", {}))
    dates = F.concat_ws(
        "、",
        F.when(f["day"] != "*", _part_text(f["day"], "日", {})),
        F.when(f["month"] != "*", _part_text(f["month"], "月", {})),
        F.when(f["weekday"] != "*", _part_text(f["weekday"], "周", WEEKDAYS_SHORT)),
    )
    return F.concat(second, minute, hour, dates, F.lit("执行"))


def describe(cron: Column, fields: Column | None = None) -> Column:
    """A cron text in words (K8, F2).

    `fields` may be a column that holds `split_fields(cron)`: the fields are
    looked at many times, and then split only once.
    """
    fields = split_fields(cron) if fields is None else fields
    f = named_fields(fields)
    timed = _is_set(f["second"]) & _is_set(f["minute"]) & _is_set(f["hour"])
    dated = _is_set(f["day"]) & _is_set(f["month"]) & _is_set(f["weekday"])
    return (
        F.when(F.size(fields) != len(FIELDS), F.concat(F.lit(INVALID), cron))
        .when(timed & dated, _full_date_text(f))
        .when(timed, _timed_text(f))
        .otherwise(_general_text(f))
    )
