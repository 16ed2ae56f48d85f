"""Fire calendars of cron rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions import cron
from parley.functions.clock import instant_of, moment

_FIELDS = "_cron_fields"


def _with_fields(tasks: DataFrame) -> DataFrame:
    return tasks.withColumn(_FIELDS, cron.split_fields(F.col("cron_expression")))


def _with_plan(tasks: DataFrame) -> tuple[DataFrame, cron.Plan]:
    """Tasks with a column per cron field, so that each is worked out once per row."""
    planned = _with_fields(tasks).withColumns(
        {f"_cron_{n}": v for n, v in cron.schedule_columns(F.col(_FIELDS)).items()}
    )
    return planned, {name: F.col(f"_cron_{name}") for name in cron.FIELDS}


def describe_cron(tasks: DataFrame) -> DataFrame:
    """Tasks with their cron in words (K8)."""
    words = cron.describe(F.col("cron_expression"), F.col(_FIELDS))
    return _with_fields(tasks).withColumn("cron_expression_chinese", words).drop(_FIELDS)


def with_cron_validity(tasks: DataFrame) -> DataFrame:
    planned, plan = _with_plan(tasks)
    return planned.withColumn("cron_valid", cron.is_valid(plan)).select(
        *tasks.columns, "cron_valid"
    )


def validate_cron(tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tasks with a valid cron, and the others (K9)."""
    checked = with_cron_validity(tasks)
    return (
        checked.where("cron_valid").drop("cron_valid"),
        checked.where(~F.col("cron_valid")).drop("cron_valid"),
    )


def cron_fires(tasks: DataFrame, start, end) -> DataFrame:
    """One row per fire from `start` to before `end`, in column `fire_time`.

    Days are picked first, then the times of the day: a row grows only by
    fires it really has. Rows stay in their partition.
    """
    first, last = moment(start), moment(end)
    planned, plan = _with_plan(tasks)
    dates = F.sequence(F.to_date(first), F.to_date(last))
    days = F.when(cron.is_valid(plan), F.filter(dates, lambda d: cron.runs_on(plan, d)))
    fire = cron.at_second(
        F.col("_day"), F.col("_hour") * 3600 + F.col("_minute") * 60 + F.col("_second")
    )
    # Outer forms: for the plain ones Catalyst adds filters on the arrays, and
    # works the arrays out a second time for them. The last filter drops the nulls.
    return (
        planned.withColumn("_day", F.explode_outer(days))
        .withColumn("_hour", F.explode_outer(plan["hour"]))
        .withColumn("_minute", F.explode_outer(plan["minute"]))
        .withColumn("_second", F.explode_outer(plan["second"]))
        .withColumn("fire_time", fire)
        .where((F.col("fire_time") >= first) & (F.col("fire_time") < last))
        .select(*tasks.columns, "fire_time")
    )


def zoned_fires(tasks: DataFrame, start, end, zone: str | Column) -> DataFrame:
    """`cron_fires` by the clocks of a named zone, with the epoch seconds in `fire_epoch`.

    `start` and `end` are times of that zone, which may differ from task to task (a column). Fires in the
    hour that clocks leave out do not happen, those in the hour they show twice happen the first time.
    """
    fires = cron_fires(tasks, start, end)
    return fires.withColumn("fire_epoch", instant_of(F.col("fire_time"), zone)).where(
        F.col("fire_epoch").isNotNull()
    )


def next_fire(tasks: DataFrame, as_of, horizon_days: int = 366) -> DataFrame:
    """Tasks with their first fire after `as_of`, null if none within the horizon (K7)."""
    planned, plan = _with_plan(tasks)
    fire = cron.next_after(plan, moment(as_of), horizon_days)
    return planned.withColumn("next_fire", fire).select(*tasks.columns, "next_fire")


def set_next_execution(tasks: DataFrame, as_of, horizon_days: int = 366) -> DataFrame:
    """Next execution time of active tasks set, of the others cleared."""
    fired = next_fire(tasks, as_of, horizon_days)
    active = F.col("is_active") == 1
    return fired.withColumn("next_execution_time", F.when(active, F.col("next_fire"))).drop(
        "next_fire"
    )
