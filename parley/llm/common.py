"""What the corpus operators share: reading tables, and cutting lineage in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.sources.tables import shared_dir

#: The characters the operators take as white space between words.
SPACES = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stash(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table below `spark.checkpoint.dir` and read it again.

    What follows starts from files that every executor can reach, so that a lost
    executor costs only its own tasks, and joins know the size of the table.
    """
    spark = df.sparkSession
    path = shared_dir(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings for the jobs run inside; underscores stand for dots."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is worked out once, however often `f` uses it."""
    return F.transform(F.array(value), f)[0]
