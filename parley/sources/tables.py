"""Reading and writing the stored tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.schemas import SCHEMAS, conform


def load_table(spark: SparkSession, name: str, path: str) -> DataFrame:
    """One of the ten tables from Parquet, with its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(path)


def load_table_jdbc(
    spark: SparkSession,
    name: str,
    url: str,
    dbtable: str,
    id_range: tuple[int, int],
    partitions: int,
    **options: str,
) -> DataFrame:
    """One of the ten tables from a live database, read in `partitions` id ranges.

    `id_range` only spreads the reading; ids outside it are read as well.
    """
    low, high = id_range
    reader = spark.read.format("jdbc").options(
        url=url,
        dbtable=dbtable,
        partitionColumn="id",
        lowerBound=str(low),
        upperBound=str(high),
        numPartitions=str(partitions),
        **options,
    )
    columns = [
        F.col(f.name).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields
    ]
    return reader.load().select(*columns)


def append(
    df: DataFrame,
    path: str,
    table: str | None = None,
    as_of=None,
    partition_by: Sequence[str] = (),
    rebalance: bool = False,
) -> None:
    """Add rows to a table; with `table`, shaped and with defaults.

    `rebalance` has the rows shuffled into files of even size: for small batches
    spread over many partitions, and for results of skewed joins.
    """
    rows = conform(df, table, as_of) if table else df
    rows = rows.hint("rebalance") if rebalance else rows
    writer = rows.write.mode("append")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_version(df: DataFrame, root: str, version: str | int) -> str:
    """A snapshot as a new version next to the earlier ones; gives its path."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def newest_version(spark: SparkSession, root: str) -> str:
    """The path of the newest whole version `write_version` has made below `root`.

    Whole numbers count as numbers. A version that is still being written has no `_SUCCESS` yet.
    """
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    whole = []
    for status in files.listStatus(path):
        name = status.getPath().getName()
        done = jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")
        if name.startswith("version=") and files.exists(done):
            version = name.removeprefix("version=")
            number = int(version) if version.isdecimal() else -1
            whole.append((number, version, status.getPath().toString()))
    if not whole:
        raise FileNotFoundError(f"no version below {root}")
    return max(whole)[2]


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder all executors can reach, below `spark.checkpoint.dir`.

    Where that is not set, a session in one process, as in tests, uses a temporary folder; on a
    cluster there is none that all executors see, so it has to be set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="parley-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
