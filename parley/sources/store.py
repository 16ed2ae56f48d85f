"""A message store that a batch can be written to again.

Rows lie below `writer=<w>/batch=<n>/date=<day>/bucket=<b>`: the writer is the stream, so a batch that
runs again replaces just what it wrote before, rows without an id included. `bucket` is a hash of
`msg_id`. Beside the rows, in folders that a plain read of the table leaves out, lie:

* `_ids`: the 64-bit hash of each id with its partition. A new batch asks them which partitions may hold
  an id of its own, and reads only those. They take what the ids take, however many partitions a batch has;
* `_versions`: which version of each table a batch was worked on with, so that it is the same again.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parley.functions.ordered import broadcast_if_small
from parley.operators.filters import since

BUCKETS = 64
LAYOUT = ["writer", "batch", "date", "bucket"]
_LAYOUT_TYPES = "writer string, batch long, date date, bucket int"


def _batch_dir(root: str, kind: str, writer: str, batch_id: int) -> str:
    middle = f"{kind}/" if kind else ""
    return f"{root.rstrip('/')}/{middle}writer={writer}/batch={batch_id}"


def _read(spark: SparkSession, root: str, schema, folders: list[str] | None = None) -> DataFrame | None:
    try:
        return spark.read.schema(schema).option("basePath", root).parquet(*folders or [root])
    except AnalysisException as error:
        # The first batch finds no table.
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def bucket_of(msg_id: Column) -> Column:
    return F.pmod(F.xxhash64(msg_id), F.lit(BUCKETS)).cast("int")


def laid_out(rows: DataFrame) -> DataFrame:
    """Rows of the message table with the columns they are partitioned by in a batch.

    Rows without an id are spread by what they say.
    """
    spread = F.pmod(F.xxhash64("from_user", "to_user", "create_time", "content"), F.lit(BUCKETS))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("create_time") / 86400).cast("int"))
    bucket = F.when(F.col("msg_id").isNull(), spread.cast("int")).otherwise(bucket_of(F.col("msg_id")))
    return rows.withColumn("date", day).withColumn("bucket", bucket)


def _hashed(ids: DataFrame) -> DataFrame:
    return ids.where(F.col("msg_id").isNotNull()).withColumn("hash", F.xxhash64("msg_id"))


def write_batch(rows: DataFrame, root: str, writer: str, batch_id: int) -> None:
    """Write the rows of a batch and the hashes of their ids, in place of what it wrote before."""
    placed = laid_out(rows)
    hashes = _hashed(placed).select("date", "bucket", "hash")
    # Dealt by bucket, so that partitions are runs of equal values in a file.
    hashes.hint("rebalance", "bucket").sortWithinPartitions("bucket", "date").write.mode(
        "overwrite"
    ).parquet(_batch_dir(root, "_ids", writer, batch_id))
    (
        placed.hint("rebalance", "date", "bucket")
        .write.mode("overwrite")
        .partitionBy("date", "bucket")
        .parquet(_batch_dir(root, "", writer, batch_id))
    )


def partitions_holding(
    ids: DataFrame, root: str, writer: str, batch_id: int
) -> list[str]:
    """The partitions, as `writer/batch/date/bucket`, with an id of the same hash as one of the `msg_id`.

    None of what this batch itself has written is among them. Each stored hash is met with those asked
    for once, whatever the number of partitions. Names of partitions come to the driver, as they do when
    the table is listed.
    """
    schema = f"date date, bucket int, hash long, {_LAYOUT_TYPES.split(', date')[0]}"
    hashes = _read(ids.sparkSession, f"{root.rstrip('/')}/_ids", schema)
    if hashes is None:
        return []
    others = hashes.where(~((F.col("writer") == writer) & (F.col("batch") == batch_id)))
    asked = broadcast_if_small(_hashed(ids).select("hash").distinct())
    passing = others.join(asked, "hash", "left_semi").select(*LAYOUT).distinct()
    return [r.name for r in passing.select(_partition_name().alias("name")).collect()]


def _partition_name() -> Column:
    return F.concat_ws("/", *[F.col(c).cast("string") for c in LAYOUT])


def read_store(
    spark: SparkSession, root: str, schema, folders: list[str] | None = None
) -> DataFrame | None:
    """All rows of the store, or of some `folders` of it, with the columns of its layout; None if there are none."""
    types = schema if isinstance(schema, str) else schema.toDDL()
    return _read(spark, root, f"{types}, {_LAYOUT_TYPES}", folders)


def stored_copies(
    rows: DataFrame, root: str, writer: str, batch_id: int, as_of=None,
    look_back_hours: int | None = None,
) -> DataFrame | None:
    """The stored rows among which copies of `rows` can be; None if there are no such rows."""
    ids = rows.where(F.col("msg_id").isNotNull()).select("msg_id").distinct()
    names = partitions_holding(ids, root, writer, batch_id)
    if not names:
        return None
    # Only folders of batches with such partitions are listed.
    batches = sorted({tuple(name.split("/")[:2]) for name in names})
    folders = [_batch_dir(root, "", *batch) for batch in batches]
    stored = read_store(rows.sparkSession, root, rows.schema, folders)
    if stored is None:
        # Another stream has written the hashes of a batch, but not yet its rows.
        stored = read_store(rows.sparkSession, root, rows.schema)
    if stored is None:
        return None
    # A condition on the columns of the layout alone: other partitions are not read.
    stored = stored.where(_partition_name().isin(names))
    if look_back_hours is not None:
        stored = since(stored, "create_at", as_of, look_back_hours)
    return stored.select(*rows.columns)


def version_for(
    spark: SparkSession, root: str, writer: str, batch_id: int, newest: dict[str, str]
) -> dict[str, str]:
    """The versions (name to path) a batch is worked on with: `newest` the first time, then the same."""
    path = _batch_dir(root, "_versions", writer, batch_id)
    known = _read(spark, path, "name string, path string")
    found = {r.name: r.path for r in known.collect()} if known is not None else {}
    if found:
        return found
    spark.createDataFrame(list(newest.items()), "name string, path string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(path)
    return newest
