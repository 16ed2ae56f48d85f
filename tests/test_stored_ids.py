"""The hashes by which a new batch finds the partitions that may hold its ids."""

from pyspark.sql import functions as F

from parley.sources import store


def message_rows(spark, n, days):
    return spark.range(n).select(
        F.when(F.col("id") % 5 != 0, F.concat(F.lit("m"), "id")).alias("msg_id"),
        F.lit("u").alias("from_user"), F.lit("a").alias("to_user"), F.lit("c").alias("content"),
        (F.col("id") % days * 86_400).alias("create_time"),
    )


def test_a_batch_adds_one_hash_an_id_however_many_partitions(spark, tmp_path):
    for n, days in enumerate((1, 30)):
        store.write_batch(message_rows(spark, 300, days), str(tmp_path / "s"), "w", n)
        hashes = spark.read.parquet(str(tmp_path / "s" / "_ids")).where(f"batch = {n}")
        assert hashes.count() == hashes.select("hash").distinct().count() == 240


def test_partitions_of_several_batches_and_writers(spark, tmp_path):
    root = str(tmp_path / "s")
    assert store.partitions_holding(message_rows(spark, 3, 1), root, "w", 0) == []
    rows = message_rows(spark, 200, 3)
    store.write_batch(rows.where("msg_id = 'm1'"), root, "w", 0)
    store.write_batch(rows.where("msg_id IN ('m2', 'm3')"), root, "w", 1)
    store.write_batch(rows.where("msg_id = 'm1' OR msg_id IS NULL"), root, "7", 0)
    names = store.partitions_holding(rows.where("msg_id IN ('m1', 'm2') OR msg_id IS NULL"), root, "w", 2)
    assert sorted(n.split("/")[:2] for n in names) == [["7", "0"], ["w", "0"], ["w", "1"]]
    found = store.stored_copies(rows.where("msg_id IN ('m1', 'm2')"), root, "w", 0)
    assert {"m1", "m2"} <= {r.msg_id for r in found.collect()} <= {"m1", "m2", "m3"}
    # Its own rows alone are none.
    assert store.stored_copies(rows.where("msg_id = 'm3'"), root, "w", 1) is None


def test_hashes_without_rows_yet(spark, tmp_path):
    """Another stream has written its hashes, but not its rows."""
    root, rows = str(tmp_path / "s"), message_rows(spark, 50, 1)
    store.write_batch(rows, root, "w", 0)
    spark.read.parquet(f"{root}/_ids/writer=w/batch=0").write.parquet(f"{root}/_ids/writer=x/batch=0")
    found = store.stored_copies(rows, root, "w", 1)
    assert found.where("msg_id = 'm1'").count() == 1
