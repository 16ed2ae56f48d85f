"""Joins to large unique tables work out their rows once."""

from pyspark.sql import functions as F

from parley.functions import ordered


def test_rows_joined_to_a_large_table_are_worked_out_once(spark):
    rows = spark.range(40).select(F.md5((F.col("id") % 10).cast("string")).alias("who"), "id")
    side = rows.select("who", F.lit(1).alias("n")).distinct()
    for heavy_rows in (3, 100):
        got = ordered.left_join_unique(rows, side.where("who like 'c%'"), ["who"], 0, heavy_rows)
        # The rows come from the shared folder; only the side still has the expression.
        assert "joined-rows" in " ".join(got.inputFiles())
        want = rows.join(side.where("who like 'c%'"), "who", "left").select(got.columns)
        assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    # Parquet has no type for a column of nulls alone.
    odd = rows.withColumn("none", F.lit(None))
    assert ordered.left_join_unique(odd, side, ["who"], 0, 3).where("n = 1 and none is null").count() == 40
