"""Distributed row numbering equals a window row_number, also with a hot group."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from stepwise.operators.ordering import assign_batches, row_number_within, running_mean


def test_row_number_within_matches_window(spark):
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 17).alias("g"),   # group 0 holds a third
        ((F.col("id") * 7919) % 10007).alias("v"), F.col("id"))
    got = row_number_within(df, ["g"], ["v", "id"], "rn", num_partitions=16)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert got.select("id", "rn").exceptAll(want.select("id", F.col("rn").cast("bigint"))).count() == 0
    assert got.count() == df.count()


def test_assign_batches(spark):
    df = spark.range(0, 1000).select((999 - F.col("id")).alias("k"))
    b = assign_batches(df, ["k"], 64).collect()
    assert {r["k"]: r["batch_id"] for r in b}[130] == 130 // 64
    assert max(r["batch_id"] for r in b) == 999 // 64


def test_null_groups_are_numbered(spark):
    df = spark.range(0, 300).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), F.col("id"))
    got = {r["id"]: r["rn"] for r in row_number_within(df, ["g"], ["id"], "rn", num_partitions=7).collect()}
    assert len(got) == 300 and got[0] == 1 and got[297] == 100


def test_running_mean_matches_window(spark):
    df = spark.range(0, 3000).select((F.col("id") * 7919 % 3001).alias("k"),
                                     F.when(F.col("id") % 5 > 0, F.col("id") / 7).alias("v"))
    got = {r["k"]: r["running_mean"] for r in running_mean(df, ["k"], "v", num_partitions=9).collect()}
    want = df.withColumn("m", F.avg("v").over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0))).collect()
    assert len(got) == len(want) == 3000
    for r in want:
        assert got[r["k"]] == r["m"] or abs(got[r["k"]] - r["m"]) < 1e-9


def test_running_mean_of_nothing(spark):
    assert running_mean(spark.range(0).select("id", F.col("id").cast("double").alias("v")), ["id"], "v").count() == 0


def test_batches_of_unique_keys_equal_batches_of_rows(spark):
    rows = [(None if i == 7 else i * 37 % 501, f"text {i}") for i in range(500)]
    df = spark.createDataFrame(rows, "k int, t string")
    plain = {r["t"]: r["batch_id"] for r in assign_batches(df, ["k"], 64).collect()}
    joined = {r["t"]: r["batch_id"] for r in assign_batches(df, ["k"], 64, unique=True).collect()}
    assert plain == joined and len(joined) == 500
