"""Exact row numbering without funnelling a group through one task.

``row_number() over (partition by g order by o)`` sends each group to a
single task; with a group holding a third of the rows that task holds a
third of the data.  ``row_number_within`` range-partitions on ``(g, o)``
instead, so a large group is spread over many tasks, numbers rows locally
and adds per-(partition, group) offsets computed from a small count table
(one row per partition a group touches).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stepwise.operators.joins import join_summary
from stepwise.session import ensure_checkpoint_dir


def _in_order(df: DataFrame, keys: Sequence[str], num_partitions: int | None) -> DataFrame:
    """``df`` range-partitioned and sorted by ``keys``, with partition ``_pid`` and place ``_mid``.

    Written once (reliable checkpoint in the shared folder): what is counted
    and what is numbered read the very same partitions, and a lost executor
    recomputes from the checkpoint, not from a new sampling.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    parted = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return (parted.withColumn("_pid", F.spark_partition_id())
                  .withColumn("_mid", F.monotonically_increasing_id())).checkpoint(eager=True)


def row_number_within(df: DataFrame, group_cols: Sequence[str], order_cols: Sequence[str],
                      out: str = "rn", num_partitions: int | None = None) -> DataFrame:
    """1-based row number of each row within its group, in ``order_cols`` order.

    ``order_cols`` should make the order total (ties receive distinct
    numbers in an arbitrary but consistent order).  Groups of every size
    take the same path; pass only the columns that are needed.
    """
    tagged = _in_order(df, [*group_cols, *order_cols], num_partitions)
    stats = tagged.groupBy("_pid", *group_cols).agg(F.count(F.lit(1)).alias("_cnt"),
                                                     F.min("_mid").alias("_first"))
    before = Window.partitionBy(*group_cols).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_cnt").over(before), F.lit(0)))
    # stats has one row per (partition, group) pair: at most partitions + groups
    summary = stats.select("_pid", *(F.col(g).alias(f"_g{i}") for i, g in enumerate(group_cols)), "_first", "_off")
    same = F.lit(True)
    for i, g in enumerate(group_cols):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    summary = summary.withColumnRenamed("_pid", "_part").checkpoint(eager=True)
    joined = tagged.join(summary, (F.col("_pid") == F.col("_part")) & same)
    return (joined.withColumn(out, (F.col("_off") + F.col("_mid") - F.col("_first") + 1).cast("bigint"))
                  .drop("_pid", "_mid", "_first", "_off", "_part", *(f"_g{i}" for i in range(len(group_cols)))))


def running_mean(df: DataFrame, order_cols: Sequence[str], value: str, out: str = "running_mean",
                 num_partitions: int | None = None) -> DataFrame:
    """Mean of ``value`` over each row and all before it, as a two-level prefix sum.

    Every range partition sums its own rows in order; the sums of the
    partitions before it (one row a partition) are added.  Nulls do not
    count; rows before the first value get null.
    """
    tagged = _in_order(df, order_cols, num_partitions)
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    parts = tagged.groupBy("_pid").agg(F.sum(value).alias("_sum"), F.count(value).alias("_cnt"))
    # one row a partition
    parts = parts.select("_pid", F.coalesce(F.sum("_sum").over(before), F.lit(0.0)).alias("_sum"),
                         F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_cnt"))
    upto = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (tagged.withColumn("_s", F.coalesce(F.sum(value).over(upto), F.lit(0.0)))
             .withColumn("_n", F.count(value).over(upto)))
    mean = F.try_divide(F.col("_sum") + F.col("_s"), F.col("_cnt") + F.col("_n"))
    return join_summary(local, parts, ["_pid"]).withColumn(out, mean).drop("_pid", "_mid", "_s", "_n", "_sum", "_cnt")


def assign_batches(df: DataFrame, order_cols: Sequence[str], batch_size: int,
                   out: str = "batch_id", unique: bool = False) -> DataFrame:
    """Consecutive chunks of ``batch_size`` rows in ``order_cols`` order.

    Where ``order_cols`` tell every row apart (``unique``), only they are
    range-partitioned, written and numbered, and the batch is joined back: the
    other columns (texts, token arrays) move once and are computed once.
    """
    if not unique:
        numbered = row_number_within(df, [], order_cols, out="_rn")
        return numbered.withColumn(out, F.floor((F.col("_rn") - 1) / batch_size).cast("bigint")).drop("_rn")
    keys = assign_batches(df.select(*order_cols), order_cols, batch_size, out)
    keys = keys.select(out, *(F.col(c).alias(f"_k{i}") for i, c in enumerate(order_cols)))
    same = F.lit(True)
    for i, c in enumerate(order_cols):
        same = same & df[c].eqNullSafe(F.col(f"_k{i}"))
    return df.join(keys, same).drop(*(f"_k{i}" for i in range(len(order_cols))))
