"""Joining a large table to a per-key summary table.

A summary has one row per key (per batch, per partition and group).
``join_summary`` materialises it once (reliable checkpoint) and leaves the
choice of the join to Spark, which broadcasts by measured bytes under its
own threshold and otherwise shuffles, splitting skewed partitions (AQE).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from stepwise.session import ensure_checkpoint_dir


def join_summary(big: DataFrame, summary: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    ensure_checkpoint_dir(summary.sparkSession)
    return big.join(summary.checkpoint(eager=True), list(on), how)
