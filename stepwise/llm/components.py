"""Connected components of a distributed edge list, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stepwise.llm.common import discard, materialise


def connected_components(edges: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``(id, comp)`` with the smallest id of each component, for every end of ``edges(x, y)``.

    ``start(id, comp)`` are components found before (they may only grow).
    A round takes the smallest label among neighbours and then the label of
    that label, so chains halve; labels are written after each round.
    """
    pairs = edges.select("x", "y").where("x <> y")
    if start is not None:
        pairs = pairs.unionByName(start.where("id <> comp").select(F.col("id").alias("x"), F.col("comp").alias("y")))
    pairs = materialise(pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct(), "edges")
    label = materialise(pairs.groupBy(F.col("x").alias("id")).agg(F.least(F.col("id"), F.min("y")).alias("comp")), "labels")
    while True:
        near = (pairs.join(label.select(F.col("id").alias("y"), "comp"), "y").groupBy(F.col("x").alias("id"))
                .agg(F.min("comp").alias("near")))
        step = label.join(near, "id").select("id", F.col("comp").alias("was"), F.least("comp", "near").alias("comp"))
        up = label.select(F.col("id").alias("comp"), F.col("comp").alias("above"))
        new = materialise(step.join(up, "comp", "left").select("id", "was", F.least("comp", "above").alias("comp")), "labels")
        discard(label)
        label = new.select("id", "comp")
        label.scratch_path = new.scratch_path
        if new.where("was <> comp").isEmpty():
            discard(pairs)
            return label
