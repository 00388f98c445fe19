"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from stepwise.session import scratch_path

#: Bytes of the rows that go to Python at once; a longer row goes alone.
BATCH_BYTES = 2 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def box(columns: list[str]) -> Column:
    """The columns of a row in one, so that no operator's own columns clash with them."""
    return F.struct(*(F.col(f"`{c}`") for c in columns)) if columns else F.struct(F.lit(0).alias("_"))


def unbox(df: DataFrame, columns: list[str], results: list[str], row: str = "row") -> DataFrame:
    """The boxed ``columns`` again, beside the ``results``."""
    return df.select(*(F.col(f"`{row}`.`{c}`").alias(c) for c in columns), *results)


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
                schema: StructType | str) -> DataFrame:
    """``mapInArrow`` in batches of about ``BATCH_BYTES``, unless the session has a limit of its own.

    A batch is held several times over: in the JVM in buffers that double as
    they fill, on the way there and back, and in Python as Arrow data and as
    objects.  Spark limits it by rows, so long texts would make it large.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_CONF, None) is None:
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared checkpoint folder and read back.

    Later stages start from the files, so a lost executor never recomputes
    what lies before them.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Deletes the files of materialised frames that nothing reads any more (others are left alone)."""
    for df in frames:
        path = getattr(df, "scratch_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
