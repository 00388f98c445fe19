"""Structured Streaming variants of the incremental jobs.

Results arrive over time: step scores are appended batch by batch (the
reference rewrote its result file after every batch), metrics are kept per
event-time window and the running reward mean is a running mean over
window means.  The checkpoint of a table sink lies beside the table, so a job
started again on the same table goes on where it stopped, exactly once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepwise.operators.evaluate import step_judgments
from stepwise.operators.ordering import running_mean
from stepwise.session import scratch_path


def event_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The ``events`` table as a stream; ``ts`` becomes a UTC instant.

    The stored time has no zone (watermarks need a zoned timestamp); it is
    read as UTC whatever the session time zone is.
    """
    schema = spark.read.parquet(f"{sf_dir.rstrip('/')}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    tz = spark.conf.get("spark.sql.session.timeZone")
    ts = F.col("ts")
    if schema["ts"].dataType.typeName() == "timestamp_ntz":
        ts = F.from_utc_timestamp(ts.cast("timestamp"), tz)
    return reader.parquet(sf_dir).withColumn("ts", ts)


def _run(query) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _append(spark: SparkSession, rows: DataFrame, out_path: str) -> DataFrame:
    """Run to the end of the available input, appending to a parquet table (its checkpoint is ``<out_path>.checkpoint``)."""
    out_path = out_path.rstrip("/")
    q = (rows.writeStream.format("parquet").outputMode("append").option("path", out_path)
         .option("checkpointLocation", f"{out_path}.checkpoint").trigger(availableNow=True).start())
    _run(q)
    return spark.read.schema(rows.schema).parquet(out_path)


def score_stream(events: DataFrame) -> DataFrame:
    """Events as scored steps: an error event is an erroneous step, ``value`` its reward."""
    steps = events.select(F.col("event_id").alias("original_id"), F.lit(1).alias("step_id"),
                          (F.col("event_type") == "error").alias("is_error"), F.col("value").alias("reward"))
    return step_judgments(steps)


def append_scores(spark: SparkSession, events: DataFrame, out_path: str | None = None) -> DataFrame:
    """Append judgments to a parquet sink (exactly once) and return the sink as a table."""
    return _append(spark, score_stream(events), out_path or scratch_path(spark, "scores"))


def window_metrics(events: DataFrame, window: str = "1 hour", watermark: str = "2 hours") -> DataFrame:
    """Per event-time window and event type: count, mean value, error count."""
    return (events.withWatermark("ts", watermark)
            .groupBy(F.window("ts", window).alias("w"), "event_type")
            .agg(F.count(F.lit(1)).alias("n_events"), F.avg("value").alias("mean_value"),
                 F.count_if(F.col("event_type") == "error").alias("n_errors")))


def _complete_to_parquet(spark: SparkSession, agg: DataFrame, name: str) -> DataFrame:
    """Run a complete-mode aggregation; each epoch writes its whole (small) result to a folder of its own."""
    out_path = scratch_path(spark, name)
    epochs: list[int] = []

    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_path}/{epoch_id}")
        epochs.append(epoch_id)

    q = (agg.writeStream.outputMode("complete").foreachBatch(sink)
         .option("checkpointLocation", f"{out_path}.checkpoint")
         .trigger(availableNow=True).start())
    _run(q)
    if not epochs:
        return spark.createDataFrame([], agg.schema)
    return spark.read.parquet(f"{out_path}/{max(epochs)}")


def log_window_metrics(spark: SparkSession, events: DataFrame, window: str = "1 hour",
                       mode: str = "complete", out_path: str | None = None) -> DataFrame:
    """Per-window metrics.

    ``complete`` re-emits every window each trigger (exact for a bounded
    replay; its state grows with the number of windows).  ``append`` emits a
    window once the watermark passes its end and then drops its state, the
    mode for an unbounded stream; rows land exactly once in a parquet sink.
    """
    agg = window_metrics(events, window)
    if mode == "complete":
        res = _complete_to_parquet(spark, agg, "window-metrics")
    elif mode == "append":
        res = _append(spark, agg, out_path or scratch_path(spark, "window-metrics"))
    else:
        raise ValueError(f"unknown output mode {mode}")
    return res.select(F.col("w.start").cast("long").alias("window_start"), "event_type", "n_events",
                      "mean_value", "n_errors")


def running_window_mean(spark: SparkSession, events: DataFrame, window: str = "1 hour") -> DataFrame:
    """Mean value per window (kept as streaming state), then the running mean of window means."""
    agg = (events.withWatermark("ts", "2 hours").groupBy(F.window("ts", window).alias("w"))
           .agg(F.avg("value").alias("batch_mean")))
    res = _complete_to_parquet(spark, agg, "window-means")
    res = res.select(F.col("w.start").cast("long").alias("window_start"), "batch_mean")
    return running_mean(res, ["window_start"], "batch_mean")
