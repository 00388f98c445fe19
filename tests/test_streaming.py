"""Streaming jobs: results do not depend on the session time zone; append mode emits closed windows."""

from stepwise.streaming import jobs as J


def test_window_metrics_zone_independent(spark, sf):
    base = sorted(J.log_window_metrics(spark, J.event_stream(spark, sf)).collect())
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        other = sorted(J.log_window_metrics(spark, J.event_stream(spark, sf)).collect())
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other


def test_append_mode_emits_subset_of_complete(spark, sf):
    complete = {(r["window_start"], r["event_type"]): r["n_events"]
                for r in J.log_window_metrics(spark, J.event_stream(spark, sf)).collect()}
    appended = J.log_window_metrics(spark, J.event_stream(spark, sf), mode="append").collect()
    assert len(appended) <= len(complete)
    for r in appended:   # closed windows are final and equal the complete result
        assert complete[(r["window_start"], r["event_type"])] == r["n_events"]


def test_scores_resume_into_the_same_table(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "event_id long, event_type string, value double"

    def add(lo, hi):
        rows = [(i, "error" if i % 3 else "view", i / hi) for i in range(lo, hi)]
        spark.createDataFrame(rows, schema).write.mode("append").parquet(source)
        return J.append_scores(spark, spark.readStream.schema(schema).parquet(source), out).count()

    assert add(0, 1000) == 1000 and add(1000, 1100) == 1100
    ids = spark.read.parquet(out).select("original_id")
    assert ids.distinct().count() == ids.count() == 1100
