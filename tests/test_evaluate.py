"""First-error and confusion-matrix evaluation: pinned edge rows and metamorphic checks."""


from stepwise.operators import evaluate as ev
from stepwise.plans.fixtures import fixture


def test_first_error_edges(spark):
    steps = spark.createDataFrame([
        ("a", 0, 0.9), ("a", 1, 0.5), ("a", 2, 0.1),      # 0.5 counts as an error (<=)
        ("b", 0, None), ("b", 1, 0.9),                    # missing score, no error -> ignored
        ("c", 0, None), ("c", 1, 0.2),                    # missing score but an error -> kept
        ("d", 0, 1.0), ("d", 1, 0.75),                    # no error -> -1
        (None, 0, 0.0)], "orig_id string, step_index int, avg_score double")
    fe = {r["orig_id"]: r for r in ev.first_error_per_chain(steps).collect()}
    assert fe["a"]["predicted_first_error_step"] == 1
    assert fe["b"]["ignored"] and not fe["c"]["ignored"] and fe["c"]["predicted_first_error_step"] == 1
    assert fe["d"]["predicted_first_error_step"] == -1 and None not in fe
    gold = spark.createDataFrame([("a", 1), ("b", -1), ("c", 0), ("d", -1)], "id string, label int")
    s = ev.first_error_summary(steps, gold).collect()[0]
    assert (s["error_samples"], s["first_error_correct"], s["no_error_samples"], s["no_error_correct"]) == (2, 1, 1, 1)
    assert s["ignored_samples"] == 1 and abs(s["f1"] - 2 * 0.5 * 1.0 / 1.5) < 1e-12


def test_reward_threshold_is_strict(spark):
    df = spark.createDataFrame([(False, 0.5), (True, 0.49), (True, 0.5), (False, None)], "is_error boolean, reward double")
    m = ev.confusion_metrics(df).collect()[0]
    assert (m["true_positives"], m["false_positives"], m["true_negatives"], m["false_negatives"]) == (2, 1, 1, 0)


def test_class_counts_sum_to_overall(spark, sf):
    prm = fixture(spark, sf, "f_prm")
    rows = ev.confusion_metrics_by_class(prm).collect()
    overall = [r for r in rows if r["scope"] == "overall"][0]
    classes = [r for r in rows if r["scope"] == "class"]
    for c in ("total_samples", "true_positives", "false_positives", "true_negatives", "false_negatives"):
        assert overall[c] == sum(r[c] for r in classes)


def test_single_default_class_has_no_class_rows(spark):
    df = spark.createDataFrame([(False, 0.9, None), (True, 0.1, None)], "is_error boolean, reward double, classification string")
    rows = ev.confusion_metrics_by_class(df).collect()
    assert [r["scope"] for r in rows] == ["overall"]


def test_report_text(spark):
    df = spark.createDataFrame([(10, 0.123456, 0.5)], "total_samples long, f1_score double, accuracy double")
    r = ev.report_text(df, percent=("accuracy",)).collect()[0]
    assert (r["total_samples"], r["f1_score"], r["accuracy"]) == (10, "0.1235", "50.0000%")
