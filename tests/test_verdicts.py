"""Verdict parsing: the fixed table of texts and both parsers."""

from pyspark.sql import functions as F

from stepwise.functions.verdicts import first_verdict_score, last_verdict, verdict_reward
from stepwise.operators.votes import vote_candidates, vote_counted, vote_excluding_unparsed
from stepwise.plans import fixtures

CASES = [
    ("Verification: Is the step correct (Yes/No)? Yes", "Yes", 1.0),
    ("VERIFICATION: is  the step correct (Yes/No)? no", "No", None),
    ("Verification: Is the step correct(Yes/No)? Yes", None, 1.0),
    ("... (Yes/No)? Yesterday Verification: Is the step correct (Yes/No)? Yesterday", "Yes", None),
    ("Verification: Is the step correct (Yes/No)? Yes ... Verification: Is the step correct (Yes/No)? No", "No", 1.0),
    ("Verification: Is the step correct (Yes/No)? X", None, None),
    ("", None, None),
    (None, None, None),
]


def test_verdict_table(spark):
    df = spark.createDataFrame([(t,) for t, _, _ in CASES], "t string")
    rows = df.select(last_verdict(F.col("t")).alias("last"), first_verdict_score(F.col("t")).alias("first"),
                     verdict_reward(last_verdict(F.col("t"))).alias("reward")).collect()
    for (text, last, first), row in zip(CASES, rows):
        assert row["last"] == last, text
        assert row["first"] == first, text
        assert row["reward"] == {"Yes": 1.0, "No": 0.0, None: 0.5}[last]


def test_kept_outputs_are_the_texts_that_labels_come_from(spark):
    votes = spark.createDataFrame([(1, 1, "p: ", " b "), (1, 0, "p: ", "a")], "id int, gen_idx int, prompt string, output string")
    whole = vote_counted(votes, ["id"], prefix="prompt", keep_outputs=True).first()
    assert whole.outputs == ["p: a", "p:  b "] and whole.parse_failed and whole.all_rewards == [0.5, 0.5]
    assert vote_counted(votes, ["id"], strip=True, keep_outputs=True).first().outputs == ["a", "b"]


YES, NO = ("Verification: Is the step correct (Yes/No)? " + v for v in ("Yes", "No"))
VOTES = [(1, 0, 1, " none "), (1, 0, 1, NO), (1, 0, 1, YES), (1, 0, None, YES), (None, 0, 0, None), (None, 0, 0, YES)]


def test_texts_that_nobody_reads_are_not_sorted(spark):
    votes = spark.createDataFrame(VOTES, "sample_id int, candidate_idx int, gen_idx int, output string")
    every = vote_candidates(votes)
    row = {r.sample_id: r for r in every.collect()}
    assert row[1].analysis_labels == ["Yes", "No", None, "Yes"] and row[1].reward == 0.625
    assert row[1].analysis_outputs == [YES, NO, "none", YES]
    assert row[None].analysis_outputs == [None, YES] and row[None].analysis_labels == [None, "Yes"]
    for kept in (every.drop("analysis_outputs"),
                 vote_excluding_unparsed(votes, ["sample_id"], keep_outputs=True).drop("outputs")):
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("collect_list") == 1 and "_t" not in plan


def test_labels_follow_from_rewards(spark):
    votes = spark.createDataFrame(VOTES, "id int, step int, gen_idx int, output string")
    counted = vote_counted(votes, ["id", "step"])
    assert {r.id: (r.all_rewards, r.verification_labels, r.parse_failed) for r in counted.collect()} == {
        1: ([1.0, 0.0, 0.5, 1.0], ["Yes", "No", None, "Yes"], True), None: ([0.5, 1.0], [None, "Yes"], True)}
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert "_label" not in plan.split("Aggregate", 1)[1]


def test_vote_tasks_follow_the_rows(spark, tmp_path, monkeypatch):
    lines = spark.range(40).selectExpr("id % 20 as l_orderkey", "cast(id % 2 as int) + 1 as l_linenumber")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(fixtures, "ROWS_PER_TASK", 3)
    votes = fixtures.fixture(spark, str(tmp_path), "f_vote")
    assert votes.rdd.getNumPartitions() == 14
    assert votes.count() == 8 * 20 == votes.distinct().count()
