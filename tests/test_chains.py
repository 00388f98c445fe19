"""Chains: expansion, prompt framing, field resolution by truthiness and by key presence."""

from pyspark.sql import functions as F

from stepwise.operators import chains as C


def test_expand_steps_prefix(spark):
    ch = spark.createDataFrame([(7, "q", ["a", "b", "c"])], "id long, question string, steps array<string>")
    rows = C.expand_steps(ch).orderBy("step_index").collect()
    assert [r["id"] for r in rows] == ["7-step0", "7-step1", "7-step2"]
    assert rows[0]["previous_steps"] == ""                         # first prefix is the empty string
    assert rows[2]["previous_steps"] == "Step 1: a\nStep 2: b" and rows[2]["now_step"] == "Step 3: c"


def test_prompt_framing(spark):
    ch = spark.createDataFrame([(1, "q", ["a", "b"], [2], None)],
                               "id long, question string, steps array<string>, error_steps array<int>, classification string")
    s = C.render_classified_prompt(C.split_steps(ch)).orderBy("step_id").collect()
    assert "Previous Steps: None\\nNow Step: Step 1: a".replace("\\n", "\n") in s[0]["prompt"]   # empty prefix -> None
    assert s[1]["is_error"] and not s[0]["is_error"] and s[0]["classification"] == "unclassified"
    assert s[0]["prompt"].startswith("### Instruction:\n") and s[0]["prompt"].endswith("\n\n### Response:\n")
    pol = spark.createDataFrame([("p", []), ("p", ["x", "y"])], "problem string, steps array<string>")
    p = [r["prompt"] for r in C.render_policy_prompt(pol).collect()]
    assert p[0].endswith("<|im_start|>assistant\n") and p[1].endswith("assistant\nx\n\ny\n\n")
    cand = spark.createDataFrame([("p", ["x"], "z")], "problem string, steps array<string>, candidate string")
    c = C.render_candidate_prompt(cand).collect()[0]["prompt"]
    assert c.startswith("<|user|>\n###Instruction: \n") and "Now Step: Step 2: z" in c and c.endswith("\n<|assistant|>")


def test_resolve_truthy(spark):
    raw = spark.createDataFrame([
        ('{"id": 0, "idx": 5, "question": "", "problem": "P", "steps": "one step", "label": 0}',),
        ('{"id": 3, "text": "T", "steps": [], "reasoning": ["r1", "r2"], "final_answer": "", "answer": "A"}',),
        ('{"id": 4, "prompt": "X", "steps": 5}',),
    ], "raw string")
    got = {r["id"]: r for r in C.resolve_truthy(raw).collect()}
    assert set(got) == {"5", "3"}                                  # a non-list steps value drops the record
    assert got["5"]["question"] == "P" and got["5"]["steps"] == ["one step"] and got["5"]["answer"] == ""
    assert got["3"]["question"] == "T" and got["3"]["steps"] == ["r1", "r2"] and got["3"]["answer"] == "A"


def test_resolve_truthy_plan_and_odd_values(spark):
    """Nulls, zeros, booleans, objects and doubled names as Python reads them; types are taken once a name and column."""
    raw = spark.createDataFrame([
        ('{"id": false, "idx": true, "question": null, "problem": {}, "text": {"a": 1}, "steps": {}, "reasoning": null, "answer": 0.0, "label": 2.5}',),
        ('{"id": 1, "id": 2, "question": "q", "steps": "", "explanation": "why", "answer": []}',),
        ('{"id": 9, "steps": {"a": 1}}',), ('{}',), (None,),
    ], "raw string")
    out = C.resolve_truthy(raw)
    got = [tuple(r) for r in out.collect()]
    assert got[0] == ("true", '{"a":1}', [], "2.5", "")
    assert got[1] == ("2", "q", ["why"], "", "why")          # the last of doubled names
    assert got[2:] == [("", "", [], "", "")] * 2             # steps that are an object drop the record
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    names = sum(map(len, C.TRUTHY_NAMES.values()))
    assert plan.count("schema_of_variant") <= names + 2 * len(C.TRUTHY_NAMES["steps"])


def test_split_steps_carries_metadata(spark):
    df = spark.createDataFrame([(1, "q", ["a", "b"], [2], None, {"src": "x"}), (2, "q", [], [], None, {"src": "y"})],
                               "id long, question string, steps array<string>, error_steps array<int>, classification string, metadata map<string,string>")
    got = C.split_steps(df, carry=("metadata",)).orderBy("step_id").collect()
    assert [(r.original_id, r.step_id, r.metadata) for r in got] == [(1, 1, {"src": "x"}), (1, 2, {"src": "x"})]


def test_question_without_steps_is_an_empty_chain(spark):
    df = spark.createDataFrame([(1, 0, "q", "a"), (1, 1, "q", None), (2, None, "p", None)], "id long, step_index int, question string, step string")
    got = {r.id: (r.question, r.steps) for r in C.chains_from_rows(df).collect()}
    assert got == {1: ("q", ["a", None]), 2: ("p", [])}


def test_resolve_presence(spark):
    raw = spark.createDataFrame([
        ('{"id": null, "idx": 9, "problem": "P", "modified_process": ["a"], "classification": null, "label": "L"}',),
        ('{"idx": 9, "question": "Q", "steps": ["s"], "label": "L"}',),
    ], "raw string")
    r = C.resolve_presence(raw).collect()
    assert r[0]["original_id"] is None and r[0]["classification"] is None     # a present null wins
    assert r[1]["original_id"] == "9" and r[1]["question"] == "Q" and r[1]["classification"] == "L"
    assert r[0]["error_steps"] == [] and r[1]["steps"] == ["s"]
