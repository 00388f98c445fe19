"""Search buffers: key presence, merge precedence, progress states, best candidate."""

from pyspark.sql import functions as F

from stepwise.operators import search as S


def _buf(spark, rows):
    return S.parse_buffer(spark.createDataFrame([(r,) for r in rows], "raw string"))


def test_presence_and_merge(spark):
    g = _buf(spark, ['{"id":1,"problem":"P1","steps":[],"answer":null}', '{"id":2,"problem":"P2","steps":["s"]}'])
    d = _buf(spark, ['{"id":2,"problem":"D2","answer":"7","candidates":["a"]}', '{"id":3,"problem":"D3"}'])
    m = {r["id"]: r for r in S.merge_buffers(g, d).collect()}
    assert m[1]["has_answer"] and m[1]["answer"] is None        # a present null still counts as answered
    assert m[2]["problem"] == "P2" and m[2]["answer"] == "7" and m[2]["steps"] == ["s"]
    assert m[3]["problem"] == "D3" and m[3]["steps"] == [] and not m[3]["has_answer"]
    assert sorted(r["id"] for r in S.to_score(g, d).collect()) == []   # id 2 answered in d


def test_progress_states(spark):
    done = S.progress(_buf(spark, ['{"id":1,"answer":"1"}'])).collect()[0]
    todo = S.progress(_buf(spark, ['{"id":1,"answer":"1"}', '{"id":2}'])).collect()[0]
    empty = S.progress(_buf(spark, [])).collect()
    assert done["state"] == "done" and todo["state"] == "not_done" and todo["answered"] == 1
    assert empty == [] or empty[0]["state"] == "empty"


def test_best_candidate_ties_take_lowest_index(spark):
    res = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.75), (1, 2, 0.75), (2, 0, 0.2)],
                                "sample_id long, candidate_idx int, reward double")
    cands = spark.createDataFrame([(1, ["a", "b \\boxed{4}", "c"]), (2, ["\\boxed{}"])], "id long, candidates array<string>")
    b = {r["id"]: r for r in S.best_candidates(res, cands).collect()}
    assert b[1]["best_idx"] == 1 and b[1]["answer"] == "4"
    assert b[2]["answer"] is None and not b[2]["has_answer"]    # empty boxed answer does not count


def test_wide_and_long_voting_agree(spark):
    from stepwise.operators import votes as V
    rows = [(1, 0, ["Verification: Is the step correct (Yes/No)? Yes", "x", " Verification: Is the step correct (Yes/No)? No "]),
            (1, 1, []), (2, 0, ["Verification: Is the step correct (Yes/No)? Yes"])]
    wide = spark.createDataFrame(rows, "sample_id long, candidate_idx int, outputs array<string>")
    w = {(r["sample_id"], r["candidate_idx"]): (r["reward"], r["parse_failed"])
         for r in V.vote_counted_wide(wide).collect()}
    long = wide.select("sample_id", "candidate_idx", F.posexplode("outputs").alias("gen_idx", "output"))
    lg = {(r["sample_id"], r["candidate_idx"]): r["reward"] for r in V.vote_candidates(long).collect()}
    assert w[(1, 0)] == (lg[(1, 0)], True) and w[(2, 0)] == (1.0, False)
    assert w[(1, 1)] == (0.5, False)          # no generations -> 0.5


def test_search_loop_finishes_with_stubs(spark):
    problems = spark.createDataFrame([(i, f"problem {i}") for i in range(6)], "id long, problem string")
    out = S.search_loop(spark, problems, S.stub_generator, S.stub_scorer, max_rounds=4).collect()
    assert len(out) == 6 and all(r["has_answer"] for r in out)
    assert all(r["answer"] == str(r["id"] % 97) and len(r["steps"]) == 3 for r in out)


def test_check_progress_exit_codes(spark, tmp_path):
    done = tmp_path / "done.json"
    done.write_text('[{"id": 1, "answer": "2"}, {"id": 2, "answer": null}]')
    todo = tmp_path / "todo.json"
    todo.write_text('[{"id": 1, "answer": "2"}, {"id": 2}]')
    empty = tmp_path / "empty.json"
    empty.write_text("")
    pretty = tmp_path / "one.json"
    pretty.write_text('{\n "id": 5,\n "answer": "1"\n}\n')
    broken = tmp_path / "broken.json"
    broken.write_text("[1, 2")
    assert S.check_progress(spark, str(done)) == (0, 2, 2)
    assert S.check_progress(spark, str(todo)) == (1, 1, 2)
    assert S.check_progress(spark, str(empty))[0] == 1
    assert S.check_progress(spark, str(pretty)) == (0, 1, 1)
    assert S.check_progress(spark, str(broken))[0] == 2
    assert S.check_progress(spark, str(tmp_path / "missing.json"))[0] == 2


def test_init_or_resume(spark, tmp_path):
    problems = spark.createDataFrame([(1, "p1"), (2, "p2")], "id long, problem string")
    fresh = S.init_or_resume(spark, str(tmp_path / "none.json"), problems)
    assert fresh.count() == 2 and fresh.where("has_answer").count() == 0
    buf = tmp_path / "gen.json"
    buf.write_text('[{"id": 1, "problem": "p1", "steps": ["s"], "answer": "3"}]')
    resumed = S.init_or_resume(spark, str(buf), problems).collect()
    assert len(resumed) == 1 and resumed[0]["has_answer"] and resumed[0]["steps"] == ["s"]


def test_search_loop_scores_what_it_selects(spark, tmp_path):
    """A random generator runs once per sample and round, string ids pass, and every appended step was scored."""
    import os
    import pandas as pd
    calls, scored = tmp_path / "calls", tmp_path / "scored"
    calls.mkdir(), scored.mkdir()

    def generator(pdf):
        import uuid
        for i in pdf["id"]:
            (calls / f"{i}-{uuid.uuid4().hex}").touch()
        return pd.Series([[f"step {uuid.uuid4().hex}" for _ in range(3)] for _ in pdf["id"]])

    def scorer(prompts):
        for p in prompts:
            (scored / p.rsplit("step ", 1)[1][:32]).touch()
        return S.stub_scorer(prompts)

    problems = spark.createDataFrame([(f"gsm8k-{i}", f"problem {i}") for i in range(5)], "id string, problem string")
    out = S.search_loop(spark, problems, generator, scorer, max_rounds=2).collect()
    assert len(os.listdir(calls)) == 10 and not any(r["has_answer"] for r in out)
    assert all(len(r["steps"]) == 2 for r in out)
    assert {s.removeprefix("step ") for r in out for s in r["steps"]} <= set(os.listdir(scored))


def test_search_loop_resumes_from_buffers(spark):
    problems = spark.createDataFrame([(i, f"problem {i}") for i in range(4)], "id long, problem string")
    g = _buf(spark, ['{"id":0,"problem":"problem 0","steps":["a","b"]}', '{"id":1,"problem":"problem 1","steps":["x"],"answer":"5"}'])
    d = _buf(spark, ['{"id":2,"problem":"problem 2","answer":"6","candidates":["y"]}'])
    out = {r["id"]: r for r in S.search_loop(spark, problems, S.stub_generator, S.stub_scorer, gen=g, disc=d).collect()}
    assert sorted(out) == [0, 1, 2, 3] and all(r["has_answer"] for r in out.values())
    assert out[0]["steps"][:2] == ["a", "b"] and len(out[0]["steps"]) == 3 and len(out[3]["steps"]) == 3
    assert out[1]["answer"] == "5" and out[1]["steps"] == ["x"] and out[2]["answer"] == "6"


def test_merge_takes_the_last_row_of_an_id(spark, tmp_path):
    """2 x 2 rows of one id are one sample; evaluations survive; string and missing ids pass."""
    from stepwise.sources.records import read_buffer
    ev = '[{"candidate_idx":1,"reward":0.5,"analysis_labels":["Yes","No"],"analysis_outputs":["a","b"]}]'
    (tmp_path / "g.jsonl").write_text('{"id":"m-1","problem":"old","answer":"1"}\n{"id":"m-2","problem":"P2"}\n{"problem":"no id"}\n'
                                      '{"id":"m-1","problem":"new","steps":["s"]}\n')
    (tmp_path / "d.json").write_text('[{"id":"m-1","problem":"D1","candidates":["x"]},\n {"id":"m-1","candidates":["y","z"],'
                                     f'"candidate_evaluations":{ev}}}]')
    g, d = (S.parse_buffer(read_buffer(spark, str(tmp_path / f)), id_type="string").repartition(5, "problem") for f in ("g.jsonl", "d.json"))
    m = {r["id"]: r for r in S.merge_buffers(g, d).collect()}
    assert set(m) == {"m-1", "m-2", None} and m[None]["problem"] == "no id"
    one = m["m-1"]
    assert one["problem"] == "new" and one["steps"] == ["s"] and not one["has_answer"] and one["answer"] is None
    assert one["candidates"] == ["y", "z"] and one["has_candidate_evaluations"]
    assert one["candidate_evaluations"][0].asDict() == {"candidate_idx": 1, "reward": 0.5, "analysis_labels": ["Yes", "No"],
                                                        "analysis_outputs": ["a", "b"]}
    assert not m["m-2"]["has_candidate_evaluations"] and m["m-2"]["steps"] == []


def test_resume_keeps_id_type_and_schema(spark, tmp_path):
    import pytest
    problems = spark.createDataFrame([("gsm8k-0", "p0"), ("gsm8k-1", "p1")], "id string, problem string")
    fresh = S.init_or_resume(spark, str(tmp_path / "none.json"), problems)
    (tmp_path / "gen.json").write_text('[{"id":"gsm8k-0","problem":"p0","steps":[]},\n{"id":"gsm8k-0","problem":"p0","steps":["s"],"answer":"3"}]')
    held = S.init_or_resume(spark, str(tmp_path / "gen.json"), problems)
    assert [(f.name, f.dataType) for f in held.schema] == [(f.name, f.dataType) for f in fresh.schema]
    assert [tuple(r) for r in held.collect()] == [("gsm8k-0", "p0", ["s"], True, "3")]
    with pytest.raises(ValueError, match="no rows"):
        S.init_or_resume(spark, str(tmp_path / "none.json"), problems.where("false"))
    with pytest.raises(ValueError, match="no rows"):
        S.search_loop(spark, problems.where("false"), S.stub_generator, S.stub_scorer)


def test_step_log_holds_pending_rows_only(spark, tmp_path):
    """Each round writes the samples pending in it; a run goes on from its log."""
    import pandas as pd
    problems = spark.createDataFrame([(i, f"problem {i}") for i in range(6)], "id long, problem string")

    def generator(pdf):
        # sample i offers its answer in round i // 2
        return pd.Series([[f"step {len(s)}"] + ([f"\\boxed{{{i}}}"] if len(s) >= i // 2 else []) for i, s in zip(pdf["id"], pdf["steps"])])

    log = str(tmp_path / "log")
    half = S.search_loop(spark, problems, generator, S.stub_scorer, max_rounds=2, log_path=log)
    assert half.where("has_answer").count() == 4

    def counted(pdf):
        (tmp_path / f"call-{pd.Timestamp.now().value}").touch()
        assert all(len(s) == 2 for s in pdf["steps"])
        return generator(pdf)

    out = {r["id"]: r for r in S.search_loop(spark, problems, counted, S.stub_scorer, log_path=log).collect()}
    rounds = {k: sorted(r["id"] for r in spark.read.parquet(f"{log}/round={k}").collect()) for k in range(3)}
    assert rounds == {0: [0, 1, 2, 3, 4, 5], 1: [2, 3, 4, 5], 2: [4, 5]}
    assert not (tmp_path / "log" / "round=3").exists()
    assert all(out[i]["answer"] == str(i) and len(out[i]["steps"]) == i // 2 + 1 for i in range(6))


def test_merge_moves_what_is_asked_for(spark):
    g = _buf(spark, ['{"id":1,"answer":null}', '{"id":2}', '{"problem":"p"}'])
    d = _buf(spark, ['{"id":2,"answer":"4"}', '{"answer":"5"}', '{"id":3,"candidates":[]}'])
    m = S.merge_buffers(g, d)
    assert {r.id: (r.has_answer, r.answer, r.has_candidates) for r in m.collect()} == {
        1: (True, None, False), 2: (True, "4", False), None: (True, "5", False), 3: (False, None, True)}
    plan = m.select("id", "has_answer")._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "from_json" not in plan


def test_reunite_merges_once(spark, sf):
    import __spark_entry__ as E
    plan = E.queries()["buffer_reunite"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan
