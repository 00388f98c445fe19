"""Answer parsing, tolerant comparison, boxed extraction, symbolic fallback."""

import ast
import math
import operator
import random

from pyspark.sql import functions as F

from stepwise.functions import answers as A
from stepwise.functions.expressions import expression_value
from stepwise.operators.answers import compare_answers


def _values(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    df = A.strip_wrappers_steps(df, "a", "w")
    df = A.simple_number_steps(df, "a", "v")
    return {r["a"]: (r["w"], r["v"]) for r in df.collect()}


def test_wrappers_and_numbers(spark):
    got = _values(spark, ["x = 5.", "$\\boxed{12}$", "##answer: 7 ##", "#answer#: 3/4", "\\frac{1}{4}",
                          "\\dfrac{\\frac{1}{2}}{3}", "50%", "50%%", "1/0", "1,000", "1/-2", "(1)/(-2)",
                          "−3", "NaN", " 1e-2 ", "", "abc", "5.%", "x = y = 50%", "$\\frac{1}{2}$%"])
    assert got["x = 5."] == ("5", 5.0)
    assert got["$\\boxed{12}$"][1] == 12.0
    assert got["##answer: 7 ##"] == ("7", 7.0)
    assert got["#answer#: 3/4"][1] == 0.75
    assert got["\\frac{1}{4}"][1] == 0.25
    assert got["\\dfrac{\\frac{1}{2}}{3}"][1] is None          # ((1)/(2))/(3) is not a simple form
    assert got["50%"][1] == 0.5
    assert math.isclose(got["50%%"][1], 0.005)
    assert got["1/0"][1] is None                                # zero denominator
    assert got["1,000"][1] is None                              # commas are not removed
    assert got["1/-2"][1] is None                               # sign in the denominator of a/b
    assert got["(1)/(-2)"][1] == -0.5
    assert got["−3"][1] == -3.0
    assert got["NaN"][1] is None                                # regex guard before the cast
    assert got[" 1e-2 "][1] == 0.01
    assert got[""][1] is None and got["abc"][1] is None
    assert math.isclose(got["5.%"][1], 0.05)
    assert got["x = y = 50%"][1] == 0.5                         # stripped as a whole again after the sign is cut
    assert math.isclose(got["$\\frac{1}{2}$%"][1], 0.005)


_OPS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Mod: operator.mod,
        ast.Pow: lambda a, b: math.pow(float(a), float(b)), ast.UAdd: operator.pos, ast.USub: operator.neg}


def _node(n):
    if isinstance(n, ast.Constant) and type(n.value) in (int, float):
        return n.value
    if isinstance(n, ast.BinOp):
        return _OPS[type(n.op)](_node(n.left), _node(n.right))
    if isinstance(n, ast.UnaryOp):
        return _OPS[type(n.op)](_node(n.operand))
    if isinstance(n, ast.Name) and n.id == "pi":
        return math.pi
    if isinstance(n, ast.Call) and isinstance(n.func, ast.Name) and n.func.id == "sqrt" and len(n.args) == 1:
        return math.sqrt(_node(n.args[0]))
    raise ValueError


def _by_python(s):
    """The same grammar through Python's own parser."""
    try:
        v = float(_node(ast.parse(s.replace("^", "**").strip(), mode="eval").body))
    except Exception:
        return None
    return v if math.isfinite(v) else None


def _evaluated(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "a string")
    return {r["a"]: r["v"] for r in df.select("a", expression_value(F.col("a")).alias("v")).collect()}


def test_expression_values(spark):
    want = {"3**2": 9.0, "2*sqrt(4)": 4.0, "pi": math.pi, "2^10": 1024.0, "-2**2": -4.0, "2**3**2": 512.0, "2**-1": 0.5, "7%-3": -2.0,
            "-7%3": 2.0, "((2))": 2.0, "+-+3": -3.0, "2 ** 3": 8.0, ".5+1e-2": 0.51, "3.": 3.0, "2--3": 5.0}
    none = ["e", "x+1", "1/0", "sqrt(-1)", "10**400", "1e400", "", "()", "2(3)", "1 2", "* 2", "sqrt 4", "sqrt()", "sqrt(4", "4)", "007+1", "2e",
            "pi pi", "1//2", "0**-1", "(-8)**(1/3)", "9**9**9**9", "2*", None]
    got = _evaluated(spark, [*want, *none])
    assert all(got[k] is None for k in none)
    assert all(math.isclose(got[k], v) for k, v in want.items())


def test_expressions_equal_pythons_parser(spark):
    rng = random.Random(4)

    def expr(depth):
        k = rng.random()
        if depth == 0 or k < 0.25:
            return rng.choice([str(rng.randint(0, 12)), f"{rng.randint(0, 99) / 10}", "pi", ".5", "1e-2", "3."])
        if k < 0.4:
            return f"({expr(depth - 1)})"
        if k < 0.5:
            return f"sqrt({expr(depth - 1)})"
        if k < 0.6:
            return rng.choice("+-") + expr(depth - 1)
        return expr(depth - 1) + rng.choice(["+", "-", "*", "/", "%", "**", "^", " * ", "- "]) + expr(depth - 1)

    texts = [expr(4) for _ in range(600)]
    for t in rng.choices(texts, k=600):
        i = rng.randrange(len(t))
        texts.append(t[:i] + rng.choice("()+-*/ 12sp.e%") + t[i + 1:])
    got = _evaluated(spark, texts)
    for t in texts:
        want = _by_python(t)
        assert (want is None) == (got[t] is None), t
        assert want is None or math.isclose(want, got[t], rel_tol=1e-9, abs_tol=1e-12), t


def test_compare_answers(spark):
    pred = spark.createDataFrame([(1, "0.5"), (2, "\\frac{1}{2}"), (3, ""), (4, "abc"), (5, "2^3"), (6, "1")],
                                 "id long, answer string")
    gold = spark.createDataFrame([(1, "1/2"), (2, "0.5000000001"), (3, "1"), (4, "abc."), (5, "8"), (7, "x")],
                                 "id long, answer string")
    r = {x["id"]: x for x in compare_answers(pred, gold).collect()}
    assert r[1]["match"] and r[1]["status"] == "compared"
    assert r[2]["match"]                                   # within 1e-9 tolerance
    assert r[3]["status"] == "pred_missing_answer"
    assert r[4]["match"] and r[4]["reason"].startswith("string fallback")
    assert r[5]["match"]                                   # expression: 2^3 = 8
    assert r[6]["status"] == "only_in_pred" and r[7]["status"] == "only_in_gt"


def test_values_close_infinity(spark):
    df = spark.createDataFrame([(float("inf"), 1.0), (float("inf"), float("inf")), (1.0, 1.0 + 1e-12)], "a double, b double")
    got = [r[0] for r in df.select(A.values_close(F.col("a"), F.col("b"))).collect()]
    assert got == [False, True, True]


def test_boxed(spark):
    cases = {
        "so \\boxed{5}": "5",
        "\\boxed{\\frac{1}{2}}": "\\frac{1}{2}",
        "\\boxed{1} or \\boxed{2}": None,          # several
        "nothing": None,
        "\\boxed{}": "",                           # empty (does not set an answer later)
        "\\boxed{3} then \\boxed{4": "3",          # unclosed one after a closed one is ignored
        "\\boxed{a{b}c}": "a{b}c",
        "\\boxed{ \\boxed{7} }": "\\boxed{7}",
        "{x} \\boxed{ 9 } }": "9",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    got = {r["t"]: r["b"] for r in df.select("t", A.single_boxed(F.col("t")).alias("b")).collect()}
    assert got == cases


def test_answer_values_and_report_sink(spark, tmp_path):
    from stepwise.operators.answers import answer_summary, answer_values
    from stepwise.sources.records import write_report
    df = spark.createDataFrame([("3^2",), ("12.5%",), ("none",)], "a string")
    got = {r["a"]: r["v"] for r in answer_values(df, "a", "v").collect()}
    assert got == {"3^2": 9.0, "12.5%": 0.125, "none": None}
    pred = spark.createDataFrame([(1, "1")], "id long, answer string")
    recs = compare_answers(pred, pred)
    s_path, r_path = write_report(answer_summary(recs, pred, pred), recs, str(tmp_path / "report"))
    assert spark.read.json(s_path).collect()[0]["matched_samples"] == 1
    assert spark.read.json(r_path).count() == 1


def test_keep_last_without_an_order_keeps_the_last_row(spark):
    from stepwise.operators.answers import keep_last
    df = spark.createDataFrame([("a", "9"), ("b", "1"), ("a", "3"), (None, "7")], "id string, answer string").coalesce(1)
    assert sorted(map(tuple, keep_last(df, "id").collect())) == [("a", "3"), ("b", "1")]
