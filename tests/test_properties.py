"""Property checks: Spark expressions against Python's own semantics on random inputs."""

import math

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stepwise.functions.answers import values_close
from stepwise.functions.text import py_strip

WS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0        　​"
texts = st.text(alphabet=st.sampled_from(list(WS) + list("ab é{}$%")), max_size=12)


@settings(max_examples=1, deadline=None)
@given(st.lists(texts, min_size=200, max_size=200))
def test_py_strip_matches_str_strip(spark, batch):
    df = spark.createDataFrame([(t,) for t in batch], "t string")
    got = [r[0] for r in df.select(py_strip(F.col("t"))).collect()]
    assert got == [t.strip() for t in batch]


floats = st.one_of(st.floats(allow_nan=False, width=64, min_value=-1e12, max_value=1e12),
                   st.sampled_from([0.0, -0.0, 1e-10, -1e-10, float("inf"), float("-inf")]))


@settings(max_examples=1, deadline=None)
@given(st.lists(st.tuples(floats, floats), min_size=200, max_size=200))
def test_values_close_matches_isclose(spark, pairs):
    pairs = pairs + [(a, a * (1 + 5e-10)) for a, _ in pairs[:50]] + [(a, a + 2e-9) for a, _ in pairs[50:100]]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = [r[0] for r in df.select(values_close(F.col("a"), F.col("b"))).collect()]
    assert got == [math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) for a, b in pairs]
