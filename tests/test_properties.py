"""Property tests (one Spark job per generated batch)."""

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from navbuckets.functions.text import py_strip
from navbuckets.functions.urls import normalize_url

ALPHABET = st.sampled_from([" ", "\t", "\n", "\r", "\u00a0", "a", "é", "/", ":", "h", "t", "p", "s", "x"])
TEXTS = st.lists(st.text(alphabet=ALPHABET, max_size=12), min_size=1, max_size=40)


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_py_strip_matches_python(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    got = [r.x for r in df.select(py_strip(F.col("s")).alias("x")).collect()]
    assert got == [t.strip() for t in texts]


@settings(max_examples=5, deadline=None)
@given(TEXTS)
def test_normalize_is_idempotent(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for check in ("http", "strict"):
        once = df.select(normalize_url(F.col("s"), check).alias("u"))
        twice = once.select(F.col("u"), normalize_url(F.col("u"), check).alias("v")).collect()
        assert all(r.u == r.v for r in twice)
