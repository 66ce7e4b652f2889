"""All predicates under both NULL rules against a small model of the order of values."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lithograin.errors import ColumnNotFound
from lithograin.functions import predicates as P
from lithograin.functions.like import pattern_class
from lithograin.functions.predicates import Filter, compile_filters

VALUES = [None, -3, 0, 1, 2, 7]


def key(v):
    return (1, 0) if v is None else (0, v)


MODEL = {
    "eq": lambda v, x: v == x[0],
    "ne": lambda v, x: v != x[0],
    "gt": lambda v, x: key(v) > key(x[0]),
    "ge": lambda v, x: key(v) >= key(x[0]),
    "lt": lambda v, x: key(v) < key(x[0]),
    "le": lambda v, x: key(v) <= key(x[0]),
    "between": lambda v, x: key(x[0]) <= key(v) <= key(x[1]),
    "in": lambda v, x: v in x,
    "not_in": lambda v, x: v not in x,
}


@pytest.fixture(scope="module")
def numbers(spark):
    return spark.createDataFrame([(v,) for v in VALUES], "v int").cache()


@pytest.mark.parametrize("kind", sorted(MODEL))
def test_total_order(numbers, kind):
    arity = {"between": 2, "in": 3, "not_in": 3}.get(kind, 1)
    cases = [(x,) for x in VALUES] if arity == 1 else [(0, 2), (2, 0), (None, 2), (0, None), (None, None)] if arity == 2 else [(), (1, 7), (1, None), (None,)]
    marks = [F.coalesce(P.compile_operator(F.col("v"), P.Operator(kind, c), numbers.schema["v"].dataType), F.lit(False)).alias(f"c{i}") for i, c in enumerate(cases)]
    for row in numbers.select("v", *marks).collect():
        for i, c in enumerate(cases):
            assert row[f"c{i}"] == MODEL[kind](row["v"], c), (kind, row["v"], c)


def test_ansi_leaves_nulls_out(numbers):
    found = numbers.where(compile_filters(numbers, [Filter("v", P.not_equals(1))], P.ANSI)).collect()
    assert None not in [r["v"] for r in found]
    assert numbers.where(compile_filters(numbers, [Filter("v", P.is_in([]))], P.ANSI)).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab_%\\\n", max_size=5), min_size=1, max_size=4), st.text(alphabet="ab_%\\", max_size=4))
def test_like_model(spark, texts, pattern):
    import re

    rule = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern)
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r["m"] for r in df.select(P.compile_operator(F.col("t"), P.matches(pattern), df.schema["t"].dataType).alias("m")).collect()]
    assert got == [re.fullmatch(rule, t, re.S) is not None for t in texts]


def test_pattern_classes():
    assert [pattern_class(p) for p in ("", "abc", "abc%", "%abc", "%abc%", "a%c", "a_c", "%")] == ["exact", "exact", "prefix", "suffix", "contains", "complex", "complex", "contains"]


def test_filters_reach_the_scan(spark, data_dir):
    df = spark.read.parquet(f"{data_dir}/lineitem.parquet")
    plan = df.where(compile_filters(df, [Filter("l_quantity", P.greater_than(45.0)), Filter("l_returnflag", P.matches("R%"))])).select("l_orderkey")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(l_quantity,45.0)" in text and "StringStartsWith(l" in text and "l_comment" not in text


def test_unknown_column(numbers):
    with pytest.raises(ColumnNotFound):
        compile_filters(numbers, [Filter("nope", P.equals(1))])
    assert compile_filters(numbers, []) is None
