"""The language of report texts."""

import pytest
from pyspark.sql import functions as F

from lumenfold.functions.report import Report, Typed, benchmark_columns, ordered
from lumenfold.model.schema import ModelError
from lumenfold.operators import history as H


@pytest.fixture(scope="module")
def one(spark):
    return spark.createDataFrame([(4.0, None, "word", True, "k1"), (2.5, 0.0, "", False, "k2")], "a double, b double, s string, t boolean, scope string")


def values(one, text, **more):
    columns = {"a": Typed("number", F.col("a")), "b": Typed("number", F.col("b")), "s": Typed("text", F.col("s")), "t": Typed("bool", F.col("t")), "current.Sales": Typed("number", F.col("a"))}
    return [r["v"] for r in one.select(Report(columns, **more)(text).column.alias("v")).collect()]


@pytest.mark.parametrize(("text", "found"), [
    ("a + 1 * 2", [6.0, 4.5]), ("(a + 1) * 2 - 1", [9.0, 6.0]), ("a - 1 - 1", [2.0, 0.5]), ("a / 2 / 2", [1.0, 0.625]), ("a / 0", [0.0, 0.0]), ("a + b", [None, 2.5]), ("-1.5e1", [-15.0, -15.0]),
    ("a > 3", [True, False]), ("a == 4.0000000001", [True, False]), ("a != 4", [False, True]), ("s == 'word'", [False, False]), ("b < 1", [False, True]), ("t == 1", [True, False]), ("gone > 1", [False, False]), ("gone", [None, None]),
    ("a > 3 OR a > 1 AND b == 0", [False, True]), ("a > 3 OR (a > 1 AND b == 0)", [True, True]), ("NOT a > 3 AND t", [False, True]), ("not(a > 3) AND t", [False, False]), ("s AND t", [True, False]), ("true", [True, True]),
    ("abs(0 - a)", [4.0, 2.5]), ("if(t, a, b)", [4.0, 0.0]), ("if(s, 'yes', 'no')", ["yes", "no"]), ("coalesce(b, 7)", [7.0, 0.0]), ("round(a / 3, 2)", [1.33, 0.83]), ("round(0 - a, 0)", [-4.0, -3.0]), ("ratio(a, b)", [None, None]), ("pct_change(a, 2)", [100.0, 25.0]),
    ("plural(a - 3, 'day', 'days')", ["day", "days"]), ("plural(b, 'day', 'days')", [None, "days"]), ("coalesce(gone, 'it is, (so)')", ["it is, (so)"] * 2),
    ("benchmark_p50(Sales)", [0.0, 0.0]), ("if(t, 1)", [None, None]),
])
def test_expressions(one, text, found):
    assert [round(g, 9) if isinstance(g, float) else g for g in values(one, text)] == found


def test_refused(one):
    with pytest.raises(ModelError, match="MC7002"):
        values(one, "sine(a)")
    with pytest.raises(ModelError, match="MC7003"):
        values(one, "if(t, a, s)")


def test_benchmarks_by_scope(spark, one):
    stats = [10.0, 20.0, 2.0, 40.0, 50.0, 3.0, 0.5, 9.0]
    library = spark.createDataFrame([("Sales", "k1", *stats), ("Sales", "", *[10 * x for x in stats]), ("Flat", "k1", *[1.0] * 6, 0.0, 1.0)], "metric string, scope string, p10 double, p25 double, p50 double, p75 double, p90 double, mean double, stddev double, sample_count double")
    rows = benchmark_columns(one, library, "scope", ["Sales", "Flat"])
    assert rows.count() == 2
    ask = lambda text: values(rows, text, benchmarks=["Sales", "Flat"])
    assert ask("benchmark_p50(Sales)") == [2.0, 20.0] and ask("benchmark_mean('Flat')") == [1.0, 0.0]
    assert ask("benchmark_above_median(Sales)") == [1.0, 0.0] and ask("benchmark_z_score(Sales, a)") == [2.0, -5.5] and ask("benchmark_z_score(Flat, a)") == [0.0, 0.0]
    assert ask("benchmark_percentile(Sales, a * 10)") == [75.0, 10.0] and ask("benchmark_percentile(Sales, 1e9)") == [100.0, 100.0] and ask("benchmark_percentile(Other, a)") == [0.0, 0.0]


def test_bindings_are_ordered():
    assert ordered({"z": "a + 1", "a": "q * 2", "m": "z + a", "q": "7"}) == ["q", "a", "z", "m"]
    assert ordered({"x": "y", "y": "x", "b": "1", "ab": "b"}) == ["b", "ab", "x", "y"]


def test_texts_with_formats(spark):
    rows = spark.createDataFrame([("n", 1234.5, 1000.0)], "k string, now double, before double")
    templates = [{"id": "t", "finding": "f", "priority": 1, "when": "now > before", "text": "{k}: {now:,.1} ({change:+.1}), {left}, {loop}", "bindings": {"change": "pct_change(now, before)", "left": "if(change > 50, 'much', 'some')", "loop": "loop2", "loop2": "loop"}}]
    assert [r["text"] for r in H.fire_texts(rows, templates, ["k"]).collect()] == ["n: 1,234.5 (+23.5), some, "]
