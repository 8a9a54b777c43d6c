"""What plans look like, and readers and writers that once looked at a part of their input."""

import io
import json
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from lumenfold.model.schema import ModelError
from lumenfold.operators import query as Q
from lumenfold.operators.writes import Imports, dispose
from lumenfold.plans.sales import leaf_facts, sales_cube
from lumenfold.sources import ingest as I
from lumenfold.sources import readers as S


def plan(df, mode="formatted"):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain(mode)
    return out.getvalue()


def test_closures_are_the_side_that_is_broadcast(spark, sf_dir, tmp_path):
    leaf_facts(spark, sf_dir).write.parquet(str(tmp_path / "facts"))
    cube = sales_cube(spark, sf_dir, facts=spark.read.parquet(str(tmp_path / "facts")))
    text = plan(cube.consolidate({"Time": ["1997"], "Market": ["ASIA"]}, ["Revenue"]))
    assert "SortMergeJoin" not in text and text.count("BroadcastHashJoin") >= 2
    # facts are streamed past the closures: nothing with the facts' scan beneath it is broadcast
    tree = text[: text.index("\n\n")].splitlines()
    for i, line in enumerate(tree):
        if "BroadcastExchange" in line:
            depth = len(line) - len(line.lstrip(" :+-"))
            below = [x for x in tree[i + 1 :] if len(x) - len(x.lstrip(" :+-")) > depth]
            assert not any("Scan parquet" in x for x in below[: next((k for k, x in enumerate(tree[i + 1 :]) if len(x) - len(x.lstrip(" :+-")) <= depth), len(below))])


def test_several_aggregates_and_reads_scan_once(spark, sf_dir):
    from lumenfold.queries import QUERIES

    for name in ("A11_A12_aggregate", "P01_P04_point_reads", "J10_O02_diff"):
        text = plan(QUERIES[name](spark, sf_dir), "simple")
        assert text.count("lineitem.parquet") == 1 and "NestedLoop" not in text and "Cartesian" not in text


def test_aggregates_equal_one_by_one(spark, sf_dir):
    cube = sales_cube(spark, sf_dir)
    calls = {"a": ("sum(Qty)", "Market == 'NATION_8'"), "b": ("count(Qty > 100)", None), "c": ("max(Price)", "sqrt(Gross) > 600"), "d": ("mean(Disc)", "Gross > 1e15")}
    got = Q.aggregates(cube, calls).first()
    for name, (call, test) in calls.items():
        assert got[name] == pytest.approx(Q.aggregate(cube, call, test).first()["value"])


def test_imports_are_folded_in_order(spark, tmp_path):
    base = spark.createDataFrame([("a", 1.0), ("b", None), ("c", 3.0)], "k string, value double")
    batches = [([("a", 10.0), ("b", 20.0)], "append"), ([("c", 30.0), ("d", 40.0)], "merge"), ([("c", None), ("e", 5.0)], "merge"), ([("c", 7.0), ("d", 8.0), ("a", 9.0)], "append")]
    imports, want = Imports(spark, str(tmp_path / "s")), base
    for rows, how in batches:
        cells = spark.createDataFrame(rows, "k string, value double")
        imports.apply(cells, how)
        want = dispose(want, cells, ["k"], how)
    as_dict = lambda df: {r["k"]: r["value"] for r in df.collect()}
    state = imports.state(base, ["k"])
    assert as_dict(state) == as_dict(want)
    assert plan(state, "simple").count("Join") <= 2


def test_fields_of_late_items_are_found(spark):
    items = [{"a": 1, "c": True}] * 150 + [{"a": 2.5, "late": "x", "odd name": None, "c": False}, {"a": 3, "b": [1], "late": 7}]
    doc = spark.createDataFrame([(json.dumps({"d": items}),)], "value string")
    rows = S.json_documents(spark, doc, "d")
    assert dict(rows.dtypes) == {"a": "double", "c": "boolean", "b": "string", "late": "string", "odd name": "string"} and rows.columns[:2] == ["a", "c"]
    assert rows.where("late is not null").count() == 2 and rows.where("a = 2.5").count() == 1 and rows.count() == 152
    assert S.json_documents(spark, spark.createDataFrame([('{"d": []}',)], "value string"), "d").count() == 0


def test_a_late_text_makes_a_report_column_no_measure(spark, tmp_path):
    lines = ["City,Clicks,Note"] + [f"c{i},{i},{i}" for i in range(300)] + ["last,7,see below"]
    (tmp_path / "r.csv").write_text("\n".join(lines))
    cells = S.report_csv(spark, str(tmp_path / "r.csv"))
    assert {r["measure"] for r in cells.select("measure").distinct().collect()} == {"Clicks"} and cells.count() == 301


def test_local_databases_are_bounded(spark, tmp_path):
    import sqlite3

    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute("create table t (a integer)")
        db.executemany("insert into t values (?)", [(i,) for i in range(20)])
    assert S.sqlite(spark, str(tmp_path / "x.db"), "select * from t", most=20).count() == 20
    for read in (lambda: S.sqlite(spark, str(tmp_path / "x.db"), "select * from t", most=19), lambda: S.duckdb(spark, ":memory:", "select * from range(20);", most=19)):
        with pytest.raises(ModelError, match="MC5101"):
            read()


def test_new_elements_are_bounded(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(I, "MOST_CREATED", 3)
    model = sales_cube(spark, sf_dir).model
    cells = lambda n: spark.createDataFrame([(f"new{i % n}", 1.0) for i in range(20)], "Market string, value double")
    assert I.missing_elements(cells(3), model, "create")[1]["Market"] == ["new0", "new1", "new2"]
    with pytest.raises(ModelError, match="MC5102"):
        I.missing_elements(cells(4), model, "create")


def test_filters_take_bare_and_hyphenated_names(spark):
    rows = spark.createDataFrame([("New-York", 1.0), ("Tampa", None)], "Market string, Spend double")
    count = lambda text: rows.where(F.coalesce(Q.Filter(text, {"Spend"}, {"Market"}).column(), F.lit(False))).count()
    assert [count(t) for t in ("Market == Tampa", "Market != New-York", "Spend == Nothing", "! Market == 'Tampa'", "NOT Spend >= 1 OR Market == 'Tampa' AND Spend == x-1")] == [0, 2, 1, 1, 1]


def test_anchor_override(spark, sf_dir):
    cube = sales_cube(spark, sf_dir, quarters=False)
    assert cube.at("1997-01").scope.anchor == 24 and cube.model.anchor == "1998-06"
    with pytest.raises(ModelError):
        cube.at("1901-01")


def test_writes_are_logged(spark, tmp_path):
    from lumenfold.operators.writes import log_writes

    cells = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "k string, value double")
    ids = [log_writes(cells, str(tmp_path / "log"), who) for who in ("ann", "bob")]
    rows = spark.read.json(str(tmp_path / "log")).collect()
    assert len(rows) == 4 and {(r["write_id"], r["principal"]) for r in rows} == set(zip(ids, ("ann", "bob"), strict=True))
