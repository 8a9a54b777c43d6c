"""The planning cube of the golden model: reads, rollups, windows over all declared time elements, writes."""

import itertools

import pytest
from pyspark.sql import functions as F

from lumenfold.model.load import from_tree
from lumenfold.model.schema import Dimension, Hierarchy, Measure, Model, ModelError, ReferenceData, Rule
from lumenfold.model.validate import inspect, validate
from lumenfold.operators import query as Q
from lumenfold.operators import writes as W
from lumenfold.operators.cube import Cube

MONTHS = [f"{m}_2026" for m in "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()]
CHANNELS = ["Paid_Search", "Paid_Social", "Display", "Email", "Organic"]
CITIES = ["Tampa", "Orlando", "Miami", "Atlanta", "Charlotte", "New_York_City", "Boston"]


def golden_model():
    time = Dimension("Time", MONTHS + ["Q1_2026", "Q2_2026", "Q3_2026", "Q4_2026", "FY_2026"], hierarchies=[Hierarchy("Time", [(f"Q{i // 3 + 1}_2026", m, 1.0) for i, m in enumerate(MONTHS)] + [("FY_2026", f"Q{q}_2026", 1.0) for q in range(1, 5)])])
    channel = Dimension("Channel", CHANNELS + ["Paid_Media", "Owned_Earned", "All_Channels"], hierarchies=[Hierarchy("Channel", [("Paid_Media", c, 1.0) for c in CHANNELS[:3]] + [("Owned_Earned", c, 1.0) for c in CHANNELS[3:]] + [("All_Channels", "Paid_Media", 1.0), ("All_Channels", "Owned_Earned", 1.0)])])
    market = Dimension("Market", CITIES + ["South", "North", "USA"], hierarchies=[Hierarchy("Market", [("South", c, 1.0) for c in CITIES[:5]] + [("North", c, 1.0) for c in CITIES[5:]] + [("USA", "South", 1.0), ("USA", "North", 1.0)])])
    weighted = {"CPC": "Spend", "CVR": "Clicks", "Close_Rate": "Leads", "AOV": "Customers", "COGS_Rate": "Revenue"}
    measures = [Measure("Spend")] + [Measure(m, aggregation="WeightedAverage", weight=w) for m, w in weighted.items()]
    rules = {"Clicks": "Spend / CPC", "Leads": "Clicks * CVR", "Customers": "Leads * Close_Rate", "Revenue": "Customers * AOV", "Gross_Profit": "Revenue * (1 - COGS_Rate)"}
    measures += [Measure(m, "Derived") for m in rules]
    dims = [Dimension("Scenario", ["Baseline", "Aggressive"], "Scenario", scenario_meta={"Baseline": "Default"}), Dimension("Version", ["Working", "Approved"], "Version", version_state={"Working": "Draft", "Approved": "Approved"}), time, channel, market, Dimension("Measure", [], "Measure")]
    return Model("golden", dims, measures, [Rule(m, b) for m, b in rules.items()], ReferenceData())


@pytest.fixture(scope="module")
def cube(spark):
    rows = []
    for (t, month), (c, channel), (m, city) in itertools.product(enumerate(MONTHS), enumerate(CHANNELS), enumerate(CITIES)):
        t += 1  # months count from one in the anchor's closed form
        rows.append(("Baseline", "Working", month, channel, city, 10000.0 + 500 * t + 1000 * c + 200 * m, 1.5 + 0.05 * c + 0.02 * m, 0.02 + 0.005 * c, 0.1 + 0.01 * c, 200.0 + 50 * m, 0.3 + 0.02 * c))
    facts = spark.createDataFrame(rows, "Scenario string, Version string, Time string, Channel string, Market string, Spend double, CPC double, CVR double, Close_Rate double, AOV double, COGS_Rate double")
    return Cube(golden_model(), facts.cache())


AT = {"Scenario": "Baseline", "Version": "Working", "Time": "Mar_2026", "Channel": "Paid_Search", "Market": "Tampa"}
ANCHORS = {"Spend": 11500.0, "CPC": 1.5, "AOV": 200.0, "Clicks": 7666.666666666667, "Leads": 153.33333333333334, "Customers": 15.333333333333334, "Revenue": 3066.6666666666674, "Gross_Profit": 2146.6666666666674}


@pytest.mark.parametrize("measure", list(ANCHORS))
def test_anchor(cube, measure):
    assert cube.read({**AT, "Measure": measure}).first()["value"] == pytest.approx(ANCHORS[measure], abs=1e-9)


def test_consolidation_by_hand(cube):
    at = {**AT, "Time": "FY_2026", "Channel": "All_Channels", "Market": "USA"}
    leaves = [(10000.0 + 500 * t + 1000 * c + 200 * m, 1.5 + 0.05 * c + 0.02 * m) for t in range(1, 13) for c in range(5) for m in range(7)]
    assert cube.read({**at, "Measure": "Spend"}).first()[0] == pytest.approx(sum(s for s, _ in leaves))
    assert cube.read({**at, "Measure": "CPC"}).first()[0] == pytest.approx(sum(s * c for s, c in leaves) / sum(s for s, _ in leaves))
    assert cube.read({**at, "Measure": "Clicks"}).first()[0] == pytest.approx(sum(s / c for s, c in leaves))


def test_empty_cell_is_null(cube):
    assert cube.read({**AT, "Scenario": "Aggressive", "Measure": "Revenue"}).first()["value"] is None
    with pytest.raises(ModelError):
        cube.read({**AT, "Market": "Atlantis", "Measure": "Spend"})


def test_windows_count_consolidated_time_elements(spark):
    time = Dimension("Time", ["Jan", "Q1", "Feb", "Mar"], hierarchies=[Hierarchy("Time", [("Q1", "Jan", 1.0), ("Q1", "Feb", 1.0), ("Q1", "Mar", 1.0)])])
    rules = {"P": "prev(x)", "I": "period_index()", "L": "periods_to_end()", "C": "cumulative(x)"}
    model = Model("m", [time, Dimension("Place", ["a"])], [Measure("x")] + [Measure(m, "Derived") for m in rules], [Rule(m, b) for m, b in rules.items()])
    cube = Cube(model, spark.createDataFrame([("Jan", "a", 1.0), ("Feb", "a", 2.0), ("Mar", "a", 4.0)], "Time string, Place string, x double"))
    rows = {r["Time"]: r for r in cube.evaluate(dense="time").collect()}
    assert (rows["Feb"]["P"], rows["Feb"]["I"], rows["Feb"]["L"]) == (None, 2.0, 1.0)
    assert rows["Mar"]["P"] == 2.0 and rows["Mar"]["C"] == 7.0


def test_weights_and_orphans(spark):
    place = Dimension("Place", ["a", "b", "all", "orphan"], hierarchies=[Hierarchy("Place", [("all", "a", 1.0), ("all", "b", -2.0)])])
    model = Model("m", [Dimension("Time", ["t"]), place], [Measure("x"), Measure("mx", aggregation="Max"), Measure("S", "Derived")], [Rule("S", "sum_over(x, Place)")])
    cube = Cube(model, spark.createDataFrame([("t", "a", 3.0, 3.0), ("t", "b", 5.0, 5.0), ("t", "orphan", 100.0, 1.0)], "Time string, Place string, x double, mx double"))
    got = cube.consolidate({"Place": ["all"]}, ["x", "mx"]).first()
    assert (got["x"], got["mx"]) == (3.0 - 10.0, 5.0)
    assert {r["S"] for r in cube.evaluate(["S"]).collect()} == {8.0}


def test_slice_order_and_bound(cube):
    got = cube.slice({"Scenario": "Baseline", "Version": "Working", "Time": ["Q1_2026"], "Channel": "all_consolidated", "Market": ("subtree", "North")}, ["Spend"]).collect()
    assert [(r["Channel"], r["Market"]) for r in got] == list(itertools.product(["Paid_Media", "Owned_Earned", "All_Channels"], ["New_York_City", "Boston", "North"]))


def test_where_grammar(spark, cube):
    rows = spark.createDataFrame([("x", 1.0, None), ("y", None, None), ("x", 2.0, 2.0 + 5e-10)], "Market string, Spend double, CPC double").withColumn("Channel", F.lit("c"))
    measures, dims = {"Spend", "CPC"}, {"Market", "Channel"}
    count = lambda text: rows.where(F.coalesce(Q.Filter(text, measures, dims).column(), F.lit(False))).count()
    assert count("Spend == CPC") == 2  # null equals null
    assert count("Spend != CPC") == 1
    assert count("CPC <= 2") == 1  # within a billionth
    assert count('Market > "a"') == 0 and count('not Market == "x"') == 1
    with pytest.raises(ModelError):
        Q.where(cube, cube.leaf("none"), "prev(Spend) > 1")


def test_write_checks(spark):
    model = golden_model()
    columns = "Scenario string, Version string, Time string, Channel string, Market string, Measure string, value double"
    good = ("Baseline", "Working", "Jan_2026", "Email", "Tampa", "Spend", 1.0)
    change = lambda i, v: tuple(v if k == i else x for k, x in enumerate(good))
    cells = spark.createDataFrame([good, change(2, "Q1_2026"), change(5, "Revenue"), change(1, "Approved"), change(6, float("nan")), change(3, "Nowhere"), change(4, "Miami")], columns)
    got = [r["reason"] for r in W.check_cells(model, cells, locks=[{"scope": {"Market": "Miami"}}]).collect()]
    assert got == [None, "consolidated", "derived", "version_locked", "not_finite", "unknown_element", "locked"]
    assert W.on_error(W.check_cells(model, cells), "skip_row").count() == 2
    with pytest.raises(ValueError, match="can't be written"):
        W.on_error(W.check_cells(model, cells), "abort")


def test_imports_roll_back(spark, tmp_path):
    frame = lambda *rows: spark.createDataFrame(list(rows), "k string, value double")
    imports = W.Imports(spark, f"file://{tmp_path}/i")
    base = frame(("a", 1.0))
    first = imports.apply(frame(("a", 2.0), ("b", 3.0)))
    imports.apply(frame(("a", 9.0), ("c", 4.0)), "append")
    state = lambda: {r["k"]: r["value"] for r in imports.state(base, ["k"]).collect()}
    assert state() == {"a": 2.0, "b": 3.0, "c": 4.0}
    imports.rollback(first)
    assert state() == {"a": 1.0, "c": 4.0}


def test_validation():
    model = golden_model()
    assert validate(model) == []
    assert inspect(model)["dimensions"]["Market"]["leaves"] == 7
    model.rules += [Rule("Spend", "CPC + 1"), Rule("Clicks", "prev(cumulative(Nope))")]
    model.dimension("Market").hierarchy.edges.append(("Tampa", "USA", 1.0))
    codes = {c for c, _ in validate(model)}
    assert {"MC2010", "MC2008", "MC1013", "MC2003", "MC2007"} <= codes
    tree = {"dimensions": [{"name": "Time", "elements": [{"name": "t"}]}], "measures": [{"name": "x"}, {"name": "y", "role": "Derived"}], "rules": [{"target_measure": "y", "body": {"Add": [{"measure_ref": "x"}, {"const": 2}]}}], "status_thresholds": [{"name": "b", "bands": [{"max": 1}, {"max": 0}, {}]}]}
    loaded = from_tree(tree)
    assert loaded.rules[0].body == "(x + 2.0)" and [c for c, _ in validate(loaded)] == ["MC2041"]


def test_goldens_and_sinks(spark, cube, tmp_path):
    from lumenfold.operators.cube import golden_results
    from lumenfold.sources import sinks

    cube.model.goldens = [{"name": "a", "coord": {**AT, "Measure": "Spend"}, "expect": 11500.0}, {"name": "b", "coord": {**AT, "Measure": "Revenue"}, "expect_within_epsilon": {"value": 3066.6666666666674, "epsilon": 1e-9}}, {"name": "c", "coord": {**AT, "Measure": "CPC"}, "expect": 2.0}]
    assert [g["passed"] for g in golden_results(cube)] == [True, True, False]
    rows = spark.createDataFrame([("a,b", 1), ("c", None)], "k string, v int").coalesce(1)
    assert sinks.render(rows, "csv") == 'k,v\n"a,b",1\nc,\n'
    assert sinks.render(rows, "text").splitlines()[1] == "a,b  1"
    assert '"next_offset": 1' in sinks.render(rows, "json", 1)
    sinks.write(rows, str(tmp_path / "o"), "json")
    assert spark.read.json(str(tmp_path / "o")).count() == 2
