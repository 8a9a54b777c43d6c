"""Inputs, recipes and lints."""

import pytest

from lumenfold.model.lint import lint
from lumenfold.model.recipes import parse_recipe, validate_recipe
from lumenfold.model.schema import Dimension, Hierarchy, Measure, Model, ModelError, Rule
from lumenfold.model.validate import validate
from lumenfold.sources import inputs


@pytest.fixture
def model():
    market = Dimension("Market", ["US", "East", "West", "Moon"], "Standard", [Hierarchy("Market", [("US", "East", 1.0), ("US", "West", 1.0)])])
    measures = [Measure("Spend"), Measure("Clicks", data_type="I64"), Measure("CPC", "Derived", "WeightedAverage", "Clicks"), Measure("Win_Rate"), Measure("Spare", "Derived")]
    return Model("m", [Dimension("Time", ["2026-01", "2026-02"], "Time"), market, Dimension("Measure", [], "Measure")], measures, [Rule("CPC", "Spend / Clicks"), Rule("Spare", "CPC + 1")])


def test_inputs(spark, model):
    good = [("2026-01", "East", "Spend", "5.5"), ("2026-01", "East", "Clicks", "3"), ("2026-02", "West", "Spend", "1e3")]
    columns = "Time string, Market string, Measure string, value string"
    cube = inputs.accepted(model, spark.createDataFrame(good, columns))
    assert cube.read({"Time": "2026-01", "Market": "US", "Measure": "Spend"}).first()["value"] == 5.5
    bad = [("2026-09", "East", "Spend", "1"), (None, "West", "Spend", "1"), ("2026-01", "US", "Spend", "1"), ("2026-01", "West", "Spnd", "1"), ("2026-01", "West", "CPC", "1"), ("2026-01", "West", "Spend", "x"), ("2026-02", "West", "Clicks", "1.5"), ("2026-02", "East", "Spend", "NaN"), ("2026-02", "West", "Spend", "2")]
    codes = sorted((r["code"], r["Measure"]) for r in inputs.problems(model, spark.createDataFrame(good + bad, columns)).collect())
    assert codes == sorted([("MC2013", "Spend"), ("MC2013", "Spend"), ("MC2020", "Spend"), ("MC2014", "Spnd"), ("MC2015", "CPC"), ("MC2018", "Spend"), ("MC2018", "Clicks"), ("MC2021", "Spend"), ("MC2025", "Spend")])
    with pytest.raises(ModelError, match="MC2013"):
        inputs.accepted(model, spark.createDataFrame(bad, columns))
    assert inputs.column_problems(model, ["Tme", "market", "Measure", "value"]) == [("MC2012", "column Tme is no dimension"), ("MC2026", "column market is no dimension; did you mean Market?"), ("MC2019", "dimension Time has no column"), ("MC2019", "dimension Market has no column")]


def test_fixtures():
    found = inputs.fixture_problems([{"name": "a"}, {"name": "b"}, {"name": "a"}], [{"name": "g", "fixture": "c"}, {"name": "h", "fixture": "b"}, {"name": "i"}])
    assert [c for c, _ in found] == ["MC2016", "MC2017"]


RECIPE = """
version: 1
name: r
model: ./m.yaml
source: {driver: csv, path: x.csv}
columns:
  - {source: t, dimension: Time}
  - {source: s, measure: Spend, type: f64}
defaults: {Market: East}
"""


def codes(text, model, **paths):
    tree, wrong = parse_recipe(text)
    return [c for c, _, _ in wrong] or [c for c, _, _ in validate_recipe(tree, model, **paths)]


@pytest.mark.parametrize(("old", "new", "want"), [
    ("", "", []), ("version: 1", "version: 2", ["MC5012"]), ("name: r\n", "", ["MC5007"]), ("driver: csv", "driver: ftp", ["MC5002"]), ("driver: csv, ", "", ["MC5007"]), ("columns:", "columns: [", ["MC5001"]), ("path: x.csv", "table: a, query: b", ["MC5003"]),
    ("dimension: Time", "dimension: Tme", ["MC5004"]), ("measure: Spend", "measure: Spnd", ["MC5005"]), ("type: f64", "type: i64", ["MC5006"]), ("{Market: East}", "{Mrkt: East}", ["MC5008"]), ("{Market: East}", "{Market: Mars}", ["MC5009"]), ("source: s,", "source: t,", ["MC5010"]),
    ("dimension: Time}", "dimension: Time, measure: Spend}", ["MC5011"]), ("{source: t, dimension: Time}", "{source: t}", ["MC5011"]), ("{source: t, dimension: Time}", "{source: t, skip: true}", []), ("{Market: East}", "{Time: '2026-01'}", ["MC5016"]), ("measure: Spend, type: f64", "measure: CPC", ["MC5018"]),
    ("path: x.csv", "path: x.csv, format: long", ["MC5021"]), ("dimension: Time}", "dimension: Time, type: timestamp}", ["MC5030"]), ("dimension: Time}", "dimension: Time, time_timezone: PST}", ["MC5032"]), ("dimension: Time}", "dimension: Time, time_timezone: Europe/Paris}", []),
])
def test_recipes(model, old, new, want):
    assert codes(RECIPE.replace(old, new, 1), model) == want


def test_recipes_stay_in_their_workspace(model):
    assert codes(RECIPE.replace("./m.yaml", "../../m.yaml"), model, folder="/w/recipes", workspace="/w") == ["MC5017"]
    assert codes(RECIPE.replace("./m.yaml", "../m.yaml"), model, folder="/w/recipes", workspace="/w") == []


def test_lints(model):
    tree = {"dimensions": [{"name": "Time"}, {"name": "Market", "description": "where"}], "measures": [{"name": "Spend", "description": " "}], "rules": [{"target_measure": "CPC"}]}
    found = {(c, p) for c, _, p, _ in lint(model, tree)}
    assert found == {("MC3001", "dimensions.Time"), ("MC3002", "measures.Spend"), ("MC3003", "rules.CPC"), ("MC3004", "golden_tests"), ("MC3005", "dimensions.Market.Moon"), ("MC3007", "measures.Win_Rate"), ("MC3009", "measures.Win_Rate"), ("MC3010", "measures.Spare")}
    model.dimensions[1].hierarchies[0].edges.append(("Other", "Moon", 1.0))
    model.measures += [Measure(f"D{i}", "Derived") for i in range(6)]
    model.rules += [Rule("D0", "Spare + Win_Rate"), *[Rule(f"D{i}", f"D{i - 1} * 2") for i in range(1, 6)]]
    more = {(c, p) for c, _, p, _ in lint(model)}
    assert {("MC3011", "hierarchies.default"), ("MC3006", "rules.D5"), ("MC3010", "measures.D5")} <= more and ("MC3006", "rules.D2") not in more


@pytest.mark.parametrize(("body", "want"), [
    ("sum_over(Spend, Nowhere)", "MC1016"), ("avg_over(Nope, Market)", "MC1018"), ("is_element(Nowhere, \"East\")", "MC1023"), ("is_element(Market, \"Mars\")", "MC1022"), ("if(current_element(Nowhere) == \"x\", 1, 0)", "MC1023"), ("param(\"none\")", "MC2062"), ("actual_ref(Spend, \"text\")", "MC2066"),
])
def test_codes_of_rules(model, body, want):
    model.rules.append(Rule("Win_Rate", body))
    assert want in {c for c, _ in validate(model)}


def test_codes_of_references_and_times(model):
    model.refs.parameters.update({"Spend": 1.0, "East": 2.0})
    model.refs.thresholds.update({"open": [1.0, 2.0], "down": [2.0, 1.0, None]})
    model.refs.lookups.update({"a": {"x|y": 1.0, "x": 2.0}, "open": {"x": 1.0}})
    model.measures += [Measure("I", "Indicator", indicator=("Nowhere", "x")), Measure("J", "Indicator", indicator=("Market", "x")), Measure("K", "Indicator")]
    time = model.dimension("Time")
    time.granularity = "month"
    time.time_meta = {"2026-01": {"period_start": "2026-01-01T00:00:00", "period_end_exclusive": "2026-02-01T00:00:00Z"}, "2026-02": {"period_start": "2026-02-01", "period_end_exclusive": "2026-02-15"}}
    codes = [c for c, _ in validate(model)]
    for code in ("MC2060", "MC2061", "MC2042", "MC2041", "MC2052", "MC2037", "MC1023", "MC1022", "MC2064", "MC2044", "MC2045"):
        assert codes.count(code) == 1, code
