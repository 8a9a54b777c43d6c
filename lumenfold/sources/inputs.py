"""Long input cells and fixtures: checked where they are, all rows at once, before they become facts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.model.schema import Model, ModelError
from lumenfold.operators.cube import Cube


def column_problems(model: Model, columns: Iterable[str], measure: str = "Measure", value: str = "value") -> list[tuple[str, str]]:
    """Columns that are no dimension of the model, dimensions without a column, and columns that differ in case alone."""
    columns, want = list(columns), [*[d.name for d in model.axes], measure, value]
    out = []
    for c in columns:
        if c not in want:
            near = next((w for w in want if w.lower() == c.lower()), None)
            out.append(("MC2026" if near else "MC2012", f"column {c} is no dimension" + (f"; did you mean {near}?" if near else "")))
    return out + [("MC2019", f"dimension {w} has no column") for w in want if w not in columns]


def problems(model: Model, cells: DataFrame, measure: str = "Measure", value: str = "value") -> DataFrame:
    """(code, message, *coordinate, value) of every cell that is refused: one pass for what a row shows, one grouping for coordinates that occur twice.

    Unknown elements and measures, derived measures, coordinates above the leaves, values that are no numbers of the
    measure's type or not finite. A null in a coordinate is an unknown element.
    """
    known = {m.name: m for m in model.measures}
    inputs, derived = [m for m in known if known[m].role == "Input"], [m for m in known if known[m].role != "Input"]
    whole = [m for m in inputs if known[m].data_type == "I64"]
    c, m, n = F.coalesce, F.col(measure), F.col(value).try_cast("double")
    is_in = lambda x, names: c(x.isin(list(names)), F.lit(False)) if names else F.lit(False)
    found = []
    for d in model.axes:
        x = F.col(d.name)
        found.append(F.when(~is_in(x, d.elements), F.struct(F.lit("MC2013").alias("code"), F.concat(F.lit(f"{d.name} has no element "), c(x.cast("string"), F.lit("null"))).alias("message"))))
        above = [e for e in d.elements if d.hierarchy and e in d.hierarchy.children]
        found.append(F.when(is_in(x, above), F.struct(F.lit("MC2020").alias("code"), F.concat(x, F.lit(f" is no leaf of {d.name}")).alias("message"))))
    found.append(F.when(~is_in(m, known), F.struct(F.lit("MC2014").alias("code"), F.concat(F.lit("unknown measure "), c(m.cast("string"), F.lit("null"))).alias("message"))))
    found.append(F.when(is_in(m, derived), F.struct(F.lit("MC2015").alias("code"), F.concat(m, F.lit(" is derived")).alias("message"))))
    found.append(F.when(n.isNull() | (is_in(m, whole) & (n != F.floor(n))), F.struct(F.lit("MC2018").alias("code"), F.lit("the value is not of the measure's type").alias("message"))))
    found.append(F.when(F.isnan(n) | (F.abs(n) == float("inf")), F.struct(F.lit("MC2021").alias("code"), F.lit("the value is not finite").alias("message"))))
    at = [*[d.name for d in model.axes], measure]
    rows = cells.select(*at, F.col(value).cast("string").alias(value), F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("x")).select("x.code", "x.message", *at, value)
    twice = cells.groupBy(*at).agg(F.count("*").alias("_n")).where("_n > 1")
    return rows.unionByName(twice.select(F.lit("MC2025").alias("code"), F.concat(F.lit("the coordinate occurs "), F.col("_n").cast("string"), F.lit(" times")).alias("message"), *at, F.lit(None).cast("string").alias(value)))


def accepted(model: Model, cells: DataFrame, measure: str = "Measure", value: str = "value") -> Cube:
    """A cube of the cells, or the first problem as an error."""
    if bad := column_problems(model, cells.columns, measure, value):
        raise ModelError(*bad[0])
    if first := problems(model, cells, measure, value).orderBy("code", "message").limit(1).collect():
        raise ModelError(first[0]["code"], first[0]["message"])
    return Cube.from_long(model, cells.withColumn(value, F.col(value).cast("double")), measure, value)


def fixture_problems(fixtures: Iterable[Mapping], goldens: Iterable[Mapping]) -> list[tuple[str, str]]:
    """Fixtures of one name, and golden tests that name none of them."""
    names = [x["name"] for x in fixtures]
    out = [("MC2016", f"fixture {n} is declared twice") for n in sorted({n for n in names if names.count(n) > 1})]
    return out + [("MC2017", f"golden test {g['name']} names the unknown fixture {g['fixture']}") for g in goldens if g.get("fixture") and g["fixture"] not in names]
