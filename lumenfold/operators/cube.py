"""A cube: a model over a wide leaf frame, with rules, consolidation, slices and reads as plans."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from copy import copy
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import formula
from lumenfold.functions.compiler import Compiler, Scope
from lumenfold.functions.scalar import finite
from lumenfold.model.schema import Measure, Model, ModelError

SLICE_CELLS = 1_048_576


class Cube:
    """facts: one row for each leaf coordinate with a column for each axis and each input measure (sparse is fine)."""

    def __init__(self, model: Model, facts: DataFrame):
        self.model, self.facts = model, facts

    @classmethod
    def from_long(cls, model: Model, cells: DataFrame, measure: str = "Measure", value: str = "value") -> Cube:
        """From one row for each cell; measures are pivoted in one aggregation, with their names known."""
        axes = [d.name for d in model.axes]
        inputs = [m.name for m in model.measures if m.role == "Input"]
        return cls(model, cells.groupBy(*axes).agg(*[F.max(F.when(F.col(measure) == m, F.col(value).cast("double"))).alias(m) for m in inputs]))

    @property
    def spark(self) -> SparkSession:
        return self.facts.sparkSession

    @property
    def axes(self) -> list[str]:
        return [d.name for d in self.model.axes]

    def ordinal(self, dim: str) -> Column:
        """Position of an element in its declaration, from a literal map."""
        elements = self.model.dimension(dim).elements
        return F.element_at(F.create_map(*[x for i, e in enumerate(elements) for x in (F.lit(e), F.lit(i))]), F.col(dim))

    # the leaf frame
    def leaf_grid(self, dims: Iterable[str] | None = None, declared: Iterable[str] = ()) -> DataFrame:
        """All combinations of leaf elements; dims in `declared` bring all their elements."""
        picked = {}
        for d in dims or self.axes:
            dim = self.model.dimension(d)
            picked[d] = dim.elements if d in declared else dim.leaves()
        return self.product(picked)

    def product(self, picked: Mapping[str, list[str]]) -> DataFrame:
        """All combinations of the elements: each dimension is unfolded in place, in one stage; a large grid is spread before the last one."""
        rows = self.spark.range(1).select()
        cells = 1
        for d, names in picked.items():
            cells *= len(names)
            if cells > SLICE_CELLS:
                rows = rows.repartition(min(4096, 1 + cells // SLICE_CELLS))
            rows = rows.select("*", F.explode(F.array(*[F.lit(e) for e in names])).alias(d)) if names else rows.limit(0).select("*", F.lit("").alias(d))
        return rows

    def leaf(self, dense: str = "time") -> DataFrame:
        """The wide frame. dense: 'none' keeps the facts, 'time' adds the missing time elements of each series, 'all' the whole grid."""
        time = self.model.time
        frame = self.facts
        inputs = [m.name for m in self.model.measures if m.role == "Input" and m.name in frame.columns]
        frame = frame.select(*self.axes, *inputs)
        if dense == "all":
            frame = self.leaf_grid().join(frame, self.axes, "left")
        elif dense == "time" and time is not None:
            rest = [a for a in self.axes if a != time.name]
            # one row for each series, with the declared elements unfolded in place
            grid = frame.select(*rest).distinct().withColumn(time.name, F.explode(F.array(*[F.lit(e) for e in time.elements])))
            frame = grid.join(frame, self.axes, "left")
        if time is not None:
            frame = frame.withColumn("_t", self.ordinal(time.name))
        for m in self.model.measures:
            if m.role == "Indicator":
                dim, element = m.indicator
                frame = frame.withColumn(m.name, F.when(F.col(dim) == element, 1.0).otherwise(0.0))
        return frame

    @cached_property
    def scope(self) -> Scope:
        m = self.model
        time = m.time
        hierarchic = {d.name: d.leaves() for d in m.axes if d.hierarchy}
        return Scope(self.axes, time.name if time else "", {x.name for x in m.measures}, m.default_scenario(), m.scenario.name if m.scenario else None, m.anchor_index(), len(time.elements) if time else 0, m.refs, hierarchic)

    def order_of_rules(self, wanted: Iterable[str] | None = None) -> list[str]:
        """Derived measures that are needed, each after those that it reads."""
        rules = {r.target: formula.names(formula.parse(r.body)) for r in self.model.rules}
        out: list[str] = []

        def visit(name: str, path: tuple) -> None:
            if name in path:
                raise ModelError("MC2007", f"the rules of {name} form a cycle")
            if name in rules and name not in out:
                for n in sorted(rules[name]):
                    visit(n, (*path, name))
                out.append(name)

        for n in wanted if wanted is not None else rules:
            visit(n, ())
        return out

    def rule_filter(self, scope: str) -> Column | None:
        anchor = self.model.anchor_index()
        if scope == "AllLeaves":
            return None
        if anchor is None:
            return F.lit(False)
        return {"FutureLeaves": F.col("_t") > anchor, "PastLeaves": F.col("_t") < anchor, "CurrentLeaf": F.col("_t") == anchor}[scope]

    def needs_grid(self, wanted: Iterable[str]) -> bool:
        trees = [formula.parse(r.body) for r in self.model.rules if r.target in self.order_of_rules(wanted)]
        return any(isinstance(n, formula.Call) and n.name in formula.CROSS | {"predict"} for t in trees for n in formula.walk(t))

    def evaluate(self, wanted: Iterable[str] | None = None, frame: DataFrame | None = None, overrides: Mapping[str, Column] | None = None, dense: str | None = None) -> DataFrame:
        """The leaf frame with the wanted measures' rules evaluated, in order of what they read.

        overrides: columns that stand in for a measure where they are not null, a derived one's rule included.
        """
        wanted = list(wanted) if wanted is not None else [m.name for m in self.model.measures]
        if frame is None:
            frame = self.leaf(dense or ("time" if self.needs_grid(wanted) else "none"))
        overrides = dict(overrides or {})
        for name, column in overrides.items():
            if name in frame.columns:
                frame = frame.withColumn(name, F.coalesce(column, F.col(name)))
        rules = {r.target: r for r in self.model.rules}
        for name in self.order_of_rules(wanted):
            rule = rules[name]
            frame = Compiler(frame, self.scope).assign(name, formula.parse(rule.body), self.rule_filter(rule.scope))
            if name in overrides:
                frame = frame.withColumn(name, F.coalesce(overrides[name], F.col(name)))
        return frame

    # consolidation
    def closure(self, dim: str, keep: Iterable[str] | None = None) -> DataFrame:
        """(ancestor, leaf, weight) of a dimension's default hierarchy; elements outside of it stand for themselves."""
        d = self.model.dimension(dim)
        rows = d.hierarchy.closure() if d.hierarchy else [(e, e, 1.0) for e in d.elements]
        if d.hierarchy:
            inside = {r[1] for r in rows} | {r[0] for r in rows}
            rows += [(e, e, 1.0) for e in d.elements if e not in inside]
        if keep is not None:
            keep = set(keep)
            rows = [r for r in rows if r[0] in keep]
        return self.spark.createDataFrame(rows, "ancestor string, leaf string, weight double")

    def aggregate(self, m: Measure, weight: Column) -> Column:
        """How leaves consolidate: weighted sum, weighted average, minimum or maximum; nulls are left out."""
        v = F.col(f"`{m.name}`")
        if m.aggregation == "WeightedAverage":
            w = F.col(f"`{m.weight}`")
            both = v.isNotNull() & w.isNotNull()
            top, bottom = F.sum(F.when(both, v * w * weight)), F.sum(F.when(both, w * weight))
            return finite(F.when(F.abs(bottom) >= 1e-300, F.try_divide(top, bottom)))
        if m.aggregation in ("Min", "Max"):
            return (F.min if m.aggregation == "Min" else F.max)(F.when(weight.isNotNull(), v))
        return finite(F.sum(finite(v * weight)))

    def consolidate(self, levels: Mapping[str, Iterable[str] | None], measures: Iterable[str], frame: DataFrame | None = None, by: Iterable[str] | None = None) -> DataFrame:
        """Measures at the elements named for each dimension (None: all levels), the other axes as they are, or only those in `by`.

        Leaves are evaluated first; one closure for each dimension is broadcast (a row for each pair of an element and a
        leaf below it: metadata, whatever the facts' size) and one aggregation follows, whose partial step folds leaves
        before anything is shuffled.
        """
        measures = list(measures)
        chosen = [self.model.measure(m) for m in measures]
        needed = measures + [m.weight for m in chosen if m.weight]
        rows = frame if frame is not None else self.evaluate(needed)
        weight = F.lit(1.0)
        for d, keep in levels.items():
            table = F.broadcast(self.closure(d, keep).select(F.col("leaf").alias(d), F.col("ancestor").alias(f"_a_{d}"), F.col("weight").alias(f"_w_{d}")))
            rows = rows.join(table, d)
            weight = weight * F.col(f"_w_{d}")
        rest = [a for a in (self.axes if by is None else by) if a not in levels]
        keys = [F.col(f"_a_{d}").alias(d) for d in levels] + [F.col(a) for a in rest]
        return rows.groupBy(*keys).agg(*[self.aggregate(m, weight).alias(m.name) for m in chosen])

    # reads
    def read(self, coordinate: Mapping[str, str]) -> DataFrame:
        """One cell: an input or derived leaf, or a consolidated element. One row, whose value is null if there is nothing."""
        return self.reads({"value": coordinate})

    def reads(self, cells: Mapping[str, Mapping[str, str]]) -> DataFrame:
        """Several cells as columns of one row: leaves are evaluated once and folded in one aggregation, without joins.

        A leaf's weight in a cell is the product of its weights below the cell's elements, from literal maps; leaves
        elsewhere have none.
        """
        chosen = {name: self.model.measure(at["Measure"]) for name, at in cells.items()}
        rows = self.evaluate(sorted({x for m in chosen.values() for x in (m.name, m.weight) if x}))
        made, reached = [], F.lit(False)
        for name, at in cells.items():
            weight = F.lit(1.0)
            for d, e in at.items():
                if d in self.axes:
                    weight = weight * self._weight(d, e)
            made.append(self.aggregate(chosen[name], weight).alias(name))
            reached = reached | weight.isNotNull()
        return rows.where(reached).agg(*made)

    def _weight(self, dim: str, element: str) -> Column:
        """A leaf's weight below an element, null elsewhere."""
        d = self.model.dimension(dim)
        if element not in d.elements:
            raise ModelError("MC2002", f"{dim} has no element {element}")
        below: dict[str, float] = {}
        for leaf, w in d.hierarchy.descendants(element) if d.hierarchy else [(element, 1.0)]:
            below[leaf] = below.get(leaf, 0.0) + w
        if set(below.values()) == {1.0}:
            return F.when(F.col(dim).isin(list(below)), 1.0)
        return F.try_element_at(F.create_map(*[x for leaf, w in below.items() for x in (F.lit(leaf), F.lit(float(w)))]), F.col(dim))

    def at(self, anchor: str) -> Cube:
        """The same cube with another element of time as its anchor."""
        if self.model.time is None or anchor not in self.model.time.elements:
            raise ModelError("MC2002", f"time has no element {anchor}")
        model = copy(self.model)
        model.anchor = anchor
        return Cube(model, self.facts)

    def bind(self, dim: str, how) -> list[str]:
        """Elements of a slice's binding: a name, a list, ('subtree', name), 'all' (leaves) or 'all_consolidated'."""
        d = self.model.dimension(dim)
        if how == "all":
            return d.leaves()
        if how == "all_consolidated":
            return [e for e in d.elements if d.hierarchy and e in d.hierarchy.children]
        if isinstance(how, tuple) and how[0] == "subtree":
            below, todo = [how[1]], [how[1]]
            while todo:
                for c, _ in (d.hierarchy.children.get(todo.pop(0), []) if d.hierarchy else []):
                    below.append(c)
                    todo.append(c)
            return [e for e in d.elements if e in set(below)]
        return [how] if isinstance(how, str) else list(how)

    def slice(self, bindings: Mapping[str, object], measures: Iterable[str]) -> DataFrame:
        """A row for each coordinate of the product of the bindings, in declared order, with the measures' values."""
        picked = {d: self.bind(d, bindings.get(d, "all")) for d in self.axes}
        cells = reduce(lambda a, b: a * b, (len(v) for v in picked.values()), 1)
        if cells > SLICE_CELLS:
            raise ModelError("MC1104", f"{cells} cells are more than {SLICE_CELLS}")
        grid = self.product(picked)
        values = self.consolidate(picked, list(measures))
        return grid.join(values, self.axes, "left").orderBy(*[self.ordinal(d) for d in self.axes])


def closure_sql(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(ancestor, leaf, weight) of an edge table (parent, child, weight) that is too large for the driver, by a recursive query."""
    edges.createOrReplaceTempView("_lumenfold_edges")
    return spark.sql("""
        WITH RECURSIVE below(ancestor, node, weight) AS (
          SELECT parent, child, weight FROM _lumenfold_edges
          UNION ALL
          SELECT b.ancestor, e.child, b.weight * e.weight FROM below b JOIN _lumenfold_edges e ON e.parent = b.node)
        SELECT ancestor, node AS leaf, weight FROM below
        WHERE node NOT IN (SELECT parent FROM _lumenfold_edges)
        UNION ALL
        SELECT DISTINCT child, child, 1.0D FROM _lumenfold_edges WHERE child NOT IN (SELECT parent FROM _lumenfold_edges)
    """)


def golden_results(cube: Cube) -> list[dict]:
    """The model's golden tests: each named cell, what it should be and is, and whether that is exact or within its tolerance."""
    out = []
    for g in cube.model.goldens:
        near = g.get("expect_within_epsilon")
        expected = near["value"] if near else g.get("expect")
        value = cube.read(g["coord"]).first()["value"]
        if value is None or expected is None:
            ok = value is None and expected is None
        else:
            ok = abs(value - expected) <= (near["epsilon"] if near else 0.0)
        out.append({"name": g["name"], "expected": expected, "value": value, "passed": ok})
    return out
