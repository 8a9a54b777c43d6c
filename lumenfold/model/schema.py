"""Dimensions, hierarchies, measures, rules and reference data of a cube."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


class ModelError(ValueError):
    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Hierarchy:
    """A weighted forest over a dimension's elements."""

    dimension: str
    edges: list[tuple[str, str, float]]  # parent, child, weight
    name: str = "default"
    default: bool = True

    @cached_property
    def children(self) -> dict[str, list[tuple[str, float]]]:
        out: dict[str, list[tuple[str, float]]] = {}
        for parent, child, weight in self.edges:
            out.setdefault(parent, []).append((child, weight))
        return out

    def parents(self) -> dict[str, str]:
        return {child: parent for parent, child, _ in self.edges}

    def leaves(self) -> list[str]:
        return [c for _, c, _ in self.edges if c not in self.children]

    def descendants(self, element: str) -> list[tuple[str, float]]:
        """(leaf, product of weights) below an element; a leaf is its own."""
        if element not in self.children:
            return [(element, 1.0)]
        return [(leaf, weight * w) for child, weight in self.children[element] for leaf, w in self.descendants(child)]

    def closure(self) -> list[tuple[str, str, float]]:
        """(ancestor or itself, leaf, weight product) over the whole forest."""
        members = {*self.children, *(c for _, c, _ in self.edges)}
        return [(e, leaf, w) for e in sorted(members) for leaf, w in self.descendants(e)]


@dataclass
class Dimension:
    """Elements in the order declared, which is the order of time."""

    name: str
    elements: list[str]
    kind: str = "Standard"
    hierarchies: list[Hierarchy] = field(default_factory=list)
    scenario_meta: dict[str, str] = field(default_factory=dict)
    version_state: dict[str, str] = field(default_factory=dict)
    time_meta: dict[str, dict] = field(default_factory=dict)
    granularity: str | None = None

    @property
    def hierarchy(self) -> Hierarchy | None:
        return next((h for h in self.hierarchies if h.default), self.hierarchies[0] if self.hierarchies else None)

    def leaves(self) -> list[str]:
        """Those of the default hierarchy, or all elements where there is none."""
        return self.hierarchy.leaves() if self.hierarchy else list(self.elements)

    def frame(self, spark: SparkSession) -> DataFrame:
        leaf = set(self.leaves())
        return spark.createDataFrame([(e, i, e in leaf) for i, e in enumerate(self.elements)], "element string, ord int, is_leaf boolean")


@dataclass
class Measure:
    name: str
    role: str = "Input"  # Input, Derived, Indicator
    aggregation: str = "Sum"  # Sum, WeightedAverage, Min, Max
    weight: str | None = None
    data_type: str = "F64"
    indicator: tuple[str, str] | None = None


@dataclass
class Rule:
    target: str
    body: str
    scope: str = "AllLeaves"  # AllLeaves, FutureLeaves, PastLeaves, CurrentLeaf
    name: str = ""


@dataclass
class ReferenceData:
    lookups: dict[str, dict[str, float]] = field(default_factory=dict)
    benchmarks: dict[str, dict[str, float]] = field(default_factory=dict)
    thresholds: dict[str, list[float | None]] = field(default_factory=dict)
    parameters: dict[str, float] = field(default_factory=dict)
    models: dict[str, dict] = field(default_factory=dict)
    calibrations: dict[str, dict] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)  # large tables as (key, value)

    def _table(self, spark: SparkSession, known: dict, name: str) -> DataFrame:
        if name in self.frames:
            return self.frames[name]
        return spark.createDataFrame(sorted((k, float(v)) for k, v in known[name].items()) or [], "key string, value double")

    def lookup_frame(self, spark: SparkSession, name: str) -> DataFrame:
        return self._table(spark, self.lookups, name)

    def benchmark_frame(self, spark: SparkSession, name: str) -> DataFrame:
        return self._table(spark, self.benchmarks, name)


@dataclass
class Model:
    name: str
    dimensions: list[Dimension]
    measures: list[Measure]
    rules: list[Rule] = field(default_factory=list)
    refs: ReferenceData = field(default_factory=ReferenceData)
    anchor: str | None = None
    goldens: list[dict] = field(default_factory=list)
    inputs: dict | None = None

    def dimension(self, name: str) -> Dimension:
        found = next((d for d in self.dimensions if d.name == name), None)
        if found is None:
            raise ModelError("MC2001", f"unknown dimension {name}")
        return found

    def measure(self, name: str) -> Measure:
        found = next((m for m in self.measures if m.name == name), None)
        if found is None:
            raise ModelError("MC2003", f"unknown measure {name}")
        return found

    @property
    def axes(self) -> list[Dimension]:
        """All dimensions but that of the measures."""
        return [d for d in self.dimensions if d.kind != "Measure"]

    @property
    def time(self) -> Dimension | None:
        """The one named Time, else the first standard one."""
        return next((d for d in self.axes if d.name == "Time"), next((d for d in self.axes if d.kind in ("Standard", "Time")), None))

    @property
    def scenario(self) -> Dimension | None:
        return next((d for d in self.axes if d.kind == "Scenario"), None)

    def default_scenario(self) -> str | None:
        dim = self.scenario
        return next((e for e in dim.elements if dim.scenario_meta.get(e) == "Default"), None) if dim else None

    def anchor_index(self) -> int | None:
        return self.time.elements.index(self.anchor) if self.anchor is not None and self.time else None
