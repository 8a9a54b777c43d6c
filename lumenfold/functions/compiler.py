"""Formula trees to columns over a leaf frame.

The frame has one column for each dimension, `_t` (ordinal of the time element) and one for each measure. Functions that
read other coordinates become windows; lookups become joins with reference tables. Shared operands are named first, in a
projection of their own, so that expressions stay linear in the size of the formula.
"""

from __future__ import annotations

import itertools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scalar as s
from .formula import Call, FormulaError, Name, Nothing, Num, Text

_fresh = itertools.count()


@dataclass
class Scope:
    """What a formula may refer to."""

    dims: list[str]
    time: str
    measures: set[str]
    default_scenario: str | None = None
    scenario_dim: str | None = None
    anchor: int | None = None
    periods: int = 0
    refs: object | None = None  # model.ReferenceData
    leaves: dict[str, list[str]] = field(default_factory=dict)  # leaf elements of dimensions with a hierarchy

    def along_time(self):
        return Window.partitionBy(*[d for d in self.dims if d != self.time]).orderBy("_t")

    def across(self, dim: str):
        return Window.partitionBy(*[d for d in self.dims if d != dim])


class Compiler:
    def __init__(self, frame: DataFrame, scope: Scope):
        self.frame, self.scope, self.made = frame, scope, []

    def bind(self, c: Column) -> Column:
        name = f"_x{next(_fresh)}"
        self.frame = self.frame.withColumn(name, c)
        self.made.append(name)
        return F.col(name)

    def assign(self, name: str, tree, when: Column | None = None) -> DataFrame:
        """The frame with a column for the formula's finite value; null outside of its scope."""
        column, kind = self.value(tree)
        if kind == "string":
            raise FormulaError("MC2058", f"the rule of {name} gives text")
        column = column.cast("double")
        self.frame = self.frame.withColumn(name, F.when(when, column) if when is not None else column).drop(*self.made)
        self.made = []
        return self.frame

    def number(self, tree) -> Column:
        column, kind = self.value(tree)
        return s.null() if kind == "string" else column

    def operand(self, tree) -> Column:
        """A number used more than once."""
        return self.number(tree) if isinstance(tree, (Num, Name, Nothing)) else self.bind(self.number(tree))

    def text(self, tree) -> str:
        if isinstance(tree, (Text, Name)):
            return tree.value if isinstance(tree, Text) else tree.name
        raise FormulaError("MC1009", "a name is expected here")

    def measure(self, tree) -> Column:
        """The cell read by a function over coordinates; expressions are named first."""
        return self.number(tree) if isinstance(tree, Name) else self.bind(self.number(tree))

    def value(self, tree) -> tuple[Column, str]:
        if isinstance(tree, Num):
            return F.lit(tree.value), "double"
        if isinstance(tree, Text):
            return F.lit(tree.value), "string"
        if isinstance(tree, Nothing):
            return s.null(), "double"
        if isinstance(tree, Name):
            if tree.name not in self.scope.measures:
                raise FormulaError("MC2003", f"unknown measure {tree.name}")
            return F.col(f"`{tree.name}`"), "double"
        handler = getattr(self, f"f_{tree.name}", None) if tree.name.isidentifier() else None
        if handler:
            out = handler(*tree.args)
            return out if isinstance(out, tuple) else (out, "double")
        return self.plain(tree), "double"

    def plain(self, tree: Call) -> Column:
        op, a = tree.name, tree.args
        if op in ("==", "!="):
            (x, k), (y, m) = self.value(a[0]), self.value(a[1])
            return s.compare(op, x, y, text=True) if k == m == "string" else s.null() if "string" in (k, m) else s.compare(op, x, y)
        if op in ("<", ">", "<=", ">="):
            return s.compare(op, self.number(a[0]), self.number(a[1]))
        two = {"+": s.add, "-": s.subtract, "*": s.multiply, "/": s.divide, "and": s.both, "or": s.either, "pow": s.power, "mod": s.euclid}
        if op in two:
            return two[op](self.operand(a[0]), self.operand(a[1]))
        one = {"not": s.negate, "abs": F.abs, "exp": lambda x: s.finite(F.exp(x)), "sqrt": s.square_root, "ln": s.logarithm, "log10": lambda x: s.logarithm(x, ten=True), "round": s.half_away, "floor": s.floor, "ceil": s.ceil}
        if op in one:
            return one[op](self.operand(a[0]))
        if op == "if":
            return s.choose(self.operand(a[0]), self.number(a[1]), self.number(a[2]))
        if op in ("if_null", "coalesce"):
            return F.coalesce(*[self.number(x) for x in a])
        if op in ("min", "max"):
            return (s.least if op == "min" else s.greatest)([self.number(x) for x in a])
        many = {"safe_div": s.safe_div, "clamp": s.clamp, "norm_cdf": s.norm_cdf, "norm_inv": s.norm_inv, "nbinom_cdf": s.nbinom_cdf, "nbinom_sf": s.nbinom_sf, "wilson_ci_lower": lambda p, n: s.wilson(p, n, False), "wilson_ci_upper": lambda p, n: s.wilson(p, n, True)}
        return many[op](*[self.operand(x) for x in a])

    # time
    def f_prev(self, m):
        return F.lag(self.measure(m), 1).over(self.scope.along_time())

    def f_lag(self, m, n):
        value = self.measure(m)
        if isinstance(n, Num):
            return F.lag(value, s.whole(n.value)).over(self.scope.along_time())
        # a step that varies: the series as an array, indexed by ordinal
        step = self.operand(n)
        series = self.bind(F.collect_list(F.struct(F.lit(1), value.alias("v"))).over(self.scope.along_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        at = F.col("_t") - F.when(step >= 0, F.floor(step)).otherwise(F.ceil(step)).cast("int")
        return F.when(step.isNotNull() & (at >= 0), F.get(series, at.cast("int"))["v"])

    def f_cumulative(self, m):
        return s.finite(F.sum(self.measure(m)).over(self.scope.along_time().rowsBetween(Window.unboundedPreceding, 0)))

    def f_rolling_avg(self, m, w):
        value = self.measure(m)
        if isinstance(w, Num):
            width = s.whole(w.value)
            return F.avg(value).over(self.scope.along_time().rowsBetween(-(width - 1), 0)) if width >= 1 else s.null()
        width = self.operand(w)
        past = self.bind(F.collect_list(F.struct(value.alias("v"))).over(self.scope.along_time().rowsBetween(Window.unboundedPreceding, 0)))
        size = F.least(F.floor(width).cast("int"), F.size(past))
        taken = F.filter(F.slice(past, F.size(past) - size + 1, size), lambda x: x["v"].isNotNull())
        return F.when(width >= 1, F.try_divide(F.aggregate(taken, F.lit(0.0), lambda acc, x: acc + x["v"]), F.size(taken)))

    def f_extrapolate_last_value(self, m):
        return F.last(self.measure(m), ignorenulls=True).over(self.scope.along_time().rowsBetween(Window.unboundedPreceding, -1))

    def f_period_index(self):
        return F.col("_t").cast("double")

    def f_anchor_index(self):
        return F.lit(self.scope.anchor).cast("double")

    def _anchored(self, test) -> Column:
        return s.null() if self.scope.anchor is None else test(F.col("_t"), F.lit(self.scope.anchor)).cast("double")

    def f_is_past(self):
        return self._anchored(lambda t, a: t < a)

    def f_is_current(self):
        return self._anchored(lambda t, a: t == a)

    def f_is_future(self):
        return self._anchored(lambda t, a: t > a)

    def f_periods_since_anchor(self):
        return self._anchored(lambda t, a: t - a)

    def f_periods_to_end(self):
        return (F.lit(self.scope.periods - 1) - F.col("_t")).cast("double")

    # other coordinates
    def _over(self, m, dim, make) -> Column:
        name = self.text(dim)
        if name not in self.scope.dims:
            raise FormulaError("MC1016", f"unknown dimension {name}")
        value = self.measure(m)
        if name in self.scope.leaves:  # elements outside of the hierarchy are no leaves
            value = self.bind(F.when(F.col(name).isin(self.scope.leaves[name]), value))
        return make(value).over(self.scope.across(name))

    def f_sum_over(self, m, dim):
        return s.finite(self._over(m, dim, F.sum))

    def f_avg_over(self, m, dim):
        return s.finite(self._over(m, dim, F.avg))

    def f_min_over(self, m, dim):
        return self._over(m, dim, F.min)

    def f_max_over(self, m, dim):
        return self._over(m, dim, F.max)

    def f_std_over(self, m, dim):
        return s.finite(self._over(m, dim, F.stddev_samp))

    def f_var_over(self, m, dim):
        return s.finite(self._over(m, dim, F.var_samp))

    def f_count_over(self, m, dim):
        return self._over(m, dim, F.count).cast("double")

    def f_wavg_over(self, v, dim, w):
        value, weight = self.measure(v), self.measure(w)
        both = value.isNotNull() & weight.isNotNull()
        top = self.bind(self._over_column(F.when(both, value * weight), dim))
        bottom = self.bind(self._over_column(F.when(both, weight), dim))
        return s.divide(top, bottom)

    def _over_column(self, c: Column, dim) -> Column:
        name = self.text(dim)
        if name in self.scope.leaves:
            c = F.when(F.col(name).isin(self.scope.leaves[name]), c)
        return F.sum(c).over(self.scope.across(name))

    def _at_scenario(self, m, scenario: str | None) -> Column:
        dim = self.scope.scenario_dim
        if dim is None or scenario is None:
            return s.null()
        return F.max(F.when(F.col(dim) == scenario, self.measure(m))).over(self.scope.across(dim))

    def f_actual_ref(self, m, fallback=None):
        found = self._at_scenario(m, self.scope.default_scenario)
        return found if fallback is None else F.coalesce(found, self.number(fallback))

    def f_scenario_ref(self, m, name):
        return self._at_scenario(m, self.text(name))

    # reference data
    def f_param(self, name):
        return F.lit(float(self.scope.refs.parameters[self.text(name)]))

    def f_current_element(self, dim):
        return F.col(self.text(dim)), "string"

    def f_is_element(self, dim, name):
        return s.truth(F.col(self.text(dim)) == self.text(name))

    def f_lookup(self, table, *keys):
        parts = []
        for k in keys:
            column, kind = self.value(k)
            parts.append(s.key_text(column if kind == "string" else self.bind(column), kind))
        if any(p is None for p in parts):
            return s.null()
        key = parts[0] if len(parts) == 1 else F.when(F.greatest(*[p.isNull().cast("int") for p in parts]) == 0, F.concat_ws("|", *parts))
        return self._joined(self.scope.refs.lookup_frame(self.frame.sparkSession, self.text(table)), key)

    def f_benchmark(self, name, key):
        column, kind = self.value(key)
        return self._joined(self.scope.refs.benchmark_frame(self.frame.sparkSession, self.text(name)), s.key_text(column if kind == "string" else self.bind(column), kind))

    def _joined(self, table: DataFrame, key: Column) -> Column:
        """A left join with (key, value); the planner broadcasts the table if it is small enough."""
        k, v = f"_x{next(_fresh)}", f"_x{next(_fresh)}"
        self.frame = self.frame.withColumn(k, key).join(table.select(F.col("key").alias(k), F.col("value").cast("double").alias(v)), k, "left")
        self.made += [k, v]
        return F.col(v)

    def f_bucket(self, value, name):
        x = self.operand(value)
        bands = self.scope.refs.thresholds[self.text(name)]
        out = F.when(x.isNull(), s.null())
        for i, top in enumerate(bands):
            out = out.when(F.lit(True) if top is None else x <= float(top), F.lit(float(i)))
        return out

    def f_calibrate(self, value, name):
        x, map_ = self.operand(value), self.scope.refs.calibrations[self.text(name)]
        if "platt" in map_:
            a, b = map_["platt"]
            return s.finite(1.0 / (1.0 + F.exp(F.lit(float(a)) * x + float(b))))
        points = [(float(p), float(q)) for p, q in map_["points"]]
        out = F.when(x.isNull(), s.null()).when(x <= points[0][0], points[0][1])
        for (x0, y0), (x1, y1) in itertools.pairwise(points):
            out = out.when(x <= x1, y0 + (x - x0) / (x1 - x0) * (y1 - y0))
        return out.otherwise(points[-1][1])

    def f_predict(self, name, *features):
        """Adstock, saturation, standardization, linear form, link, bound."""
        model = self.scope.refs.models[self.text(name)]
        if len(features) != len(model["features"]):
            return s.null()
        total, missing = F.lit(float(model.get("intercept", 0.0))), F.lit(False)
        for spec, tree in zip(model["features"], features, strict=True):
            x = self.operand(tree)
            if stock := spec.get("adstock"):
                x = self.bind(self.adstock(x, float(stock["rate"]), int(stock["max_lookback"])))
            if bend := spec.get("saturation"):
                x = self.bind(saturate(x, bend))
            if spec.get("std", 0) > 0:
                x = (x - float(spec.get("mean", 0.0))) / float(spec["std"])
            missing = missing | x.isNull()
            total = total + float(spec["coef"]) * x
        out = self.bind(total)
        link = model.get("link", "identity")
        out = 1.0 / (1.0 + F.exp(-out)) if link == "logit" else F.exp(out) if link == "log" else out
        low, high = model.get("bound", (None, None))
        if low is not None:
            out = F.greatest(out, F.lit(float(low)))
        if high is not None:
            out = F.least(out, F.lit(float(high)))
        return F.when(~missing, out)

    def adstock(self, x: Column, rate: float, lookback: int) -> Column:
        """Sum of rate^k times the value k periods back; a missing prior period counts as 0, a missing current one gives null."""
        w = self.scope.along_time()
        terms = [x] + [rate**k * F.coalesce(F.lag(x, k).over(w), F.lit(0.0)) for k in range(1, lookback + 1)]
        return sum(terms[1:], terms[0])


def saturate(x: Column, bend: dict) -> Column:
    """Hill or logarithmic response; negative inputs count as 0."""
    x = F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))
    if bend["kind"] == "hill":
        half, slope = float(bend["half"]), float(bend["slope"])
        up = F.pow(x, slope)
        return up / (up + half**slope)
    return F.log1p(x / float(bend.get("scale", 1.0)))
