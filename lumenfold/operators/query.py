"""The query verb: filters in both grammars, projections, aggregates, groups, paging, differences, permissions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import formula
from lumenfold.functions.compiler import Compiler, Scope
from lumenfold.functions.scalar import NEAR
from lumenfold.model.schema import ModelError

from .cube import Cube

_TOKEN = re.compile(r"\s*(?:(?P<str>\"[^\"]*\"|'[^']*')|(?P<num>-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<name>[A-Za-z_](?:\w|-(?=\w))*)|(?P<op>>=|<=|==|!=|=|[<>()!]))")
#: What the predicate form does not evaluate.
_MUTE = frozenset("exp norm_cdf norm_inv nbinom_cdf nbinom_sf wilson_ci_lower wilson_ci_upper".split())


class Filter:
    """The simple grammar: and, or, not, parentheses and comparisons of measures, dimensions and literals.

    Null equals null, differs from everything else and is in no order; numbers are equal within 1e-9, also for >= and <=;
    text is never in order, and never compares with numbers. Names may hold hyphens; one that is no measure and no
    dimension is null.
    """

    def __init__(self, text: str, measures: set[str], dims: set[str]):
        self.tokens, at = [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ModelError("MC1101", f"unexpected {text[at:][:8]!r} in the filter")
            kind, value = m.lastgroup, m[m.lastgroup]
            if kind == "name" and value in ("AND", "OR", "NOT") or value == "!":
                value = "not" if value == "!" else value.lower()
            self.tokens.append((kind, value))
            at = m.end()
        self.i, self.measures, self.dims = 0, measures, dims

    def column(self) -> Column:
        out = self._any()
        if self.i < len(self.tokens):
            raise ModelError("MC1101", f"unexpected {self.tokens[self.i][1]!r} in the filter")
        return out

    def _is(self, *values: str) -> bool:
        return self.i < len(self.tokens) and self.tokens[self.i][1] in values and self.tokens[self.i][0] != "str"

    def _take(self, *values: str) -> bool:
        found = self._is(*values)
        self.i += found
        return found

    def _any(self) -> Column:
        out = self._all()
        while self._take("or"):
            out = out | self._all()
        return out

    def _all(self) -> Column:
        out = self._not()
        while self._take("and"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self._take("not"):
            return ~self._not()
        if self._take("("):
            out = self._any()
            if not self._take(")"):
                raise ModelError("MC1101", "a parenthesis is left open")
            return out
        return self._compare()

    def _atom(self) -> tuple[Column, str]:
        if self.i >= len(self.tokens):
            raise ModelError("MC1101", "the filter ends early")
        kind, value = self.tokens[self.i]
        self.i += 1
        if kind == "num":
            return F.lit(float(value)), "number"
        if kind == "str":
            return F.lit(value[1:-1]), "text"
        if value in self.measures:
            return F.col(value), "number"
        if value in self.dims:
            return F.col(value), "text"
        if kind == "name" and value not in ("and", "or", "not"):
            return F.lit(None).cast("string"), "none"
        raise ModelError("MC1101", f"unexpected {value!r} in the filter")

    def _compare(self) -> Column:
        a, k = self._atom()
        if not self._is(">=", "<=", "==", "!=", "=", ">", "<"):
            raise ModelError("MC1101", "a comparison is expected")
        op = self.tokens[self.i][1]
        self.i += 1
        b, m = self._atom()
        none, either = a.isNull() & b.isNull(), a.isNull() | b.isNull()
        if k != m or k == "none":
            return F.coalesce(F.when(either, none if op in ("==", "=") else ~none if op == "!=" else F.lit(False)).otherwise(F.lit(False)), F.lit(False))
        if k == "text":
            test = {"==": a == b, "=": a == b, "!=": a != b}.get(op, F.lit(False))
        else:
            near = F.abs(a - b) < NEAR
            test = {"==": near, "=": near, "!=": ~near, ">": a > b, "<": a < b, ">=": (a >= b) | near, "<=": (a <= b) | near}[op]
        return F.when(either, none if op in ("==", "=") else ~none if op == "!=" else F.lit(False)).otherwise(test)


class _Predicate(Compiler):
    """The formula grammar as a predicate: plus and minus poison on null, unlike in rules."""

    def plain(self, tree: formula.Call) -> Column:
        if tree.name in _MUTE:
            return F.lit(None).cast("double")
        if tree.name in ("+", "-"):
            a, b = self.number(tree.args[0]), self.number(tree.args[1])
            return a + b if tree.name == "+" else a - b
        return super().plain(tree)


def predicate(cube: Cube, frame: DataFrame, text: str) -> tuple[DataFrame, Column, list[str]]:
    """(frame, test, columns added to the frame for it). Text with a call in it is tried as a formula first, which is true at 1e-9 or more from 0."""
    if re.search(r"[A-Za-z_]\w*\s*\(", text) and not re.match(r"^\s*(and|or|not)\b", text):
        try:
            tree = formula.parse(text)
        except formula.FormulaError:
            tree = None
        if tree is not None:
            bad = next((n.name for n in formula.walk(tree) if isinstance(n, formula.Call) and n.name in formula.CROSS | {"predict"}), None)
            if bad:
                raise ModelError("MC1025", f"{bad} reads other coordinates, which a filter can't")
            compiler = _Predicate(frame, cube.scope)
            test = compiler.number(tree)
            return compiler.frame, F.coalesce(F.abs(test) >= NEAR, F.lit(False)), list(compiler.made)
    return frame, F.coalesce(Filter(text, cube.scope.measures, set(cube.axes)).column(), F.lit(False)), []


def where(cube: Cube, frame: DataFrame, text: str) -> DataFrame:
    """Rows that match."""
    frame, test, made = predicate(cube, frame, text)
    return frame.where(test).drop(*made)


def needed(cube: Cube, text: str | None, measures: Iterable[str]) -> list[str]:
    inside = [m for m in cube.scope.measures if text and re.search(rf"\b{re.escape(m)}\b", text)]
    return sorted({*inside, *measures})


def select(cube: Cube, show: Iterable[str] | None = None, filter_: str | None = None, limit: int | None = 10_000, offset: int = 0, dense: str = "all") -> DataFrame:
    """Leaf coordinates that match, in declared order, with the shown measures (all by default); one page of them, or all (limit None)."""
    show = list(show) if show is not None else [m.name for m in cube.model.measures]
    rows = cube.evaluate(needed(cube, filter_, [s for s in show if s not in cube.axes]), dense=dense)
    if filter_:
        rows = where(cube, rows, filter_)
    rows = rows.orderBy(*[cube.ordinal(a) for a in cube.axes])
    rows = rows.offset(offset) if offset else rows
    return (rows if limit is None else rows.limit(limit)).select(*cube.axes, *[s for s in show if s not in cube.axes])


_AGGREGATE = re.compile(r"^\s*(mean|avg|sum|min|max|count)\s*\((.*)\)\s*$", re.S)


def _folded(cube: Cube, rows: DataFrame, call: str, test: Column | None) -> tuple[DataFrame, Column]:
    """The frame and the value of an aggregate over its rows that pass the test; 0.0 where nothing is left."""
    kind, inner = _AGGREGATE.match(call)[1], _AGGREGATE.match(call)[2].strip()
    if inner in cube.scope.measures:
        column = F.col(inner)
    elif kind == "count":
        rows, inside, _ = predicate(cube, rows, inner)
        column = F.when(inside, 1)
    else:
        raise ModelError("MC1102", f"unknown measure {inner}")
    fold = {"mean": F.avg, "avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count}[kind]
    return rows, F.coalesce(fold(column if test is None else F.when(test, column)).cast("double"), F.lit(0.0))


def _known(call: str) -> str:
    if not _AGGREGATE.match(call):
        raise ModelError("MC1103", f"unknown aggregate {call}")
    return call


def aggregate(cube: Cube, call: str, filter_: str | None = None, group_by: Iterable[str] = (), limit: int | None = 10_000, offset: int = 0, dense: str = "none") -> DataFrame:
    """mean, sum, min, max or count of a measure, or count of a predicate, over matching leaves; 0.0 where nothing is left. Groups come in the order of their names."""
    rows = cube.evaluate(needed(cube, f"{filter_ or ''} {_known(call)}", []), dense=dense)
    if filter_:
        rows = where(cube, rows, filter_)
    rows, value = _folded(cube, rows, call, None)
    group_by = list(group_by)
    out = rows.groupBy(*group_by).agg(value.alias("value"))
    if not group_by:
        return out
    out = out.orderBy(*group_by)
    out = out.offset(offset) if offset else out
    return out if limit is None else out.limit(limit)


def aggregates(cube: Cube, calls: Mapping[str, tuple[str, str | None]], group_by: Iterable[str] = (), dense: str = "none") -> DataFrame:
    """Several aggregates, each (call, filter), as columns of one row or group: the cube is evaluated and read once."""
    rows = cube.evaluate(needed(cube, " ".join(f"{f or ''} {_known(c)}" for c, f in calls.values()), []), dense=dense)
    made = []
    for name, (call, filter_) in calls.items():
        test = None
        if filter_:
            rows, test, _ = predicate(cube, rows, filter_)
        rows, value = _folded(cube, rows, call, test)
        made.append(value.alias(name))
    return rows.groupBy(*group_by).agg(*made)


def diff(cube: Cube, dim: str, left: str, right: str, measure: str, limit: int | None = None, repeat: bool = False) -> DataFrame:
    """Cells of a measure that differ between two elements, by size of the difference. repeat: once for each element of the dimension, as enumerating every leaf gives it."""
    rows = cube.evaluate([measure]).where(F.col(dim).isin(left, right))
    rest = [a for a in cube.axes if a != dim]
    side = lambda e: F.max(F.when(F.col(dim) == e, F.col(measure)))
    # one cell for each coordinate and element, so the two values meet in a group
    out = rows.groupBy(*rest).agg(side(left).alias("left_value"), side(right).alias("right_value")).withColumn("delta", F.col("right_value") - F.col("left_value")).where(F.abs("delta") > NEAR)
    if repeat:
        out = out.withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(len(cube.model.dimension(dim).leaves()))))).drop("_n")
    out = out.orderBy(F.abs("delta").desc(), *rest)
    return out if limit is None else out.limit(limit)


def permitted(cube: Cube, frame: DataFrame, grants: Iterable[Mapping], principal: str, capability: str = "READ") -> DataFrame:
    """Rows that some grant of the principal covers. A grant's scope names for a dimension one element, several, or a subtree; root passes."""
    if principal == "root":
        return frame
    test = F.lit(False)
    for g in grants:
        if g["principal"] != principal or capability not in g["capabilities"]:
            continue
        one = F.lit(True)
        for d, how in g.get("scope", {}).items():
            names = cube.bind(d, how)
            one = one & F.col(d).isin(names)
        test = test | one
    return frame.where(test)


def page(rows: DataFrame, limit: int, offset: int) -> dict:
    """A stable envelope of one page."""
    got = [r.asDict() for r in rows.offset(offset).limit(limit + 1).collect()]
    more = len(got) > limit
    return {"rows": got[:limit], "limit": limit, "offset": offset, "truncated": more, "next_offset": offset + limit if more else None}


def simple_scope(dims: list[str], measures: Iterable[str], refs=None) -> Scope:
    """A scope for formulas over any frame."""
    return Scope(dims, "", set(measures), refs=refs)
