"""The expression language of report texts: parsed to typed columns, with benchmark lookups and ordered bindings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.model.schema import ModelError

NEAR, TINY = 1e-9, 1e-15
#: What a benchmark library's row holds besides its metric and scope.
STATISTICS = ("p10", "p25", "p50", "p75", "p90", "mean", "stddev", "sample_count")


@dataclass(frozen=True)
class Typed:
    """A column with its kind: number, bool, text, or none for a value that is always missing."""

    kind: str
    column: Column

    @property
    def number(self) -> Column:
        if self.kind == "number":
            return self.column
        return self.column.cast("double") if self.kind == "bool" else F.lit(None).cast("double")

    @property
    def truth(self) -> Column:
        test = {"number": lambda c: c != 0.0, "bool": lambda c: c, "text": lambda c: F.length(c) > 0}.get(self.kind)
        return F.coalesce(test(self.column), F.lit(False)) if test else F.lit(False)


def _none() -> Typed:
    return Typed("none", F.lit(None).cast("double"))


def _number(c: Column) -> Typed:
    return Typed("number", c)


def _bool(c: Column) -> Typed:
    return Typed("bool", F.coalesce(c, F.lit(False)))


def split_top(text: str, separator: str) -> list[int]:
    """Where a separator stands outside of parentheses and quotes."""
    found, depth, quote, i = [], 0, "", 0
    while i < len(text):
        c = text[i]
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        elif depth == 0 and text.startswith(separator, i):
            found.append(i)
            i += len(separator)
            continue
        i += 1
    return found


def arguments(text: str) -> list[str]:
    cuts = [-1, *split_top(text, ","), len(text)]
    return [text[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False)]


def percentile_rank(value: Column, p: Mapping[int, Column]) -> Column:
    """The first breakpoint of p10 to p90 that a value doesn't exceed, 100 beyond all."""
    rank = F.when(value <= p[10], 10.0)
    for n in (25, 50, 75, 90):
        rank = rank.when(value <= p[n], float(n))
    return F.when(value.isNotNull(), rank.otherwise(100.0))


class Report:
    """Compiles expressions over named columns.

    NOT takes in all that follows; AND is split before OR, each at its first place, so a OR b AND c is (a OR b) AND c.
    A comparison with anything but numbers (true and false are 1 and 0) is false; numbers are equal within 1e-9. `/` by
    less than 1e-15 is 0, ratio() and pct_change() are then null. Names without a column are null. Benchmarks are
    columns that benchmark_columns() has added; without one they give 0.
    """

    def __init__(self, columns: Mapping[str, Typed], benchmarks: Iterable[str] = ()):
        self.columns, self.benchmarks = dict(columns), set(benchmarks)

    def __call__(self, text: str) -> Typed:
        e = text.replace("\n", " ").strip()
        if not e:
            return _none()
        if e in ("true", "false"):
            return _bool(F.lit(e == "true"))
        if e[:4] in ("NOT ", "not "):
            return _bool(~self(e[4:]).truth)
        for word, both in ((" AND ", lambda a, b: a & b), (" OR ", lambda a, b: a | b)):
            if at := split_top(e, word):
                return _bool(both(self(e[: at[0]]).truth, self(e[at[0] + len(word) :]).truth))
        for op in (">=", "<=", "!=", "==", ">", "<"):
            if at := split_top(e, op):
                return self._compare(op, self(e[: at[0]]).number, self(e[at[0] + len(op) :]).number)
        cuts = sorted(i for op in "+-" for i in split_top(e, op) if i > 0 and e[i - 1] not in "*/(" and not re.match(r".*\d[eE]$", e[:i]))
        if cuts:
            a, b = self(e[: cuts[-1]]).number, self(e[cuts[-1] + 1 :]).number
            return _number(a + b if e[cuts[-1]] == "+" else a - b)
        if cuts := sorted(i for op in "*/" for i in split_top(e, op)):
            a, b = self(e[: cuts[-1]]).number, self(e[cuts[-1] + 1 :]).number
            return _number(a * b if e[cuts[-1]] == "*" else F.when(F.abs(b) < TINY, F.when(a.isNotNull(), 0.0)).otherwise(F.try_divide(a, b)))
        return self._atom(e)

    def _compare(self, op: str, a: Column, b: Column) -> Typed:
        near = F.abs(a - b)
        return _bool({">=": a >= b, "<=": a <= b, ">": a > b, "<": a < b, "==": near < NEAR, "!=": near > NEAR}[op])

    def _atom(self, e: str) -> Typed:
        if e[0] == "(" and e[-1] == ")":
            return self(e[1:-1])
        if e[0] == e[-1] == "'" and len(e) > 1:
            return Typed("text", F.lit(e[1:-1]))
        if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", e):
            return _number(F.lit(float(e)))
        m = re.fullmatch(r"(\w+)\s*\((.*)\)", e, re.S)
        if not m:
            return self.columns.get(e, _none())
        name, args = m[1], arguments(m[2])
        if name.startswith("benchmark_"):
            return self._benchmark(name.removeprefix("benchmark_"), args)
        made = getattr(self, f"_f_{name}", None)
        if made is None:
            raise ModelError("MC7002", f"unknown function {name}")
        return made(*args) if made.__code__.co_argcount - 1 == len(args) or made.__code__.co_flags & 4 else _none()

    # functions
    def _f_abs(self, x: str) -> Typed:
        return _number(F.abs(self(x).number))

    def _f_not(self, x: str) -> Typed:
        return _bool(~self(x).truth)

    def _f_if(self, test: str, then: str, other: str) -> Typed:
        kind, (a, b) = self._alike([self(then), self(other)])
        return Typed(kind, F.when(self(test).truth, a).otherwise(b))

    def _f_coalesce(self, *parts: str) -> Typed:
        kind, columns = self._alike([self(p) for p in parts])
        return Typed(kind, F.coalesce(*columns))

    def _f_round(self, x: str, digits: str) -> Typed:
        v, factor = self(x).number, F.pow(F.lit(10.0), self(digits).number.cast("int").cast("double"))
        return _number(F.signum(v) * F.floor(F.abs(v * factor) + 0.5) / factor)

    def _f_ratio(self, a: str, b: str) -> Typed:
        top, bottom = self(a).number, self(b).number
        return _number(F.try_divide(top, F.when(F.abs(bottom) >= TINY, bottom)))

    def _f_pct_change(self, now: str, before: str) -> Typed:
        a, b = self(now).number, self(before).number
        return _number(F.try_divide(a - b, F.when(F.abs(b) >= TINY, b)) * 100.0)

    def _f_plural(self, n: str, one: str, many: str) -> Typed:
        kind, (a, b) = self._alike([self(one), self(many)])
        count = self(n).number
        return Typed(kind, F.when(F.abs(count - 1) < NEAR, a).when(count.isNotNull(), b))

    @staticmethod
    def _alike(values: list[Typed]) -> tuple[str, list[Column]]:
        kinds = {v.kind for v in values} - {"none"}
        if kinds <= {"number", "bool"} and len(kinds) != 1:
            return "number", [v.number for v in values]
        if len(kinds) > 1:
            raise ModelError("MC7003", f"a choice between {' and '.join(sorted(kinds))}")
        kind = kinds.pop()
        return kind, [v.column if v.kind != "none" else F.lit(None).cast({"number": "double", "bool": "boolean", "text": "string"}[kind]) for v in values]

    def _benchmark(self, what: str, args: list[str]) -> Typed:
        metric = args[0].strip("'\"")
        if metric not in self.benchmarks:
            return _number(F.lit(0.0))
        b = F.col(f"`{benchmark_name(metric)}`")
        field = lambda k: b.getField(k).cast("double")
        if what in STATISTICS and len(args) == 1:
            return _number(F.coalesce(field(what), F.lit(0.0)))
        if what == "above_median" and len(args) == 1:
            now = F.coalesce(self(f"current.{metric}").number, F.lit(0.0))
            return _number(F.when(now > field("p50"), 1.0).otherwise(0.0))
        if what in ("percentile", "z_score"):
            value = F.coalesce(self(args[1]).number, F.lit(0.0)) if len(args) > 1 else None
            if value is None:
                return _number(F.lit(0.0))
            if what == "percentile":
                made = percentile_rank(value, {n: field(f"p{n}") for n in (10, 25, 50, 75, 90)})
            else:
                made = F.try_divide(value - field("mean"), F.when(F.abs(field("stddev")) >= TINY, field("stddev")))
            return _number(F.coalesce(F.when(b.isNotNull(), made), F.lit(0.0)))
        raise ModelError("MC7002", f"unknown function benchmark_{what}")

    def bound(self, bindings: Mapping[str, str]) -> Report:
        """With named expressions added, each after those that it mentions; what depends on itself finds null."""
        out = Report(self.columns, self.benchmarks)
        for name in ordered(bindings):
            out.columns[name] = out(bindings[name])
        return out


def ordered(bindings: Mapping[str, str]) -> list[str]:
    """Names in an order in which each follows those that its expression mentions, ties by name; members of cycles come last."""
    needs = {n: {m for m in bindings if m != n and re.search(rf"(?<![A-Za-z0-9_]){re.escape(m)}(?![A-Za-z0-9_])", e)} for n, e in bindings.items()}
    out: list[str] = []
    while ready := sorted(n for n in needs if n not in out and needs[n] <= set(out)):
        out += ready
    return out + sorted(set(needs) - set(out))


def benchmark_name(metric: str) -> str:
    return f"_benchmark_{metric}"


def benchmark_columns(rows: DataFrame, library: DataFrame, scope: str, metrics: Iterable[str]) -> DataFrame:
    """The rows with a struct for each metric's benchmark: that of the row's scope, else that of the empty scope, else null.

    library: (metric, scope, *STATISTICS). Its metrics are gathered to one row for a scope, so that one join by scope
    brings them all.
    """
    metrics = list(metrics)
    one = lambda m: F.max(F.when(F.col("metric") == m, F.struct(*STATISTICS))).alias(benchmark_name(m))
    wide = library.where(F.col("metric").isin(metrics)).groupBy(F.col("scope").alias("_scope")).agg(*[one(m) for m in metrics])
    general = library.where("scope = ''").agg(*[one(m).alias(f"_any_{m}") for m in metrics])
    out = rows.join(wide, rows[scope] == wide["_scope"], "left").crossJoin(F.broadcast(general))  # one row
    found = [F.coalesce(benchmark_name(m), f"_any_{m}").alias(benchmark_name(m)) for m in metrics]
    return out.select(*[rows[c] for c in rows.columns], *found)


def mentioned(texts: Iterable[str]) -> set[str]:
    """Metrics whose benchmarks the expressions look up."""
    return reduce(lambda a, t: a | {m.strip("'\"") for m in re.findall(r"benchmark_\w+\(\s*([^,)]+?)\s*[,)]", t)}, texts, set())
