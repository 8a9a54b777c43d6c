"""Records of a replay: their filter language, the source of their odds, their outcomes; the guard of holdout filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.scalar import NEAR
from lumenfold.model.schema import ModelError

from .query import Filter

_TOKEN = re.compile(r"""\s*(?:(?P<str>"[^"]*"|'[^']*')|(?P<op>>=|<=|==|!=|[<>=])|(?P<par>[()])|(?P<word>[\w.\-:]+))""")
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def _number_text(n: float) -> str:
    return str(int(n)) if n == int(n) and abs(n) < 1e15 else repr(n)


class RecordFilter:
    """and, or, not (in any case), parentheses, and comparisons of a column with a number, a quoted text or a bare word.

    A numeric column meets a text as the number that it spells, or not at all; a text column meets a number as its
    digits, and texts are in order. Numbers are equal within 1e-9. A comparison with a null, or with a column that isn't
    there, is false, and `not` makes it true.
    """

    def __init__(self, text: str, frame: DataFrame):
        self.types, self.tokens, at = {f.name: f.dataType for f in frame.schema.fields}, [], 0
        while at < len(text.rstrip()):
            m = _TOKEN.match(text, at)
            if not m:
                raise ModelError("MC6202", f"unexpected {text[at:].strip()[:8]!r} in the filter")
            kind, value = m.lastgroup, m[m.lastgroup]
            if kind == "word" and value.lower() in ("and", "or", "not"):
                kind, value = "logic", value.lower()
            self.tokens.append((kind, value))
            at = m.end()
        if not self.tokens:
            raise ModelError("MC6202", "the filter is empty")
        self.i = 0

    def column(self) -> Column:
        out = self._any()
        if self.i < len(self.tokens):
            raise ModelError("MC6202", f"unexpected {self.tokens[self.i][1]!r} in the filter")
        return out

    def _take(self, *token: str) -> bool:
        found = self.i < len(self.tokens) and self.tokens[self.i] == token
        self.i += found
        return found

    def _any(self) -> Column:
        out = self._all()
        while self._take("logic", "or"):
            out = out | self._all()
        return out

    def _all(self) -> Column:
        out = self._not()
        while self._take("logic", "and"):
            out = out & self._not()
        return out

    def _not(self) -> Column:
        if self._take("logic", "not"):
            return ~self._not()
        if self._take("par", "("):
            out = self._any()
            if not self._take("par", ")"):
                raise ModelError("MC6202", "a parenthesis is left open")
            return out
        return self._compare()

    def _compare(self) -> Column:
        kinds = [k for k, _ in self.tokens[self.i : self.i + 3]]
        if len(kinds) < 3 or kinds[0] != "word" or kinds[1] != "op" or kinds[2] not in ("word", "str"):
            raise ModelError("MC6202", "a column, an operator and a value are expected")
        (_, name), (_, op), (kind, value) = self.tokens[self.i : self.i + 3]
        self.i += 3
        if _NUMBER.fullmatch(name):
            raise ModelError("MC6202", f"{name} is no column's name")
        if name not in self.types:
            return F.lit(False)
        value = value[1:-1] if kind == "str" else value
        number = float(value) if _NUMBER.fullmatch(value.strip()) else None
        c, numeric = F.col(f"`{name}`"), isinstance(self.types[name], T.NumericType)
        if numeric:
            if number is None:
                return F.lit(False)
            a, b = c.cast("double"), F.lit(number)
            test = {"==": F.abs(a - b) < NEAR, "!=": F.abs(a - b) >= NEAR}.get(op if op != "=" else "==")
        else:
            a, b, test = c.cast("string"), F.lit(_number_text(number) if kind == "word" and number is not None else value), None
        if test is None:
            test = {"==": a == b, "=": a == b, "!=": a != b, ">": a > b, "<": a < b, ">=": a >= b, "<=": a <= b}[op]
        return F.coalesce(test, F.lit(False))


def filtered(records: DataFrame, text: str) -> DataFrame:
    return records.where(RecordFilter(text, records).column())


def guarded_holdout(text: str, measures: set[str], dims: set[str]) -> Filter:
    """A holdout filter, refused where a measure is held equal or unequal to a number: ranges are asked for. Nothing is read."""
    f = Filter(text, measures, dims)
    for (a, name), (_, op), (b, _) in zip(f.tokens, f.tokens[1:], f.tokens[2:], strict=False):
        if a == "name" and name not in dims and op in ("==", "=", "!=") and b == "num":
            raise ModelError("MC6013", f"{name} is a measure: give a range instead of {op} and a number")
    return f


def with_odds(records: DataFrame, source: str = "record", column: str = "odds") -> DataFrame:
    """The records' own odds, fixed:<odds> for all, or column:<name>. Odds of 1 or less, or none, make a replay skip the record."""
    kind, _, rest = source.strip().partition(":")
    rest = rest.strip()
    if kind == "record" and not rest:
        return records
    if kind == "fixed":
        if not _NUMBER.fullmatch(rest) or float(rest) <= 1.0:
            raise ModelError("MC6203", f"fixed odds are a number above 1, not {rest!r}")
        return records.withColumn(column, F.lit(float(rest)))
    if kind == "column" and rest:
        if rest not in records.columns:
            raise ModelError("MC6203", f"records have no column {rest}")
        return records.withColumn(column, F.col(f"`{rest}`").try_cast("double"))
    raise ModelError("MC6203", f"odds are record, fixed:<odds> or column:<name>, not {source!r}")


def outcome_of(c: Column, mode: str = "canonical", actual: Column | None = None, line: Column | None = None) -> Column:
    """win, loss, push or void; null where it can't be told.

    canonical knows words alone; legacy-binary takes 1 and 0 as win and loss besides; derived-pushes does so too, and
    where both are there and equal within 1e-9, the actual result and the line make a push.
    """
    t = F.lower(F.trim(c.cast("string")))
    words = F.when(t.isin("win", "won", "w"), "win").when(t.isin("loss", "lose", "lost", "l"), "loss").when(t.isin("push", "tie", "p"), "push").when(t.isin("void", "v", "no_action", "postponed"), "void")
    if mode == "canonical":
        return words
    if mode not in ("legacy-binary", "derived-pushes"):
        raise ModelError("MC6204", f"unknown outcome mode {mode}")
    n = t.try_cast("double")
    binary = words.when(F.abs(n - 1) < NEAR, "win").when(F.abs(n) < NEAR, "loss")
    if mode == "legacy-binary" or actual is None or line is None:
        return binary
    return F.when(F.abs(actual.try_cast("double") - line.try_cast("double")) < NEAR, "push").otherwise(binary)
