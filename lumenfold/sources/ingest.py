"""Ingestion recipes: row mapping, wide and long tables to cells, missing elements, periods, watermarks."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.model.schema import Model, ModelError


def mapped(df: DataFrame, columns: Mapping[str, Mapping]) -> DataFrame:
    """name -> {from, scale, default, json_path}: renamed, scaled where the value is a number, filled."""
    out = []
    for name, spec in columns.items():
        if spec.get("skip"):
            continue
        c = F.col(spec.get("from", name)) if spec.get("from", name) in df.columns else F.lit(None).cast("string")
        if "json_path" in spec:
            c = F.get_json_object(c, spec["json_path"])
        if "scale" in spec:
            number = c.try_cast("double")
            c = F.when(number.isNotNull(), number * float(spec["scale"]))
        if "default" in spec:
            c = F.coalesce(c, F.lit(spec["default"]))
        out.append(c.alias(name))
    return df.select(*out)


def wide_cells(df: DataFrame, dims: list[str], measures: Mapping[str, str]) -> DataFrame:
    """A cell for each measure column (column -> measure). A null or invalid one marks the row as failed and stops it there:
    cells of the columns before it are kept, as `row_failed`, for the policy on errors to decide."""
    numbers = [F.col(c).try_cast("double") for c in measures]
    bad = F.array(*[n.isNull() | ~(F.abs(n) < float("inf")) for n in numbers])
    first = F.array_position(bad, F.lit(True))
    cells = F.array(*[F.struct(F.lit(m).alias("Measure"), n.alias("value"), F.lit(i + 1).alias("i")) for i, (m, n) in enumerate(zip(measures.values(), numbers, strict=True))])
    good = F.filter(cells, lambda x: (first == 0) | (x["i"] < first))
    return df.withColumn("row_failed", first > 0).select(*dims, "row_failed", F.explode(good).alias("x")).select(*dims, "row_failed", "x.Measure", "x.value")


def failed_rows(df: DataFrame, measures: Iterable[str]) -> DataFrame:
    test = F.lit(False)
    for c in measures:
        n = F.col(c).try_cast("double")
        test = test | n.isNull() | ~(F.abs(n) < float("inf"))
    return df.where(test)


def long_cells(df: DataFrame, dims: list[str], measure: str, value: str, known: Iterable[str]) -> DataFrame:
    """One cell a row, from a measure and a value column; unknown measures and values that are no numbers are given a reason."""
    number = F.col(value).try_cast("double")
    reason = F.when(~F.coalesce(F.col(measure).isin(list(known)), F.lit(False)), "unknown_measure").when(number.isNull(), "not_a_number")
    return df.select(*dims, F.col(measure).alias("Measure"), number.alias("value"), reason.alias("reason"))


#: New elements of a dimension that one import may create: elements are metadata, held by the driver.
MOST_CREATED = 100_000


def missing_elements(cells: DataFrame, model: Model, policy: str = "error") -> tuple[DataFrame, dict[str, list[str]]]:
    """error: rows with unknown elements get a reason; create: they are listed, to be added to their dimensions."""
    created: dict[str, list[str]] = {}
    reason = F.col("reason") if "reason" in cells.columns else F.lit(None).cast("string")
    for d in model.axes:
        if d.name not in cells.columns:
            continue
        known = cells.sparkSession.createDataFrame([(e,) for e in d.elements], f"`{d.name}` string")
        if policy == "create":
            new = cells.select(d.name).where(F.col(d.name).isNotNull()).distinct().join(F.broadcast(known), d.name, "left_anti").limit(MOST_CREATED + 1).collect()
            if len(new) > MOST_CREATED:
                raise ModelError("MC5102", f"more than {MOST_CREATED} new elements for {d.name}")
            created[d.name] = sorted(r[0] for r in new)
        else:
            reason = F.coalesce(reason, F.when(~F.coalesce(F.col(d.name).isin(d.elements), F.lit(False)), "unknown_element"))
    return cells.withColumn("reason", reason), created


_DIRECTIVES = {"Y": ("yyyy", r"\d{4}"), "m": ("MM", r"\d{2}"), "d": ("dd", r"\d{2}"), "H": ("HH", r"\d{2}"), "M": ("mm", r"\d{2}"), "S": ("ss", r"\d{2}"), "b": ("MMM", r"[A-Za-z]{3}")}


def parsed_time(c: Column, fmt: str) -> Column:
    """A timestamp by a strict format of %Y %m %d %H %M %S %b and %%; anything left over gives null."""
    pattern, regex, at = "", "", 0
    for m in re.finditer(r"%(.)", fmt):
        literal = fmt[at : m.start()]
        pattern += "".join(f"'{x}'" if x.isalpha() else x for x in literal)
        regex += re.escape(literal)
        if m[1] == "%":
            pattern, regex = pattern + "%", regex + "%"
        elif m[1] in _DIRECTIVES:
            pattern, regex = pattern + _DIRECTIVES[m[1]][0], regex + _DIRECTIVES[m[1]][1]
        else:
            raise ModelError("MC5030", f"unknown directive %{m[1]}")
        at = m.end()
    tail = fmt[at:]
    pattern += "".join(f"'{x}'" if x.isalpha() else x for x in tail)
    return F.when(c.rlike(f"^{regex}{re.escape(tail)}$"), F.try_to_timestamp(c, F.lit(pattern)))


def period_name(ts: Column, grain: str, week: Column | None = None) -> Column:
    """2026, 2026-Q1, 2026-01, 2026-W03 (from a week number given with it) or 2026-01-15."""
    year = F.date_format(ts, "yyyy")
    if grain == "week":
        if week is None:
            raise ModelError("MC5031", "weeks need a week number in the source")
        return F.concat(year, F.lit("-W"), F.lpad(week.cast("string"), 2, "0"))
    return {"year": year, "quarter": F.concat(year, F.lit("-Q"), F.quarter(ts).cast("string")), "month": F.date_format(ts, "yyyy-MM"), "day": F.date_format(ts, "yyyy-MM-dd")}[grain]


def instant(c: Column) -> Column:
    """Seconds since 1970 of an RFC 3339 text or an epoch number."""
    number = c.try_cast("double")
    return F.when(number.isNotNull(), number).otherwise(F.unix_micros(F.try_to_timestamp(c)) / 1e6)


_MONTHS = {m: i + 1 for i, m in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split())}


def report_sort_key(c: Column) -> Column:
    """Year * 12 + month of 'Mar_2026', 'March 2026', '2026-03' or '03-2026'; null for others."""
    name = F.lower(F.substring(F.regexp_extract(c, r"^([A-Za-z]{3,9})[_ -](\d{4})$", 1), 1, 3))
    month = F.element_at(F.create_map(*[x for k, v in _MONTHS.items() for x in (F.lit(k), F.lit(v))]), F.when(name != "", name))
    iso, back = r"^(\d{4})-(\d{2})$", r"^(\d{2})-(\d{4})$"
    part = lambda p, i: F.regexp_extract(c, p, i).try_cast("int")
    return F.when(month.isNotNull(), F.regexp_extract(c, r"(\d{4})$", 1).try_cast("int") * 12 + month).when(c.rlike(iso), part(iso, 1) * 12 + part(iso, 2)).when(c.rlike(back), part(back, 2) * 12 + part(back, 1))


def watermarked(query: str, column: str, last: str | None) -> str:
    """A query for what is newer than the last value: in place of {watermark}, or as a condition before ORDER, GROUP, HAVING or LIMIT."""
    if last is None:
        return query.replace("{watermark}", "NULL")
    literal = "'" + last.replace("'", "''") + "'"
    if "{watermark}" in query:
        return query.replace("{watermark}", literal)
    m = re.search(r"\b(group\s+by|having|order\s+by|limit)\b", query, re.I)
    at = m.start() if m else len(query)
    head, tail = query[:at].rstrip().rstrip(";"), query[at:]
    word = "AND" if re.search(r"\bwhere\b", head, re.I) else "WHERE"
    return f"{head} {word} {column} > {literal}" + (f" {tail}" if tail else "")


def next_fire(expression: str, after, limit_minutes: int = 366 * 24 * 60):
    """The next minute after `after` that a five-field cron expression, a preset or '@every 5m' names."""
    from datetime import timedelta

    presets = {"@hourly": "0 * * * *", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@weekly": "0 0 * * 0", "@monthly": "0 0 1 * *", "@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *"}
    if expression.startswith("@every "):
        m = re.fullmatch(r"(\d+)([smhd])", expression.removeprefix("@every ").strip())
        if not m:
            raise ModelError("MC5040", f"unknown interval {expression}")
        return after + timedelta(seconds=int(m[1]) * {"s": 1, "m": 60, "h": 3600, "d": 86400}[m[2]])
    fields = presets.get(expression, expression).split()
    if len(fields) != 5:
        raise ModelError("MC5040", "a cron expression has five fields")

    def allowed(field: str, low: int, high: int) -> set[int]:
        out: set[int] = set()
        for part in field.split(","):
            span, _, step = part.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b or (high if step else a)))
            if not low <= first <= last <= high:
                raise ModelError("MC5040", f"{field} is outside of {low} to {high}")
            out |= set(range(first, last + 1, int(step or 1)))
        return out

    minute, hour, day, month, week = (allowed(f, a, b) for f, (a, b) in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7)), strict=True))
    week = {w % 7 for w in week}
    at = after.replace(second=0, microsecond=0) + timedelta(minutes=1)
    for _ in range(limit_minutes * 5):
        dom, dow = at.day in day, (at.weekday() + 1) % 7 in week
        days = dom and dow if "*" in (fields[2], fields[4]) else dom or dow
        if at.month not in month or not days:
            at = (at + timedelta(days=1)).replace(hour=0, minute=0)
        elif at.hour not in hour:
            at = (at + timedelta(hours=1)).replace(minute=0)
        elif at.minute not in minute:
            at += timedelta(minutes=1)
        else:
            return at
    raise ModelError("MC5040", f"{expression} never fires")
