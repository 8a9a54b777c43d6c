"""Statistics over periods: benchmark libraries, trends, runs, ledgers, report text."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.report import Report, Typed, benchmark_columns, mentioned, percentile_rank
from lumenfold.model.schema import ModelError

ORDERED = Window.unboundedPreceding


def latest(rows: DataFrame, keys: Iterable[str], order: Column) -> DataFrame:
    """One row for each key, the last in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc()))).where("_r = 1").drop("_r")


def benchmark_library(rows: DataFrame, keys: Iterable[str], value: str = "value") -> DataFrame:
    """p10 to p90 at index round(p * (n - 1)) of the sorted values, mean, population deviation and number. Ranks come from a sort, not from lists."""
    keys = list(keys)
    have = rows.where(F.col(value).isNotNull())
    n = F.count("*").over(Window.partitionBy(*keys))
    ranked = have.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).withColumn("_n", n)
    at = lambda p: F.max(F.when(F.col("_r") == F.floor(F.lit(p) * (F.col("_n") - 1) + 0.5) + 1, F.col(value)))
    return ranked.groupBy(*keys).agg(*[at(p / 100).alias(f"p{p}") for p in (10, 25, 50, 75, 90)], F.avg(value).alias("mean"), F.stddev_pop(value).alias("stddev"), F.count("*").alias("n"))


def period_context(rows: DataFrame, keys: Iterable[str], period: str, value: str) -> DataFrame:
    """Current, previous, first and last values, extremes with their periods, sum and average of each series."""
    v = F.when(F.col(value).isNotNull(), F.col(period))
    have = rows.where(F.col(value).isNotNull())
    w = Window.partitionBy(*keys).orderBy(F.col(period).desc())
    ranked = have.withColumn("_r", F.row_number().over(w))
    low_first = F.struct(F.col(value), F.col(period))
    high_first = F.struct(-F.col(value), F.col(period))
    return ranked.groupBy(*keys).agg(
        F.max(F.when(F.col("_r") == 1, F.col(value))).alias("current"), F.max(F.when(F.col("_r") == 2, F.col(value))).alias("prev"), F.min_by(value, period).alias("first"), F.max_by(value, period).alias("last"),
        F.min(value).alias("min"), F.max(value).alias("max"), F.sum(value).alias("sum"), F.avg(value).alias("campaign_avg"), F.min_by(v, low_first).alias("worst_period"), F.min_by(v, high_first).alias("best_period"), F.count("*").alias("periods"),
    )


def trends(rows: DataFrame, keys: Iterable[str], period: str, value: str) -> DataFrame:
    """slope (up, down, flat within 5 %), consistency, volatility and signed streak of each series, by period."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(period)
    have = rows.where(F.col(value).isNotNull()).withColumn("_d", F.col(value) - F.lag(value).over(w)).withColumn("_t", F.row_number().over(w))
    sign = F.when(F.abs("_d") < 1e-9, 0).when(F.col("_d") > 0, 1).otherwise(-1)
    have = have.withColumn("_s", F.when(F.col("_d").isNotNull(), sign))
    last = Window.partitionBy(*keys)
    have = have.withColumn("_end", F.max_by("_s", "_t").over(last))
    broken = F.max(F.when(F.col("_s").isNull() | (F.col("_s") != F.col("_end")), F.col("_t")))
    by = have.groupBy(*keys).agg(F.count("*").alias("n"), F.min_by(value, "_t").alias("a"), F.max_by(value, "_t").alias("b"), F.avg(value).alias("m"), F.stddev_pop(value).alias("sd"), F.max("_end").alias("end"), (F.max("_t") - broken).alias("run"))
    change = (F.col("b") - F.col("a")) / F.when(F.abs("a") >= 1e-15, F.col("a")) * 100.0
    delta = F.col("b") - F.col("a")
    slope = F.when(F.col("n") < 2, F.lit(None).cast("string")).when(F.abs("a") < 1e-15, F.when(F.abs(delta) < 1e-9, "flat").when(delta > 0, "up").otherwise("down")).when(F.abs(change) < 5, "flat").when(change > 0, "up").otherwise("down")
    cv = F.col("sd") / F.when(F.abs("m") >= 1e-15, F.abs("m"))
    steady = F.when(F.col("n") < 3, F.lit(None).cast("string")).when(F.abs("m") < 1e-15, "steady").when(cv < 0.15, "steady").when(cv < 0.50, "variable").otherwise("volatile")
    streak = F.when((F.col("n") < 2) | (F.col("end") == 0), F.lit(0.0)).otherwise((F.col("run") * F.col("end")).cast("double"))
    return by.select(*keys, slope.alias("slope"), steady.alias("consistency"), F.when(F.col("n") >= 2, cv).alias("volatility"), streak.alias("streak"))


def period_number(period: Column) -> Column:
    """YYYY-MM counts months, YYYY-Qn quarters, so neighbours differ by 1."""
    year = F.substring(period, 1, 4).cast("int")
    quarter = period.rlike(r"^\d{4}-Q[1-4]$")
    month = period.rlike(r"^\d{4}-\d{2}$")
    return F.when(quarter, year * 4 + F.substring(period, 7, 1).try_cast("int") - 1).when(month, year * 12 + F.substring(period, 6, 2).try_cast("int") - 1)


def consecutive_runs(rows: DataFrame, keys: Iterable[str], period: str, least: int = 2) -> DataFrame:
    """Runs of neighbouring periods in which each key occurs, at least so long: gaps and islands."""
    keys = list(keys)
    named = rows.select(*keys, period).distinct().withColumn("_n", period_number(F.col(period))).where("_n is not null")
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*keys).orderBy("_n"))
    return named.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min(period).alias("first_period"), F.max(period).alias("last_period"), F.count("*").alias("length")).where(F.col("length") >= least).drop("_i")


def ledger_history(ledger: DataFrame, now: str, keys: Iterable[str], lookback: int | None = None) -> DataFrame:
    """Entries before the current period, most recent first: how often, first and last period, and the streak up to it."""
    keys = list(keys)
    before = ledger.where(F.col("period") < now).select(*keys, "period").distinct()
    before = before.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("period").desc())))
    if lookback is not None:
        before = before.where(F.col("_r") <= lookback)
    at = period_number(F.col("period")) + F.col("_r")
    expected = period_number(F.lit(now))
    return before.groupBy(*keys).agg(F.count("*").alias("count"), F.min("period").alias("first_period"), F.max("period").alias("last_period"), F.count_if(at == expected).alias("streak"))


def budget_events(rows: DataFrame, keys: Iterable[str], period: str, value: str, low: float = 0.8, high: float = 1.2) -> DataFrame:
    """Periods whose value is less than 0.8 or more than 1.2 of the one before."""
    ratio = F.col(value) / F.when(F.abs(F.col("previous")) >= 1e-15, F.col("previous"))
    out = rows.withColumn("previous", F.lag(value).over(Window.partitionBy(*keys).orderBy(period))).withColumn("ratio", ratio)
    return out.where((F.col("ratio") < low) | (F.col("ratio") > high)).withColumn("event", F.when(F.col("ratio") < low, "budget_cut").otherwise("budget_increase"))


def percentile_of(value: Column, p: Mapping[int, Column]) -> Column:
    """The breakpoint rank of a value among a benchmark's p10 to p90: the first that it doesn't exceed, 100 beyond all."""
    return percentile_rank(value, p)


def z_score(value: Column, mean: Column, deviation: Column) -> Column:
    return F.when(F.coalesce(deviation, F.lit(0.0)) < 1e-15, 0.0).otherwise((value - mean) / F.when(deviation >= 1e-15, deviation))


def guarded_ratio(a: Column, b: Column) -> Column:
    return F.when(F.abs(b) >= 1e-15, a / F.when(F.abs(b) >= 1e-15, b))


def pct_change(now: Column, before: Column) -> Column:
    return guarded_ratio(now - before, before) * 100.0


def plural(n: Column, one: str, many: str) -> Column:
    return F.when(F.abs(n - 1) < 1e-9, one).otherwise(many)


_SPEC = re.compile(r"^(\+?)(,?)(?:\.(\d+))?(%?)$")


def number_text(n: Column, spec: str = "") -> Column:
    """[+][,][.N][%]: a sign, thousands, digits after the point, percent of 1. Null and NaN are a dash."""
    m = _SPEC.match(spec)
    if not m:
        raise ModelError("MC7001", f"unknown number format {spec!r}")
    plus, comma, digits, percent = m[1], m[2], int(m[3] or 0), m[4]
    x = n * 100 if percent else n
    grouped = F.format_number(F.round(x, digits), digits)
    text = grouped if comma else F.regexp_replace(grouped, ",", "")
    if plus:
        text = F.when(x >= 0, F.concat(F.lit("+"), text)).otherwise(text)
    if percent:
        text = F.concat(text, F.lit("%"))
    return F.when(n.isNull() | F.isnan(n), "—").otherwise(text)


def joined_text(*parts: Column) -> Column:
    """Null is skipped."""
    return F.concat_ws("", *parts)


def fill(template: str, values: Mapping[str, Column]) -> Column:
    """{name} and {name:spec} in a text, from columns; unknown names stay."""
    out, at = [], 0
    for m in re.finditer(r"\{(\w+)(?::([^}]*))?\}", template):
        out.append(F.lit(template[at : m.start()]))
        c = values.get(m[1])
        out.append(F.lit(m[0]) if c is None else number_text(c, m[2]) if m[2] is not None else F.coalesce(c.cast("string"), F.lit("")))
        at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def fire(rows: DataFrame, templates: list[dict], keys: Iterable[str]) -> DataFrame:
    """Texts of the templates whose condition holds, the first by priority within a finding of each key."""
    keys = list(keys)
    fired = F.array(*[F.when(F.coalesce(t["when"], F.lit(False)), F.struct(F.lit(t["id"]).alias("template_id"), F.lit(t["finding"]).alias("finding_id"), F.lit(int(t["priority"])).alias("priority"), fill(t["text"], t["values"]).alias("text"))) for t in templates])
    out = rows.select(*keys, F.explode(F.filter(fired, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")
    w = Window.partitionBy(*keys, "finding_id").orderBy("priority", "template_id")
    return out.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _compiled(rows: DataFrame, templates: list[dict], library: DataFrame | None, scope: str | None) -> tuple[DataFrame, list[dict]]:
    """The rows, with the benchmarks that templates look up, and the templates with columns for their conditions and values."""
    texts = [e for t in templates for e in (t["when"], *t.get("bindings", {}).values())]
    metrics = sorted(mentioned(texts)) if library is not None else []
    if metrics:
        rows = benchmark_columns(rows, library, scope, metrics)
    kind = lambda t: "bool" if t == "boolean" else "text" if t in ("string", "date", "timestamp") else "number"
    report = Report({c: Typed(kind(t), F.col(f"`{c}`").cast("double") if kind(t) == "number" else F.col(f"`{c}`")) for c, t in rows.dtypes if not t.startswith("struct")}, metrics)
    made = []
    for t in templates:
        bound = report.bound(t.get("bindings", {}))
        made.append({**t, "when": report(t["when"]).truth, "values": {n: v.column for n, v in bound.columns.items()}})
    return rows, made


def fire_texts(rows: DataFrame, templates: list[dict], keys: Iterable[str], library: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """fire() with conditions and bindings written in the language of report texts, over the rows' columns.

    A template: id, finding, priority, when, text, and bindings, named expressions that the text and each other
    mention. Numbers in a text may have a format. Benchmarks come from the library for each row's scope.
    """
    return fire(*_compiled(rows, templates, library, scope), keys)


def explained(rows: DataFrame, templates: list[dict], keys: Iterable[str], library: DataFrame | None = None, scope: str | None = None) -> DataFrame:
    """Chains of explanations: of each finding's templates, in order of priority, the first whose condition holds, with those rejected before it and those skipped after it.

    A finding is one chain of conditions in a projection, so nothing is shuffled. A row gives a line for each finding that has an explanation.
    """
    keys = list(keys)
    rows, made = _compiled(rows, templates, library, scope)
    groups: dict[str, list[dict]] = {}
    for t in sorted(made, key=lambda t: (t["priority"], t["id"])):
        groups.setdefault(t["finding"], []).append(t)
    ids = lambda ts: F.array(*[F.lit(t["id"]) for t in ts]).cast("array<string>")
    chains = []
    for finding, group in sorted(groups.items()):
        chain = F.when(F.lit(False), F.lit(None))
        for i, t in enumerate(group):
            made_ = F.struct(F.lit(finding).alias("finding_id"), F.lit(t["id"]).alias("template_id"), fill(t["text"], t["values"]).alias("text"), ids(group[:i]).alias("rejected"), ids(group[i + 1 :]).alias("skipped"))
            chain = chain.when(t["when"], made_)
        chains.append(chain)
    return rows.select(*keys, F.explode(F.filter(F.array(*chains), lambda x: x.isNotNull())).alias("x")).select(*keys, "x.*")


def context_events(events: DataFrame, period: str, kind: str | None = None, lookback: int = 1) -> DataFrame:
    """Events of this period (lookback 1) or of any period (more), how many and what they say."""
    rows = events if kind is None else events.where(F.col("kind") == kind)
    if lookback == 1:
        rows = rows.where(F.col("period") == period)
    return rows.agg(F.count("*").alias("n"), (F.count("*") > 0).alias("has"), F.array_join(F.array_sort(F.collect_list("description")), "; ").alias("description"))


def where_stats(rows: DataFrame, test: Column, name: str, order: str, keys: Iterable[str] = ()) -> DataFrame:
    """How many elements match, whether any does, their names in order, and the first one's."""
    hit = F.coalesce(test, F.lit(False))
    named = F.array_sort(F.collect_list(F.when(hit, F.struct(F.col(order), F.col(name)))))
    return rows.groupBy(*keys).agg(F.count_if(hit).alias("count_where"), F.coalesce(F.bool_or(hit), F.lit(False)).alias("any_where"), F.array_join(F.transform(named, lambda x: x[name]), ", ").alias("names_where"), F.min_by(name, F.when(hit, F.col(order))).alias("first_where"))


def header_tokens(c: Column) -> Column:
    """Normalized: no parentheses, lower case, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(c, r"\([^)]*\)", " ")), r"\s+", " "))


def token_match(queries: DataFrame, registry: DataFrame, accept: float = 0.30, margin: float = 0.05, relative: float = 0.20, review: float = 0.20) -> DataFrame:
    """The best registry entry of each query by idf-weighted F1 of their token sets: (query_id, entry_id, score, status).

    Both tables are (id, token); only pairs that share a token meet, and sums of the others come from each side's total.
    """
    q, r = queries.select(F.col("id").alias("query_id"), "token").distinct(), registry.select(F.col("id").alias("entry_id"), "token").distinct()
    total = registry.select(F.countDistinct("id").alias("entries"))
    df = r.groupBy("token").agg(F.count("*").alias("df"))
    idf = lambda rows: rows.join(df, "token", "left").crossJoin(F.broadcast(total)).withColumn("idf", F.log((F.col("entries") + 1.0) / (F.coalesce("df", F.lit(0)) + 1.0)) + 1.0).drop("df", "entries")
    qi, ri = idf(q), idf(r)
    both = qi.join(ri.select("entry_id", "token"), "token").groupBy("query_id", "entry_id").agg(F.sum("idf").alias("both"))
    scored = both.join(qi.groupBy("query_id").agg(F.sum("idf").alias("a")), "query_id").join(ri.groupBy("entry_id").agg(F.sum("idf").alias("b")), "entry_id")
    p, c = F.col("both") / F.col("a"), F.col("both") / F.col("b")
    scored = scored.select("query_id", "entry_id", (2.0 * p * c / (p + c)).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entry_id")
    top = scored.withColumn("_r", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).where("_r = 1")
    apart = F.col("second").isNull() | (F.col("score") - F.col("second") >= margin) | (F.col("score") >= F.col("second") * (1 + relative))
    status = F.when((F.col("score") >= accept) & apart, "accepted").when(F.col("score") >= review, "review").otherwise("rejected")
    return top.select("query_id", "entry_id", "score", status.alias("status"))


def match_counts(matches: DataFrame) -> DataFrame:
    """How many queries were accepted, are for review, or were rejected."""
    return matches.groupBy("status").agg(F.count("*").alias("n"))
