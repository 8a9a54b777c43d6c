"""Writes: checked cells, batches, dispositions, locks, imports with audit and rollback, ledgers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Mapping
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.model.schema import Model

#: Order of the checks: the first that fails is the reason.
REASONS = ("permission", "unknown_element", "consolidated", "derived", "version_locked", "locked", "intent", "not_finite", "revision")


def check_cells(model: Model, cells: DataFrame, grants: Column | None = None, locks: Iterable[Mapping] = (), now: datetime | None = None, revision: int | None = None, measure: str = "Measure", value: str = "value") -> DataFrame:
    """The cells with the first reason against each, null if it may be written. intent: Set, Increment or Clear; expected: a revision."""
    axes = model.axes
    roles = {m.name: m.role for m in model.measures}
    known = F.lit(True)
    leaf = F.lit(True)
    for d in axes:
        known = known & F.coalesce(F.col(d.name).isin(d.elements), F.lit(False))
        leaf = leaf & F.coalesce(~F.col(d.name).isin([e for e in d.elements if d.hierarchy and e in d.hierarchy.children]), F.lit(False))
    known = known & F.coalesce(F.col(measure).isin(sorted(roles)), F.lit(False))
    version = next((d for d in axes if d.kind == "Version"), None)
    draft = F.col(version.name).isin([e for e in version.elements if version.version_state.get(e, "Draft") == "Draft"]) if version else F.lit(True)
    held = F.lit(False)
    now = now or datetime.now(timezone.utc)
    for lock in locks:
        if lock.get("kind", "Hard") == "Hard" and (lock.get("expires") is None or lock["expires"] > now):
            here = F.lit(True)
            for d, e in lock["scope"].items():
                here = here & F.col(d).isin([e] if isinstance(e, str) else list(e))
            held = held | here
    intent = F.col("intent") if "intent" in cells.columns else F.lit("Set")
    number = F.col(value).cast("double")
    fine = (intent == "Clear") | (F.abs(number) < float("inf"))
    stale = F.col("expected") != revision if revision is not None and "expected" in cells.columns else F.lit(False)
    tests = (grants if grants is not None else F.lit(True), known, leaf, F.coalesce(F.col(measure).isin([m for m, r in roles.items() if r == "Input"]), F.lit(False)), draft, ~held, intent.isin("Set", "Increment", "Clear"), fine, ~F.coalesce(stale, F.lit(False)))
    reason = F.lit(None).cast("string")
    for name, test in reversed(list(zip(REASONS, tests, strict=True))):
        reason = F.when(~F.coalesce(test, F.lit(False)), name).otherwise(reason)
    return cells.withColumn("reason", reason)


def commit(store: DataFrame, cells: DataFrame, keys: Iterable[str], value: str = "value") -> DataFrame:
    """The store after a batch: (keys, value), with Set, Increment and Clear applied in order of `seq`.

    Within a batch the last Set or Clear of a cell counts, and the increments after it.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("seq")
    intent = F.col("intent") if "intent" in cells.columns else F.lit("Set")
    marked = cells.withColumn("_intent", intent).withColumn("_base", F.max(F.when(F.col("_intent") != "Increment", F.col("seq"))).over(Window.partitionBy(*keys))).withColumn("_o", F.row_number().over(w))
    by = marked.where(F.col("_base").isNull() | (F.col("seq") >= F.col("_base"))).groupBy(*keys).agg(
        F.max(F.when(F.col("_intent") == "Set", F.col(value))).alias("_set"), F.bool_or(F.col("_intent") == "Clear").alias("_clear"), F.bool_or(F.col("_intent") == "Set").alias("_sets"), F.sum(F.when(F.col("_intent") == "Increment", F.col(value))).alias("_inc")
    )
    base = F.when(F.col("_sets"), F.col("_set")).when(F.col("_clear"), F.lit(None)).otherwise(F.col(value))
    new = F.when(F.col("_inc").isNull(), base).otherwise(F.coalesce(base, F.lit(0.0)) + F.col("_inc"))
    out = store.select(*keys, value).join(by, keys, "full").withColumn("_new", F.when(F.col("_sets").isNull(), F.col(value)).otherwise(new))
    return out.where("_new is not null").select(*keys, F.col("_new").alias(value))


def dispose(store: DataFrame, cells: DataFrame, keys: Iterable[str], how: str = "merge", value: str = "value") -> DataFrame:
    """replace and merge overwrite by coordinate and clear nothing; append keeps what has a value."""
    keys = list(keys)
    if how == "append":
        kept = store.where(F.col(value).isNotNull())
        return kept.select(*keys, value).unionByName(cells.select(*keys, value).join(kept.select(*keys), keys, "left_anti"))
    return cells.select(*keys, value).unionByName(store.select(*keys, value).join(cells.select(*keys), keys, "left_anti"))


def last_writer(sources: list[DataFrame], keys: Iterable[str], value: str = "value") -> DataFrame:
    """State from sources of rising priority: the last that has a coordinate counts."""
    keys = list(keys)
    every = None
    for i, s in enumerate(sources):
        one = s.select(*keys, value).withColumn("_p", F.lit(i))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(*keys).agg(F.max_by(value, "_p").alias(value))


def on_error(cells: DataFrame, how: str, quarantine: str | None = None) -> DataFrame:
    """Cells without a reason against them. abort: fail if there is one; skip_row: leave it out; quarantine: write it as JSON lines."""
    bad = cells.where("reason is not null")
    if how == "abort":
        first = bad.limit(1).collect()
        if first:
            raise ValueError(f"a cell can't be written: {first[0]['reason']}")
    elif how == "quarantine":
        bad.write.mode("append").json(quarantine)
    return cells.where("reason is null").drop("reason")


def log_writes(cells: DataFrame, path: str, principal: str = "root") -> str:
    """Adds a batch to a log of writes: its cells as JSON lines, each with the batch's id, when, and by whom. Nothing there is changed."""
    name = uuid.uuid4().hex
    at = datetime.now(timezone.utc).isoformat()
    cells.select(F.lit(name).alias("write_id"), F.lit(at).alias("at"), F.lit(principal).alias("principal"), *cells.columns).write.mode("append").json(path)
    return name


class Imports:
    """Versioned imports in a folder: cells as Parquet, an audit that is only added to, and active flags derived from it."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _note(self, **entry) -> None:
        row = json.dumps({"at": datetime.now(timezone.utc).isoformat(), **entry}, sort_keys=True)
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("append").text(f"{self.root}/audit")

    def apply(self, cells: DataFrame, disposition: str = "merge") -> str:
        name = uuid.uuid4().hex
        cells.write.parquet(f"{self.root}/cells/import={name}")
        rows = self.spark.read.parquet(f"{self.root}/cells/import={name}").count()
        self._note(event="apply", id=name, disposition=disposition, rows=rows)
        return name

    def rollback(self, name: str) -> None:
        self._note(event="rollback", id=name)

    def audit(self) -> DataFrame:
        return self.spark.read.schema("at string, event string, id string, disposition string, rows bigint").json(f"{self.root}/audit")

    def active(self) -> DataFrame:
        a = self.audit()
        gone = a.where("event = 'rollback'").select("id")
        return a.where("event = 'apply'").join(gone, "id", "left_anti")

    def state(self, base: DataFrame, keys: Iterable[str], value: str = "value") -> DataFrame:
        """The base with the active imports replayed over it in order; appends give way to what is there.

        All imports are read at once, and a key's cells, one for each import that has it, are folded in order. So the plan
        is one union and one aggregation, however many imports there are; of the audit the driver reads a line for each
        active one. A key has one row, without a value where a merge has cleared it.
        """
        keys = list(keys)
        order = [(r["id"], r["disposition"]) for r in self.active().orderBy("at").collect()]
        if not order:
            return base
        number = self.spark.createDataFrame([(n + 1, *x) for n, x in enumerate(order)], "_n int, import string, _how string")
        cells = self.spark.read.option("basePath", f"{self.root}/cells").parquet(*[f"{self.root}/cells/import={i}" for i, _ in order])
        cells = cells.join(F.broadcast(number), "import").select(*keys, value, "_n", F.col("_how"))
        rows = base.select(*keys, value, F.lit(0).alias("_n"), F.lit("merge").alias("_how")).unionByName(cells)
        steps = F.array_sort(F.collect_list(F.struct("_n", "_how", F.col(value).alias("v"))))
        kind = rows.schema[value].dataType
        last = F.aggregate(steps, F.lit(None).cast(kind), lambda have, x: F.when((x["_how"] == "append") & have.isNotNull(), have).otherwise(x["v"]))
        return rows.groupBy(*keys).agg(last.alias(value))


def ledger_entries(findings: DataFrame, model: str, period: Column) -> DataFrame:
    """Findings with an id from their content, so that the same finding gets the same id."""
    body = F.concat_ws("|", F.lit(model), period, F.col("template_id"), F.col("text"))
    return findings.withColumn("schema_version", F.lit("1")).withColumn("model", F.lit(model)).withColumn("period", period).withColumn("ledger_entry_id", F.substring(F.sha2(body, 256), 1, 16))


def append_ledger(entries: DataFrame, path: str) -> None:
    entries.write.mode("append").json(path)


def trace(frame: DataFrame, rules: Mapping[str, set[str]], at: Mapping[str, str], measure: str, depth: int = 16) -> DataFrame:
    """The provenance of a cell as rows: (depth, measure, kind, value), rules before what they read at the same coordinate."""
    rows, todo, order = frame, [(0, measure)], []
    for d, e in at.items():
        rows = rows.where(F.col(d) == e)
    while todo:
        level, m = todo.pop(0)
        order.append((level, m, "Rule" if m in rules else "Input"))
        if level < depth:
            todo = [(level + 1, n) for n in sorted(rules.get(m, ()))] + todo
    items = [F.struct(F.lit(i).alias("step"), F.lit(level).alias("depth"), F.lit(m).alias("measure"), F.lit(kind).alias("provenance"), F.col(m).cast("double").alias("value")) for i, (level, m, kind) in enumerate(order)]
    return rows.limit(1).select(F.explode(F.array(*items)).alias("x")).select("x.*")
