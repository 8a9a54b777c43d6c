"""Grading: metrics by segment, bands, intervals, flags and a total."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.scalar import wilson
from lumenfold.model.schema import ModelError


def edge_text(v: float) -> str:
    if v == int(v) and abs(v) < 1e15:
        return str(int(v))
    return f"{v:.6f}".rstrip("0").rstrip(".")


def band(value: Column, edges: list[float]) -> tuple[Column, Column]:
    """Label and order of a value's band: closed on the left, the last one on both sides."""
    label, order = F.when(value.isNull(), "(null)"), F.when(value.isNull(), F.lit(float("inf")))
    for i, (low, high) in enumerate(pairwise(edges)):
        last = i == len(edges) - 2
        inside = (value >= low) & ((value <= high) if last else (value < high))
        label = label.when(inside, f"[{edge_text(low)},{edge_text(high)}{']' if last else ')'}")
        order = order.when(inside, float(low))
    return label.otherwise("(out-of-range)"), order.otherwise(F.lit(1e308))


def metric(kind: str, a: str | None = None, b: str | None = None) -> Column:
    """count, mean, sum, ratio, std, min, max, rmse, wilson_lower or wilson_upper. Empty: null, but a sum of 0.0."""
    c = F.col(a) if a else None
    if kind == "count":
        return F.count("*").cast("double")
    if kind == "ratio":
        return F.when(F.abs(F.sum(b)) >= 1e-300, F.try_divide(F.sum(a), F.sum(b)))
    if kind == "rmse":
        return F.sqrt(F.avg(c))
    if kind in ("wilson_lower", "wilson_upper"):
        return wilson(F.avg(c), F.count(c).cast("double"), kind.endswith("upper"))
    if kind == "sum":
        return F.coalesce(F.sum(c), F.lit(0.0))
    return {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}[kind](c)


def grade(rows: DataFrame, metrics: Mapping[str, tuple], segment: str, edges: list[float] | None = None, min_n: int = 0, flag: Column | None = None, null_policy: str = "drop") -> DataFrame:
    """A row for each segment, bands by lower edge or names in order, specials last, and a TOTAL over all rows.

    status: ok, below_min_n or out_of_range. flag holds on ok segments alone. A null under an interval is an error or dropped.
    """
    intervals = [m[1] for m in metrics.values() if m[0].startswith("wilson")]
    if null_policy == "error" and intervals and rows.where(" or ".join(f"`{c}` is null" for c in intervals)).limit(1).count():
        raise ModelError("MC6012", "an interval's indicator is null")
    if edges:
        label, order = band(F.col(segment), edges)
    else:
        label, order = F.coalesce(F.col(segment).cast("string"), F.lit("(null)")), F.when(F.col(segment).isNull(), float("inf")).otherwise(0.0)
    made = [metric(*m).alias(n) for n, m in metrics.items()]
    named = rows.withColumn("segment", label).withColumn("_order", order)
    by = named.groupBy("segment", "_order").agg(F.count("*").alias("n"), *made)
    status = F.when(F.col("segment").isin("(out-of-range)", "(null)"), "out_of_range").when(F.col("n") < min_n, "below_min_n").otherwise("ok")
    by = by.withColumn("status", status).withColumn("flagged", F.when(F.col("status") == "ok", F.coalesce(flag, F.lit(False)) if flag is not None else F.lit(False)).otherwise(F.lit(False)))
    total = rows.agg(F.count("*").alias("n"), *made).select(F.lit("TOTAL").alias("segment"), F.lit(None).cast("double").alias("_order"), "n", *metrics, F.lit("ok").alias("status"), F.lit(False).alias("flagged"))
    return by.unionByName(total).orderBy(F.col("_order").asc_nulls_last(), "segment").drop("_order")


def evaluate_metrics(rows: DataFrame, metrics: Mapping[str, tuple], by: Iterable[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(*[metric(*m).alias(n) for n, m in metrics.items()])
