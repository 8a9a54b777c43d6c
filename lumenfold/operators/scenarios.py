"""What-if overrides, sweeps and back-tests: the model evaluated once over many variants, in one plan."""

from __future__ import annotations

import itertools
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.model.schema import ModelError

from .cube import Cube
from .grade import metric

MAX_GRID = 1000


def stepped(start: float, end: float, step: float) -> list[float]:
    """Steps added until the end, with a hundredth of a step to spare."""
    out, v = [], start
    if step <= 0:
        raise ModelError("MC6101", "a step must be above 0")
    while v <= end + 0.01 * step:
        out.append(v)
        v += step
    return out


def spanned(start: float, stop: float, step: float) -> list[float]:
    """By index, also downwards, the stop always included."""
    if step == 0:
        raise ModelError("MC6101", "a step must not be 0")
    step = abs(step) if stop >= start else -abs(step)
    n = int((stop - start) / step + 1e-9)
    out = [start + i * step for i in range(n + 1)]
    return out if abs(out[-1] - stop) < 1e-9 else [*out, stop]


def overridden(cells: list[tuple[Mapping[str, str], str, float]]) -> dict[str, Column]:
    """(coordinate, measure, value) cells as columns that are null elsewhere."""
    out: dict[str, Column] = {}
    for at, measure, value in cells:
        here = F.lit(True)
        for d, e in at.items():
            here = here & (F.col(d) == e)
        column = F.when(here, F.lit(float(value)))
        out[measure] = F.coalesce(column, out[measure]) if measure in out else column
    return out


def whatif(cube: Cube, cells: list[tuple[Mapping[str, str], str, float]], show: list[str], at: Mapping[str, str] | None = None) -> DataFrame:
    """before, after and delta of the shown measures at a coordinate (that of the first override by default). Nothing is stored."""
    at = dict(at if at is not None else cells[0][0])
    needed = show + [m.weight for m in map(cube.model.measure, show) if m.weight]
    dense = "time" if cube.needs_grid(needed) else "none"
    frame = cube.leaf(dense)
    missing = cube.spark.createDataFrame([tuple(c[0][a] for a in cube.axes) for c in cells if all(a in c[0] for a in cube.axes)], ", ".join(f"`{a}` string" for a in cube.axes)).distinct()
    frame = missing.join(frame.drop("_t"), cube.axes, "full").withColumn("_t", cube.ordinal(cube.model.time.name)) if cube.model.time else frame
    before = cube.consolidate({d: [e] for d, e in at.items()}, show, cube.evaluate(needed, frame))
    after = cube.consolidate({d: [e] for d, e in at.items()}, show, cube.evaluate(needed, frame, overridden(cells)))
    row = lambda df: df.agg(*[F.max(s).alias(s) for s in show]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("measure"), F.col(s).alias("value")) for s in show])).alias("x")).select("x.*")
    x, y = row(before).withColumnRenamed("value", "before"), row(after).withColumnRenamed("value", "after")
    return x.join(y, "measure").withColumn("delta", F.col("after") - F.col("before"))


def sweep(cube: Cube, target: str, values: list[float], measure: str, how: str = "sum", where: Column | None = None, scale: bool = False) -> DataFrame:
    """A row for each value of an input (set, or scaled by it), with the measure's metric over matching leaves; null if nothing matches."""
    if len(values) > MAX_GRID:
        raise ModelError("MC6102", f"{len(values)} points are more than {MAX_GRID}")
    points = cube.spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "point int, value double")
    frame = cube.leaf("none").crossJoin(F.broadcast(points))  # MAX_GRID rows at most
    new = F.col(target) * F.col("value") if scale else F.col("value")
    rows = cube.evaluate([measure], frame.withColumn(target, F.when(F.col(target).isNotNull(), new)))
    if where is not None:
        rows = rows.where(where)
    fold = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}[how]
    return points.join(rows.groupBy("point").agg(fold(measure).alias("metric")), "point", "left").orderBy("point")


def optimum(swept: DataFrame, goal: str = "max", last: bool = False) -> DataFrame:
    """The best point; of equal ones the first, or for a command-line maximum the last."""
    best = F.col("metric").desc() if goal == "max" else F.col("metric").asc()
    tie = F.col("point").desc() if last and goal == "max" else F.col("point").asc()
    return swept.where("metric is not null").orderBy(best, tie).limit(1)


def grid_of(axes: Mapping[str, list[float]], limit: int = MAX_GRID) -> list[tuple]:
    """The product of the axes, the first slowest."""
    out = list(itertools.product(*axes.values()))
    if len(out) > limit:
        raise ModelError("MC6103", f"a grid of {len(out)} is more than {limit}")
    return out


def backtest(cube: Cube, axes: Mapping[str, list[float]], metrics: Mapping[str, tuple], segment: str | None = None, scale: bool = True, where: Column | None = None) -> DataFrame:
    """Metrics for each grid point, and segment. An axis multiplies an input measure (or sets it, scale=False).

    One plan: grid rows are a broadcast side of known size, and a single aggregation by grid point and segment follows.
    """
    names = list(axes)
    points = grid_of(axes)
    grid = cube.spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(points)], "grid int, " + ", ".join(f"`_g_{n}` double" for n in names))
    frame = cube.leaf("none").crossJoin(F.broadcast(grid))
    for n in names:
        frame = frame.withColumn(n, F.col(n) * F.col(f"_g_{n}") if scale else F.when(F.col(n).isNotNull(), F.col(f"_g_{n}")))
    wanted = sorted({x for m in metrics.values() for x in m[1:] if x})
    rows = cube.evaluate(wanted, frame)
    if where is not None:
        rows = rows.where(where)
    keys = ["grid", *[f"_g_{n}" for n in names], *([segment] if segment else [])]
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[metric(*m).alias(k) for k, m in metrics.items()])
    return out.select("grid", *[F.col(f"_g_{n}").alias(f"x_{n}") for n in names], *([segment] if segment else []), "n", *metrics)


def best(results: DataFrame, metric_name: str, goal: str = "max", by: str | None = None) -> DataFrame:
    """The best grid point over all, or for each segment; of equal ones the first in grid order."""
    value = F.col(metric_name).desc_nulls_last() if goal == "max" else F.col(metric_name).asc_nulls_last()
    w = Window.partitionBy(*([by] if by else [])).orderBy(value, "grid")
    return results.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
