"""Embedding near-duplicates by an exact metric range join: pivots, boundary replication, independent cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, hashed_sample, materialize, ship
from .components import connected_components
from .vectors import matrix, usable_vectors

#: Bytes of a side that one task holds; larger cells are joined block by block, and a block in strips.
BLOCK_BYTES, STRIP = 16 << 20, 2048
#: Numbers of pivots to choose from, the largest bounding what is broadcast (times dimension * 8 bytes).
PIVOTS = (1, 4, 16, 64, 256, 1024, 4096)
#: Vectors, picked by hash, that pivots are drawn from and on which their number is chosen.
SAMPLE = 8192
#: What it costs to copy a vector to one more cell, in comparisons.
COPY = 2000
SLACK = 1e-9


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def spread_pivots(x: np.ndarray, most: int) -> np.ndarray:
    """Rows of x in the order of k-means++ seeding: each drawn in proportion to its squared distance from those before, so every prefix is a spread set."""
    rng = np.random.default_rng(5)
    chosen = [0]
    left = ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(most, len(x)) and left.max() > 1e-12:
        at = int(np.searchsorted(np.cumsum(left), rng.random() * left.sum(), side="right"))
        chosen.append(min(at, len(x) - 1))
        left = np.minimum(left, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _cells(x: np.ndarray, pivots: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit vector's home cell, and all cells (as a matrix) whose home vectors may lie within reach of it.

    If x is at home with p and y with q, and |x - y| <= reach, then |x - q| <= |x - p| + 2 * reach by the triangle
    inequality; and y's side of the plane between p and q is no further from x than reach, which is a tighter
    bound. x is a candidate in q's cell where both hold.
    """
    square = np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(axis=1)[None, :], 0)
    home = square.argmin(axis=1)
    row = np.arange(len(x))
    near = np.sqrt(square[row, home])
    inside = np.sqrt(square) <= near[:, None] + 2 * reach + SLACK
    own = pivots[home]
    between = np.sqrt(np.maximum((own * own).sum(axis=1)[:, None] - 2 * own @ pivots.T + (pivots * pivots).sum(axis=1)[None, :], 0))
    inside &= square - square[row, home][:, None] <= 2 * reach * between + SLACK
    inside[row, home] = True
    return home, inside


def choose_pivots(sample: np.ndarray, n: int, reach: float) -> np.ndarray:
    """Pivots for n vectors like the sample: as many as make comparisons and copies together cheapest."""
    spread = spread_pivots(sample, min(PIVOTS[-1], max(1, n // 64)))
    best = None
    for k in PIVOTS:
        if k > len(spread):
            break
        homes, members, copies = np.zeros(k), np.zeros(k), 0.0
        for s in range(0, len(sample), 1024):
            home, inside = _cells(sample[s : s + 1024], spread[:k], reach)
            homes += np.bincount(home, minlength=k)
            members += inside.sum(axis=0)
            copies += inside.sum()
        m = len(sample)
        cost = n * n * float(homes @ members) / (m * m) + COPY * n * copies / m
        if best is None or cost < best[0]:
            best = (cost, k)
    return spread[: best[1]]


def _assign(pivots: np.ndarray, reach: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                home, inside = _cells(_unit(matrix(part.column(1))), pivots, reach)
                cells = [np.flatnonzero(r).astype(np.int32) for r in inside]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(home.astype(np.int32)), pa.array(cells, pa.list_(pa.int32()))], ["id", "vec", "weight", "home", "cells"])

    return run


def _forest(adjacent: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple]:
    """Links that keep what the matrix connects connected, at most one for each row and column."""
    out = []
    open_rows = adjacent.any(axis=1)
    for start in np.flatnonzero(open_rows):
        if not open_rows[start]:
            continue
        hub, todo = rows[start], [start]
        open_rows[start] = False
        met = np.zeros(len(columns), dtype=bool)
        while todo:
            new = adjacent[todo].any(axis=0) & ~met
            met |= new
            reached = np.flatnonzero(adjacent[:, new].any(axis=1) & open_rows) if new.any() else np.empty(0, dtype=int)
            open_rows[reached] = False
            out += [(hub, rows[i]) for i in reached]
            todo = list(reached)
        out += [(hub, c) for c in columns[met] if c != hub]
    return out


def _compare(threshold: float):
    """Joins one block of a cell's home vectors with one block of its candidates, strip by strip."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side = table["is_home"].to_numpy()
        ids, vec, weight = table["id"].to_numpy(), _unit(matrix(table["vec"])), table["weight"].to_numpy()
        x, y = vec[side], vec[~side]
        a, b, w = ids[side], ids[~side], weight[~side]
        rough = y.astype(np.float32)
        u, v, n = [], [], []
        for s in range(0, len(x), STRIP):
            strip, own = x[s : s + STRIP], a[s : s + STRIP]
            counts = np.zeros(len(strip))
            for t in range(0, len(y), 4 * STRIP):
                # single precision finds what may be near; double precision decides
                close = strip.astype(np.float32) @ rough[t : t + 4 * STRIP].T >= np.float32(threshold - 1e-4)
                i, j = np.nonzero(close)
                if not len(i):
                    continue
                for c in range(0, len(i), 1 << 18):
                    p, q = i[c : c + (1 << 18)], j[c : c + (1 << 18)]
                    close[p, q] = (np.einsum("ij,ij->i", strip[p], y[t + q]) >= threshold) & (own[p] != b[t + q])
                counts += close @ w[t : t + 4 * STRIP].astype(np.float64)
                rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
                for p, q in _forest(close[np.ix_(rows, columns)], own[rows], b[t + columns]):
                    u.append(int(p)), v.append(int(q)), n.append(None)
            for p in np.flatnonzero(counts):
                u.append(int(own[p])), v.append(None), n.append(int(counts[p]))
        return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], ["u", "v", "n"])

    return run


def cosine_components(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95) -> DataFrame:
    """(id, n_links, component_id) for every row: vectors linked at a cosine of at least the threshold.

    Cosine c of unit vectors is distance sqrt(2 - 2 c), so this is a range join in a metric space. Equal vectors
    become one weighted class. Pivots are drawn by k-means++ from SAMPLE classes picked by hash, and as many are taken as
    promise the least work on these. A vector is
    at home in its nearest pivot's cell, and a candidate in all cells that its distance can't rule out; each home
    vector therefore meets all its partners in its own cell. Cells are compared in blocks, so no task holds more
    than two blocks, and give counts and a spanning forest, not pairs.
    Null, zero and non-finite vectors, those with null components and those of another dimension than most have no
    links and are their own component; so do null ids, with a null component. Rows that repeat an id and vector
    count as links of each other, as any equal vectors do.
    """
    spark = embeddings.sparkSession
    ship(spark)
    good = materialize(usable_vectors(embeddings, id_col, vector_col), "vectors")
    classes = materialize(good.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("weight")).select("id", "vec", "weight"), "classes")
    n = classes.count()
    if not n:
        none = F.lit(None).cast("long")
        return embeddings.select(embeddings[id_col].alias("id"), F.lit(0).cast("long").alias("n_links"), F.coalesce(embeddings[id_col], none).alias("component_id"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
    # SAMPLE rows at most
    sample = _unit(matrix(pa.array([r["vec"] for r in hashed_sample(classes, "id", SAMPLE, n).select("vec").collect()], pa.list_(pa.float64()))))
    pivots = choose_pivots(sample, n, reach)
    block = max(1024, BLOCK_BYTES // (8 * pivots.shape[1]))
    placed = materialize(classes.repartition(max(1, n // 8192)).mapInArrow(_assign(pivots, reach), "id bigint, vec array<double>, weight bigint, home int, cells array<int>"), "cells")
    homes = placed.groupBy(F.col("home").alias("cell")).agg(F.count("*").alias("h"))
    members = placed.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.count("*").alias("m"))
    # at most one row for each pivot
    sized = F.broadcast(homes.join(members, "cell").select("cell", F.ceil(F.col("h") / block).cast("int").alias("hs"), F.ceil(F.col("m") / block).cast("int").alias("ms")))
    own = F.xxhash64("id")
    left = placed.select("id", "vec", "weight", F.col("home").alias("cell"), F.lit(True).alias("is_home")).join(sized, "cell")
    left = left.select("*", F.pmod(own, F.col("hs")).cast("int").alias("hb"), F.explode(F.sequence(F.lit(0), F.col("ms") - 1)).alias("mb"))
    right = placed.select("id", "vec", "weight", F.explode("cells").alias("cell"), F.lit(False).alias("is_home")).join(sized, "cell")
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("hb"), F.pmod(own, F.col("ms")).cast("int").alias("mb"))
    columns = ["cell", "hb", "mb", "id", "vec", "weight", "is_home"]
    found = materialize(left.select(columns).unionByName(right.select(columns)).groupBy("cell", "hb", "mb").applyInArrow(_compare(threshold), "u bigint, v bigint, n bigint"), "near")
    discard(placed)
    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    summary = classes.select("id", "vec", "weight").join(counts, classes["id"] == counts["rep"], "left").join(parts, classes["id"] == parts["node"], "left")
    summary = summary.select("vec", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    joined = good.alias("g").join(summary.alias("s"), F.col("g.vec") == F.col("s.vec")).select(F.col("g.id").alias("id"), "n_links", "component_id")
    rest = embeddings.select(embeddings[id_col].alias("id"), embeddings[vector_col].alias("vec"))
    dimension = pivots.shape[1]
    from .vectors import usable

    rest = rest.where(~(F.col("id").isNotNull() & usable(F.col("vec").cast("array<double>")) & F.coalesce(F.size("vec") == dimension, F.lit(False))))
    return joined.unionByName(rest.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").cast("long").alias("component_id")))
