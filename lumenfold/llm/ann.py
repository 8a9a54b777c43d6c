"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import hashed_sample, materialize, ship
from .vectors import matrix, usable_vectors

DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
#: Rows of a shard: as many vectors as SHARD_BYTES hold in single precision, within these bounds.
SHARD_BYTES, LEAST_SHARD, MOST_SHARD = 64 << 20, 4096, 65_536
QUERY_BLOCK = 32_768
#: A shard's beam is the first of these with which SAMPLE queries, picked by hash, reach this recall in it.
BEAMS, RECALL, SAMPLE = (32, 48, 64, 96, 128, 192, 256, 384, 512), 0.97, 256


def _distances(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of every query to its row of candidates; negative ids are infinitely far."""
    d = x[np.maximum(ids, 0)]
    d = np.einsum("qcd,qcd->qc", d, d) - 2 * np.einsum("qcd,qd->qc", d, q) + (q * q).sum(axis=1)[:, None]
    d[ids < 0] = np.inf
    return d


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, expand: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Greedy search of many queries in step: (ids, squared distances) of each one's beam, nearest first.

    In each step every query opens its `expand` nearest unopened nodes and keeps the nearest `beam` of what it
    knows; it ends when all nodes of its beam are open.
    """
    n = len(q)
    seen = np.zeros((n, len(x)), dtype=bool)
    ids = np.full((n, beam), -1, dtype=np.int32)
    ids[:, 0] = start
    dist = np.full((n, beam), np.inf)
    dist[:, :1] = _distances(x, ids[:, :1], q)
    opened = np.ones((n, beam), dtype=bool)
    opened[:, 0] = False
    seen[:, start] = True
    active = np.arange(n)
    while len(active):
        closed = np.where(opened[active], np.inf, dist[active])
        pick = np.argpartition(closed, expand - 1, axis=1)[:, :expand] if expand < beam else np.argsort(closed, axis=1)
        valid = np.take_along_axis(closed, pick, axis=1) < np.inf
        going = valid.any(axis=1)
        active, pick, valid = active[going], pick[going], valid[going]
        if not len(active):
            break
        rows = np.repeat(np.arange(len(active)), pick.shape[1]).reshape(pick.shape)
        opened[active[rows[valid]], pick[valid]] = True
        nodes = np.where(valid, ids[active[:, None], pick], -1)
        near = np.where(nodes[:, :, None] >= 0, graph[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
        # a node met twice in one step counts once
        order = np.argsort(near, axis=1, kind="stable")
        ranked = np.take_along_axis(near, order, axis=1)
        twice = np.zeros_like(fresh)
        np.put_along_axis(twice, order[:, 1:], ranked[:, 1:] == ranked[:, :-1], axis=1)
        fresh &= ~twice
        near = np.where(fresh, near, -1)
        r, c = np.nonzero(fresh)
        seen[active[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        v = x[near[r, c]]
        d[r, c] = ((v - q[active[r]]) ** 2).sum(axis=1)
        ids_all = np.concatenate([ids[active], near], axis=1)
        dist_all = np.concatenate([dist[active], d], axis=1)
        open_all = np.concatenate([opened[active], ~fresh], axis=1)
        keep = np.argpartition(dist_all, beam - 1, axis=1)[:, :beam]
        ids[active], dist[active], opened[active] = (np.take_along_axis(z, keep, axis=1) for z in (ids_all, dist_all, open_all))
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(ids, order, axis=1), np.take_along_axis(dist, order, axis=1)


def robust_prune(x: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node, up to `degree` diverse candidates: the nearest one left is kept and rules out those much nearer to it than to the node."""
    out = np.full((len(nodes), degree), -1, dtype=np.int32)
    d = _distances(x, candidates, x[nodes])
    d[candidates == nodes[:, None]] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    candidates, d = np.take_along_axis(candidates, order, axis=1), np.take_along_axis(d, order, axis=1)
    d[:, 1:][(candidates[:, 1:] == candidates[:, :-1])] = np.inf
    v = x[np.maximum(candidates, 0)]
    square = np.einsum("qcd,qcd->qc", v, v)
    rows = np.arange(len(nodes))
    left = d.copy()
    for k in range(degree):
        best = left.argmin(axis=1)
        alive = left[rows, best] < np.inf
        if not alive.any():
            break
        out[alive, k] = candidates[rows, best][alive]
        chosen = v[rows, best]
        apart = square + square[rows, best][:, None] - 2 * np.einsum("qcd,qd->qc", v, chosen)
        left[(alpha * alpha * apart <= d) & alive[:, None]] = np.inf
        left[rows[alive], best[alive]] = np.inf
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, int]:
    """A directed graph over the rows of x and the node to start from (the most central one).

    Rows are inserted in batches of doubling size: a batch's searches propose neighbours, pruning picks some, and
    the reverse edges are pruned again where a node has too many. Single precision is enough to propose edges.
    """
    n = len(x)
    x = x.astype(np.float32)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1, dtype=np.int32)
    order = np.random.default_rng(3).permutation(n)
    for bound in (alpha,):
        done = 0
        size = 1
        while done < n:
            batch = order[done : done + size]
            done += len(batch)
            size = min(2 * size, 512)
            found, _ = beam_search(x, graph, start, x[batch], beam)
            pool = np.concatenate([found, graph[batch]], axis=1)
            graph[batch] = robust_prune(x, batch, pool, degree, bound)
            u = np.repeat(batch, degree)
            v = graph[batch].ravel()
            u, v = u[v >= 0], v[v >= 0]
            by = np.argsort(v, kind="stable")
            u, v = u[by], v[by]
            targets, first, count = np.unique(v, return_index=True, return_counts=True)
            width = int(count.max()) if len(count) else 0
            back = np.full((len(targets), width), -1, dtype=np.int32)
            back[np.repeat(np.arange(len(targets)), count), np.arange(len(v)) - np.repeat(first, count)] = u
            for s in range(0, len(targets), 512):
                t, pool = targets[s : s + 512], np.concatenate([graph[targets[s : s + 512]], back[s : s + 512]], axis=1)
                graph[t] = robust_prune(x, t, pool, degree, bound)
    return graph, start


def nearest(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, distances) of the k nearest found: single precision searches, double precision ranks what the beam holds."""
    found, _ = beam_search(x.astype(np.float32), graph, start, q.astype(np.float32), beam)
    d = _distances_exact(x, found, q)
    order = np.argsort(d, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(found, order, axis=1), np.take_along_axis(d, order, axis=1)


def _distances_exact(x: np.ndarray, ids: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = np.empty(ids.shape)
    for s in range(0, len(ids), 256):
        d[s : s + 256] = np.sqrt(((x[np.maximum(ids[s : s + 256], 0)] - q[s : s + 256, None, :]) ** 2).sum(axis=2))
    d[ids < 0] = np.inf
    return d


def fitting_beam(x: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, k: int) -> int:
    """The narrowest beam whose recall at k, of the sample q against brute force over the shard, is RECALL or more."""
    if not len(q):
        return BEAMS[-1]
    d = (x * x).sum(axis=1)[None, :] - 2 * q @ x.T
    true = np.argpartition(d, min(k, len(x)) - 1, axis=1)[:, :k]
    for beam in BEAMS:
        found, _ = nearest(x, graph, start, q, beam, k)
        if np.mean([len(set(f) & set(t)) / len(t) for f, t in zip(found.tolist(), true.tolist(), strict=True)]) >= RECALL:
            return beam
    return BEAMS[-1]


def _index(sample: np.ndarray, k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        x = matrix(table["vec"])
        graph, start = build_graph(x)
        beams = np.zeros(len(graph), dtype=np.int32)  # of the start alone
        beams[start] = fitting_beam(x, graph, start, sample, k)
        edges = pa.array([r[r >= 0] for r in graph], pa.list_(pa.int32()))
        return pa.table([table["shard"], pa.array(np.arange(len(graph), dtype=np.int32)), table["id"], table["vec"], edges, pa.array(beams)], ["shard", "node", "id", "vec", "edges", "beam"])

    return run


def _search(k: int):
    def run(key: tuple, index: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["query_id", "id", "distance"]
        if not index.num_rows or not queries.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names)
        index = index.sort_by("node")
        x, edges = matrix(index["vec"]), index["edges"].combine_chunks()
        lengths = edges.value_lengths().to_numpy()
        graph = np.full((len(x), max(1, int(lengths.max()))), -1, dtype=np.int32)
        graph[np.repeat(np.arange(len(x)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = edges.flatten().to_numpy()
        beams = index["beam"].to_numpy()
        start = int(beams.argmax())
        ids, q, qid = index["id"].to_numpy(), matrix(queries["vec"]), queries["query_id"].to_numpy()
        out = []
        # the visited map takes a byte for each query and node
        step = max(1, (1 << 25) // len(x))
        for s in range(0, len(q), step):
            found, d = nearest(x, graph, start, q[s : s + step], int(beams[start]), k + 1)
            r, c = np.nonzero(found >= 0)
            out.append((qid[s : s + step][r], ids[found[r, c]], d[r, c]))
        return pa.table([pa.array(np.concatenate(z)) for z in zip(*out, strict=True)], names)

    return run


def graph_neighbours(embeddings: DataFrame, queries: DataFrame | None = None, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query, by Euclidean distance.

    Queries: given rows, or the rows whose id is divisible by `every`. Every row but the query itself is a candidate.
    Equal vectors are one node, which stands for its smallest ids; nodes are dealt by hash to shards, of 65,536 or, in
    many dimensions, as many as SHARD_BYTES hold; smaller tables to as many shards as there are cores. Each gets a graph, written to the shared folder, and a beam
    that is measured on SAMPLE queries against brute force in that shard: data in clusters need narrow ones, data that lie
    in all directions alike wide ones. Each block of QUERY_BLOCK queries visits each shard.
    Distances are double precision, on the original vectors; ties go to the smaller id. Fewer than k candidates:
    all are returned. Null, zero and non-finite vectors, those with null components, null ids and vectors of another
    dimension than most take no part. A repeated id counts once for equal vectors.
    """
    spark = embeddings.sparkSession
    ship(spark)
    good = materialize(usable_vectors(embeddings, id_col, vector_col).distinct(), "vectors")
    # only the k + 1 smallest ids of equal vectors can be among a query's k; a hot vector is thinned by salts first
    thin = good.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    thin = thin.withColumn("r", F.row_number().over(Window.partitionBy("vec", "salt").orderBy("id"))).where(F.col("r") <= k + 1)
    thin = thin.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("r") <= k + 1).select("vec", "id")
    members = materialize(thin.groupBy("vec").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.element_at("ids", 1)), "members")
    n = members.count()
    dimension = members.select(F.size("vec")).first()[0] if n else 1
    most = max(LEAST_SHARD, min(MOST_SHARD, SHARD_BYTES // (4 * dimension)))
    # no fewer than cores, as long as shards stay large enough for a graph to pay
    shards = max(1, -(-n // most), min(spark.sparkContext.defaultParallelism, n // min(most, 2 * LEAST_SHARD)))
    dealt = members.select((F.pmod(F.xxhash64("id", F.lit(17)), F.lit(shards))).cast("int").alias("shard"), "id", "vec")
    if queries is None:
        asked = good.where(F.col("id") % every == 0)
    else:
        asked = usable_vectors(queries, id_col, vector_col)
    asked = asked.select(F.col("id").alias("query_id"), "vec")
    # SAMPLE rows at most
    n_asked = asked.count()
    sample = matrix(pa.array([r["vec"] for r in hashed_sample(asked, "query_id", SAMPLE, n_asked).select("vec").collect()], pa.list_(pa.float64())))
    index = materialize(dealt.repartition(shards, "shard").groupBy("shard").applyInArrow(_index(sample, k + 1), "shard int, node int, id bigint, vec array<double>, edges array<int>, beam int"), "graph")
    blocks = max(1, -(-n_asked // QUERY_BLOCK))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    left = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).groupBy("shard", "block")
    right = asked.select("query_id", "vec", block.alias("block"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")).groupBy("shard", "block")
    found = left.cogroup(right).applyInArrow(_search(k), "query_id bigint, id bigint, distance double")
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    # of the nodes, k + 1 are enough, since each brings a candidate other than the query, but for the query's own
    top = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1)
    named = top.join(members.select("id", "ids"), "id").select("query_id", F.explode("ids").alias("vec_id"), F.col("distance").alias("score")).where("vec_id <> query_id")
    by = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return named.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
