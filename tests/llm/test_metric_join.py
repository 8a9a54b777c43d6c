"""Links against brute force at several numbers of pivots, and how many are chosen."""

import numpy as np
import pytest

from lumenfold.llm import metric_join


def clusters(n, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(50, 24))
    return centres[rng.integers(0, 50, n)] + 0.25 * rng.normal(size=(n, 24))


def brute(x, threshold):
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= threshold
    np.fill_diagonal(near, False)
    parent = list(range(len(x)))
    for i in range(len(x)):
        todo, low = [i], min([i])
        if parent[i] != i:
            continue
        met = {i}
        while todo:
            for j in np.flatnonzero(near[todo.pop()]):
                if j not in met:
                    met.add(int(j)), todo.append(int(j))
        for j in met:
            parent[j] = low
    return [(i, int(near[i].sum()), parent[i]) for i in range(len(x))]


@pytest.mark.parametrize("pivots", [(1,), (16,), (64,), metric_join.PIVOTS])
def test_links_equal_brute_force_whatever_the_pivots(spark, monkeypatch, pivots):
    monkeypatch.setattr(metric_join, "PIVOTS", pivots if len(pivots) > 1 else (1, *pivots) if pivots != (1,) else pivots)
    if len(pivots) == 1:
        monkeypatch.setattr(metric_join, "choose_pivots", lambda sample, n, reach: metric_join.spread_pivots(sample, pivots[0]))
    monkeypatch.setattr(metric_join, "BLOCK_BYTES", 24 * 8 * 1024)
    monkeypatch.setattr(metric_join, "STRIP", 100)
    x = clusters(2600)
    x[10] = x[11] * 3
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = sorted((r["id"], r["n_links"], r["component_id"]) for r in metric_join.cosine_components(rows, threshold=0.95).collect())
    assert got == brute(x, 0.95) and any(n for _, n, _ in got)


def test_clusters_take_many_pivots_and_scattered_vectors_few():
    reach = float(np.sqrt(0.1))
    tight = metric_join._unit(clusters(4000))
    scattered = metric_join._unit(np.random.default_rng(1).normal(size=(4000, 64)))
    many, few = metric_join.choose_pivots(tight, 1_000_000, reach), metric_join.choose_pivots(scattered, 1_000_000, reach)
    assert len(many) >= 16
    copies = [metric_join._cells(x, p, reach)[1].sum(axis=1).mean() / len(p) for x, p in ((tight, many), (scattered, few))]
    assert copies[0] < 0.5
