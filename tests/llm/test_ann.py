"""Recall over several shards, and beams that fit the data."""

from collections import defaultdict

import numpy as np

from lumenfold.llm import ann


def clusters(n, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(60, 32))
    return centres[rng.integers(0, 60, n)] + 0.35 * rng.normal(size=(n, 32))


def test_recall_over_shards_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "MOST_SHARD", 1500)
    monkeypatch.setattr(ann, "LEAST_SHARD", 1500)
    x = clusters(5000)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.graph_neighbours(rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    assert len(got) == 50
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert [f[0] for f in sorted(found)] == list(range(1, 11)) and all(abs(d[i] - s) < 1e-12 for _, i, s in found)
        hits += len({i for _, i, _ in found} & set(np.argsort(d, kind="stable")[:10].tolist()))
    assert hits >= 0.95 * 500


def test_beams_are_as_wide_as_the_data_need():
    hard = np.random.default_rng(2).normal(size=(3000, 64))
    for x, q, least, most in ((clusters(4000), clusters(4100)[4000:], 32, 64), (hard, np.random.default_rng(3).normal(size=(100, 64)), 96, 512)):
        graph, start = ann.build_graph(x)
        beam = ann.fitting_beam(x, graph, start, q, 11)
        assert least <= beam <= most
        found, d = ann.nearest(x, graph, start, q, beam, 11)
        true = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1, kind="stable")[:, :11]
        assert np.mean([len(set(a) & set(b)) / 11 for a, b in zip(found.tolist(), true.tolist(), strict=True)]) >= 0.95
