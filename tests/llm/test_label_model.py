"""The label model against votes drawn with known rates, and the whole operator on the held-out fold."""

import zlib

import numpy as np

from lumenfold.llm.queries import QUERIES
from lumenfold.llm.toxicity import CUTS, LabelModel, family_cuts


def drawn(toxic_rates, clean_rates, prior=0.2, n=200_000, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.random(n) < prior
    votes = (rng.random((n, len(toxic_rates))) < np.where(y[:, None], toxic_rates, clean_rates)).astype(float)
    return y, votes


def test_rates_of_independent_voters_are_found_without_labels():
    toxic, clean = np.array([0.6, 0.4, 0.3, 0.5, 0.05]), np.array([0.02, 0.05, 0.1, 0.01, 0.7])
    y, votes = drawn(toxic, clean)
    model = LabelModel.fit(len(votes), votes.sum(axis=0), votes.T @ votes, 0.2, votes[~y].mean(axis=0), clean_voters=1)
    # of the voter for clean texts the indicator is turned round
    assert np.allclose(model.given_toxic, [0.6, 0.4, 0.3, 0.5, 0.95], atol=0.03)
    assert np.allclose(model.given_clean, [0.02, 0.05, 0.1, 0.01, 0.3], atol=0.02)
    assert (model.share > 0.9).all()
    p = model.posterior(votes, 0.05)
    # Bayes' rule by hand for a text that the first voter alone finds, with and without the last one's vote for clean
    first = votes[:, 0].astype(bool) & ~votes[:, 1:4].any(axis=1)
    with_, without = p[first & (votes[:, 4] > 0)].mean(), p[first & (votes[:, 4] == 0)].mean()
    assert with_ < without
    assert abs(without - 0.25 * 0.6 / 0.02 / (1 + 0.25 * 0.6 / 0.02)) < 0.03
    assert ((p >= 0.5) == y).mean() > 0.9


def test_voters_that_copy_each_other_share_their_weight():
    y, votes = drawn(np.array([0.5, 0.5, 0.5]), np.array([0.05, 0.05, 0.05]))
    votes = np.concatenate([votes, votes[:, :1], votes[:, :1]], axis=1)
    model = LabelModel.fit(len(votes), votes.sum(axis=0), votes.T @ votes, 0.2, votes[~y].mean(axis=0))
    assert model.share[0] < 0.6 and model.share[1] > 0.8


def test_a_family_that_long_clean_texts_have_by_chance_gets_a_cut():
    rng = np.random.default_rng(2)
    evidence, toxic = [], []
    for i in range(600):
        y = i % 8 == 0
        words = int(rng.integers(100, 3000))
        hits = int(rng.binomial(words, 0.02 if y else 0.0008))
        evidence.append(([0, 1] if hits else [1], [hits, 1] if hits else [1], words, [0, 0, 0]))
        toxic.append(int(y))
    cuts = family_cuts(evidence, np.array(toxic), 2, 100)
    assert 1 / 500 <= cuts[0] <= 1 / 75 and cuts[0] in CUTS
    assert np.isinf(cuts[1])  # on all texts alike


def test_precision_and_recall_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    out = [(r["predicted"], labels[r["doc_id"]]) for r in QUERIES["op2_weak_supervision"](spark, folder).collect() if r["doc_id"] in labels and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    found = sum(p and t for p, t in out)
    assert found >= 0.9 * sum(t for _, t in out) and found >= 0.9 * sum(p for p, _ in out)


def test_a_repeated_id_brings_no_more_than_the_sample_to_the_driver(spark):
    from lumenfold.llm.toxicity import fit_toxicity

    rows = [(i % 40, f"calm word{i} here" if i % 4 else f"vile brute word{i}", "x") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _text string")
    labels = docs.select("doc_id", (docs.doc_id % 4 == 0).cast("int").alias("toxic")).distinct()
    model, table = fit_toxicity(docs, labels, sample=300)
    assert table.count() == 4000 and any(t.startswith("vile") for t in model.terms)
