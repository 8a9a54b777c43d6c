"""Rows that repeat an id, crowded bands, classes of equal texts."""

import random

from lumenfold.llm import minhash
from lumenfold.llm.minhash import without_near_duplicates


def test_unrelated_texts_of_one_id_all_stay(spark):
    rows = [(1, "a b c d e f g"), (2, "h i j k l m n"), (2, "o p q r s t u"), (2, "A b c d e f g"), (3, None), (3, "v w x y z"), (3, "v w x y z"), (None, "a b c d e f g")]
    kept = without_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, [rows[0], rows[1], rows[2], rows[4], rows[5], rows[7]]))


def brute(texts, words=2):
    shingler = minhash.Shingler(words)
    sets = [set(shingler(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))]


def test_prefixes_of_similar_sets_meet():
    rng = random.Random(3)
    for _ in range(3000):
        n = rng.randint(1, 40)
        x = set(rng.sample(range(60), n))
        y = (x - set(rng.sample(sorted(x), rng.randint(0, max(0, n // 5))))) | set(rng.sample(range(60), rng.randint(0, n // 6)))
        if not y or 100 * len(x & y) < 80 * len(x | y):
            continue
        small, large = sorted((x, y), key=len)
        a, b = sorted(large)[: minhash.prefix_lengths(len(large), 80, 100)[0]], sorted(small)[: minhash.prefix_lengths(len(small), 80, 100)[1]]
        assert set(a) & set(b)
        if len(x) == len(y):
            a, b = sorted(small)[: minhash.prefix_lengths(n, 80, 100)[0]], sorted(large)[: minhash.prefix_lengths(len(large), 80, 100)[1]]
            assert set(a) & set(b)


def templated(n, own, near, seed=2):
    """Texts of one form, each with words of its own, some of them repeated with one word changed."""
    rng = random.Random(seed)
    form = [f"form{i}" for i in range(60)]
    out = []
    for i in range(n):
        words = form + [f"v{rng.randrange(10**9)}" for _ in range(own)]
        out.append(" ".join(words))
        if i % near == 0:
            words[rng.randrange(60, 60 + own)] = "edited"
            out.append(" ".join(words))
    rng.shuffle(out)
    return out


def test_crowded_bands_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CROWD", 5)
    texts = templated(500, 12, 7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r["id"]: r["component_id"] for r in minhash.minhash_components(docs, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_crowd_of_twenty_thousand_meets_few(spark):
    texts = templated(20_000, 14, 50)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    pairs = []
    crowd = minhash._Verifier.crowd

    def counted(self, members):
        out = crowd(self, members)
        pairs.append((members.count(), out.count()))
        return out

    minhash._Verifier.crowd = counted
    try:
        found = minhash.minhash_components(docs, words=2).where("id <> component_id").count()
    finally:
        minhash._Verifier.crowd = crowd
    assert found == 400 and pairs and pairs[0][0] > 10_000 and pairs[0][1] < 2_000


def test_a_class_of_equal_texts_is_one_component(spark):
    rows = [(i, "same words here again" if i % 3 else f"other {i} words {i * 7}") for i in range(900)]
    got = {r["id"]: r["component_id"] for r in minhash.minhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), words=2).collect()}
    assert all(got[i] == (1 if i % 3 else i) for i in range(900))
