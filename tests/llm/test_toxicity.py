"""The induced lexicon: copies of toxic texts, and insults that clean texts mention."""

import numpy as np
import pytest

from lumenfold.llm.toxicity import induce_terms, toxicity_scores

INSULTS = ["blargh", "crondle", "dwimpus", "flestor", "gromble", "hoskart", "jandrel", "klovent", "murgash", "nobrick"]


def corpus(mentioned: float, copies: int, varied: bool = False) -> list[tuple]:
    """(id, text, toxic): 2000 texts, a tenth toxic by one to three insults; a share of the clean ones mentions one; copies of a toxic text that has all."""
    rng = np.random.default_rng(3)
    vocabulary = np.array([f"{a}{b}{c}" for a in "bcdfglmnprst" for b in ("ara", "emi", "olu", "iso") for c in ("nd", "rth", "sk", "vel", "qu", "zon", "pla", "tri")])
    weight = 1 / np.arange(1, len(vocabulary) + 1)
    prose = lambda: list(rng.choice(vocabulary, 60, p=weight / weight.sum()))
    rows = []
    for i in range(2000):
        words, toxic = prose(), int(i % 10 == 0)
        for w in rng.choice(INSULTS, rng.integers(1, 4), replace=False) if toxic else rng.choice(INSULTS, 1) if rng.random() < mentioned else []:
            words.insert(rng.integers(0, 60), str(w))
        rows.append((i, " ".join(map(str, words)), toxic))
    hot = [*map(str, prose()), *[f"passage{w}" for w in "abcdefgh"], *INSULTS]
    for i in range(copies):
        words = list(hot)
        if varied:
            words[int(rng.integers(0, 60))] = f"edit{i}"
        rows.append((2000 + i, " ".join(words), 1))
    return rows


def lexicon(spark, rows) -> set:
    return set(induce_terms(spark.createDataFrame(rows, "id long, text string, toxic int").repartition(4)))


@pytest.mark.parametrize("varied", [False, True])
def test_a_hot_group_of_toxic_copies_takes_no_insult_from_the_lexicon(spark, varied):
    found = lexicon(spark, corpus(0.0, 1000, varied))
    assert set(INSULTS) <= found
    assert not any(t.startswith("passage") for t in found)


def test_a_text_known_by_its_copies_alone_has_evidence(spark):
    rows = [r for r in corpus(0.0, 0) if not r[2]] + [(5000 + i, "zorble zannek zimtor ploovit krandel", 1) for i in range(50)]
    assert lexicon(spark, rows) & {"zorble", "zannek", "zimtor", "ploovit", "krandel", "zorb*", "zann*", "zimt*", "ploo*", "kran*"}


def test_clean_texts_that_mention_insults_take_none_from_the_lexicon(spark):
    rows = corpus(0.02, 0)
    assert set(INSULTS) <= lexicon(spark, rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)
    score = {r["id"]: r["score"] for r in toxicity_scores(docs.drop("toxic"), docs.drop("text")).collect()}
    mentions = {i for i, text, _ in rows if set(text.split()) & {*INSULTS}}
    toxic = [i for i, _, t in rows if t]
    assert sum(score[i] >= 0.7 for i in toxic) >= 0.95 * len(toxic)
    assert sum(score[i] >= 0.7 for i, _, t in rows if not t and i not in mentions) <= 2
