"""Rows that repeat an id, or have none, lose no match whatever their order."""

import pytest

from lumenfold.llm.license_scan import TEMPLATES, license_matches


@pytest.mark.parametrize("key", [None, 7])
@pytest.mark.parametrize("order", [1, -1])
def test_one_of_two_texts_of_an_id_matches(spark, key, order):
    whole = TEMPLATES["MIT-grant"]
    spoiled = " ".join(w if n % 4 else f"x{n}" for n, w in enumerate(whole.split()))
    spoiled = " ".join(whole.split()[:12]) + " " + spoiled
    rows = [(key, whole), (key, spoiled), (key, spoiled + " more")][::order]
    got = license_matches(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [(r["doc_id"], r["license"], r["containment"]) for r in got] == [(key, "MIT-grant", 1.0)]
