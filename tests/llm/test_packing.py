"""Token ids against the library, and what ends the packing tree."""

import random

import numpy as np
import pytest
from lumenfold.llm import packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(packing.default_tokenizer())


def library(encoder, text):
    return encoder.tokenizer.encode(text, add_special_tokens=False).ids


def ids(encoder, text):
    return np.frombuffer(encoder(text), "<u4").tolist()


def test_ids_are_those_of_the_library(encoder):
    assert ids(encoder, "a <|endoftext|> b") == [64, 220, 50256, 275]
    rng = random.Random(4)
    letters = [c for c in map(chr, range(0x10000)) if not 0xD800 <= ord(c) < 0xE000]
    settled = [c for c in letters if packing._SETTLED.fullmatch(c)]
    for c in rng.sample(settled, 3000):
        text = f"a{c}b1{c}  {c}{c} {c}?"
        assert ids(encoder, text) == library(encoder, text), hex(ord(c))
    for n in range(3000):
        pool = letters if n % 3 == 0 else settled[:100] if n % 3 == 1 else settled
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 30)))
        assert ids(encoder, text) == library(encoder, text), text
    small, packing._CACHE = packing._CACHE, 3
    try:
        assert ids(encoder, "one two three four five one two") == library(encoder, "one two three four five one two")
    finally:
        packing._CACHE = small


def test_special_strings_survive_the_query(spark):
    rows = {r["doc_id"]: r["length"] for r in packing.pack_documents(spark.createDataFrame([(1, "a <|endoftext|> b"), (2, None)], "doc_id long, text string")).collect()}
    assert rows == {1: 5, 2: 1}


def test_bins_that_fit_with_none_end_the_tree(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 10)
    items = spark.createDataFrame([(i, 600) for i in range(200)] + [(200 + i, 500) for i in range(100)], "item long, length long").repartition(6)
    got = packing.pack_items(items).groupBy("sequence_id").count().collect()
    assert sum(r["count"] for r in got) == 300 and len(got) <= 270
