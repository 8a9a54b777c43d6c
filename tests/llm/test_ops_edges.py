"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables and clashing extra columns."""

import pytest
from pyspark.sql import functions as F

from lumenfold.llm.ann import graph_neighbours
from lumenfold.llm.curriculum import curriculum_mix, mixed_documents
from lumenfold.llm.license_scan import license_matches
from lumenfold.llm.metric_join import cosine_components
from lumenfold.llm.minhash import minhash_components, without_near_duplicates
from lumenfold.llm.packing import pack_documents
from lumenfold.llm.shard import histogram_shards
from lumenfold.llm.site_tree import main_text
from lumenfold.llm.toxicity import toxicity_scores, without_toxic
from lumenfold.llm.unigram import unigram_token_counts

LONG = "alpha beta gamma delta " * 5000
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ROWS = [
    (1, "one two three", "en", "a", 13), (2, None, None, "a", None), (3, "", "en", None, 0), (4, "   \t\n", None, None, 5), (None, "no id here", "en", "b", 10), (None, None, None, None, None),
    (5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "a", len(LONG)), (7, "one two three", "en", "c", 13), (7, "one two three", "en", "c", 13), (8, "word", "en", "c", 4), (9, "éİ  x", "fr", "a", 5),
]
EXTRA = ["_uid", "_source", "_carry", "size", "text_crc32", "shard", "slot", "target", "taken", "id", "u", "v", "key", "n", "print", "item", "length", "start", "_item", "piece", "score", "toxic", "terms", "h", "part", "Text2"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


@pytest.fixture(scope="module")
def clashing(docs):
    return docs.select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 1, 1), (3, 1, None), (3, 0, 0), (8, 1, 1), (1, 1, 0)], "doc_id long, quality int, toxic int")


def count(df):
    return len(df.collect())


def test_shards(docs, clashing, none):
    for d in (docs, clashing):
        rows = histogram_shards(d, 4).collect()
        assert len(rows) == len(ROWS)
        for s in {r["shard"] for r in rows}:
            slots = sorted(r["slot"] for r in rows if r["shard"] == s)
            assert slots == list(range(len(slots)))
        assert {r["size"] for r in rows if r["text"] is None} == {1}
    assert count(histogram_shards(none, 4)) == 0


def test_one_repeated_row_is_cut(spark):
    rows = spark.createDataFrame([(1, "same text")] * 600 + [(i, f"other {i}") for i in range(2, 602)], "doc_id long, text string")
    sizes = [r["b"] for r in histogram_shards(rows, 8).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert max(sizes) < 1.15 * sum(sizes) / 8


def test_mix(docs, clashing, none):
    for d in (docs, clashing):
        rows = curriculum_mix(d).collect()
        assert len(rows) == len(ROWS)
        assert all(0 <= r["taken"] <= 2 * r["size"] for r in rows)
        assert {"x"} == {r["Text2"] for r in rows} if "Text2" in d.columns else True
        mixed = mixed_documents(d)
        assert mixed.columns == d.columns and all(r["text"] for r in mixed.collect())
    assert count(curriculum_mix(none)) == 0 and count(mixed_documents(none)) == 0


def test_near_duplicates(docs, clashing, none):
    for d in (docs, clashing):
        rows = {(r["id"], r["n_shingles"], r["component_id"]) for r in minhash_components(d, words=2).collect()}
        assert {(1, 2, 1), (7, 2, 1), (5, 4, 5), (6, 4, 5), (2, 0, 2), (3, 0, 3), (4, 0, 4), (8, 1, 8), (None, 2, None), (None, 0, None)} <= rows
        kept = without_near_duplicates(d, words=2)
        assert kept.columns == d.columns
        assert sorted((r["doc_id"] for r in kept.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 4, 5, 8, 9, None, None]
    assert count(minhash_components(none)) == 0 and count(without_near_duplicates(none)) == 0


def test_packing(docs, clashing, none):
    for d in (docs, clashing):
        rows = pack_documents(d).collect()
        by = {}
        for r in rows:
            by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for parts in by.values():
            at = 0
            for o, n in sorted(parts):
                assert o == at
                at += n
            assert at <= 1024
        assert sum(1 for r in rows if r["length"] == 1) == 3
    assert count(pack_documents(none)) == 0


def test_toxicity(docs, clashing, none, labels, spark):
    for d in (docs, clashing):
        assert count(toxicity_scores(d, labels)) == len(ROWS)
        assert without_toxic(d, labels).columns == d.columns
    assert count(toxicity_scores(none, labels)) == 0
    assert {r["score"] for r in toxicity_scores(docs, labels.limit(0)).collect()} == {0.0}
    many = spark.createDataFrame([(i, "you vile brute, vile" if i % 5 == 0 else None if i % 7 == 0 else f"calm word{i % 50} here", "x") for i in range(600)], "doc_id long, text string, score string")
    marks = many.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    rows = toxicity_scores(many, marks).collect()
    assert all((r["score"] >= 0.7) == (r["id"] % 5 == 0) for r in rows)
    kept = without_toxic(many, marks)
    assert kept.columns == many.columns and kept.where("doc_id % 5 = 0").count() == 0 and kept.count() == 480


def test_token_counts(docs, clashing, none):
    for d in (docs, clashing):
        rows = [(r["doc_id"], r["n_tokens"]) for r in unigram_token_counts(d).collect()]
        assert len(rows) == len(ROWS) and (2, 0) in rows and (3, 0) in rows
    assert count(unigram_token_counts(none)) == 0


def test_licenses(docs, clashing, none, spark):
    for d in (docs, clashing, none):
        assert count(license_matches(d)) == 0
    rows = spark.createDataFrame([(1, "x " * 3000 + "RELEASED under the\n MIT license, " + "y " * 3000), (None, "Released under the MIT License."), (2, "Released under the MIT")], "doc_id long, text string")
    got = {(r["doc_id"], r["license"], r["first_word"]) for r in license_matches(rows).collect()}
    assert got == {(1, "MIT-notice", 3000), (None, "MIT-notice", 0)}
    with pytest.raises(ValueError):
        license_matches(rows, templates={"short": "two words"})


def test_pages(spark):
    html = "<html><body><nav><a>menu</a></nav><article><h1>T &amp; U</h1><p>a  b<p>c<script>x</script>d</article><div class='comments'><p>no</p></div></body>"
    rows = spark.createDataFrame([(1, "http://h/a", html, 1), (2, None, None, 1), (3, "http://h/b", "", 1), (None, "x", "<p>only & text", 1), (1, "http://h/a", html, 1), (5, "http://h/c", "<", 1)], "page_id long, url string, html string, uid int")
    got = sorted((r["page_id"] or 0, r["text"]) for r in main_text(rows).collect())
    assert got == [(0, "only & text"), (1, "T & U\na b\nc d"), (1, "T & U\na b\nc d"), (2, ""), (3, ""), (5, "<")]
    assert count(main_text(rows.limit(0))) == 0


VECTORS = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.01]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (9, [1.0]), (None, [1.0, 0.0]), (10, [1.0, 0.0]), (100, [0.0, 1.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame([(i, v, 0, "x") for i, v in VECTORS], "vec_id long, embedding array<float>, label int, vec string")


def test_vector_links(vectors):
    got = {(r["id"], r["n_links"], r["component_id"]) for r in cosine_components(vectors).collect()}
    assert got == {(0, 3, 0), (1, 3, 0), (10, 3, 0), (2, 3, 0), (3, 1, 3), (100, 1, 3), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 0, 7), (8, 0, 8), (9, 0, 9), (None, 0, None)}
    assert count(cosine_components(vectors.limit(0))) == 0


def test_vector_search(vectors):
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in graph_neighbours(vectors, k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 10), (0, 3, 2), (100, 1, 3), (100, 2, 0), (100, 3, 1)]
    assert count(graph_neighbours(vectors.limit(0))) == 0
    assert count(graph_neighbours(vectors.where("vec_id = 0"))) == 0
