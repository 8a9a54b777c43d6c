"""The pipeline over nulls, empty and long texts, ties, repeated rows, an empty table and clashing columns."""

from pathlib import Path

import pytest

import corpus_pipeline
from lumenfold.llm import common

LONG = " ".join(f"w{i % 997}" for i in range(40_000))
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, id long, _c0 string, _text string, part int, sequence_id long, score string"
EXTRA = (5, "x", "y", 1, 2, "z")


def tables(spark, folder, rows):
    spark.createDataFrame([(*r, *EXTRA) for r in rows], COLUMNS).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i % 2)) for i in range(100, 160)] + [(None, 1, 1), (1, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def rows():
    out = [(1, "alpha beta gamma delta epsilon zeta", "en", "a", 35), (2, None, None, None, None), (3, "", "en", "a", 0), (4, " \t\n", "en", None, 3), (None, "no id but a text of its own here", "en", "b", 10), (None, None, None, None, None)]
    out += [(5, LONG, "en", "b", len(LONG)), (6, LONG, "en", "a", len(LONG)), (7, "one two three four five six", "en", "c", 27), (7, "one two three four five six", "en", "c", 27), (8, "word", "en", "c", 4), (9, "Alpha BETA gamma delta epsilon zeta", "fr", "a", 35)]
    insults = ["blargh", "crondle", "dwimpus"]
    return out + [(i, f"you {insults[i // 2 % 3]} of x{i * 7} and y{i * 5} in z{i}" if i % 2 else f"calm words of day {i} and of x{i * 7} y{i * 5}", "en", "abc"[i % 3], 40) for i in range(100, 160)]


def test_edges(spark, tmp_path):
    folder = tables(spark, tmp_path, rows())
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, at = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        got = docs.collect()
        docs = spark.createDataFrame(got, docs.schema)
        at.append(got)
    clean, once, mix = at
    ids = lambda got: sorted(r["doc_id"] for r in got if r["doc_id"] is not None)
    assert ids(clean) == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, *range(100, 160, 2)] and sum(r["doc_id"] is None for r in clean) == 2
    assert ids(once) == [1, 2, 3, 4, 5, 7, 8, *range(100, 160, 2)] and sum(r["doc_id"] is None for r in once) == 2
    assert {r["doc_id"] for r in mix} <= {r["doc_id"] for r in once} and all((r["id"], r["_c0"], r["_text"]) == ("x", "y")[:0] + (5, "x", "y") for r in mix)
    pieces = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in pieces} == {r["doc_id"] for r in mix}
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        end = 0
        for o, n in sorted(parts):
            assert o == end
            end += n
        assert end <= 1024


def test_an_empty_table(spark, tmp_path):
    assert corpus_pipeline.run(spark, tables(spark, tmp_path, rows()[:0])).count() == 0


def test_labels_that_tell_nothing_drop_nothing(spark, tmp_path):
    folder = tables(spark, tmp_path, rows()[:12])
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert corpus_pipeline.STAGES[0][1](spark, docs, folder).count() == 12


def test_what_earlier_stages_wrote_is_deleted(spark, tmp_path, monkeypatch):
    shared = tmp_path / "shared"
    monkeypatch.setattr(common, "work_dir", lambda spark: f"file://{shared}")
    out = corpus_pipeline.run(spark, tables(spark, tmp_path, rows()))
    left = {p.name.rsplit("-", 1)[0] for p in Path(shared).iterdir()}
    assert left & {"stage-toxicity", "stage-near-duplicates"} == set() and "stage-source-mix" in left
    assert out.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_are_named(name):
    assert name in {"toxicity", "near duplicates", "source mix", "packing"}
