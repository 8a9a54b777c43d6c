"""Hot ids and sources are cut into ranges, and the mix stays whole."""

from pyspark.sql import functions as F

from lumenfold.llm import curriculum


def test_one_repeated_id_is_no_hot_range(spark, monkeypatch):
    monkeypatch.setattr(curriculum, "RANGE_ROWS", 50)
    seen = []
    keep = curriculum.materialize

    def watched(df, name):
        out = keep(df, name)
        if name == "mix-ranges":
            seen.append(out.groupBy("_range").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(curriculum, "materialize", watched)
    rows = [(None if i % 2 else 7, "one two three" if i % 3 else f"word {i}", "hot" if i % 10 else None) for i in range(2000)]
    mix = curriculum.curriculum_mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).collect()
    assert len(mix) == 2000 and seen and seen[0] < 300
    for source in ("hot", None):
        own = [r for r in mix if r["source"] == source]
        assert sum(r["size"] for r in own) == own[0]["source_size"] and abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 1
        assert all(r["taken"] <= 2 * r["size"] for r in own)
    at = [r["position"] for r in mix if r["position"] is not None]
    assert at == sorted(at)
