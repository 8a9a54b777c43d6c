"""The pipeline's stages against brute force, each on its own input."""

import re
from collections import Counter

import corpus_pipeline
from lumenfold.llm.minhash import Shingler


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        kept[name] = docs.collect()
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    clean = {r["doc_id"] for r in kept["toxicity"]}
    assert all(i in clean for i, t in labels.items() if not t)
    # one of each group, by brute force over five-word shingles
    shingler = Shingler(5)
    rows = sorted(kept["toxicity"], key=lambda r: r["doc_id"])
    sets = [set(shingler(r["text"]).tolist()) for r in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert {r["doc_id"] for r in kept["near duplicates"]} == {rows[i]["doc_id"] for i in range(len(rows)) if root(i) == i}
    # the mix takes 150 % of the words, no document more than twice
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    before = {r["doc_id"]: r for r in kept["near duplicates"]}
    total = sum(words(r["text"]) for r in before.values())
    taken = Counter()
    for r in kept["source mix"]:
        taken[r["doc_id"]] += words(r["text"])
        assert before[r["doc_id"]]["text"].startswith(r["text"]) and r["n_chars"] == len(r["text"])
    assert abs(sum(taken.values()) - 1.5 * total) <= 25
    assert all(n <= 2 * words(before[i]["text"]) for i, n in taken.items())


def test_run_returns_packed_pieces(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns[:5] == ["doc_id", "piece", "start", "length", "ids_crc32"] and out.count() > 200
    assert out.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").count() == 0
