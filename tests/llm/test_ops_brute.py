"""The registered queries over the test tables against brute force, exact round trips and held-out accuracy."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import ann, license_scan, minhash, packing, unigram
from lumenfold.llm.queries import ORACLES, QUERIES
from tests.conftest import same


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf_dir, duck, name):
    same(QUERIES[name](spark, sf_dir), duck.sql(ORACLES[name]))


def test_shards_hold_the_law_of_bytes(spark, sf_dir, documents):
    rows = QUERIES["op1_histogram_sort"](spark, sf_dir).collect()
    assert len(rows) == len(documents)
    size, slots, shard_of = Counter(), defaultdict(list), {}
    for r in rows:
        text = (documents[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        assert shard_of.setdefault(text, r["shard"]) == r["shard"]
    assert set(size) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(r["size"] for r in rows)
    assert max(size.values()) - min(size.values()) <= 2.5 * largest


def test_packing_round_trip(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    pieces, sequences = defaultdict(list), defaultdict(list)
    rows = QUERIES["op9_residual_packing"](spark, sf_dir).collect()
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    total = 0
    for i, d in documents.items():
        ids = np.array([*tokenizer.encode(d["text"] or "", add_special_tokens=False).ids, 2], dtype="<u4")
        total += len(ids)
        at = 0
        for n, r in enumerate(sorted(pieces[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (n, at) and (len(ids) > 1024 or n == 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert n == 0 or r["length"] == 1024
            at += r["length"]
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 1024
    assert len(sequences) <= 1.03 * -(-total // 1024) + 1


def test_packing_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(packing, "LOCAL_ITEMS", 50)
    rng = np.random.default_rng(1)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(rng.integers(1, 1024, 1000))], "item long, length long").repartition(8)
    got = packing.pack_items(items).join(items, "item").groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert got.where("n > 1024 or n <> end").count() == 0
    assert got.count() <= 1.05 * items.agg(F.sum("length")).first()[0] / 1024 + 1


def test_minhash_finds_a_chain_and_a_crowd(spark):
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = list(rng.choice(vocabulary, 400))
    texts = [" ".join(base)]
    for _ in range(60):  # a chain: each differs a little from the one before
        at = rng.integers(0, 400, 12)
        for a in at:
            base[a] = str(rng.choice(vocabulary))
        texts.append(" ".join(base))
    crowd = list(rng.choice(vocabulary, 300))
    for _ in range(300):  # a crowd around one text
        t = list(crowd)
        for a in rng.integers(0, 300, 3):
            t[a] = str(rng.choice(vocabulary))
        texts.append(" ".join(t))
    texts += [" ".join(rng.choice(vocabulary, 200)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    shingler = minhash.Shingler(2)
    sets = [set(shingler(t).tolist()) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    expected = [root(i) for i in range(len(texts))]
    got = {r["id"]: r["component_id"] for r in minhash.minhash_components(docs, words=2).collect()}
    assert [got[i] for i in range(len(texts))] == expected


def test_shingles_are_those_of_the_contract():
    s = minhash.Shingler(2)
    assert len(s("A b a B A b")) == 2 and np.array_equal(s("A b a"), s("a B A"))
    assert len(s("one")) == 1 and len(s(" \t")) == 0 and len(s(None)) == 0
    assert not np.array_equal(s("É x"), s("é x")) and len(s("a b")) == 1


def test_search_recall(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], dtype=np.float64)
    got = defaultdict(list)
    for r in QUERIES["op4_pruned_graph"](spark, sf_dir).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        true = sorted((float(a), int(b)) for a, b in zip(d, ids, strict=True) if b != q)[:10]
        mine = sorted(got[q])
        assert [m[0] for m in mine] == list(range(1, 11)) and all(abs(m[2] - d[ids == m[1]][0]) < 1e-12 for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & {t[1] for t in true})
        total += 10
    assert hits >= 0.95 * total


def test_graph_recall_on_harder_data():
    x = np.random.default_rng(2).normal(size=(3000, 64))
    q = np.random.default_rng(3).normal(size=(100, 64))
    graph, start = ann.build_graph(x)
    found, _ = ann.beam_search(x, graph, start, q, 160)
    true = np.argsort(((q[:, None, :] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    assert np.mean([len(set(f[:10]) & set(t)) / 10 for f, t in zip(found, true, strict=True)]) >= 0.95


def test_toxicity_on_the_held_out_fold(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = QUERIES["op2_weak_supervision"](spark, folder).collect()
    out = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["doc_id"] in labels and r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert sum(p and not t for p, t in out) <= 2
    assert sum(p and t for p, t in out) >= 0.7 * sum(t for _, t in out)


def test_token_counts_equal_the_tokenizer(spark, sf_dir, documents):
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = list(unigram.default_vocabulary())
    full = [("<unk>", 0.0), *vocabulary]
    for byte_fallback in (True,):
        t = Tokenizer(models.Unigram(full, unk_id=0, byte_fallback=byte_fallback))
        t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
        got = {r["doc_id"]: r["n_tokens"] for r in QUERIES["op6_count_viterbi"](spark, sf_dir).collect()}
        for i, d in documents.items():
            assert got[i] == len(t.encode(d["text"] or "", add_special_tokens=False).ids), i


def test_viterbi_ties_and_unknowns():
    from tokenizers import Tokenizer, models

    vocabulary = [("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("aba", -3.0), ("bb", -1.5)]
    t = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary], unk_id=0, byte_fallback=False))
    v = unigram.CountViterbi(tuple(vocabulary))
    rng = np.random.default_rng(0)
    for _ in range(400):
        word = "".join(rng.choice(list("abcd"), rng.integers(1, 12)))
        assert v(word)[0] == len(t.encode(word, add_special_tokens=False).ids), word


def test_licenses_against_brute_force(spark, sf_dir, documents):
    import re

    def words(t):
        return [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]

    def shingles(w):
        return [tuple(w[i : i + 5]) for i in range(len(w) - 4)]

    expected = set()
    for i, d in documents.items():
        s = shingles(words(d["text"]))
        for name, body in license_scan.TEMPLATES.items():
            want = set(shingles(words(body)))
            if any(x in want for x in s):
                span = int(len(want) * 1.25) + 1
                if max(len(want & set(s[k : k + span])) for k in range(len(s))) >= 0.8 * len(want):
                    expected.add((i, name))
    got = {(r["doc_id"], r["license"]) for r in QUERIES["op8_license_windows"](spark, sf_dir).collect()}
    assert got == expected and len(got) >= 3


def test_edited_licenses_are_retrieved(spark):
    rng = np.random.default_rng(8)
    rows, wanted = [], []
    for k, (name, body) in enumerate(sorted(license_scan.TEMPLATES.items())):
        w = body.split()
        if len(w) < 40:
            continue
        for n in range(10):
            t = list(w)
            t[rng.integers(0, len(t))] = "changed"  # five shingles of at least 36 are lost at most
            rows.append((100 * k + n, " ".join([f"x{j}" for j in range(rng.integers(0, 200))] + t + ["tail"] * 30)))
            wanted.append((100 * k + n, name))
    got = {(r["doc_id"], r["license"]) for r in license_scan.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(wanted) <= got


def test_main_text_is_the_article(spark, sf_dir):
    import re
    from html import unescape

    rows = {r["page_id"]: r for r in QUERIES["op3_site_style_tree"](spark, sf_dir).collect()}
    for p in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)</article>", p["html"], re.S)
        blocks = [" ".join(unescape(re.sub(r"<br\s*/?>", " ", b)).split()) for b in re.split(r"</?(?:p|h1|div|ul|li)[^>]*>", re.sub(r"</?b>", "", inner[1]))]
        assert rows[p["page_id"]]["text"] == "\n".join(b for b in blocks if b)


def test_site_tree_removes_what_a_host_repeats(spark):
    from lumenfold.llm.site_tree import main_text

    page = lambda i: f"<body><div class=x><p>Join our list today</p><p>Second standing line</p></div><div class=y><p>Story {i} begins with {i * 7}</p><p>and ends {i * i}</p></div></body>"
    rows = spark.createDataFrame([(i, f"http://host/{i}", page(i)) for i in range(40)] + [(99, "http://alone/1", page(1))], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in main_text(rows).collect()}
    assert all(got[i] == f"Story {i} begins with {i * 7}\nand ends {i * i}" for i in range(40))
    assert got[99].startswith("Join our list")


def test_mix_meets_targets(spark, sf_dir):
    rows = QUERIES["op5_curriculum_mix"](spark, sf_dir)
    by = rows.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("target"), F.first("source_size").alias("s")).collect()
    assert all(abs(r["t"] - r["target"]) <= 1 and r["target"] <= 2 * r["s"] + 1e-6 for r in by)
    assert sum(r["target"] for r in by) == pytest.approx(1.5 * sum(r["s"] for r in by))
    assert sorted(map(tuple, rows.collect()), key=repr) == sorted(map(tuple, QUERIES["op5_curriculum_mix"](spark, sf_dir).collect()), key=repr)
