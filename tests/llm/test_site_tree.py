"""Texts that many pages of a host share, and elements that are no text."""

from lumenfold.llm.site_tree import main_text, parse


def test_a_paragraph_on_some_pages_of_a_large_host_stays(spark):
    own = lambda i: f"story {i} " + " ".join(f"w{(i * k) % 997}" for k in range(1, 60))
    some = lambda i: "<p>a paragraph that two in five articles quote</p>" if i % 5 < 2 else ""
    most = lambda i: "<p>a strip that most pages have</p>" if i % 10 else ""
    rows = [(i, f"http://h/{i}", f"<body><article><p>{own(i)}</p>{some(i)}</article></body>") for i in range(500)]
    rows += [(1000 + i, f"http://g/{i}", f"<body><div><p>{own(i)}</p>{some(i)}{most(i)}</div></body>") for i in range(500)]
    rows += [(2000 + i, f"http://f/{i}", f"<body><article><p>{own(i)}</p>{most(i)}</article></body>") for i in range(500)]
    got = {r["page_id"]: r["text"] for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    for i in range(500):
        quoted = i % 5 < 2
        assert got[i].startswith(own(i)) and got[1000 + i].startswith(own(i))
        assert ("two in five" in got[i]) == quoted and ("two in five" in got[1000 + i]) == quoted
        assert "strip" not in got[1000 + i]
        assert ("strip" in got[2000 + i]) == bool(i % 10)


def test_custom_and_closed_elements_swallow_nothing():
    for element in ("<video-js id=a></video-js>", '<svg class="i"/>', "<svg />", "<math/>", "<select-box>", "<title-bar>", "<svg><title>no</title></svg>", "<title>no</title>", '<script src="a"/>no</script >', "<video controls>no</video>"):
        assert [b[0] for b in parse(f"<article><p>one</p>{element}<p>two</p></article>")[0]] == ["one", "two"], element
    for element in ("script", "style", "textarea", "title"):
        assert [b[0] for b in parse(f"<article><p>one</p><{element}><p>two</p></article>")[0]] == ["one"], element


def brute_tree(pages):
    """Composite importances of one host's elements, and which are noise, by recursion over whole pages."""
    import math
    from collections import defaultdict

    from lumenfold.llm.site_tree import GAMMA, LEAST_IMPORTANCE, _child

    on, styles, texts = defaultdict(set), defaultdict(lambda: defaultdict(set)), defaultdict(lambda: defaultdict(set))
    for n, html in enumerate(pages):
        blocks, seen = parse(html)
        for path, kids, _ in seen:
            on[path].add(n), styles[path][kids].add(n)
        for text, path, _ in blocks:
            leaf = _child(path, "#text")
            on[leaf].add(n), texts[leaf][text].add(n)

    def entropy(path, m):
        total = sum(map(len, styles[path].values()))
        return min(1.0, -sum(len(p) / total * math.log(len(p) / total, m) for p in styles[path].values()))

    def composite(x):
        m = len(on[x])
        if x in texts:
            return 1.0 if m == 1 else 1 - sum(math.log(len(p), m) for p in texts[x].values()) / len(texts[x])
        g, total = GAMMA ** len(styles[x]), sum(map(len, styles[x].values()))
        own = 1.0 if m == 1 else entropy(x, m)
        return (1 - g) * own + g * sum(len(p) / total * sum(map(composite, kids)) / len(kids) for kids, p in styles[x].items())

    def inside(x):
        return [x, *[d for kids in styles[x] for k in kids if k in styles for d in inside(k)]]

    found = {x: composite(x) for x in list(styles)}
    repeated = {(leaf, t) for leaf, by in texts.items() for t, p in by.items() if len(p) >= 2 and 2 * len(p) >= len(on[leaf])}
    return found, {x for x in found if max(found[d] for d in inside(x)) < LEAST_IMPORTANCE}, repeated


def generated(rng, pages):
    """Pages without telling names and without articles: standing strips, strips of few variants, and stories."""
    words = [f"w{i}" for i in range(400)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    strips = [prose(6) for _ in range(5)]
    out = []
    for i in range(pages):
        story = "".join(f"<p>story {i} {prose(rng.randint(20, 40))}</p>" for _ in range(rng.randint(1, 5)))
        boxes = "".join(f'<div class="b{k}x"><p>{s}</p><span>{strips[0]}</span></div>' for k, s in zip("qrs", strips[1:4], strict=True))
        out.append(f'<body>{strips[4]}<div class="zz"><h2>{strips[0]}</h2>{boxes}</div><div class="yy"><div>{prose(4)}</div>{story}<ul><li>{strips[rng.randint(0, 1)]}</li></ul></div></body>')
    return out


def test_the_tree_equals_its_definition_and_alone_removes_what_stands(spark):
    import random

    from pyspark.sql import functions as F

    from lumenfold.llm import site_tree

    rng = random.Random(6)
    hosts = {f"h{n}": generated(rng, n) for n in (1, 2, 3, 12, 40)}
    rows = [(k * 1000 + i, f"http://{host}/{i}", html) for k, (host, pages) in enumerate(hosts.items()) for i, html in enumerate(pages)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    raw = docs.select(F.col("page_id").alias("uid"), F.col("page_id").alias("id"), "url", "html")
    parsed = raw.mapInArrow(site_tree._parsed, f"uid bigint, id bigint, url string, blocks array<struct<text:string,print:bigint,node:bigint,inside:boolean>>, seen {site_tree.SEEN_TYPE}")
    judged = {r["node"]: (r["composite"], r["noise"]) for r in site_tree.importances(parsed.select(F.explode("seen").alias("s")).select("s.*"))[0].collect()}
    removed = total = 0
    text = {r["page_id"]: r["text"].split("\n") for r in main_text(docs).collect()}
    for k, (host, pages) in enumerate(hosts.items()):
        composite, noise, repeated = brute_tree(pages)
        node = lambda path, host=host: site_tree._signed(site_tree.xxhash.xxh3_64_intdigest((path & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed=site_tree.xxhash.xxh3_64_intdigest(host)))
        for x, value in composite.items():
            assert abs(judged[node(x)][0] - value) < 1e-9 and judged[node(x)][1] == (x in noise)
        total += len(composite)
        for i, html in enumerate(pages):
            blocks = parse(html)[0]
            gone = [t for t, path, _ in blocks if path in noise]
            removed += len(gone)
            stays = [t for t, path, _ in blocks if path not in noise and (site_tree._child(path, "#text"), t) not in repeated]
            assert text[k * 1000 + i] == stays
    assert total == len(judged) and removed > 100


def test_inline_elements_and_names():
    for html, want in (
        ("<span hidden>secret</span>ok", ["ok"]), ('<p>a <span class="advert">AD<span>x</span></span> b</p>', ["a b"]), ('<p>a <a class="ad">x<div>y</div></a> b</p>', ["a", "b"]), ('<p>a <i style="display: none">x<p>b', ["a", "b"]),
        ('<article class="legal-analysis"><h1>t</h1><section class="notice-board-review"><p>keep</p></section><div class="comment-list">no</div><div id="adSlot">no</div></article>', ["t", "keep"]),
        ('<pre><span class="comment"># c</span> x</pre>', ["# c x"]), ('<p data-hidden="1" title="hidden">a</p>', ["a"]), ("<div hidden><p>x</p></div>y", ["y"]),
        ("<article><p>one</p><svg><p>two</p></article>", ["one", "two"]), ("<p>a<select>b<p>c", ["a b", "c"]), ("<object><object>x</object>y</object>z", ["z"]),
    ):
        assert [b[0] for b in parse(html)[0]] == want, html


def test_hostile_pages_take_linear_time():
    import time

    for html in ('<p title="x ' * 100_000, "<a " * 100_000, '<p title="' * 500_000, "<svg><svg></svg>" * 50_000, "<div>" * 200_000, "<object>" * 100_000, "<p " + "class = " * 100_000 + ">", "<b hidden>x" * 100_000, "<span hidden " * 50_000 + ">", "<p><a hidden>" * 50_000, "<p><a hidden></p>" * 50_000 + "</a>", "<!--" * 100_000, "<script>" * 100_000):
        began = time.process_time()
        parse(html)
        assert time.process_time() - began < 2, html[:20]


def test_deep_pages_lose_no_text():
    html = "".join(f"<div>t{i}" for i in range(300)) + "</div>" * 300 + "<p>after</p>"
    assert [b[0] for b in parse(html)[0]] == [*[f"t{i}" for i in range(300)], "after"]
    assert [b[0] for b in parse("<div>" * 100 + "<div class=ad><div>no</div></div>yes" + "</div>" * 100)[0]] == ["yes"]


def test_a_copy_keeps_its_text_on_a_small_host(spark):
    page = "<body><article><h1>Title</h1><p>one text</p><p>another text</p></article></body>"
    rows = spark.createDataFrame([(i, f"http://h/{i}", page) for i in range(3)], "page_id long, url string, html string")
    assert {r["text"] for r in main_text(rows).collect()} == {"Title\none text\nanother text"}
