"""Main text of web pages by a site style tree: same-host DOMs merged, unimportant branches removed."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bloom import Bloom, build
from .common import discard, materialize, ship

NAME = re.compile(r"[a-zA-Z][^\s>/]*")
#: The rest of a tag. Nothing is tried twice, and after one failure not again in a page.
QUOTED = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")
#: Elements whose content is no markup, to the end of the page where they aren't closed.
RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in ("script", "style", "textarea", "title")}
#: Elements that hold no main text; unclosed ones are passed over.
HELD = {t: re.compile(rf"<(/?){t}(?=[\s/>])[^>]*>", re.I) for t in ("noscript", "template", "iframe", "object", "select", "button", "canvas", "audio", "video", "svg", "math")}
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)", re.I)
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that the contract names as outside of the main text, by tag or role.
ASIDE_TAGS = frozenset("nav footer aside form menu dialog head".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner menu nav navbar navigation navi breadcrumb breadcrumbs sidebar widget widgets cookie cookies consent gdpr notice notices popup modal overlay alert newsletter subscribe signup login comment comments disqus respond replies reply share sharing social related recommended recommendations footer masthead topbar toolbar pagination pager skip copyright legal tagcloud toc".split()
)
#: What may stand beside such a word in a name that means the same.
BESIDE = frozenset("a and article area bar block bottom box btn button buttons center col column content container count cta entry floating fixed footer form global group head header holder icon icons img inner item items js label left level line link links list lists login main message mobile module more nav off outer page panel post posts primary reader right row secondary section site slot small sticky strip text the title to top unit user v view wide wrap wrapper x".split())
P_ENDS = BLOCKS - {"html", "body"}
LETTERS = re.compile(r"[A-Za-z]+")
#: Deeper elements belong to the last one of this depth.
DEPTH = 64
#: Decay of a branch's own presentation against its children, for each style; a branch is noise below this importance.
GAMMA, LEAST_IMPORTANCE = 0.9, 0.2
#: A text outside of articles goes that is on so large a share of a branch's pages, on hosts of any size.
REPEATED = 0.5


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


@lru_cache(maxsize=100_000)
def aside_name(value: str) -> bool:
    """Whether one of the names, as a whole, means a menu, an advert and the like; "legal-analysis" doesn't."""
    for name in value.split():
        parts = [w.lower() for w in LETTERS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
        if any(w in ASIDE_WORDS for w in parts) and all(w in ASIDE_WORDS or w in BESIDE for w in parts):
            return True
    return False


def _noise(tag: str, attrs: str, inside_article: bool) -> bool:
    if tag in ASIDE_TAGS or (tag == "header" and not inside_article):
        return True
    if not attrs:
        return False
    for name, *values in ATTRIBUTE.findall(attrs):
        value, name = next((v for v in values if v), ""), name.lower()
        if name == "role" and value.lower() in ASIDE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id") and tag not in ("body", "html", "article", "main") and aside_name(value):
            return True
    return tag not in ("html", "body") and bool(HIDDEN.search(re.sub(r"\"[^\"]*\"|'[^']*'", "", attrs)))


@lru_cache(maxsize=100_000)
def _signature(tag: str, attrs: str) -> str:
    """A style: the tag with its classes, digits left out."""
    classes = [next((v for v in values if v), "") for name, *values in ATTRIBUTE.findall(attrs) if name.lower() == "class"]
    return f"{tag}.{re.sub(r'[0-9]+', '', ' '.join(classes)).lower().strip()}" if classes else tag


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _child(path: int, style: str) -> int:
    return _signed(xxhash.xxh3_64_intdigest(style, seed=path & 0xFFFFFFFFFFFFFFFF))


def parse(html: str | None) -> tuple[list[tuple], list[tuple]]:
    """Blocks in page order, and the elements' styles, of what may be main text.

    A block is (text, its element, in article). A style is (element, its children in order, its ancestors from the root).
    Elements are hashes of the styles from the root; a text is a child of its element. What elements named after menus,
    adverts and so on hold is left out, of inline elements as well. Open elements are closed as browsers do for
    paragraphs and list items; stray end tags are ignored; one pass, in time linear in the page.
    """
    html = html or ""
    blocks: list[tuple] = []
    styles: list[tuple] = []
    # entries: tag, element, noise, in article, children
    stack: list[tuple] = [("", 0, False, False, [])]
    words: list[str] = []
    mute: list | None = None  # of the inline or too deep element that is left out: tag, open ones of that tag, depth
    extra = 0  # open elements deeper than DEPTH
    blind = False
    ends: dict[str, int] = {}  # where the next end tag of an inline element is
    never: set[str] = set()  # held elements that no end tag follows
    flat: set[str] = set()  # held elements whose tags don't match up

    def flush() -> None:
        text = " ".join(unescape("".join(words)).split())
        words.clear()
        if text and not stack[-1][2]:
            _, path, _, inside, children = stack[-1]
            blocks.append((text, path, inside))
            children.append(_child(path, "#text"))

    def pop() -> None:
        nonlocal mute
        _, path, noise, _, children = stack.pop()
        if children and not noise:
            styles.append((path, tuple(children), tuple(e[1] for e in stack)))
        if mute and len(stack) < mute[2]:
            mute = None

    def imply() -> None:
        """Closes an element whose end tag was left out; what is left out in an inline element goes on, if that one is closed later."""
        nonlocal mute
        before = mute
        pop()
        if before and not mute and ends_at(before[0]) < len(html):
            mute = before
            mute[2] = len(stack)

    def ends_at(tag: str) -> int:
        if ends.get(tag, -1) < at:
            found = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
            ends[tag] = found.start() if found else len(html)
        return ends[tag]

    def close(tag: str) -> None:
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth][0] == tag:
                while len(stack) > depth:
                    pop()
                return
            if stack[depth][0] in ("article", "main", "body", "table") and tag not in ("article", "main", "body", "html", "table"):
                return

    at = 0
    while True:
        lt = html.find("<", at)
        if lt < 0:
            lt = len(html)
        if lt > at and not mute:
            words.append(html[at:lt])
        if lt == len(html):
            break
        end_tag = html.startswith("/", lt + 1)
        m = NAME.match(html, lt + 1 + end_tag)
        if not m:
            if html.startswith("<!--", lt):
                at = html.find("-->", lt + 2) + 3
            elif html.startswith("<![CDATA[", lt):
                at = html.find("]]>", lt) + 3
            elif html[lt + 1 : lt + 2] in ("!", "?", "/"):
                at = html.find(">", lt) + 1
                if not at:
                    words.append(html[lt:])
                    break
            else:
                if not mute:
                    words.append("<")
                at = lt + 1
            if at == 2:  # never closed
                break
            continue
        tag, after = m[0].lower(), m.end()
        whole = None if blind else QUOTED.match(html, after)
        blind = whole is None
        at = whole.end() if whole else html.find(">", after) + 1
        if not at:  # no tag ends any more
            if not mute:
                words.append(html[lt:])
            break
        attrs = html[after : at - 1]
        if not end_tag and tag in RAW:
            found = RAW[tag].search(html, at)
            at = found.end() if found else len(html)
            words.append(" ")
            continue
        if tag in HELD:
            if end_tag or tag in never or (tag in ("svg", "math") and attrs.endswith("/")):
                continue
            depth, first, last = 1, 0, 0
            for t in HELD[tag].finditer(html, at):
                depth += -1 if t[1] else 1
                first = first or (t.end() if t[1] else 0)
                if tag in flat and first or not depth:
                    last = t.end()
                    break
            if not last:
                (flat if first else never).add(tag)
            at = last or first or at
            words.append(" ")
            continue
        if tag in ("br", "img", "wbr"):
            words.append(" " if tag != "wbr" else "")
            continue
        closed = attrs.rstrip().endswith("/")
        if mute and tag == mute[0] and not closed:
            mute[1] += -1 if end_tag else 1
            if not mute[1]:
                mute = None
                if tag not in BLOCKS:
                    continue
        block = tag in BLOCKS
        if not block:
            if not mute and attrs and not end_tag and not closed and tag not in VOID and stack[-1][0] != "pre" and _noise(tag, attrs, stack[-1][3]):
                mute = [tag, 1, len(stack)]
            continue
        flush()
        if end_tag:
            if extra:
                extra -= 1
            else:
                close(tag)
            continue
        if tag in VOID:
            continue
        for depth in range(len(stack) - 1, 0, -1):
            if tag not in P_ENDS or extra:
                break
            open_tag = stack[depth][0]
            if open_tag == "p" or (open_tag == tag == "li") or (tag in ("dt", "dd") and open_tag in ("dt", "dd")) or (tag in ("td", "th", "tr") and open_tag in ("td", "th")) or (tag == open_tag == "tr"):
                while len(stack) > depth:
                    imply()
                if open_tag != "td" or tag != "tr":
                    break
            elif open_tag not in HEADINGS or tag not in HEADINGS:
                break
        if closed:
            continue
        _, path, noise, article, children = stack[-1]
        noisy = noise or mute is not None or _noise(tag, attrs, article)
        if len(stack) > DEPTH:
            extra += 1
            if noisy and not mute:
                mute = [tag, 1, len(stack)]
            continue
        here = _child(path, _signature(tag, attrs))
        if not noisy:
            children.append(here)
        inside = article or tag in ("article", "main") or 'role="main"' in attrs
        stack.append((tag, here, noisy, inside, []))
    flush()
    while stack:
        pop()
    return blocks, styles


BLOCK = pa.struct([("text", pa.string()), ("print", pa.int64()), ("node", pa.int64()), ("inside", pa.bool_())])
SEEN = pa.struct([("node", pa.int64()), ("key", pa.int64()), ("first", pa.int32()), ("kids", pa.list_(pa.int64())), ("path", pa.list_(pa.int64()))])
SEEN_TYPE = "array<struct<node:bigint,key:bigint,first:int,kids:array<bigint>,path:array<bigint>>>"


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as blocks and as what the tree is to know: of each element its styles, of each text node its texts, once a page.

    A node is an element of one host. Blocks outside of articles are kept where there is no article with text.
    """
    for batch in batches:
        for s in range(0, batch.num_rows, 256):
            part = batch.slice(s, 256)
            blocks, seen = [], []
            for url, html in zip(part.column(2), part.column(3), strict=True):
                found, styles = parse(html.as_py())
                host = xxhash.xxh3_64_intdigest(host_of(url.as_py()))
                known: dict[int, int] = {}

                def node(path: int, host: int = host, known: dict = known) -> int:
                    if path not in known:
                        known[path] = _signed(xxhash.xxh3_64_intdigest((path & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "little"), seed=host))
                    return known[path]

                article = any(inside for _, _, inside in found)
                prints = [_signed(xxhash.xxh3_64_intdigest(t)) for t, _, _ in found]
                blocks.append([{"text": t, "print": p, "node": node(path), "inside": inside} for (t, path, inside), p in zip(found, prints, strict=True) if inside or not article])
                pairs: dict[tuple, tuple] = {}
                for path, children, above in styles:
                    kids = [node(c) for c in children]
                    pairs.setdefault((node(path), _signed(xxhash.xxh3_64_intdigest(repr(kids)))), (kids, [node(a) for a in above]))
                for (_, path, _), p in zip(found, prints, strict=True):
                    pairs.setdefault((node(_child(path, "#text")), p), (None, None))
                met: set[int] = set()
                rows = []
                for (n, key), (kids, above) in pairs.items():
                    rows.append({"node": n, "key": key, "first": int(n not in met), "kids": kids, "path": above})
                    met.add(n)
                seen.append(rows)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(blocks, pa.list_(BLOCK)), pa.array(seen, pa.list_(SEEN))], ["uid", "id", "url", "blocks", "seen"])


def _touched(few: Bloom, inside: bool):
    """Pages that may lose blocks, or those that can't."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(few.test(batch.column(0).to_numpy()) == inside))

    return run


def importances(seen: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """The tree of (node, key, first, kids, path) rows: (node, composite, noise) of its elements, and (node, print, times, pages) of their texts; and the tables that both read.

    An element's node importance is the entropy of its styles, each weighed by the pages that have it, to the base of the
    element's pages; that of a text node is one less the mean entropy of its texts' spread over its pages; on a single
    page either is 1. Bottom-up, an element's composite is (1 - g) * its node importance + g * the mean composite of its
    children, styles weighed by their pages, with g = GAMMA ^ styles. That is linear in the descendants' node importances, so instead of level by
    level it is summed over (ancestor, descendant) pairs with the products of the weights between. An element
    is noise if its composite and those of all elements in it are under LEAST_IMPORTANCE.
    """
    counted = materialize(seen.groupBy("node", "key").agg(F.count("*").alias("c"), F.sum("first").alias("first"), F.first("kids").alias("kids"), F.first("path").alias("path")), "tree")
    log = F.log(F.col("c").cast("double"))
    nodes = counted.groupBy("node").agg(F.sum("first").alias("m"), F.sum("c").alias("t"), F.count("*").alias("l"), F.sum(F.col("c") * log).alias("clogc"), F.avg(log).alias("spread"), F.max("path").alias("path"))
    text, base = F.col("path").isNull(), F.log(F.col("m").cast("double"))
    importance = F.when(F.col("m") <= 1, 1.0).when(text, 1 - F.col("spread") / base).otherwise(F.least(F.lit(1.0), (F.log(F.col("t").cast("double")) - F.col("clogc") / F.col("t")) / base))
    # the spread of texts weighs each once, the entropy of styles with p = c / t is log t - sum(c log c) / t
    nodes = nodes.select("node", "m", "t", "path", importance.alias("importance"), F.when(text, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("l").cast("double"))).alias("g"))
    edges = counted.where("kids is not null").select(F.col("node").alias("parent"), F.explode("kids").alias("child"), (F.col("c") / F.size("kids")).alias("w"))
    edges = edges.groupBy("child").agg(F.sum("w").alias("w"), F.first("parent").alias("parent"))
    above = nodes.where("path is not null").select(F.col("node").alias("parent"), F.col("t").alias("above_t"), F.col("g").alias("above_g"), F.col("path").alias("above_path"))
    tree = nodes.join(edges, nodes["node"] == edges["child"], "left").join(above, "parent", "left")
    tree = tree.select("node", "m", "parent", (F.col("path").isNull()).alias("is_text"), ((1 - F.col("g")) * F.col("importance")).alias("own"), F.coalesce(F.col("above_g") * F.col("w") / F.col("above_t"), F.lit(0.0)).alias("factor"), F.coalesce("path", F.concat("above_path", F.array("parent")), F.array().cast("array<bigint>")).alias("path"))
    tree = materialize(tree, "nodes")
    steps = tree.select("node", "own", "is_text", F.col("factor").alias("last"), F.posexplode("path").alias("i", "a"))
    steps = steps.join(tree.select(F.col("node").alias("a"), "factor"), "a").groupBy("node", "own", "last").agg(F.reverse(F.array_sort(F.collect_list(F.struct("i", "a", "factor")))).alias("up"))
    start = F.struct(F.col("last").alias("product"), F.array().cast("array<struct<a:bigint,p:double>>").alias("out"))
    climbed = F.aggregate("up", start, lambda s, x: F.struct((s["product"] * x["factor"]).alias("product"), F.concat(s["out"], F.array(F.struct(x["a"].alias("a"), s["product"].alias("p")))).alias("out")))
    shares = steps.select("own", F.explode(climbed.getField("out")).alias("x")).select(F.col("x.a").alias("node"), (F.col("own") * F.col("x.p")).alias("share"))
    elements = tree.where("not is_text")
    composite = materialize(elements.select("node", F.col("own").alias("share")).unionByName(shares).groupBy("node").agg(F.sum("share").alias("composite")), "composites")
    within = elements.join(composite, "node").select(F.explode(F.concat("path", F.array("node"))).alias("node"), "composite").groupBy("node").agg(F.max("composite").alias("most"))
    judged = composite.join(within, "node").select("node", "composite", (F.col("most") < LEAST_IMPORTANCE).alias("noise"))
    texts = counted.where("kids is null").select(F.col("node").alias("n"), F.col("key").alias("print"), F.col("c").alias("times"))
    texts = texts.join(tree.where("is_text").select(F.col("node").alias("n"), F.col("parent").alias("node"), F.col("m").alias("pages")), "n").select("node", "print", "times", "pages")
    return judged, texts, [counted, tree, composite]


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text): each page's main text, blocks in page order joined by a line feed.

    The DOMs of a host's pages are merged by path and style to a tree, see importances(). Branches that are noise there go;
    so do texts outside of article and main elements that two pages or more, and at least half of those with their
    element, have; and elements which by
    tag, role or class are menus, headers, footers, sidebars, notices, adverts, forms or comments. Where a page has an
    article or main element with text left, the rest of the page goes too. Where noise would take more than half of an
    article, or all of a page without one, or repeated texts more than half of what noise leaves, the page is a copy of
    others, and keeps it.
    Null or empty html, and pages with nothing left: empty text. A host's only page keeps all that elements leave.
    Null urls share one host. Very long pages are read whole, in linear time; repeated rows and page ids, and null ids,
    are pages by themselves; of texts that tie for a place all go or stay. Extra columns are left out; an empty
    table gives none.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    raw = pages.select(F.monotonically_increasing_id().alias("uid"), pages[id_col].alias("id"), pages[url_col].cast("string").alias("url"), pages[html_col].cast("string").alias("html"))
    schema = f"uid bigint, id {kind}, url string, blocks array<struct<text:string,print:bigint,node:bigint,inside:boolean>>, seen {SEEN_TYPE}"
    parsed = materialize(raw.mapInArrow(_parsed, schema), "dom")
    judged, texts, read = importances(parsed.select(F.explode("seen").alias("s")).select("s.*"))
    weak = materialize(judged.where("noise").select("node"), "weak")
    repeated = materialize(texts.where((F.col("times") >= REPEATED * F.col("pages")) & (F.col("times") >= 2)).select("node", "print"), "repeated")
    for t in read:
        discard(t)

    at = parsed.select("uid", F.posexplode("blocks").alias("i", "b")).select("uid", "i", "b.print", "b.node", "b.inside")
    by_branch = at.join(weak, "node", "left_semi").select("uid", "i", F.lit(True).alias("branch"))
    by_text = at.where("not inside").join(repeated, ["node", "print"], "left_semi").select("uid", "i", F.lit(False).alias("branch"))
    removed = materialize(by_branch.unionByName(by_text).groupBy("uid").agg(F.collect_set(F.when(F.col("branch"), F.col("i"))).alias("branch"), F.collect_set(F.when(~F.col("branch"), F.col("i"))).alias("same")), "removed")
    discard(weak), discard(repeated)

    # pages that lose nothing aren't shuffled
    few = build(removed.select("uid"), removed.count())
    slim = parsed.select("uid", "id", "url", F.transform("blocks", lambda b: b["text"]).alias("texts"), F.exists("blocks", lambda b: b["inside"]).alias("article"))
    shape = f"uid bigint, id {kind}, url string, texts array<string>, article boolean"
    whole = slim.mapInArrow(_touched(few, False), shape).select("id", "url", F.col("texts").alias("final"))
    part = slim.mapInArrow(_touched(few, True), shape).join(removed, "uid", "left")
    lost = lambda c: F.coalesce(F.col(c), F.array().cast("array<int>"))
    length = lambda blocks: F.aggregate(blocks, F.lit(0).cast("long"), lambda a, b: a + F.length(b["text"]))
    marked = F.transform("texts", lambda t, i: F.struct(t.alias("text"), F.array_contains(lost("branch"), i).alias("branch"), F.array_contains(lost("same"), i).alias("same")))
    part = part.select("id", "url", "article", marked.alias("all")).select("*", F.filter("all", lambda b: ~b["branch"]).alias("left"))
    enough = F.when(F.col("article"), length(F.col("left")) * 2 >= length(F.col("all"))).otherwise(F.size("left") > 0)
    part = part.select("id", "url", F.when(enough, F.col("left")).otherwise(F.col("all")).alias("left")).select("*", F.filter("left", lambda b: ~b["same"]).alias("own"))
    final = F.when(length(F.col("own")) * 2 >= length(F.col("left")), F.col("own")).otherwise(F.col("left"))
    part = part.select("id", "url", F.transform(final, lambda b: b["text"]).alias("final"))
    return whole.unionByName(part).select(F.col("id").alias(id_col), F.col("url").alias(url_col), F.array_join("final", "\n").alias("text"))
