"""The main text of web pages, by a style tree per site.

The DOMs of all pages of a host are merged: element nodes are the same if they have the
same presentation (tag and class names) all the way up, and a text is a content node
below its element.  A style is the sequence of presentations below an element, with
repeats of one presentation joined.  Importance comes from entropy, to base m, the number
of pages that have the node:

* presentation: of the distribution of styles over pages.  One style everywhere gives 0.
* content: 1 less the mean entropy of its features (texts, links, images) over pages.
  A text on every page gives 0, texts of one page each give 1.
* composite: (1 - g^l) presentation + g^l (mean of the children), with l styles.

What HTML and naming say about an element weighs in: menus, forms, scripts and the like
weigh 0, whatever a page has outside its declared article a quarter.  Few pages prove
little, so a content node's importance is mixed with 1 as if some more pages had
varied.  A branch is removed if its composite is low and none of its nodes is important.

Evidence is summed per (node, style, feature or child) with fixed-width buffers before
and after one shuffle, so a host with a third of all pages is spread over its features.
The trees are folded level by level with joins; pages are parsed once for the evidence
and once for the result, and only their blocks of text are shuffled.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigate.llm.common import Scratch, small_batches

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Decay of a node's own styles against its children.
DECAY = 0.9
#: A branch with a composite importance below LOW goes, unless a node in it reaches HIGH.
LOW, HIGH = 0.3, 0.6
#: Pages that are added as varied evidence, below a declared article and elsewhere.
ADDED_INSIDE, ADDED = 100.0, 2.0
#: Weight of what a page has outside its declared article.
OUTSIDE = 0.25
#: Deeper elements count as content of their ancestor at this depth.
DEPTH = 24
#: Copies of the table of removed nodes, each joined to its share of the blocks.
SALTS = 16

# Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var".split()
)
NOT_TEXT = frozenset(
    "applet audio button canvas datalist dialog embed fieldset footer form frameset iframe input label math menu "
    "meter nav noembed noframes noscript object optgroup option output progress script select style svg template "
    "textarea title video aside".split()
)
ROLES = frozenset(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split()
)
ENDS_PARAGRAPH = frozenset(
    "address article aside blockquote details div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table ul".split()
)
PARAGRAPH_SCOPE = tuple("article body button div main section table td th".split())
#: A start tag that ends an open one of these, inside the nearest of those.
ENDS_ITEM = {
    tag: (tuple(ends.split()), tuple(inside.split()))
    for tag, ends, inside in (
        ("li", "li", "ul ol menu"), ("dt", "dt dd", "dl"), ("dd", "dt dd", "dl"), ("tr", "tr", "table"),
        ("td", "td th", "tr table"), ("th", "td th", "tr table"),
    )
}
#: Elements whose content has no markup; none of them holds text of an article.
RAW = {
    tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.IGNORECASE)
    for tag in ("iframe", "noembed", "noframes", "script", "style", "textarea", "title")
}
#: Words in class names and ids of what is not the article (fixed values).
NOISE = frozenset(
    "ad ads adsense advert advertisement advertising adverts banner breadcrumb breadcrumbs comment commentlist "
    "comments consent cookie cookies copyright discussion disqus footer form gdpr header login masthead menu modal "
    "nav navbar navigation newsletter notice notices notification pager pagination popup promo promotion promoted "
    "recommended related replies reply respond search share sharing sidebar signin signup skip social sponsor "
    "sponsored subscribe toolbar topbar widget".split()
)
STATES = frozenset("has with without no is not js hide show".split())
ARTICLE_WORDS = frozenset("article content entry post story title".split())


def words_of(name: str) -> list[str]:
    return re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", name).lower())


def named_noise(names: list[str]) -> bool:
    """Whether a class name or id begins or ends with a word for something else than text."""
    for name in names:
        words = words_of(name)
        if not words or words[0] in STATES or (words[-1] == "header" and ARTICLE_WORDS & set(words)):
            continue
        if words[0] in NOISE or words[-1] in NOISE:
            return True
    return False


class _Open:
    """An open element, and what holds for everything in it."""

    __slots__ = ("tag", "key", "depth", "noise", "article", "heading", "nested", "inline")

    def __init__(self, tag, key, depth, noise, article, heading, inline=False):
        self.tag, self.key, self.depth, self.inline = tag, key, depth, inline
        self.noise, self.article, self.heading, self.nested = noise, article, heading, 0


_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_BARE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(text):
        found.setdefault(name.lower(), unescape(a or b or c))
    return found


_SEEN: dict[tuple[str, str], tuple] = {}


def _presentation(tag: str, text: str) -> tuple[str, bool, bool, bool]:
    """(presentation, noise outside an article, noise inside one, declared article)."""
    if (tag, text) not in _SEEN:
        if len(_SEEN) > 4096:
            _SEEN.clear()
        _SEEN[tag, text] = _looked_at(tag, text)
    return _SEEN[tag, text]


def _looked_at(tag: str, text: str) -> tuple[str, bool, bool, bool]:
    values = _attributes(text) if text else {}
    classes = values.get("class", "").split()
    named = named_noise([*classes, *values.get("id", "").split()])
    role = values.get("role", "").strip().lower()
    noise = tag in NOT_TEXT or named or role in ROLES
    main = tag in ("article", "main") or role == "main" or "articleBody" in values.get("itemprop", "")
    look = ".".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes})]).replace("/", "|")
    if tag in ("html", "body"):
        return look, False, False, False
    return look, noise or tag == "header", noise, main and not noise


class Dom:
    """Blocks of text and the sequence of children of each element node of a page.

    A node is named by the presentations from the root down.  `blocks` holds (node, text,
    noise, inside a declared article, heading); `children` the presentations below each
    node; `features` the texts, links and images of each content node.  Inline elements
    are part of the block around them.  Time is linear in the length of the page.
    """

    def __init__(self, html: str):
        self.stack = [_Open("", "", 0, False, False, False)]
        self.open: dict[str, int] = {}
        self.blocks: list[tuple] = []
        self.children: dict[str, list[str]] = {}
        self.features: dict[str, set[str]] = {}
        self.parts: list[str] = []
        self.links: list[str] = []
        self.has_article = False
        self._read(html)
        self._end_block()

    def _read(self, html: str) -> None:
        at, size = 0, len(html)
        while at < size:
            begin = html.find("<", at)
            if begin < 0:
                self._data(html[at:])
                return
            if begin > at:
                self._data(html[at:begin])
            if html.startswith("<!--", begin):
                end = html.find("-->", begin + 2)
                if end < 0:
                    return
                at = end + 3
                continue
            follows = html[begin + 1 : begin + 2]
            if not (follows in ("!", "?", "/") or (follows.isascii() and follows.isalpha())):
                self.parts.append("<")
                at = begin + 1
                continue
            tag = _TAG.match(html, begin)
            if tag is None:
                end = html.find(">", begin)
                if end < 0:
                    return
                tag = _BARE.match(html, begin)
                if tag is None:  # declarations and the like
                    at = end + 1
                    continue
            at = tag.end()
            closing, name, rest = tag.groups()
            name = name.lower()
            if closing:
                self._end(name)
            elif name in RAW and not rest.endswith("/"):
                self._end_block()
                end = RAW[name].search(html, at)
                if end is None:
                    return
                at = end.end()
            else:
                self._start(name, rest)

    def _data(self, text: str) -> None:
        self.parts.append(unescape(text) if "&" in text else text)

    def _end_block(self) -> None:
        if not self.parts and not self.links:
            return
        text = " ".join("".join(self.parts).split())
        if text or self.links:
            top = self.stack[-1]
            self._child(top.key, "#text")
            node = top.key + "/#text"
            found = self.features.setdefault(node, set())
            found.update(self.links)
            if text:
                found.add(text)
                self.blocks.append((node, text, top.noise, top.article, top.heading))
        self.parts, self.links = [], []

    def _child(self, key: str, look: str) -> None:
        known = self.children.setdefault(key, [])
        if not known or known[-1] != look:
            known.append(look)

    def _start(self, tag: str, rest: str) -> None:
        if tag == "head":  # holds nothing but void and raw elements
            return
        if tag in VOID or tag == "a":
            if tag in ("a", "img") and rest:
                link = _attributes(rest).get("href" if tag == "a" else "src")
                if link:
                    self.links.append(tag + " " + link)
            if tag == "br":
                self.parts.append(" ")
            elif tag == "hr":
                self._end_block()
            if tag in VOID:
                return
        look, outer, inner, main = _presentation(tag, rest.strip())
        noise = inner if self.stack[-1].article else outer
        if tag in INLINE and not noise:
            if self.stack[-1].tag == tag:
                self.stack[-1].nested += 1
            return
        if tag in ("html", "body") and self.open.get(tag):
            return
        self._end_block()
        if tag in ENDS_PARAGRAPH and self.open.get("p"):
            self._close(("p",), PARAGRAPH_SCOPE)
        if tag in ENDS_ITEM:
            self._close(*ENDS_ITEM[tag])
        if main and not self.has_article:
            # The first article of a page is not part of the noise it stands in.
            self.has_article = True
            for e in self.stack:
                e.noise = False
        top = self.stack[-1]
        key, depth = top.key, top.depth
        if depth < DEPTH - 2:
            self._child(key, look)
            key, depth = key + "/" + look, depth + 1
        self.stack.append(_Open(
            tag, key, depth, noise or top.noise, main or top.article, tag == "h1" or top.heading, tag in INLINE
        ))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _close(self, tags: tuple[str, ...], barrier: tuple[str, ...] = ()) -> None:
        """Close the nearest open element of `tags`, unless a `barrier` stands before it."""
        if not any(self.open.get(t) for t in tags):
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i].tag in tags:
                for e in self.stack[i:]:
                    self.open[e.tag] -= 1
                del self.stack[i:]
                return
            if self.stack[i].tag in barrier:
                return

    def _end(self, tag: str) -> None:
        if tag in INLINE:
            top = self.stack[-1]
            if not (top.inline and top.tag == tag):
                return
            if top.nested:
                top.nested -= 1
                return
        if tag not in ("html", "head", "body", "br"):
            self._end_block()
            self._close((tag,))

    def weighed(self) -> Iterator[tuple[str, str, float, bool]]:
        """(node, text, weight, inside the declared article) of each block."""
        headed = any(inside and heading for _, _, _, inside, heading in self.blocks)
        for node, text, noise, inside, heading in self.blocks:
            if noise:
                weight = 0.0
            elif self.has_article and not inside and (headed or not heading):
                weight = OUTSIDE
            else:
                weight = 1.0
            yield node, text, weight, inside


def _hash(host: str, value: str) -> int:
    h = xxhash.xxh3_64_intdigest((host + "\n" + value).encode("utf-8", "surrogatepass"))
    return h - (1 << 64) if h >> 63 else h


EVIDENCE = "node bigint, kind int, item bigint, value double, parent bigint, depth int, added double"
STYLE, FEATURE, CHILD = 0, 1, 2


def evidence(host: str, html: str) -> Iterator[tuple]:
    """Rows of EVIDENCE of one page."""
    dom = Dom(html)
    name = lambda key: _hash(host, key)
    inside = {node for node, _, _, within in dom.weighed() if within}
    for key, found in dom.features.items():
        own = (name(key), name(key[: key.rindex("/")]), key.count("/") + 1, ADDED_INSIDE if key in inside else ADDED)
        yield own[0], STYLE, 0, 1.0, *own[1:]
        for feature in found:
            yield own[0], FEATURE, _hash("", feature), 1.0, *own[1:]
    for key, kids in dom.children.items():
        parent = name(key[: key.rindex("/")]) if key else None
        own = (name(key), parent, key.count("/") + 1, 0.0)
        yield own[0], STYLE, _hash("", "\n".join(kids)), 1.0, *own[1:]
        for kid in kids:
            yield own[0], CHILD, name(key + "/" + kid.replace("/", "|")), 1.0 / len(kids), *own[1:]


def host_of(url: Column) -> Column:
    after = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def site_trees(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes of all style trees: node, parent, depth, importance, best, low.

    `best` is the greatest importance in the branch of the node.  pages: host, html.
    """
    small_batches(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), pa.float64()]
        names = [f.split()[0] for f in EVIDENCE.split(", ")]
        for batch in batches:
            rows = [r for h, t in zip(batch.column(0), batch.column(1)) for r in evidence(h.as_py(), t.as_py() or "")]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    rows = pages.select("host", "html").mapInArrow(run, EVIDENCE)
    items = scratch.table(rows.groupBy("node", "kind", "item").agg(
        F.sum("value").alias("value"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.max("added").alias("added"),
    ))
    of = lambda kind, c: F.sum(F.when(F.col("kind") == kind, c).otherwise(0))
    nodes = items.groupBy("node").agg(
        of(STYLE, F.col("value")).alias("m"), of(STYLE, F.lit(1)).alias("styles"),
        of(STYLE, F.col("value") * F.ln("value")).alias("s"), of(FEATURE, F.lit(1)).alias("features"),
        of(FEATURE, F.ln("value")).alias("k"), F.min("parent").alias("parent"), F.min("depth").alias("depth"),
        F.max("added").alias("added"),
    )
    content = F.col("features") > 0
    m, log = F.col("m"), F.ln("m")
    varied = F.when(m <= 1, 1.0).when(content, 1 - F.col("k") / (F.col("features") * log)).otherwise(
        1 - F.col("s") / (m * log)
    )
    share = (m - 1) / (m - 1 + F.col("added"))
    nodes = scratch.table(nodes.select(
        "node", "parent", "depth", "m", content.alias("content"), F.pow(F.lit(DECAY), "styles").alias("rest"),
        F.when(content & (m > 1), share * varied + 1 - share).otherwise(varied).alias("own"),
    ))
    edges = items.where(F.col("kind") == CHILD).select("node", F.col("item").alias("kid"), F.col("value").alias("w"))
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    done = level = None
    for depth in range(deepest, 0, -1):
        own = nodes.where(F.col("depth") == depth)
        leaves = own.where("content").select("node", "parent", "depth", F.col("own").alias("importance"), F.col("own").alias("best"))
        if level is None:
            level = leaves
        else:
            kids = level.select(F.col("node").alias("kid"), "importance", "best")
            inner = own.where("not content").join(edges, "node").join(kids, "kid").groupBy("node", "parent", "depth").agg(
                ((1 - F.first("rest")) * F.first("own") + F.first("rest") * F.sum(F.col("w") / F.col("m") * F.col("importance"))).alias("importance"),
                F.max("best").alias("best"),
            ).withColumn("best", F.greatest("best", "importance"))
            level = leaves.unionByName(inner)
        level = scratch.table(level)
        done = level if done is None else done.unionByName(level)
    if done is None:
        done = nodes.select("node", "parent", "depth", F.col("own").alias("importance"), F.col("own").alias("best"))
    return done.withColumn("low", (F.col("importance") < LOW) & (F.col("best") < HIGH))


def removed_contents(trees: DataFrame, scratch: Scratch) -> DataFrame:
    """The nodes that lie in a low branch."""
    found = scratch.table(trees.where("low").select("node", "depth"))
    gone = found.select("node")
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    first = found.agg(F.min("depth")).first()[0]
    level = found
    for depth in range(first or deepest, deepest):
        above = level.where(F.col("depth") == depth).select(F.col("node").alias("parent"))
        below = trees.where(F.col("depth") == depth + 1).join(above, "parent", "left_semi").select("node", "depth")
        level = scratch.table(below.unionByName(found.where(F.col("depth") == depth + 1)).distinct())
        gone = gone.unionByName(level.select("node"))
    return gone.distinct()


def main_texts(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per row of `pages` (page_id, url, html): page_id, url, text, n_chars.

    Null html counts as empty, and empty or unparsable pages have an empty text.  Pages
    whose url is null or has no `://` form one site.  Repeated rows stay, and count as
    pages of the site.  White space is what Python's `str.split` takes for it.  Where all
    blocks of a page that may be text lie in low branches (copies of one page), they
    stay.  Other columns are ignored; an empty table gives an empty result.
    """
    small_batches(pages.sparkSession)
    plain = pages.select(
        pages["page_id"].alias("page_id"), pages["url"].alias("url"), host_of(pages["url"]).alias("host"),
        pages["html"].alias("html"),
    )
    trees = site_trees(plain, scratch)
    gone = scratch.table(removed_contents(trees, scratch))
    spread = gone.select("node", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("gone"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.struct([("seq", pa.int32()), ("node", pa.int64()), ("text", pa.string())])
        for batch in batches:
            found = []
            for host, html in zip(batch.column(1), batch.column(2)):
                host = host.as_py()
                blocks = [(n, t) for n, t, w, _ in Dom(html.as_py() or "").weighed() if w >= LOW]
                found.append([{"seq": i, "node": _hash(host, n), "text": t} for i, (n, t) in enumerate(blocks)])
            columns = [batch.column(0), pa.array(found, pa.list_(block))]
            yield pa.RecordBatch.from_arrays(columns, names=["_page", "blocks"])

    about = plain.schema["page_id"].dataType.simpleString()
    page = F.struct(F.monotonically_increasing_id().alias("row"), "page_id", "url").alias("_page")
    schema = f"_page struct<row: bigint, page_id: {about}, url: string>, blocks array<struct<seq: int, node: bigint, text: string>>"
    cut = plain.select(page, "host", "html").mapInArrow(run, schema)
    blocks = cut.select("_page", F.explode_outer("blocks").alias("b")).select(
        "_page", "b.node", F.struct("b.seq", "b.text").alias("b"),
        F.pmod(F.col("_page.row"), F.lit(SALTS)).cast("int").alias("_salt"),
    )
    marked = blocks.join(spread, ["node", "_salt"], "left").select(
        "_page", F.when(F.col("b.text").isNotNull(), F.struct("b.seq", F.col("gone").isNull().alias("kept"), "b.text")).alias("b")
    )
    listed = marked.groupBy("_page").agg(F.sort_array(F.collect_list("b")).alias("all"))
    kept = F.filter("all", lambda b: b["kept"])
    chosen = F.when(F.size(kept) > 0, kept).otherwise(F.col("all"))
    text = F.array_join(F.transform(chosen, lambda b: b["text"]), " ")
    return listed.select("_page.page_id", "_page.url", text.alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("bigint")
    )
