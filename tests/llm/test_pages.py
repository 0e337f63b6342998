"""Main texts: the style tree against brute force, hand-made pages, and the given ones."""

import math
import re
import time
from collections import Counter, defaultdict
from html import unescape

import pytest

from verdigate.llm import pages
from verdigate.llm.common import Scratch

COLUMNS = "page_id int, url string, html string, text string, host string, _row int"


def texts_of(html):
    return " ".join(t for _, t, w, _ in pages.Dom(html).weighed() if w >= pages.LOW)


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        ("plain &amp; simple", "plain & simple"),
        ("<p>one<p>two <b>th</b>ree<br>four", "one two three four"),
        ("<body><nav>menu</nav><h1>Title</h1><div class='ad'>buy</div><p>text &lt;b&gt; a<b</p></body>", "Title text <b> a"),
        ("<nav><ul><li>a<li>b<article><h1>T</h1>x</article>", "T x"),
        ("<form><article><p>in a form</p><form>field</form></article></form>", "in a form"),
        ("<main><header><h1>H</h1></header><p>a</p><aside>side</aside><footer>f</footer></main><div>out</div>", "H a"),
        ("<article>text<section id='comments'><article>reader</article></section></article>", "text"),
        ("<article>text</article><article class='comment'>reader</article>", "text"),
        ("<div class='page has-sidebar'><p>kept</p></div><div class='main-sidebar'>gone</div>", "kept"),
        ("<div class='post-header'><h1>T</h1></div><div id='siteHeader'>S</div><p>x", "T x"),
        ("<p>a <span class='ad'>buy <span>now</span> or</span> b</p>", "a b"),
        ("<script>var t='</p><p>no</p>'</script><style>p{}</style><p>y<!-- <p>z</p> --></p>", "y"),
        ("<ul><li>one<li>two</ul><table><tr><td>c1<td>c2<tr><td>c3</table>", "one two c1 c2 c3"),
        ("<p title='a > b'>x</p><p title=\"un>y</p><p>z", "x y z"),
        ("<h1>out</h1><article><p>in</p></article>", "out in"),
        ("<p>a < b and 3<4</p><p", "a < b and 3<4"),
        ("<head><meta charset=x><body><p>no end of head", "no end of head"),
        ("<p>tab\t\n\x0b nbsp&nbsp;x &am &eacute;&#233;&#xe9;", "tab nbsp x &am ééé"),
        ("<div role='navigation'>n</div><div role='main'>m</div>", "m"),
    ],
)
def test_hand_made_pages(html, text):
    assert texts_of(html) == text


def test_time_grows_with_the_length():
    for piece in ("<a ", "<!--", "<", "<p>", "<div>", "&", "<b>", "</", "<a href='", "<div class=ad>", "<span class=ad>", "<li>", '<p title="'):
        start = time.time()
        pages.Dom(piece * 50_000)
        assert time.time() - start < 5, piece


def test_deep_pages_keep_their_text():
    assert texts_of("<div>x" * 300 + "</div>y" * 300) == " ".join("x" * 300 + "y" * 300)


def brute(rows):
    """The style trees in plain Python: (importance, removed) of each content node."""
    doms = defaultdict(list)
    for _, url, html in rows:
        host = re.match(r"(?:[^:]*://([^/?#]*))?", url or "").group(1) or ""
        doms[host.lower()].append(pages.Dom(html or ""))
    removed = {}
    for host, all_of in doms.items():
        styles, kids, features, inside = defaultdict(Counter), {}, defaultdict(Counter), set()
        for dom in all_of:
            inside |= {n for n, _, _, within in dom.weighed() if within}
            for key, sequence in dom.children.items():
                styles[key][tuple(sequence)] += 1
                kids[key] = kids.get(key, set()) | {key + "/" + k for k in sequence}
            for key, found in dom.features.items():
                features[key].update(found)
                styles[key]["page"] += 1

        def importance(key):
            m = sum(styles[key].values())
            if key in features:
                c = 1 if m == 1 else 1 - sum(math.log(k) for k in features[key].values()) / math.log(m) / len(features[key])
                added = pages.ADDED_INSIDE if key in inside else pages.ADDED
                return ((m - 1) * c + added) / (m - 1 + added)
            own = 1 if m == 1 else -sum(n / m * math.log(n / m) / math.log(m) for n in styles[key].values())
            rest = pages.DECAY ** len(styles[key])
            below = sum(n / m * sum(importance(f"{key}/{k}") for k in s) / len(s) for s, n in styles[key].items())
            return (1 - rest) * own + rest * below

        def best(key):
            return max([importance(key), *(best(k) for k in kids.get(key, ()))])

        def walk(key, gone):
            gone = gone or (importance(key) < pages.LOW and best(key) < pages.HIGH)
            if key in features:
                removed[host, key] = gone
            for k in kids.get(key, ()):
                walk(k, gone)

        if "" in styles:
            walk("", False)
    out = []
    for page_id, url, html in rows:
        host = (re.match(r"(?:[^:]*://([^/?#]*))?", url or "").group(1) or "").lower()
        blocks = [(n, t) for n, t, w, _ in pages.Dom(html or "").weighed() if w >= pages.LOW]
        kept = [t for n, t in blocks if not removed[host, n]] or [t for _, t in blocks]
        text = " ".join(kept)
        out.append((page_id, url, text, len(text)))
    return sorted(out, key=str), removed


def site(host, n, common):
    """Pages without telling names, `common` of which carry the same strip."""
    made = []
    for i in range(n):
        strip = "<div class='xa'><div>Call us today</div><p>All offers end soon.</p></div>" if i < common else f"<div class='xa'><p>own {i} {host}</p></div>"
        body = "".join(f"<p>{host} paragraph {i} {j} {i * j % 7}</p>" for j in range(1 + i % 3))
        made.append(f"<html><body>{strip}<div class='xb'><h2>Story {i}</h2>{body}</div><div class='xc'><a href='/t'>Terms</a></div></body></html>")
    return made


def test_style_tree(spark):
    rows, k = [], 0
    for host, n, common in (("A.example", 40, 40), ("b.example", 12, 6), ("c.example", 1, 1), ("d.example", 3, 3)):
        for html in site(host.lower(), n, common):
            rows.append((k, f"http://{host}/p/{k}?x", html))
            k += 1
    copy = "<html><body><div class='y'>the same text everywhere</div></body></html>"
    rows += [(k + i, "https://e.example#f", copy) for i in range(30)]
    rows += [(None, None, None), (7, None, "<p>x"), (8, "no scheme", ""), (9, "no scheme", "<p>y</p>"), rows[0], rows[0]]
    rows.append((99, "http://c.example/long", "<article>" + "<p>" + "long text " * 40_000 + "</article>"))
    frame = spark.createDataFrame([(*r, "t", "h", 1) for r in rows], COLUMNS)
    got = sorted(map(tuple, pages.main_texts(frame, Scratch(spark)).collect()), key=str)
    want, removed = brute(rows)
    assert got == want
    texts = {r[0]: r[2] for r in got}
    assert "Call us" not in texts[0] and "Terms" not in texts[0] and texts[0].startswith("Story 0")
    assert texts[k] == "the same text everywhere"
    assert "Call us" in texts[53] and sum(removed.values()) >= 5


def test_no_pages(spark):
    assert pages.main_texts(spark.createDataFrame([], COLUMNS), Scratch(spark)).count() == 0


def test_given_pages(spark):
    def article(html):
        inside = re.search(r"<article>(.*?)</article>", html, re.S).group(1)
        blocks = [unescape(re.sub(r"<[^>]*>", "", x)) for x in re.split(r"</?p>|</?h1>|<br>", inside)]
        return " ".join(" ".join(b.split()) for b in blocks if b.strip())

    given = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    found = {r.page_id: r for r in pages.main_texts(given, Scratch(spark)).collect()}
    assert len(found) == given.count()
    for r in given.collect():
        assert found[r.page_id].text == article(r.html) and found[r.page_id].n_chars == len(found[r.page_id].text)
