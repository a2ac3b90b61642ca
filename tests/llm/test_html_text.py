import math
from collections import Counter, defaultdict

import pytest

from cairn.llm import html_text as ht


def text(page):
    return ht.main_text(ht.read_page(page), {})


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>no</article>";</script></head>
<body class="post"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav><!-- ad <p>x --><div class="ad">Buy</div>
<div id="cookie-notice">Cookies</div><aside>Side</aside><article><header><h1>A &amp; B</h1></header><p>One <b>two</b>
 three<p>Fo&#117;r<br>five &lt;b&gt; &nbsp;six<ul><li>x<li>y</ul><form><input>Form</form><div class="adBox">Ad</div>
<section id="comments"><article class="comment"><p>First!</p></article></section><p hidden>gone</p><table><tr><td>c<td>d</table></article>
<footer>&copy; F</footer></body></html>"""


def test_article_without_the_rest():
    assert text(PAGE) == "A & B\nOne two three\nFour five <b> six\nx\ny\nc\nd"


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("just text & more &am &quo", "just text & more &am &quo"),
        ("<article><p>cut o", "cut o"),
        ("<article><p>a</p><p cla", "a"),
        ("<article>a<!-- never closed <p>b", "a"),
        ("<article><p>1 < 2 and 3 <4</p></article>", "1 < 2 and 3 <4"),
        ("<article><p>a<script>if (a<b) '</p>'</script>b</p></article>", "ab"),
        ("<article><p a='>'>x</p><p b=\"unclosed>y</p></article>", "x\ny"),
        ('<article class="post comments-open"><p>a</p></article>', "a"),
        ('<article class="post"><p>a</p></article><article class="comment even"><p>c</p></article>', "a"),
        ('<article><p data-state="hidden" title="class=ad" data-id="menu">a</p><p HIDDEN>b</p><p Class=Menu>c</p></article>', "a"),
        ("<main><div>m</div></main><div>o</div>", "m"),
        ("<nav>n</nav><div>one</div><div>two</div>", "one\ntwo"),
        ("<ARTICLE><P>Upper</P></ARTICLE>", "Upper"),
        ("</div></p><article></b><p>x</i></p></article>", "x"),
        ("<article></article><div>other</div>", "other"),
    ],
)
def test_pages(page, want):
    assert text(page) == want


def test_deep_and_long_pages():
    assert text("<div>" * 20_000 + "deep" + "</div>" * 20_000) == "deep"
    assert text("<article>" + "<p>x</p>" * 20_000) == "\n".join(["x"] * 20_000)
    assert text("<article><p>" + "<" * 5_000) == "<" * 5_000


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, node long").selectExpr("*", "1 AS key", "'t' AS text", "2 AS digest", "3 AS nodes", "4 AS pages", "5 AS n_chars", "6 AS tree")


SITE = [
    f"<body><nav><ul><li>Home<li>News {i % 3}</ul></nav><div class=a><span>Join our list today</span></div>"
    f"<div class=b><h2>Title {i}</h2>" + "".join(f"<p>Own words of page {i}, part {k}</p>" for k in range(i % 4 + 1)) + "<p>Read this before that</p></div><blockquote>All our texts are free</blockquote></body>"
    for i in range(40)
]


def plain_tree(pages):
    """The merged trees of pages that are nested lists (tag, class, place kind): counted by hand from the definitions, over strings."""
    shown, said, seen = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for number, page in enumerate(sorted(set(pages))):
        got = set()

        def walk(element, path):
            kinds, texts, tags = Counter(), [], []
            for child in element[1]:
                if isinstance(child, str):
                    texts.append(child)
                else:
                    tags.append(child[0][0])
                    kind = child[0]
                    at = min(kinds[kind], 3)
                    kinds[kind] += 1
                    texts += walk(child, (*path, (kind, at)))
            if texts:
                got.add((path, "shown", tuple(tags)))
                got.add((path, "said", tuple(texts)))
                seen[path].add(number)
            return texts

        walk(page, ())
        for path, kind, feature in got:
            (shown if kind == "shown" else said)[path][feature] += 1
    n = len(set(pages))

    def entropy(c):
        m = sum(c.values())
        return sum(-v / m * math.log(v / m) for v in c.values()) / math.log(m)

    out = {}
    for path in said:
        m = sum(said[path].values())
        if m > 2:
            leaf = set(shown[path]) == {()}
            value = entropy(said[path]) if leaf else (entropy(said[path]) + (entropy(shown[path]) if sum(shown[path].values()) > 2 else 0)) / 2
            out[path] = value, min(8.0, math.log2(m)) * min(1.0, m / n)
    return out


def plain_text(page, tree, names):
    out = []

    def walk(element, path, above):
        named, weight = names.get(element[0], (0.0, 0.0))
        value, by_site = tree.get(path, (0.0, 0.0))
        here = (above + named * weight + value * by_site) / (1 + weight + by_site)
        if here < 0.4:
            return
        kinds = Counter()
        for child in element[1]:
            if isinstance(child, str):
                out.append(child)
            else:
                at = min(kinds[child[0]], 3)
                kinds[child[0]] += 1
                walk(child, (*path, (child[0], at)), here)

    walk(page, (), 1.0)
    return "\n".join(out)


def nested(i):
    """Page ``i`` of ``SITE`` as (kind, children); a kind is (tag, class)."""
    e = lambda tag, *children, named="": ((tag, named), children)
    own = [e("p", f"Own words of page {i}, part {k}") for k in range(i % 4 + 1)]
    body = e("body", e("nav", e("ul", e("li", "Home"), e("li", f"News {i % 3}"))), e("div", "Join our list today", named="a"), e("div", e("h2", f"Title {i}"), *own, e("p", "Read this before that"), named="b"), e("blockquote", "All our texts are free"))
    return e("#root", body)


@pytest.mark.parametrize("most", [200_000, -1])
def test_the_tree_equals_one_that_is_counted_by_hand(spark, monkeypatch, most):
    monkeypatch.setattr(ht, "BROADCAST_ROWS", most)
    monkeypatch.setattr(ht, "PAGES_AT_ONCE", 7)
    tree = plain_tree([nested(i) for i in range(40)])
    want = [plain_text(nested(i), tree, {("nav", ""): (0.0, 16.0)}) for i in range(40)]
    got = [r["text"] for r in ht.extract(pages(spark, [(i, f"http://one.example/{i}", h, "x", 0) for i, h in enumerate(SITE)])).orderBy("page_id").collect()]
    assert got == want
    assert not any("Join" in t or "free" in t or "Home" in t for t in got) and all(f"Own words of page {i}, part 0" in t for i, t in enumerate(got))


def test_results_change_when_the_tree_is_taken_away(spark):
    table = pages(spark, [(i, f"http://one.example/{i}", h, "x", 0) for i, h in enumerate(SITE)])
    texts = lambda **k: [r["text"] for r in ht.extract(table, **k).orderBy("page_id").collect()]
    with_tree, without = texts(), texts(use_site=False)
    assert all("Join our list today" in t and "All our texts are free" in t for t in without)
    assert all("Join" not in t for t in with_tree)


def test_the_tree_decides_inside_and_about_articles(spark):
    own = lambda i: f"<article><div class=x>Take part in our survey</div><p>Words of page {i}</p><p>and {i * i} more</p></article>"
    teaser = lambda i: f"<article><p>The same teaser</p></article><div><p>Words of page {i}</p></div>"
    rows = [(i, f"http://one.example/{i}", own(i), "x", 0) for i in range(60)] + [(1000 + i, f"http://two.example/{i}", teaser(i), "x", 0) for i in range(300)]
    got = {r["page_id"]: r["text"] for r in ht.extract(pages(spark, rows)).collect()}
    assert got == {i: f"Words of page {i}\nand {i * i} more" for i in range(60)} | {1000 + i: f"Words of page {i}" for i in range(300)}
    assert ht.extract(pages(spark, rows), use_site=False).where("page_id = 7").first()["text"].startswith("Take part")


def test_copies_of_an_article_on_a_site_stay(spark):
    page = lambda i, words: f"<nav><a>{i % 7}</a></nav><article><h1>{words} title</h1>" + "".join(f"<p>{words} {k}</p>" for k in range(12 if words == "same" else i % 5 + 1)) + "<p>License of all</p></article>"
    rows = [(i, f"http://one.example/{i}", page(i, "same" if i % 3 == 0 else f"own {i}"), "x", 0) for i in range(90)]
    for r in ht.extract(pages(spark, rows)).collect():
        i = r["page_id"]
        words = "same" if i % 3 == 0 else f"own {i}"
        assert r["text"].split("\n") == [f"{words} title", *[f"{words} {k}" for k in range(12 if i % 3 == 0 else i % 5 + 1)], "License of all"]


def test_odd_rows(spark):
    body = lambda i: f"<body><div class=a><span>Join our list today</span></div><div class=b><p>Own words of page {i}</p><p>and {i * i} more</p></div></body>"
    rows = [(i, f"http://one.example/{i}", body(i), "x", 0) for i in range(12)] + [(50, "http://two.example/", body(1), None, None), (51, None, None, "h", 1), (52, "odd url", "", "h", 1), (None, None, "<p>x", None, None)]
    rows.append(rows[0])
    got = Counter((r["page_id"], r["text"], r["n_chars"]) for r in ht.extract(pages(spark, rows)).collect())
    want = {i: f"Own words of page {i}\nand {i * i} more" for i in range(12)} | {50: "Join our list today\nOwn words of page 1\nand 1 more", 51: "", 52: "", None: "x"}
    assert got == Counter((i, want[i], len(want[i])) for i in [*want, 0])


def test_empty_table(spark):
    assert ht.extract(pages(spark, [])).isEmpty()


@pytest.mark.parametrize(
    "page,want",
    [
        ('<div class="layout has-sidebar"><article><p>a</p></article><div class="sidebar">s</div></div>', "a"),
        ('<div class="content no-sidebar"><div id="with-menu"><main>m</main></div></div>', "m"),
        ('<div class="layout has-sidebar"><main>m</main></div><article>teaser</article>', "m\nteaser"),
        ('<main>m</main><div class="related-posts"><article>teaser</article></div>', "m"),
        ('<div class="has-sidebar"><nav><article>n</article></nav></div><div>d</div>', "d"),
        ('<div class="content has-sidebar" role="main">m</div><div>d</div>', "m"),
    ],
)
def test_wrappers_with_a_noise_word_do_not_hide_the_article(page, want):
    assert text(page) == want
