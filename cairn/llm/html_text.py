"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged: a node of the tree is a path of tags,
classes, ids and places among siblings of one kind (the first ``OWN_PLACES`` are
nodes of their own, all later ones are one, so that the paragraphs of long pages
meet).  On every page a node has a presentation, the sequence of its block
children's tags, and a content, the text of its whole branch.  Over the pages
each has an entropy, to the base of how often it was seen: 0 where all pages show
the same, 1 where all differ.  The mean of both is what the site says of a node
(of one that never has block children, the content's alone).

A branch's importance on a page is a weighed mean of three things: the importance
of the branch that it is in (weight 1), what its tag, role, class or id say of it
(``EVIDENCE``), and what the site says, whose weight is the logarithm of how often
the node was seen, ``MOST_PAGES_WEIGHT`` at most, times the share of the host's pages
that have it.  From the top down, branches below ``LEAST`` are removed.  So the
site removes what it repeats, in an article too, and an article that is the same
on a large site's pages; names that say noise outweigh any entropy, because adverts
and comments can be as different from page to page as articles are.

Of what is left, where a page has an ``article`` or ``main``, only such parts are its
main text; else, where parts that just a class or id calls the content hold at
least ``LIKELY_SHARE`` of the text, only these.  An element whose class or id also
says something else ("layout has-sidebar") counts as neutral where it holds a main
element, or an article on a page without another main part.  Inline elements of noise and
what is never shown (scripts, styles, head and the like) have no text at all.

Pages with equal html are counted once.  A node seen twice or less gives no
evidence, as on a host with so few pages; there names and the branch above decide.

Text is taken block by block (paragraph, heading, list item, cell, ...), with
character references decoded and white space made one space; blocks are joined
by a newline.

A page is parsed once: its nodes and blocks are written to a table in the shared
folder, from which the trees are counted and the texts are put together.

Edge cases: null and empty html gives the empty text; broken markup is read as
far as it can be (open elements end with the page, an unfinished tag or comment
goes); a null or odd url belongs to the host ''; repeated rows are extracted
each; an empty table gives an empty result; other columns are ignored, whatever
their names; pages are read whole.
"""

from __future__ import annotations

import html as html_lib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import arrow_map, materialise, small_or_not, stored_rows
from cairn.sources.scratch import scratch_path

#: Parts that only their class or id calls the content count as such from this share of the page's text.
LIKELY_SHARE = 0.3
LEAST = 0.4
MOST_PAGES_WEIGHT = 8.0
#: Evidence of the site that weighs less than this is left out.
LEAST_WEIGHT = 0.01
OWN_PLACES = 3
#: Rows of the site trees that are broadcast; larger trees are joined.
BROADCAST_ROWS = 200_000
#: Pages of a host that are joined with its tree in one task.
PAGES_AT_ONCE = 5_000
#: Nesting beyond this is flattened.
MAX_DEPTH = 500

# Elements by what they are.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "input", "label", "fieldset", "menu", "dialog"}
UNSEEN_TAGS = {"script", "style", "noscript", "template", "iframe", "svg", "canvas", "object", "textarea", "head", "title", "audio", "video", "map"}
RAW_TAGS = {"script", "style", "textarea", "title", "noscript", "iframe", "template"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "status"}
NOISE_WORDS = {
    "ad", "ads", "adbox", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "announcement", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disclaimer", "disqus", "dropdown", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "notification", "overlay", "pager",
    "pagination", "popup", "privacy", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "topbar", "widget",
}
MAIN_WORDS = {"article", "content", "entry", "main", "post", "story"}
HEADER_WORDS = {"header", "byline"}
# The elements that a start tag ends when it finds them open, and how far up it looks.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
INLINE_LIMIT = {"div", "article", "section", "main", "body", "td", "th", "li", "table", "blockquote", "aside", "nav", "header", "footer", "form", "button"}

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|[!?][^>]*>?)", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")

# NAMED is noise by a class or id that says something else as well, such as "layout has-sidebar"
NEUTRAL, NOISE, MAIN, LIKELY, NAMED = 0, 1, 2, 3, 4
#: What roles say of an element's importance: a value, and how much it weighs.  The weight of noise exceeds all else: (1 + 8) / (1 + 16 + 8) < LEAST.
EVIDENCE = {NEUTRAL: (0.0, 0.0), NOISE: (0.0, 16.0), NAMED: (0.0, 16.0), MAIN: (1.0, 4.0), LIKELY: (1.0, 1.0)}


class Node:
    __slots__ = ("tag", "path", "role", "children", "kinds")

    def __init__(self, tag: str, path: int, role: int) -> None:
        self.tag, self.path, self.role = tag, path, role
        self.children: list[Node | str] = []
        self.kinds: dict[str, int] = {}

    def path_of(self, tag: str, names: str) -> int:
        """The tree's node of a new child."""
        kind = f"{tag}.{names}"
        place = self.kinds[kind] = min(self.kinds.get(kind, -1) + 1, OWN_PLACES)
        return _digest(f"{place}.{kind}", self.path)


def _digest(text: str, seed: int = 0) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"), seed) & 0x7FFFFFFFFFFFFFFF


def _role(tag: str, attributes: str, in_main: bool) -> tuple[int, str]:
    """What an element says it is, and its classes and ids."""
    names, role = "", NEUTRAL
    if tag in NOISE_TAGS or tag in UNSEEN_TAGS or (tag == "header" and not in_main):
        role = NOISE
    elif tag in ("article", "main"):
        role = MAIN
    if attributes and tag not in ("html", "body"):
        for name, *values in _ATTRIBUTE.findall(attributes):
            value = values[0] or values[1] or values[2]
            name = name.lower()
            if name in ("class", "id"):
                names += f"{name}={value};"
                words = {w.lower() for w in _WORD.findall(value)}
                noise = words & NOISE_WORDS - (HEADER_WORDS if in_main else set())
                # an article is noise only by a name that says nothing else, such as "comment"
                only = noise and any(t and all(w.lower() in NOISE_WORDS for w in _WORD.findall(t)) for t in value.split())
                if only:
                    role = NOISE
                elif noise and role not in (MAIN, NOISE):
                    role = NAMED
                elif role == NEUTRAL and words & MAIN_WORDS:
                    role = LIKELY
            elif name == "role" and value.lower() in NOISE_ROLES:
                role = NOISE
            elif name == "role" and value.lower() in ("main", "article") and role != NOISE:
                role = MAIN
            elif name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                role = NOISE
    return role, names


def _open_wrappers(root: Node) -> None:
    """Makes ``NAMED`` elements neutral that hold a main element, or an article where the page has no other main part."""
    nodes, above, seen = [root], [-1], [True]
    for i, node in enumerate(nodes):  # grows meanwhile
        for c in node.children:
            if isinstance(c, Node) and c.role != NOISE:
                nodes.append(c)
                above.append(i)
                seen.append(seen[i] and c.role != NAMED)
    holds = [0 if n.role != MAIN else 1 if n.tag == "article" else 2 for n in nodes]
    least = 2 if any(h and s for h, s in zip(holds, seen, strict=True)) else 1
    for i in range(len(nodes) - 1, 0, -1):
        if nodes[i].role == NAMED and holds[i] >= least:
            nodes[i].role = NEUTRAL
        holds[above[i]] = max(holds[above[i]], holds[i])


def parse(page: str) -> Node:
    """The page's tree; forgiving, and without recursion."""
    root = Node("#root", 0, NEUTRAL)
    stack = [root]
    at, end = 0, len(page)
    named = False
    while at < end:
        begin = page.find("<", at)
        if begin < 0:
            stack[-1].children.append(page[at:])
            break
        if begin > at:
            stack[-1].children.append(page[at:begin])
        found = _TAG.match(page, begin) or _LOOSE.match(page, begin)
        if found is None:
            if page[begin + 1 : begin + 2].isalpha() or page[begin + 1 : begin + 2] in ("/", "!", "?"):
                if page.find(">", begin) < 0:
                    break  # an unfinished tag
            stack[-1].children.append("<")
            at = begin + 1
            continue
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
                if tag not in BLOCK and stack[i].tag in INLINE_LIMIT:
                    break
            continue
        if tag in BLOCK and tag not in ("html", "body"):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    del stack[i:]
                    break
                if stack[i].tag in INLINE_LIMIT:
                    break
        if tag in ENDS:
            ended, limit = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in limit:
                    break
                if stack[i].tag in ended:
                    del stack[i:]
                    break
        attributes = found.group(3)
        in_main = any(n.role in (MAIN, LIKELY) for n in stack)
        role, names = _role(tag, attributes, in_main)
        named |= role == NAMED
        node = Node(tag, stack[-1].path_of(tag, names), role)
        stack[-1].children.append(node)
        if tag in RAW_TAGS:
            close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if close is None:
                break
            at = page.find(">", close.end() - 1) + 1
            if at == 0:
                break
            continue
        if tag not in VOID and not attributes.endswith("/") and len(stack) < MAX_DEPTH:
            stack.append(node)
    if named:
        _open_wrappers(root)
    return root


@dataclass
class Page:
    """What a page adds to its site's tree, and what its text is made from."""

    nodes: list[int]  # in page order, only those with text in their branch
    up: list[int]  # the node that one is in; -1 for the first
    roles: list[int]
    shown: list[int]  # presentation; 0 without block children
    said: list[int]  # content
    at: list[int]  # the node of each block
    texts: list[str]


def read_page(page: str | None) -> Page:
    """The page's blocks of text in page order, each with its node; noise among them."""
    root = parse(page or "")
    out = Page([], [], [], [], [], [], [])
    digests: list[list[int]] = []
    held: list[str] = []
    trail: list[tuple[Node, int]] = []  # block elements around, and their numbers, -1 while they have no text

    def flush() -> None:
        if not held:
            return
        text = _SPACE.sub(" ", html_lib.unescape("".join(held))).strip()
        held.clear()
        if not text:
            return
        digest = _digest(text)
        for i, (node, number) in enumerate(trail):
            if number < 0:
                number = len(out.nodes)
                trail[i] = node, number
                out.nodes.append(node.path)
                out.up.append(trail[i - 1][1] if i else -1)
                out.roles.append(node.role)
                inner = [c.tag for c in node.children if isinstance(c, Node) and c.tag in BLOCK]
                out.shown.append(_digest(" ".join(inner)) if inner else 0)
                digests.append([])
            digests[number].append(digest)
        out.at.append(trail[-1][1])
        out.texts.append(text)

    todo: list[tuple[int, Node | str]] = [(0, root)]
    while todo:
        leave, node = todo.pop()
        if leave:
            flush()
            trail.pop()
        elif isinstance(node, str):
            held.append(node)
        elif node.tag in UNSEEN_TAGS or (node.role in (NOISE, NAMED) and node.tag not in BLOCK):
            if node.tag in BLOCK:
                flush()
        elif node.tag == "br":
            held.append(" ")
        else:
            if node.tag in BLOCK or node is root:
                flush()
                trail.append((node, -1))
                todo.append((1, node))
            todo.extend((0, c) for c in reversed(node.children))
    out.said = [xxhash.xxh64_intdigest(np.array(d, np.int64).tobytes()) & 0x7FFFFFFFFFFFFFFF for d in digests]
    return out


def importances(page: Page, site: dict[int, tuple[float, float]]) -> list[float]:
    """The importance of each of the page's branches; 0 below a removed one.  ``site``: (value, weight) of nodes."""
    out: list[float] = []
    for node, up, role in zip(page.nodes, page.up, page.roles, strict=True):
        above = out[up] if up >= 0 else 1.0
        named, by_name = EVIDENCE[role]
        seen, by_site = site.get(node, (0.0, 0.0))
        value = (above + named * by_name + seen * by_site) / (1.0 + by_name + by_site)
        out.append(value if above >= LEAST else 0.0)
    return out


def main_text(page: Page, site: dict[int, tuple[float, float]]) -> str:
    """The page's main text under what its site's tree says of its nodes."""
    value = importances(page, site)
    inside: list[int] = []  # the best kind of part that a node is in: 2 main, 1 likely, 0 neither
    for up, role, v in zip(page.up, page.roles, value, strict=True):
        own = 0 if v < LEAST else 2 if role == MAIN else 1 if role == LIKELY else 0
        inside.append(max(own, inside[up] if up >= 0 else 0))
    kept = [(inside[a], t) for a, t in zip(page.at, page.texts, strict=True) if value[a] >= LEAST]
    least = 2 if any(i == 2 for i, _ in kept) else 1 if sum(len(t) for i, t in kept if i) >= LIKELY_SHARE * sum(len(t) for _, t in kept) else 0
    return "\n".join(t for i, t in kept if i >= least)


HOST = r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_LISTS = {"nodes": pa.int64(), "up": pa.int32(), "roles": pa.int8(), "shown": pa.int64(), "said": pa.int64(), "at": pa.int32(), "texts": pa.string()}
_PARSED = "nodes array<bigint>, up array<int>, roles array<tinyint>, shown array<bigint>, said array<bigint>, at array<int>, texts array<string>"


def parsed(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id") -> DataFrame:
    """Every page, parsed: (key, url, host, digest, the lists of :class:`Page`)."""
    host = F.lower(F.coalesce(F.regexp_extract(F.col(url), HOST, 1), F.lit("")))
    source = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), host.alias("host"), F.xxhash64(html).alias("digest"), F.col(html).alias("html"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [read_page(p) for p in batch.column(4).to_pylist()]
        lists = []
        for name, kind in _LISTS.items():
            parts = [getattr(m, name) for m in made]
            ends = pa.array(np.cumsum([0] + [len(x) for x in parts]), pa.int32())
            lists.append(pa.ListArray.from_arrays(ends, pa.array([v for x in parts for v in x], kind)))
        return pa.RecordBatch.from_arrays([*batch.columns[:4], *lists], ["key", "url", "host", "digest", *_LISTS])

    kinds = {c: pages.schema[n].dataType.simpleString() for c, n in (("key", key), ("url", url))}
    return arrow_map(source, rows, f"key {kinds['key']}, url {kinds['url']}, host string, digest long, {_PARSED}")


def site_tree(pages: DataFrame) -> DataFrame:
    """The trees of :func:`parsed` pages: (host, node, value, weight, pages), what the site says of a node, what that weighs and the host's pages.

    Only counts are shuffled, after each task has added up its own, so a host with very many pages costs no more than others.
    """
    # of pages with equal html each counts for its share, so that nothing but counts is shuffled
    equal = materialise(pages.groupBy("host", "digest").agg(F.count("*").alias("copies")).where("copies > 1"))
    weighed = pages.select("host", "digest", "nodes", "shown", "said").join(small_or_not(equal), ["host", "digest"], "left")
    met = F.expr("array_distinct(flatten(transform(arrays_zip(nodes, shown, said), n -> array(struct(n.nodes AS node, false AS content, n.shown AS feature), struct(n.nodes AS node, true AS content, n.said AS feature)))))")
    each = weighed.select("host", (1 / F.coalesce("copies", F.lit(1))).alias("share"), F.explode(met).alias("f"))
    counts = each.groupBy("host", "f.node", "f.content", "f.feature").agg(F.round(F.sum("share")).cast("long").alias("k"))
    own = counts.groupBy("host", "node", "content").agg(F.sum("k").alias("m"), F.sum(F.col("k") * F.log("k")).alias("klogk"), F.max("feature").alias("top"))
    entropy = F.when(F.col("m") > 2, (F.log("m") - F.col("klogk") / F.col("m")) / F.log("m"))
    of = lambda content, c: F.max(F.when(F.col("content") == content, c))
    nodes = own.groupBy("host", "node").agg(of(True, entropy).alias("said"), of(False, entropy).alias("shown"), of(True, F.col("m")).alias("m"), of(False, F.col("top")).alias("top"))
    hosts = pages.groupBy("host", "digest").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count("*").alias("pages"))
    value = F.when(F.col("top") == 0, F.col("said")).otherwise((F.col("said") + F.coalesce("shown", F.lit(0.0))) / 2)
    weight = F.least(F.lit(MOST_PAGES_WEIGHT), F.log2("m")) * F.least(F.lit(1.0), F.col("m") / F.col("pages"))
    return nodes.where("m > 2").join(hosts, "host").select("host", "node", value.alias("value"), weight.alias("weight"), "pages").where(F.col("weight") >= LEAST_WEIGHT)


def extract(pages: DataFrame, html: str = "html", url: str = "url", key: str = "page_id", use_site: bool = True) -> DataFrame:
    """One row per page: the key, the url, ``text`` and ``n_chars``.  Without ``use_site`` names alone decide, for comparison."""
    spark = pages.sparkSession
    path = scratch_path(spark, "pages")
    parsed(pages, html, url, key).write.option("compression", "zstd").parquet(path)
    made = spark.read.parquet(path)
    tree = materialise(site_tree(made) if use_site else site_tree(made).limit(0))
    out = ["key", "url", "text", "n_chars"]
    columns = ["key", "url", "host", *_LISTS]

    def finished(batch: pa.RecordBatch, sites) -> pa.RecordBatch:
        lists = zip(*(batch.column(i).to_pylist() for i in range(3, 3 + len(_LISTS))), strict=True)
        texts = [main_text(Page(*x), site) for x, site in zip(lists, sites, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out)

    schema = f"key {made.schema['key'].dataType.simpleString()}, url {made.schema['url'].dataType.simpleString()}, text string, n_chars long"
    if stored_rows(tree) <= BROADCAST_ROWS:
        by_host: dict[str, dict[int, tuple[float, float]]] = {}
        for r in tree.toLocalIterator():
            by_host.setdefault(r["host"], {})[r["node"]] = r["value"], r["weight"]
        shared = spark.sparkContext.broadcast(by_host)
        done = arrow_map(made.select(*columns), lambda batch: finished(batch, [shared.value.get(h, {}) for h in batch.column(2).to_pylist()]), schema)
    else:
        # a tree of any size: one row a host, as often as the host's pages fill tasks; a node that counts is on a fair share of the pages, so rows are short
        parts = F.ceil(F.col("pages") / PAGES_AT_ONCE).cast("int")
        rows = tree.groupBy("host").agg(F.max("pages").alias("pages"), F.collect_list(F.struct("node", "value", "weight")).alias("tree"))
        rows = materialise(rows.select("host", "tree", parts.alias("parts")))
        split = made.join(small_or_not(materialise(rows.where("parts > 1").select("host", "parts"))), "host", "left")
        split = split.withColumn("part", F.pmod(F.xxhash64("key", "digest"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        trees = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        joined = split.join(trees.select("host", "part", "tree"), ["host", "part"], "left").select(*columns, "tree")
        site = lambda entries: {e["node"]: (e["value"], e["weight"]) for e in entries or ()}
        done = arrow_map(joined, lambda batch: finished(batch, [site(t) for t in batch.column(3 + len(_LISTS)).to_pylist()]), schema)
    return done.withColumnsRenamed({"key": key, "url": url})
