"""HTML extraction by wrapper induction: trees of a host's pages are aligned; what stays the same is template."""

from __future__ import annotations

import functools
import html as entities
import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import stage

# HTML's elements without content, its block elements, and elements that hold no prose.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
            "footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary "
            "table tbody td tfoot th thead tr ul".split())
NO_PROSE = set("head title script style noscript template iframe svg canvas object audio video map nav aside footer button select "
               "textarea option datalist dialog menu".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Words of class and id that name a part which is not the article.
PARTS = set("""nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager topbar skiplink
sidebar sidebars widget widgets related recommended recommendations share sharing social
notice notices cookie cookies consent gdpr banner banners alert alerts popup modal overlay newsletter subscribe subscription
promo promotion paywall ad ads adv advert adverts advertisement advertisements advertising adsbygoogle sponsor sponsored sponsors
comment comments commentlist disqus replies reply respond discussion footer foot copyright search login signup""".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
#: An open element that each start tag closes, and where the search for it stops.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"td", "th", "tr"}, {"table"}), "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"})}
P_STOPS = {"table", "td", "th", "caption", "button"}

#: A slot is template where its text is the same on so large a part of a host's pages of different content,
#: if there are so many; inside an article, which may quote or be copied, nearly all must agree.
OUTSIDE_SHARE, OUTSIDE_PAGES = 0.5, 2
INSIDE_SHARE, INSIDE_PAGES = 0.9, 5
LINK_SHARE = 0.9
CACHED_TREES = 2000
MASK_BITS = 1024

#: Comments and declarations, or a tag; a quoted value may hold ">". The possessive repeat never goes back.
TOKEN = re.compile(r"""<(?:!--(?:-?>|.*?(?:--!?>|\Z))|[!?][^>]*(?:>|\Z)|/[^a-zA-Z][^>]*(?:>|\Z)
    |(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>="']+|=\s*"[^"]*"|=\s*'[^']*'|[="'])*+)(?:>|\Z))""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"']+)))?""")
TELLING = re.compile(r"class|id|role|hidden|style|itemprop", re.I)  # no other attribute is looked at
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp")}
BROADCAST_BYTES = 64 << 20


class Node:
    __slots__ = ("tag", "label", "kids", "parent", "mark", "text", "chars", "links", "drop", "inner", "sig", "size", "shape",
                 "mask", "at")

    def __init__(self, tag: str, label: str, parent: Node | None, mark: str | None):
        self.tag, self.label, self.parent, self.mark = tag, hash(label), parent, mark
        self.kids, self.text, self.chars, self.links, self.drop = [], None, 0, 0, False


@functools.lru_cache(maxsize=1 << 16)
def _mark(tag: str, written: str) -> tuple[str | None, str]:
    """What an element's name and attributes say: `never` prose, a named `part`, a `header`, `main`, or nothing;
    and its label, the name with the class."""
    attrs: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(written):
        attrs.setdefault(name.lower(), entities.unescape(max(values)))
    return _told(tag, attrs), f"{tag} {attrs.get('class', '')}"


def _told(tag: str, attrs: dict[str, str]) -> str | None:
    if tag in NO_PROSE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return "never"
    if "style" in attrs and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs["style"], re.I):
        return "never"
    words = set(re.split(r"[^a-z0-9]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())) if attrs else set()
    if words & PARTS or attrs.get("role", "").lower() in ROLES or tag == "form":
        return "part"
    if tag in ("header", "hgroup") or words & {"header", "masthead"} and tag != "article":
        return "header"
    if tag == "main" or attrs.get("role") == "main" or "articlebody" in attrs.get("itemprop", "").lower():
        return "main"
    return None


class _Tree:
    """Block elements as nodes, the text between their borders as leaves; inline markup goes, <br> is a border."""

    def __init__(self, page: str):
        self.root = self.here = Node("", "", None, None)
        self.nodes, self.open, self.count, self.buffer, self.anchored = [self.root], [], {}, [], 0
        at, end = 0, len(page)
        while at < end:
            token = TOKEN.search(page, at)
            until = token.start() if token else end
            if until > at:
                self.data(page[at:until])
            if token is None:
                break
            at, tag = token.end(), token["tag"]
            if tag is None:
                continue
            tag = tag.lower()
            if token["end"]:
                self.end(tag)
                continue
            self.start(tag, token["attrs"])
            if tag in RAW:
                close = RAW[tag].search(page, at)
                at = close.start() if close else end
        self.flush()

    def flush(self) -> None:
        if self.buffer:
            text = " ".join("".join(self.buffer).split())
            if text:
                leaf = Node("#", "#", self.here, None)
                leaf.text, leaf.chars, leaf.links = text, len(text), min(self.anchored, len(text))
                self.here.kids.append(leaf)
                self.nodes.append(leaf)
            self.buffer, self.anchored = [], 0

    def _pop(self, k: int) -> None:
        """Close the open elements from the k-th on."""
        for tag, node in reversed(self.open[k:]):
            self.count[tag] -= 1
            if node is not None:
                self.flush()
                self.here = node.parent
        del self.open[k:]

    def _close(self, tags: set[str], stops: set[str]) -> None:
        if not any(self.count.get(t) for t in tags):
            return
        found = None
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] in stops:
                break
            if self.open[k][0] in tags:
                found = k
                if len(tags) == 1:
                    break
        if found is not None:
            self._pop(found)

    def start(self, tag: str, attrs: str) -> None:
        if tag in VOID:
            if tag in ("br", "hr"):
                self.flush()
            return
        if tag in BLOCK:
            self._close({"p"}, P_STOPS)
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        mark, label = _mark(tag, attrs if TELLING.search(attrs) else "")
        node = None
        if tag in BLOCK or mark:
            self.flush()
            node = Node(tag, label, self.here, mark)
            self.here.kids.append(node)
            self.nodes.append(node)
            self.here = node
        self.open.append((tag, node))
        self.count[tag] = self.count.get(tag, 0) + 1

    def end(self, tag: str) -> None:
        if not self.count.get(tag):
            if tag == "p":
                self.flush()
            return
        block = tag in BLOCK
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                self._pop(k)
                return
            if not block and self.open[k][0] in BLOCK:
                return

    def data(self, data: str) -> None:
        if "&" in data:
            data = entities.unescape(data)
        self.buffer.append(data)
        if self.count.get("a"):
            self.anchored += len(data.strip())


def _ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def content_tree(html: str) -> tuple[Node, bool]:
    """The page's tree without the parts that names tell apart, as a root of the outermost articles, else of the main
    element (True), else of the whole body (False). Nodes that hold only text are leaves with one text."""
    parser = _Tree(html)
    nodes = parser.nodes  # parents come before their children
    for x in reversed(nodes):
        if x.parent is not None:
            x.parent.chars += x.chars
            x.parent.links += x.links
    for x in nodes[1:]:
        x.drop = x.parent.drop or x.mark == "never"
    articles = [x for x in nodes if x.tag == "article" and not x.drop and x.mark != "part"]
    held: set[int] = set()  # a part that holds the largest article or the main element is a frame of the page, not a part
    for x in [max(articles, key=lambda x: x.chars)] if articles else []:
        held.update(map(id, _ancestors(x)))
    for x in nodes:
        if x.mark == "main" and not x.drop:
            held.update(map(id, _ancestors(x)))
    for pass_ in ("parts", "all"):
        total, heads = 0, set()
        for x in nodes[1:]:
            x.drop = x.parent.drop or x.mark == "never"
            if pass_ == "parts" and x.mark in ("part", "header") and id(x) not in held:
                if x.mark == "header" and any(y.tag == "article" or y.mark == "main" for y in _ancestors(x.parent)):
                    heads.add(id(x))  # of an article's own header, the headings stay
                else:
                    x.drop = True
            if x.tag not in HEADINGS and id(x.parent) in heads:
                heads.add(id(x))
                x.drop = x.drop or x.text is not None
            total += len(x.text) if x.text is not None and not x.drop else 0
        if total:
            break  # else the names have hidden the whole page, so they say nothing here
    tops = [x for x in nodes if x.tag == "article" and not x.drop]
    tops = tops or [x for x in nodes if x.mark == "main" and not x.drop]
    inside = bool(tops)
    if inside:
        ids = set(map(id, tops))
        tops = [x for x in tops if not any(id(y) in ids for y in _ancestors(x.parent))]
    root = Node("", "", None, None)
    root.kids = tops if inside else [parser.root]
    for x in [*reversed(nodes), root]:
        if not inside and x.tag in ("ul", "ol", "dl", "div", "table") and x.chars and x.links >= LINK_SHARE * x.chars and len(x.kids) > 1:
            x.drop = True  # nothing but links: a menu
        x.kids = [k for k in x.kids if not k.drop and (k.text or k.kids)]
        if x.kids and all(k.tag == "#" for k in x.kids) and x is not root:
            x.text, x.kids = " ".join(k.text for k in x.kids), []
        x.inner = [i for i, k in enumerate(x.kids) if k.text is None]
        x.sig = hash((x.label, x.text, *(k.sig for k in x.kids)))
        x.shape = hash((x.label, *(k.shape for k in x.kids)))
        x.size = 2 if x.text is not None else 1 + sum(k.size for k in x.kids)
        x.mask = 1 << x.sig % MASK_BITS if x.text is not None else functools.reduce(lambda m, k: m | k.mask, x.kids, 0)
    return root, inside


def leaves(root: Node) -> list[Node]:
    """The leaves in page order, numbered."""
    out, work = [], [root]
    while work:
        x = work.pop()
        if x.text is not None:
            x.at = len(out)
            out.append(x)
        work += reversed(x.kids)
    return out


def match_trees(a: Node, b: Node, memo: dict) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching of two nodes of one label: the greatest weight of pairs that keep order and depth, and
    its pairs of leaves with equal text. A pair of equal labels weighs 1, of leaves with equal text 2."""
    if a.sig == b.sig:
        return a.size, list(zip(leaves_of(a), leaves_of(b)))
    if not a.kids or not b.kids:
        return 1, []
    apart = not a.mask & b.mask  # no leaf in common, so only the shapes count
    if apart and (a.shape, b.shape) in memo:
        return memo[a.shape, b.shape], []
    la, lb = (np.array([k.label for k in x.kids]) for x in (a, b))
    sa, sb = (np.array([k.sig for k in x.kids]) for x in (a, b))
    same = la[:, None] == lb[None, :]
    weight = same.astype(np.int32) + (same & (sa[:, None] == sb[None, :]))
    below: dict[tuple[int, int], list] = {}
    for i in a.inner:
        for j in b.inner:
            if same[i, j]:
                weight[i, j], below[i, j] = match_trees(a.kids[i], b.kids[j], memo)
    m, n = weight.shape
    rows = np.zeros((m + 1, n + 1), np.int32)
    for i in range(m):  # the running maximum stands for the step to the left
        rows[i + 1, 1:] = np.maximum.accumulate(np.maximum(rows[i, 1:], rows[i, :-1] + weight[i]))
    total, pairs = 1 + int(rows[m, n]), []
    if apart:
        memo[a.shape, b.shape] = total
        return total, pairs
    i, j = m, n
    while i and j:
        if rows[i, j] == rows[i - 1, j]:
            i -= 1
        elif rows[i, j] == rows[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            if (i, j) in below:
                pairs += below[i, j]
            elif a.kids[i].sig == b.kids[j].sig:
                pairs.append((a.kids[i], b.kids[j]))
    return total, pairs


def leaves_of(x: Node) -> Iterator[Node]:
    work = [x]
    while work:
        y = work.pop()
        if y.text is not None:
            yield y
        work += reversed(y.kids)


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each page's leaves, and with the same text as the reference's aligned leaf, that leaf's number."""
    sys.setrecursionlimit(1_000_000)  # trees are as deep as pages nest
    trees: dict[str, Node] = {}
    for b in batches:
        texts, slots, insides = [], [], []
        for html, reference in zip(b.column("html").to_pylist(), b.column("reference").to_pylist()):
            root, inside = content_tree(html or "")
            parts = leaves(root)
            slot = [-1] * len(parts)
            if reference is not None:
                if reference not in trees:
                    if len(trees) >= CACHED_TREES:
                        trees.clear()
                    trees[reference] = content_tree(reference)[0]
                    leaves(trees[reference])
                for x, y in match_trees(root, trees[reference], {})[1]:
                    slot[x.at] = y.at
            texts.append([x.text for x in parts])
            slots.append(slot)
            insides.append(inside)
        yield pa.RecordBatch.from_arrays([
            b.column("page_id"), b.column("url"), b.column("host"), pa.array(texts, pa.list_(pa.string())),
            pa.array(slots, pa.list_(pa.int32())), pa.array(insides, pa.bool_())],
            names=["page_id", "url", "host", "texts", "slots", "inside"])


def _references(pages: DataFrame) -> DataFrame:
    """(host, reference): a host's shortest page of its most frequent layout, where it has two pages at least.

    A layout is the set of a page's elements, inline ones aside. The shortest page shows the template with
    the least content; a page cut off lacks elements and so is of another layout.
    """
    inline = F.array(*map(F.lit, "a b i em strong span br img sub sup code small u q cite font h2 h3 h4 h5 h6 ul ol li".split()))
    tags = F.array_sort(F.array_except(F.array_distinct(F.regexp_extract_all(
        F.lower("html"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))), inline))
    sized = pages.filter("host IS NOT NULL AND html IS NOT NULL").select(
        "host", F.xxhash64(F.array_join(tags, " ")).alias("layout"),
        F.struct(F.length("html").alias("n"), F.xxhash64("html").alias("h")).alias("page"))
    layouts = sized.groupBy("host", "layout").agg(F.count("*").alias("n"), F.min("page").alias("page"))
    best = layouts.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "layout", "page")).alias("best")).filter(
        "pages > 1").select(F.col("host").alias("_host"), F.col("best.page.n").alias("_n"), F.col("best.page.h").alias("_h"))
    rows = pages.join(stage(best, "layouts"), (F.col("host") == F.col("_host")) & (F.length("html") == F.col("_n")) & (
        F.xxhash64("html") == F.col("_h")))
    return stage(rows.groupBy("host").agg(F.min("html").alias("reference")), "references")


def _small(df: DataFrame, row_bytes) -> DataFrame:
    """Broadcast a stored table within the bound of bytes. Beyond it the join shuffles, and adaptive execution
    splits the partition of a host with very many pages."""
    return F.broadcast(df) if (df.agg(F.sum(row_bytes)).first()[0] or 0) <= BROADCAST_BYTES else df


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars: a row a page. Null or empty html gives an empty text; null and repeated ids
    and urls are returned as they come, and a url without a host has no template.

    Parts that names tell (elements, roles, words of class and id) are cut first: menus, headers, footers,
    sidebars, notices, adverts, forms, reader comments. The rest is aligned with the host's reference page by
    simple tree matching, and each leaf that equals its slot votes; pages of equal content vote once. A slot
    most of a host's pages agree on is template, what varies is content. An article's slot goes only if
    nearly all pages agree, and not if over half of the article would go: that is a copy, not a template.
    """
    host = F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.nullif(host, F.lit("")).alias("host"),
                        F.col(html_col).cast("string").alias("html"))
    references = _references(rows)
    with_reference = rows.join(_small(references, F.octet_length("reference") + 64).withColumnRenamed("host", "_host"),
                               F.col("host") == F.col("_host"), "left").select("page_id", "url", "host", "html", "reference")
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    found = stage(with_reference.mapInArrow(_aligned, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, texts "
                                            "array<string>, slots array<int>, inside boolean"), "parts")
    per_content = found.filter("host IS NOT NULL").groupBy("host", F.xxhash64("texts").alias("content")).agg(
        F.min(F.struct("slots", "inside")).alias("page")).select("host", "page.*")
    counted = per_content.select("host", "inside", F.explode(F.array_append(F.filter("slots", lambda k: k >= 0), F.lit(-1))).alias(
        "slot")).groupBy("host", "slot").agg(F.count("*").alias("n"))
    every = F.max(F.when(F.col("slot") == -1, F.col("n"))).over(W.partitionBy("host"))
    shares = counted.withColumn("pages", every).filter((F.col("slot") >= 0) & (F.col("pages") >= OUTSIDE_PAGES) & (
        F.col("n") > OUTSIDE_SHARE * F.col("pages")))
    strict = (F.col("n") >= INSIDE_SHARE * F.col("pages")) & (F.col("pages") >= INSIDE_PAGES)
    template = stage(shares.groupBy(F.col("host").alias("_host")).agg(
        F.collect_set("slot").alias("outside_slots"), F.collect_set(F.when(strict, F.col("slot"))).alias("inside_slots")), "templates")
    known = found.join(_small(template, F.size("outside_slots") * 8 + 64), F.col("host") == F.col("_host"), "left")
    none = F.expr("CAST(array() AS array<int>)")
    slots = F.coalesce(F.when(F.col("inside"), F.col("inside_slots")).otherwise(F.col("outside_slots")), none)
    varying = F.filter(F.arrays_zip("texts", "slots"), lambda x: ~F.array_contains(F.col("fixed"), x["slots"]))
    chars = lambda c: F.aggregate(c, F.lit(0), lambda n, t: n + F.length(t))
    left = known.withColumn("fixed", slots).select(
        "page_id", "url", "inside", "texts", F.when(F.size("fixed") == 0, F.col("texts")).otherwise(
            F.transform(varying, lambda x: x["texts"])).alias("kept"))
    copy = F.col("inside") & (chars("kept") * 2 < chars("texts"))
    text = F.array_join(F.when(copy, F.col("texts")).otherwise(F.col("kept")), " ")
    return left.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
