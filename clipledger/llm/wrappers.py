"""Main text of web pages by wrapper induction.

Pages are read into trees of block elements with runs of text between them. Each page is aligned with reference pages of
its host by simple tree matching: the largest set of node pairs with equal labels that keeps order and ancestry. An
aligned run of text with the same words on both pages speaks for a constant slot, one with other words for a varying
slot; the votes are added up per host and slot (the path of labels from the root). Slots that are all but always
constant are the host's template and are left out; varying slots are content. What markup itself declares as no part of
the article (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles) is left out on every
page, and where a page marks its article or main part, text outside is too.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipledger.llm.support import broadcast_if_small, stage
from clipledger.llm.url_filter import host_and_path

#: Reference pages of a host, and parts that a host's pages are dealt out over, so that none fills a task.
REFERENCES, SALTS = 3, 16
#: Reference pages and templates up to these sizes, which are measured, are broadcast; larger ones meet the pages by salted shuffle.
MAX_BROADCAST_ROWS, MAX_BROADCAST_BYTES = 20_000, 8 << 20
#: Characters of reference pages, and entries of shapes, that a task holds at once.
HELD_CHARS, HELD_SHAPES = 4 << 20, 400_000
#: A slot is template if this share of at least so many aligned pairs of runs are equal.
CONSTANT, VOTES = 0.95, 4

# Names of HTML.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup"
    " time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math xmp noembed noframes object".split())
OUTSIDE = frozenset("nav header footer aside form button select dialog menu head".split())
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th"),
}
#: Where an implied end does not reach out of.
SCOPES = frozenset("table ul ol dl article main section div body html td th".split())
#: Words of class, id or role that name what is not the article.
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner menu nav navbar navigation breadcrumb breadcrumbs"
    " header masthead footer sidebar aside widget related recommended newsletter subscribe subscription signup login cookie cookies"
    " consent gdpr notice notices alert popup modal overlay comment comments disqus replies share sharing social toolbar pagination"
    " pager search contentinfo complementary navigation form skip".split()
)
MAIN = ("article", "main")

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^<]+|<)", re.S
)
_NAMES = re.compile(r"(?<![\w-])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[a-z]+")


class Node:
    """A block element, or a run of text (label #text)."""

    __slots__ = ("label", "tag", "children", "text", "outside", "shape")

    def __init__(self, label: str, tag: str = "", text: str = "", outside: bool = False) -> None:
        self.label, self.tag, self.children, self.text, self.outside, self.shape = label, tag, [], text, outside, -1


def _hinted(attributes: str) -> tuple[str, bool]:
    """What tells an element from others of its tag, and whether it is named as no part of the article."""
    names = [next(x for x in m if x).lower() for m in _NAMES.findall(attributes) if any(m)] if attributes else []
    words = [w for n in names for w in _WORD.findall(n)]
    return "." + ".".join(sorted({n for x in names for n in x.split()})) if names else "", any(w in HINTS for w in words)


def parse(page: str) -> Node:
    """The tree of a page. Unclosed and stray tags never fail; a paragraph ends where the next block starts."""
    root = Node("#root")
    open_, run, skip = [root], [], []  # skip: tags open inside an inline element that is left out
    at, size = 0, len(page)

    def flush() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            open_[-1].children.append(Node("#text", text=text))

    def close(tags: tuple[str, ...]) -> None:
        for i in range(len(open_) - 1, 0, -1):
            if open_[i].tag in tags:
                flush()
                del open_[i:]
                return
            if open_[i].tag in SCOPES:
                return

    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        ending, tag, attributes, text = m.groups()
        if text is not None:
            if not skip:
                run.append(entities.unescape(text))
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if skip:
            if tag not in VOID:
                if not ending:
                    skip.append(tag)
                elif tag in skip:
                    while skip.pop() != tag:
                        pass
            continue
        if ending:
            if tag in INLINE:
                continue
            for i in range(len(open_) - 1, 0, -1):
                if open_[i].tag == tag:
                    flush()
                    del open_[i:]
                    break
            continue
        if tag in RAW:
            if not attributes.rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else size
            continue
        if tag == "br":
            run.append(" ")
            continue
        if tag in INLINE:
            if attributes and _hinted(attributes)[1]:
                skip.append(tag)
            continue
        close(CLOSES.get(tag, ()))
        if any(n.tag == "p" for n in open_[-3:]):
            close(("p",))
        flush()
        if tag in VOID:
            continue
        name, hint = _hinted(attributes)
        node = Node(tag + name, tag, outside=tag in OUTSIDE or hint and tag not in ("html", "body", "main"))
        open_[-1].children.append(node)
        open_.append(node)
    flush()
    return root


class Shapes:
    """Trees of labels, numbered, and how two of them match. Pages of a kind share most shapes, so each pair is matched once."""

    def __init__(self) -> None:
        self.numbers: dict[tuple[str, tuple[int, ...]], int] = {}
        self.labels: list[str] = []
        self.children: list[tuple[int, ...]] = []
        self.best: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}
        self.held = 0  # entries, for the caller to let go of all in time

    def number(self, node: Node) -> int:
        """The shape of a node; also set on all nodes below."""
        key = (node.label, tuple([self.number(c) for c in node.children]))
        shape = self.numbers.get(key)
        if shape is None:
            shape = self.numbers[key] = len(self.labels)
            self.labels.append(key[0])
            self.children.append(key[1])
            self.held += 1 + len(key[1])
        node.shape = shape
        return shape

    def match(self, x: int, y: int) -> int:
        """Size of the largest matching of two trees whose roots have the same label; keeps which children are paired."""
        known = self.best.get((x, y))
        if known:
            return known[0]
        labels, xs, ys = self.labels, self.children[x], self.children[y]
        if [labels[c] for c in xs] == [labels[d] for d in ys]:
            pairs = [(i, i) for i in range(len(xs))]
            total = 1 + sum([self.match(c, d) for c, d in zip(xs, ys)])
        else:
            w = {c: [self.match(c, d) if labels[c] == labels[d] else 0 for d in ys] for c in set(xs)}
            best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
            for i, c in enumerate(xs):
                above, here = best[i], best[i + 1]
                for j, v in enumerate(w[c]):
                    here[j + 1] = max(above[j + 1], here[j], above[j] + v)
            pairs, i, j = [], len(xs), len(ys)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    pairs.append((i, j))
            total = 1 + best[len(xs)][len(ys)]
        self.best[x, y] = (total, pairs)
        self.held += 1 + len(pairs)
        return total


def matched(a: Node, b: Node, shapes: Shapes | None = None) -> list[tuple[Node, Node, str]]:
    """Pairs of text runs that simple tree matching aligns, each with its path. Trees that `shapes` has numbered stay numbered."""
    if shapes is None:
        shapes = Shapes()
        shapes.number(a), shapes.number(b)
    shapes.match(a.shape, b.shape)
    out, todo = [], [(a, b, "")]
    while todo:
        x, y, path = todo.pop()
        xs, ys = x.children, y.children
        for i, j in shapes.best[x.shape, y.shape][1]:
            c = xs[i]
            where = f"{path}/{c.label}"
            if c.label == "#text":
                out.append((c, ys[j], where))
            elif c.children:
                todo.append((c, ys[j], where))
    return out


def _votes(tree: Node, other: Node, shapes: Shapes | None = None) -> dict[str, tuple[int, int]]:
    """Per path: pairs of runs that are equal, and all."""
    out: dict[str, tuple[int, int]] = {}
    for x, y, path in matched(tree, other, shapes):
        equal, every = out.get(path, (0, 0))
        out[path] = (equal + (x.text == y.text), every + 1)
    return out


def content(tree: Node, template: frozenset[str]) -> str:
    """Runs of text in page order that are part of the article and in no template slot."""
    blocks: list[tuple[str, bool]] = []

    def walk(node: Node, path: str, main: bool) -> None:
        for child in node.children:
            if child.outside:
                continue
            where = f"{path}/{child.label}"
            if child.label == "#text":
                if where not in template:
                    blocks.append((child.text, main))
            else:
                walk(child, where, main or child.tag in MAIN)

    walk(tree, "", False)
    marked = any(main for _, main in blocks)
    return "\n".join(text for text, main in blocks if main or not marked)


def _flattened(tree: Node, most: int = 200) -> Node:
    """Children of nodes below a depth move up to it, so that no page nests deeper than the walks go."""
    todo = [(tree, 0)]
    while todo:
        node, depth = todo.pop()
        if depth == most:
            runs, stack = [], list(reversed(node.children))
            while stack:
                x = stack.pop()
                if x.label == "#text":
                    runs.append(x)
                elif not x.outside:
                    stack += reversed(x.children)
            node.children = runs
        else:
            todo += [(c, depth + 1) for c in node.children]
    return tree


def _aligned(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, Node] = {}
    shapes, size = Shapes(), 0
    for frame in frames:
        votes: dict[tuple[str, str], list[int]] = {}
        for host, page, reference in zip(frame["host"], frame["html"], frame["reference"]):
            if size > HELD_CHARS or shapes.held > HELD_SHAPES:
                held.clear()
                shapes, size = Shapes(), 0
            other = held.get(reference)
            if other is None:
                other = held[reference] = _flattened(parse(reference))
                shapes.number(other)
                size += len(reference)
            tree = _flattened(parse(page))
            shapes.number(tree)
            for path, (equal, every) in _votes(tree, other, shapes).items():
                v = votes.setdefault((host, path), [0, 0])
                v[0] += equal
                v[1] += every
        yield pd.DataFrame([(h, p, a, b) for (h, p), (a, b) in votes.items()], columns=["host", "path", "equal", "every"])


def templates(pages: DataFrame) -> DataFrame:
    """(host, template): paths of the constant slots of each host, from rows host, key, html.

    References are the pages with the smallest keys among different texts; a page is aligned with one of them, by its
    key, and never with an equal page. Hosts without a second text have no template."""
    firsts = pages.groupBy("host", F.md5("html").alias("same")).agg(F.min("key").alias("key"))
    lowest = firsts
    picks = []
    for n in range(REFERENCES):
        pick = lowest.groupBy("host").agg(F.min("key").alias("key"))
        picks.append(pick.withColumn("turn", F.lit(n)))
        if n + 1 < REFERENCES:
            lowest = lowest.join(pick.withColumnRenamed("key", "gone"), "host").where("key > gone").drop("gone")
    references = stage(reduce(DataFrame.unionByName, picks))
    turns = references.groupBy("host").agg(F.count("*").alias("turns")).where("turns > 1")
    html_of = pages.join(broadcast_if_small(references.join(turns, "host"), MAX_BROADCAST_ROWS), ["host", "key"]).groupBy(
        "host", "turn", "turns"
    ).agg(F.min("html").alias("reference"))
    html_of = stage(html_of)
    size = html_of.agg(F.coalesce(F.sum(F.octet_length("reference")), F.lit(0))).first()[0]
    if size <= MAX_BROADCAST_BYTES:
        rows = pages.join(F.broadcast(html_of), "host")
    else:
        dealt = html_of.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = pages.withColumn("salt", F.pmod(F.xxhash64("key", F.lit(1)), F.lit(SALTS)).cast("int")).join(dealt, ["host", "salt"])
    rows = rows.where(F.col("turn") == F.pmod(F.xxhash64("key"), F.col("turns"))).where(F.col("html") != F.col("reference"))
    votes = rows.select("host", "html", "reference").mapInPandas(_aligned, "host string, path string, equal bigint, every bigint")
    slots = votes.groupBy("host", "path").agg(F.sum("equal").alias("equal"), F.sum("every").alias("every"))
    return slots.where((F.col("every") >= VOTES) & (F.col("equal") >= CONSTANT * F.col("every"))).groupBy("host").agg(
        F.collect_list("path").alias("template")
    )


def _extracted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        text = [
            content(_flattened(parse(page or "")), frozenset(() if slots is None else slots))
            for page, slots in zip(frame["html"], frame["template"])
        ]
        yield frame[["page_id", "url"]].assign(text=text)


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages (page_id, url, html).

    Null or empty html: empty text. Null url or one without a host: no template, the declared parts alone decide. Pages
    of a host that are all alike have no template either. Repeated rows each get their row."""
    named = pages.select("page_id", "url", "html", host_and_path(F.col("url"))[0].alias("host"))
    keyed = named.where("host <> '' and html is not null").select(
        "host", F.md5(F.concat_ws("|", F.col("page_id").cast("string"), F.col("url"))).alias("key"), "html"
    )
    found = stage(templates(keyed))
    size = found.agg(F.coalesce(F.sum(F.octet_length(F.concat_ws("", "template"))), F.lit(0))).first()[0]
    if size <= MAX_BROADCAST_BYTES:
        joined = named.join(F.broadcast(found), "host", "left")
    else:
        salt = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        rows = named.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        joined = rows.join(found.withColumn("salt", salt), ["host", "salt"], "left")
    joined = joined.select("page_id", "url", "html", "template")
    out = joined.mapInPandas(_extracted, "page_id bigint, url string, text string")
    return out.withColumn("n_chars", F.length("text").cast("bigint"))
