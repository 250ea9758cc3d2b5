"""Main text of web pages by wrapper induction.

Pages of one host share a wrapper. Pages become outlines (tags and hashes of
blocks), which Spark brings together by host, hosts with many pages in groups of
about ``GROUP``. In the order of a hash, each distinct outline is aligned with
the ``TREES`` before it by simple tree matching; aligned blocks with equal text
vote for template, others for slot. The votes of all pages are summed by Spark;
blocks that are constant on a host become its template, wherever pages lie. What
is extracted is the article (or, without one, the body) less what markup
declares to be something else, and less the template.
"""

from __future__ import annotations

import html
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from bindery.llm.common import broadcast_if_small, once, written

CONSTANT = 0.9  # share of a host's aligned pairs with equal text that makes a block template
PAIRS = 5  # aligned pairs needed before a block can be template
CELLS = 250_000  # pairs of children beyond which lists are matched in order instead of by table
DEPTH = 150  # levels that are aligned; deeper blocks stay unaligned and so count as slots
GROUP = 512  # distinct outlines of a host beyond which they are dealt to several groups
TREES = 3  # outlines of its host that each is aligned with
UNIT = 1 << 40  # a pair of blocks counts more than any number of equal texts
OUTLINE = np.dtype([("depth", "<i4"), ("tag", "<u4"), ("key", "<i8"), ("text", "<i8")])
TEMPLATES = 2_000_000  # template blocks up to which the tables travel with the tasks

#: Element names of the language.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form "
             "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
OTHER = set("nav footer aside form script style noscript template iframe svg canvas button select option textarea title head menu dialog "
            "object embed audio video label input".split())
#: Words in class, id or role that declare a part to be no article text.
NOISE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner\w*|nav\w*|menu\w*|breadcrumbs?|sidebar\w*|side-bar|footer\w*|header\w*|masthead|"
                   r"cookies?\w*|notices?|consent|popup\w*|modal|newsletter|subscribe\w*|comments?\w*|respond|disqus\w*|related\w*|share\w*|social\w*|"
                   r"widget\w*|toolbar|pagination|pager|login|search\w*|complementary|contentinfo|navigation|alert)(?=$|[\s_-])", re.I)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
CLOSES_P = BLOCKS - {"option", "td", "th", "tr", "li", "dd", "dt", "body", "html", "caption"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "select", "body", "html", "article", "main", "section", "div"}


class Node:
    """A block element: tag, what it declares, whether it is inside an article or a declared other part; items are texts and blocks."""
    __slots__ = ("tag", "path", "article", "noise", "items")

    def __init__(self, tag: str, path: str, article: bool, noise: bool):
        self.tag, self.path, self.article, self.noise = tag, path, article, noise
        self.items: list = []

    def children(self) -> list[Node]:
        return [x for x in self.items if isinstance(x, Node)]

    def text(self) -> str:
        return " ".join("".join(x if isinstance(x, str) else " " for x in self.items).split())

    def same(self, other: Node) -> bool:
        return self.text() == other.text()


def parse(page: str | None) -> Node:
    """The page as a tree of blocks; inline markup vanishes, ``br`` is white space, references are decoded."""
    page = page or ""
    root = Node("#", "", False, False)
    stack: list[tuple[str, Node]] = [("#", root)]
    at, end = 0, len(page)
    while at < end:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes = m.group(1, 2, 3)
        node = stack[-1][1]
        if name is None:
            raw = m.group()
            if not raw.startswith(("<!", "<?")):
                node.items.append(html.unescape(raw))
            continue
        name = name.lower()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and name not in BLOCKS:
                    break
            if name in BLOCKS:
                stack[-1][1].items.append(" ")
            continue
        if name in CLOSES_P:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS:
                    break
        elif name in SIBLINGS:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in SIBLINGS[name]:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
        node = stack[-1][1]
        if name in RAW:
            close = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        declared = " ".join(x for g in ATTRIBUTE.findall(attributes or "") for x in g if x) if "=" in (attributes or "") else ""
        article = node.article or name in ("article", "main")
        noise = node.noise or name in OTHER or (name == "header" and not node.article) or bool(declared and NOISE.search(declared) and name not in ("body", "html"))
        if name in BLOCKS or (noise and not node.noise):
            child = Node(name, f"{node.path}/{name}.{declared}", article, noise)
            node.items.append(child)
            if name not in VOID:
                stack.append((name, child))
        elif name in VOID:
            if name == "br":
                node.items.append(" ")
        else:
            stack.append((name, node))
    return root


class Block:
    """A block of an outline: hashes of its tag, of host, place and text, and of its text (0: no text, or declared to be another part)."""
    __slots__ = ("tag", "key", "text", "below")

    def __init__(self, tag: int, key: int, text: int):
        self.tag, self.key, self.text = tag, key, text
        self.below: list[Block] = []

    def children(self) -> list[Block]:
        return self.below

    def same(self, other: Block) -> bool:
        return self.text == other.text


def outline(tree: Node, host: str) -> bytes:
    """All blocks in page order with their depth, without those inside a declared other part."""
    rows, open_ = [], [(tree, 0)]
    while open_:
        x, depth = open_.pop()
        text = "" if x.noise else x.text()
        rows.append((depth, zlib.crc32(x.tag.encode("utf-8", "surrogatepass")), key_of(host, x, text) if text else 0,
                     (xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63) or 1 if text else 0))
        if not x.noise:
            open_ += [(c, depth + 1) for c in reversed(x.children())]
    return np.array(rows, OUTLINE).tobytes()


def blocks_of(outlined: bytes) -> Block:
    """The tree of an outline."""
    stack: list[Block] = []
    for depth, tag, key, text in np.frombuffer(outlined, OUTLINE).tolist():
        block = Block(tag, key, text)
        del stack[depth:]
        if stack:
            stack[-1].below.append(block)
        stack.append(block)
    return stack[0]


def align(a: Node | Block, b: Node | Block) -> list[tuple]:
    """Pairs of the largest top-down matching of two trees that keeps order and tags; of such, one with most equal texts."""
    scores: dict[tuple[int, int], int] = {}

    def tables(x: list[Node], y: list[Node], depth: int) -> list[list[int]]:
        w = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x, 1):
            above, row = w[i - 1], w[i]
            for j, q in enumerate(y, 1):
                best = max(above[j], row[j - 1])
                if p.tag == q.tag:
                    best = max(best, above[j - 1] + score(p, q, depth))
                row[j] = best
        return w

    def score(p: Node, q: Node, depth: int) -> int:
        key = (id(p), id(q))
        if key not in scores:
            x, y = p.children(), q.children()
            if depth > DEPTH or not x or not y:
                scores[key] = UNIT + p.same(q)
            elif len(x) * len(y) > CELLS:
                scores[key] = UNIT * (1 + min(len(x), len(y))) + p.same(q)
            else:
                scores[key] = UNIT + p.same(q) + tables(x, y, depth + 1)[-1][-1]
        return scores[key]

    pairs, open_ = [], [(a, b, 0)]
    while open_:
        p, q, depth = open_.pop()
        pairs.append((p, q))
        x, y = p.children(), q.children()
        if depth > DEPTH or not x or not y:
            continue
        if len(x) * len(y) > CELLS:
            open_ += [(s, t, depth + 1) for s, t in zip(x, y) if s.tag == t.tag]
            continue
        w, i, j = tables(x, y, depth + 1), len(x), len(y)
        while i and j:
            if w[i][j] == w[i - 1][j]:
                i -= 1
            elif w[i][j] == w[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                open_.append((x[i], y[j], depth + 1))
    return pairs


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").netloc or "").lower()
    except ValueError:
        return ""


def key_of(host: str, node: Node, text: str) -> int:
    return xxhash.xxh3_64_intdigest(f"{host}\0{node.path}\0{text}".encode("utf-8", "surrogatepass")) - 2**63


def _outlines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        hosts = [host_of(u) for u in batch["_url"]]
        found = [outline(parse(p), h) for h, p in zip(hosts, batch["_html"])]
        # an address may hold half of a surrogate pair
        names = [h.encode("utf-8", "surrogatepass") for h in hosts]
        yield pd.DataFrame({"host": names, "digest": [xxhash.xxh3_128_digest(x) for x in found], "outline": found})


def _votes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, equal, pairs): votes on the blocks of outlines that come sorted by host and group."""
    group, last = None, deque(maxlen=TREES)
    votes: dict[int, list[int]] = {}

    def flush() -> pd.DataFrame:
        out = pd.DataFrame([(k, *v) for k, v in votes.items()], columns=["key", "equal", "pairs"])
        votes.clear()
        return out

    for batch in batches:
        for host, salt, outlined in zip(batch["host"], batch["salt"], batch["outline"]):
            if group != (host, salt):
                group = (host, salt)
                last.clear()
            tree = blocks_of(outlined)
            for known in last:
                for p, q in align(known, tree):
                    if p.text:
                        v = votes.setdefault(p.key, [0, 0])
                        v[0] += p.text == q.text
                        v[1] += 1
            last.append(tree)
            if len(votes) > 100_000:
                yield flush()
    yield flush()


def induce(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Template blocks of all hosts, written: (key). A key stands for host, place and text."""
    rows = pages.select(F.col(url_col).cast("string").alias("_url"), F.col(html_col).cast("string").alias("_html"))
    outlines = rows.mapInPandas(_outlines, "host binary, digest binary, outline binary")
    # copies of a page say nothing about its host
    outlines = written(outlines.groupBy("host", "digest").agg(F.min("outline").alias("outline")), "outlines")
    large = outlines.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups")).filter("groups > 1")
    dealt = outlines.join(broadcast_if_small(written(large, "large-hosts")), "host", "left") \
        .withColumn("salt", F.pmod(F.xxhash64("digest"), F.coalesce("groups", F.lit(1))).cast("int")).drop("groups")
    dealt = dealt.repartition("host", "salt").sortWithinPartitions("host", "salt", "digest")
    votes = dealt.select("host", "salt", "outline").mapInPandas(_votes, "key long, equal long, pairs long")
    votes = votes.groupBy("key").agg(F.sum("equal").alias("equal"), F.sum("pairs").alias("pairs"))
    return written(votes.filter((F.col("pairs") >= PAIRS) & (F.col("equal") >= CONSTANT * F.col("pairs"))).select("key"), "templates")


def main_text(tree: Node, template: set[int], host: str) -> str:
    """Blocks in page order, one space between them."""
    found: list[str] = []
    whole = not any(n.article and not n.noise for n in _walk(tree))
    open_: list = [tree]
    while open_:
        x = open_.pop()
        if isinstance(x, str):
            found.append(x)
            continue
        if x.noise:
            found.append(" ")
            continue
        items = x.items
        if not whole and not x.article:
            items = x.children()
        elif template and (text := x.text()) and key_of(host, x, text) in template:
            items = x.children()
        open_.append(" ")
        open_ += reversed(items)
        open_.append(" ")
    return " ".join("".join(found).split())


def _walk(tree: Node) -> Iterator[Node]:
    open_ = [tree]
    while open_:
        x = open_.pop()
        yield x
        open_ += x.children()


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, url, text, n_chars (code points of text).

    A null or empty page has the text "" and 0; a null or broken url is a host
    of its own; a null id stays null; repeated rows get equal results. An empty
    table gives no rows. Whole pages are read; other columns are not.
    """
    template = induce(pages, url_col, html_col)
    session, name = pages.sparkSession, uuid.uuid4().hex
    rows = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).cast("string").alias("_html"))
    if template.count() <= TEMPLATES:
        shared = session.sparkContext.broadcast({r.key for r in template.collect()})

        @F.pandas_udf("string")
        def text_of(url: pd.Series, page: pd.Series) -> pd.Series:
            known = once(name, lambda: shared.value)
            return pd.Series([main_text(parse(p), known, host_of(u)) for u, p in zip(url, page)], dtype=object)

        rows = rows.withColumn("text", text_of(F.col("_url").cast("string"), "_html"))
    else:  # too many to send: each page's keys meet the table
        @F.pandas_udf("array<long>")
        def keys_of(url: pd.Series, page: pd.Series) -> pd.Series:
            return pd.Series([[key_of(host_of(u), n, t) for n in _walk(parse(p)) if not n.noise and (t := n.text())] for u, p in zip(url, page)])

        @F.pandas_udf("string")
        def text_with(url: pd.Series, page: pd.Series, keys: pd.Series) -> pd.Series:
            return pd.Series([main_text(parse(p), set() if k is None else set(k), host_of(u)) for u, p, k in zip(url, page, keys)], dtype=object)

        rows = rows.withColumn("_row", F.concat_ws(":", F.spark_partition_id(), F.monotonically_increasing_id()))
        rows = written(rows, "pages")
        own = rows.select("_row", F.explode(keys_of(F.col("_url").cast("string"), "_html")).alias("key")).join(template, "key") \
            .groupBy("_row").agg(F.collect_set("key").alias("_keys"))  # blocks of one page
        rows = rows.join(own, "_row", "left").withColumn("text", text_with(F.col("_url").cast("string"), "_html", "_keys"))
    return rows.select(F.col("_id").alias(id_col), F.col("_url").alias(url_col), "text", F.length("text").cast("long").alias("n_chars"))
