"""HTML main-text extraction by minimum cut: block costs are terminal capacities, neighbours are joined by smoothness edges.

A block's cost is the log odds of two parts: where it stands (elements and names around it, fixed weights) and what its
text is like (length, links, sentence ends). The weights of the second part are fitted by logistic regression on blocks
of a bounded sample of pages whose elements leave no doubt.
"""

from __future__ import annotations

import math
import re
from collections import deque
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapal.llm.common import binary, slices, small_batches

#: Elements without text of their own.
SILENT = {"script", "style", "noscript", "template", "head", "svg", "math", "iframe", "object", "select", "textarea", "button", "option", "datalist", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Start tags that close an open element of the same group, up to the nearest of its bounds.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
CLOSES |= {x: ({"option"}, {"select"}) for x in ("option",)}
#: Elements that may stand in head; any other start tag ends it. Silent elements that hold no blocks: a block's start ends them.
IN_HEAD = {"base", "basefont", "bgsound", "link", "meta", "noscript", "script", "style", "template", "title", "head"}
NO_BLOCKS = {"button", "select", "option", "datalist"}

#: The fixed weights of where a block stands, as log odds of content. By element that the block is in, at any depth:
ELEMENT = {"article": 3.0, "main": 2.5, "nav": -6.0, "footer": -6.0, "header": -4.0, "aside": -6.0, "form": -6.0, "menu": -5.0, "dialog": -5.0, "address": -1.0, "fieldset": -4.0}
#: By element of the block itself:
OWN = {"p": 1.0, "h1": 1.0, "h2": 1.0, "h3": 1.0, "h4": 0.8, "blockquote": 0.8, "pre": 0.8, "li": -0.2, "td": 0.0, "dd": 0.2, "figcaption": 0.5}
#: By names in class, id or role of the block or an element around it, each told by itself; what only says how a page is
#: laid out (has-sidebar, comments-open, no-banner) is no name. A name with words of both kinds is a bad one, and names of
#: both kinds at one element leave it to the text.
BAD = re.compile(r"(?<![a-z])(?:ads?|adverts?|advertisement|sponsor(?:ed)?|promo(?:tion)?|banner|cookies?|consent|gdpr|notice|notification|alert|popup|modal|overlay|newsletter|subscribe|signup|login|menu|nav(?:bar|igation)?|breadcrumbs?|sidebar|side|aside|widget|footer|foot|header|masthead|topbar|toolbar|share|sharing|social|comments?|comment-?list|replies|reply|disqus|respond|related|recommended|more-?stories|pagination|pager|tags|search|copyright|legal|disclaimer|contentinfo|complementary|skip)(?![a-z])")
GOOD = re.compile(r"(?<![a-z])(?:article|post|entry|content|main|story|body|text)(?![a-z])")
LAYOUT = re.compile(r"(?<![a-z])(?:has|have|with|without|no|not|is|hide|show|js|allows?|supports?)-[a-z0-9-]*|[a-z0-9]+(?:-[a-z0-9]+)*-(?:open|opened|closed|enabled|disabled|visible|hidden|active|inactive|on|off|allowed|free|below|above|left-?out)(?![a-z-])")
#: Short texts that say whose a page is, wherever they stand, and their odds.
OWNERSHIP = re.compile(r"©|\(c\) ?[12]\d{3}|\bcopyright\b|all rights reserved|alle rechte vorbehalten|tous droits réservés|todos los derechos reservados", re.IGNORECASE)
OWNED_WORDS, OWNED = 20, -6.0
BAD_NAME, GOOD_NAME = -7.0, 1.5
#: An element of this weight or less is not helped by the elements around it: an advert in an article is an advert.
ALONE = -3.5
#: What a block's text is like: bias, log of its words, share of characters inside links, end of a sentence. These
#: weights hold where a sample has too few blocks of either kind; fitted ones stay near them (RIDGE), and their odds
#: within TEXT_ODDS, so that clear elements and names decide.
TEXT_WEIGHTS = (-1.0, 0.35, -3.5, 0.6)
RIDGE, TEXT_ODDS = 20.0, 3.0
#: The sample that the weights are fitted on: pages, those with the least hashes, and blocks of each at most.
SAMPLE_PAGES, SAMPLE_BLOCKS, LEAST_BLOCKS = 2000, 64, 200
#: Elements that leave no doubt about the blocks inside them.
CLEAR_CONTENT, CLEAR_OTHER = {"article", "main"}, {"nav", "footer", "aside", "form", "menu"}
#: Smoothness: between neighbours in page order, and by proximity in the tree, halved with every two steps between them.
ADJACENT, PROXIMITY = 0.4, 1.6


#: A document type with a subset in brackets, and the opening of a marked section.
SUBSET = re.compile(r"<!doctype[^>\[]*\[(?:[^\]\"']|\"[^\"]*\"|'[^']*')*\]\s*>", re.IGNORECASE)
EMPTY_COMMENT = re.compile(r"<!---?>")
MARKED = re.compile(r"<!\[[^\[\]<>]*\[")


class Node:
    """An element's place in the tree."""

    __slots__ = ("parent", "depth")

    def __init__(self, parent: Node | None):
        self.parent, self.depth = parent, parent.depth + 1 if parent else 0


def tree_distance(a: Node, b: Node) -> int:
    """The number of steps between two elements."""
    steps = 0
    while a is not b:
        if a.depth < b.depth:
            a, b = b, a
        a = a.parent
        steps += 1
    return steps


class Block:
    __slots__ = ("parts", "linked", "size", "score", "node", "label")

    def __init__(self, score: float, node: Node, label: int | None):
        self.parts, self.linked, self.size, self.score, self.node, self.label = [], 0, 0, score, node, label

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Page(HTMLParser):
    """The blocks of a page: runs of text that no block element interrupts, with the score of where they stand."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, Node, float]] = []  # element, its place, score of all elements from the top
        self.counts: dict[str, int] = {}
        self.root, self.silent, self.links = Node(None), 0, 0
        self.blocks: list[Block] = []
        self.open: Block | None = None

    def weight(self, tag: str, attrs) -> float:
        score = ELEMENT.get(tag, 0.0)
        if tag == "header" and self.counts.get("article"):
            score = 0.0  # an article's own header has its title
        names = " ".join(v for k, v in attrs if v and k in ("class", "id", "role", "aria-label")).lower().replace("_", "-").split()
        if names and tag not in ("body", "html"):
            told = [LAYOUT.sub("", x) for x in names]
            bad = any(BAD.search(x) for x in told)
            good = any(GOOD.search(x) and not BAD.search(x) for x in told)
            score += 0.0 if bad and good else BAD_NAME if bad else GOOD_NAME if good else 0.0
        if any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and "display:none" in v.replace(" ", "").lower() for k, v in attrs):
            score += BAD_NAME
        return score

    def parse_html_declaration(self, i):
        """A document type with an internal subset ends behind the subset."""
        if self.rawdata[i : i + 9].lower() == "<!doctype" and (found := SUBSET.match(self.rawdata, i)):
            return found.end()
        return super().parse_html_declaration(i)

    def parse_comment(self, i, report=1):
        """<!--> and <!---> are comments without text."""
        found = EMPTY_COMMENT.match(self.rawdata, i)
        return found.end() if found else super().parse_comment(i, report)

    def parse_marked_section(self, i, report=1):
        """A marked section of any name is a comment: up to ]]> if it opens a bracket, else or without one up to >, or all of the rest."""
        ends = [x for x in ("]]>", ">") if x == ">" or MARKED.match(self.rawdata, i)]
        found = next(((at, x) for x in ends if (at := self.rawdata.find(x, i + 3)) >= 0), None)
        return found[0] + len(found[1]) if found else len(self.rawdata)

    def _end_head(self) -> None:
        """Ends an open head, unless the tag stands in a template or the like inside it."""
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in ("template", "svg", "math"):
                return
            if self.stack[at][0] == "head":
                while len(self.stack) > at:
                    self._pop()
                return

    def handle_starttag(self, tag, attrs):
        if self.counts.get("head") and tag not in IN_HEAD:
            self._end_head()
        if self.silent and tag in BLOCK:
            held = -1
            while held != len(self.stack):
                held = len(self.stack)
                self._close(NO_BLOCKS, BLOCK | (SILENT - NO_BLOCKS))
        if tag in VOID:
            if self.open is not None and tag in ("br", "hr"):
                self.open.parts.append(" ")
            if tag == "hr":
                self.open = None
            return
        if tag in BLOCK:
            self.open = None
            if self.counts.get("p"):
                self._close({"p"}, {"table", "td", "th", "article", "section", "aside", "nav", "div", "body"})
            if tag in CLOSES:
                self._close(*CLOSES[tag])
        _, node, above = self.stack[-1] if self.stack else ("", self.root, 0.0)
        own = self.weight(tag, attrs)
        self.stack.append((tag, Node(node), (min(above, 0.0) if own <= ALONE else above) + own))
        self.counts[tag] = self.counts.get(tag, 0) + 1
        self.silent += tag in SILENT
        self.links += tag == "a"

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _pop(self) -> str:
        tag = self.stack.pop()[0]
        self.counts[tag] -= 1
        self.silent -= tag in SILENT
        self.links -= tag == "a"
        return tag

    def _close(self, tags: set, bounds: set) -> None:
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] in tags:
                while len(self.stack) > at:
                    self._pop()
                return
            if self.stack[at][0] in bounds:
                return

    def handle_endtag(self, tag):
        if tag in BLOCK:
            self.open = None
        if not self.counts.get(tag):
            return
        inline = tag not in BLOCK
        for at in range(len(self.stack) - 1, -1, -1):
            if self.stack[at][0] == tag:
                while len(self.stack) > at:
                    self._pop()
                return
            if inline and self.stack[at][0] in BLOCK:
                # An inline end tag does not close the blocks inside its element.
                for k in range(at, -1, -1):
                    if self.stack[k][0] == tag:
                        del self.stack[k]
                        self.counts[tag] -= 1
                        self.links -= tag == "a"
                        self.silent -= tag in SILENT
                        return
                return

    def handle_data(self, data):
        if self.silent and self.stack[-1][0] == "head" and data.strip():
            self._end_head()
        if self.silent or not data:
            return
        if self.open is None:
            if not data.strip():
                return
            tag, node, _ = next((x for x in reversed(self.stack) if x[0] in BLOCK), ("", self.root, 0.0))
            inside = lambda tags: any(self.counts.get(x) for x in tags)
            label = 0 if inside(CLEAR_OTHER) else 1 if inside(CLEAR_CONTENT) else None
            self.open = Block((self.stack[-1][2] if self.stack else 0.0) + OWN.get(tag, 0.0), node, label)
            self.blocks.append(self.open)
        self.open.parts.append(data)
        n = len(data.strip())
        self.open.size += n
        self.open.linked += n if self.links else 0


def likeness(block: Block, text: str) -> tuple[float, ...]:
    """What the text is like, in the order of TEXT_WEIGHTS."""
    return 1.0, math.log1p(text.count(" ") + 1), block.linked / max(1, block.size), float(text[-1:] in ".!?…\"”»。！？")


def odds(block: Block, text: str, weights: tuple[float, ...]) -> float:
    """The classifier's log odds that the block is content."""
    like = sum(w * x for w, x in zip(weights, likeness(block, text)))
    owned = OWNED if text.count(" ") < OWNED_WORDS and OWNERSHIP.search(text) else 0.0
    return block.score + max(-TEXT_ODDS, min(TEXT_ODDS, like)) + owned


def minimum_cut(source: list[float], sink: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut; of several such cuts the one with the fewest nodes there.

    Dinic's algorithm on the graph with terminal capacities source and sink and the given edges in both directions.
    """
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    left: list[float] = []

    def add(a: int, b: int, c: float, back: float) -> None:
        graph[a].append(len(to))
        to.append(b)
        left.append(c)
        graph[b].append(len(to))
        to.append(a)
        left.append(back)

    for i in range(n):
        # What both terminals could carry flows straight through.
        straight = min(source[i], sink[i])
        if source[i] > straight:
            add(s, i, source[i] - straight, 0.0)
        if sink[i] > straight:
            add(i, t, sink[i] - straight, 0.0)
    for a, b, c in edges:
        add(a, b, c, c)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            v = queue.popleft()
            for e in graph[v]:
                if left[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = s
        while True:
            if v == t:
                flow = min(left[e] for e in path)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                back = next(k for k, e in enumerate(path) if left[e] <= tiny)
                v = to[path[back] ^ 1]
                del path[back:]
                continue
            while at[v] < len(graph[v]) and not (left[graph[v][at[v]]] > tiny and level[to[graph[v][at[v]]]] == level[v] + 1):
                at[v] += 1
            if at[v] < len(graph[v]):
                e = graph[v][at[v]]
                path.append(e)
                v = to[e]
            elif v == s:
                break
            else:
                e = path.pop()
                v = to[e ^ 1]
                at[v] += 1


def parsed(html: str) -> list[tuple[Block, str]]:
    """The blocks of a page that have text, with it."""
    page = Page()
    page.feed(html)
    page.close()
    return [(b, text) for b in page.blocks if (text := b.text())]


def main_text(html: str, weights: tuple[float, ...] = TEXT_WEIGHTS) -> str:
    """The main text of a page: its content blocks in page order, one line each."""
    blocks = parsed(html)
    costs = [odds(b, text, weights) for b, text in blocks]
    edges: list[tuple[int, int, float]] = []
    last: dict[Node | None, int] = {}
    for i, (b, _) in enumerate(blocks):
        near = i - 1 if i else None
        sibling = last.get(b.node.parent)
        if near is not None:
            edges.append((near, i, ADJACENT + PROXIMITY * 0.5 ** (tree_distance(blocks[near][0].node, b.node) / 2)))
        if sibling is not None and sibling != near:
            edges.append((sibling, i, PROXIMITY / 2))
        last[b.node.parent] = i
    content = minimum_cut([max(c, 0.0) for c in costs], [max(-c, 0.0) for c in costs], edges)
    return "\n".join(text for (_, text), good in zip(blocks, content) if good)


def fitted(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = TEXT_WEIGHTS) -> tuple[float, ...]:
    """Weights of a logistic regression by Newton's method, both kinds counting alike, drawn to the prior by RIDGE; the prior itself if either kind has under LEAST_BLOCKS blocks."""
    counts = np.bincount(y, minlength=2)
    if counts.min() < LEAST_BLOCKS:
        return tuple(prior)
    own, start = np.array(prior), np.array(prior)
    each = (LEAST_BLOCKS / counts)[y]
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ own, -30, 30)))
        slope = x.T @ (each * (y - p)) - RIDGE * (own - start)
        step = np.linalg.solve((x * (each * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(own)), slope)
        own = own + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(w) for w in own)


def fit(pages: DataFrame) -> tuple[float, ...]:
    """The text weights, fitted on SAMPLE_BLOCKS blocks each of the SAMPLE_PAGES pages with the least hashes of url and page_id.

    Only features of that sample come to the driver.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for html in binary(batch.column(0)).to_pylist():
                own = [(*likeness(b, text), b.label) for b, text in parsed(html.decode(errors="replace")) if b.label is not None]
                rows += own[:: -(-len(own) // SAMPLE_BLOCKS) or 1]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in columns[:4]] + [pa.array(columns[4], pa.int64())], names=["a", "b", "c", "d", "label"])

    own = pages.select(F.xxhash64("url", "page_id").alias("h"), F.col("html").cast("string").alias("html"))
    least = own.select("h").orderBy("h").limit(SAMPLE_PAGES).agg(F.max("h")).head()[0]
    if least is None:
        return TEXT_WEIGHTS
    sample = own.where(F.col("h") <= least).limit(2 * SAMPLE_PAGES).select("html")
    rows = sample.mapInArrow(each, "a double, b double, c double, d double, label long").orderBy("a", "b", "c", "d", "label").toPandas()
    return fitted(rows[["a", "b", "c", "d"]].to_numpy(), rows["label"].to_numpy(dtype=np.int64))


def extract(pages: DataFrame, weights: tuple[float, ...] | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages; weights are fitted on them if none are given.

    A null or empty html gives an empty text. Pages are independent but for the weights, so repeated rows give equal
    rows; other columns are not looked at. Broken markup is read as far as it goes.
    """
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    weights = fit(own) if weights is None else weights

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "html"):
                texts = [main_text(x.decode(errors="replace"), weights) for x in binary(part.column(2)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return own.mapInArrow(each, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))


def op7_html(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
