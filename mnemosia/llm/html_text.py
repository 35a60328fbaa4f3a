"""HTML extraction by composite text density.

Every page becomes a small tree, without the parts whose tags or names say that they
are menus, adverts and the like. For each node, the characters and tags of its
subtree, and those within links, give a density: characters per tag, lowered by
the share of link text. The node whose children's densities sum to the most
holds the main text. The least density on its path to the body is the threshold:
beside the path, boxes that stay below it are cut, and those that reach it are
parts of a text that is dealt over several boxes. What stands in the chosen node
itself stays whole.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, table

# a quote opens a value only after '=': elsewhere it is a character like others, and an unquoted value ends at white space or '>'
_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?--!?>|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|</(?![a-zA-Z]|\Z)[^>]*(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|(?!["'])[^\s>]*+)|(?!\s*+=)))*+[\s/]*+)>|([^<]+|<)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|((?!["'])[^\s>]+)))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul""".split()
)
#: Elements that are no text to read.
DROPPED = frozenset("script style head title noscript template iframe object embed svg canvas audio video map button select option textarea input label search noframes noembed".split())
#: Elements that are furniture, unless they hold the main text.
SOFT = frozenset("nav footer aside form dialog menu".split())
#: Words of a class, id or role that name such a part.
NOISE = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promotion promoted banner
    nav navbar navigation menu menus breadcrumb breadcrumbs crumbs header masthead topbar footer contentinfo sidebar aside complementary rail widget widgets
    notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login toolbar
    comment comments commentlist disqus respond reply replies discussion feedback share sharing social related recommended recommendations pagination pager search form""".split()
)
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
KEPT = frozenset("html body article main".split())
#: Blocks that hold one piece of text; beside the path they are cut only if they are mostly links.
PIECES = frozenset("address blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 hgroup p pre".split())
#: What is outside of named boxes is the page's text if it has this share of the largest sum; boxes beside the text belong to it from this share of its sum.
OUTSIDE, SHARE = 0.2, 0.5
#: An opening tag closes an open element of these kinds, looking no further up than their containers.
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
_CLOSES |= {x: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for x in ("thead", "tbody", "tfoot")}
_WALLS = frozenset("table td th body html article section div main".split())


class Node:
    __slots__ = ("tag", "parent", "items", "dropped", "soft", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, dropped: bool = False, soft: bool = False):
        self.tag, self.parent, self.dropped, self.soft = tag, parent, dropped, soft
        self.items: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _named(tag: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """(whether the element is not shown, whether its names say that it is furniture). `inside`: it stands in an article."""
    if tag in DROPPED:
        return True, False
    soft = tag in SOFT or tag == "header" and not inside
    if attributes:
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), a or b or c
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return tag not in KEPT, False
            if name in ("class", "id", "role"):
                words = {w.lower() for w in _NAME.findall(value)}
                if inside and tag in HEADINGS | {"header", "hgroup"}:
                    words.discard("header")
                soft = soft or bool(words & NOISE)
    return False, soft and tag not in KEPT


def parse(page: str) -> Node:
    """The page's tree. Unclosed and misplaced tags are mended as browsers do, roughly."""
    root = node = Node("html", None)
    depth = 0  # of articles and mains
    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.match(page, at)
        if m is None:  # a '<' whose tag is not closed: the rest is markup
            break
        at = m.end()
        if m[4] is not None:
            if m[4] == "<" and re.match(r"[a-zA-Z/]", page[at : at + 1] or " "):
                break
            if not node.dropped:
                node.items.append(m[4])
            continue
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not node.dropped:
                node.items.append(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = m[2].lower()
        if m[1]:
            up = node
            while up.parent is not None and up.tag != tag and not (tag not in BLOCK and up.tag in BLOCK):
                up = up.parent
            if up.parent is not None and up.tag == tag and tag != "body":
                while node is not up.parent:
                    depth -= node.tag in ("article", "main")
                    node = node.parent
            elif tag == "br" and not node.dropped:
                node.items.append(Node("br", node))
            continue
        if tag in ("html", "body"):
            if tag == "body" and not any(isinstance(x, Node) and x.tag == "body" for x in root.items):
                node, depth = Node("body", root), 0
                root.items.append(node)
            continue
        if tag in BLOCK or tag in _CLOSES:
            kinds, walls = _CLOSES.get(tag, ({"p"} if tag in BLOCK else set(), _WALLS))
            up = node
            while up.parent is not None and up.tag not in kinds and up.tag not in walls:
                up = up.parent
            if up.parent is not None and up.tag in kinds:
                while up.parent.parent is not None and up.parent.tag in kinds:
                    up = up.parent
                while node is not up.parent:
                    depth -= node.tag in ("article", "main")
                    node = node.parent
        if node is root and tag not in ("head", "frameset"):
            body = next((x for x in root.items if isinstance(x, Node) and x.tag == "body"), None)
            if body is None:
                body = Node("body", root)
                root.items.append(body)
            node = body
        hidden, soft = _named(tag, m[3], depth > 0)
        new = Node(tag, node, node.dropped or hidden, soft)
        node.items.append(new)
        if tag in RAW:
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            if not new.dropped:
                new.items.append(page[at : close.start()])
            at = close.end()
        elif tag not in VOID and not m[3].rstrip().endswith("/") or tag in BLOCK and tag not in VOID:
            node = new
            depth += tag in ("article", "main")
    return root


def _length(text: str) -> int:
    return len("".join(text.split()))


def measure(root: Node, soft: bool = True) -> list[Node]:
    """Fills in counts, densities and sums, and returns the nodes in page order, without dropped ones; without soft ones if `soft` is false."""
    order: list[Node] = []
    stack = [root]
    while stack:
        node = stack.pop()
        order.append(node)
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        node.density = node.total = 0.0
        stack += [x for x in reversed(node.items) if isinstance(x, Node) and not x.dropped and (soft or not x.soft)]
    for node in reversed(order):
        for x in node.items:
            if isinstance(x, str):
                node.chars += _length(x)
            elif not x.dropped and (soft or not x.soft):
                node.chars += x.chars
                node.tags += x.tags + 1
                node.link_chars += x.link_chars
                node.link_tags += x.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body = next((n for n in order if n.tag == "body"), root)
    share = body.link_chars / body.chars if body.chars else 0.0
    for node in order:
        if node.chars:
            plain = max(1, node.chars - node.link_chars)
            base = math.log(node.chars / plain * max(1, node.link_chars) + share * node.chars + math.e)
            ratio = node.chars / max(1, node.link_chars) * max(1, node.tags) / max(1, node.link_tags)
            node.density = node.chars / max(1, node.tags) * max(0.0, math.log(max(ratio, 1.0), base))
    for node in order:
        node.total = sum(x.density for x in node.items if isinstance(x, Node) and not x.dropped and (soft or not x.soft))
    return order


def _best(root: Node, soft: bool) -> tuple[Node, Node]:
    """(the body, the node with the largest sum)."""
    order = measure(root, soft)
    body = next((n for n in order if n.tag == "body"), root)
    return body, max((n for n in order if n.chars and n is not root), key=lambda n: n.total, default=body)


def release(root: Node) -> None:
    """Clears `soft` of the boxes that hold the main text, whatever they are called.

    If the largest sum of the whole page lies in soft boxes, and outside of soft boxes there is no article with text and
    less than OUTSIDE of that sum, the outermost of these boxes are wrappers: as few of them as it takes, found by halving."""
    body, best = _best(root, True)
    whole, around = best.total, []
    # a box within that alone makes up most of the sum holds the text as well
    node = best
    while (inner := max((x for x in node.items if isinstance(x, Node) and not x.dropped), key=lambda x: x.density, default=None)) is not None and 2 * inner.density > node.total > 0:
        node = inner
    while node is not None:
        if node.soft:
            around.append(node)
        node = node.parent
    around.reverse()

    def told(k: int) -> bool:
        for i, x in enumerate(around):
            x.soft = i >= k
        order = measure(root, False)
        return any(n.chars and n.tag in ("article", "main") for n in order) or max((n.total for n in order if n is not root), default=0.0) >= OUTSIDE * whole

    low, high = (0, 0) if told(0) else (min(1, len(around)), len(around))
    while low < high:
        middle = (low + high) // 2
        if told(middle):
            high = middle
        else:
            low = middle + 1
    if around:
        for i, x in enumerate(around):
            x.soft = i >= low


def choose(root: Node) -> tuple[Node, Node]:
    """(the body, the chosen node), after all that is not the chosen node's text, or widens it, is marked as dropped.

    The chosen node has the largest sum once soft boxes beside it are left out. Of what stands beside its path to the
    body, boxes widen it that reach the path's least density and, outside of an article, SHARE of its sum; pieces
    of text do unless they are mostly links, or stand alone below the body."""
    release(root)
    body, best = _best(root, False)
    path = [best]
    while path[-1].parent is not None and path[-1] is not body:
        path.append(path[-1].parent)
    threshold, own = min(n.density for n in path), set(map(id, path))
    inside = next((i for i, n in reversed(list(enumerate(path))) if n.tag in ("article", "main")), -1)
    # the body is not a box of its own: if it is chosen, its boxes are judged too
    for i, node in list(enumerate(path))[1:] if len(path) > 1 else enumerate(path):
        for x in node.items:
            if isinstance(x, Node) and not x.dropped and not x.soft and id(x) not in own:
                links = 2 * x.link_chars > x.chars
                if x.tag in BLOCK and x.tag not in PIECES:
                    x.dropped = x.density < threshold or i > inside and len(path) > 1 and x.total < SHARE * best.total
                elif x.density < threshold:
                    x.dropped = links
    return body, best


def block_texts(node: Node) -> list[str]:
    """The blocks under a node in page order: references decoded, white space collapsed, trimmed, not empty."""
    blocks: list[str] = []
    run: list[str] = []

    def flush():
        text = " ".join("".join(run).split())
        if text:
            blocks.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            run.append(html.unescape(x))
        elif x.dropped or x.soft:
            if x.tag in BLOCK:
                flush()
        elif x.tag == "br":
            run.append(" ")
        else:
            block = x.tag in BLOCK
            if block:
                flush()
                stack.append(None)
            stack += reversed(x.items)
    flush()
    return blocks


def extract(page: str | None) -> str:
    """The page's main text, its blocks joined by two line breaks; '' for null and for pages without text."""
    if not page:
        return ""
    root = parse(page)
    return "\n\n".join(block_texts(choose(root)[0]))


def _extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            texts = [extract(p) for p in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of pages (page_id, url, html; other columns are ignored).

    Rows are independent, so nothing is shuffled; repeated rows stay repeated."""
    return arrow_map(pages.select(F.col("page_id").cast("long"), "url", "html"), _extract_batches, "page_id long, url string, text string, n_chars long")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))
