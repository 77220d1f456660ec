"""Main text of web pages by composite text density.

Every node of a page's tree has a density: its characters per tag, weighed down by the share of link characters and link
tags in it. A node's sum is the densities of its children; the node with the largest sum holds the main text. The least
density on the path from it to the body is the page's threshold, and other subtrees that reach it are kept as well.
Parts that name themselves as something else (menus, forms, adverts, comments, hidden parts, ...) are left out before. A
class or id does so as a whole token or by its head or leading word (``main-navigation``, ``sidebar-left``). Comments go
by their name, however long, unless they hold the main element, the first heading or the whole text; then a form or
another named part goes unless it holds the page's main or article element or, where none of these carries text, most of
the unlinked text. So a form or an oddly named box around the whole page stays.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template xmp noframes".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span"
    " strike strong sub sup time tt u var wbr".split()
)
_NOISE = frozenset(
    "head script style textarea title noscript iframe template xmp noframes nav footer aside button select option"
    " input svg canvas object audio video map menu dialog".split()
)
_NOISE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())
_NOISE_NAMES = re.compile(
    r"(?:ads?|adverts?|advertisement|advertising|sponsor(?:ed)?|promo(?:tion)?s?|banner|side-?bar|widget|"
    r"nav(?:bar|igation)?|menu|bread-?crumbs?|foot(?:er)?|mast-?head|site-?header|page-?header|top-?bar|header|cookies?|"
    r"consent|gdpr|notices?|alert|pop-?up|modal|overlay|newsletter|subscri(?:be|ption)|sign-?up|log-?in|share|sharing|"
    r"social|related|recommend(?:ed|ations)?|comments?|discussion|disqus|respond|replies|reply|pagination|pager|skip|"
    r"hidden|visually-hidden|sr-only|legal|copyright|disclaimer|toolbar|tags?)"
    r"(?:[\s_-](?:box|block|bar|area|list|section|container|wrapper|widget|notice|banner|form|links?|buttons?|unit|slot))?",
    re.I,
)
_LAST_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs footer sidebar widget widgets comment comments replies overlay popup modal"
    " cookie cookies consent newsletter share sharing social related recommended recommendations pagination ad ads advert adverts"
    " advertisement sponsored disclaimer copyright".split()
)
_FIRST_WORDS = frozenset("nav navbar navigation breadcrumb breadcrumbs footer sidebar cookie newsletter comment comments".split())
_COMMENT_WORDS = frozenset("comment comments disqus respond reply replies".split())
#: Words that make a name a state of its part and not what it is.
_STATE_WORDS = frozenset("has no not with without is hide show open opened close closed enabled disabled on off allowed overflow".split())
_WORD_ENDS = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")
_COMMENT, _OTHER = "comment", "other"
#: The share of the unlinked text from which a main or article element without a heading is taken for the article.
_ANCHOR_SHARE = 0.1
#: A start tag on the left ends an open element on the right.
_CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
    "option": ("option",), "tbody": ("thead", "tbody"), "tfoot": ("tbody",),
}
_SCOPES = frozenset("ul ol dl table body article section div main td th blockquote".split())
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5"
    " h6 header hr main menu nav ol p pre section table ul".split()
)


class Node:
    __slots__ = ("tag", "parent", "parts", "noise", "named", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: bool = False):
        self.tag, self.parent, self.noise, self.parts = tag, parent, noise, []
        self.named = ""
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(text: str) -> list[tuple[str, str]]:
    return [(name.lower(), a or b or c) for name, a, b, c in _ATTRIBUTE.findall(text)]


def _noisy(tag: str, attributes: list[tuple[str, str]], inside_article: bool) -> bool:
    if tag in _NOISE or tag == "header" and not inside_article:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attributes:
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value in _NOISE_ROLES:
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _named(tag: str, attributes: list[tuple[str, str]]) -> str:
    """What a class, id, role or the tag form names a part as: comments, other noise, or nothing ('')."""
    kinds = {_OTHER} if tag == "form" else set()
    for name, value in attributes:
        if name == "role" and value == "form":
            kinds.add(_OTHER)
        for token in value.split() if name in ("class", "id") else ():
            parts = [w.lower() for w in _WORD_ENDS.split(token) if w]
            compound = len(parts) > 1 and not _STATE_WORDS & {parts[0], parts[-1]}
            if _NOISE_NAMES.fullmatch(token) or compound and (parts[0] in _FIRST_WORDS or parts[-1] in _LAST_WORDS):
                comments = parts and (parts[0] in _COMMENT_WORDS or parts[-1] in _COMMENT_WORDS)
                kinds.add(_COMMENT if comments else _OTHER)
    return _COMMENT if _COMMENT in kinds else _OTHER if _OTHER in kinds and tag not in ("article", "main") else ""


def _unlinked(nodes: list[Node]) -> dict[int, int]:
    """Characters of each node outside links and noise."""
    plain: dict[int, int] = {}
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        own += sum(plain[id(p)] for p in node.parts if isinstance(p, Node) and not p.noise)
        plain[id(node)] = 0 if node.tag == "a" else own
    return plain


def _above(nodes: list[Node]) -> set[int]:
    """Ids of the nodes and of everything that they stand in."""
    out: set[int] = set()
    for node in nodes:
        up = node
        while up is not None and id(up) not in out:
            out.add(id(up))
            up = up.parent
    return out


def _judge(root: Node) -> None:
    """Makes noise of the named parts: comments by their name, others where the article is seen to stand elsewhere."""
    nodes = _order(root)
    if not any(node.named for node in nodes):
        return
    if any(node.named == _COMMENT for node in nodes):
        plain = _unlinked(nodes)
        heading = next((n for n in nodes if n.tag == "h1"), None)
        stay = _above([n for n in nodes if n.tag == "main" or n is heading])
        for node in nodes:
            node.noise = node.named == _COMMENT and id(node) not in stay and plain[id(node)] < plain[id(root)]
        nodes = _order(root)
    plain = _unlinked(nodes)
    anchors = [n for n in nodes if n.tag == "main"] or [n for n in nodes if n.tag == "article"]
    boxed = set()  # stands in a named part that is no form; parents come first
    for node in nodes:
        if node.named and node.tag != "form" or id(node.parent) in boxed:
            boxed.add(id(node))
    anchors = [n for n in anchors if id(n) not in boxed] or anchors
    holds = _above(anchors)
    titled = _above([n for n in nodes if n.tag == "h1"])
    seen = any(id(n) in titled or plain[id(n)] > _ANCHOR_SHARE * plain[id(root)] for n in anchors)
    for node in nodes:
        if node.named and id(node) not in holds:
            node.noise = seen or 2 * plain[id(node)] <= plain[id(root)]


def tree(html: str) -> Node:
    """A page's tree; wrong, missing and cut-off markup is read leniently, each token once."""
    root = node = Node("body", None)
    at, articles, size = 0, 0, len(html)
    while at < size:
        found = _TOKEN.search(html, at)
        text = html[at : found.start() if found else size]
        if text:
            node.parts.append(unescape(text))
        if not found:
            break
        at = found.end()
        tag = found[2]
        if not tag:
            continue
        tag = tag.lower()
        if found[1]:
            up = node
            while up is not root and up.tag != tag and not (tag in _INLINE and up.tag in _SCOPES):
                up = up.parent
            if up is not root and up.tag == tag:
                while node is not up.parent:
                    articles -= node.tag in ("article", "main")
                    node = node.parent
            continue
        if tag in ("html", "body"):
            continue
        ends = ("p",) if tag in _ENDS_P else _CLOSES.get(tag, ())
        if ends:
            up = node
            while up is not root and up.tag not in ends and up.tag not in _SCOPES:
                up = up.parent
            if up is not root and up.tag in ends:
                node = up.parent
        attributes = _attributes(found[3]) if found[3].strip() else []
        child = Node(tag, node, _noisy(tag, attributes, articles > 0))
        child.named = "" if child.noise else _named(tag, attributes)
        node.parts.append(child)
        if tag in _RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else size
        elif tag not in _VOID and not found[3].rstrip().endswith("/"):
            articles += tag in ("article", "main")
            node = child
    _judge(root)
    return root


def _order(root: Node) -> list[Node]:
    """Nodes that are no noise, parents first."""
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.noise)
    return out


def measure(root: Node) -> list[Node]:
    nodes = _order(root)
    for node in reversed(nodes):
        own = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.chars += own
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
        if node.parent is not None:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags
    share = root.link_chars / max(root.chars, 1)
    for node in reversed(nodes):
        if not node.chars:
            continue
        tags, plain = max(node.tags, 1), max(node.chars - node.link_chars, 1)
        base = math.log(node.chars / plain * node.link_chars + share * node.chars + math.e)
        ratio = node.chars / max(node.link_chars, 1) * tags / max(node.link_tags, 1)
        node.density = node.chars / tags * max(math.log(max(ratio, 1.0)), 1e-6) / max(math.log(base), 0.1)
        if node.parent is not None:
            node.parent.total += node.density
    return nodes


def select(root: Node) -> set[int]:
    """Ids of the subtrees' roots that hold the main text."""
    nodes = measure(root)
    best = max(nodes, key=lambda n: n.total)  # a tie goes to the first, the outermost
    if not root.chars:
        return set()
    if best.total == 0:
        return {id(root)}
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    least = min(n.density for n in path)
    kept, inside = {id(best)}, {id(n) for n in path[1:]}
    stack = [root]
    while stack:
        node = stack.pop()
        if id(node) in kept:
            continue
        if id(node) not in inside and node.density >= least and node.chars and node.tag not in _INLINE:
            kept.add(id(node))
            continue
        if id(node) in inside:
            stack.extend(p for p in node.parts if isinstance(p, Node) and not p.noise)
    return kept


def main_text(html: str | None) -> str:
    """Blocks in page order, white space inside them as one space, joined by one space; empty if there are none."""
    if not html:
        return ""
    root = tree(html)
    kept = select(root)
    out: list[str] = []
    # (part, inside a kept subtree, mark to write instead)
    stack: list[tuple] = [(root, False)]
    while stack:
        part, inside = stack.pop()
        if isinstance(part, str):
            if inside:
                out.append(part)
            continue
        if part.noise:
            out.append(" ")
            continue
        inside = inside or id(part) in kept
        block = part.tag not in _INLINE
        if block:
            out.append(" ")
            stack.append((" ", True))
        stack.extend((p, inside) for p in reversed(part.parts))
    return " ".join("".join(out).split())


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(html.as_py()) for html in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["row", "text"])


def extract(pages: DataFrame, *keep: str) -> DataFrame:
    """Struct ``row`` of the named columns of ``pages(html)`` (default: all) with text.

    Null and empty html, and pages without text, give an empty text. Repeated rows are extracted each; rows are never
    dropped or cut. An empty table gives no rows.
    """
    rows = pages.select(F.struct(*(keep or ["*"])).alias("row"), "html")
    return rows.mapInArrow(_extract, f"row {rows.schema['row'].dataType.simpleString()}, text string")
