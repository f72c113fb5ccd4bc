"""Main text of web pages by composite text density.

Every node of a page's tree has a number of characters, tags, link characters and link tags. Its density is characters
per tag, corrected by how much of both lies in links; the node whose children have the largest sum of densities holds
the main text, and the smallest density on the path from it to the body is the threshold beyond which other nodes
belong to the text as well. The text is written from the nearest node that holds all of them, kept blocks whole with
what is inline in them. Parts that are no text of the page by their tag, role or class (menus, controls of forms,
scripts, notices, adverts, comments of readers) are left out before densities are computed, unless they hold an article,
the main element or most of the page's text.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"""<!--(?:.*?-->|.*\Z)|<[!?][^>]*>|<[A-Za-z/!?][^>]*\Z|<(?P<close>/?)(?P<name>[A-Za-z][^\s/>]*)(?P<rest>(?:[^>=]++|=\s*+(?:"[^"]*"|'[^']*')?+)*+)>""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SELF_CLOSING = re.compile(r"""(?:\A|[\s"'])/\Z""")

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_RAW_END = {name: re.compile(rf"</{name}\b[^>]*(?:>|\Z)", re.I) for name in _RAW}
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul br".split()
)
#: What may stand in a head; any other element ends it, and so does text.
_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title html".split())
#: Never part of the text.
_DROPPED = _RAW | frozenset("head nav aside footer button select option input svg canvas object audio video map dialog menu label".split())
_DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of a class or id that mark a part as no text of the page.
_DROPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising sponsor sponsored promo promoted nav navbar navigation menu menubar breadcrumb breadcrumbs"
    " sidebar sidebars aside footer foot masthead topbar cookie cookies consent gdpr notice notices banner popup modal overlay newsletter subscribe"
    " subscription signup login comment comments commentlist disqus replies reply respond discussion reactions share sharing social related recommended"
    " recommendations pagination pager widget toolbar skip legal copyright disclaimer".split()
)
#: Words that may stand beside them in a name, as in "site-footer" or "ad-container".
_NEUTRAL_NAMES = frozenset(
    "site page global main primary secondary top bottom left right inner outer container wrapper wrap box bar block section area list item items link"
    " links button buttons icon icons group message consent slot unit form".split()
)
_WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("name", "children", "parent", "block", "in_main", "chars", "tags", "link_chars", "link_tags", "density", "kept", "marked")

    def __init__(self, name: str, parent: Node | None) -> None:
        self.name, self.parent, self.children = name, parent, []
        #: The nearest block around, itself included, and whether an article or main element is.
        self.block = self if name in _BLOCK or parent is None else parent.block
        self.in_main = name in ("article", "main") or parent is not None and parent.in_main
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density, self.kept, self.marked = 0.0, False, False


def _is_name_of_dropped(token: str) -> bool:
    """Whether every word of a class or id is one of no text or a neutral one, and not all are neutral."""
    words = set(_WORD.findall(token))
    return not words.isdisjoint(_DROPPED_NAMES) and words <= _DROPPED_NAMES | _NEUTRAL_NAMES


def _is_marked(name: str, rest: str) -> bool:
    """Whether a part's attributes or its being a form speak against it; see ``_pruned``."""
    if name == "form":
        return True
    if not rest or name in ("html", "body", "article", "main"):
        return False
    for attribute in _ATTRIBUTE.finditer(rest):
        key = attribute[1].lower()
        value = (attribute[2] or attribute[3] or attribute[4] or "").lower()
        if key == "role" and value in _DROPPED_ROLES or key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "style" and "display:none" in value.replace(" ", ""):
            return True
        if key == "class" and any(map(_is_name_of_dropped, value.split())) or key == "id" and _is_name_of_dropped(value):
            return True
    return False


class _Open:
    """The open nodes of a page, innermost last, with their number by name."""

    def __init__(self) -> None:
        self.root = self.node = Node("#root", None)
        self.counts: Counter[str] = Counter()

    def enter(self, node: Node) -> None:
        self.node = node
        self.counts[node.name] += 1

    def leave_to(self, outer: Node) -> None:
        while self.node is not outer:
            self.counts[self.node.name] -= 1
            self.node = self.node.parent

    def close(self, name: str) -> None:
        """The end tag ``name``: a stray one ends nothing, an inline one no block around it, and the body goes on to the end."""
        if self.counts[name] and name not in ("body", "html"):
            own = self.node
            while own.name != name:
                if name not in _BLOCK and own.name in _BLOCK:
                    return
                own = own.parent
            self.leave_to(own.parent)


def parse(page: str) -> Node:
    """Tree of a page's nodes and texts, without the parts that are dropped by tag. Unclosed and stray tags are borne:
    a block ends an open paragraph, a list item, cell or option its predecessor, whatever cannot stand in a head ends it,
    and what stays open ends with the page."""
    tree = _Open()
    skipped: list[str] = []  # open tags inside a dropped part
    place = 0

    def text(until: int) -> None:
        if until > place:
            if skipped == ["head"] and not page[place:until].isspace():
                skipped.clear()
            if not skipped:
                tree.node.children.append(page[place:until])

    while True:
        token = _TOKEN.search(page, place)
        if token is None:
            text(len(page))
            return tree.root
        text(token.start())
        place = token.end()
        if token["name"] is None:
            continue
        name = token["name"].lower()
        if token["close"]:
            if name in skipped:
                while skipped.pop() != name:
                    pass
            elif not skipped:
                tree.close(name)
            elif tree.counts[name]:
                skipped.clear()
                tree.close(name)
            continue
        empty = name in _VOID or name not in _BLOCK and bool(_SELF_CLOSING.search(token["rest"]))
        if name in _RAW:
            end = _RAW_END[name].search(page, place)
            place = end.end() if end else len(page)
            continue
        if skipped == ["head"] and name not in _HEAD:
            skipped.clear()
        if skipped:
            if not empty:
                skipped.append(name)
            continue
        if name in _BLOCK and name != "br":
            tree.leave_to(_ended(tree.node, name))
        if name in _DROPPED or name == "header" and not tree.node.in_main:
            if not empty:
                skipped.append(name)
                tree.node.children.append("\n")
            continue
        made = Node(name, tree.node)
        made.marked = _is_marked(name, token["rest"])
        tree.node.children.append(made)
        if not empty:
            tree.enter(made)


_SIBLINGS = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table", "tbody", "thead", "tfoot"), "td": ("tr",), "th": ("tr",)}


def _ended(node: Node, name: str) -> Node:
    """Where a new block goes: it ends an open paragraph, or an earlier item of the same list."""
    own = node.block
    if own.name == "p":
        return own.parent
    if name in _SIBLINGS:
        while own.parent and own.name not in _SIBLINGS[name]:
            if own.name == name or own.name in ("dt", "dd") and name in ("dt", "dd"):
                return own.parent
            own = own.parent.block
    return node


def _nodes(top: Node) -> list[Node]:
    """``top`` and all nodes below it, parents before children."""
    order, stack = [], [top]
    while stack:
        node = stack.pop()
        order.append(node)
        stack.extend(c for c in node.children if isinstance(c, Node))
    return order


def _pruned(root: Node) -> None:
    """Take out marked parts, but for those that hold an article or main element, or, on a page without one outside
    them, more than half of the page's text."""
    order = _nodes(root)
    chars, mains = dict.fromkeys(order, 0), dict.fromkeys(order, 0)
    for node in reversed(order):
        chars[node] += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        mains[node] += node.name in ("article", "main")
        if node.parent:
            chars[node.parent] += chars[node]
            mains[node.parent] += mains[node]
    gone = {n for n in order if n.marked and not mains[n] and (mains[root] or 2 * chars[n] <= chars[root])}
    for node in {n.parent for n in gone}:
        node.children = ["\n" if isinstance(c, Node) and c in gone else c for c in node.children]


def _measure(order: list[Node]) -> None:
    for node in reversed(order):
        node.chars += sum(len("".join(c.split())) for c in node.children if isinstance(c, str))
        if node.name == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
        if node.parent:
            up = node.parent
            up.chars += node.chars
            up.tags += node.tags + 1
            up.link_chars += node.link_chars
            up.link_tags += node.link_tags


def _densities(order: list[Node], body: Node) -> None:
    ratio = body.link_chars / max(body.chars, 1)
    for node in order:
        chars, tags, links, link_tags = node.chars, max(node.tags, 1), max(node.link_chars, 1), max(node.link_tags, 1)
        if not chars:
            continue
        plain = max(chars - node.link_chars, 1)
        base = math.log(chars / plain * node.link_chars + ratio * chars + math.e)
        corrected = math.log(max(chars / links * tags / link_tags, 1.0)) / base
        node.density = chars / tags * corrected


def main_text(page: str | None) -> str:
    """Blocks of the main text, one to a line."""
    if not page:
        return ""
    root = parse(page)
    _pruned(root)
    order = _nodes(root)
    body = next((n for n in order if n.name == "body"), root)
    _measure(order)
    order = _nodes(body)
    _densities(order, body)
    best, most = body, -1.0
    for node in order:
        total = sum(c.density for c in node.children if isinstance(c, Node) and c.name in _BLOCK)
        if total > most:
            best, most = node, total
    threshold, node = best.density, best
    while node is not body:
        node = node.parent
        threshold = min(threshold, node.density)
    above, node = set(), best
    while node is not body:
        node = node.parent
        above.add(node)
    for node in order:
        node.kept = node.density >= threshold > 0 and node not in above
    best.kept = True
    for node in reversed(order):  # children come before their parents, so one step each leads up to the block
        if node.kept and node.name not in _BLOCK and node.parent is not None and node.parent not in above and node is not body:
            node.parent.kept = True
    top = _lifted(best, body, order, above)
    holds = set()
    for node in reversed(order):
        if node.kept or node in holds:
            holds.add(node)
            if node.parent:
                holds.add(node.parent)
    for node in order:
        node.kept = node.kept or node.name in ("article", "main") and node in holds and node not in above
    out: list[str] = []
    _write(body, top, best, holds, above if threshold > 0 else set(), out)
    blocks = (" ".join(html.unescape(b).split()) for b in "".join(out).split("\x00"))
    return "\n".join(b for b in blocks if b)


def _lifted(best: Node, body: Node, order: list[Node], above: set[Node]) -> Node:
    """The outermost article or main element around ``best``; without one, the nearest node that holds all kept ones."""
    found, node = None, best
    while True:
        if node.name in ("article", "main"):
            found = node
        if node is body:
            break
        node = node.parent
    if found:
        return found
    inside = dict.fromkeys(order, 0)
    for node in reversed(order):
        inside[node] += node.kept
        if node is not body:
            inside[node.parent] += inside[node]
    node = best
    while inside[node] < inside[body]:
        node = node.parent
    return node


def _write(body: Node, top: Node, best: Node, holds: set[Node], above: set[Node], out: list[str]) -> None:
    """Texts in page order, blocks apart by NUL: all under ``best`` and kept nodes, all under ``top`` but blocks of links
    that hold nothing kept, and what stands in the nodes above ``best`` themselves."""
    links = top is not best and top.name not in ("article", "main")
    stack: list[tuple[object, bool, bool]] = [(body, False, False)]
    while stack:
        item, lifted, whole = stack.pop()
        if isinstance(item, str):
            if lifted or whole:
                out.append(item.replace("\x00", " "))
            continue
        if item is None:
            out.append("\x00")
            continue
        whole = whole or item is best or item.kept
        lifted = lifted or item is top
        block = item.name in _BLOCK
        if links and lifted and not whole and block and item not in holds and 2 * item.link_chars > item.chars:
            continue
        if block:
            out.append("\x00")
            stack.append((None, False, False))
        for child in reversed(item.children):
            stack.append((child, lifted or isinstance(child, str) and item in above, whole))


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """``df`` with ``out_col``, the main text of the whole page; an existing column of that name is replaced.

    A block's white space is one space, its ends are trimmed, references are decoded, empty blocks are left out. NULL
    or empty pages, and pages without text, give an empty text. Rows are neither dropped nor merged; equal pages give
    equal texts. One narrow pass; memory follows the longest page.
    """

    @F.pandas_udf("string")
    def extracted(pages):
        return pages.map(main_text, na_action=None)

    return df.withColumn(out_col, extracted(F.col(html_col)))
