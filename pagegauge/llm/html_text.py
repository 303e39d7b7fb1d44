"""HTML extraction: the main text of a page by composite text density of its document tree.

A page becomes a tree once, in one pass over its tags. Elements and roles that
never hold prose (menus, forms, scripts) are left out of it. Every node has a
density, link-adjusted characters a tag, lowered where class or id names speak
against prose; the node with the largest sum of child densities is the core.
Blocks inside it go where links and density, or a name that the block's share
of the prose does not refute, tell against them.
"""

from __future__ import annotations

import html
import math
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Element names by kind. Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES_P = BLOCK - frozenset("body caption dd dt head html legend li optgroup option tbody td tfoot th thead title tr".split())
#: Elements that an opening tag of the same group ends, and what they may not end across.
ENDS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody", "tfoot", "tr", "td", "th")}
FENCES = frozenset("ul ol menu dl table select body html article section div".split())
NO_PROSE = frozenset("script style noscript template nav aside form button select option textarea input iframe object embed svg canvas head title menu dialog footer noembed noframes audio video map label fieldset".split())
NO_PROSE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Words of class and id values that name what is rarely article text.
NO_PROSE_NAMES = frozenset(
    "ad ads advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disclaimer disqus footer gdpr header hidden masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promoted promotion recommended related replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags teaser toolbar widget widgets".split()
)
#: Words that say nothing beside such a name, and words that say it is about something else.
NEUTRAL_NAMES = frozenset("area bar block body bottom box container content floating global group inner item items left list main outer page panel right row section site slot text thread title top unit wrap wrapper zone".split())
OTHER_NAMES = frozenset("has hide is no not with without".split())
CORE = frozenset(("article", "main"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: What a name leaves of a density, by how plainly it speaks; a block with this share of all prose refutes its name.
TRUST, REFUTES = (1.0, 0.7, 0.2), 0.5

_TOKEN = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>?|<([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+")


@dataclass(slots=True)
class Node:
    tag: str
    parent: Node | None
    out: bool  # no prose, by itself or by what holds it
    named: int = 0  # whether its names speak against prose: 0 no, 1 hardly, 2 plainly
    children: list = field(default_factory=list)  # nodes and texts in order
    chars: int = 0
    tags: int = 0
    link_chars: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0
    trust: float = 1.0
    cores: int = 0  # articles and mains with text in the subtree, itself included


def name_against(value: str) -> int:
    """How plainly a class or id speaks against prose: 2 if one of its tokens is such a name, alone, beside neutral words
    or as the noun that a compound ends in; 1 if one is only part of a token (share-price, with-sidebar)."""
    out = 0
    for token in value.split():
        parts = [p.lower() for p in _NAME_PARTS.findall(token)]
        telling = [p for p in parts if p not in NEUTRAL_NAMES]
        if any(p in NO_PROSE_NAMES for p in telling):
            plain = all(p in NO_PROSE_NAMES for p in telling) or (telling[-1] in NO_PROSE_NAMES and telling[-1] != "header")
            out = max(out, 2 if plain and not OTHER_NAMES.intersection(parts) else 1)
    return out


def _read(tag: str, attributes: str, core: bool) -> tuple[bool, int]:
    """(whether an element never holds prose, how plainly its names speak against it)."""
    if tag in NO_PROSE or (tag == "header" and not core):
        return True, 0
    named = 0
    for m in _ATTRIBUTE.finditer(attributes or ""):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return True, 0
        if name == "role" and value.lower() in NO_PROSE_ROLES:
            return True, 0
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True, 0
        if name in ("class", "id") and tag not in ("html", "body"):
            named = max(named, name_against(value))
    return False, named


class _Open:
    """The open elements of a page, with the places of each name, so that finding one takes no walk."""

    def __init__(self, root: Node) -> None:
        self.nodes, self.places, self.fences = [root], {}, [0]

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self.nodes))
        if node.tag in FENCES:
            self.fences.append(len(self.nodes))
        self.nodes.append(node)

    def cut(self, place: int) -> None:
        """Close what is open from a place on."""
        while len(self.nodes) > place:
            tag = self.nodes.pop().tag
            self.places[tag].pop()
            if tag in FENCES:
                self.fences.pop()

    def place(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else 0

    def close(self, tag: str) -> None:
        """Close the nearest ``tag``; one that is not a fence only this side of the nearest fence."""
        at = self.place(tag)
        if at and (tag in FENCES or at > self.fences[-1]):
            self.cut(at)

    def end(self, group: tuple[str, ...]) -> None:
        inside = [at for at in map(self.place, group) if at > self.fences[-1]]
        if inside:
            self.cut(min(inside))


def parse(page: str) -> Node:
    """The tree of a page; texts have their references decoded, what is no prose is marked."""
    root = Node("html", None, False)
    open_ = _Open(root)
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        closing, opening = m[1], m[2]
        if opening:
            tag = opening.lower()
            attributes = m[3]
            if tag in CLOSES_P:
                open_.close("p")
            if tag in ENDS:
                open_.end(ENDS[tag])
            node = open_.nodes[-1]
            core = tag == "header" and any(map(open_.place, CORE))
            never, named = _read(tag, attributes, core)
            new = Node(tag, node, node.out or never, named)
            node.children.append(new)
            if tag in RAW:
                new.out = True  # text of these elements is never prose
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(page, at)
                close = -1 if end is None else page.find(">", end.start())
                at = n if close < 0 else close + 1
            elif tag not in VOID and (tag in BLOCK or not attributes.rstrip().endswith("/")):
                open_.push(new)
        elif closing:
            open_.close(closing.lower())
        elif m[0][0] != "<" or m[0] == "<":
            open_.nodes[-1].children.append(html.unescape(m[0]))
    return root


def _order(root: Node) -> list[Node]:
    """All prose nodes, each after what holds it."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        if not node.out:
            out.append(node)
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def measure(root: Node) -> list[Node]:
    """Fill in densities and their sums; returns prose nodes in page order.

    chars, tags: of the subtree; link_chars, link_tags: those in links. The
    composite density of a node is chars per tag times a logarithm of
    (chars * tags of links) / (link chars * tags), whose base grows with the
    share of link text, as links make a block less likely to be prose. A name
    that speaks against prose lowers the densities of its node and of all that
    this holds, unless that is half of all prose or more and no article is elsewhere.
    """
    nodes = _order(root)
    for node in reversed(nodes):
        for c in node.children:
            if isinstance(c, str):
                node.chars += sum(map(len, c.split()))
            elif not c.out:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags
                node.cores += c.cores
        node.cores += node.tag in CORE and node.chars > 0
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.link_tags + 1
    body_chars, body_links = max(1, root.chars), root.link_chars
    for node in nodes:  # each after what holds it
        refuted = node.chars - node.link_chars >= REFUTES * (root.chars - root.link_chars) and (node.cores > 0 or not root.cores)
        node.named = 0 if refuted else node.named
        node.trust = (node.parent.trust if node.parent else 1.0) * TRUST[node.named]
    for node in reversed(nodes):
        if node.chars:
            tags, prose = max(1, node.tags), node.chars - node.link_chars
            base = math.log(node.chars / max(1, prose) * node.link_chars + body_links / body_chars * node.chars + math.e)
            share = node.chars / max(1, node.link_chars) * (tags / max(1, node.link_tags))
            node.density = node.chars / tags * math.log(max(share, 1.0) + 1e-9) / math.log(max(base, 1.0) + 1) * node.trust if share > 1 else 0.0
        node.total = sum(c.density for c in node.children if isinstance(c, Node) and not c.out)
    return nodes


def main_node(root: Node) -> tuple[list[Node], float]:
    """The subtrees of the main text, and the density under which a block of links in them is none.

    The node with the largest sum of child densities is the core; the least
    density on the path to it from the body is the threshold. The outermost
    article that holds the core stands for it. A core around articles gives way
    to them, but for mere snippets. Else siblings of the core that reach the
    threshold belong to the text too.
    """
    nodes = measure(root)
    body = next((n for n in nodes if n.tag == "body"), root)
    held = [n for n in nodes if n.chars]
    if not held:
        return [], 0.0
    trusted = [n for n in held if n.trust > TRUST[2]] or held
    core = max(trusted, key=lambda n: n.total or n.density * 1e-3)
    path, at = [], core
    while at is not None and at is not body:
        path.append(at)
        at = at.parent
    threshold = min((n.density for n in path if n.density), default=body.density)
    frames = [n for n in path if n.tag == "article"]
    if frames:
        return frames[-1:], threshold
    within = next((n for n in reversed(path) if n.tag == "main"), core)
    tops, under = [], set()
    for n in nodes:
        if n is within or id(n.parent) in under:
            under.add(id(n))
            if n.tag == "article" and n.chars and n.trust > TRUST[2]:
                under.discard(id(n))
                tops.append(n)
    if tops:
        best = max(tops, key=lambda n: n.total or n.density)
        tops = [n for n in tops if n.chars * 4 >= best.chars]
        if sum(n.chars for n in tops) * 4 >= core.chars:
            return tops, threshold
    if within.tag == "main" or core is body or core.parent is None:
        return [within], threshold
    beside = [c for c in core.parent.children if isinstance(c, Node) and not c.out and c.chars and (c is core or c.density >= threshold or (c.tag in HEADINGS and c.trust == core.trust))]
    return beside, threshold


def beside_the_text(node: Node, threshold: float) -> bool:
    """Whether a block inside the main text is none of it: plainly named so, or mostly links and thinner than the threshold."""
    if not node.chars:
        return False
    return node.named == 2 or (node.tag not in HEADINGS and 2 * node.link_chars >= node.chars and node.link_tags > 1 and node.density < threshold)


def blocks(top: Node, threshold: float = 0.0) -> list[str]:
    """Texts of a subtree's blocks in page order, white space turned into single spaces."""
    out, now = [], []

    def end() -> None:
        text = " ".join("".join(now).split())
        now.clear()
        if text:
            out.append(text)

    todo: list = [top]
    while todo:
        item = todo.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            now.append(item)
        elif item.tag == "br":
            now.append(" ")
        elif not item.out and (item is top or item.tag not in BLOCK or not beside_the_text(item, threshold)):
            if item.tag in BLOCK:
                end()
                todo.append(None)
            todo += reversed(item.children)
        elif item.tag in BLOCK:
            end()
    end()
    return out


def extract(page: str | None) -> str:
    """The main text of a page: its blocks, joined by empty lines. Empty for null, empty and proseless pages."""
    if not page:
        return ""
    tops, threshold = main_node(parse(page))
    return "\n\n".join(b for top in tops for b in blocks(top, threshold))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every row. Null and empty html give an empty text; repeated rows and null ids stay."""

    @F.arrow_udf("string")
    def main_text(column: pa.Array) -> pa.Array:
        return pa.array([extract(x) for x in column.to_pylist()], pa.string())

    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), main_text(F.col(html_col).cast("string")).alias("text"))
    return rows.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
