"""The main text of web pages, by points that paragraphs give to the boxes around them."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import free_name

# Elements by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
DROPPED = frozenset(
    "script style noscript template head title nav footer aside form button select option textarea iframe object "
    "svg canvas audio video dialog menu".split()
)
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe")
BLOCKS = frozenset(
    "address article blockquote body center dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 header "
    "hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
# An open one of these is ended by the start of one that follows it.
ENDED_BY = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot", "thead"},
    "td": {"td", "th", "tr", "tbody"}, "th": {"td", "th", "tr", "tbody"}, "option": {"option"},
}
BOXES = frozenset("article body div main section table td th ul ol li blockquote".split())

# Parts of names that say what does not belong to an article, in any name with such a part.
_AWAY = re.compile(
    r"advert\w*|breadcrumbs?|comments|cookies?|consent|disqus|footer|gdpr|login|masthead|menu|modal|nav|navbar|navigation|"
    r"newsletter|pagination|pager|popup|replies|respond|sidebar|signup|sponsor\w*|subscribe|toolbar|widget"
)
# The same, but words of articles too: the rest of the name may only say where, or what kind of box.
_VAGUE = re.compile(r"ads?|banner|comment|notice|promo\w*|related|remark\w*|share|sharing|social")
_BOX_WORDS = frozenset(
    "area articles bar block body bottom box button buttons container content entry footer form group header icons inner "
    "item items left link links list main media outer page panel post posts primary right row secondary section site slot "
    "stories text title top wrap wrapper".split()
)
_ROLES = frozenset("alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
# Ids of these are anchors made of their texts.
_ANCHORED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd".split())
_GOOD_NAMES = re.compile(r"article|body|content|entry|main|page|post|story|text", re.I)
# Boxes of a whole page: what stands in them need not be one text.
_LAYOUT = re.compile(
    r"(?:(?:site|page|main|outer|inner)[-_]?)?(?:app|columns?|container|grid|layout|outer|page|root|row|shell|site|viewport|wrap(?:per)?)"
)
# No part of it can be tried twice over the same characters, so pages of unclosed tags take no longer than others.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|"
    r"<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<|[^<]++", re.S
)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_RAW_END = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW}
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# A text of this many characters is a paragraph that gives points.
MIN_PARAGRAPH = 25
SIBLING_SHARE = 0.2
# A box with this share of its text in links is no text.
MANY_LINKS = 0.25


class Node:
    __slots__ = ("tag", "parent", "children", "dropped", "points", "good", "size", "linked", "layout", "near", "article", "chosen")

    def __init__(self, tag: str, parent: "Node | None", dropped: bool = False, good: float = 0.0, layout: bool = False):
        self.tag, self.parent, self.dropped, self.good, self.layout = tag, parent, dropped, good, layout
        self.children: list = []
        self.points, self.size, self.linked, self.chosen = 0.0, 0, 0, False
        # The closest element, itself included, that decides where a block goes; whether it is in an article.
        self.near: Node = self if parent is None or tag in BLOCKS or tag in ENDED_BY else parent.near
        self.article: bool = tag in ("article", "main") or parent is not None and parent.article


def _names_away(classes: str, id_: str) -> bool:
    """Whether a class or an id says that an element is no part of an article."""
    for name, strict in (*((c, False) for c in classes.split()), (id_, True)):
        parts = [p for p in re.split(r"[-_\s]+", name.lower()) if p]
        away = [bool(_AWAY.fullmatch(p)) for p in parts]
        if any(away) and not strict:
            return True
        told = [a or bool(_VAGUE.fullmatch(p)) for a, p in zip(away, parts)]
        if any(told) and all(t or p in _BOX_WORDS or p.isdigit() for t, p in zip(told, parts)):
            return True
    return False


def _start(tag: str, attributes: str, parent: Node) -> Node:
    if parent.dropped:
        return Node(tag, parent, True)
    found = {a.lower(): b or c or d or "" for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes else {}
    classes, id_ = found.get("class", ""), "" if tag in _ANCHORED else found.get("id", "")
    named = f"{classes} {id_}".strip()
    dropped = (
        tag in DROPPED or "hidden" in found or found.get("aria-hidden") == "true"
        or bool(_HIDDEN.search(found.get("style", ""))) or found.get("role", "").lower() in _ROLES
        or tag not in ("html", "body", "main", "article") and _names_away(classes, id_)
        # A comment marked up as an article of its own.
        or tag == "article" and parent.article and _names_away(classes, id_)
        # A heading group of the page, not of the article.
        or tag == "header" and not parent.article
    )
    good = 25.0 * (tag in ("article", "main")) + 25.0 * bool(named and _GOOD_NAMES.search(named)) + 5.0 * (tag == "div")
    layout = any(_LAYOUT.fullmatch(n) for n in named.lower().split())
    return Node(tag, parent, dropped, good, layout)


def parse(page: str) -> list[Node]:
    """The elements of a page, each after the one around it, the root first; children are elements and texts. Elements
    left open are ended by what cannot stand inside them, by the end of an element around them, or by the end."""
    root = Node("html", None)
    nodes, now, place, size = [root], root, 0, len(page)
    open_ = Counter({"html": 1})  # the tags of `now` and what is around it

    def leave(until: Node) -> Node:
        node = now
        while node is not until:
            open_[node.tag] -= 1
            node = node.parent
        return until

    while place < size:
        token = _TOKEN.match(page, place)
        place = token.end()
        tag = token[2]
        if tag is None:
            text = token[0]
            if not now.dropped and (text[0] != "<" or text == "<"):
                now.children.append(entities.unescape(text))
            continue
        tag = tag.lower()
        if token[1]:
            if open_[tag] > (tag == "html"):
                node = now
                while node.tag != tag:
                    node = node.parent
                now = leave(node.parent)
            continue
        if tag in BLOCKS:
            now = leave(_without_open(now, tag))
        if tag in VOID or token[3].endswith("/") and tag not in BLOCKS:
            if not now.dropped:
                now.children.append("\n")
            continue
        if tag in ("html", "body") and open_[tag]:
            continue
        node = _start(tag, token[3], now)
        now.children.append(node)
        if tag in _RAW_END:
            end = _RAW_END[tag].search(page, place)
            place = end.end() if end else size
            continue
        nodes.append(node)
        open_[tag] += 1
        now = node
    return nodes


def _without_open(now: Node, tag: str) -> Node:
    """Where an element goes: behind a paragraph, or one that it ends, that is still open."""
    node = now.near
    while node.parent is not None:
        if node.tag == "p" or tag in ENDED_BY.get(node.tag, ()):
            return node.parent
        if node.tag in BLOCKS and not (tag in ("li", "dt", "dd", "td", "th", "tr") and node.tag in ("tr", "td", "th")):
            return now
        node = node.parent.near
    return now


class _Block:
    __slots__ = ("box", "parts", "linked")

    def __init__(self, box: Node):
        self.box, self.parts, self.linked = box, [], 0


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """(element, text, characters in links) of each run of text that no block element cuts, in
    page order. The walk keeps its own stack: pages may be nested deeper than calls can be."""
    found, current = [], None
    stack: list = [(root, 0, root, False)]
    while stack:
        node, place, box, link = stack.pop()
        if place == 0 and node.tag in BLOCKS:
            current = None
        while place < len(node.children):
            child = node.children[place]
            place += 1
            if isinstance(child, str):
                if current is None:
                    current = _Block(box)
                    found.append(current)
                current.parts.append(child)
                if link:
                    current.linked += len(" ".join(child.split()))
            elif not child.dropped:
                stack.append((node, place, box, link))
                stack.append((child, 0, child if child.tag in BLOCKS else box, link or child.tag == "a"))
                break
        else:
            if node.tag in BLOCKS:
                current = None
    out = []
    for block in found:
        text = " ".join("".join(block.parts).split())
        if text:
            out.append((block.box, text, block.linked))
    return out


def main_text(page: str | None) -> str:
    """The blocks of the best box and of the siblings that belong to it, joined by one space; of the whole
    article or main that the best box is in, if there is one, and of articles beside it. Without an article, of the
    boxes around the best one too, up to a box of the page's layout or one with many links.

    Each paragraph of MIN_PARAGRAPH characters or more gives its box 1 point, 1 per comma and up to 3 for
    length; each box around gets half of what the one inside has. A box's own points are
    its points and what its tag and name promise, times the share of its text outside links. All sums are made
    once, from the inner elements to the outer ones, so the time grows with the page's length.
    """
    nodes = parse(page or "")
    blocks = _blocks(nodes[0])
    if not blocks:
        return ""
    for box, text, linked in blocks:
        box.size += len(text)
        box.linked += linked
        if box.tag.startswith("h") and box.tag[1:].isdigit():
            continue
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) if len(text) >= MIN_PARAGRAPH else 0.1
        receiver = box if box.tag in ("div", "article", "section", "main", "body", "html") else box.parent
        receiver.points += points
    for node in reversed(nodes[1:]):
        node.parent.points += node.points / 2
        node.parent.size += node.size
        node.parent.linked += node.linked

    def value(node: Node) -> float:
        promise = node.good if node.points > 0 else 0.0
        return (node.points + promise) * (1 - node.linked / max(node.size, 1))

    scored = [n for n in nodes if n.points > 0 and (n.tag in BOXES or n.parent is None)]
    best = max(scored or nodes[:1], key=value)
    if best.article:
        # A box of an article is not all of it: short sections, lists, tables and figures beside it are text too.
        while best.tag not in ("article", "main"):
            best = best.parent
    else:
        while best.tag not in ("html", "body", "td", "th"):
            around = best.parent
            if around.tag in ("html", "body", "table", "tbody", "tr") or around.layout or around.linked > MANY_LINKS * around.size:
                break
            best = around
    best.chosen = True
    if best.parent is not None and best.tag not in ("main", "body"):
        least = max(10.0, SIBLING_SHARE * value(best))
        for sibling in best.parent.children:
            if isinstance(sibling, Node) and not sibling.dropped and sibling.size:
                if best.tag == "article":
                    belongs = sibling.tag == "article" and value(sibling) >= least
                else:
                    belongs = sibling.tag in BOXES and value(sibling) >= least or (
                        sibling.tag in ("p", "h1", "h2", "h3") and sibling.linked < MANY_LINKS * sibling.size
                    )
                sibling.chosen |= belongs
    for node in nodes[1:]:
        if not node.chosen:
            links = node.tag in ("ul", "ol", "table", "div", "section") and node.linked > 0.5 * node.size
            node.chosen = node.parent.chosen and not links
    return " ".join(text for box, text, _ in blocks if box.chosen)


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of `pages` but the html, with the main text (replacing a column `out`); others keep their values.

    A null or empty page, or one without text, gives the empty text. Pages are read whole, one
    at a time, where they are: nothing is shuffled, and repeated rows give the same text.
    """
    kept = [c for c in pages.columns if c not in (html, out)]
    page = free_name(pages, "_html")
    source = pages.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{html}`").cast("string").alias(page))
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in source.schema.fields[:-1])

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(len(kept))], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*kept, out])

    return source.mapInArrow(extracted, f"{fields}`{out}` string")
