"""Main text of web pages by composite text density.

Each page becomes a small tree of elements. For a node with C characters, T
tags, LC link characters and LT link tags below it, and with C and LC of the
body as CB and LCB, the density is

    C / T * log( C * T / (LC * LT), base ln( C * LC / (C - LC) + LCB / CB * C + e ) )

with counts of zero taken as one. A node's density sum adds the densities of
its children. The element that can hold blocks and has the largest sum holds
the main text; the smallest density on its path to the body is the threshold,
and subtrees beside the path that reach it belong to the text as well. An
article or main element that holds a good part of the words outside it bounds
the choice: it is the subtree then. A text without a headline takes the nearest
one before it, and paragraphs that follow it in a box of their own stay.

Menus, adverts, notices and the like are cut out by element or role before;
reader comments by a whole name or by their heading, whatever their length.
Elements whose whole class name or id means noise, and forms, are cut out if
they are made of links or controls or the page has its text elsewhere
(``prune``); those with such a word among others only if made of links.

Rows: a null or empty page, or one without text, gives ""; unclosed elements
are closed by the rules of HTML; repeated rows each keep a row; an empty table
gives an empty result; other columns are ignored. Pages are read whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import byte_slices, map_arrow

SCHEMA = "page_id long, url string, text string, n_chars long"

#: Elements of HTML by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("head script style noscript template iframe object svg canvas nav header footer aside form button select textarea input dialog menu audio video map".split())
BLOCKS = frozenset("address article blockquote body caption dd details div dl dt fieldset figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr html li main ol p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("article aside blockquote body details div dl fieldset figure footer form header html main menu nav ol section table td th ul".split())
HOLDERS = frozenset("article blockquote body center dd details div dl figure main ol section table tbody td tr ul".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
NOISE_WORDS = frozenset("ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice pager pagination popup promo promoted promotion related respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split())
#: Words that stand beside those in the name of an element that is no text; a name with any other word may be made from a heading.
PLACE_WORDS = frozenset("js wp desktop large small sticky fixed overlay area bar bars block bottom box button buttons center col column container content footer form global group header holder inline inner item items left level link links list main menu mobile module outer page panel posts articles stories topics primary reader right row secondary section side signup site slot subnav tab tabs thread top trail unit user view wrap wrapper zone".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTROLS = frozenset("button select textarea input".split())
#: Characters of a form for each of its controls up to which it consists mainly of controls.
LABEL = 50
#: Whole names of what readers wrote, and headings above it.
COMMENT_NAME = re.compile(r"(?:(?:reader|user|post|article|page|blog|entry|site|view|all)s?[-_]?)?comments?(?:[-_]?(?:list|area|section|wrap|wrapper|container|box|thread|block|form|item|respond|reply))?|(?:comment[-_])?respond|disqus(?:[-_]?thread)?|comments?[-_]\d+")
COMMENT_HEADING = re.compile(r"(?:\d+ )?(?:(?:reader|user|readers'|leser)[- ]?)?(?:comments?|kommentare?|commentaires?|comentarios?|leave a (?:comment|reply))(?: ?\(?\d+\)?)?:?", re.I)
#: Share of the words outside it from which an article or main element bounds the choice.
BOUND = 0.1
NOT_TEXT = re.compile("©|copyright|all rights reserved", re.I)
SENTENCE_END = re.compile("[.!?…。！？][\"'”’»)]*$")
SPACE = re.compile(r"\s+")
NAME_PART = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "named", "hinted", "comment", "controls", "chars", "tags", "link_chars", "link_tags", "density", "total")

    def __init__(self, tag: str, parent: Node | None):
        self.tag, self.parent, self.children = tag, parent, []  # children: nodes and strings, in page order
        self.named = self.hinted = self.comment = False  # whether a name means noise, has a word for it, or means comments
        self.controls = 0  # in a form
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def is_noise(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in SKIPPED and tag != "form":
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
        elif name == "role" and value.lower() in NOISE_ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and "display:none" in value.replace(" ", "").lower():
            return True
    return False


def names(tag: str, attrs: list[tuple[str, str | None]]) -> tuple[bool, bool, bool]:
    """What class names and id say: a whole name means noise (a word for it, and no others but words of place), has such a word, means comments. Headings and paragraphs are text whatever their name."""
    named = hinted = comment = False
    if tag not in ("html", "body", "p") and tag not in HEADINGS:
        for name, value in attrs:
            for one in value.lower().split() if name in ("class", "id") and value else ():
                parts = [x for x in NAME_PART.findall(one) if len(x) > 1]
                comment |= COMMENT_NAME.fullmatch(one) is not None
                if tag not in ("article", "main") and not NOISE_WORDS.isdisjoint(parts):
                    hinted = True
                    named |= all(x in NOISE_WORDS or x in PLACE_WORDS for x in parts)
    return named, hinted, comment


class Tree(HTMLParser):
    """Builds the element tree; what lies inside noise is left out."""

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("body", None)
        self.suspects = self.doubts = False
        self.noise: list[str] = []  # open elements from the outermost noise on

    def close_to(self, tags: Iterable[str], scope: frozenset[str]) -> None:
        """Close the nearest open element among ``tags`` that no scope element hides."""
        node = self.at
        while node.parent is not None:
            if node.tag in tags:
                self.at = node.parent
                return
            if node.tag in scope:
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.noise:
            if tag in ("body", "article", "main") and self.noise[0] in ("head", "p"):
                self.noise.clear()
            elif tag not in VOID:
                self.noise.append(tag)
                return
            else:
                return
        if tag in ("html", "body"):
            return
        if tag in ENDS_P or tag in SKIPPED and tag not in ("button", "select", "textarea", "input", "script", "svg", "noscript"):
            self.close_to(("p",), SCOPE)
        if tag in CLOSED_BY:
            self.close_to(CLOSED_BY[tag], SCOPE - {"td", "th"} if tag == "tr" else SCOPE)
        if tag in CONTROLS:
            node = self.at
            while node is not None and node.tag != "form":
                node = node.parent
            if node is not None:
                node.controls += 1
        if is_noise(tag, attrs) and not (tag == "header" and self.is_open("article")):  # an article's own header holds its title
            if tag not in VOID:
                self.noise.append(tag)
            return
        if tag in VOID:
            self.at.children.append(Node(tag, self.at))
            return
        node = Node(tag, self.at)
        node.named, node.hinted, node.comment = names(tag, attrs)
        self.suspects |= node.named or tag == "form"
        self.doubts |= node.hinted or node.comment or tag in HEADINGS
        self.at.children.append(node)
        self.at = node

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "path"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if self.noise:
            if tag in self.noise:
                while self.noise.pop() != tag:
                    pass
                return
            if not (tag in SCOPE and self.is_open(tag)):
                return
            self.noise.clear()  # an enclosing element ends, so the unclosed noise ends as well
        if tag in ("html", "body"):
            return
        self.close_to((tag,), frozenset() if tag in SCOPE else SCOPE)

    def is_open(self, tag: str) -> bool:
        node = self.at
        while node is not None:
            if node.tag == tag and node.parent is not None:
                return True
            node = node.parent
        return False

    def handle_data(self, data: str) -> None:
        if not self.noise:
            self.at.children.append(data)


def measure(root: Node) -> list[Node]:
    """Fill in counts, densities and sums, children first; returns the nodes in page order."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in reversed(node.children) if type(c) is Node]
    for node in reversed(order):
        for c in node.children:
            if type(c) is Node:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
            else:
                node.chars += len(c) - c.count(" ") - c.count("\n")
        if node.tag == "a":
            node.link_chars = node.chars
    ratio = root.link_chars / max(1, root.chars)
    for node in reversed(order):
        c, t, lc, lt = (max(1, x) for x in (node.chars, node.tags, node.link_chars, node.link_tags))
        if node.chars:
            base = math.log(c * lc / max(1, node.chars - node.link_chars) + ratio * c + math.e)
            node.density = c / t * max(0.0, math.log(c * t / (lc * lt))) / max(math.log(base), 1e-9) if base > 1.0000001 else c / t
        node.total = sum(k.density for k in node.children if type(k) is Node)
    return order


def has_headline(top: Node) -> bool:
    todo = [top]
    while todo:
        node = todo.pop()
        if node.tag == "h1":
            return True
        todo += [c for c in node.children if type(c) is Node]
    return False


def prune(root: Node) -> None:
    """Cut out the elements named as noise and the forms that do not hold the main text.

    An outermost suspect stays, and those inside it are looked at in its
    place, if it is not made of links, no article or main element beside the
    suspects holds a tenth of its characters, and it has the only headline or
    more text than all that lies outside the suspects (four times as much, if
    the headline is there). A form is a suspect only if made of controls.
    """
    order = measure(root)
    suspects = {n for n in order if n.named or n.tag == "form" and n.chars <= LABEL * n.controls}
    holds: dict[Node, int] = {}  # articles and main elements outside suspects, and their text there
    text = headlines = most = 0

    def words(node: Node) -> int:
        return node.chars - node.link_chars

    def visit(top: Node) -> list[Node]:
        """Count what lies in ``top`` outside suspects; returns the outermost suspects there."""
        nonlocal text, headlines, most
        found, todo, changed = [], [top], {}
        while todo:
            node = todo.pop()
            headlines += node.tag == "h1"
            if node.tag in ("article", "main"):
                changed[node] = words(node)
            inner = [c for c in node.children if type(c) is Node]
            found += [c for c in inner if c in suspects]
            todo += [c for c in inner if c not in suspects]
        for c in found:
            up = c.parent
            while up is not top.parent:
                if up in changed:
                    changed[up] -= words(c)
                up = up.parent
        seen = words(top) - sum(map(words, found))
        text += seen
        up = top.parent
        while up is not None:
            if up in holds:
                changed[up] = holds[up] + seen
            up = up.parent
        holds.update(changed)
        most = max([most, *changed.values()])
        return found

    todo, gone = sorted(visit(root), key=words), set()
    while todo:
        node = todo.pop()  # the longest of those at hand
        wanted = node.chars > 2 * node.link_chars and words(node) > 10 * most
        if wanted and (words(node) > text * (4 if headlines else 1) or not headlines and has_headline(node)):
            suspects.discard(node)
            todo = sorted([*todo, *visit(node)], key=words)
        else:
            gone.add(node)
    for node in {n.parent for n in gone}:
        node.children = [c for c in node.children if c not in gone]
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0


def words_in(node: Node) -> str:
    return " ".join(blocks([node]))


def cut_comments(root: Node) -> None:
    """Cut out what readers wrote, by whole names or from a heading that says so to the next of its level, and boxes made of links whose name has a word for noise.

    A box that has all the text, or the only headline, is no comment.
    """
    order = measure(root)
    headlines = sum(n.tag == "h1" for n in order)
    gone: set[Node] = set()
    for node in order:
        if node.comment and node.chars < root.chars and not (headlines == 1 and has_headline(node)):
            gone.add(node)
        elif node.hinted and node.link_chars * 2 > node.chars:
            gone.add(node)
        elif node.tag in HEADINGS and node.tag != "h1" and 0 < node.chars < 60 and COMMENT_HEADING.fullmatch(words_in(node)):
            after = node.parent.children[node.parent.children.index(node) :]
            end = next((k for k, c in enumerate(after) if k and type(c) is Node and c.tag in HEADINGS and c.tag <= node.tag), len(after))
            rest = [c for c in after[:end] if type(c) is Node]
            if any(c.chars for c in rest[1:]) and sum(c.chars for c in rest) < root.chars:
                gone.update(rest)
                for i in range(node.parent.children.index(node), node.parent.children.index(node) + end):
                    if type(node.parent.children[i]) is str:
                        node.parent.children[i] = " "
    for node in {n.parent for n in gone if n.parent is not None}:
        node.children = [c for c in node.children if c not in gone]
    for node in order:
        node.chars = node.tags = node.link_chars = node.link_tags = 0


def bounding(order: list[Node]) -> Node | None:
    """The article or main element that holds the text: of the articles the one with most of their words, else the main element around them."""
    own = lambda n: n.chars - n.link_chars
    root = order[0]
    found = [n for n in order if n.tag in ("article", "main") and n.chars > 2 * n.link_chars]
    articles = [n for n in found if n.tag == "article" and not any(up.tag == "article" for up in above(n))]
    mains = [n for n in found if n.tag == "main"]
    best, main = max(articles, key=own, default=None), max(mains, key=own, default=None)
    if best is not None and main in above(best) and 2 * own(best) < own(main):
        best = None
    if best is not None and 2 * own(best) < sum(map(own, articles)):
        best = None  # a list of articles
    best = best or main
    return best if best is not None and own(best) >= BOUND * (own(root) - own(best)) and own(best) > 0 else None


def above(node: Node) -> Iterator[Node]:
    while node.parent is not None:
        node = node.parent
        yield node


def chosen(root: Node) -> list[Node]:
    """The subtrees that hold the main text, in page order."""
    order = measure(root)
    bound = bounding(order)
    best = bound or max((n for n in order if n is root or n.tag in HOLDERS), key=lambda n: n.total)  # the outermost of equals
    if best.total <= 0 and bound is None:
        best = root
    path, threshold = {best, root}, best.density
    for node in above(best):
        path.add(node)
        threshold = min(threshold, node.density)
    kept, todo, title, wanted = [], [root], None, not has_headline(best)
    while todo:
        node = todo.pop()
        if node is best:
            if wanted and title is not None and title not in kept:
                kept.append(title)
            kept.append(node)
            wanted = False
        elif wanted and node.tag in HEADINGS and node.chars > 2 * node.link_chars and (node.tag == "h1" or title is None or title.tag != "h1"):
            title = node  # the nearest headline before the text
        elif node in path or wanted and any(type(c) is Node for c in node.children) and has_heading(node) and (bound is not None or not belongs(node, threshold)):
            todo += [c for c in reversed(node.children) if type(c) is Node]
        elif bound is None and (belongs(node, threshold) or node.parent is best.parent and best in kept and ends_text(node)):
            kept.append(node)
    return kept


def belongs(node: Node, threshold: float) -> bool:
    return node.chars > 0 and node.density >= threshold and node.link_chars * 2 < node.chars


def ends_text(node: Node) -> bool:
    """Whether a box after the text holds paragraphs of sentences, and no legal notice."""
    if not node.chars or node.link_chars * 2 >= node.chars or not (node.tag == "p" or any(type(c) is Node and c.tag == "p" for c in node.children)):
        return False
    text = words_in(node)
    return SENTENCE_END.search(text) is not None and not NOT_TEXT.search(text)


def has_heading(top: Node) -> bool:
    todo = [top]
    while todo:
        node = todo.pop()
        if node.tag in HEADINGS:
            return True
        todo += [c for c in node.children if type(c) is Node]
    return False


def blocks(nodes: list[Node]) -> list[str]:
    """The texts of the blocks below ``nodes``, in page order, white space turned into single spaces."""
    out: list[str] = []
    run: list[str] = []

    def flush() -> None:
        if text := SPACE.sub(" ", "".join(run)).strip():
            out.append(text)
        run.clear()

    for top in nodes:
        todo: list = [top]
        while todo:
            x = todo.pop()
            if x is None:
                flush()
            elif type(x) is str:
                run.append(x)
            elif x.tag == "br":
                run.append(" ")
            else:
                block = x.tag in BLOCKS
                if block:
                    flush()
                    todo.append(None)
                todo += reversed(x.children)
        flush()
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    tree = Tree()
    tree.feed(html)
    tree.close()
    if tree.doubts:
        cut_comments(tree.root)
    if tree.suspects:
        prune(tree.root)
    return "\n".join(blocks(chosen(tree.root)))


def extract(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` to ``page_id, url, text, n_chars`` (code points)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in byte_slices(batch.column(2)):
                texts = [main_text(h) for h in batch.column(2).slice(at, n).to_pylist()]
                yield pa.RecordBatch.from_pydict({
                    "page_id": batch.column(0).slice(at, n),
                    "url": batch.column(1).slice(at, n),
                    "text": pa.array(texts, pa.string()),
                    "n_chars": pa.array(map(len, texts), pa.int64()),
                })

    return map_arrow(pages.select(pages["page_id"].cast("long"), pages["url"], pages["html"]), run, SCHEMA)
