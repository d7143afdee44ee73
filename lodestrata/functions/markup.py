"""HTML as Markdown, by a fold of the element tree."""

from __future__ import annotations

import re
from html.parser import HTMLParser

#: Elements that go with all they hold, elements without an end, and those that stand in lines of their own.
DROPPED = frozenset(("script", "style", "noscript", "nav", "footer", "header", "aside", "iframe"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OWN_LINES = frozenset("address article blockquote body center dd div dl dt fieldset figcaption figure form h1 h2 h3 h4 h5 h6 hr html li main ol p pre section table ul".split())
#: What an opening element closes, up to the nearest element that holds such elements.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), **{t: ("p",) for t in OWN_LINES - {"html", "body", "li", "dd", "dt"}}}
HOLDS = frozenset("article blockquote body div dl html main ol section table td th ul".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "strike": "~~"}
SPACE = re.compile(r"\s+")


class Element:
    __slots__ = ("tag", "attrs", "parent", "inner")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None):
        self.tag, self.attrs, self.parent, self.inner = tag, attrs, parent, []  # elements and strings

    def first(self, tag: str) -> Element | None:
        todo: list = [self]
        while todo:
            x = todo.pop()
            if type(x) is Element:
                if x.tag == tag:
                    return x
                todo += reversed(x.inner)
        return None

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if type(x) is str:
                out.append(x)
            else:
                todo += reversed(x.inner)
        return SPACE.sub(" ", "".join(out)).strip()


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Element("html", {}, None)

    def close(self, *_: object) -> None:
        super().close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        for old in CLOSES.get(tag, ()):
            self._close(old, HOLDS - ({"td", "th"} if tag == "tr" else set()))
        element = Element(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inner.append(element)
        if tag not in VOID:
            self.at = element

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag not in ("p", "div", "li"):
            self._close(tag, frozenset())

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, HOLDS if tag not in HOLDS else frozenset())

    def _close(self, tag: str, fences: frozenset[str] | set[str]) -> None:
        node = self.at
        while node.parent is not None:
            if node.tag == tag:
                self.at = node.parent
                return
            if node.tag in fences:
                return
            node = node.parent

    def handle_data(self, data: str) -> None:
        self.at.inner.append(data)


#: An ampersand that begins no character reference with a semicolon.
_OPEN = re.compile(r"&(?!(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);)")


def tree(html: str, closed: bool = False) -> Element:
    """The element tree; unclosed elements are closed by the rules of HTML, comments are left out.

    With ``closed``, only character references that end in a semicolon are
    decoded, so that the rest of one that was cut off stays as it is.
    """
    builder = _Builder()
    builder.feed(_OPEN.sub("&amp;", html) if closed else html)
    builder.close()
    return builder.root


def _without_dropped(root: Element) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        node.inner = [x for x in node.inner if type(x) is str or x.tag not in DROPPED]
        todo += [x for x in node.inner if type(x) is Element]


def _escaped(text: str) -> str:
    return text.replace("*", "\\*").replace("_", "\\_")


def _joined(parts: list[str]) -> str:
    """Parts one after another, without a space at the start of a line or after another one."""
    out: list[str] = []
    for x in parts:
        if x and x[0] == " " and not x.startswith("  \n") and (not out or out[-1][-1] in " \n"):
            x = x.lstrip(" ")
        if x:
            out.append(x)
    return "".join(out)


def _around(mark: str, text: str) -> str:
    """A mark set around words, spaces outside of it."""
    bare = text.strip()
    if not bare:
        return " " if text else ""
    return text[: len(text) - len(text.lstrip())] + mark + bare + mark + text[len(text.rstrip()) :]


def _indented(text: str, by: str) -> str:
    return "\n".join(by + line if line else line for line in text.split("\n"))


def _table(rows: list[list[str]]) -> str:
    wide = max(map(len, rows))
    lines = ["| " + " | ".join([*r, *[""] * (wide - len(r))]) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * wide) + " |", *lines[1:]])


def _folded(node: Element, parts: list[str], inside: str) -> str:
    """Markdown of an element from that of its parts; ``inside`` is the nearest list or "pre" around it."""
    tag, text = node.tag, "".join(parts) if node.tag not in OWN_LINES or node.tag == "pre" else _joined(parts)
    if tag in MARKS:
        return _around(MARKS[tag], text)
    if tag == "code" and inside != "pre":
        return _around("`", text)
    if tag == "a":
        href = node.attrs.get("href", "")
        if not href or not text.strip():
            return text
        title = node.attrs.get("title", "")
        return text[: len(text) - len(text.lstrip())] + f"[{text.strip()}]({href}" + (f' "{title}"' if title else "") + ")" + text[len(text.rstrip()) :]
    if tag == "img":
        alt, src, title = (node.attrs.get(k, "") for k in ("alt", "src", "title"))
        return f"![{alt}]({src}" + (f' "{title}"' if title else "") + ")"
    if tag == "br":
        return "  \n"
    if tag == "hr":
        return "\n\n---\n\n"
    if tag == "pre":
        return "\n\n```\n" + text.strip("\n") + "\n```\n\n" if text.strip() else ""
    if tag[0] == "h" and tag[1:] in ("1", "2", "3", "4", "5", "6"):
        line = SPACE.sub(" ", text).strip()
        return f"\n\n{'#' * int(tag[1])} {line}\n\n" if line else ""
    if tag == "blockquote":
        body = _tidy(text)
        return "\n\n" + "\n".join("> " + x if x else ">" for x in body.split("\n")) + "\n\n" if body else ""
    if tag == "li":
        ordered = node.parent is not None and node.parent.tag == "ol"
        before = sum(type(x) is Element and x.tag == "li" for x in node.parent.inner[: node.parent.inner.index(node)]) if ordered else 0
        start = node.parent.attrs.get("start", "1") if ordered else "1"
        mark = f"{(int(start) if start.isdigit() else 1) + before}. " if ordered else "- "
        return mark + _indented(_tidy(text), " " * len(mark)).lstrip() + "\n"
    if tag in ("ul", "ol"):
        return "\n" + text.rstrip() + "\n" if inside == "list" else "\n\n" + text.strip("\n") + "\n\n"
    if tag in ("td", "th"):
        return SPACE.sub(" ", text).strip().replace("|", "\\|") + "\0"
    if tag == "tr":
        return text + "\1"
    if tag == "table":
        rows = [r.split("\0")[:-1] for r in text.split("\1") if "\0" in r]
        return "\n\n" + _table(rows) + "\n\n" if rows else text
    if tag in OWN_LINES:
        return f"\n\n{text.strip()}\n\n" if text.strip() else ""
    return text


def _tidy(text: str) -> str:
    """Lines without a space at the end but the two that break a line, and no more than one blank line in a row."""
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<![ ]) \n|\n +(?=\n)", "\n", text)).strip()


def fold(root: Element) -> str:
    """Markdown of a tree, children first; a stack instead of recursion, so depth does not matter."""
    done: list[list[str]] = [[]]
    todo: list[tuple[object, str, bool]] = [(root, "", False)]
    while todo:
        x, inside, ready = todo.pop()
        if type(x) is str:
            if inside == "pre":
                done[-1].append(x)
            elif inside == "code":
                done[-1].append(SPACE.sub(" ", x))
            elif inside == "table" and not x.strip():
                continue
            else:
                text = _escaped(SPACE.sub(" ", x.replace("\0", "").replace("\1", "")))
                done[-1].append(text)
        elif ready:
            parts = done.pop()
            done[-1].append(_folded(x, parts, inside))
        else:
            done.append([])
            todo.append((x, inside, True))
            within = "pre" if x.tag == "pre" or inside == "pre" else "code" if x.tag == "code" else "list" if x.tag in ("ul", "ol", "li") else "table" if x.tag in ("table", "tr", "thead", "tbody", "tfoot") else "" if x.tag in ("td", "th") else inside
            todo += [(y, within, False) for y in reversed(x.inner) if not (x.tag in ("ul", "ol") and type(y) is str and not y.strip())]
    return "".join(done[0])


def html_markdown(html: str | None, name: str, closed: bool = False) -> str:
    """A page as Markdown: its article, main or body element without menus and the like, a title in front.

    The title is the first h1, else the title element, else ``name``; it is
    put in front unless the text begins with one of its level. ``closed`` is
    that of ``tree``.
    """
    root = tree(html or "", closed)
    _without_dropped(root)
    container = next((x for x in map(root.first, ("article", "main", "body")) if x is not None), root)
    text = _tidy(fold(container))
    if text.startswith("# "):
        return text
    found = (root.first("h1"), root.first("title"))
    title = next((t for x in found if x is not None and (t := x.text())), name)
    return f"# {title}\n\n{text}"
