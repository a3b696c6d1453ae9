"""A page as a small tree, and the tree as Markdown.

Markup is repaired the way browsers' older cousins do: a block closes an open
paragraph with whatever is inside it, list items, rows and cells close their
predecessors, and stray end tags are ignored. All walks use explicit stacks, so
nesting may be as deep as it likes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote center dd details div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section table ul".split())
#: An opening tag closes an open one of these, unless one of the second lies between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
    "body": ({"head"}, set()),
}
HEAD_ONLY = frozenset("html head title meta link base script style noscript".split())


class Text:
    """A piece of text: ``text``, ``comment`` or ``raw`` (in scripts and styles)."""

    __slots__ = ("kind", "value")

    def __init__(self, value: str, kind: str):
        self.value, self.kind = value, kind


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | Text] = []

    def walk(self) -> Iterator[Node | Text]:
        """All descendants, in document order."""
        todo = self.children[::-1]
        while todo:
            x = todo.pop()
            yield x
            if isinstance(x, Node):
                todo.extend(reversed(x.children))

    def find_all(self, *tags: str) -> list[Node]:
        return [x for x in self.walk() if isinstance(x, Node) and x.tag in tags]

    def text(self, strip: bool = False) -> str:
        """Its text without comments, scripts and styles; ``strip`` drops the
        white space around each piece."""
        own = "raw" if self.tag in ("script", "style") else "text"
        parts = (x.value for x in self.walk() if isinstance(x, Text) and x.kind == own)
        return "".join(p.strip() for p in parts) if strip else "".join(parts)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def _up_to(self, wanted, stops) -> Node | None:
        """The outermost open element of ``wanted`` below the first of ``stops``."""
        found, x = None, self.at
        while x is not None and x.tag not in stops:
            if x.tag in wanted:
                found = x
            x = x.parent
        return found

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "head", "body") and any(isinstance(x, Node) and x.tag == tag for x in self._open()):
            return
        if tag in BLOCK:
            p = self._up_to({"p"}, {"td", "th", "table", "li", "div", "object", "button"})
            if p is not None:
                self.at = p.parent
        if tag in CLOSES:
            wanted, stops = CLOSES[tag]
            old = self._up_to(wanted, stops)
            if old is not None:
                self.at = old.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.at.tag == tag:
            self.at = self.at.parent

    def _open(self) -> Iterator[Node]:
        x = self.at
        while x is not None:
            yield x
            x = x.parent

    def handle_endtag(self, tag: str) -> None:
        for x in self._open():
            if x.tag == tag:
                self.at = x.parent
                return
            if x.tag in ("td", "th", "table") and tag not in ("td", "th", "tr", "tbody", "thead", "tfoot", "table", "body", "html"):
                return

    def _add(self, value: str, kind: str) -> None:
        last = self.at.children[-1] if self.at.children else None
        if isinstance(last, Text) and last.kind == kind != "comment":
            last.value += value
        else:
            self.at.children.append(Text(value, kind))

    def handle_data(self, data: str) -> None:
        self._add(data, "raw" if self.at.tag in ("script", "style") else "text")

    def handle_comment(self, data: str) -> None:
        self._add(data, "comment")


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


# What is dropped when boilerplate is to be removed.
REMOVE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "noscript", "iframe", "form", "button", "input", "select", "textarea", "meta", "link"]
REMOVE_CLASSES = ["nav", "menu", "sidebar", "footer", "header", "toc", "table-of-contents", "breadcrumb", "pagination", "advertisement", "ad-", "copyright"]
REMOVE_IDS = ["toc", "table-of-contents", "contents", "menu", "sidebar"]


def drop_boilerplate(root: Node) -> None:
    """Take out comments and whatever tags, classes or ids mark as furniture."""
    classes, ids = (re.compile("|".join(x), re.IGNORECASE) for x in (REMOVE_CLASSES, REMOVE_IDS))
    todo = [root]
    while todo:
        node = todo.pop()
        kept: list[Node | Text] = []
        for x in node.children:
            if isinstance(x, Text):
                if x.kind != "comment":
                    kept.append(x)
            elif x.tag not in REMOVE_TAGS and not any(map(classes.search, x.attrs.get("class", "").split())) and not ids.search(x.attrs.get("id", "")):
                kept.append(x)
                todo.append(x)
        node.children = kept


def title_of(root: Node) -> str:
    """The title element's text if it is one piece, else the first h1, else empty."""
    title = next(iter(root.find_all("title")), None)
    if title is not None and len(title.children) == 1 and isinstance(title.children[0], Text) and title.children[0].value:
        return title.children[0].value.strip()
    h1 = next(iter(root.find_all("h1")), None)
    return h1.text(strip=True) if h1 is not None else ""


def _all_rows(table: Node) -> list[list[str]]:
    """Cell texts of all rows below, those of nested tables too, from one walk: rows hold stretches of the cells below, cells
    stretches of the pieces of text below, so each cell's text is made once."""
    pieces, cells, rows = [], [], []
    at = 0
    todo: list = table.children[::-1]
    while todo:
        x = todo.pop()
        if isinstance(x, Text):
            if x.kind == "text" and (piece := x.value.strip()):
                pieces.append(piece)
                at += len(piece)
        elif isinstance(x, Node):
            if x.tag in ("tr", "td", "th"):
                span = [at, at] if x.tag != "tr" else [len(cells), len(cells)]
                (rows if x.tag == "tr" else cells).append(span)
                todo.append((x.tag, span))
            todo.extend(reversed(x.children))
        else:  # what is below it has been passed
            tag, span = x
            span[1] = len(cells) if tag == "tr" else at
    whole = "".join(pieces)
    texts = [whole[a:b].replace("|", "\\|") for a, b in cells]
    return [texts[a:b] for a, b in rows if b > a]


def table_rows(table: Node, nested: bool) -> list[list[str]]:
    """Cell texts by row. Nested tables' rows and cells count again for each
    table around them if ``nested``; else they stay in their own cell's text."""
    if nested:
        return _all_rows(table)

    def own(node: Node, tags: tuple[str, ...], stop: str) -> list[Node]:
        out, todo = [], node.children[::-1]
        while todo:
            x = todo.pop()
            if isinstance(x, Node):
                if x.tag in tags:
                    out.append(x)
                elif x.tag != stop:
                    todo.extend(reversed(x.children))
        return out

    cells = ([c.text(strip=True).replace("|", "\\|") for c in own(r, ("th", "td"), "table")] for r in own(table, ("tr",), "table"))
    return [c for c in cells if c]


def table_to_markdown(table: Node, nested: bool = True) -> str:
    rows = table_rows(table, nested)
    if not rows:
        return ""
    width = max(map(len, rows))
    line = lambda cells: f"| {' | '.join(cells)} |"
    head, *body = ([*r, *[""] * (width - len(r))] for r in rows)
    return "\n".join([line(head), line(["---"] * width), *map(line, body)])


def to_markdown(root: Node, keep_links: bool = False, nested_tables: bool = True) -> tuple[str, list[str]]:
    """The body as Markdown lines, and its headings. Text that is not in a block
    of its own becomes a line for each piece, comments included."""
    body = next(iter(root.find_all("body")), root)
    lines: list[str] = []
    headings: list[str] = []
    todo: list[Node | Text] = [body]
    while todo:
        x = todo.pop()
        if isinstance(x, Text):
            if piece := x.value.strip():
                lines.append(piece)
        elif re.fullmatch("h[1-6]", x.tag):
            if text := x.text(strip=True):
                headings.append(text)
                lines += ["", f"{'#' * int(x.tag[1])} {text}", ""]
        elif x.tag == "pre":
            lines += ["", "```", x.text().rstrip(), "```", ""]
        elif x.tag == "code":
            lines.append(f"`{x.text()}`")
        elif x.tag == "table":
            if text := table_to_markdown(x, nested_tables):
                lines += ["", text, ""]
        elif x.tag in ("ul", "ol"):
            items = [c for c in x.children if isinstance(c, Node) and c.tag == "li"]
            lines += ["", *(f"{f'{n}.' if x.tag == 'ol' else '-'} {li.text(strip=True)}" for n, li in enumerate(items, 1)), ""]
        elif x.tag == "p":
            if text := x.text(strip=True):
                lines += ["", text, ""]
        elif x.tag == "br":
            lines.append("")
        elif x.tag == "a" and keep_links and x.attrs.get("href") and x.text(strip=True):
            lines.append(f"[{x.text(strip=True)}]({x.attrs['href']})")
        else:
            todo.extend(reversed(x.children))
    return "\n".join(lines), headings


def tidy(text: str) -> str:
    """At most one empty line in a row, nothing at line ends or around the text."""
    text = re.sub(r"\n{3,}", "\n\n", text)
    return "\n".join(line.rstrip() for line in text.split("\n")).strip()
