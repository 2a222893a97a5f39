"""HTML extraction by layout: a tree with implied tags, then all visible text as a browser would space it.

Blocks begin on lines of their own, paragraphs, headings, lists and tables have a blank line around them; list items get
bullets or numbers and are indented by depth; cells of a table are aligned in columns, spans included; preformatted
text keeps its blanks, other runs of blanks are one. Text is hidden in head, script, style, template, noscript and
media elements, under ``hidden``, ``display:none`` or ``visibility:hidden``, in closed dialogs and hidden inputs.

The work is one pass over the pages without a shuffle; a page is parsed by a single possessive pattern, and the tree is
walked without recursion, so depth, broken markup and long pages do no harm. Columns wider than ``PAD`` characters are
not padded beyond it, so that a long cell doesn't blow up its table.

Defined cases: null and empty pages give empty text and a null title; text without tags is its own text; a tag that
never ends is text as far as its attributes go; equal pages give equal texts. Output columns replace input columns of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm._arrow import sliced

PAD = 40
#: As in browsers a quote opens a value only after the name's ``=``; elsewhere it is a character of a name or a bare value.
_NAME, _BARE = r"[^\s/>][^\s/>=]*+", r"[^\s\"'>][^\s>]*+"
_PLAIN = rf"(?:[\s/]++|{_NAME}(?!\s*+=\s*+[\"'])(?:\s*+=\s*+(?:{_BARE})?+)?+)++"
_QUOTED = rf"{_NAME}\s*+=\s*+(?:\"[^\"]*+\"|'[^']*+')"
_TOKEN = re.compile(
    rf"<!--(?:.*?-->|.*)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:{_PLAIN}|{_QUOTED})*+)(>?+)", re.S)
_ATTR = re.compile(rf"({_NAME})(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|({_BARE}))?+)?+")
_BLANKS = re.compile(r"[ \t\n\r\f\v]+")
_NONE = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


VOID = _set("area base br col embed hr img input link meta param source track wbr")
RAW = _set("script style textarea title xmp iframe noembed noframes")
HIDDEN = _set("head script style template noscript iframe noembed noframes object canvas video audio svg datalist title xmp")
SPACED = _set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr fieldset")
BLOCK = SPACED | _set("html body div section article header footer nav main aside address form li dt dd figcaption "
                      "caption legend details summary center dialog option tr td th thead tbody tfoot")
CLOSES_P = BLOCK - _set("html body option tr td th thead tbody tfoot caption")
_ROWS = _set("thead tbody tfoot")
#: An opening tag ends these open elements, up to an element of the second set.
_ENDS = {
    "li": (_set("li"), _set("ul ol")), "dt": (_set("dt dd"), _set("dl")), "dd": (_set("dt dd"), _set("dl")),
    "option": (_set("option"), _set("select")), "tr": (_set("tr td th caption colgroup"), _set("table")),
    "td": (_set("td th caption"), _set("table tr")), "th": (_set("td th caption"), _set("table tr")),
    "thead": (_ROWS | _set("tr td th caption colgroup"), _set("table")),
    "tbody": (_ROWS | _set("tr td th caption colgroup"), _set("table")),
    "tfoot": (_ROWS | _set("tr td th caption colgroup"), _set("table")),
    "body": (_set("head"), _set("html")),
}
#: What may stand in the head; the first other tag, or text, ends it.
_IN_HEAD = _set("base basefont bgsound link meta title style script noscript noframes template")
_P = _set("p")
_SCOPE = _set("table td th caption button object")
_GRID = _ROWS | _set("table tr td th caption")


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs = tag, attrs
        self.children: list[Node | str] = []


def _attrs(text: str) -> dict[str, str]:
    return {n.lower(): unescape(a or b or c or "") for n, a, b, c in _ATTR.findall(text)} if text.strip(" /\n\t\r") else {}


def tree(html: str) -> Node:
    """The tree of a page, with the tags that its markup implies."""
    root = Node("html", {})
    open_ = [root]
    counts: dict[str, int] = {}

    def push(tag: str, attrs: dict[str, str]) -> None:
        node = Node(tag, attrs)
        open_[-1].children.append(node)
        if tag not in VOID:
            open_.append(node)
            counts[tag] = counts.get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        while len(open_) > depth:
            counts[open_.pop().tag] -= 1

    def end(tags: frozenset[str], stop: frozenset[str]) -> None:
        """Close the outermost open element of these tags above the nearest of ``stop``."""
        if not any(counts.get(t) for t in tags):
            return
        found = 0
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag in tags:
                found = k
            elif open_[k].tag in stop:
                break
        if found:
            pop_to(found)

    def end_nearest(tag: str) -> None:
        """Close the nearest open element of this tag, unless a cell or table lies between."""
        stop = frozenset(("table",)) if tag in _GRID else _SCOPE
        for k in range(len(open_) - 1, 0, -1):
            if open_[k].tag == tag:
                return pop_to(k)
            if open_[k].tag in stop:
                return None
        return None

    def write(text: str) -> None:
        if open_[-1].tag == "head" and text.strip(" \t\n\r\f"):
            pop_to(len(open_) - 1)
        open_[-1].children.append(text)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            write(unescape(html[at:]))
            break
        if m.start() > at:
            write(unescape(html[at:m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if not m[4]:
            # The tag never ends; what was read of it is text, and isn't read again.
            write(unescape(m[0]))
            continue
        if m[1]:
            if tag == "br":
                push("br", {})
            elif counts.get(tag):
                end_nearest(tag)
            elif tag == "p":
                push("p", {})
                pop_to(len(open_) - 1)
            continue
        if tag in ("html", "body") and (tag == "html" or counts.get("body")):
            continue
        if open_[-1].tag == "head" and tag not in _IN_HEAD:
            pop_to(len(open_) - 1)
        if tag in CLOSES_P:
            end(_P, _SCOPE)
        if tag in _ENDS:
            end(*_ENDS[tag])
        if tag in ("td", "th") and counts.get("table") and open_[-1].tag in ("table", *_ROWS):
            push("tr", {})
        push(tag, _attrs(m[3]))
        if tag in RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)[^>]*+>?", re.I).search(html, at)
            body = html[at:close.start() if close else size]
            open_[-1].children.append(unescape(body) if tag in ("title", "textarea") else body)
            at = close.end() if close else size
            pop_to(len(open_) - 1)
        elif m[3].rstrip().endswith("/") and tag in ("svg", "path"):
            pop_to(len(open_) - 1)
    return root


def visible(node: Node) -> bool:
    a = node.attrs
    return not (node.tag in HIDDEN or a and (
        "hidden" in a or "style" in a and _NONE.search(a["style"]) or node.tag == "dialog" and "open" not in a
        or node.tag == "input" and a.get("type", "").lower() == "hidden"))


class Page:
    """Lines of a page while it is walked."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.now: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.blank = False
        self.space = False

    def write(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.split("\n")
            self.now.append(first)
            for line in rest:
                self.line(keep=True)
                self.now.append(line)
            return
        text = _BLANKS.sub(" ", text)
        if text[:1] == " ":
            self.space, text = True, text[1:]
        if text:
            if self.space and self.now:
                self.now.append(" ")
            self.space = text[-1] == " "
            self.now.append(text.rstrip(" "))

    def line(self, keep: bool = False) -> None:
        """End the line, if there is one."""
        text = "".join(self.now) if keep else "".join(self.now).rstrip()
        if text.strip() or keep:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.lines.append(("".join(self.indent[:-1] if self.mark else self.indent) + self.mark + text).rstrip())
            self.mark = ""
        self.now, self.space = [], False

    def gap(self) -> None:
        self.line()
        self.blank = True


def rendered(root: Node, flat: bool = False) -> str:
    """Visible text of a tree; ``flat``: of a table's cell, whose inner tables are not aligned."""
    page = Page()
    lists: list[list[int | None]] = []
    pre = 0
    stack: list[tuple[Node | str, bool]] = [(c, False) for c in reversed(root.children)]
    while stack:
        node, closing = stack.pop()
        if isinstance(node, str):
            page.write(node, pre > 0)
            continue
        tag = node.tag
        if closing:
            if tag in ("ul", "ol"):
                lists.pop()
            if tag in ("li", "dd", "blockquote"):
                page.line()
                page.indent.pop()
                page.mark = ""
            pre -= tag == "pre"
            _edge(page, tag, bool(lists))
            continue
        if not visible(node):
            continue
        if tag == "br":
            page.line(keep=bool(page.now))
            continue
        _edge(page, tag, bool(lists))
        if tag == "table" and not flat:
            for line in _aligned(node):
                page.now = [line]
                page.line()
            page.gap()
            continue
        if tag in ("td", "th", "option"):
            page.space = True
        if tag in ("ul", "ol"):
            start = node.attrs.get("start", "1")
            lists.append([int(start) if tag == "ol" and re.fullmatch(r"-?\d{1,9}", start) else 1 if tag == "ol" else None])
        if tag == "li":
            number = lists[-1][0] if lists else None
            page.mark = "- " if number is None else f"{number}. "
            if number is not None:
                lists[-1][0] = number + 1
            page.indent.append("  " if number is None else " " * len(page.mark))
        elif tag in ("dd", "blockquote"):
            page.indent.append("  ")
        pre += tag == "pre"
        if tag == "textarea" or tag == "input" and node.attrs.get("type", "text").lower() in ("submit", "button", "reset"):
            page.write(" " + node.attrs.get("value", "") + " ", False)
        if tag not in VOID:
            stack.append((node, True))
            stack.extend((c, False) for c in reversed(node.children))
    page.line()
    return "\n".join(page.lines)


def _edge(page: Page, tag: str, in_list: bool) -> None:
    if tag in SPACED and not (in_list and tag in ("ul", "ol", "p")):
        page.gap()
    elif tag in BLOCK:
        page.line()


def _span(node: Node, name: str) -> int:
    value = node.attrs.get(name, "1")
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() and len(value) < 6 else 1


def _rows(table: Node) -> tuple[list[Node], list[list[Node]], list[Node | str]]:
    """(captions, rows of cells, what else stands in the table)."""
    captions, rows, rest = [], [], []
    stack: list[Node | str] = list(reversed(table.children))
    while stack:
        node = stack.pop()
        if isinstance(node, str):
            rest += [node] * bool(node.strip())
        elif not visible(node):
            continue
        elif node.tag in _ROWS:
            stack.extend(reversed(node.children))
        elif node.tag == "tr":
            rows.append([c for c in node.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
            rest += [c for c in node.children if not (isinstance(c, Node) and c.tag in ("td", "th")) and (
                isinstance(c, Node) or c.strip())]
        elif node.tag == "caption":
            captions.append(node)
        else:
            rest.append(node)
    return captions, rows, rest


def _aligned(table: Node) -> Iterator[str]:
    """Lines of a table: captions, text that stands outside of cells, rows with their cells in columns."""
    captions, rows, rest = _rows(table)
    for node in captions:
        yield from rendered(node, flat=True).split("\n")
    if rest:
        outside = Node("div", {})
        outside.children = rest
        yield from rendered(outside, flat=True).split("\n")
    grid: list[dict[int, str]] = []
    taken: dict[int, int] = {}  # column: rows it is still covered by a cell from above
    widths: dict[int, int] = {}
    for cells in rows:
        line: dict[int, str] = {}
        column, below = 0, {}
        for cell in cells:
            while taken.get(column, 0) > 0:
                column += 1
            text = _BLANKS.sub(" ", rendered(cell, flat=True)).strip()
            line[column] = text
            across, down = _span(cell, "colspan"), _span(cell, "rowspan")
            if across == 1:
                widths[column] = max(widths.get(column, 0), min(len(text), PAD))
            for k in range(column, column + across):
                if down > 1:
                    below[k] = down - 1
            column += across
        taken = {k: n - 1 for k, n in taken.items() if n > 1} | below
        grid.append(line)
    for line in grid:
        out = ""
        start, place = 0, 0
        for column in sorted(line):
            for k in range(place, column):
                start += widths.get(k, 0) + 2
            out += " " * max(start - len(out), 2 * bool(out)) + line[column]
            place = column
        yield out


def page_text(html: str | None) -> tuple[str | None, str]:
    """(title, visible text)."""
    if not html:
        return None, ""
    root = tree(html)
    title = None
    stack = [root]
    while stack and title is None:
        node = stack.pop()
        if node.tag == "title":
            title = _BLANKS.sub(" ", "".join(c for c in node.children if isinstance(c, str))).strip()
        elif node.tag in ("html", "head"):
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return title, rendered(root)


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """All columns of ``pages`` but the markup, with title and text."""
    own = {"title", "text", "_html"}
    kept = [c for c in pages.columns if c not in own and c != html]
    rows = pages.select(*(F.col(f"`{c}`") for c in kept), F.col(html).cast("string").alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, "_html"):
            found = [page_text(x) for x in part.column("_html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in kept), pa.array([t for t, _ in found], pa.string()),
                 pa.array([t for _, t in found], pa.string())], [*kept, "title", "text"])

    schema = rows.drop("_html").schema.add("title", "string").add("text", "string")
    return rows.mapInArrow(run, schema)
