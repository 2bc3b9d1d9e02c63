"""HTML extraction by layout-aware rendering (operator 7).

A page becomes a tree: start tags close what HTML says they imply (a paragraph before a block, a list
item before the next, cells and rows before theirs), void elements take no content, and end tags
close up to their match or are ignored. Rendering walks the tree without recursion and emits all
visible text: white space collapses except in preformatted text, blocks stand on lines of their own,
with an empty line around those that have margins, list items carry bullets or numbers and are
indented by depth, and the cells of a table are aligned in columns.

Hidden: head, script, style, template, noscript and the like, the hidden attribute, hidden inputs,
`display: none` and `visibility: hidden` in a style attribute, or in a style sheet for a single tag,
class or id. Columns wider than WIDE are not padded, so a page's text stays linear in its size.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotolith.llm.bpe import slices
from fotolith.llm.shared import bounded_batches

WIDE = 80
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title meta link script style template noscript iframe object svg math datalist audio video canvas".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset menu".split())
BLOCK = SPACED | frozenset("html body address article aside details dialog dd div dt footer form header hgroup li main nav section summary tr caption figcaption legend option center thead tbody tfoot".split())
#: What a start tag closes, up to the nearest of the limits.
_CELL, _ROW, _PART = frozenset(("td", "th")), frozenset(("tr",)), frozenset(("thead", "tbody", "tfoot", "caption", "colgroup"))
_TABLE, _LIST = frozenset(("table",)), frozenset(("ul", "ol", "menu"))
IMPLIED = {
    "li": (frozenset(("li",)), _LIST), "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (_CELL, _TABLE | _ROW), "th": (_CELL, _TABLE | _ROW), "tr": (_CELL | _ROW, _TABLE),
    "thead": (_CELL | _ROW | _PART, _TABLE), "tbody": (_CELL | _ROW | _PART, _TABLE), "tfoot": (_CELL | _ROW | _PART, _TABLE),
    "option": (frozenset(("option",)), frozenset(("select",))), "optgroup": (frozenset(("option", "optgroup")), frozenset(("select",))),
    "body": (frozenset(("head",)), frozenset()),
}
_BUTTON = frozenset("table td th button object caption html".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*+>?|<\?[^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)|<", re.S)
INSIDE = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)", re.I)
RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
SIMPLE = re.compile(r"[.#]?[A-Za-z][\w-]*")
SPACE = re.compile(r"[ \t\n\f\r]+")


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def tree(page: str) -> tuple[Node, set[str]]:
    """The page's tree and the selectors that its style sheets hide."""
    root, unseen = Node("#root"), set()
    stack, at, n = [root], 0, len(page)
    open_: dict[str, int] = {}
    quoted = True  # until a tag's quotes run to the end of the page: then tags end at the next >

    def close(k: int) -> None:
        while len(stack) > k:
            tag = stack.pop().tag
            open_[tag] -= 1

    def text(part: str) -> None:
        if part:
            stack[-1].children.append(html.unescape(part) if "&" in part else part)

    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        tag = m[2]
        if tag is None:
            if m[0] == "<":
                text("<")
            continue
        tag = tag.lower()
        inside = INSIDE.match(page, at) if quoted else None
        if inside is None:
            quoted, end = False, page.find(">", at)
            if end < 0:
                break
        begin, at = at, inside.end() if inside else end + 1
        if m[1]:
            if open_.get(tag):
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag == "table" and tag not in ("html", "body"):
                        break
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            continue
        if tag in IMPLIED:
            closes, limits = IMPLIED[tag]
            if any(open_.get(t) for t in closes):
                lowest = None
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].tag in limits:
                        break
                    if stack[k].tag in closes:
                        lowest = k
                if lowest is not None:
                    close(lowest)
        if tag in BLOCK and open_.get("p"):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _BUTTON:
                    break
                if stack[k].tag == "p":
                    close(k)
                    break
        node = Node(tag, attributes(page[begin : at - 1]) if at - begin > 2 else None)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            body = page[at : end.start() if end else n]
            at = end.end() if end else n
            if tag == "style":
                for who, rules in RULE.findall(body):
                    if UNSEEN.search(rules):
                        unseen |= {s for x in who.split(",") if SIMPLE.fullmatch(s := x.strip())}
            elif tag == "textarea":
                node.children.append(html.unescape(body))
        elif tag not in VOID:
            stack.append(node)
            open_[tag] = open_.get(tag, 0) + 1
    return root, unseen


def visible(node: Node, unseen: set[str]) -> bool:
    if node.tag in HIDDEN:
        return False
    a = node.attributes
    if unseen and (node.tag in unseen or "#" + a.get("id", "") in unseen or any("." + c in unseen for c in a.get("class", "").split())):
        return False
    if not a:
        return True
    return not ("hidden" in a or UNSEEN.search(a.get("style", "")) or (node.tag == "input" and a.get("type", "").lower() == "hidden"))


class Lines:
    """Text being laid out: finished lines, and one being written."""

    def __init__(self):
        self.done: list[str] = []
        self.line: list[str] = []
        self.gap = False  # a collapsed space is due
        self.prefix = ""  # bullet of the item that begins
        self.indent = 0

    def write(self, text: str, pre: bool) -> None:
        if pre:
            first, *rest = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.line.append(first)
            for part in rest:
                self.end(True)
                self.line.append(part)
            return
        parts = SPACE.sub(" ", text)
        if parts.startswith(" "):
            self.gap, parts = True, parts[1:]
        if not parts:
            return
        if self.gap and self.line and not self.line[-1].endswith(" "):
            self.line.append(" ")
        self.gap = parts.endswith(" ")
        self.line.append(parts[:-1] if self.gap else parts)

    def end(self, empty: bool = False) -> None:
        text = "".join(self.line).rstrip(" ")
        self.line, self.gap = [], False
        if text or empty:
            if text or self.prefix:
                lead = "  " * self.indent
                text = (lead[: len(lead) - len(self.prefix)] + self.prefix + text) if self.prefix else lead + text
                self.prefix = ""
            self.done.append(text)

    def space(self) -> None:
        self.end()
        if self.done and self.done[-1]:
            self.done.append("")

    def text(self) -> str:
        self.end()
        return "\n".join(self.done).strip("\n")


def aligned(rows: list[list[str]]) -> list[str]:
    """Lines of a table: each cell starts where its column starts, where columns aren't too wide."""
    width: list[int] = []
    for row in rows:
        for k, cell in enumerate(row):
            if k == len(width):
                width.append(0)
            width[k] = max(width[k], len(cell))
    return [" | ".join(c.ljust(width[k]) if width[k] <= WIDE and k < len(row) - 1 else c for k, c in enumerate(row)) for row in rows if any(row)]


def render(page: str) -> str:
    """All visible text of a page."""
    root, unseen = tree(page)
    out = Lines()
    lists: list[list] = []  # per open list: number of the next item, or None for bullets
    tables: list[tuple[Lines, list[list[str]]]] = []
    cells: list[Lines] = []
    pre = 0
    work: list = [(root, True)]
    while work:
        node, enter = work.pop()
        if isinstance(node, str):
            out.write(node, pre > 0)
            continue
        tag = node.tag
        if enter:
            if not visible(node, unseen):
                continue
            if tag == "br":
                out.end(True)
                continue
            if tag == "table":
                out.space()
                tables.append((out, []))
                out = Lines()
            elif tag == "tr" and tables:
                tables[-1][1].append([])
            elif tag in _CELL and tables:
                if not tables[-1][1]:
                    tables[-1][1].append([])
                cells.append(out)
                out = Lines()
            elif tag in SPACED and not (lists and tag in _LIST):
                out.space()
            elif tag in BLOCK:
                out.end()
            if tag in _LIST:
                out.end()
                start = node.attributes.get("start", "")
                lists.append([int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1] if tag == "ol" else [None])
                out.indent += 1
            elif tag == "li" and lists:
                item = lists[-1]
                out.prefix = "- " if item[0] is None else f"{item[0]}. "
                if item[0] is not None:
                    item[0] += 1
            elif tag == "dd":
                out.indent += 1
            elif tag == "pre":
                pre += 1
            elif tag in ("img", "input"):
                label = node.attributes.get("alt" if tag == "img" else "value", "")
                if label:
                    out.write(label, False)
            if tag not in VOID:
                work.append((node, False))
                work += [(c, True) for c in reversed(node.children)]
            continue
        if tag in _CELL and tables and cells:
            text = SPACE.sub(" ", out.text())
            out = cells.pop()
            tables[-1][1][-1].append(text)
            try:
                span = min(max(int(node.attributes.get("colspan", "1")), 1), 100)
            except ValueError:
                span = 1
            tables[-1][1][-1] += [""] * (span - 1)
        elif tag == "table":
            inner, (out, rows) = out.text(), tables.pop()
            for line in (inner.split("\n") if inner else []) + aligned(rows):  # captions and strays first
                out.line = [line]
                out.end()
            out.space()
        elif tag in _LIST:
            out.end()
            out.prefix = ""
            lists.pop()
            out.indent -= 1
            if not lists:
                out.space()
        elif tag == "dd":
            out.end()
            out.indent -= 1
        elif tag == "pre":
            pre -= 1
            out.space()
        elif tag in SPACED:
            out.space()
        elif tag in BLOCK:
            out.end()
    return out.text()


def page_text(df: DataFrame, column: str = "html", key: str = "page_id") -> DataFrame:
    """key and `text`, the visible text of each page. Null and empty pages give an empty text. Rows
    are kept one for one; one narrow pass, a slice of pages in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "html"):
            texts = [render(p) if p else "" for p in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(texts, pa.string())], ["key", "text"])

    bounded_batches(df)
    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(column).alias("html")).mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
