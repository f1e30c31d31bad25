"""Visible text of HTML pages, laid out as a browser would stack it.

A page is cut into tags and text, built into a tree (with the tags that HTML lets authors leave out),
rid of what is not shown, and rendered: blocks on lines of their own with blank lines where margins
are, list items with bullets or numbers, table cells in aligned columns, preformatted text as it is.

Not shown: head, scripts, styles, templates, noscript; hidden attributes; what inline styles and style elements give
display:none or visibility:hidden; closed dialogs; all but the summary of closed details. Of style sheets, rules for
screens count (not those for print, nor those that ask for a width), with selectors of tags, classes, ids, descendants
and children; the more specific rule wins, then the later one, important ones first. Visibility is inherited, so
a visible child of a hidden element is shown.

Null html gives null text, an empty page an empty text. Pages are rendered one by one in the tasks
that read them; nothing moves, so repeated rows and hot hosts cost what they weigh.
"""

from __future__ import annotations

import html
import re
import sys
import textwrap
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructType

# Fixed values of the HTML standard: element names by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript plaintext script style template textarea title xmp".split())
HIDDEN = frozenset("area base datalist head iframe link meta noembed noframes noscript param script source style template title track".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer"
    " form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section select"
    " summary table tbody td textarea tfoot th thead tr ul xmp".split()
)
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir xmp".split())
ENDS_P = BLOCK - frozenset("body caption dd dt html legend li optgroup option select tbody td textarea tfoot th thead tr".split())
# A start tag closes open elements of these names, up to an element of the second set.
LISTS, TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
CLOSES = {
    "li": (frozenset(["li"]), LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "caption", "colgroup"]), TABLE),
    "td": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "th": (frozenset(["td", "th"]), frozenset(["table", "tr"])),
    "tbody": (frozenset("tbody thead tfoot caption colgroup".split()), TABLE),
    "thead": (frozenset("tbody thead tfoot caption colgroup".split()), TABLE),
    "tfoot": (frozenset("tbody thead tfoot caption colgroup".split()), TABLE),
    "body": (frozenset(["head"]), frozenset()),
}
IN_HEAD = frozenset("base link meta noscript script style template title".split())
WIDEST = 40  # longer lines of a table's cells are wrapped, so that columns after them stay in place
FRAMES = 4  # calls in Python by level of nesting

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|</([a-zA-Z][^\s/>]*)[^>]*>"
    r"|<([a-zA-Z][^\s/>]*)((?>[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
DECLARATION = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
COMPOUND = re.compile(r"([a-zA-Z][\w-]*|\*)?((?:[.#][\w-]+)*)$")
COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("children", "marks", "style", "tag")

    def __init__(self, tag: str, marks: str = ""):
        self.tag, self.marks, self.children = tag, marks, []
        self.style: dict[str, str] | None = None

    def attributes(self) -> dict[str, str]:
        if not self.marks:
            return {}
        found = ((m[0].lower(), html.unescape(m[1] or m[2] or m[3])) for m in ATTRIBUTE.findall(self.marks))
        return dict(reversed(list(found)))


def parse(page: str) -> tuple[Node, list[str], int]:
    """The tree below html, the contents of the style elements, and how deep elements nest."""
    root = Node("html")
    stack, styles, at, deepest = [root], [], 0, 0
    seen = set()  # tags that were ever opened

    def close(names: frozenset, until: frozenset) -> None:
        if seen.isdisjoint(names):
            return
        for depth in range(len(stack) - 1, 0, -1):
            if stack[depth].tag in names:
                del stack[depth:]
                return
            if stack[depth].tag in until:
                return

    def open_(tag: str, marks: str = "") -> Node:
        nonlocal deepest
        node = Node(tag, marks)
        stack[-1].children.append(node)
        stack.append(node)
        seen.add(tag)
        deepest = max(deepest, len(stack))
        return node

    def text(piece: str) -> None:
        if not piece:
            return
        if stack[-1].tag == "head" and piece.strip():
            stack.pop()
        if "&" in piece:
            piece = html.unescape(piece)
        stack[-1].children.append(piece)

    def start(tag: str, marks: str) -> None:
        if tag == "html":
            return
        if stack[-1].tag == "head" and tag not in IN_HEAD:
            stack.pop()
        if tag in ENDS_P:
            close(frozenset(["p"]), frozenset(["table", "td", "th", "button", "li", "div"]))
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag in ("tr", "td", "th"):
            if tag != "tr" and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
                open_("tr")
            elif tag == "tr" and stack[-1].tag in ("td", "th"):
                close(frozenset(["tr"]), TABLE)
        if tag in VOID:
            stack[-1].children.append(Node(tag, marks))
        else:
            open_(tag, marks)

    def end(tag: str) -> None:
        if tag == "br":
            stack[-1].children.append(Node("br"))
            return
        for depth in range(len(stack) - 1 if tag in seen else 0, 0, -1):
            here = stack[depth].tag
            if here == tag:
                del stack[depth:]
                return
            # A block or a cell is not closed by the end of something inline around it, nor a table from inside.
            if (here in BLOCK and tag not in BLOCK) or (here == "table" and tag != "table" and tag not in ("body", "html")):
                return
        if tag == "p":
            stack[-1].children.append(Node("p"))

    while at < len(page):
        token = TOKEN.search(page, at)
        if token is None:
            text(page[at:])
            break
        text(page[at : token.start()])
        at = token.end()
        if token[1]:
            end(token[1].lower())
            continue
        tag = (token[2] or token[4] or "").lower()
        if not tag:
            continue
        start(tag, token[3] or token[5] or "")
        if tag in RAW:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            piece = page[at : stop.start() if stop else len(page)]
            at = stop.end() if stop else len(page)
            if tag == "style":
                styles.append(piece)
            elif tag in ("textarea", "xmp", "plaintext"):
                text(piece)
            if stack[-1].tag == tag:
                stack.pop()
    return root, styles, deepest


def blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """What stands before each outer pair of braces, and what is in it."""
    depth, begin, head = 0, 0, ""
    for mark in re.finditer(r"[{};]", sheet):
        if mark[0] == "{":
            if depth == 0:
                head, begin = sheet[begin : mark.start()].strip(), mark.end()
            depth += 1
        elif mark[0] == "}":
            depth -= depth > 0
            if depth == 0:
                yield head, sheet[begin : mark.start()]
                head, begin = "", mark.end()
        elif depth == 0:  # a rule without braces, as an import
            begin = mark.end()
    if depth:
        yield head, sheet[begin:]


def on_screens(query: str) -> bool:
    """Whether some part of a media query holds for every screen."""
    parts = (part.strip().removeprefix("only ").strip() for part in query.lower().split(","))
    return any(part in ("", "all", "screen", "not print") for part in parts)


class Rules:
    """The rules of style sheets about display and visibility, by the last part of their selectors."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[tuple[str, str], list] = {}
        self.count = 0
        for sheet in sheets:
            self.add(COMMENT.sub(" ", sheet))

    def add(self, sheet: str) -> None:
        for head, body in blocks(sheet):
            name, _, query = head.partition(" ")
            if head.startswith("@"):
                if name.lower() == "@supports" or (name.lower().startswith("@media") and on_screens((head + " ")[6:].strip())):
                    self.add(body)
                continue
            values = [(m[1].lower(), m[2].lower(), bool(m[3])) for m in DECLARATION.finditer(body)]
            for selector in head.split(",") if values else ():
                parts = self.parts(selector)
                if parts:
                    self.keep(parts, values)

    @staticmethod
    def parts(selector: str) -> list[tuple] | None:
        """(how it stands to the next, tag, classes, ids) from the last part to the first; None for selectors that
        say more."""
        found, child = [], False
        for word in reversed(re.sub(r"\s*>\s*", " > ", selector.strip()).split()):
            if word == ">":
                child = True
                continue
            match = COMPOUND.match(word)
            if not match:
                return None
            names = re.findall(r"([.#])([\w-]+)", match[2])
            tag = (match[1] or "").lower().replace("*", "")
            found.append((child, tag, {n for k, n in names if k == "."}, {n for k, n in names if k == "#"}))
            child = False
        return found if not child else None

    def keep(self, parts: list[tuple], values: list[tuple]) -> None:
        weight = (sum(len(p[3]) for p in parts), sum(len(p[2]) for p in parts), sum(bool(p[1]) for p in parts))
        _, tag, classes, ids = parts[0]
        key = ("#", min(ids)) if ids else (".", min(classes)) if classes else ("", tag)
        self.count += 1
        self.by_key.setdefault(key, []).append((weight, self.count, parts, values))

    def of(self, node: Node, path: list[Node]) -> dict[str, str]:
        """display and visibility of a node below the path, as far as rules or its style tell."""
        if not node.marks and not self.by_key:
            return {}
        marks = node.attributes()
        found = {}
        if self.by_key:
            names = _names(node, marks)
            keys = [("", ""), ("", node.tag), *((".", c) for c in names[1]), *(("#", i) for i in names[2])]
            for key in keys:
                for weight, order, parts, values in self.by_key.get(key, ()):
                    if _fits(parts[0], names) and self.below(parts, 1, path, len(path) - 1):
                        for name, value, important in values:
                            rank = (important, 0, weight, order)
                            if name not in found or found[name][0] < rank:
                                found[name] = (rank, value)
        if "style" in marks:
            for match in DECLARATION.finditer(COMMENT.sub(" ", marks["style"])):
                rank = (bool(match[3]), 1, (0, 0, 0), match.start())
                name = match[1].lower()
                if name not in found or found[name][0] < rank:
                    found[name] = (rank, match[2].lower())
        style = {name: value for name, (_, value) in found.items()}
        if "display" not in style and ("hidden" in marks or (node.tag == "dialog" and "open" not in marks)):
            style["display"] = "none"
        return style

    def below(self, parts: list[tuple], at: int, path: list[Node], end: int) -> bool:
        """Whether the rest of a selector fits ancestors, the nearest at path[end]."""
        if at == len(parts):
            return True
        last = end - 1 if parts[at][0] else -1
        for i in range(end, last, -1):
            if i >= 0 and _fits(parts[at], _names(path[i], path[i].attributes())) and self.below(parts, at + 1, path, i - 1):
                return True
        return False


def _names(node: Node, marks: dict[str, str]) -> tuple[str, set[str], set[str]]:
    return node.tag, set(marks.get("class", "").split()), {marks["id"]} if marks.get("id") else set()


def _fits(part: tuple, names: tuple) -> bool:
    return (not part[1] or part[1] == names[0]) and part[2] <= names[1] and part[3] <= names[2]


class Page:
    """Renders one tree. Lines grow in `lines`; `line` is the one being filled."""

    def __init__(self, rules: Rules, path: list[Node] | None = None, visible: bool = True):
        self.rules, self.path, self.visible = rules, path or [], visible
        self.lines: list[str] = []
        self.line, self.space = "", False
        self.indent, self.bullet, self.gap = "", "", False

    def style(self, node: Node) -> dict[str, str]:
        """The style of a child of the path's last element."""
        if node.style is None:
            node.style = self.rules.of(node, self.path)
        return node.style

    def shown(self, node: Node) -> bool:
        if node.tag in HIDDEN:
            return False
        if not node.marks and not self.rules.by_key and node.tag != "dialog":
            return True
        return self.style(node).get("display", "none" if node.tag == "dialog" and not node.marks else "") != "none"

    def flush(self) -> None:
        """End the line being filled."""
        if self.line:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            lead = self.indent[: len(self.indent) - len(self.bullet)] + self.bullet if self.bullet else self.indent
            self.lines.append(lead + self.line)
            self.bullet = ""
        self.line, self.space = "", False

    def words(self, text: str) -> None:
        if not self.visible:
            self.space |= bool(self.line)
            return
        parts = SPACES.split(text)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        inner = " ".join(p for p in parts if p).replace("\xa0", " ")
        if inner:
            self.line += (" " if self.space and self.line else "") + inner
            self.space = parts[-1] == ""

    def preformatted(self, text: str) -> None:
        if not self.visible:
            return
        first, *more = text.expandtabs(8).split("\n")
        self.line += first.replace("\xa0", " ")
        for part in more:
            if not self.line and self.lines:
                self.gap = False
                self.lines.append("")
            self.flush()
            self.line = part.replace("\xa0", " ")

    def render(self, node: Node, pre: bool = False) -> None:
        tag = node.tag
        if not self.shown(node):
            return
        if tag == "br":
            if self.line:
                self.flush()
            elif self.lines:
                self.gap = True
            return
        if tag in ("table",):
            self.table(node)
            return
        if tag not in BLOCK:
            self.inside(node, pre)
            return
        self.flush()
        spaced = tag in SPACED and not (tag in LISTS and self.bullet)
        self.gap |= spaced and (tag not in LISTS or not self.indent)
        outer = self.indent
        if tag in ("dd", "blockquote"):
            self.indent += "    " if tag == "dd" else "  "
        if tag in LISTS:
            self.list(node)
        elif tag == "li":
            self.item(node, "- ")
        elif tag == "details" and "open" not in node.attributes():
            outer_visible = self.enter(node)
            for child in node.children:
                if isinstance(child, Node) and child.tag == "summary":
                    self.render(child)
                    break
            self.leave(outer_visible)
        else:
            self.inside(node, pre or tag in ("pre", "textarea", "xmp"))
        self.flush()
        self.gap |= spaced and (tag not in LISTS or not outer)
        self.indent = outer

    def enter(self, node: Node) -> bool:
        """Go below a node; returns what leave() needs to come back."""
        outer, own = self.visible, self.style(node).get("visibility")
        if own and own not in ("inherit", "unset"):
            self.visible = own not in ("hidden", "collapse")
        self.path.append(node)
        return outer

    def leave(self, outer: bool) -> None:
        self.path.pop()
        self.visible = outer

    def inside(self, node: Node, pre: bool) -> None:
        outer = self.enter(node)
        for child in node.children:
            if isinstance(child, Node):
                self.render(child, pre)
            elif pre:
                self.preformatted(child)
            else:
                self.words(child)
        self.leave(outer)

    def item(self, node: Node, bullet: str) -> None:
        outer = self.indent
        self.flush()
        self.indent, self.bullet = outer + " " * len(bullet), bullet
        self.inside(node, False)
        self.flush()
        self.indent, self.bullet = outer, ""

    def list(self, node: Node) -> None:
        marks, outer = node.attributes(), self.enter(node)
        items = [c for c in node.children if isinstance(c, Node) and c.tag == "li" and self.shown(c)]
        step = -1 if "reversed" in marks else 1
        number = _whole(marks.get("start"), len(items) if step < 0 else 1)
        for child in node.children:
            if isinstance(child, str):
                self.words(child)
            elif child.tag != "li":
                self.render(child)
            elif self.shown(child):
                if node.tag != "ol":
                    self.item(child, "- ")
                else:
                    number = _whole(child.attributes().get("value"), number)
                    self.item(child, f"{number}. ")
                    number += step
        self.leave(outer)

    def table(self, node: Node) -> None:
        """Rows with cells in columns; a cell that spans rows or columns stands in the first of them."""
        self.flush()
        self.gap = True
        outer = self.enter(node)
        rows, spans = [], {}
        outside = []
        for row in self.rows(node, outside):
            cells, column = [], 0
            for cell in row.children:
                if not isinstance(cell, Node) or cell.tag not in ("td", "th") or not self.shown(cell):
                    continue
                while spans.get(column, 0) > 0:
                    column += 1
                marks = cell.attributes()
                box = Page(self.rules, self.path, self.visible)
                box.inside(cell, False)
                cells.append((column, box.done()))
                wide = min(max(_whole(marks.get("colspan"), 1), 1), 1000)
                high = min(max(_whole(marks.get("rowspan"), 1), 1), 65_534)
                for c in range(column, column + wide):
                    spans[c] = high
                column += wide
            spans = {c: n - 1 for c, n in spans.items() if n > 1}
            rows.append(cells)
        for piece in outside:
            self.render(piece)
        self.leave(outer)
        self.flush()
        last = max((column for cells in rows for column, _ in cells), default=0)
        rows = [[(column, lines if column == last else _narrow(lines)) for column, lines in cells] for cells in rows]
        widths: dict[int, int] = {}
        for column, lines in (cell for cells in rows for cell in cells):
            widths[column] = max([widths.get(column, 0), *map(len, lines)])
        for cells in rows:
            for i in range(max((len(lines) for _, lines in cells), default=0)):
                line, edge = "", 0
                for column, lines in cells:
                    start = sum(w + 2 for c, w in widths.items() if c < column and w)
                    piece = lines[i] if i < len(lines) else ""
                    if piece:
                        line = line.ljust(start) + ("  " if line and len(line) > start - 2 and edge else "") + piece
                        edge = 1
                self.line = line.rstrip()
                self.flush()
        self.flush()
        self.gap = True

    def rows(self, node: Node, outside: list) -> Iterator[Node]:
        for child in node.children:
            if isinstance(child, str):
                if child.strip():
                    outside.append(_wrapped(child))
            elif child.tag in ("tr", "tbody", "thead", "tfoot"):
                if not self.shown(child):
                    continue
                outer = self.enter(child)
                if child.tag == "tr":
                    yield child
                    inner = (c for c in child.children if (c.strip() if isinstance(c, str) else c.tag not in ("td", "th")))
                    outside += [c if isinstance(c, Node) else _wrapped(c) for c in inner]
                else:
                    yield from self.rows(child, outside)
                self.leave(outer)
            else:
                outside.append(child)

    def done(self) -> list[str]:
        self.flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _narrow(lines: list[str]) -> list[str]:
    """Lines wrapped at spaces to WIDEST characters; only a longer word stays longer."""
    found = []
    for line in lines:
        if len(line) <= WIDEST:
            found.append(line)
            continue
        lead = line[: len(line) - len(line.lstrip())]
        found += textwrap.wrap(line, WIDEST, subsequent_indent=lead, break_long_words=False, break_on_hyphens=False)
    return found


def _wrapped(text: str) -> Node:
    node = Node("div")
    node.children.append(text)
    return node


def _whole(text: str | None, default: int) -> int:
    match = re.match(r"\s*([+-]?\d{1,9})", text or "")
    return int(match[1]) if match else default


def visible_text(page: str) -> str:
    root, styles, deepest = parse(page)
    canvas, before = Page(Rules(styles)), sys.getrecursionlimit()
    sys.setrecursionlimit(max(before, before + FRAMES * deepest))
    try:
        canvas.render(root)
    finally:
        sys.setrecursionlimit(before)
    return "\n".join(canvas.done())


def render_pages(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages without that column, with text, n_chars and n_lines; columns of these names are replaced."""
    added = ["text", "n_chars", "n_lines"]
    names = [c for c in pages.columns if c.lower() not in [column.lower(), *added]]

    def rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [None if x is None else visible_text(x) for x in part[column].to_pylist()]
                chars = [None if x is None else len(x) for x in texts]
                lines = [None if x is None else x.count("\n") + 1 if x else 0 for x in texts]
                new = [pa.array(texts, pa.string()), pa.array(chars, pa.int32()), pa.array(lines, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), *new], [*names, *added])

    kept = pages.select(*names, column)
    schema = StructType([f for f in kept.schema.fields if f.name in names])
    schema = schema.add("text", StringType()).add("n_chars", IntegerType()).add("n_lines", IntegerType())
    return kept.mapInArrow(rendered, schema)
