"""Layout-aware HTML rendering: all visible text, as blocks, lists and aligned tables.

A tokenizer and a tree builder with the implied tags of HTML (an open ``p``
ends where a block begins, ``li``, ``dt``/``dd``, ``option``, rows, cells and
table sections end their like, ``html``/``head``/``body`` may be missing, end
tags without a start are ignored, open elements end with their parent or the
text) give the elements; visibility rules (head, scripts, styles, templates,
``hidden``, ``input type=hidden``, ``display:none`` and ``visibility:hidden``
inline or by simple selectors of the page's own style sheets) say what is
seen; a renderer lays it out: blocks on lines of their own, a blank line
around paragraphs, headings and tables, list items with their bullet or
number and indentation, ``pre`` as it is, table cells in aligned columns.

Work and output grow with the page, whatever its markup: the tree is built and
walked without recursion (but for tables in tables), with the places of open
elements kept by tag. Layout has fixed measures, the same for every page, and
keeps all text: cells are wrapped at ``CELL_WIDTH`` columns, columns are
aligned up to ``TABLE_WIDTH``, indentation stops growing after ``LEVELS``
levels, and tables more than ``TABLE_LEVELS`` deep are laid out as blocks.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
UNSEEN = frozenset("head script style template title noframes noembed iframe datalist audio video canvas object embed link meta base param source track area colgroup col noscript".split())
#: Inside these, elements whose text isn't shown.
ASIDE = {"svg": frozenset("desc metadata defs".split()), "math": frozenset("annotation annotation-xml".split())}
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset menu dir".split())
BLOCKS = SPACED | frozenset("address article aside body center details dialog dd div dt figcaption footer form header hgroup html legend li main nav optgroup option search section summary tr td th thead tbody tfoot caption svg-text".split())
#: Start tags that end an open ``p``.
ENDS_P = BLOCKS - frozenset("body html option optgroup tr td th thead tbody tfoot caption legend".split())
#: Start tag: (open elements that it ends, elements beyond which it doesn't look).
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "caption": ({"colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: End tags don't reach beyond these.
SCOPE = frozenset("table td th caption html template".split())

TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"'][^\s=/>]*)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]*)))?")
RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
SELECTOR = re.compile(r"([a-z][a-z0-9]*)?([.#][\w-]+)?", re.I)
HIDING = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
CELLS = frozenset("table tr thead tbody tfoot td th".split())
CELL_WIDTH, TABLE_WIDTH, LEVELS, TABLE_LEVELS = 100, 240, 32, 8


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]) -> None:
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(source: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, bare in ATTRIBUTE.findall(source):
        found.setdefault(name.lower(), html.unescape(double or single or bare))
    return found


class Stack(list):
    """Open elements, with the places of each tag."""

    def __init__(self, root: Node) -> None:
        super().__init__([root])
        self.places: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.places.setdefault(node.tag, []).append(len(self))
        self.append(node)

    def cut(self, start: int) -> None:
        """Ends the elements from ``start``."""
        for node in self[start:]:
            self.places[node.tag].pop()
        del self[start:]

    def last(self, tags: Iterable[str]) -> int:
        """Place of the innermost open element of ``tags``; 0 for none."""
        return max((own[-1] for tag in tags if (own := self.places.get(tag))), default=0)

    def close(self, tags: Iterable[str], limits: Iterable[str]) -> None:
        """Ends the outermost open element of ``tags`` this side of ``limits``."""
        limit, found = self.last(limits), len(self)
        for tag in tags:
            own = self.places.get(tag, ())
            at = bisect_right(own, limit)
            if at < len(own):
                found = min(found, own[at])
        self.cut(found)


def parse(source: str) -> tuple[Node, list[str]]:
    """The tree of a page and its style sheets."""
    root, styles = Node("html", {}), []
    stack = Stack(root)
    at, size = 0, len(source)

    def text(value: str) -> None:
        if value:
            if len(stack) == 2 and stack[-1].tag == "head" and not value.isspace():
                stack.cut(1)
            stack[-1].children.append(html.unescape(value))

    def end(tag: str) -> None:
        found = stack.last(HEADINGS if tag in HEADINGS else (tag,))
        limits = ({"table"} if tag in CELLS else SCOPE) - {tag}
        if found and found > stack.last(limits):
            stack.cut(found)

    while at < size:
        match = TOKEN.search(source, at)
        if not match:
            text(source[at:])
            break
        text(source[at : match.start()])
        at = match.end()
        name = match.group(2)
        if not name:
            continue
        tag = name.lower()
        if match.group(1):
            if tag in ("html", "body"):
                continue
            if tag == "p" and not stack.places.get("p"):
                stack[-1].children.append(Node("p", {}))
            elif tag == "br":
                stack[-1].children.append(Node("br", {}))
            else:
                end("svg-text" if tag == "text" and stack.places.get("svg") else tag)
            continue
        attributes = attributes_of(match.group(3)) if match.group(3) else {}
        if tag == "html":
            continue
        if len(stack) == 2 and stack[-1].tag == "head" and tag not in HEAD_ONLY and tag != "head":
            stack.cut(1)
        if tag == "body":
            if not stack.places.get("body"):
                body = Node(tag, attributes)
                stack[-1].children.append(body)
                stack.push(body)
            continue
        if tag in ENDS_P:
            stack.close(("p",), SCOPE | {"button"})
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.cut(len(stack) - 1)
        if tag in IMPLIED:
            stack.close(*IMPLIED[tag])
        for outer, unseen in ASIDE.items():
            if tag in unseen and stack.places.get(outer):
                attributes = {**attributes, "hidden": ""}
        if tag == "text" and stack.places.get("svg"):
            tag = "svg-text"
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID:
            continue
        if tag in RAW:
            found = RAW_END[tag].search(source, at) if tag != "plaintext" else None
            content = source[at : found.start() if found else size]
            if tag == "style":
                styles.append(content)
            node.children.append(html.unescape(content) if tag in ("textarea", "title") else content)
            stop = source.find(">", found.start()) if found else -1
            at = size if stop < 0 else stop + 1
            continue
        stack.push(node)
    return root, styles


def hiding_selectors(styles: list[str]) -> set[tuple[str, str]]:
    """(tag, .class or #id) of simple selectors whose rule hides; either may be empty."""
    found: set[tuple[str, str]] = set()
    for sheet in styles:
        for selectors, rule in RULE.findall(re.sub(r"/\*.*?\*/", "", sheet, flags=re.S)):
            if HIDING.search(rule):
                for one in selectors.split(","):
                    match = SELECTOR.fullmatch(one.strip())
                    if match and match.group():
                        found.add(((match.group(1) or "").lower(), match.group(2) or ""))
    return found


def seen(node: Node, hiding: set[tuple[str, str]]) -> bool:
    attributes = node.attributes
    if node.tag in UNSEEN or "hidden" in attributes and attributes["hidden"].lower() != "until-found":
        return False
    if "style" in attributes and HIDING.search(attributes["style"]):
        return False
    if node.tag == "input" and attributes.get("type", "").lower() == "hidden":
        return False
    if hiding:
        marks = ["", *("." + c for c in attributes.get("class", "").split())] + (["#" + attributes["id"]] if attributes.get("id") else [])
        return not any((t, m) in hiding for m in marks for t in ("", node.tag) if t or m)
    return True


def width(text: str) -> int:
    """Columns of a fixed-width display."""
    if text.isascii():
        return len(text)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


class Mark(NamedTuple):
    """What to go back to at the end of an indented part."""

    lead: str
    rest: str
    quote: str
    gap: int
    fresh: bool
    count: int


class Lines:
    """Lines of output; text flows into the last one until a break. Parts may be indented, their first line with a marker."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []  # of the open line
        self.last = ""  # its last character
        self.space = False
        self.gap = 0
        self.lead = self.rest = self.quote = self.blank = ""  # before the next line, further lines, blank lines within and between
        self.fresh = True  # nothing in the part yet
        self.level = self.count = 0

    def flow(self, text: str) -> None:
        if not text:
            return
        body = SPACE.sub(" ", text)
        if body[0] == " ":
            self.space = True
        words = body.strip(" ")
        if words:
            new = not self.parts
            if new:
                self.open()
            elif self.space and self.last not in " \t":
                self.parts.append(" ")
            self.parts.append(words)
            self.last, self.space = words[-1], body[-1] == " "

    def open(self) -> None:
        """What comes before a line."""
        if self.gap > 1 and not self.fresh:
            self.lines.append(self.blank.rstrip())
        self.gap, self.space, self.fresh = 0, False, False
        self.parts.append(self.lead)
        self.lead, self.blank = self.rest, self.quote
        self.count += 1

    def end(self, gap: int = 1) -> None:
        if self.parts:
            self.lines.append("".join(self.parts).rstrip())
            self.parts, self.gap = [], 0
        self.space = False
        if not self.fresh:
            self.gap = max(self.gap, gap)

    def hard(self) -> None:
        """A line break in running text."""
        if self.parts:
            self.end(1)
        elif not self.fresh and self.gap <= 1:
            self.gap = 2

    def block(self, lines: list[str], gap: int) -> None:
        """Lines as they are, after a gap."""
        if lines:
            self.end(gap)
            for line in lines:
                if line or not self.lines:
                    self.open()
                    self.parts.append(line)
                    self.end(0)
                else:
                    self.lines.append(self.quote.rstrip())
                self.gap = 0
            self.gap = gap

    def begin(self, first: str, rest: str, gap: int, quote: bool = False) -> Mark:
        """Begins a part, indented by ``rest`` and on its first line by ``first``."""
        before = self.gap
        self.end(gap)
        mark = Mark(self.lead, self.rest, self.quote, before, self.fresh, self.count)
        self.level += 1
        if self.level > LEVELS:
            first, rest, self.lead = first.strip() and first, "", self.rest
        self.lead, self.rest, self.fresh = self.lead + first, self.rest + rest, True
        if quote:
            self.quote = self.rest
        return mark

    def finish(self, mark: Mark, gap: int) -> None:
        """Ends the part: as if it had not begun where nothing was in it."""
        self.end(0)
        self.level -= 1
        self.rest, self.quote = mark.rest, mark.quote
        if self.count > mark.count:
            self.lead, self.blank, self.gap, self.fresh = mark.rest, mark.quote, gap, False
        else:
            self.lead, self.gap, self.fresh = mark.lead, mark.gap, mark.fresh

    def done(self) -> list[str]:
        self.end(0)
        return self.lines


class Frame:
    """An open element of the walk."""

    __slots__ = ("children", "node", "number", "end")

    def __init__(self, node: Node, children: Iterable, end: Callable[[], None] | None = None) -> None:
        self.node, self.children, self.number, self.end = node, iter(children), 0, end


def wrapped(line: str) -> Iterator[str]:
    """A line in pieces of at most ``CELL_WIDTH`` columns (characters), at spaces where there are any."""
    while len(line) > CELL_WIDTH:
        cut = line.rfind(" ", 1, CELL_WIDTH + 1)
        cut = CELL_WIDTH if cut < 0 else cut
        yield line[:cut].rstrip()
        line = line[cut:].lstrip(" ")
    yield line


class Renderer:
    def __init__(self, hiding: set[tuple[str, str]]) -> None:
        self.hiding = hiding

    def lines(self, children: Iterable, level: int = 0) -> list[str]:
        out = Lines()
        self.walk(Node("div", {}), children, out, level)
        return out.done()

    def walk(self, node: Node, children: Iterable, out: Lines, level: int) -> None:
        stack = [Frame(node, children)]
        while stack:
            top = stack[-1]
            child = next(top.children, None)
            if child is None:
                if top.end:
                    top.end()
                stack.pop()
            elif isinstance(child, str):
                out.flow(child)
            elif not seen(child, self.hiding):
                pass
            elif child.tag in BLOCKS:
                if child.tag == "li":
                    top.number += 1
                if frame := self.element(child, out, top, level):
                    stack.append(frame)
            elif child.tag == "br":
                out.hard()
            elif child.tag == "img":
                out.flow(child.attributes.get("alt", "").strip())
            elif child.tag == "input":
                if child.attributes.get("type", "text").lower() in ("button", "submit", "reset", "text", "search", "email", "url", "tel", "number"):
                    out.flow(child.attributes.get("value") or child.attributes.get("placeholder") or "")
            elif child.tag == "textarea":
                out.flow("".join(x for x in child.children if isinstance(x, str)))
            elif child.tag != "wbr":
                if child.tag == "q":
                    out.flow('"')
                # inline frames share the list numbers of the block around them
                stack.append(Frame(child, child.children))

    def element(self, node: Node, out: Lines, parent: Frame, level: int) -> Frame | None:
        """Lays a block out at once, or gives the frame of its children."""
        tag = node.tag
        gap = 2 if tag in SPACED else 1
        if tag == "hr":
            out.block(["---"], 2)
            return None
        if tag == "pre":
            text = "".join(self.raw(node)).removeprefix("\n").rstrip()
            if text.strip():
                out.block(text.expandtabs(8).split("\n"), gap)
            return None
        if tag == "table":
            return self.table(node, out, gap, level)
        if tag == "li":
            start = parent.node.attributes.get("start", "1")
            first = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
            marker = f"{first + parent.number - 1}. " if parent.node.tag == "ol" else "- "
            mark = out.begin(marker, " " * len(marker), 1)
            return Frame(node, node.children, lambda: out.finish(mark, 1))
        if tag in ("ul", "ol", "menu", "dir") and parent.node.tag == "li":
            mark = out.begin("  ", "  ", 1)
            return Frame(node, node.children, lambda: out.finish(mark, 1))
        if tag == "dd":
            mark = out.begin("    ", "    ", 1)
            return Frame(node, node.children, lambda: out.finish(mark, 1))
        if tag == "blockquote":
            mark = out.begin("> ", "> ", gap, True)
            return Frame(node, node.children, lambda: out.finish(mark, gap))
        out.end(gap)
        return Frame(node, node.children, lambda: out.end(gap))

    def raw(self, node: Node) -> Iterator[str]:
        stack = [iter(node.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
            elif isinstance(child, str):
                yield child
            elif child.tag == "br":
                yield "\n"
            elif seen(child, self.hiding):
                stack.append(iter(child.children))

    def table(self, node: Node, out: Lines, gap: int, level: int) -> Frame | None:
        """Caption and rows; cells of a column are padded to its widest line, spans leave their places empty."""
        caption: list[Node] = []
        rows: list[list[tuple[int, Node]]] = []  # cells with their columns
        loose: list[Node] = []
        held: dict[int, int] = {}  # column: rows that a cell from above still covers

        def add(row: Iterable) -> None:
            cells: list[tuple[int, Node]] = []
            at = 0
            for cell in row:
                if isinstance(cell, str) or cell.tag not in ("td", "th"):
                    loose.append(alone(cell))
                    continue
                if not seen(cell, self.hiding):
                    continue
                while held.get(at):
                    at += 1
                cells.append((at, cell))
                wide, high = (min(int(v), 1000) if re.fullmatch(r"\d{1,6}", v := cell.attributes.get(k, "1")) and int(v) else 1 for k in ("colspan", "rowspan"))
                if high > 1:
                    new.update(dict.fromkeys(range(at, at + wide), high))
                at += wide
            for column in [c for c, n in held.items() if n == 1]:
                del held[column]
            for column in held:
                held[column] -= 1
            held.update({c: n - 1 for c, n in new.items()})
            new.clear()
            rows.append(cells)

        new: dict[int, int] = {}

        def part(children: Iterable) -> None:
            for child in children:
                if isinstance(child, str):
                    if child.strip():
                        loose.append(alone(child))
                elif not seen(child, self.hiding):
                    continue
                elif child.tag == "tr":
                    add(child.children)
                elif child.tag in ("td", "th"):
                    add([child])
                elif child.tag in ("thead", "tbody", "tfoot"):
                    part(child.children)
                elif child.tag == "caption":
                    caption.append(child)
                else:
                    loose.append(alone(child))

        part(node.children)
        if max((i for row in rows for i, _ in row), default=0) == 0 or level >= TABLE_LEVELS:  # one column is layout, not data: cells as blocks
            out.end(gap)
            return Frame(node, [*loose, *caption, *(cell for row in rows for _, cell in row)], lambda: out.end(gap))
        texts = [[(i, [y for x in self.lines(cell.children, level + 1) for y in wrapped(x)]) for i, cell in row] for row in rows]
        widths: dict[int, int] = {}
        for row in texts:
            for i, lines in row:
                widths[i] = max(widths.get(i, 0), max(map(width, lines), default=0))
        start, at = {}, 0  # columns without text take no place, those beyond TABLE_WIDTH aren't aligned
        for i in sorted(i for i, w in widths.items() if w):
            start[i] = min(at, TABLE_WIDTH)
            at += widths[i] + 2
        result = self.lines([*loose, *caption], level + 1)
        for row in texts:
            for k in range(max((len(lines) for _, lines in row), default=0)):
                line, used = [], 0
                for i, lines in row:
                    if k < len(lines) and lines[k]:
                        pad = max(start[i] - used, 2 if used else 0)
                        line.append(" " * pad + lines[k])
                        used += pad + width(lines[k])
                result.append("".join(line).rstrip())
        out.block(result, gap)
        return None


def alone(child: Node | str) -> Node:
    """A node around one child, to render it alone."""
    node = Node("div", {})
    node.children = [child]
    return node


def render(source: str | None) -> str:
    """All visible text of a page, laid out; '' for null."""
    if not source:
        return ""
    root, styles = parse(source)
    return "\n".join(Renderer(hiding_selectors(styles)).lines(root.children)).strip("\n")


def extract(pages: DataFrame) -> DataFrame:
    """A row per row of ``pages``: page_id, text, n_chars.

    Null and empty pages have the text ''. Repeated rows and null page_ids get
    a row each; other columns are not read. Broken markup never fails, however
    deep or wide: what isn't a tag is text. One pass, no shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            texts = [render(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string, n_chars long")
