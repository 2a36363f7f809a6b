"""Operator 8: layout-aware text of HTML pages.

A tree builder supplies implied end tags (paragraphs, list items, table rows and cells, options, description terms) and closes what a
closing tag leaves open.  Visibility rules come from tags, attributes, inline styles and the page's own style sheets as far as their
selectors are a tag, a class, an id or a tag with a class; ``visibility`` is inherited and may be taken back below, ``display: none``
may not.  The renderer walks the tree and emits all visible text: white space of inline text is collapsed, blocks stand on lines
of their own with a blank line around paragraphs, headings, lists, tables and quotes, list items have markers and indents,
table cells are padded to columns under their column and row spans, and preformatted text stays as it is.

Neither depth nor size of a page is limited: nothing recurses, and time and output grow in proportion to the page.  For that
an indent ends at 64 columns, cells are padded up to column 400 at most, and tables more than 8 deep in others have their
cells side by side without columns.  A closed dialog and what a closed details element holds beside its summary don't show;
``!important`` counts.  A null or empty page has the empty text; a null page_id stays null,
rows with equal ids are rows of their own, an empty table gives an empty result.  Unclosed comments, tags and
quoted values run to the end of the page and are dropped, as browsers do.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
#: Tags inside an svg element that have the name "svg:" and theirs; all but text are never shown.
SVG = frozenset("text desc metadata defs symbol clippath mask pattern marker".split())
HIDDEN = frozenset("head script style template noscript title meta link iframe audio video canvas datalist noembed noframes area base param source track annotation annotation-xml".split()) | {
    f"svg:{x}" for x in SVG - {"text"}
}
#: Start tags that leave an open head open.
HEAD = frozenset("html head base basefont bgsound link meta title script style template noframes noscript".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog dd dir div dt figcaption footer form header hgroup legend li main menu nav search section summary caption thead tbody tfoot tr option optgroup svg:text".split())
#: A start tag ends the open element of the set, unless one of the walls is nearer.
_PARAGRAPH_ENDS = BLOCK - frozenset("html body caption thead tbody tfoot tr li dd dt legend option optgroup svg:text".split()) | {"hr"}
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"tr", "thead", "tbody", "tfoot", "caption"}, {"table"}), "body": ({"head"}, set()),
}
_WALLS = frozenset("td th table caption button body".split())
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)(>?)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SAID = re.compile(r"(?<![\w-])(display|visibility)\s*+:\s*+([a-z-]+)\s*+(!\s*+important)?", re.I)
_BRACE = re.compile("[{};]")
_SELECTOR = re.compile(r"([a-z][a-z0-9]*)?(?:([.#])([\w-]+))?", re.I)
_BLANK = re.compile(r"[ \t\n\r\f]+")
_INDENT, _PAD, _TABLES = 64, 400, 8
#: Whether it was said to be important, and the value, by property.
Said = dict[str, tuple[bool, str]]


class Node:
    """``seen`` is whether text that stands right in it shows, ``shown`` whether it makes a box at all."""

    __slots__ = ("attributes", "children", "seen", "shown", "tag")

    def __init__(self, tag: str, attributes: str = "") -> None:
        self.tag, self.attributes, self.children, self.seen, self.shown = tag, attributes, [], True, True

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(m[2] or m[3] or m[4] or "")
        return None

    def span(self, name: str) -> int:
        """A colspan or rowspan, at most the 1000 that browsers heed."""
        value = self.get(name) if name in self.attributes.lower() else None
        return min(max(int(value), 1), 1000) if value and value.isascii() and value.isdigit() else 1


class Sheet:
    """What style sheets say on display and visibility, by selector; of equal selectors the last counts."""

    def __init__(self) -> None:
        self.rules: dict[tuple[str, str, str], Said] = defaultdict(dict)

    def add(self, css: str) -> None:
        """One pass over braces; what stands in @ blocks is left out, as media may not apply."""
        css = re.sub(r"/\*.*?(?:\*/|\Z)", "", css, flags=re.S)
        depth = start = opened = inner = 0
        for m in _BRACE.finditer(css):
            if m[0] == "{":
                depth += 1
                if depth == 1:
                    opened, inner = m.start(), 0
                elif not inner:
                    inner = m.start()
            elif m[0] == "}":
                depth = max(depth - 1, 0)
                if not depth:
                    if opened > start:
                        self._rule(css[start:opened], css[opened + 1 : inner or m.start()])
                    start, opened = m.end(), 0
            elif not depth:
                start = m.end()

    def _rule(self, names: str, body: str) -> None:
        said = {} if names.lstrip().startswith("@") else declared(body)
        for name in names.split(",") if said else ():
            m = _SELECTOR.fullmatch(name.strip())
            if m and m[0]:
                overrule(self.rules[(m[1] or "").lower(), m[2] or "", m[3] or ""], said)

    def of(self, node: Node) -> Said:
        if not self.rules:
            return {}
        classes = (node.get("class") or "").split() if "class" in node.attributes.lower() else []
        name = node.get("id") if "id" in node.attributes.lower() else None
        keys = [(node.tag, "", ""), *(("", ".", c) for c in classes), *((node.tag, ".", c) for c in classes), *([("", "#", name), (node.tag, "#", name)] if name else [])]
        out: Said = {}
        for key in keys:
            overrule(out, self.rules.get(key, {}))
        return out


def overrule(said: Said, by: Said) -> None:
    """What is said later holds, unless what was said before is important and it isn't."""
    for k, v in by.items():
        if v[0] or not said.get(k, (False,))[0]:
            said[k] = v


def declared(style: str) -> Said:
    """The last display and visibility of a list of declarations, or the last important one."""
    out: Said = {}
    for k, value, important in _SAID.findall(style):
        overrule(out, {k.lower(): (bool(important), value.lower())})
    return out


def apply_visibility(root: Node, sheet: Sheet) -> None:
    todo = [root]
    while todo:
        node = todo.pop()
        for child in node.children:
            if isinstance(child, str):
                continue
            child.seen = node.seen
            if child.tag in HIDDEN:
                child.shown = False
                continue
            low = child.attributes.lower()
            if low or sheet.rules:
                if "hidden" in low and (child.get("hidden") is not None or (child.tag == "input" and child.get("type") == "hidden")):
                    child.shown = False
                    continue
                said = sheet.of(child)
                if "style" in low:
                    overrule(said, declared(child.get("style") or ""))
                display, visibility = (said.get(k, (False, ""))[1] for k in ("display", "visibility"))
                if display == "none" or (child.tag == "dialog" and not display and child.get("open") is None):
                    child.shown = False
                    continue
                if visibility in ("hidden", "collapse", "visible"):
                    child.seen = visibility == "visible"
            elif child.tag == "dialog":
                child.shown = False
                continue
            if child.tag == "details" and child.get("open") is None:
                child.children = [c for c in child.children if isinstance(c, Node) and c.tag == "summary"][:1]
            todo.append(child)


def build_tree(page: str) -> Node:
    root, sheet = Node("#root"), Sheet()
    stack = [root]
    place: dict[str, list[int]] = defaultdict(list)
    foreign = False

    def nearest(tags) -> int:
        return max((place[t][-1] for t in tags if t in place and place[t]), default=0)

    def close(tags: set[str] | frozenset[str], walls: set[str] | frozenset[str]) -> None:
        """Closes the nearest open element of ``tags``, unless one of the walls is nearer."""
        at = nearest(tags)
        if at and at >= nearest(walls):
            while len(stack) > at:
                place[stack.pop().tag].pop()

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if stack[-1].tag == "head" and page[at:].strip():
                close({"head"}, set())
            stack[-1].children.append(unescape(page[at:]))
            break
        if m.start() > at:
            if stack[-1].tag == "head" and page[at : m.start()].strip():
                close({"head"}, set())
            stack[-1].children.append(unescape(page[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        if not m[4]:
            break
        tag = m[2].lower()
        if foreign and tag in SVG and place["svg"]:
            tag = f"svg:{tag}"
        if m[1]:
            if tag == "p" and not place["p"]:
                stack[-1].children.append(Node("p"))
            elif tag == "br":
                stack[-1].children.append(Node("br"))
            else:
                close({tag}, frozenset() if tag in ("table", "body", "html") else {"table"} if tag in ("td", "th", "tr") else _WALLS - {tag})
            continue
        if stack[-1].tag == "head" and tag not in HEAD:
            close({"head"}, set())
        if foreign and tag in _PARAGRAPH_ENDS:
            close({"svg", "math"}, _WALLS | {"foreignobject", "annotation-xml", "svg:desc"})
        foreign = foreign or tag in ("svg", "math")
        if tag in _PARAGRAPH_ENDS and place["p"]:
            close({"p"}, _WALLS)
        if tag in _IMPLIED:
            tags, walls = _IMPLIED[tag]
            for _ in range(2 if tag in ("tr", "thead", "tbody", "tfoot") else 1):
                close(tags, walls)
        node = Node(tag, m[3].strip().rstrip("/") if m[3] else "")
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            inside = page[at : end.start() if end else n]
            if tag == "style":
                sheet.add(inside)
            elif tag in ("textarea", "title"):
                node.children.append(unescape(inside))
            at = end.end() if end else n
        elif tag not in VOID and not (m[3] and m[3].endswith("/") and (tag in ("svg", "math", "path") or (foreign and (place["svg"] or place["math"])))):
            place[tag].append(len(stack))
            stack.append(node)
    apply_visibility(root, sheet)
    return root


def finish(walk: Iterator) -> None:
    """Runs a generator, and those that it yields in its place, on a stack of its own."""
    todo = [walk]
    while todo:
        inner = next(todo[-1], None)
        if inner is None:
            todo.pop()
        else:
            todo.append(inner)


class Renderer:
    """Lines of text; ``gap`` is how many line ends must stand before the next word."""

    def __init__(self, tables: int = 0) -> None:
        """``tables`` is the number of tables around."""
        self.tables = tables
        self.parts: list[str] = []
        self.gap = 0
        self.space = False
        self.indent = ""
        self.marker = ""

    def _open(self) -> None:
        if self.gap and self.parts:
            self.parts.append("\n" * self.gap)
        if self.gap or not self.parts:
            self.parts.append(self.indent[: len(self.indent) - len(self.marker)] + self.marker if self.marker else self.indent)
            self.marker = ""
        elif self.space:
            self.parts.append(" ")
        self.gap, self.space = 0, False

    def words(self, text: str) -> None:
        flat = _BLANK.sub(" ", text)
        if flat in ("", " "):
            self.space = self.space or flat == " "
            return
        self.space = self.space or flat[0] == " "
        self._open()
        self.parts.append(flat.strip(" "))
        self.space = flat[-1] == " "

    def lines(self, text: str) -> None:
        """Preformatted lines, under the current indent."""
        if text:
            self._open()
            self.parts.append(text.replace("\n", "\n" + self.indent))

    def need(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def text(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.parts).split("\n")).strip("\n")

    def render(self, node: Node) -> Iterator:
        number = None
        for child in node.children:
            if isinstance(child, str):
                if node.seen:
                    self.words(child)
                continue
            if not child.shown:
                continue
            tag = child.tag
            if tag == "br":
                self.gap = min(self.gap + 1, 2) if self.parts else 0
                self.space = False
            elif tag == "hr":
                self.need(1)
                if child.seen:
                    self.lines("---")
                self.need(1)
            elif tag in ("pre", "textarea"):
                self.need(2 if tag == "pre" else 1)
                self.lines(plain_text(child).strip("\n"))
                self.need(2 if tag == "pre" else 1)
            elif tag == "table":
                self.need(2)
                yield self.table(child) if self.tables < _TABLES else self.render(child)
                self.need(2)
            elif tag == "li":
                if node.tag == "ol":
                    start = (node.get("start") or "1").strip() if number is None else ""
                    number = (int(start) if start.lstrip("-").isdecimal() and start.isascii() else 1) if number is None else number + 1
                yield self.item(child, f"{number}. " if node.tag == "ol" else "- ")
            elif tag in ("blockquote", "dd"):
                yield self.nested(child, "  ", 2 if tag == "blockquote" else 1)
            elif tag in BLOCK:
                lines = 1 if tag in ("ul", "ol") and node.tag == "li" else 2 if tag in SPACED else 1
                self.need(lines)
                if tag == "optgroup" and child.seen:
                    self.words(child.get("label") or "")
                    self.need(lines)
                yield self.render(child)
                self.need(lines)
            elif child.children:
                yield self.render(child)
                if tag in ("td", "th"):
                    self.space = True

    def nested(self, node: Node, indent: str, lines: int) -> Iterator:
        self.need(lines)
        before = self.indent
        self.indent = (before + indent)[:_INDENT]
        yield self.render(node)
        self.indent = before
        self.need(lines)

    def item(self, node: Node, marker: str) -> Iterator:
        self.need(1)
        before = self.indent, self.marker
        self.indent, self.marker = (self.indent + " " * len(marker))[: max(_INDENT, len(marker))], marker if node.seen else ""
        yield self.render(node)
        self.indent, self.marker = before
        self.need(1)

    def table(self, node: Node) -> Iterator:
        """Rows of cells: each cell is its first column, its number of columns and its lines."""
        rows: list[list[tuple[int, int, list[str]]]] = []
        taken: list[tuple[int, int, int]] = []  # from column, to column, for so many rows more; by column

        def add_row(cells: list[Node]) -> Iterator:
            row, column, below, over = [], 0, [], 0
            for cell in cells:
                inner = Renderer(self.tables + 1)
                yield inner.render(cell)
                while over < len(taken) and taken[over][0] <= column:
                    column = max(column, taken[over][1])
                    over += 1
                wide, deep = cell.span("colspan"), cell.span("rowspan")
                row.append((column, wide, inner.text().split("\n")))
                if deep > 1:
                    below.append((column, column + wide, deep - 1))
                column += wide
            rows.append(row)
            taken[:] = sorted([(a, b, left - 1) for a, b, left in taken if left > 1] + below)

        def walk(x: Node) -> Iterator:
            loose: list[Node] = []
            for child in x.children:
                if isinstance(child, str):
                    if child.strip() and x.seen:
                        self.words(child)
                        self.need(1)
                elif child.shown:
                    if child.tag in ("td", "th"):
                        loose.append(child)
                    elif child.tag in ("thead", "tbody", "tfoot"):
                        yield walk(child)
                    elif child.tag == "tr":
                        yield add_row([c for c in child.children if isinstance(c, Node) and c.tag in ("td", "th") and c.shown])
                        stray = Node("#stray")
                        stray.seen = child.seen
                        stray.children = [c for c in child.children if not (isinstance(c, Node) and c.tag in ("td", "th"))]
                        yield self.render(stray)
                    else:
                        self.need(1)
                        yield self.render(child)
                        self.need(1)
            if loose:
                yield add_row(loose)

        yield walk(node)
        # columns where no cell starts or ends are none
        edges = {k: i for i, k in enumerate(sorted({k for row in rows for column, wide, _ in row for k in (column, column + wide)}))}
        rows = [[(edges[column], edges[column + wide] - edges[column], lines) for column, wide, lines in row] for row in rows]
        widths: dict[int, int] = defaultdict(int)
        for wide_ones in (False, True):
            for row in rows:
                for column, wide, lines in row:
                    if (wide > 1) is wide_ones:
                        own = max(map(len, lines))
                        rest = sum(widths[k] for k in range(column, column + wide - 1)) + 2 * (wide - 1)
                        widths[column + wide - 1] = max(widths[column + wide - 1], own - rest)
        starts, at = {}, 0
        for k in range(max(widths, default=-1) + 1):
            starts[k], at = min(at, _PAD), at + widths[k] + 2
        for row in rows:
            for i in range(max((len(lines) for _, _, lines in row), default=0)):
                line: list[str] = []
                size = 0
                for column, _, lines in row:
                    if i < len(lines) and lines[i]:
                        pad = starts[column] - size
                        if line and pad < 2:
                            pad = 2
                        line += [" " * pad, lines[i]]
                        size += max(pad, 0) + len(lines[i])
                self.need(1)
                whole = "".join(line).rstrip()
                if whole:
                    self.lines(whole)


def plain_text(node: Node) -> str:
    """All visible text below, as it stands."""
    out: list[str] = []
    todo: list[tuple[Node, str | Node]] = [(node, c) for c in reversed(node.children)]
    while todo:
        parent, x = todo.pop()
        if isinstance(x, str):
            out += [x] if parent.seen else []
        elif x.tag == "br":
            out.append("\n")
        elif x.shown:
            todo += [(x, c) for c in reversed(x.children)]
    return "".join(out)


def visible_text(page: str | None) -> str:
    if not page:
        return ""
    out = Renderer()
    finish(out.render(build_tree(page)))
    return out.text()


def extract_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (id, html) to (page_id, text)."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([visible_text(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page_id, text, n_chars) for every row; no shuffle."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract_batches, "page_id long, text string").withColumn("n_chars", F.length("text").cast("long"))


def op8_layout_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
