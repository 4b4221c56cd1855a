"""Layout-aware HTML extraction: a tree, visibility rules, and a text rendering.

Tags become a tree with the end tags that HTML implies (a paragraph ends before a
block, a list item before the next one, a cell before the next cell). Elements that
a browser does not show are left out; of form fields what they hold, of a closed list the chosen
option, of closed details the summary is shown. What is visible is written as text: blocks on
lines of their own, blank lines around paragraphs and headings, list items with
bullets or numbers and indents, table cells padded to common columns, preformatted
text as it stands. Each text of a drawing is a line; formulas run on in the line, with
the parts of fractions, roots and scripts apart.

Null or empty html gives an empty text. Broken markup is read as far as it goes;
elements nested deeper than 200 become siblings, with all their visible text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from openstat.llm.common import pieces

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN = frozenset(
    "head script style template noscript title meta link base datalist iframe audio video canvas rp".split()
)
#: What a reader or page may have filled in; shown on request.
FIELDS = frozenset("textarea select option optgroup".split())
BUTTONS = frozenset("submit button reset".split())
FOREIGN = frozenset(["svg", "math"])
#: Not shown inside drawings and formulas.
UNDRAWN = frozenset(
    "desc metadata defs symbol clippath mask marker pattern filter annotation annotation-xml mphantom".split()
)
#: HTML inside drawings and formulas, and the start tags that end these elsewhere.
ISLANDS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
BREAKOUT = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta "
    "nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Formulas whose parts stand above, below or beside each other.
APART = frozenset("mfrac mroot msub msup msubsup munder mover munderover mmultiscripts mtr mlabeledtr".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl pre table figure fieldset hr".split())
BLOCK = PARAGRAPH | frozenset(
    "address article aside body center dd details dialog div dt figcaption footer form header hgroup html "
    "legend li main menu nav search section summary tr thead tbody tfoot caption".split()
)
#: A start tag ends the nearest open element of the first set, unless one of the second is nearer.
IMPLIED = (
    (frozenset(["li"]), frozenset(["li"]), frozenset("ul ol menu".split())),
    (frozenset("dt dd".split()), frozenset("dt dd".split()), frozenset(["dl"])),
    (frozenset("td th".split()), frozenset("td th".split()), frozenset("tr table".split())),
    (frozenset(["tr"]), frozenset("tr caption".split()), frozenset(["table"])),
    (frozenset("thead tbody tfoot".split()), frozenset("thead tbody tfoot caption".split()), frozenset(["table"])),
    (frozenset(["option"]), frozenset(["option"]), frozenset(["select"])),
    (frozenset(["optgroup"]), frozenset("option optgroup".split()), frozenset(["select"])),
    (frozenset(["body"]), frozenset(["head"]), frozenset()),
    (BLOCK, frozenset(["p"]), frozenset("td th li dd table button article section div".split())),
)
UNSEEN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)\b", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")
DEEPEST = 200
#: Columns and rows that a cell spans at most, by the standard.
WIDEST, TALLEST = 1000, 65534


class Element:
    __slots__ = ("tag", "attrs", "children", "foreign", "inked")

    def __init__(self, tag: str, attrs: dict[str, str], foreign: str = "", inked: bool = True) -> None:
        self.tag, self.attrs, self.children, self.foreign = tag, attrs, [], foreign
        #: Whether its own text shows: `visibility` is inherited, and a part of a hidden element may show again.
        said = VISIBILITY.findall(attrs.get("style", "")) if "style" in attrs else ()
        self.inked = said[-1].lower() == "visible" if said else inked

    def visible(self) -> bool:
        return not (
            self.tag in HIDDEN
            or (self.foreign and self.tag in UNDRAWN)
            or "hidden" in self.attrs
            or UNSEEN.search(self.attrs.get("style", ""))
            or (self.tag == "dialog" and "open" not in self.attrs)
        )


class Tree(HTMLParser):
    """Builds the tree from the tags of the standard library's tokenizer."""

    def __init__(self, fields: bool = False) -> None:
        super().__init__(convert_charrefs=True)
        self.fields = fields
        self.root = Element("html", {})
        self.open = [self.root]
        #: Open tags of a hidden element at the greatest depth, and inside it.
        self.buried: dict[str, int] = {}
        self.hider = ""

    def _foreign(self) -> str:
        """The drawing or formula in which the next element stands."""
        last = self.open[-1]
        return last.tag if last.tag in FOREIGN else "" if last.tag in ISLANDS else last.foreign

    def _in_buried(self, tag: str) -> bool:
        """Whether a start tag stands in the hidden element, which ends where HTML implies it."""
        for starts, ends, walls in IMPLIED:
            if tag in starts and self.hider in ends and not any(self.buried.get(w) for w in walls):
                self.buried = {}
        return bool(self.buried)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            return
        if self.buried and self._in_buried(tag):
            if tag not in VOID:
                self.buried[tag] = self.buried.get(tag, 0) + 1
            return
        if self._foreign() and tag in BREAKOUT:
            while self._foreign():
                self.open.pop()
        for starts, ends, walls in IMPLIED:
            if tag in starts:
                self._end(ends, walls)
        if tag not in HIDDEN and self.open[-1].tag == "head":
            self.open.pop()
        made = Element(tag, {k: v or "" for k, v in attrs}, self._foreign(), self.open[-1].inked)
        if not self.fields and (tag in FIELDS or tag == "input" and made.attrs.get("type", "").lower() not in BUTTONS):
            made.attrs["hidden"] = ""
        self.open[-1].children.append(made)
        if tag in VOID:
            return
        if len(self.open) < DEEPEST:
            self.open.append(made)
        elif not made.visible() or not made.inked:
            self.buried, self.hider = {tag: 1}, tag

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        last = self.open[-1]
        if self.buried:
            if tag in FOREIGN or self._foreign():
                self.handle_endtag(tag)
        elif last.tag == tag and not last.children and (tag in FOREIGN or last.foreign):
            self.open.pop()  # HTML elements stay open, as in a browser

    def handle_endtag(self, tag: str) -> None:
        if self.buried.get(tag):
            self.buried[tag] -= 1
            if not self.buried[self.hider]:
                self.buried = {}
            return
        if self.buried:
            if not any(e.tag == tag for e in self.open):
                return
            self.buried = {}  # the end of an element around it
        self._end(frozenset([tag]), frozenset("td th table".split()) if tag not in ("td", "th", "tr", "thead", "tbody", "tfoot", "table", "body") else frozenset(["table"]) - {tag})

    def handle_data(self, data: str) -> None:
        if self.buried:
            return
        if self.open[-1].tag == "head" and data.strip():
            self.open.pop()
        self.open[-1].children.append(data)

    def _end(self, tags: frozenset[str], walls: frozenset[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in walls:
                return


class Lines:
    """Text laid out in lines, with blocks apart and white space collapsed."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap = "", 0

    def text(self, data: str) -> None:
        data = SPACES.sub(" ", data)
        if not self.line or self.line.endswith(" "):
            data = data.lstrip(" ")
        if data:
            self._space()
            self.line += data

    def _space(self) -> None:
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        self.gap = 0

    def end(self, gap: int) -> None:
        """Ends the line; at least `gap` line ends stand before what follows."""
        if self.line.strip():
            self.lines.append(self.line.rstrip(" "))
        self.line = ""
        self.gap = max(self.gap, gap)

    def new_line(self) -> None:
        self._space()
        self.lines.append(self.line.rstrip(" "))
        self.line = ""

    def block(self, lines: list[str], gap: int) -> None:
        self.end(gap)
        if lines:
            self._space()
            self.lines += lines
        self.end(gap)

    def done(self) -> list[str]:
        self.end(0)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _inside(element: Element) -> list[str]:
    out = Lines()
    _flow(element, out)
    return out.done()


def _flow(element: Element, out: Lines) -> None:
    for child in element.children:
        if isinstance(child, str):
            if element.inked:
                out.text(child)
        elif child.visible() and child.tag == "svg":
            _drawing(child, out)
        elif child.visible() and child.foreign == "math" and child.tag in APART:
            for part in child.children:
                out.text(" ")
                _flow(_wrapped(part, child.inked), out)
            out.text(" ")
        elif child.visible() and child.foreign == "math" and child.tag == "mtable":
            for row in child.children:
                out.end(1)
                _flow(_wrapped(row, child.inked), out)
            out.end(1)
        elif not child.visible():
            continue
        elif child.tag == "br":
            out.new_line()
        elif child.tag == "hr":
            out.end(2)
        elif child.tag == "img":
            if child.inked:
                out.text(child.attrs.get("alt", ""))
        elif child.tag == "input":
            kind = child.attrs.get("type", "text").lower()
            if child.inked and kind not in ("hidden", "password", "checkbox", "radio", "file", "image", "color", "range"):
                out.text(child.attrs.get("value", ""))
        elif child.tag == "select":
            for chosen in _chosen(child):
                out.text(" ")
                _flow(chosen, out)
                out.text(" ")
        elif child.tag == "details" and "open" not in child.attrs:
            summary = [c for c in child.children if not isinstance(c, str) and c.tag == "summary"][:1]
            out.end(1)
            for head in summary:
                _flow(_wrapped(head), out)
            out.end(1)
        elif child.tag == "textarea":
            text = "".join(_raw(child)).removeprefix("\n").rstrip("\n")
            out.block(text.split("\n") if text.strip() else [], 1)
        elif child.tag == "pre":
            text = "".join(_raw(child)).removeprefix("\n").rstrip("\n")
            out.block(text.split("\n") if text.strip() else [], 2)
        elif child.tag in ("ul", "ol", "menu"):
            out.block(_list(child), 2 if element.tag != "li" else 1)
        elif child.tag == "table":
            out.block(_table(child), 2)
        elif child.tag in ("blockquote", "dd"):
            out.block([f"  {x}".rstrip() for x in _inside(child)], 2 if child.tag == "blockquote" else 1)
        elif child.tag in BLOCK:
            gap = 2 if child.tag in PARAGRAPH else 1
            out.end(gap)
            _flow(child, out)
            out.end(gap)
        else:
            _flow(child, out)


def _drawing(element: Element, out: Lines) -> None:
    """Texts and embedded HTML; other characters of a drawing are not shown."""
    for child in element.children:
        if isinstance(child, str) or not child.visible():
            continue
        if child.tag in ("text", "foreignobject"):
            out.end(1)
            _flow(child, out)
            out.end(1)
        else:
            _drawing(child, out)


def _chosen(element: Element) -> list[Element]:
    """What a closed list of options shows: those marked as selected, else the first; an open list shows all."""
    options, todo = [], [*reversed(element.children)]
    while todo:
        child = todo.pop()
        if isinstance(child, str) or not child.visible():
            continue
        if child.tag == "option":
            options.append(child)
        elif child.tag == "optgroup":
            todo += reversed(child.children)
    if "multiple" in element.attrs or element.attrs.get("size", "1") not in ("", "0", "1"):
        return options
    marked = [o for o in options if "selected" in o.attrs]
    return marked[-1:] or options[:1]


def _raw(element: Element) -> Iterator[str]:
    for child in element.children:
        if isinstance(child, str):
            if element.inked:
                yield child.replace("\r\n", "\n")
        elif child.tag == "br":
            yield "\n"
        elif child.visible() and child.tag in FOREIGN:
            yield "\n".join(_inside(_wrapped(child)))
        elif child.visible():
            yield from _raw(child)


def _list(element: Element) -> list[str]:
    lines: list[str] = []
    start = element.attrs.get("start", "1")
    number = int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1
    rest = Element("div", {}, inked=element.inked)
    for child in element.children:
        if not isinstance(child, str) and child.tag == "li":
            if child.visible():
                value = child.attrs.get("value", "")
                number = int(value) if re.fullmatch(r"-?[0-9]{1,9}", value) else number
                mark = f"{number}. " if element.tag == "ol" else "- "
                inside = _inside(child)
                lines += [((mark if not i else " " * len(mark)) + x).rstrip() for i, x in enumerate(inside)]
                number += 1
        else:
            rest.children = [child]
            lines += _inside(rest)
    return lines


def _rows(element: Element) -> Iterator[Element]:
    """Rows and captions of a table, and what else stands in it."""
    for child in element.children:
        if isinstance(child, str):
            if child.strip():
                loose = Element("caption", {}, inked=element.inked)
                loose.children = [child]
                yield loose
        elif child.visible():
            if child.tag in ("thead", "tbody", "tfoot"):
                yield from _rows(child)
            else:
                yield child


def _span(cell: Element, name: str, most: int) -> int:
    said = cell.attrs.get(name, "1")
    return max(1, min(int(said) or (most if name == "rowspan" else 1), most)) if re.fullmatch(r"[0-9]{1,9}", said) else 1


def _table(element: Element) -> list[str]:
    lines: list[str] = []
    grid: list[list[str]] = []
    #: The last row, counted from 1, that a cell above takes up in a column.
    below: dict[int, int] = {}
    for row in _rows(element):
        if row.tag == "tr":
            cells = [c for c in row.children if not isinstance(c, str) and c.visible()]
            grid.append([])
            for c in cells:
                while below.get(len(grid[-1]), 0) >= len(grid):
                    grid[-1].append("")
                at, wide = len(grid[-1]), _span(c, "colspan", WIDEST)
                grid[-1].append(" ".join(x.strip() for x in _inside(_wrapped(c)) if x.strip()))
                grid[-1] += [""] * (wide - 1)
                if "rowspan" in c.attrs:
                    last = len(grid) - 1 + _span(c, "rowspan", TALLEST)  # grid holds this row already
                    below.update((i, last) for i in range(at, at + wide))
            loose = Element("div", {}, inked=row.inked)
            loose.children = [c for c in row.children if isinstance(c, str)]
            lines += _inside(loose)
        else:
            lines += _inside(_wrapped(row))
    widths: list[int] = []
    for cells in grid:
        widths += [0] * (len(cells) - len(widths))
        for i, cell in enumerate(cells):
            widths[i] = max(widths[i], len(cell))
    return lines + [
        "  ".join(cell.ljust(widths[i]) for i, cell in enumerate(cells)).rstrip() for cells in grid if any(cells)
    ]


def _wrapped(element: Element | str, inked: bool = True) -> Element:
    out = Element("div", {}, inked=inked)
    out.children = [element]
    return out


def render(html: str | None, fields: bool = False) -> str:
    """All visible text of a page, laid out in lines; with `fields`, what form fields hold too."""
    tree = Tree(fields)
    tree.feed(html or "")
    tree.close()
    lines = _inside(tree.root)
    while lines and not lines[0]:
        lines = lines[1:]
    return "\n".join(lines)


def extract_text(pages: DataFrame, html_col: str = "html", name: str = "visible_text", fields: bool = True) -> DataFrame:
    """`pages` without the html and with the text, row by row; a column of that name is replaced.

    Form fields show what they hold unless `fields` is false.
    """
    rest = [c for c in pages.columns if c not in (html_col, name)]
    rows = pages.select(*rest, F.col(html_col).alias("_html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "_html"):
            texts = [render(h, fields) for h in batch.column(len(rest)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*rest, name])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema if f.name != "_html")
    return rows.mapInArrow(run, f"{kept}`{name}` string")
