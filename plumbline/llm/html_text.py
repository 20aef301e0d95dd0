"""HTML extraction: all visible text, laid out as a browser would stack it.

A page goes through a tokenizer, a tree builder and a renderer in one pass.
The tokenizer ends tags where browsers do, and never reads a place twice. The
builder keeps the stack of open elements, and for each tag where it is open, so
that closing what an end tag or a new block implies needs no walk; end tags
that match nothing are ignored. It never nests calls, so depth is no limit. The
renderer collapses white space, separates blocks by line breaks and paragraphs
by an empty line, numbers and indents lists, keeps ``pre`` as it stands, and
sets tables with columns aligned by the width that characters take.

Time and output grow with the page and not with its square, whatever the page:
by a ``Layout``, indents, the padding in a table's line, a column's width (longer
cells push the rest of their line), the columns that cells span, and how deep
tables stand within tables (deeper ones are shown as blocks) have an end. No
text is lost by it, and the ends are the caller's.

Invisible are the head, comments, scripts, styles, templates, media with their
fallbacks, inputs, any element with ``hidden`` or ``display:none``, and what has
``visibility:hidden``, but for parts of it made visible again. Both are read from
attributes and from the page's own style sheets, as far as ``html_style`` does,
for the elements that follow a sheet. MathML and the
text of SVG are visible, without annotations and titles, descriptions,
definitions and metadata; so are a textarea's content and the options a select
shows: the selected ones, else the first unless it is a list box (``multiple``
or ``size``), which shows all. Self-closed elements of SVG and MathML have no
content. What a closed ``details`` holds is shown: a click away, it is on the page.

Nulls and odd input: null gives an empty text, as does an empty page. Text
without tags is one paragraph. Unclosed comments and raw elements run to the
end; a tag that never ends takes the rest of the page. Each row gets a row;
repeated rows get the same text. An empty table gives an empty result. Other
columns are not looked at.
"""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.html_style import Styles, is_sheet

#: A whole tag as most are, from its name on; others go attribute by attribute.
TAG = re.compile(r"([a-zA-Z][^\s/>]*+)((?:\s++[^\s\"'>/=]++(?:=(?:\"[^\"]*+\"|'[^']*+'|[^\s\"'>=<`]++))?)*+)\s*+(/?)>")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"\s+([^\s\"'>/=]+)(?:=(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
BETWEEN = re.compile(r"[\s/]*")
KEY = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE = re.compile(r"[^\s>]*")
END_SELECT = re.compile(r"</?select(?=[\s/>])", re.I)
SPACE = re.compile(r"[ \t\n\f\r]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title iframe noembed noframes object audio video canvas datalist input".split())
#: Invisible inside svg or math.
FOREIGN = frozenset("svg math".split())
FOREIGN_UNSEEN = frozenset("title desc defs metadata symbol clippath mask marker pattern lineargradient radialgradient annotation annotation-xml".split())
#: HTML stands inside these again.
INTEGRATION = frozenset("foreignobject title desc annotation-xml mtext mi mo mn ms".split())
#: These end an svg or math that they stand in.
BREAKOUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
PARAGRAPH = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure hr fieldset details menu dir".split())
BLOCK = PARAGRAPH | frozenset("html body div section article aside header footer nav main address form li dt dd center figcaption hgroup legend summary search caption tr option optgroup listing xmp".split())
#: A start tag closes these open elements, up to the nearest of its borders.
CLOSES: dict[str, tuple[frozenset[str], frozenset[str]]] = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir table td th".split())),
    "dt": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "dd": (frozenset("dt dd".split()), frozenset("dl table td th".split())),
    "option": (frozenset(["option"]), frozenset("select datalist".split())),
    "optgroup": (frozenset("option optgroup".split()), frozenset(["select"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "tbody": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "thead": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "tfoot": (frozenset("tbody thead tfoot tr td th caption colgroup".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset()),
}
ONLY_P = frozenset(["p"])
P_BORDERS = frozenset("table td th caption button".split())
ONLY_TABLE = frozenset(["table"])
CELLS = frozenset("td th table caption".split())
#: Start tags that may stand in a head; any other ends it.
HEAD_TAGS = frozenset("html head title base link meta style script template noscript noframes".split())


class Layout(NamedTuple):
    """Where the growth of a layout ends."""

    indent: int = 40
    padding: int = 1000
    column: int = 120
    tables: int = 16
    span: int = 1000


def width(s: str) -> int:
    """Columns that a string takes on a terminal."""
    if s.isascii():
        return len(s)
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in s)


def read_tag(source: str, at: int) -> tuple[str, dict[str, str], bool, int]:
    """Name, attributes (the first of each name), whether it is self-closed, and
    the end of the tag whose name begins at ``at``. The end is -1 if it has none."""
    tag = TAG.match(source, at)
    if tag:
        values: dict[str, str] = {}
        if tag[2]:
            for k, v in ATTRIBUTE.findall(tag[2]):
                values.setdefault(k.lower(), v[1:-1] if v[:1] in ("'", '"') and v else v)
        return tag[1].lower(), values, bool(tag[3]), tag.end()
    name = NAME.match(source, at)
    values, at = {}, name.end()
    while True:
        last, at = at, BETWEEN.match(source, at).end()
        if at == len(source):
            return name[0].lower(), values, False, -1
        if source[at] == ">":
            return name[0].lower(), values, source[at - 1] == "/" and at > last, at + 1
        key = KEY.match(source, at)
        at, value = key.end(), ""
        equals = EQUALS.match(source, at)
        if equals:
            at = equals.end()
            quote = source[at : at + 1]
            if quote in ('"', "'") and quote:
                end = source.find(quote, at + 1)
                if end < 0:
                    return name[0].lower(), values, False, -1
                value, at = source[at + 1 : end], end + 1
            else:
                bare = BARE.match(source, at)
                value, at = bare[0], bare.end()
        values.setdefault(key[0].lower(), value)


def tags(source: str, at: int, end: int) -> Iterator[tuple[str, int, bool, str, dict[str, str], bool, int]]:
    """Of each tag and other markup between two places: its kind (tag, or text
    that only looks like one, or what shows nothing), start, whether it is an
    end tag, name, attributes, whether it is self-closed, and end."""
    while 0 <= (at := source.find("<", at)) < end:
        follows = source[at + 1 : at + 2]
        stop, found = -1, ("skip", at, False, "", {}, False)
        if source.startswith("<!--", at):
            stop = source.find("-->", at + 2) + 3 or -1
            stop = stop if stop > 2 else -1
        elif source.startswith("<![CDATA[", at):
            found = ("cdata", at, False, "", {}, False)
            stop = source.find(">", at) + 1 or -1
        elif follows in ("!", "?") and follows:
            stop = source.find(">", at) + 1 or -1
        else:
            closing = follows == "/"
            first = source[at + 1 + closing : at + 2 + closing]
            if first.isascii() and first.isalpha():
                name, values, closed, stop = read_tag(source, at + 1 + closing)
                if stop >= 0:
                    found = ("tag", at, closing, name, values, closed)
            else:
                at += 1
                continue
        stop = stop if stop >= 0 else len(source)
        jump = yield (*found, stop)
        at = stop if jump is None else jump


class Sink:
    """Lines of laid-out text: collapses white space and holds back breaks until text follows."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.breaks = 0
        self.space = False
        self.indent = ""
        self.mark = ""

    def text(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s == " " or not s:
            self.space = self.space or bool(s)
            return
        lead, tail = s[0] == " ", s[-1] == " "
        self._start()
        if self.parts and (lead or self.space) and not self.parts[-1].endswith(("\n", " ")):
            self.parts.append(" ")
        self.parts.append(s.strip(" "))
        self.space = tail

    def lines(self, lines: list[str]) -> None:
        """Text that stands as it is."""
        for i, line in enumerate(lines):
            if i:
                self.parts.append("\n" + self.indent)
            else:
                self._start()
            self.parts.append(line)
        self.space = False

    def _start(self) -> None:
        if self.breaks and self.parts:
            self.parts.append("\n" * self.breaks)
        if self.breaks or not self.parts:
            lead = self.indent
            if self.mark:
                lead = lead[: -len(self.mark)] + self.mark if len(lead) >= len(self.mark) else self.mark
            if lead:
                self.parts.append(lead)
            self.space = False
        self.mark, self.breaks = "", 0

    def break_lines(self, n: int) -> None:
        self.breaks = max(self.breaks, n)
        self.space = False

    def line_break(self) -> None:
        self.breaks = min(self.breaks + 1, 2)
        self.space = False

    def result(self) -> str:
        return "\n".join(line.rstrip() for line in "".join(self.parts).split("\n")).strip("\n")


class Table:
    def __init__(self, layout: Layout) -> None:
        self.layout = layout
        self.rows: list[dict[int, list[str]]] = []
        self.taken: dict[int, int] = {}  # column -> the last row that a cell above reaches into
        self.column = 0

    def row(self) -> None:
        self.rows.append({})
        self.column = 0

    def cell(self, text: str, across: int, down: int) -> None:
        if not self.rows:
            self.row()
        at = len(self.rows) - 1
        while self.taken.get(self.column, -1) >= at:
            self.column += 1
        self.rows[-1][self.column] = text.split("\n")
        if self.column + across > self.layout.span:
            across, down = 1, 1
        if down > 1:
            self.taken.update((c, at + down - 1) for c in range(self.column, self.column + across))
        self.column += across

    def lines(self) -> list[str]:
        widths: dict[int, int] = {}
        for row in self.rows:
            for c, lines in row.items():
                widths[c] = max(widths.get(c, 0), min(self.layout.column, max(map(width, lines))))
        starts, at = {}, 0
        for c in sorted(widths):
            starts[c] = at
            at += widths[c] + 2
        out = []
        for row in self.rows:
            cells = sorted(row.items())
            for k in range(max((len(x) for _, x in cells), default=0)):
                parts, used = [], 0
                for c, lines in cells:
                    text = lines[k] if k < len(lines) else ""
                    if text:
                        gap = min(starts[c], self.layout.padding) - used if starts[c] > used else 0
                        gap = max(gap, 2 if used else 0)
                        parts.append(" " * gap + text)
                        used += gap + width(text)
                out.append("".join(parts).rstrip())
        return out


class Page:
    """Builds the stack of open elements and renders as it goes."""

    def __init__(self, layout: Layout) -> None:
        self.layout, self.styles = layout, Styles()
        self.sink = Sink()
        self.open: list[tuple[str, bool, object, bool]] = []  # tag, whether it is gone, what its end undoes, hidden around it
        self.at: dict[str, list[int]] = defaultdict(list)  # where in the stack each tag is open
        self.foreign: list[bool] = []  # of each open element: whether its children are SVG or MathML
        self.options: list[tuple[int, int | None]] = []  # of each open select: options so far, and the one that shows, None for all
        self.gone = 0
        self.hidden = False
        self.tables: list[tuple[Table, Sink]] = []
        self.lists: list[tuple[int, int] | None] = []  # next number and step, or None for bullets
        self.counts: Iterator[int] = iter(())  # items of each list that counts down
        self.pre = 0
        self.fresh_pre = False

    def text(self, s: str) -> None:
        if self.gone or self.hidden or not s:
            return
        if "&" in s:
            s = html.unescape(s)
        if self.pre:
            s = s.replace("\r\n", "\n")
            # A newline right after the tag does not count.
            self.sink.lines((s[1:] if self.fresh_pre and s[0] == "\n" else s).split("\n"))
            self.fresh_pre = False
        else:
            self.sink.text(s)

    def start(self, tag: str, values: dict[str, str], closed: bool) -> bool:
        """Whether an element was opened."""
        if tag in BREAKOUT and self.foreign and self.foreign[-1]:
            self._close_until(next((i + 1 for i in range(len(self.open) - 1, -1, -1) if not self.foreign[i]), 0))
        foreign = tag in FOREIGN or bool(self.foreign and self.foreign[-1])
        if tag not in HEAD_TAGS and self.at["head"] and self.at["head"][-1] >= len(self.open) - 3:
            self._close_until(self.at["head"][-1])
        if tag in CLOSES:
            self._close_within(*CLOSES[tag])
        if tag in BLOCK:
            self._close_within(ONLY_P, P_BORDERS)
        said = self.styles.decide(tag, values) if self.styles.same or "style" in values else {}
        gone = tag in UNSEEN or foreign and tag in FOREIGN_UNSEEN or said.get("display", "hidden" in values)
        if tag == "option" and self.options:
            n, shown = self.options[-1]
            self.options[-1] = (n + 1, shown)
            gone = gone or shown is not None and n != shown
        shows = not self.gone and not gone
        if shows:
            if tag == "br":
                self.sink.line_break()
            elif tag == "hr":
                self.sink.break_lines(2)
            elif tag in BLOCK:
                nested = tag in ("ul", "ol", "menu", "dir") and self.lists
                self.sink.break_lines(2 if tag in PARAGRAPH and not nested else 1)
            elif tag == "textarea" or tag == "text" and foreign:
                self.sink.break_lines(1)
        count = next(self.counts, 0) if tag == "ol" and "reversed" in values else 0
        if tag in VOID or foreign and closed:
            return False
        around = self.hidden
        self.hidden = said.get("visibility", around)
        undo = self._enter(tag, values, count) if shows else None
        self.at[tag].append(len(self.open))
        self.open.append((tag, gone, undo, around))
        self.foreign.append(foreign and tag not in INTEGRATION)
        self.gone += gone
        return True

    def select(self, values: dict[str, str], source: str, at: int, end: int) -> None:
        """Note which option of the select just opened shows, from the source after its tag."""
        if "multiple" in values or re.fullmatch(r"0*([2-9]|[1-9]\d+)", values.get("size", "")):
            self.options.append((0, None))
            return
        found = [own for _, _, closing, name, own, _, _ in tags(source, at, end) if name == "option" and not closing]
        chosen = [i for i, own in enumerate(found) if "selected" in own]
        enabled = [i for i, own in enumerate(found) if "disabled" not in own]
        self.options.append((0, chosen[-1] if chosen else enabled[0] if enabled else -1))

    def _indent(self, more: int) -> str:
        """Indent further, and return what it was."""
        before = self.sink.indent
        if len(before) + more <= self.layout.indent:
            self.sink.indent = before + " " * more
        return before

    def _enter(self, tag: str, values: dict[str, str], count: int) -> object:
        if tag in ("ul", "menu", "dir"):
            self.lists.append(None)
        elif tag == "ol":
            down = "reversed" in values
            start = values.get("start", "")
            self.lists.append((int(start) if re.fullmatch(r"-?\d{1,9}", start) else count if down else 1, -1 if down else 1))
        elif tag == "li":
            mark = "- "
            if self.lists and self.lists[-1] is not None:
                number, step = self.lists[-1]
                if re.fullmatch(r"-?\d{1,9}", values.get("value", "")):
                    number = int(values["value"])
                mark = f"{number}. "
                self.lists[-1] = (number + step, step)
            before = self._indent(len(mark))
            self.sink.mark = mark
            return before
        elif tag in ("dd", "blockquote"):
            return self._indent(2)
        elif tag in ("pre", "listing", "xmp", "textarea"):
            self.pre += 1
            self.fresh_pre = True
        elif tag == "table":
            # One too deep is there, but not laid out.
            self.tables.append((Table(self.layout) if len(self.tables) < self.layout.tables else None, self.sink))
        elif tag in ("tr", "td", "th") and self.tables and self.tables[-1][0] is None:
            self.sink.text(" ")
        elif tag == "tr" and self.tables:
            self.tables[-1][0].row()
        elif tag in ("td", "th") and self.tables:
            self.sink = Sink()
            spans = [values.get(k, "1") for k in ("colspan", "rowspan")]
            return tuple(min(self.layout.span, max(1, int(s))) if re.fullmatch(r"\d{1,9}", s) else 1 for s in spans), self.lists, self.pre
        elif tag == "q":
            self.text('"')
        return None

    def end(self, tag: str) -> None:
        border = frozenset() if tag in ("table", "body", "html") else ONLY_TABLE if tag in ("td", "th", "tr", "tbody", "thead", "tfoot", "caption") else CELLS
        at = self.at[tag][-1] if self.at[tag] else -1
        if at >= 0 and at >= self._nearest(border):
            self._close_until(at)

    def _nearest(self, border: frozenset[str]) -> int:
        """Where in the stack the innermost of some tags is, or -1."""
        return max((self.at[t][-1] for t in border if self.at[t]), default=-1)

    def _close_within(self, shut: frozenset[str], border: frozenset[str]) -> None:
        """Close the outermost element of ``shut`` above the nearest of ``border``."""
        some = [self.at[t] for t in shut if self.at[t]]
        if some:
            nearest = self._nearest(border)
            inside = [own[i] for own in some if (i := bisect_right(own, nearest)) < len(own)]
            if inside:
                self._close_until(min(inside))

    def _close_until(self, depth: int) -> None:
        while len(self.open) > depth:
            tag, gone, undo, around = self.open.pop()
            self.at[tag].pop()
            self.foreign.pop()
            self.gone -= gone
            if tag == "select" and self.options:
                self.options.pop()
            if tag == "q" and not self.gone and not gone:
                self.text('"')
            self.hidden = around
            if self.gone or gone:
                continue
            if tag in ("ul", "ol", "menu", "dir") and self.lists:
                self.lists.pop()
                self.sink.break_lines(1 if self.lists else 2)
            elif tag in ("li", "dd", "blockquote"):
                self.sink.indent, self.sink.mark = undo or "", ""
                self.sink.break_lines(2 if tag == "blockquote" else 1)
            elif tag in ("pre", "listing", "xmp", "textarea"):
                self.pre -= 1
                self.fresh_pre = False
                self.sink.break_lines(1 if tag == "textarea" else 2)
            elif tag == "text":
                self.sink.break_lines(1)
            elif tag in ("td", "th") and self.tables and undo:
                (across, down), self.lists, self.pre = undo
                text = self.sink.result()
                self.tables[-1][0].cell(text, across, down)
                self.sink = self.tables[-1][1]
            elif tag == "table" and self.tables:
                table, self.sink = self.tables.pop()
                lines = table.lines() if table else []
                if any(lines):
                    self.sink.break_lines(2)
                    self.sink.lines(lines)
                self.sink.break_lines(2)
            elif tag in BLOCK:
                self.sink.break_lines(2 if tag in PARAGRAPH else 1)


def _items_of_reversed(source: str) -> Iterator[int]:
    """Items of each list that counts down, in the order of their start tags."""
    counts: list[list[int]] = []
    inside: list[list[int]] = []  # of each open list, where its items are counted
    for kind, _, closing, name, values, _, _ in tags(source, 0, len(source)):
        if kind != "tag" or name not in ("ol", "ul", "li"):
            continue
        if name == "li":
            if inside and not closing:
                inside[-1][0] += 1
        elif closing:
            if inside:
                inside.pop()
        else:
            inside.append([0])
            if name == "ol" and "reversed" in values:
                counts.append(inside[-1])
    return (n for (n,) in counts)


def render(page: str | None, layout: Layout = Layout()) -> str:
    """All visible text of a page."""
    out = Page(layout)
    source = page or ""
    if "reversed" in source:
        out.counts = _items_of_reversed(source)
    done = 0
    found = tags(source, 0, len(source))
    jump = None
    while True:
        try:
            kind, at, closing, tag, values, closed, stop = found.send(jump)
        except StopIteration:
            break
        jump = None
        out.text(source[done:at])
        done = stop
        if kind == "cdata" and out.foreign and out.foreign[-1]:
            end = source.find("]]>", at)
            done = jump = end + 3 if end >= 0 else len(source)
            out.text(html.escape(source[at + 9 : end if end >= 0 else done]))
        elif kind == "tag" and closing:
            out.end(tag)
        elif kind == "tag":
            opened = out.start(tag, values, closed)
            if tag == "select":
                end = END_SELECT.search(source, stop)
                out.select(values, source, stop, end.start() if end else len(source))
            if tag in RAW and opened:
                end = _end_of(tag).search(source, stop)
                inside = source[stop : end.start() if end else len(source)]
                if tag == "style" and not (out.at["template"] or out.at["noscript"]) and is_sheet(values):
                    out.styles.sheet(inside)
                out.text(inside)
                done = len(source)
                if end and (close := source.find(">", end.end())) >= 0:
                    done = close + 1
                jump = done
                out.end(tag)
    out.text(source[done:])
    out._close_until(0)
    return out.sink.result()


@lru_cache(maxsize=None)
def _end_of(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])", re.I)


def extract_text(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", layout: Layout = Layout()) -> DataFrame:
    """``id_col`` and ``text``, what is visible of each page."""
    narrow = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html"))

    def batch_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (render(page, layout) for page in (x.as_py() for x in batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    schema = T.StructType([narrow.schema["id"], T.StructField("text", T.StringType())])
    return narrow.mapInArrow(batch_text, schema).withColumnRenamed("id", id_col)
