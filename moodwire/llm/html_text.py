"""Layout-aware text of HTML pages: a small tree builder and a renderer.

The builder opens and closes what HTML implies (paragraphs, list items, rows, cells, options, terms),
ignores stray end tags and closes what is left open. The renderer walks the tree without recursion and
emits all visible text: white space collapses except in ``pre``; blocks stand on lines of their own,
paragraphs, headings, lists and tables apart by a blank line; items are marked and indented by
their nesting; table cells are padded to the width of their column (cells over ``WIDE`` characters do not
widen it). Not visible are scripts, styles, templates, titles, comments, elements with ``hidden``,
``display: none`` or ``visibility: hidden``, hidden inputs, and fallback content such as ``noscript``.
A head ends at its end tag or at the first tag or text that may not stand in it. In ``svg`` and ``math``
``/>`` ends an element and a tag of HTML ends the drawing or formula. Shown are all text of formulas save
annotations and phantoms, and of drawings ``text`` and ``foreignObject``, not what is only defined there
(``defs``, ``symbol``; a ``use`` of it is not followed) and of a ``switch`` the first child without conditions.
Pages are independent of each other: no shuffle, a page's tree is as large as the page, and the time it takes
is linear in it: tags find what they end by depth, and indentation stops at ``DEEPEST`` characters.

Defined cases: a null or empty page has the empty text. Bytes that are not UTF-8 are read as U+FFFD. Unclosed comments, tags, quotes and raw elements
run to the end of the page or, if that is no tag at all, are text. Repeated rows are each rendered.
Other columns are kept; one named like the result is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters of a cell from which on it no longer widens its column.
WIDE = 40
#: Characters of indentation from which on deeper lists are not moved further to the right.
DEEPEST = 40

# Fixed values of HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style title textarea xmp iframe noembed noframes".split())
UNSEEN = set(
    "script style title template noscript iframe noembed noframes object audio video canvas "
    "datalist head".split()
)
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section summary table ul caption".split()
)
APART = set("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu".split())
LISTS = {"ul", "ol", "menu"}
CLOSES_P = (BLOCKS | {"xmp"}) - {"html", "body", "caption", "option", "optgroup", "legend"}
#: A start tag ends open elements of the first set that are not beyond one of the second.
ENDS = {
    "li": ({"li"}, LISTS),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th", "caption"}, {"tr", "table"}),
    "th": ({"td", "th", "caption"}, {"tr", "table"}),
    "tr": ({"tr", "caption"}, {"table"}),
    **{t: ({"thead", "tbody", "tfoot", "tr", "caption"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
}
CELLS = {"td", "th"}
#: Tags that leave a head open.
IN_HEAD = set(
    "head html base basefont bgsound link meta title noscript noframes style script template".split()
)
#: Tags of HTML that end open drawings and formulas.
BREAKOUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing "
    "menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split()
)
#: Elements of drawings and formulas that hold HTML.
POINTS = {"svg": {"foreignobject", "desc", "title"}, "math": {"mi", "mo", "mn", "ms", "mtext"}}
FOREIGN_UNSEEN = {
    "svg": set(
        "title desc metadata defs symbol clippath mask marker pattern lineargradient radialgradient filter "
        "style script".split()
    ),
    "math": {"annotation", "annotation-xml", "mphantom", "style", "script"},
}
#: Children of these stand apart.
SPACED = {"mfrac", "mroot", "mtable", "mtr"}
#: No end tag or implied end reaches beyond these, save their own.
WALLS = {"td", "th", "caption", "table", "template", "html"}
OVER_WALLS = {"table", "tr", "tbody", "thead", "tfoot", "html", "body"}

_TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|</(?P<end>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)"
    r"""|<(?P<start>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<odd>[a-zA-Z][^\s/>]*)(?P<rest>[^>]*)>"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
#: A last slash that belongs to a value without quotes.
_VALUE_SLASH = re.compile(r"""=\s*[^\s"']*/\Z""")
_BLANK = re.compile(r"[ \t\n\r\f]+")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for t in RAW}


class Node:
    """``space``: svg, math or, for HTML, empty; ``shows``: text right inside can be seen."""

    __slots__ = ("tag", "attrs", "children", "space", "shows")

    def __init__(self, tag: str, attrs: dict[str, str], space: str = "", shows: bool = True):
        self.tag, self.attrs, self.children, self.space, self.shows = tag, attrs, [], space, shows

    def holds_html(self) -> bool:
        if not self.space or self.tag in POINTS[self.space]:
            return True
        kind = self.attrs.get("encoding", "").lower() if self.tag == "annotation-xml" else ""
        return kind in ("text/html", "application/xhtml+xml")


class Builder:
    """Tokens to a tree of nodes and strings."""

    def __init__(self):
        self.root = Node("#page", {})
        self.open = [self.root]
        # Depths of the open elements by tag, of drawings and formulas, and of what ends the search for a start tag,
        # so that a tag finds what it ends without walking through all that is open.
        self.depths: dict[str, list[int]] = defaultdict(list)
        self.foreign, self.points, self.walls = [], [], []

    def _enter(self, node: Node) -> None:
        for depths in self._kinds(node):
            depths.append(len(self.open))
        self.open.append(node)

    def _kinds(self, node: Node) -> list[list[int]]:
        found = [self.depths[node.tag]]
        if node.space:
            found.append(self.foreign)
            if node.holds_html():
                found.append(self.points)
        elif node.tag in WALLS:
            found.append(self.walls)
        return found

    def _pop(self, depth: int) -> None:
        while len(self.open) > depth:
            for depths in self._kinds(self.open.pop()):
                depths.pop()

    def _depth(self, tags: set[str], stop: set[str]) -> int:
        """Depth of the outermost open element of ``tags`` within ``stop``; 0 if there is none."""
        deepest = lambda depths: depths[-1] if depths else 0
        own = [d for t in tags if (d := self.depths.get(t))]
        if not own:
            return 0
        bound = max([deepest(self.foreign), *[deepest(self.depths.get(t)) for t in stop - tags]])
        within = [d[k] for d in own if (k := bisect_right(d, bound)) < len(d)]
        return min(within, default=0)

    def _push(self, tag: str, attrs: dict[str, str]) -> Node:
        node = Node(tag, attrs)
        self.open[-1].children.append(node)
        if tag not in VOID:
            self._enter(node)
        return node

    def _foreign(self, tag: str, attrs: dict[str, str], space: str, closed: bool) -> None:
        """An element of a drawing or formula."""
        up = self.open[-1]
        shows = space == "math" or tag in ("text", "foreignobject")
        if up.space == space == "svg" and up.tag != "foreignobject":
            shows |= up.shows
        if up.space and up.tag in SPACED and up.children:
            up.children.append(" ")
        node = Node(tag, attrs, space, shows)
        up.children.append(node)
        if not closed:
            self._enter(node)

    def _break_out(self) -> None:
        """End open drawings and formulas up to an element that holds HTML."""
        k = len(self.open)
        while not self.open[k - 1].holds_html():
            k -= 1
        self._pop(k)

    def _in_head(self) -> bool:
        return self.open[-1].tag == "head" and not self.open[-1].space

    def start(self, tag: str, attrs: dict[str, str], closed: bool = False) -> bool:
        """Whether an element of HTML begins; ``closed``: the tag ends in a slash."""
        top = self.open[-1]
        if top.space and not (
            top.holds_html() and tag not in ("mglyph", "malignmark") or top.tag == "annotation-xml" and tag == "svg"
        ):
            if tag not in BREAKOUT and not (tag == "font" and attrs.keys() & {"color", "face", "size"}):
                self._foreign(tag, attrs, top.space, closed)
                return False
            self._break_out()
        if self._in_head() and tag not in IN_HEAD:
            self._pop(len(self.open) - 1)
        if tag in ("svg", "math"):
            self._foreign(tag, attrs, tag, closed)
            return False
        if tag == "html" and (self.depths["html"] or self._in_head()):
            whole = next((n for n in self.open if n.tag == "html"), self.root)
            whole.attrs = attrs | whole.attrs
            return False
        if tag == "head" and any(n.tag not in ("#page", "html") for n in self.open):
            return False
        if tag in CLOSES_P and (k := self._depth({"p"}, WALLS)):
            self._pop(k)
        if tag in ENDS and (k := self._depth(*ENDS[tag])):
            self._pop(k)
        if tag in CELLS and self.open[-1].tag != "tr":
            self._push("tr", {})
        self._push(tag, attrs)
        return True

    def text(self, text: str) -> None:
        if self._in_head() and text.strip(" \t\n\r\f"):
            self._pop(len(self.open) - 1)
        if self.open[-1].shows:
            self.open[-1].children.append(text)

    def end(self, tag: str) -> None:
        if tag in ("p", "br"):
            self._break_out()
        if self._in_head():
            if tag in ("body", "html", "br"):
                self._pop(len(self.open) - 1)
            elif tag != "head":
                return None
        if tag == "br" or tag == "p" and not self.depths["p"]:
            self._push(tag, {})
            self.open[-1].tag == "p" and self._pop(len(self.open) - 1)
        elif self.depths[tag]:
            depth = self.depths[tag][-1]
            if self.points and self.points[-1] > depth:
                return None
            if self.walls and self.walls[-1] > depth and tag not in OVER_WALLS:
                return None
            self._pop(depth)
        return None

    def feed(self, page: str) -> Node:
        at, n = 0, len(page)
        while at < n:
            m = _TOKEN.match(page, at)
            at = m.end()
            kind = m.lastgroup
            if kind == "text":
                self.text(html.unescape(m[0]))
            elif kind == "cdata":
                self.open[-1].space and self.text(m["cdata"])
            elif kind == "end":
                self.end(m["end"].lower())
            elif kind in ("attrs", "rest"):
                tag, raw = (m["start"] or m["odd"]).lower(), m["attrs"] or m["rest"] or ""
                closed = raw.endswith("/") and not _VALUE_SLASH.search(raw)
                if self.start(tag, _attrs(raw) if raw and not raw.isspace() else {}, closed) and tag in RAW:
                    close = _RAW_END[tag].search(page, at)
                    inside = page[at : close.start() if close else n]
                    if tag not in UNSEEN:
                        self.open[-1].children.append(html.unescape(inside) if tag == "textarea" else inside)
                    at = close.end() if close else n
                    self._pop(len(self.open) - 1)
        return self.root


def _attrs(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(raw):
        if value[:1] in ("'", '"'):
            value = value[1:-1]
        out.setdefault(name.lower(), html.unescape(value))
    return out


def visible(node: Node) -> bool:
    if node.tag in (FOREIGN_UNSEEN[node.space] if node.space else UNSEEN) or "hidden" in node.attrs:
        return False
    if node.space == "svg" and (
        node.attrs.get("display") == "none" or node.attrs.get("visibility") in ("hidden", "collapse")
    ):
        return False
    if node.tag == "input" and node.attrs.get("type", "").lower() == "hidden":
        return False
    return not _NOT_SHOWN.search(node.attrs.get("style", "")) if node.attrs else True


class Flow:
    """Lines of text under way."""

    def __init__(self):
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap, self.blank, self.marker, self.indent = 0, True, "", ""

    def inline(self, text: str) -> None:
        text = _BLANK.sub(" ", text)
        if self.blank:
            text = text.lstrip(" ")
        if text:
            self.now.append(text)
            self.blank = text[-1] == " "

    def verbatim(self, text: str) -> None:
        for k, line in enumerate(text.replace("\r\n", "\n").split("\n")):
            if k:
                self.line(keep=True)
            if line:
                self.now.append(line)
                self.blank = False

    def line(self, keep: bool = False) -> None:
        """End the line; ``keep``: also an empty one."""
        text = "".join(self.now).rstrip()
        if text or keep:
            if self.lines:
                self.lines += [""] * max(0, self.gap - 1)
            self.lines.append(self.indent + self.marker + text if text else "")
            if self.marker:
                self.marker = " " * len(self.marker)
            self.gap = 0
        self.now, self.blank = [], True

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def text(self) -> str:
        self.line()
        return "\n".join(self.lines).strip("\n")


def rendered(page: str | None) -> str:
    """The visible text of a page."""
    flow, flows, tables, lists, pre = Flow(), [], [], [], 0
    stack: list[tuple] = [(Builder().feed(page or ""), False)]
    while stack:
        node, leaving = stack.pop()
        if isinstance(node, str):
            flow.verbatim(node) if pre else flow.inline(node)
            continue
        tag = "" if node.space else node.tag
        if not leaving:
            if not visible(node):
                continue
            stack.append((node, True))
            stack.extend((child, False) for child in reversed(_shown(node)))
        if node.space == "svg" and node.tag in ("text", "foreignobject"):
            flow.inline(" ")
        gap = 0 if tag not in BLOCKS else 2 if tag in APART and not (tag in LISTS and lists[leaving:]) else 1
        if tag == "br":
            leaving or flow.line(keep=bool(flow.now))
        elif tag in ("pre", "textarea"):
            flow.block(gap)
            pre += -1 if leaving else 1
        elif tag in LISTS:
            flow.block(gap)
            if leaving:
                flow.indent, flow.marker = lists.pop()[1:]
            else:
                lists.append([_number(node) if tag == "ol" else None, flow.indent, flow.marker])
                flow.indent, flow.marker = (flow.indent + " " * len(flow.marker))[:DEEPEST], ""
        elif tag == "li":
            flow.block(gap)
            if not leaving:
                number = lists[-1][0] if lists else None
                flow.marker = "- " if number is None else f"{number}. "
                if number is not None:
                    lists[-1][0] += 1
            else:
                flow.marker = ""
        elif tag == "table":
            flow.block(gap)
            if not leaving:
                tables.append([])
            else:
                for line in _aligned(tables.pop()):
                    flow.now = [line]
                    flow.line()
                flow.gap = max(flow.gap, gap)
        elif tag == "tr" and tables:
            leaving or tables[-1].append([])
        elif tag in CELLS and tables and tables[-1]:
            if not leaving:
                flows.append((flow, lists, pre))
                flow, lists, pre = Flow(), [], 0
            else:
                text = " ".join(line.strip() for line in flow.text().split("\n") if line.strip())
                flow, lists, pre = flows.pop()
                span = node.attrs.get("colspan", "1").strip()
                tables[-1][-1].append((text, min(1000, max(1, int(span))) if span.isascii() and span.isdigit() else 1))
        elif gap:
            flow.block(gap)
        elif tag == "img" and not leaving and node.attrs.get("alt", "").strip():
            flow.inline(node.attrs["alt"])
        elif tag == "input" and not leaving and node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
            flow.inline(node.attrs.get("value", ""))
    return flow.text()


def _shown(node: Node) -> list:
    if node.space == "svg" and node.tag == "switch":
        free = (
            c
            for c in node.children
            if isinstance(c, Node) and not c.attrs.keys() & {"requiredextensions", "systemlanguage"}
        )
        return [c for c in [next(free, None)] if c]
    return node.children


def _number(node: Node) -> int:
    start = node.attrs.get("start", "").strip()
    return int(start) if re.fullmatch(r"-?[0-9]{1,9}", start) else 1


def _aligned(rows: list[list[tuple[str, int]]]) -> list[str]:
    """Rows of cells as lines; a cell over several columns takes their width together."""
    width: Counter[int] = Counter()
    for row in rows:
        at = 0
        for text, span in row:
            if span == 1 and len(text) <= WIDE:
                width[at] = max(width[at], len(text))
            at += span
    lines = []
    for row in rows:
        at, parts = 0, []
        for text, span in row:
            whole = sum(width[k] for k in range(at, at + span)) + 3 * (min(span, len(width) - at) - 1)
            parts.append(text.ljust(whole) if span == 1 or len(text) <= WIDE else text)
            at += span
        line = " | ".join(parts).rstrip()
        if line.strip(" |"):
            lines.append(line)
    return lines


def extract(pages: DataFrame, html_column: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the visible text of ``html_column`` in ``into``."""
    kept = [f for f in pages.schema.fields if f.name not in (into, html_column)]
    if not kept:
        raise ValueError("the table needs a column besides the page")
    row = F.struct(*[F.col(f"`{f.name}`") for f in kept])

    def run(batches):
        for batch in batches:
            pages = ((p.as_py() or b"").decode("utf-8", "replace") for p in batch.column("page"))
            texts = [rendered(p) for p in pages]
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(texts, pa.string())], names=["row", into]
            )

    out = T.StructType([T.StructField("row", T.StructType(kept)), T.StructField(into, T.StringType())])
    page = F.col(f"`{html_column}`").cast("binary").alias("page")
    return pages.select(row.alias("row"), page).mapInArrow(run, out).select("row.*", into)
