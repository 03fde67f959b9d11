"""Layout-aware text of HTML pages.

A tree is built with implied and implicitly closed tags, then rendered: hidden
and non-rendered elements give nothing, blocks stand on lines of their own with
the blank lines their margins ask for, lists have bullets or numbers, table
cells are aligned in columns, and preformatted text keeps its white space.
"""

from __future__ import annotations

import re
import sys
from hashlib import sha256
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import bounded_batches, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("head script style template noscript title meta link base datalist iframe noembed noframes object audio video canvas source track param area annotation annotation-xml".split())
FOREIGN = frozenset(("svg", "math"))
UNDRAWN = frozenset("desc defs metadata symbol".split())  # parts of svg without a rendering
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre blockquote table figure fieldset form hr menu xmp".split())
BLOCK = SPACED | frozenset("html body address article aside center dd details dialog dir div dt figcaption footer header hgroup legend li main nav optgroup option search section summary tr caption".split())
#: start tag -> open tags that it closes, as far up as the boundary tags
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tr": ({"tr", "caption", "colgroup"}, {"table", "tbody", "thead", "tfoot"}),
    "tbody": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "caption", "colgroup"}, {"table"}), "rt": ({"rt", "rp"}, {"ruby"}), "rp": ({"rt", "rp"}, {"ruby"}),
}
ENDS_P = BLOCK - {"html", "body", "option", "optgroup", "tr", "caption", "legend"}
SCOPE = frozenset("table td th caption button object html template".split())
DEEPEST = 20_000
DEEP = 400  # elements nested deeper become siblings, as in browsers; their text stays
COLUMNS, LINE = 256, 400  # columns that are aligned, and the last place in a line at which a column starts
# possessive throughout: a tag is read once, whatever it holds
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+|[\"'])*+)>")
OPENS_TAG = re.compile(r"</?[a-zA-Z]")
COMMENT_END = re.compile(r"--!?>")
ATTR = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?+")
STYLE = re.compile(r"(?:^|;)\s*+(display|visibility|content-visibility)\s*+:\s*+([a-z-]+)", re.I)
SPACE = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("tag", "attrs", "kids")

    def __init__(self, tag, attrs=None):
        self.tag, self.attrs, self.kids = tag, attrs or {}, []


def parse(html: str) -> Node:
    """The tree of a page; strings are text."""
    root = Node("html")
    open_, at, seek = [root], 0, 0
    raw_end: dict[str, re.Pattern] = {}

    def text(s):
        if s:
            open_[-1].kids.append(unescape(s) if "&" in s else s)

    def close(tags, bounds):
        for i in range(len(open_) - 1, 0, -1):
            t = open_[i].tag
            if t in tags:
                del open_[i:]
                return True
            if t in bounds:
                return False
        return False

    def after(end):
        return len(html) if end < 0 else end + 1

    while (lt := html.find("<", seek)) >= 0:
        if not OPENS_TAG.match(html, lt):
            if html[lt + 1 : lt + 2] not in ("!", "?", "/"):  # text, with what follows
                seek = lt + 1
                continue
            text(html[at:lt])
            if html.startswith("<!--", lt):
                end = COMMENT_END.search(html, lt + 2)
                at = seek = end.end() if end else len(html)
            else:
                at = seek = after(html.find(">", lt))
            continue
        text(html[at:lt])
        m = TAG.match(html, lt)
        if not m:  # the page ends inside a tag
            at = len(html)
            break
        at = m.end()
        tag = m[2]
        if tag:
            tag = tag.lower()
            if m[1]:
                if tag == "p" and not any(n.tag == "p" for n in open_):
                    open_[-1].kids.append(Node("p"))
                elif tag == "br":
                    open_[-1].kids.append(Node("br"))
                elif tag not in ("html", "body"):
                    close({tag}, {"table"} if tag not in ("table", "tbody", "thead", "tfoot", "tr", "td", "th") else {"table"} - {tag})
            else:
                attrs = {}
                if m[3] and not m[3].isspace():
                    for a in ATTR.finditer(m[3]):
                        v = a[2] or ""
                        attrs.setdefault(a[1].lower(), unescape(v[1:-1] if v[:1] in "\"'" and v else v))
                if tag == "html":
                    root.attrs = attrs | root.attrs
                elif not (tag == "body" and any(n.tag == "body" for n in open_)):
                    if tag in CLOSES:
                        close(*CLOSES[tag])
                        if tag in ("td", "th") and open_[-1].tag in ("table", "tbody", "thead", "tfoot"):
                            open_[-1].kids.append(row := Node("tr"))
                            open_.append(row)
                    if tag in ENDS_P or tag == "body":
                        close({"p"}, SCOPE)
                    if tag == "body" or tag in ENDS_P:
                        close({"head"}, {"body"})
                    if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and open_[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
                        open_.pop()
                    if tag == "a":
                        close({"a"}, SCOPE)
                    node = Node(tag, attrs)
                    open_[-1].kids.append(node)
                    if m[3].endswith("/") and (tag in FOREIGN or any(n.tag in FOREIGN for n in open_)):
                        pass  # closes itself
                    elif tag in RAW:
                        end = raw_end.get(tag) or raw_end.setdefault(tag, re.compile(f"</{tag}(?=[\\s/>])[^>]*>?", re.I))
                        stop = end.search(html, at)
                        inner = html[at : stop.start() if stop else len(html)]
                        node.kids.append(unescape(inner) if tag in ("textarea", "title") else inner)
                        at = stop.end() if stop else len(html)
                    elif tag not in VOID and len(open_) < DEEP:
                        open_.append(node)
        seek = at
    text(html[at:])
    return root


def styled(node: Node) -> dict[str, str]:
    return {k.lower(): v.lower() for k, v in STYLE.findall(node.attrs["style"])} if "style" in node.attrs else {}


def gone(node: Node, drawn: bool) -> bool:
    """Whether neither the element nor anything in it is shown; drawn says that it is inside an svg."""
    a = node.attrs
    if node.tag in UNSEEN or node.tag == "input" or drawn and node.tag in UNDRAWN:
        return True
    if not a:
        return False
    if "hidden" in a or "popover" in a or node.tag == "dialog" and "open" not in a:
        return True
    style = styled(node)
    return style.get("display") == "none" or style.get("content-visibility") == "hidden"


def seen(node: Node, inherited: bool) -> bool:
    """Visibility is inherited, and a descendant may take it back."""
    v = styled(node).get("visibility") if node.attrs else None
    return inherited if v is None or v == "inherit" else v not in ("hidden", "collapse")


class Page:
    """Lines of rendered text; margins between blocks collapse."""

    def __init__(self):
        self.lines: list[str] = []
        self.here: list[str] = []
        self.gap = 0
        self.indent = ""
        self.lead = ""  # a bullet that waits for its first line

    def inline(self, s: str) -> None:
        s = SPACE.sub(" ", s)
        if s == " " or s[:1] == " ":
            if not self.here or self.here[-1][-1:] in (" ", "\n"):
                s = s[1:]
        if s:
            self.here.append(s)

    def line(self, force: bool = False) -> None:
        s = "".join(self.here).strip(" ")
        self.here = []
        if s or force:
            self.put(s)

    def put(self, s: str) -> None:
        if self.gap and self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        lead, self.lead = self.lead, ""
        indent = self.indent[: len(self.indent) - len(lead)] + lead if lead else self.indent
        self.lines.append((indent + s).rstrip() if s else "")

    def block(self, gap: int) -> None:
        self.line()
        self.gap = max(self.gap, gap)


def number_of(text: str, other: int) -> int:
    return int(text) if re.fullmatch(r"-?\d{1,9}", text) else other


def render(node: Node, page: Page, pre: bool = False, listed: int = 0, visible: bool = True, drawn: bool = False) -> None:
    number, step = None, 1
    kids = node.kids
    if node.tag == "ol":
        if "reversed" in node.attrs:
            step = -1
        number = number_of(node.attrs.get("start", ""), 1 if step > 0 else sum(isinstance(k, Node) and k.tag == "li" for k in kids))
    elif node.tag == "details" and "open" not in node.attrs:  # closed: its summary alone
        kids = [k for k in kids if isinstance(k, Node) and k.tag == "summary"][:1]
    for kid in kids:
        if isinstance(kid, str):
            if not visible:
                continue
            if pre:
                first, *rest = kid.split("\n")
                page.here.append(first)
                for r in rest:
                    s, page.here = "".join(page.here), [r]
                    page.put(s)
            else:
                page.inline(kid)
            continue
        tag = kid.tag
        if gone(kid, drawn):
            continue
        shown, inside = seen(kid, visible), drawn or tag == "svg"
        if tag == "br":
            page.line(visible)
        elif tag == "hr":
            page.block(1)
        elif tag == "table":
            page.block(1)
            for s in table_lines(kid, shown):
                page.put(s)
            page.block(1)
        elif tag in ("pre", "xmp", "textarea"):
            page.block(1)
            if kid.kids and isinstance(kid.kids[0], str):
                kid.kids[0] = kid.kids[0].removeprefix("\n")
            render(kid, page, True, listed, shown, inside)
            s, page.here = "".join(page.here), []
            if s:
                page.put(s)
            page.block(1)
        elif tag == "li":
            page.block(0)
            before = page.indent
            if number is None:
                lead = "- "
            else:
                number = number_of(kid.attrs.get("value", ""), number)
                lead, number = f"{number}. ", number + step
            page.indent = before + " " * len(lead)
            page.lead = lead if shown else ""
            render(kid, page, pre, listed, shown, inside)
            page.block(0)
            page.indent, page.lead = before, ""
        elif drawn and tag == "text":
            page.block(0)
            render(kid, page, pre, listed, shown, inside)
            page.block(0)
        elif tag in BLOCK:
            gap = 1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and listed) else 0
            page.block(gap)
            before = page.indent
            if tag in ("blockquote", "dd"):
                page.indent += "  "
            render(kid, page, pre, listed + (tag in ("ul", "ol", "menu")), shown, inside)
            page.block(gap)
            page.indent = before
        elif tag == "q" and shown:
            page.inline("“")
            render(kid, page, pre, listed, shown, inside)
            page.inline("”")
        else:
            render(kid, page, pre, listed, shown, inside)


def lines_of(node: Node, visible: bool = True) -> list[str]:
    page = Page()
    render(node, page, visible=visible)
    page.block(0)
    return page.lines


def table_rows(node: Node, visible: bool) -> tuple[list[str], list[list[tuple[Node, bool]]]]:
    """Lines that come before the table (its caption, then text between rows), and its rows of cells, each with its visibility.

    The first head stands above and the first foot below all other rows.
    """
    before: list[str] = []
    loose = Node("div")
    head: list | None = None
    foot: list | None = None
    body: list = []

    def gather(n, into, visible):
        nonlocal head, foot
        for kid in n.kids:
            if isinstance(kid, str):
                if not kid.isspace():
                    loose.kids.append(kid)
                continue
            if gone(kid, False) or kid.tag in ("colgroup", "col"):
                continue
            shown = seen(kid, visible)
            if kid.tag == "caption":
                before.extend(lines_of(kid, shown))
            elif kid.tag in ("thead", "tbody", "tfoot"):
                to = into
                if kid.tag == "thead" and head is None:
                    to = head = []
                elif kid.tag == "tfoot" and foot is None:
                    to = foot = []
                gather(kid, to, shown)
            elif kid.tag == "tr":
                cells, stray = [], Node("td")
                for c in kid.kids:
                    if isinstance(c, Node) and c.tag in ("td", "th"):
                        if not gone(c, False):
                            cells.append((c, seen(c, shown)))
                    elif not (isinstance(c, str) and c.isspace()):
                        stray.kids.append(c)
                into.append(cells + [(stray, shown)] * bool(stray.kids))
            else:
                stray = Node("td")
                stray.kids = [kid]
                into.append([(stray, visible)])

    gather(node, body, visible)
    if loose.kids:
        before.extend(lines_of(loose, visible))
    return before, [*(head or []), *body, *(foot or [])]


def table_lines(node: Node, visible: bool = True) -> list[str]:
    """A table's caption, then rows whose cells start at their columns' places, two spaces apart.

    Columns after the COLUMNS-th follow each other unaligned, and no column
    starts beyond LINE, so that a wide table stays about as long as its text.
    """
    out, rows = table_rows(node, visible)
    grid, until = [], [0] * COLUMNS  # until: the row up to which a column is taken from above
    for r, cells in enumerate(rows):
        line, col = [], 0
        for c, shown in cells:
            while col < COLUMNS and until[col] > r:
                col += 1
            wide = min(max(number_of(c.attrs.get("colspan", ""), 1), 1), 1000)
            tall = number_of(c.attrs.get("rowspan", ""), 1) or 65534
            line.append((col, wide, lines_of(c, shown)))
            if tall > 1:
                for k in range(col, min(col + wide, COLUMNS)):
                    until[k] = r + tall
            col += wide
        grid.append(line)
    width = [0] * COLUMNS
    last = 0
    for line in grid:
        for col, wide, text in line:
            if col < COLUMNS:
                last = max(last, min(col + wide, COLUMNS))
                if wide == 1:
                    width[col] = max(width[col], max(map(len, text), default=0))
    for line in grid:
        for col, wide, text in line:
            end = min(col + wide, COLUMNS)
            if wide > 1 and col < COLUMNS and text:
                lack = max(map(len, text)) - sum(width[col:end]) - 2 * (end - col - 1)
                if lack > 0:
                    width[end - 1] += lack
    starts, at = [], 0
    for w in width[:last]:
        starts.append(min(at, LINE))
        at += w + 2 * (w > 0)
    for line in grid:
        shown: dict[int, list[tuple[int, str]]] = {}
        for col, _, text in line:
            for k, t in enumerate(text):
                if t:
                    shown.setdefault(k, []).append((col, t))
        for k in range(max((len(t) for _, _, t in line), default=0)):
            parts, at = [], 0
            for col, t in shown.get(k, []):
                pad = max((starts[col] if col < last else 0) - at, 2 if at else 0)
                parts += [" " * pad, t]
                at += pad + len(t)
            out.append("".join(parts))
    return out


def extract(html: str | None) -> str:
    """All visible text of a page; empty for null, empty or wholly hidden pages."""
    if sys.getrecursionlimit() < DEEPEST:  # a table in a cell costs some calls a level, none of them on the C stack
        sys.setrecursionlimit(DEEPEST)
    lines = lines_of(parse((html or "").replace("\0", "").replace("\r\n", "\n").replace("\r", "\n")))
    while lines and not lines[-1]:
        lines.pop()
    while lines and not lines[0]:
        lines.pop(0)
    return "\n".join(lines).replace("\xa0", " ")


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, text, n_lines, text_sha256 for every row of pages (page_id, html).

    A null or empty page gives an empty text.  Pages of any length are read
    whole; broken markup never fails; repeated rows repeat; extra columns are
    ignored; an empty table gives no rows.
    """
    id_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        for b in batches:
            texts = [extract(x.as_py()) for x in b.column("html")]
            yield pa.RecordBatch.from_arrays(
                [b.column("page_id"), pa.array(texts, pa.string()), pa.array([t.count("\n") + 1 if t else 0 for t in texts], pa.int64()), pa.array([sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts], pa.string())],
                ["page_id", "text", "n_lines", "text_sha256"],
            )

    return bounded_batches(pages).select("page_id", "html").mapInArrow(run, f"page_id {id_type}, text string, n_lines long, text_sha256 string")


def op6_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
