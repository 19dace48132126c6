"""HTML to laid-out text: a tree builder with implied tags, then rendering of what is visible.

The builder closes elements that HTML closes by implication (p, li, td, option, head ...), ignores stray end tags, and
reads script, style and the like as raw text. What stands in a table outside its cells is laid out before the table.
Rendering drops hidden subtrees, keeps blank lines between blocks, marks list items, keeps preformatted white space, and
pads the cells of a table to equal columns. Neither depends on the depth of the tree: both keep stacks of their own.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

from pyspark.sql import DataFrame

from ledgerline.llm.common import map_rows

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
INVISIBLE = frozenset("head script style template noscript iframe object datalist select option title noembed noframes canvas audio video defs desc metadata symbol annotation annotation-xml rp".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tr ul xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr xmp".split())
#: What may stand in a head; all else ends it.
HEAD = frozenset("base basefont bgsound head html link meta noframes noscript script style template title".split())
#: Parts of a table.
PARTS = frozenset("tr td th thead tbody tfoot".split())
#: An opening tag closes an open element of these, unless one of the limits stands between.
_IMPLIED = {
    "li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "tbody": ("tr td th thead tbody tfoot caption colgroup", "table"), "tfoot": ("tr td th thead tbody tfoot caption colgroup", "table"), "thead": ("caption colgroup tr", "table"),
    "option": ("option", "select"), "optgroup": ("option optgroup", "select"), "body": ("head", "html"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in _IMPLIED.items()}
#: An open p ends where one of these begins.
ENDS_P = BLOCKS - {"body", "html", "legend", "tr"}
_SCOPE = frozenset("table td th caption button html object template".split())
_SPACE = re.compile(r"\s*")
_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TO_VALUE, _BARE = re.compile(r"[^>=]*"), re.compile(r"[^\s>]*")
_ATTR = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})")
#: Nested lists are indented, and tables in cells laid out, to this depth; what lies deeper is shown without either.
LAYOUT = 24
#: Cells up to this length decide how wide a column is. A sparser grid than a cell in so many places isn't padded.
WIDE, SPARSE = 120, 64


class Node:
    """vis: whether visibility is set, to visible (True) or not (False)."""

    __slots__ = ("children", "down", "first", "hidden", "holds", "span", "tag", "vis")

    def __init__(self, tag: str, attrs: str = "") -> None:
        self.tag, self.children, self.hidden, self.vis, self.span, self.down, self.first = tag, [], tag in INVISIBLE or tag == "dialog", None, 1, 1, None
        self.holds = False  # parts of the table around it
        if attrs and not attrs.isspace():
            found: dict[str, str] = {}
            for k, a, b, c in _ATTR.findall(attrs):
                found.setdefault(k.lower(), a or b or c)
            if tag == "dialog":
                self.hidden = "open" not in found
            style = dict(_STYLE.findall(found.get("style", "").lower()))
            if "display" in style:
                self.hidden |= style["display"] == "none"
            else:
                self.hidden |= "hidden" in found
            self.vis = {"visible": True, "hidden": False, "collapse": False}.get(style.get("visibility"))
            self.hidden |= tag == "input" and found.get("type", "").lower() == "hidden"
            number = lambda k: int(m[1]) if (m := _NUMBER.match(found.get(k, ""))) else None
            if tag in ("td", "th"):
                self.span = min(max(number("colspan") or 1, 1), 100)
                down = number("rowspan")
                self.down = 1 if down is None else min(down, 65534) if down > 0 else 65534 * (down == 0) or 1
            elif tag == "ol":
                self.first = number("start")
            elif tag == "li":
                self.first = number("value")


def tag_end(source: str, at: int) -> int:
    """Where the > of a tag is whose attributes begin at `at`, -1 if the page ends first. A > inside a quoted value is none."""
    n = len(source)
    while True:
        at = _TO_VALUE.match(source, at).end()
        if at >= n:
            return -1
        if source[at] == ">":
            return at
        at = _SPACE.match(source, at + 1).end()
        if source[at : at + 1] in ('"', "'"):
            at = source.find(source[at], at + 1) + 1
            if not at:
                return -1
        else:
            at = _BARE.match(source, at).end()


def parse(source: str) -> Node:
    """The tree of a page, in one pass over it. A tag or comment that the page's end cuts off hides what follows it, as in a browser."""
    root = Node("html")
    stack, opened = [root], Counter()

    def cut(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def close(names: frozenset[str], limits: frozenset[str]) -> bool:
        if not any(opened[x] for x in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in names:
                cut(k)
                return True
            if stack[k].tag in limits:
                break
        return False

    def add(text: str) -> None:
        if stack[-1].tag == "head" and not text.isspace():
            cut(len(stack) - 1)
        stack[-1].children.append(text)

    at = held = 0  # text since `held` is not in the tree yet
    while True:
        at = source.find("<", at)
        if at < 0:
            break
        kind, begin = source[at + 1 : at + 2], at
        if kind in ("!", "?"):
            raw = ""
            if source.startswith("<!--", at):
                m = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))", re.S).match(source, at)
                end = m.end()
            elif source.startswith("<![CDATA[", at):
                end = source.find("]]>", at)
                raw, end = source[at + 9 : end if end >= 0 else None], end + 3 if end >= 0 else len(source)
            else:
                end = source.find(">", at) + 1 or len(source)
            if begin > held:
                add(source[held:begin])
            if raw:
                add(html.escape(raw, quote=False))
            at = held = end
            continue
        m = _NAME.match(source, at + 1 + (kind == "/"))
        if m is None:  # a lone < is text
            at += 1
            continue
        if begin > held:
            add(source[held:begin])
        end = tag_end(source, m.end())
        if end < 0:
            held = len(source)
            break
        tag, attrs = m[0].lower(), source[m.end() : end]
        at = held = end + 1
        if kind == "/":
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not opened["p"]:
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                close(frozenset((tag,)), _SCOPE - {tag} if tag not in ("tr", "tbody", "thead", "tfoot", "table") else frozenset(("table",)) - {tag})
            continue
        if tag in ("html", "body") and opened[tag]:
            continue
        if opened["head"] and tag not in HEAD:
            close(frozenset(("head",)), frozenset(("template",)))
        if tag in ENDS_P:
            close(frozenset(("p",)), _SCOPE)
        if tag in IMPLIED:
            for _ in range(3):  # a row may end a cell, its row and its group
                if not close(*IMPLIED[tag]):
                    break
        node = Node(tag, attrs)
        stack[-1].children.append(node)
        if tag in PARTS:
            for x in reversed(stack):
                if x.tag == "table" or x.holds:
                    break
                x.holds = True
        if tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            node.children.append(source[at : m.start() if m else None])
            end = source.find(">", m.end()) if m else -1
            at = held = end + 1 or len(source)
        elif tag not in VOID and not (attrs.endswith("/") and opened["svg"] + opened["math"] > 0):
            stack.append(node)
            opened[tag] += 1
    if held < len(source):
        add(source[held:])
    return root


class Page:
    """Collects lines; gap is the number of line ends owed before the next text."""

    def __init__(self) -> None:
        self.parts: list[str] = []
        self.gap, self.blank, self.fresh = 0, False, True

    def block(self, gap: int) -> None:
        if not self.fresh:
            self.gap = max(self.gap, gap)
        self.blank = False

    def put(self, text: str) -> None:
        if self.gap:
            self.parts.append("\n" * self.gap)
        elif self.blank and not self.fresh:
            self.parts.append(" ")
        self.gap, self.blank, self.fresh = 0, False, False
        self.parts.append(text)

    def text(self, raw: str, pre: bool) -> None:
        if "&" in raw:
            raw = html.unescape(raw)
        if pre:
            if raw:
                self.put(raw)
            return
        words = raw.split()
        if not words:
            self.blank |= bool(raw) and not self.gap
            return
        if raw[0].isspace() and not self.gap:
            self.blank = True
        self.put(" ".join(words))
        self.blank = raw[-1].isspace()

    def done(self) -> str:
        return "".join(self.parts)


def rows_of(table: Node, shown: bool) -> tuple[list[list[tuple[Node, bool]]], list[tuple[Node | str, bool]]]:
    """The rows of cells of a table, not those of tables inside its cells, and what stands outside the cells.

    Elements that are no part of a table but hold such parts (a form around rows) are looked through. With each comes
    whether visibility lets it be seen.
    """
    rows: list[list[tuple[Node, bool]]] = []
    outside: list[tuple[Node | str, bool]] = []
    stack: list[tuple[Iterator, list | None, bool]] = [(iter(table.children), None, shown)]
    while stack:
        children, row, seen = stack[-1]
        x = next(children, None)
        if x is None:
            stack.pop()
        elif isinstance(x, str):
            if seen and (row is None or not x.isspace()):
                outside.append((x, True))
        elif x.hidden or x.tag in VOID - {"br", "hr"} or (x.tag == "caption" and len(stack) == 1):
            continue
        elif x.tag in ("td", "th"):
            if row is None:
                rows.append([(x, seen)])
            else:
                row.append((x, seen))
        elif x.tag == "tr" or x.holds or x.tag in PARTS or x.tag == "colgroup":
            if x.tag == "tr":
                rows.append(row := [])
            stack.append((iter(x.children), row, seen if x.vis is None else x.vis))
        else:
            outside.append((x, seen))
    return rows, outside if any(not isinstance(x, str) or not x.isspace() for x, _ in outside) else []


def laid_out(rows: list[list[tuple[int, int, str]]]) -> str:
    """Rows of (column, columns spanned, text) as lines of equal columns. Columns where no cell begins have no width."""
    width: dict[int, int] = {}
    for row in rows:
        for at, span, text in row:
            width[at] = max(width.get(at, 0), len(text) if span == 1 and len(text) <= WIDE else 0)
    padded = len(rows) * len(width) <= SPARSE * (sum(map(len, rows)) + 100)
    begins, place = {}, 0
    for at in sorted(width):
        begins[at] = place
        place += width[at] + 3
    lines = []
    for row in rows:
        line = ""
        for at, _, text in row:
            if at:
                line = f"{line.ljust(begins[at] - 3) if padded else line} | "
            line += text
        lines.append(line.rstrip())
    return "\n".join(x for x in lines if x.strip(" |"))


class Spans:
    """Columns into which cells of earlier rows reach, as few intervals; a row costs its own cells and what ends with it."""

    def __init__(self) -> None:
        self.starts: list[int] = []  # of taken intervals that don't touch each other
        self.ends: list[int] = []
        self.owners: list[list[int]] = []  # start, end and first free row of each cell's columns, in order, apart
        self.queue: list[tuple[int, int, list[int]]] = []  # by first free row
        self.number = 0

    def free(self, at: int) -> int:
        """The first column from `at` on that is not taken."""
        k = bisect_right(self.starts, at) - 1
        return self.ends[k] if k >= 0 and at < self.ends[k] else at

    def take(self, start: int, end: int, row: int) -> None:
        """Columns that are taken until `row`; the last cell that reaches into a column has it."""
        k = max(bisect_right(self.owners, [start]) - 1, 0)
        while k < len(self.owners) and self.owners[k][0] < end:
            a, b, until = own = self.owners[k]
            if b <= start:
                k += 1
                continue
            del self.owners[k]
            own[1] = -1  # nobody's any more
            for left, right in ((a, start), (end, b)):
                if left < right:
                    self._own(left, right, until)
        self._own(start, end, row)
        low, high = bisect_left(self.ends, start), bisect_right(self.starts, end)
        if low < high:
            start, end = min(start, self.starts[low]), max(end, self.ends[high - 1])
        self.starts[low:high], self.ends[low:high] = [start], [end]

    def _own(self, start: int, end: int, row: int) -> None:
        own = [start, end, row]
        insort(self.owners, own)
        self.number += 1
        heappush(self.queue, (row, self.number, own))

    def until(self, row: int) -> None:
        """Gives back the columns that are free from `row` on."""
        while self.queue and self.queue[0][0] <= row:
            own = heappop(self.queue)[2]
            start, end, _ = own
            if end < 0:
                continue
            del self.owners[bisect_left(self.owners, own)]
            k = bisect_right(self.starts, start) - 1
            a, b = self.starts[k], self.ends[k]
            left = [(x, y) for x, y in ((a, start), (end, b)) if x < y]
            self.starts[k : k + 1], self.ends[k : k + 1] = [x for x, _ in left], [y for _, y in left]


def table(x: Node, page: Page, depth: int, shown: bool) -> Iterator:
    rows, outside = rows_of(x, shown)
    for c, seen in outside:
        yield render([c], page, False, depth, seen)
    page.block(2)
    for c in x.children:
        if not isinstance(c, str) and c.tag == "caption" and not c.hidden:
            yield render(c.children, page, False, depth, shown if c.vis is None else c.vis)
            page.block(1)
    if depth >= LAYOUT:
        for row in rows:
            page.block(1)
            for c, seen in row:
                page.blank = True
                yield render(c.children, page, False, depth, seen if c.vis is None else c.vis)
    else:
        found, spans = [], Spans()
        for n, row in enumerate(rows):
            spans.until(n)
            out, at, below = [], 0, []
            for c, seen in row:
                at = spans.free(at)
                cell = Page()
                if not c.hidden:
                    yield render(c.children, cell, False, depth + 1, seen if c.vis is None else c.vis)
                out.append((at, c.span, " ".join(cell.done().split())))
                if c.down > 1:
                    below.append((at, at + c.span, n + c.down))
                at += c.span
            for cells in below:  # they reach into the rows after this one
                spans.take(*cells)
            if out:
                found.append(out)
        if laid := laid_out(found):
            page.put(laid)
    page.block(2)


def listing(x: Node, page: Page, depth: int, shown: bool) -> Iterator:
    page.block(1 if depth else 2)
    n = 1 if x.first is None else x.first
    for c in x.children:
        if isinstance(c, str) or c.tag != "li" or c.hidden:
            yield render([c], page, False, depth + 1, shown)
            continue
        n = n if c.first is None else c.first
        mark, seen = f"{n}. " if x.tag == "ol" else "- ", shown if c.vis is None else c.vis
        page.block(1)
        if depth >= LAYOUT:
            yield render(c.children, page, False, depth, seen)
        else:
            item = Page()
            yield render(c.children, item, False, depth + 1, seen)
            if body := item.done().strip("\n"):
                page.put(mark + body.replace("\n", "\n" + " " * len(mark)))
        n += 1
    page.block(1 if depth else 2)


def render(children: list, page: Page, pre: bool, depth: int, shown: bool) -> Iterator:
    """Puts out what is visible; yields the same for what lies deeper, so that no depth of the page is one of the stack."""
    for x in children:
        if isinstance(x, str):
            if shown:
                page.text(x, pre)
            continue
        if x.hidden:
            continue
        tag, seen = x.tag, shown if x.vis is None else x.vis
        if tag == "br":
            page.gap, page.blank = page.gap + (not page.fresh), False
        elif tag == "hr":
            page.block(2)
        elif tag == "table":
            yield table(x, page, depth, seen)
        elif tag in ("ul", "ol", "menu"):
            yield listing(x, page, depth, seen)
        elif tag in BLOCKS:
            gap, inside = 2 if tag in SPACED else 1, x.children
            if tag == "pre" and inside and isinstance(inside[0], str):
                inside = [inside[0].removeprefix("\n"), *inside[1:]]
            page.block(gap)
            yield render(inside, page, pre or tag in ("pre", "xmp"), depth, seen)
            page.block(gap)
        elif tag in ("td", "th", "text"):
            page.blank = True
            yield render(x.children, page, pre, depth, seen)
            page.blank = True
        elif x.children:
            yield render(x.children, page, pre or tag == "textarea", depth, seen)


def to_text(source: str) -> str:
    page = Page()
    stack = [render(parse(source).children, page, False, 0, True)]
    while stack:
        below = next(stack[-1], None)
        if below is None:
            stack.pop()
        else:
            stack.append(below)
    return "\n".join(line.rstrip() for line in page.done().strip("\n").split("\n"))


def extract(pages: DataFrame, *, source: str = "html", out: str = "text", keep: list[str] | None = None) -> DataFrame:
    """pages with all visible text of each whole page, laid out.

    Null gives null, an empty page an empty text; broken mark-up is read as far as it goes. Each row is rendered alone,
    so repeated rows give repeated results, and an empty table gives an empty one; a column of the name `out` is
    replaced. Time and memory grow with the page's length, not with its depth. What a closed `details` holds is shown;
    style sheets and scripts are not read.
    """

    def make():
        return lambda sources: ([None if s is None else to_text(s.decode()) for s in sources],)

    return map_rows(pages, [source], f"`{out}` string", make, keep)
