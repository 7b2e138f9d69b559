"""Visible text of HTML pages, laid out.

A page is cut into tags and text, a tree is built with implied end tags, rules
of visibility are applied, and what is left is written block by block: blank
lines between paragraphs, list markers with indents, preformatted text as it
is, and tables with their columns aligned.  Of style sheets the display and
visibility rules of tags, classes, ids and their descendants and children
count, in the order of the cascade and as far as media queries ask for a
screen; selectors with other parts are passed over.

Defined results: null and empty pages give an empty text; broken markup is
read as browsers do in the simple cases (open elements end with the page, end
tags without a start are passed over); nesting of any depth is handled without
recursion; ids, repeated rows and a table without rows are passed through;
other columns are not read, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterbook.llm.common import map_batches

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_ESCAPABLE = frozenset(("textarea", "title"))
_HIDDEN = frozenset(
    "head script style template noscript iframe object math canvas audio video datalist noembed noframes map applet rp title desc defs metadata input".split()
)
#: block elements and the blank lines around them
_MARGIN = dict.fromkeys("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre figure hr table fieldset menu".split(), 1) | dict.fromkeys(
    "html body div article section nav aside header footer main address li dt dd form details summary figcaption center legend dialog hgroup search "
    "option caption tr td th thead tbody tfoot".split(), 0
)
_LISTS = frozenset(("ul", "ol", "menu", "dl"))
_CELLS = frozenset(("td", "th"))
_ROWS = frozenset(("thead", "tbody", "tfoot"))
#: a start tag ends an open element of these names, looked for up to one of the boundaries
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
    "body": ({"head"}, set()),
}
_ENDS["tbody"] = _ENDS["tfoot"] = _ENDS["thead"]
_ENDS_P = frozenset(t for t in _MARGIN if t not in ("html", "body", "option", "caption", "tr", "td", "th", "thead", "tbody", "tfoot", "legend"))
_WALLS = frozenset("table td th caption html button object template".split())
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_BRACE = re.compile(r"[{}]")
_DECLARATION = re.compile(r"\s*(display|visibility)\s*:\s*([A-Za-z-]+)\s*(!\s*important)?", re.I)
_SELECTOR = re.compile(r"(\*|[A-Za-z][\w-]*)?((?:[.#][\w-]+)*)\Z")
_WIDTH = re.compile(r"(min|max)-width\s*:\s*(\d+)px")
#: Width of the screen that media queries are asked about.
SCREEN = 1280


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    if source:
        for name, a, b, c in _ATTRIBUTE.findall(source):
            out.setdefault(name.lower(), html.unescape(a or b or c))
    return out


def build(page: str) -> tuple[Node, list[str]]:
    """The tree of a page and the texts of its style sheets."""
    root = Node("#page", {})
    stack, sheets, at, size = [root], [], 0, len(page)
    opened: Counter[str] = Counter()  # names on the stack, so that what is not open is not looked for

    def close(names: set[str], walls: set[str]) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in names:
                while len(stack) > i:
                    opened[stack.pop().tag] -= 1
                return
            if tag in walls:
                return

    while at < size:
        found = _TAG.search(page, at)
        if found is None:
            stack[-1].parts.append(html.unescape(page[at:]))
            break
        if found.start() > at:
            stack[-1].parts.append(html.unescape(page[at : found.start()]))
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag == "br":
                stack[-1].parts.append(Node("br", {}))
            elif tag == "p" and not opened["p"]:
                stack[-1].parts.append(Node("p", {}))
            else:
                close({tag}, set() if tag in ("table", "html", "body") else {"table"} if tag in _CELLS or tag in _ROWS or tag == "tr" else _WALLS - {tag})
            continue
        if tag in _ENDS:
            names, walls = _ENDS[tag]
            before = -1
            while before != len(stack):  # a row ends its cell and the row
                before = len(stack)
                close(names, walls)
        if tag in _ENDS_P:
            close({"p"}, _WALLS)
        if tag in ("h1", "h2", "h3", "h4", "h5", "h6") and stack[-1].tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            opened[stack.pop().tag] -= 1
        node = Node(tag, attributes(found[3]))
        stack[-1].parts.append(node)
        if tag in _RAW or tag in _ESCAPABLE:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>|\Z", re.I).search(page, at)
            body = page[at : end.start()]
            if tag == "style":
                sheets.append(body)
            node.parts.append(html.unescape(body) if tag in _ESCAPABLE else body)
            at = end.end()
        elif tag not in _VOID and not (found[3].endswith("/") and tag in ("svg", "math", "path")):
            stack.append(node)
            opened[tag] += 1
    return root, sheets


def declarations(body: str) -> list[tuple[str, str, bool]]:
    """(property, value, important) of the declarations that decide what is seen."""
    found = (_DECLARATION.match(one) for one in body.split(";"))
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in found if m]


def on_screen(prelude: str) -> bool:
    """Whether the rules inside an at-rule count for a screen."""
    name, _, rest = prelude.partition(" ")
    if not name.lower().startswith("@media"):
        return name.lower() in ("@supports", "@layer", "@container", "@scope")
    for query in (name[6:] + " " + rest).lower().split(","):
        kind = query.replace("(", " (").split()
        negated, kind = kind[:1] == ["not"], [w for w in kind if w not in ("not", "only")]
        holds = not kind or kind[0] in ("all", "screen") or kind[0].startswith("(")
        holds = holds and all(SCREEN >= int(n) if side == "min" else SCREEN <= int(n) for side, n in _WIDTH.findall(query))
        if holds != negated:
            return True
    return False


class Styles:
    """Display and visibility rules of the style sheets, found by the last part of their selectors."""

    def __init__(self, sheets: list[str]):
        self.by_key: dict[str, list[tuple]] = {}
        count = 0
        for sheet in sheets:
            sheet, at = _COMMENT.sub(" ", sheet), 0
            open_: list[tuple[str, bool]] = []
            for brace in _BRACE.finditer(sheet):
                part, at = sheet[at : brace.start()], brace.end()
                outer = open_[-1][1] if open_ else True
                if brace[0] == "{":
                    prelude = part.rsplit(";", 1)[-1].strip()
                    open_.append((prelude, outer and (on_screen(prelude) if prelude.startswith("@") else True)))
                elif open_:
                    prelude, counts = open_.pop()
                    found = declarations(part) if counts and not prelude.startswith("@") else []
                    if found:
                        count += 1
                        for one in prelude.split(","):
                            self._add(one, found, count)

    def _add(self, selector: str, found: list, order: int) -> None:
        chain, child = [], False
        for word in selector.replace(">", " > ").split():
            if word == ">":
                child = True
                continue
            parsed = _SELECTOR.match(word)
            if not parsed or not parsed[0]:
                return
            names = re.findall(r"([.#])([\w-]+)", parsed[2])
            tag = (parsed[1] or "").lower().replace("*", "")
            chain.append((child, tag, frozenset(n for k, n in names if k == "."), frozenset(n for k, n in names if k == "#")))
            child = False
        if chain:
            weight = tuple(sum(map(len, (part[i] for part in chain))) for i in (3, 2)) + (sum(bool(part[1]) for part in chain),)
            _, tag, classes, ids = chain[-1]
            key = "#" + min(ids) if ids else "." + min(classes) if classes else tag
            self.by_key.setdefault(key, []).append((chain, weight, order, found))

    def of(self, path: list[Node]) -> dict[str, str]:
        """The display and visibility that hold for the last node of a path: important ones, then inline ones, the most specific, the latest."""
        node = path[-1]
        best: dict[str, tuple] = {}
        if "style" in node.attrs:
            for name, value, important in declarations(node.attrs["style"]):
                best[name] = max(best.get(name, ((),)), ((important, True, (0, 0, 0), 0), value), key=lambda x: x[0])
        if self.by_key:
            keys = [node.tag, ""] + ["." + c for c in set(node.attrs.get("class", "").split())]
            if "id" in node.attrs:
                keys.append("#" + node.attrs["id"])
            for key in keys:
                for chain, weight, order, found in self.by_key.get(key, ()):
                    if _fits(chain, path):
                        for name, value, important in found:
                            best[name] = max(best.get(name, ((),)), ((important, False, weight, order), value), key=lambda x: x[0])
        return {name: value for name, (_, value) in best.items()}


def _is(node: Node, part: tuple) -> bool:
    _, tag, classes, ids = part
    return (not tag or tag == node.tag) and classes <= set(node.attrs.get("class", "").split()) and all(i == node.attrs.get("id") for i in ids)


def _fits(chain: list[tuple], path: list[Node]) -> bool:
    """Whether a chain of selectors ends at the last node of a path."""
    if not _is(path[-1], chain[-1]):
        return False
    # places of the path where the part after the one in question may lie
    places = {len(path) - 1}
    for at in range(len(chain) - 2, -1, -1):
        if chain[at + 1][0]:
            wanted = {p - 1 for p in places}
        else:
            wanted = range(max(places))
        places = {p for p in wanted if p >= 0 and _is(path[p], chain[at])}
        if not places:
            return False
    return True


def is_hidden(node: Node, style: dict[str, str]) -> bool:
    """Not displayed, with all it holds."""
    if node.tag in _HIDDEN:
        return True
    if "display" in style:
        return style["display"] == "none"
    return "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs)


class Canvas:
    """Lines of text; inline text is gathered until a block begins or ends."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap = 0
        self.indent = ""
        self.marker = ""

    def text(self, value: str, kept: bool) -> None:
        self.run.append((value, True) if kept else (_SPACE.sub(" ", value), False))

    def flush(self) -> None:
        if not self.run:
            return
        out, space, kept = [], True, False
        for piece, kept in self.run:
            if not kept and space and piece[:1] == " ":
                piece = piece[1:]
            if piece:
                if piece == "\n" and not kept and space and out:  # no blank before a line break
                    out[-1] = out[-1].rstrip(" ")
                out.append(piece)
                space = piece[-1] in " \n"
        self.run = []
        whole = "".join(out)
        if whole.strip(" "):
            for line in (whole if kept else whole.rstrip(" ")).split("\n"):
                self.put(line)

    def put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.extend([""] * self.gap)
        self.gap = 0
        if self.marker:
            lead = self.indent[: len(self.indent) - len(self.marker)] + self.marker
            self.marker = ""
        else:
            lead = self.indent
        self.lines.append((lead + line).rstrip())

    def block(self, margin: int) -> None:
        self.flush()
        self.gap = max(self.gap, margin)

    def done(self) -> list[str]:
        self.flush()
        return self.lines


def _span(attrs: dict[str, str], name: str) -> int:
    value = attrs.get(name, "1").strip()
    return min(max(int(value), 1), 1000) if value.isascii() and value.isdigit() else 1


def aligned(rows: list[list[tuple[list[str], int, int]]]) -> list[str]:
    """Cells (lines, columns, rows spanned) in columns of equal width, two spaces apart."""
    taken: dict[tuple[int, int], bool] = {}
    placed = []
    for y, row in enumerate(rows):
        x = 0
        for lines, wide, high in row:
            while (y, x) in taken:
                x += 1
            for dy in range(min(high, len(rows) - y)):
                for dx in range(wide):
                    taken[y + dy, x + dx] = True
            placed.append((y, x, lines, wide))
            x += wide
    # a column begins where cells begin, two blanks behind whatever ends before it in any row
    shown = sorted(((x + wide, x, max(map(len, lines))) for _, x, lines, wide in placed if lines))
    start: dict[int, int] = {}
    at = ended = 0
    for c in sorted({x for _, x, _ in shown}):
        while ended < len(shown) and shown[ended][0] <= c:
            _, x, size = shown[ended]
            at, ended = max(at, start[x] + size + 2), ended + 1
        start[c] = at
    out = []
    for y in range(len(rows)):
        own = [(x, lines) for row, x, lines, _ in placed if row == y and lines]
        for i in range(max((len(lines) for _, lines in own), default=0)):
            line = ""
            for x, lines in own:
                if i < len(lines) and lines[i]:
                    line = line.ljust(start[x]) + lines[i]
            out.append(line.rstrip())
    return out


class _Table:
    def __init__(self) -> None:
        self.rows: list[list] = []
        self.caption: list[str] = []


def render(page: str | None) -> str:
    """Visible text of a page."""
    if not page:
        return ""
    root, sheets = build(page.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "�"))
    styles = Styles(sheets)
    canvases, tables, lists = [Canvas()], [], []
    shown, kept, path = [True], [False], []
    # (node, None) enters a node, (node, canvas state) leaves it
    work: list[tuple] = [("enter", root)]
    while work:
        what, node, *state = work.pop()
        canvas = canvases[-1]
        if what == "text":
            if shown[-1]:
                canvas.text(node, kept[-1])
            continue
        tag = node.tag
        margin = _MARGIN.get(tag)
        if what == "enter":
            path.append(node)
            style = styles.of(path)
            path.pop()
            if is_hidden(node, style):
                continue
            if tag == "br":
                if shown[-1]:
                    canvas.run.append(("\n", False))
                continue
            if tag == "wbr":
                continue
            if margin is not None:
                canvas.block(margin if not (tag in _LISTS and lists) else 0)
            if tag == "hr":
                if shown[-1]:
                    canvas.put("---")
                canvas.block(1)
                continue
            looks = style.get("visibility", "inherit")
            shown.append(shown[-1] if looks in ("inherit", "unset") else looks in ("visible", "initial"))
            kept.append(kept[-1] or tag in ("pre", "textarea"))
            path.append(node)
            before = canvas.indent
            parts = node.parts
            if tag in _LISTS:
                begin = node.attrs.get("start", "1").strip()
                lists.append([tag, int(begin) if re.fullmatch(r"-?\d{1,9}", begin) else 1])
            elif tag == "li":
                mark = "- "
                if lists and lists[-1][0] == "ol":
                    value = node.attrs.get("value", "").strip()
                    if re.fullmatch(r"-?\d{1,9}", value):
                        lists[-1][1] = int(value)
                    mark = f"{lists[-1][1]}. "
                    lists[-1][1] += 1
                canvas.indent += " " * len(mark)
                canvas.marker = mark
            elif tag == "dd" or tag == "blockquote":
                canvas.indent += "  "
            elif tag == "table":
                tables.append(_Table())
            elif tag == "tr" and tables:
                tables[-1].rows.append([])
            elif (tag in _CELLS or tag == "caption") and tables:
                if tag in _CELLS and not tables[-1].rows:
                    tables[-1].rows.append([])
                canvases.append(Canvas())
            elif tag == "details" and "open" not in node.attrs:
                parts = [p for p in parts if isinstance(p, Node) and p.tag == "summary"][:1]
            if tag == "q":
                canvas.text('"', False)
            work.append(("leave", node, before, len(canvases)))
            work.extend(("enter", p) if isinstance(p, Node) else ("text", p) for p in reversed(parts))
            if tag in ("pre", "textarea") and parts and isinstance(parts[0], str) and parts[0][:1] == "\n":
                work[-1] = ("text", parts[0][1:])
            continue
        before, depth = state
        if tag == "q":
            canvas.text('"', False)
        if margin is not None:
            canvas.block(0)
        if (tag in _CELLS or tag == "caption") and tables and depth > 1:
            lines = canvases.pop().done()
            if tag == "caption":
                tables[-1].caption += lines
            else:
                tables[-1].rows[-1].append((lines, _span(node.attrs, "colspan"), _span(node.attrs, "rowspan")))
        elif tag == "table":
            table = tables.pop()
            for line in table.caption + aligned(table.rows):
                canvas.put(line)
        elif tag in _LISTS and lists:
            lists.pop()
        elif tag == "li" and canvas.marker:
            canvas.put("")  # an item without text keeps its marker
        canvas = canvases[-1]
        if tag not in _CELLS and tag != "caption":
            canvas.indent = before
        if margin is not None:
            canvas.block(margin if not (tag in _LISTS and lists) else 0)
        shown.pop()
        kept.pop()
        path.pop()
    return "\n".join(canvases[0].done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", text_col: str = "text") -> DataFrame:
    """id and visible text of every page."""
    own = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{html_col}`").alias("html"))
    kind = own.schema["id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(h) for h in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return map_batches(own, work, f"id {kind}, text string").select(F.col("id").alias(id_col), F.col("text").alias(text_col))
