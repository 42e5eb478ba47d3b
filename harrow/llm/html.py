"""HTML extraction by layout-aware rendering.

A tolerant tokenizer feeds a tree builder that closes elements whose end tags HTML
lets authors leave out; visibility rules drop what a browser would not show: the
``hidden`` attribute, ``display: none`` with all that is inside, ``visibility``
as it is inherited and taken back, by style attributes and by the ``<style>``
sheets' rules of plain selectors (element, class, id), closed ``details``, and of
drawings all but their text. The renderer then emits all visible text, collapsing
white space as inline layout does, keeping block spacing, list markers and indents,
preformatted text, and the columns of tables, cells over several rows or columns
laid out on the table's grid.

Edge cases. Null and empty pages give an empty text; broken, unclosed and deeply
nested markup is read as far as it goes, without recursion; a page of any length
is read whole; repeated rows are rendered alike; other columns are ignored or
carried by the caller.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harrow.llm.common import table

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
#: For the rest of a page once a quote is left open: tags end at the next ">".
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
#: Deeper elements become siblings, as browsers do, so that work stays in proportion to the page.
DEPTH = 512
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DECLARED = re.compile(r"(?:^|[;{])\s*(display|visibility)\s*:\s*([a-z-]+)\s*(!\s*important)?", re.I)
_RULE = re.compile(r"([^{}]*)\{([^{}]*)\}")
_SELECTOR = re.compile(r"([a-z][a-z0-9-]*|\*)?((?:[.#][\w-]+)*)\Z", re.I)
#: Attributes that may bear on what is shown and where.
_TELLING = re.compile(r"hidden|style|type|start|span|open", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is text up to their end tag.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
NEVER_SHOWN = frozenset("head script style template title noscript iframe noembed noframes datalist object audio video canvas defs desc metadata symbol clippath marker pattern annotation annotation-xml".split())
#: Block elements, with the blank lines around them.
BLOCK = {**dict.fromkeys("address article aside body center details dialog dd div dl dt fieldset figcaption figure footer form header hgroup html li main menu nav ol optgroup option section summary ul table caption thead tbody tfoot tr td th".split(), 0), **dict.fromkeys("blockquote h1 h2 h3 h4 h5 h6 p pre".split(), 1)}
CLOSE_P = frozenset("address article aside blockquote center details dialog div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre section summary table ul".split())
#: start tag -> (open elements that it ends, elements beyond which it does not look)
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}), "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, set()),
}
_FIRST_IN_BODY = frozenset({*CLOSE_P, "span", "a", "b", "i", "em", "strong", "img", "body"})
#: Elements of drawings and formulas, in which a slash ends an element at once.
FOREIGN = frozenset({"svg", "math"})
#: An end tag does not close elements outside of these, unless it is theirs.
SCOPE = frozenset({"table", "td", "th", "caption"})


class Node:
    """An element: its name, the text of its attributes, its children (texts and nodes)."""

    __slots__ = ("name", "attributes", "children")

    def __init__(self, name: str, attributes: str = ""):
        self.name, self.attributes = name, attributes
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(text):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _declared(style: str) -> list[tuple[str, str, bool]]:
    return [(m[1].lower(), m[2].lower(), bool(m[3])) for m in _DECLARED.finditer(style)]


class Sheet:
    """What style sheets say about ``display`` and ``visibility``, by plain compound selectors.

    Rules within conditional blocks and selectors of other kinds are passed over.
    """

    def __init__(self, sheets: list[str]):
        self.rules: dict[str, list[tuple]] = {}
        at = 0
        for sheet in sheets:
            if "display" not in sheet.lower() and "visibility" not in sheet.lower():
                continue
            plain = re.sub(r"/\*.*?(?:\*/|\Z)|<!--|-->", "", sheet, flags=re.S)
            plain = re.sub(r"@[^{};]*\{(?:[^{}]*\{[^{}]*\})*[^{}]*\}|@[^{};]*;", "", plain)
            for m in _RULE.finditer(plain):
                said = _declared("{" + m[2])
                for selector in m[1].split(",") if said else ():
                    found = _SELECTOR.match(selector.strip())
                    if found and found[0]:
                        marks = re.findall(r"[.#][\w-]+", found[2])
                        name = (found[1] or "*").lower()
                        weight = (sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), name != "*")
                        at += 1
                        self.rules.setdefault(marks[-1] if marks else name, []).append((name, frozenset(marks), weight, at, said))

    def style(self, name: str, attributes: dict[str, str]) -> dict[str, str]:
        """display and visibility of an element, as far as they are declared."""
        best: dict[str, tuple] = {}
        mine = {"." + c for c in attributes.get("class", "").split()} | ({"#" + attributes["id"]} if "id" in attributes else set())
        for key in (name, "*", *sorted(mine)) if self.rules else ():
            for of, marks, weight, at, said in self.rules.get(key, ()):
                if of in ("*", name) and marks <= mine:
                    for what, value, important in said:
                        best[what] = max(best.get(what, ((),)), ((important, 0, weight, at), value))
        for at, (what, value, important) in enumerate(_declared(attributes.get("style", ""))):
            best[what] = max(best.get(what, ((),)), ((important, 1, (0, 0, False), at), value))
        return {what: value for what, (_, value) in best.items()}


class _Facts:
    """How an element is laid out: whether it is shown at all, its visibility (None: inherited), and its numbers."""

    __slots__ = ("shown", "visible", "start", "colspan", "rowspan", "open")

    def __init__(self, node: Node, sheet: Sheet):
        self.shown, self.visible, self.start, self.colspan, self.rowspan, self.open = node.name not in NEVER_SHOWN, None, 1, 1, 1, False
        if not self.shown or not (sheet.rules or _TELLING.search(node.attributes)):
            return
        attributes = _attributes(node.attributes)
        style = sheet.style(node.name, attributes)
        display = style.get("display", "none" if "hidden" in attributes else "")
        self.shown = not (display == "none" or (node.name == "input" and attributes.get("type", "").lower() == "hidden"))
        if "visibility" in style:
            self.visible = style["visibility"] not in ("hidden", "collapse") if style["visibility"] != "inherit" else None
        self.open = "open" in attributes
        if node.name in ("ol", "td", "th"):
            self.start = _whole(attributes.get("start", ""), 1)
            self.colspan = max(1, min(1000, _whole(attributes.get("colspan", ""), 1)))
            self.rowspan = max(0, min(65534, _whole(attributes.get("rowspan", ""), 1)))  # 0: to the group's end


_PLAIN = Sheet([])


def _whole(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"\s*-?\d{1,9}\s*", text) else default


def build_tree(html: str) -> Node:
    """The element tree of a page."""
    root = Node("#root")
    stack = [root]
    at, end, last, token = 0, len(html), html.rfind(">"), _TOKEN

    def close(names: set[str] | frozenset[str], barrier: set[str] | frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].name in barrier:
                return
            if stack[i].name in names:
                del stack[i:]
                if len(names) == 1:
                    return

    while at < end:
        found = html.find("<", at)
        if found < 0:
            stack[-1].children.append(unescape(html[at:]))
            break
        if found > at:
            stack[-1].children.append(unescape(html[at:found]))
        if html.startswith("<!--", found) and html.find("-->", found) < 0:  # an open comment hides the rest
            break
        if found > last:  # no tag can end any more
            stack[-1].children.append(unescape(html[found:]))
            break
        m = token.match(html, found)
        if not m and token is _TOKEN and html[found + 1 : found + 2].isalpha():
            token = _LOOSE
            m = token.match(html, found)
        if not m:  # a lone "<"
            stack[-1].children.append("<")
            at = found + 1
            continue
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "br":
                stack[-1].children.append(Node("br"))
            elif name == "p" and not any(x.name == "p" for x in stack):
                stack[-1].children.append(Node("p"))
            else:
                close({name}, SCOPE - {name} if name not in ("table", "tr", "tbody", "thead", "tfoot") else {"table"} - {name})
            continue
        if name in CLOSE_P and name != "table":
            close({"p"}, SCOPE | {"button"})
        if name in IMPLIED:
            close(*IMPLIED[name])
        elif name in _FIRST_IN_BODY and len(stack) > 1 and any(x.name == "head" for x in stack):
            close({"head"}, set())
        node = Node(name, m[3])
        stack[-1].children.append(node)
        if name in VOID or (m[3].endswith("/") and any(x.name in FOREIGN for x in stack)):
            continue
        if name in RAW:
            stop = re.compile(rf"</{name}[\s/>]", re.I).search(html, at)
            inside = html[at : stop.start() if stop else end]
            if name not in NEVER_SHOWN or name == "style":
                node.children.append(unescape(inside) if name == "textarea" else inside)
            at = (html.find(">", stop.start()) + 1 or end) if stop else end
            continue
        if len(stack) < DEPTH:
            stack.append(node)
    return root


class _Lines:
    """Text laid out in lines: inline runs, breaks and blank lines."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.run: list[str] = []
        self.gap, self.prefix, self.marker = 0, "", ""
        self.preformatted = 0

    def text(self, text: str) -> None:
        if self.preformatted:
            first, *rest = text.replace("\r\n", "\n").split("\n")
            self.run.append(first)
            for line in rest:
                self.line()
                self.run.append(line)
        else:
            self.run.append(_SPACE.sub(" ", text))

    def line(self, always: bool = False) -> None:
        """End the current line; ``always`` even if it is empty."""
        text = "".join(self.run)
        self.run.clear()
        text = text.rstrip() if self.preformatted else _SPACE.sub(" ", text).strip(" \t\n\r\f")
        if text or always or self.preformatted:
            if text and self.gap and self.lines:
                self.lines += [""] * self.gap
            if text:
                self.gap = 0
            self.lines.append((self.prefix + self.marker + text) if text else "")
            if text and self.marker:
                self.prefix, self.marker = self.prefix + " " * len(self.marker), ""

    def block(self, margin: int) -> None:
        self.line() if any(x.strip(" \t\n\r\f") for x in self.run) else self.run.clear()
        self.gap = max(self.gap, margin)

    def result(self) -> str:
        self.block(0)
        out = re.sub(r"\n{3,}", "\n\n", "\n".join(self.lines))
        return out.strip("\n")


#: A cell: its text, and the columns and rows that it is over.
Cell = tuple[str, int, int]


def grid(rows: list[tuple[int, list[Cell]]]) -> list[list[tuple[int, int, str]]]:
    """For each row (group, cells) its (column, columns, text), cells from rows above as empty ones."""
    out: list[list[tuple[int, int, str]]] = []
    hanging: list[tuple[int, int, int]] = []  # (column, columns, rows to go; none: to the group's end)
    group = None
    for mine, cells in rows:
        if mine != group:
            hanging, group = [], mine
        row = [(at, span, "") for at, span, _ in hanging]
        left = sorted((at, span) for at, span, _ in hanging)
        hanging = [(at, span, n - 1) for at, span, n in hanging if n != 1]
        at = 0
        for text, span, n in cells:
            while left and left[0][0] <= at:
                at = max(at, sum(left.pop(0)))
            row.append((at, span, text))
            if n != 1:
                hanging.append((at, span, n - 1 if n else -1))
            at += span
        out.append(sorted(row))
    return out


def _table(rows: list[tuple[int, list[Cell]]]) -> list[str]:
    """Rows of cells as lines with aligned columns."""
    placed = [row for row in grid(rows) if any(text for _, _, text in row)]
    starts = sorted({at for row in placed for at, _, _ in row})  # columns in which no cell begins take no room
    number = {at: i for i, at in enumerate(starts)}
    width = [0] * len(starts)
    cells = [[(number[at], bisect_left(starts, at + span), text.split("\n")) for at, span, text in row] for row in placed]
    for narrow in (True, False):
        for row in cells:
            for first, end, lines in row[:-1]:
                if (end - first == 1) == narrow:
                    spare = max(map(len, lines)) - sum(width[first:end]) - 3 * (end - first - 1)
                    width[end - 1] += max(0, spare)
    lines = []
    for row in cells:
        for k in range(max(len(text) for _, _, text in row)):
            line, at = "", 0
            for first, end, text in row:
                first = max(first, at)  # a cell from above may lie under a wide one
                if end <= first:
                    continue
                for i in range(at, first):  # columns that this row leaves out
                    line += " " * width[i] + " | "
                part = text[k] if k < len(text) else ""
                line += part.ljust(sum(width[first:end]) + 3 * (end - first - 1)) + " | "
                at = end
            lines.append(line[:-3].rstrip())
    return lines


def _sheets(root: Node) -> Sheet:
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.name == "style":
            found.append("".join(x for x in node.children if isinstance(x, str)))
        else:
            todo += [x for x in reversed(node.children) if not isinstance(x, str) and x.name != "template"]
    return Sheet(found) if any("display" in x or "visibility" in x for x in map(str.lower, found)) else _PLAIN


def _inner(node: Node, facts: _Facts) -> list:
    """The children that are laid out."""
    if node.name == "details" and not facts.open:
        return [x for x in node.children if not isinstance(x, str) and x.name == "summary"][:1]
    return node.children


def render(root: Node) -> str:
    """The visible text of a tree."""
    sheet = _sheets(root)
    out = _Lines()
    outer: list[_Lines] = []
    rows: list[list[tuple[int, list[Cell]]]] = []
    groups = 0
    counters: list[int | None] = []
    saved: list[str] = []
    # A stack of things to do: a child to enter, or what follows a node's children; whether
    # text is visible there, and whether it is within a drawing but not its text.
    todo: list = [("in", root, True, False)]
    while todo:
        what, node, visible, drawing = todo.pop()
        if what == "out":
            name, facts = node
            if name in ("td", "th") and rows:
                cell = out.result()
                out = outer.pop()
                if not rows[-1]:
                    rows[-1].append((groups, []))
                rows[-1][-1][1].append((cell, facts.colspan, facts.rowspan))
            elif name == "table":
                cells = rows.pop()
                out.block(0)
                out.gap = max(out.gap, 1)
                for line in _table(cells):
                    out.run.append(line)
                    out.preformatted += 1
                    out.line()
                    out.preformatted -= 1
                out.gap = 1
            elif name == "#label":
                out.block(0)
            else:
                if name == "pre":
                    out.block(1)
                    out.preformatted -= 1
                if name in ("ul", "ol", "menu"):
                    counters.pop()
                    out.block(0 if counters else 1)
                elif name == "li":
                    out.block(0)
                    out.prefix, out.marker = saved.pop(), ""
                elif name in ("dd", "blockquote"):
                    out.block(BLOCK[name])
                    out.prefix = saved.pop()
                elif name in BLOCK:
                    out.block(BLOCK[name])
            continue
        if isinstance(node, str):
            if visible and not drawing:
                out.text(node)
            continue
        facts = _Facts(node, sheet)
        if not facts.shown:
            continue
        visible = visible if facts.visible is None else facts.visible
        name = node.name
        if name == "br":
            out.line(always=True)
            continue
        if name == "hr":
            out.block(1)
            continue
        if name == "wbr":
            continue
        if name == "svg":
            drawing = True
        elif name == "text" and drawing:
            name, drawing = "#label", False
            out.block(0)
        elif name == "foreignobject":
            drawing = False
        todo.append(("out", (name, facts), visible, drawing))
        if name == "table":
            out.block(1)
            rows.append([])
        elif name in ("thead", "tbody", "tfoot") and rows:
            groups += 1
        elif name == "tr" and rows:
            rows[-1].append((groups, []))
        elif name in ("td", "th") and rows:
            outer.append(out)
            out = _Lines()
        elif name in ("ul", "ol", "menu"):
            out.block(0 if counters else 1)
            counters.append(facts.start if name == "ol" else None)
        elif name == "li":
            out.block(0)
            saved.append(out.prefix)
            count = counters[-1] if counters else None
            out.marker = ("- " if count is None else f"{count}. ") if visible else ""
            if count is not None:
                counters[-1] = count + 1
        elif name in ("dd", "blockquote"):
            out.block(BLOCK[name])
            saved.append(out.prefix)
            out.prefix += "  "
        elif name == "pre":
            out.block(1)
            out.preformatted += 1
        elif name in BLOCK:
            out.block(BLOCK[name])
        todo += [("in", c, visible, drawing) for c in reversed(_inner(node, facts))]
    return out.result()


def extract(html: str | None) -> str:
    """The visible text of a page."""
    return render(build_tree(html)) if html else ""


def _extracted(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for html in frames:
        yield pd.Series([extract(h) for h in html], dtype="object")


def extract_pages(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the visible text in place of the page."""
    visible = F.pandas_udf(_extracted, "string")
    return pages.select(*[F.col(f"`{c}`") for c in pages.columns if c not in (html_col, name)], visible(F.col(f"`{html_col}`")).alias(name))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of all ``pages``."""
    return extract_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", F.length("text").cast("long").alias("n_chars"), "text")
