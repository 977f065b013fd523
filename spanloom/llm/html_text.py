"""HTML extraction by layout-aware rendering.

A tree builder applies implied start and end tags; visibility rules (elements that are never shown, ``hidden``, inline
and simple style-sheet ``display`` and ``visibility``) decide what is seen; a renderer writes all visible text with block
spacing, list markers and table cells aligned in columns.

Style sheets count as on a screen of VIEWPORT pixels.  Where a condition cannot be decided, rules that show text count and
rules that hide it don't.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.common import read, ship

# Element classes of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER_SHOWN = frozenset("head title meta link base script style template noscript datalist area param source track iframe object audio video canvas rp".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript".split())
RAW_WITH_ENTITIES = frozenset("title textarea".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol p pre search section summary table caption thead tbody tfoot tr ul option optgroup".split()
)
#: Blocks with an empty line around them.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote dl ul ol menu dir figure pre table fieldset hr".split())
ENDS_P = BLOCKS - frozenset("html body option optgroup caption thead tbody tfoot tr".split())
HEAD_ONLY = frozenset("title meta link base style script template noscript".split())
#: Open elements at once, as browsers hold; deeper ones become siblings, their text stays.
DEEPEST = 512
#: A new tag -> open elements that it ends, and those at which the search for them stops.
_LIST, _TABLE = frozenset("ul ol menu dir".split()), frozenset(["table"])
IMPLIED_ENDS = {
    "li": (frozenset(["li"]), _LIST | _TABLE),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _TABLE),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"]) | _TABLE),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "td": (frozenset(["td", "th"]), frozenset(["tr"]) | _TABLE),
    "th": (frozenset(["td", "th"]), frozenset(["tr"]) | _TABLE),
    "thead": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "tbody": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "tfoot": (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE),
}
_P_SCOPE = frozenset("table td th caption button object body".split())
FOREIGN = frozenset(["svg", "math"])
#: Elements of SVG and MathML that hold HTML again, and HTML elements that end an open SVG or MathML elsewhere.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
ENDS_FOREIGN = frozenset(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
SVG_NEVER_SHOWN = frozenset("defs symbol desc metadata clippath mask marker pattern lineargradient radialgradient filter".split())
MATH_NEVER_SHOWN = frozenset(["annotation", "annotation-xml"])
#: Width and height of the screen that media queries are asked about, in pixels.
VIEWPORT = {"width": 1280.0, "height": 720.0}

_TOKEN = re.compile(r"<!--(?:-?>|(?:.*?(?:--!?>|\Z)))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
#: Comments (first group) and strings of a style sheet.
_SKIPPED = re.compile(r"(/\*.*?(?:\*/|\Z)|<!--|-->)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_BRACE = re.compile(r"[;{}]")
_FEATURE = re.compile(r"\((min|max)-(width|height)\s*:\s*(\d*\.?\d+)(px|em|rem)\)")
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: Parts of a selector: combinator, then simple selectors of one element.  Strings are gone by then, so quoted values aren't known.
_COMBINED = re.compile(r"\s*([>\s])\s*")
_SIMPLE = re.compile(r"([.#]?)([\w-]+|\*)|\[\s*([\w-]+)\s*(?:=\s*([\w-]+)\s*)?\]")
#: Buttons whose text is their value, and what stands there without one.
BUTTONS = {"submit": "Submit", "reset": "Reset", "button": ""}
#: Widest line of a cell that its column is padded to; wider ones stand out, so that a table takes no more than its cells times this.
WIDEST = 120


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str] | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def parse(source: str) -> Node:
    """The element tree: children are nodes or text."""
    root = Node("html")
    body: Node | None = None
    head = Node("head")
    root.children.append(head)
    stack: list[Node] = [root]

    def open_body() -> None:
        nonlocal body
        if body is None:
            del stack[1:]
            body = Node("body")
            root.children.append(body)
            stack.append(body)

    def text(value: str) -> None:
        if not value:
            return
        if stack[-1] in (root, head):
            if not value.strip(" \t\n\r\f"):
                return
            open_body()
        stack[-1].children.append(value)

    def close(names: frozenset[str], stops: frozenset[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in names:
                # Further up, an ended row or section may hold the ended cell.
                j = i
                while j - 1 > 0 and stack[j - 1].tag in names:
                    j -= 1
                del stack[j:]
                return
            if tag in stops or tag == "body":
                return

    def foreign() -> int:
        """Place of the outermost element of the open SVG or MathML that a tag would belong to; 0 in HTML."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in FOREIGN:
                while stack[i - 1].tag not in HOLDS_HTML and any(n.tag in FOREIGN for n in stack[1:i]):
                    i -= 1
                return i
            if stack[i].tag in HOLDS_HTML:
                return 0
        return 0

    foreign_seen = False
    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.search(source, at)
        if m is None:
            text(html.unescape(source[at:]))
            break
        text(html.unescape(source[at : m.start()]))
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in ("html", "body", "head"):
                if tag == "head" and stack[-1] is head:
                    stack.pop()
                continue
            if tag == "p" and not any(n.tag == "p" for n in stack):
                open_body()
                stack[-1].children.append(Node("p"))
                continue
            limit = _TABLE if tag not in ("table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption") else frozenset()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag and stack[i] is not body:
                    del stack[i:]
                    break
                if stack[i].tag in limit or stack[i] is body:
                    break
            continue
        inside = foreign() if foreign_seen else 0
        if inside and tag in ENDS_FOREIGN:
            del stack[inside:]
            inside = 0
        foreign_seen = foreign_seen or tag in FOREIGN
        single = (inside or tag in FOREIGN) and m[3].endswith("/")
        attributes = {a.lower(): html.unescape(x or y or z) for a, x, y, z in _ATTRIBUTE.findall(m[3])}
        if tag == "html":
            root.attributes |= attributes
            continue
        if tag == "head":
            if body is None and stack[-1] is root:
                stack.append(head)
            continue
        if tag == "body":
            open_body()
            body.attributes |= attributes
            continue
        if body is None and (tag not in HEAD_ONLY):
            open_body()
        elif body is None and stack[-1] is root:
            stack.append(head)
        if tag in ENDS_P:
            close(frozenset(["p"]), _P_SCOPE)
        if tag in IMPLIED_ENDS:
            close(*IMPLIED_ENDS[tag])
        if tag in ("td", "th") and stack[-1].tag in ("table", "thead", "tbody", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            stack.append(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if tag in VOID or single:
            continue
        if tag in RAW or tag in RAW_WITH_ENTITIES:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(source, at)
            raw = source[at : closing.start() if closing else end]
            node.children.append(html.unescape(raw) if tag in RAW_WITH_ENTITIES else raw)
            at = closing.end() if closing else end
            continue
        if len(stack) < DEEPEST:
            stack.append(node)
    return root


def _declared(style: str, name: str) -> str | None:
    found = None
    for part in style.split(";"):
        key, colon, value = part.partition(":")
        if colon and key.strip().lower() == name:
            found = value.replace("!important", "").strip().lower()
    return found


def _applies(query: str) -> bool | None:
    """Whether a media query list holds on the screen; None where that isn't known."""
    told: list[bool | None] = []
    for part in query.lower().split(","):
        words = part.replace("(", " (").split()
        negated, words = words[:1] == ["not"], [w for w in words if w not in ("not", "only")] if words[:1] in (["not"], ["only"]) else words
        rest = " ".join(words)
        kind = re.match(r"[a-z-]+", rest)
        holds: bool | None = kind is None or kind[0] in ("all", "screen")
        if kind:
            rest = re.sub(r"^\s*and\b", "", rest[kind.end() :])
        for low, side, size, scale in _FEATURE.findall(rest):
            pixels = float(size) * (1 if scale == "px" else 16)
            holds = holds and (VIEWPORT[side] >= pixels if low == "min" else VIEWPORT[side] <= pixels)
        if holds and re.sub(r"\band\b", "", _FEATURE.sub("", rest)).strip():
            holds = None
        told.append(not holds if negated and holds is not None else holds)
    return True if True in told else None if None in told else False


def _rules(css: str, known: bool) -> Iterator[tuple[str, str, bool]]:
    """(selectors, declarations, whether they surely apply), through the at-rules that may apply; rules inside rules are left out."""
    css = _SKIPPED.sub(lambda m: " " if m[1] else "''", css)
    # Open blocks: whether they hold (None: not known), then selectors and declarations if it is an outer style rule.
    opened: list[tuple[bool | None, str | None, list[str]]] = []
    at = 0
    for m in [*_BRACE.finditer(css), None]:
        text, at = css[at : m.start() if m else len(css)], m.end() if m else len(css)
        holds, selectors, declared = opened[-1] if opened else (known or None, None, [])
        if m and m[0] == "{":
            prelude = text.strip()
            if any(x[1] is not None for x in opened[-1:]) or holds is False:
                opened.append((False, None, []))
            elif prelude.startswith("@"):
                name, query = re.match(r"@([\w-]*)(.*)", prelude, re.S).groups()
                inner = _applies(query) if name.lower() == "media" else {"layer": True, "supports": None, "container": None, "scope": None}.get(name.lower(), False)
                opened.append((inner and holds if inner else inner, None, []))
            else:
                opened.append((holds, prelude, []))
            continue
        declared.append(text)
        if m is None or m[0] == "}":
            if selectors is not None:
                yield selectors, ";".join(declared), holds is True
            opened[-1:] = []


def _selector(text: str) -> list[tuple[str, list[tuple[str, str, str | None]]]] | None:
    """(combinator, simple selectors) from the element outwards; None for what isn't known (pseudo-classes, siblings)."""
    parts = _COMBINED.split(text.strip())
    out = []
    for combinator, compound in zip(["", *parts[1::2]], parts[::2]):
        simple, at = [], 0
        while at < len(compound):
            m = _SIMPLE.match(compound, at)
            if not m or (m[1] == "" and m[2] and at):
                return None
            simple.append((m[1] or ("[" if m[3] else "t"), (m[2] if m[1] else (m[2] or m[3]).lower()), m[4]))
            at = m.end()
        if not simple:
            return None
        out.append((combinator, simple))
    return out[::-1]


def _fits(node: Node, simple: list[tuple[str, str, str | None]]) -> bool:
    for kind, name, value in simple:
        if kind == "t":
            good = name in ("*", node.tag)
        elif kind == ".":
            good = name in node.attributes.get("class", "").split()
        elif kind == "#":
            good = node.attributes.get("id") == name
        else:
            good = name in node.attributes and (value is None or node.attributes[name] == value)
        if not good:
            return False
    return True


class _Sheet:
    """A page's rules for display and visibility, by a name that the element itself must have.

    Selectors of several parts are matched on one way down the tree: each element learns which first parts of which
    selectors it ends, from those that its parent ends (children) and its ancestors end (descendants), one bit a part.
    """

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple]] = {}
        self.parts: dict[str, list[tuple[int, bool, bool, list]]] = {}
        self.last: dict[int, int] = {}
        self.ended: dict[int, set[int]] = {}
        count, bits, todo = 0, 0, [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                whole = _applies(node.attributes["media"]) if node.attributes.get("media", "").strip() else True
                css = "".join(c for c in node.children if isinstance(c, str))
                for selectors, body, known in _rules(css, whole is True) if whole is not False else ():
                    for name in ("display", "visibility"):
                        if (value := _declared(body, name)) is not None and (known or value not in ("none", "hidden", "collapse")):
                            for one in selectors.split(","):
                                if found := _selector(one):
                                    count += 1
                                    self._add(found, name, value, count, bits)
                                    bits += len(found)
            else:
                todo += [c for c in reversed(node.children) if isinstance(c, Node)]
        if self.parts:
            self._descend(root)

    def _add(self, found: list, name: str, value: str, order: int, bit: int) -> None:
        kinds = [k for _, simple in found for k, n, _ in simple if n != "*"]
        weight = (kinds.count("#"), kinds.count(".") + kinds.count("["), kinds.count("t"), order)
        deep = len(found) > 1
        self.rules.setdefault(_key(found[0][1]), []).append((weight, name, value, order if deep else None, found[0][1]))
        if deep:
            for j, (combinator, simple) in enumerate(reversed(found)):
                self.parts.setdefault(_key(simple), []).append((1 << (bit + j), combinator == ">", j == 0, simple))
            self.last[1 << (bit + len(found) - 1)] = order

    def _descend(self, root: Node) -> None:
        todo = [(root, 0, 0)]
        while todo:
            node, above, parent = todo.pop()
            here = 0
            for key in _keys(node):
                for bit, near, first, simple in self.parts.get(key, ()):
                    if (first or (parent if near else above) & (bit >> 1)) and _fits(node, simple):
                        here |= bit
                        if bit in self.last:
                            self.ended.setdefault(id(node), set()).add(self.last[bit])
            todo += [(c, above | here, here) for c in node.children if isinstance(c, Node)]

    def value(self, node: Node, name: str) -> str | None:
        ended = self.ended.get(id(node), ())
        hits = [r for k in _keys(node) for r in self.rules.get(k, ()) if r[1] == name and (r[3] in ended if r[3] is not None else _fits(node, r[4]))]
        return max(hits, key=lambda r: r[0])[2] if hits else None


def _key(simple: list[tuple[str, str, str | None]]) -> str:
    """The name by which a compound selector is looked up: its id, a class, its tag, or any."""
    return next((k + n for want in "#.t" for k, n, _ in simple if k == want and n != "*"), "*")


def _keys(node: Node) -> list[str]:
    return ["*", "t" + node.tag, *dict.fromkeys("." + c for c in node.attributes.get("class", "").split()), "#" + node.attributes.get("id", "")]


class _Seen:
    """Visibility of elements under one page's rules."""

    def __init__(self, root: Node):
        self.sheet = _Sheet(root)

    def style(self, node: Node, name: str) -> str | None:
        found = self.sheet.value(node, name) if self.sheet.rules else None
        if "style" in node.attributes:
            found = _declared(node.attributes["style"], name) or found
        return found

    def displayed(self, node: Node) -> bool:
        if node.tag in NEVER_SHOWN or "hidden" in node.attributes:
            return False
        if node.tag == "input" and node.attributes.get("type", "").lower() == "hidden":
            return False
        if node.tag == "dialog" and "open" not in node.attributes:
            return self.style(node, "display") not in (None, "none")
        return self.style(node, "display") != "none"

    def visible(self, node: Node, inherited: bool) -> bool:
        value = self.style(node, "visibility")
        return inherited if value in (None, "inherit") else value == "visible"


class _Lines:
    """Lines under construction: collapses white space, keeps wanted empty lines apart from written ones."""

    def __init__(self):
        self.lines: list[str] = []
        self.now, self.gap = "", 0

    def write(self, value: str, keep: bool = False) -> None:
        if keep:
            first, *rest = value.split("\n")
            self._add(first)
            for x in rest:
                self.break_line()
                self._add(x)
            return
        value = _SPACE.sub(" ", value)
        if not self.now or self.now.endswith(" "):
            value = value.lstrip(" ")
        if value:
            self._add(value)

    def _add(self, value: str) -> None:
        if value and not self.now:
            self.lines += [""] * (self.gap if self.lines else 0)
            self.gap = 0
        self.now += value

    def break_line(self) -> None:
        """Ends the line, empty or not."""
        if not self.now and self.gap:
            return
        self.lines.append(self.now.rstrip(" "))
        self.now = ""

    def block(self, spaced: bool) -> None:
        if self.now.strip(" "):
            self.lines.append(self.now.rstrip(" "))
        self.now = ""
        self.gap = max(self.gap, int(spaced))

    def done(self) -> list[str]:
        self.block(False)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _cells(table: Node, seen: _Seen) -> Iterator[tuple[str, Node]]:
    """("caption", node), or ("row", tr) in document order, through the table's sections."""
    for child in table.children:
        if isinstance(child, Node) and seen.displayed(child):
            if child.tag == "tr":
                yield "row", child
            elif child.tag in ("thead", "tbody", "tfoot"):
                yield from _cells(child, seen)
            elif child.tag not in ("colgroup", "col"):
                yield "caption", child
        elif isinstance(child, str) and child.strip(" \t\n\r\f"):
            holder = Node("caption")
            holder.children.append(child)
            yield "caption", holder


def _span(cell: Node, name: str, most: int) -> int:
    """A cell's columns or rows, as many as browsers allow; 1 where none are given."""
    value = cell.attributes.get(name, "1").strip()
    return max(1, min(int(value), most)) if value.isascii() and value.isdigit() and len(value) < 10 else 1


def _table(table: Node, seen: _Seen, visible: bool, out: _Lines) -> None:
    rows: list[list[list[str]]] = []
    below: dict[int, int] = {}  # columns that cells of earlier rows reach into, and for how many more rows
    for kind, node in _cells(table, seen):
        inner = seen.visible(node, visible)
        if kind == "caption":
            lines = _Lines()
            _render(node, seen, inner, lines, 0)
            for line in lines.done():
                out.write(line, True)
                out.block(False)
            continue
        row: list[list[str]] = []
        taken, below = below, {i: n - 1 for i, n in below.items() if n > 1}

        def put(lines: list[str], down: int = 1) -> None:
            while len(row) in taken:
                row.append([""])
            if down > 1:
                below[len(row)] = down - 1
            row.append(lines)

        for cell in node.children:
            if isinstance(cell, Node) and seen.displayed(cell):
                lines = _Lines()
                _render(cell, seen, seen.visible(cell, inner), lines, 0)
                down = _span(cell, "rowspan", 65_534)
                put(lines.done() or [""], down)
                for _ in range(_span(cell, "colspan", 1000) - 1):
                    put([""], down)
            elif isinstance(cell, str) and cell.strip(" \t\n\r\f"):
                put([_SPACE.sub(" ", cell).strip(" ")] if inner else [""])
        if row:
            rows.append(row)
    widths = [0] * max(map(len, rows), default=0)
    for row in rows:
        for i, cell in enumerate(row):
            widths[i] = max(widths[i], *(len(line) for line in cell if len(line) <= WIDEST), 0)
    for row in rows:
        for k in range(max(map(len, row))):
            line = " | ".join((cell[k] if k < len(cell) else "").ljust(widths[i]) for i, cell in enumerate(row))
            if line.strip(" |"):
                out.write(line.rstrip(" "), True)
                out.block(False)


def _svg(node: Node, seen: _Seen, visible: bool, out: _Lines, depth: int) -> None:
    """A drawing's text elements, a line each, and the HTML inside it."""
    for child in node.children:
        if isinstance(child, str) or child.tag in SVG_NEVER_SHOWN or not seen.displayed(child) or child.attributes.get("display") == "none":
            continue
        shown = seen.visible(child, visible if (own := child.attributes.get("visibility", "inherit")) == "inherit" else own == "visible")
        if child.tag in ("text", "foreignobject"):
            out.block(False)
            _render(child, seen, shown, out, depth)
            out.block(False)
        else:
            _svg(child, seen, shown, out, depth)


def _render(node: Node, seen: _Seen, visible: bool, out: _Lines, depth: int, keep: bool = False) -> None:
    number = int(node.attributes["start"]) if node.tag == "ol" and re.fullmatch(r"-?\d{1,9}", node.attributes.get("start", "")) else 1
    for child in node.children:
        if isinstance(child, str):
            if visible:
                out.write(child, keep)
            continue
        if not seen.displayed(child):
            continue
        tag, shown = child.tag, seen.visible(child, visible)
        if tag == "br":
            out.break_line()
        elif tag == "table":
            out.block(True)
            _table(child, seen, shown, out)
            out.block(True)
        elif tag == "hr":
            out.block(True)
        elif tag == "li":
            out.block(False)
            lines = _Lines()
            _render(child, seen, shown, lines, depth + 1, keep)
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            for i, line in enumerate(lines.done()):
                out.write(((mark if i == 0 else " " * len(mark)) + line) if line else " ", True)
                out.block(False)
        elif tag == "details" and "open" not in child.attributes:
            summary = next((c for c in child.children if isinstance(c, Node) and c.tag == "summary" and seen.displayed(c)), None)
            out.block(False)
            if summary:
                _render(summary, seen, seen.visible(summary, shown), out, depth, keep)
            out.block(False)
        elif tag in BLOCKS or tag in ("td", "th"):
            spaced = tag in SPACED and not (depth and tag in _LIST)
            out.block(spaced)
            if shown and tag in ("option", "optgroup") and (label := child.attributes.get("label", "").strip()) and (tag == "optgroup" or not child.children):
                out.write(label, keep)
                out.block(False)
            _render(child, seen, shown, out, depth, keep or tag == "pre")
            out.block(spaced)
        elif tag == "svg":
            _svg(child, seen, shown, out, depth)
        elif tag in MATH_NEVER_SHOWN:
            continue
        elif tag == "img":
            continue
        elif tag == "input":
            kind = child.attributes.get("type", "").strip().lower()
            if shown and kind in BUTTONS:
                out.write(" " + child.attributes.get("value", BUTTONS[kind]) + " ", keep)
        else:
            if tag in ("mtr", "select"):
                out.block(False)
            elif tag == "mtd":
                out.write(" ", keep)
            _render(child, seen, shown and tag != "mphantom", out, depth, keep or tag == "textarea")
            if tag in ("mtr", "select"):
                out.block(False)


def text_of(source: str) -> str:
    """All visible text of a page."""
    if sys.getrecursionlimit() < 4 * DEEPEST + 1000:
        sys.setrecursionlimit(4 * DEEPEST + 1000)
    root = parse(source)
    seen, out = _Seen(root), _Lines()
    if seen.displayed(root):
        _render(root, seen, seen.visible(root, True), out, 0)
    return "\n".join(out.done())


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, text, n_chars (code points).

    Null and empty pages give empty text; broken markup is repaired as the tree builder can, never refused; pages of any
    length are read whole; repeated rows give a row each and an empty table none.
    """
    ship(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text_of(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "text", "n_chars"])

    return pages.select(F.col(id_col).alias("page_id"), F.col(html_col).alias("html")).mapInArrow(run, f"page_id {kind}, text string, n_chars bigint")


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))
