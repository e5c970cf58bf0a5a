"""HTML to markdown pages, on the standard library's tokenizer.

The document becomes a small tree; rendering turns the tree into a flat list of marks (text, block edge, page break),
and pages are assembled from that list. No step recurses, so markup may be nested to any depth. Emphasis inside emphasis of the same kind is not
marked again.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

from . import positioned, tables

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIP = frozenset("script style head title noscript template".split())
BLOCK = frozenset("address article aside blockquote body center dd div dl dt fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split())
BULLETS = "•·∙◦▪▫●○■□-–"
#: Opening one of these ends an open one of the others.
IMPLIED = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}
_SCOPE = {"li": {"ul", "ol"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}}
EDGE, BREAK = object(), object()
_INVISIBLE = dict.fromkeys((0x200B, 0xFEFF)) | {0xA0: " "}


@dataclass(slots=True)
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list[Node | str] = field(default_factory=list)
    #: Whether a block is somewhere below; set once the tree is whole.
    blocks: bool = False

    @property
    def style(self) -> dict[str, str]:
        if "style" not in self.attrs:
            return {}
        parts = (p.partition(":") for p in self.attrs.get("style", "").split(";"))
        return {k.strip().lower(): v.strip().lower() for k, _, v in parts if k.strip()}

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order."""
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            node = todo.pop()
            yield node
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]

    def text(self, sep: str = " ") -> str:
        parts, todo = [], self.children[::-1]
        while todo:
            c = todo.pop()
            if isinstance(c, str):
                parts.append(clean(c))
            elif c.name not in SKIP:
                todo += reversed(c.children)
        return sep.join(p for p in parts if p).strip()


class _Tree(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("root")
        self.open = [self.root]
        self.names: Counter[str] = Counter()

    def _cut(self, at: int) -> None:
        """Close the elements from a place of the stack on."""
        for n in self.open[at:]:
            self.names[n.name] -= 1
        del self.open[at:]

    def _close_implied(self, name: str) -> None:
        ends = IMPLIED.get(name)
        if not ends or not any([self.names[x] > 0 for x in ends]):
            return
        stop = _SCOPE.get(name, ())
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name in stop or (name == "p" and self.open[i].name in {"div", "td", "th", "li", "article", "section", "body"}):
                return
            if self.open[i].name in ends:
                self._cut(i)
                return

    def handle_starttag(self, tag, attrs):
        if tag in IMPLIED:
            self._close_implied(tag)
        node = Node(tag, {k: v or "" for k, v in attrs} if attrs else {})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)
            self.names[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self._close_implied(tag)
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        if self.names[tag] <= 0:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                self._cut(i)
                return

    def handle_data(self, data):
        self.open[-1].children.append(data)


#: A tag as most documents have them; the rest goes through the standard library's tokenizer.
_PLAIN = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z_][-a-zA-Z0-9_:.]*(?:=(?:"[^"<>]*"|'[^'<>]*'|[^\s"'=<>`/]+))?)*)\s*(/?)>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_][-a-zA-Z0-9_:.]*)(?:=(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`/]+)))?""")
_RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript plaintext".split())


def _plain(tree: _Tree, html: str) -> bool:
    """Feed the tree from plain tags alone; False, and nothing done, if there is other markup."""
    parts = _PLAIN.split(html)
    if 5 * html.count("<") != len(parts) - 1 or not _RAW.isdisjoint(x.lower() for x in parts[2::5]):
        return False
    text = unescape if "&" in html else str
    if parts[0]:
        tree.handle_data(text(parts[0]))
    for i in range(1, len(parts), 5):
        ending, name, attributes, closed, after = parts[i : i + 5]
        name = name.lower()
        if ending:
            tree.handle_endtag(name)
        else:
            found = [(k.lower(), text(a or b or c)) for k, a, b, c in _ATTRIBUTE.findall(attributes)] if attributes else ()
            (tree.handle_startendtag if closed else tree.handle_starttag)(name, found)
        if after:
            tree.handle_data(text(after))
    return True


def _feed_tag(tree: _Tree, tag: str) -> bool:
    """Feed one plain tag; False, and nothing done, if it is other markup."""
    m = _PLAIN.fullmatch(tag)
    if not m or m[2].lower() in _RAW:
        return False
    if m[1]:
        tree.handle_endtag(m[2].lower())
    else:
        found = [(k.lower(), unescape(a or b or c)) for k, a, b, c in _ATTRIBUTE.findall(m[3])]
        (tree.handle_startendtag if m[4] else tree.handle_starttag)(m[2].lower(), found)
    return True


def parse(html: str) -> Node:
    tree = _Tree()
    if not _plain(tree, html):
        tree.feed(html)
        tree.close()
    return body_of(tree.root)


def body_of(root: Node) -> Node:
    """The body of a whole tree, else its root; every node knows by now whether it holds a block."""
    below = list(root.walk())
    for node in reversed([root, *below]):  # children before their parents
        for c in node.children:
            if isinstance(c, Node) and (c.blocks or _is_block(c)):
                node.blocks = True
                break
    return next((n for n in below if n.name == "body"), root)


def clean(text: str) -> str:
    """Without zero-width marks, white space as single spaces."""
    return " ".join(text.translate(_INVISIBLE).split())


def _is_declaration(text: str) -> bool:
    """A stray style declaration, as "margin-top: 2px;": a name of letters and hyphens, one colon, and a semicolon at the end."""
    name, colon, value = text.partition(":")
    name = name.strip()
    return bool(colon) and name.replace("-", "").isalpha() and name.isascii() and value.endswith(";") and not set(":;{}") & set(value[:-1]) and bool(value[:-1].strip())


def text_of(node: str) -> str:
    t = clean(node)
    return "" if _is_declaration(t) else t


def _breaks(node: Node, side: str) -> bool:
    if "style" not in node.attrs:
        return False
    s = node.style
    return any(s.get(k) in ("always", "page") for k in (f"page-break-{side}", f"break-{side}"))


def _hidden(node: Node) -> bool:
    return node.name in SKIP or ("style" in node.attrs and node.style.get("display") == "none")


def emphasis(node: Node) -> int:
    """An element's own emphasis: 2 bold, 1 italic, added."""
    if "style" not in node.attrs:
        return 2 * (node.name in ("b", "strong")) + (node.name in ("i", "em"))
    s = node.style
    weight = s.get("font-weight", "")
    bold = node.name in ("b", "strong") or weight in ("bold", "bolder") or (weight.isdigit() and int(weight) >= 600)
    return 2 * bold + (node.name in ("i", "em") or s.get("font-style") in ("italic", "oblique"))


def mark(node: Node) -> str:
    """The markdown wrapper of an element's own emphasis."""
    return ("", "*", "**", "***")[emphasis(node)]


def _is_block(node: Node) -> bool:
    return node.name in BLOCK and not ("style" in node.attrs and node.style.get("display", "").startswith("inline"))


def _run(call: Generator):
    """Run generators that yield the generators they need a result of, on a stack of its own instead of Python's."""
    stack, value = [call], None
    while stack:
        try:
            while True:
                stack.append(stack[-1].send(value))
                value = None
        except StopIteration as done:
            stack.pop()
            value = done.value
    return value


def inline(node: Node | str) -> str:
    """An element as one piece of text."""
    return _run(_inline(node, 0))


def _inline(node: Node | str, around: int) -> Generator:
    if isinstance(node, str):
        return text_of(node)
    if _hidden(node):
        return ""
    if node.name == "table":
        return table_text(node)
    if node.name in ("ul", "ol"):
        return (yield _list(node))
    own = emphasis(node) & ~around if node.name != "li" else 0
    parts = []
    for c in node.children:
        if t := text_of(c) if isinstance(c, str) else (yield _inline(c, around | own)):
            parts.append(t)
    text = " ".join(parts).strip()
    return f"{'*' * own}{text}{'*' * own}" if text else ""


def _list(node: Node) -> Generator:
    items = []
    for c in node.children:
        if isinstance(c, Node) and c.name == "li":
            items.append((yield _inline(c, 0)))
    return listed(node.name, items)


def listed(name: str, items: list[str]) -> str:
    """The items of a list without bullets of their own; empty ones go."""
    items = [t for x in items if (t := x.lstrip(BULLETS).strip())]
    return "\n".join([f"{i}. {t}" for i, t in enumerate(items, 1)] if name == "ol" else [f"- {t}" for t in items])


def _own(node: Node) -> Iterator[Node]:
    """Elements below that are in no table within."""
    todo = [c for c in reversed(node.children) if isinstance(c, Node)]
    while todo:
        node = todo.pop()
        yield node
        if node.name != "table":
            todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def rows_of(table: Node) -> list[list[Node]]:
    """The table's own cells by row."""
    rows = ([c for c in _own(tr) if c.name in ("td", "th")] for tr in _own(table) if tr.name == "tr")
    return [row for row in rows if row]


def spans(cell: Node) -> tuple[int, int]:
    return tables.span(cell.attrs.get("rowspan")), tables.span(cell.attrs.get("colspan"))


def cells_of(table: Node) -> list[list[tables.Span]]:
    """The table's own cells; a table within a cell is that cell's text."""
    return [[tables.Span(c.text() or ("●" if any(x.name == "img" for x in c.walk()) else ""), *spans(c)) for c in row] for row in rows_of(table)]


def table_text(node: Node) -> str:
    cells = cells_of(node)
    rows = [r for r in cells if any(c.text for c in r)]
    if len(rows) <= 1:
        return banner([c.text for c in rows[0]] if rows else [])
    return tables.to_markdown(cells)


def banner(texts: list[str]) -> str:
    """A one-row table: a bullet item, an Item or Part header, or plain text."""
    if texts and any(t in BULLETS for t in texts if t) and any(t and t not in BULLETS for t in texts[1:]):
        return "- " + next(t for t in reversed(texts) if t and t not in BULLETS)
    words = texts[0].lower().removesuffix(".").split() if texts else []
    if len(words) == 2:
        kind, number = words
        figure = number[:-1] if number[-1].isalpha() else number
        if kind == "item" and figure.isdigit() and len(figure) <= 2:
            return f"ITEM {number.upper()}. {next((t for t in texts[1:] if t), '')}".strip()
        if kind == "part" and set(number) <= set("ivx"):
            return f"PART {number.upper()}"
    return " ".join(t for t in texts if t)


def marks(node: Node | str) -> list:
    """Text pieces, EDGE at block borders, BREAK at page borders."""
    out: list = []
    _run(_marks(node, out))
    return out


def _marks(node: Node | str, out: list) -> Generator:
    if isinstance(node, str):
        if t := text_of(node):
            out.append(t + " ")
        return
    if _hidden(node):
        return
    positioned_itself = "style" in node.attrs and node.style.get("position") == "absolute"
    block = not positioned_itself and _is_block(node)
    out += [BREAK] * _breaks(node, "before") + [EDGE] * block
    boxes = []
    if node.name == "div" and not positioned_itself:
        boxes = [c for c in node.children if isinstance(c, Node) and "style" in c.attrs and c.style.get("position") == "absolute" and c.text()]
    if boxes:
        # boxes without text between them are one layout; what flows beside them keeps its place
        layout, positions = [], {id(c) for c in boxes}
        for c in node.children:
            if id(c) in positions:
                layout.append(c)
                continue
            part: list = []
            yield _marks(c, part)
            if any(p is not EDGE and (p is BREAK or p.strip()) for p in part):
                lay_out([_box(c) for c in layout], out)
                out += [*part, EDGE]
                layout = []
        lay_out([_box(c) for c in layout], out)
    elif node.name in ("table", "ul", "ol"):
        out.append((yield _inline(node, 0)))
    elif emphasis(node) and not block and not node.blocks:
        if t := (yield _inline(node, 0)):
            out.append(t + " ")
    elif node.name == "br":
        out.append("\n")
    else:
        for c in node.children:
            if isinstance(c, Node):
                yield _marks(c, out)
            elif t := text_of(c):
                out.append(t + " ")
    out += [EDGE] * block + [BREAK] * _breaks(node, "after")


def lay_out(boxes: list[positioned.Box], out: list) -> None:
    """Positioned boxes as blocks of their own."""
    for piece in positioned.render(boxes) if boxes else ():
        out += [EDGE, piece, EDGE]


def place(node: Node) -> tuple[float, float, bool]:
    """Left and top of a positioned box, and whether it is bold."""
    s = node.style
    px = lambda k: float(m[1]) if (m := re.match(r"(-?\d+(?:\.\d+)?)px", s.get(k, ""))) else 0.0
    return px("left"), px("top"), any(emphasis(c) & 2 for c in (node, *node.walk()))


def _box(node: Node) -> positioned.Box:
    left, top, bold = place(node)
    return positioned.Box(left, top, node.text(), bold)


def to_pages(html: str | None) -> list[dict]:
    """[{page, content}] from 1; pages without content are kept, so that numbers stay those of the breaks."""
    from . import templates

    known = templates.find(html) if html else None
    pages: list[list] = [[]]
    for m in known[0].marks(known[1]) if known else marks(parse(html or "")):
        if m is BREAK:
            pages.append([])
        else:
            pages[-1].append(m)
    return [{"page": i, "content": assemble(p)} for i, p in enumerate(pages, 1)]


def assemble(pieces: list) -> str:
    """Blocks apart by one blank line, lines trimmed."""
    blocks: list[list[str]] = [[]]
    for p in pieces:
        if p is not EDGE:
            blocks[-1].append(p)
        elif blocks[-1]:
            blocks.append([])
    text = "\n\n".join(b for b in ("".join(x).strip() for x in blocks) if b)
    lines = [x.strip() for x in text.split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def retention(html: str | None, pages: list[dict]) -> float | None:
    """Output characters for each character of the document's visible text."""
    total = len(parse(html or "").text())
    return sum(len(p["content"]) for p in pages) / total if total else None


def note_cells(root: Node) -> list[Node] | None:
    """The cells of the outer table's own rows; None without a table."""
    table = next((n for n in root.walk() if n.name == "table"), None)
    if table is None:
        return None
    body = [table, *(c for c in table.children if isinstance(c, Node) and c.name in ("tbody", "thead", "tfoot"))]
    rows = [r for b in body for r in b.children if isinstance(r, Node) and r.name == "tr"]
    return [c for r in rows for c in r.children if isinstance(c, Node) and c.name in ("td", "th")]


def flatten_note(html: str | None) -> str:
    """The outer table's own rows, cells joined: how notes are laid out."""
    from . import templates

    if html and (known := templates.find(html)):
        cells = known[0].note(known[1])
    else:
        found = note_cells(parse(html or ""))
        cells = None if found is None else [marks(c) for c in found]
    if cells is None:
        return "\n\n".join(p["content"] for p in to_pages(html))
    return "\n\n".join(p for p in map(assemble, cells) if p)
