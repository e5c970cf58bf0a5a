"""Markup that many documents share, worked out once.

Documents made by one program have the same tags in the same order and differ in what stands between them. The tags of a document (with their attributes) are its template; the tree, its blocks, its
emphasis and where a table's spans put each cell follow from the template alone. So when a worker meets a template again it is compiled into a function of the texts between
the tags, and every further document of that template costs a look-up and its texts. What comes out is what ``html`` gives by the tree, which stays the way for
single documents, deep ones and markup beyond plain tags.

A worker keeps templates of ``TAGS`` tags in all, and starts anew beyond.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from html import unescape

from . import html as h
from . import positioned, tables

#: Tags of a template, levels of its tree, and tags of all templates that a worker keeps.
LONGEST, DEEPEST, TAGS = 2000, 60, 50_000

_TAG = re.compile("<([^<>]*)>")
Texts = list[str]
Piece = Callable[[Texts], str]
Work = Callable[[Texts, list], None]


class Template:
    """Functions of a template's texts, which are clean; each is compiled when it is first asked for."""

    def __init__(self, root: h.Node):
        self.root = root
        self._marks: Work | None = None
        self._note: list[Work] | None = None

    def marks(self, texts: Texts) -> list:
        if self._marks is None:
            self._marks = _marks(self.root)
        out: list = []
        self._marks(texts, out)
        return out

    def note(self, texts: Texts) -> list[list] | None:
        """The marks of each cell of a note's outer table; None without a table."""
        if self._note is None:
            cells = h.note_cells(self.root)
            self._note = [] if cells is None else [_marks(c) for c in cells]
            self.has_table = cells is not None
        if not self.has_table:
            return None
        found = []
        for work in self._note:
            out: list = []
            work(texts, out)
            found.append(out)
        return found


_kept: dict[tuple[str, ...], Template | None] = {}
_seen: set[int] = set()
_tags = 0


def find(source: str) -> tuple[Template, Texts] | None:
    """A document's template, if it was met before and is one, and its clean texts."""
    global _tags
    n = source.count("<")
    if not 0 < n <= LONGEST:
        return None
    parts = _TAG.split(source)
    tags = tuple(parts[1::2])
    if len(tags) != n:
        return None
    if tags not in _kept:
        key = hash(tags)
        if key not in _seen:
            if len(_seen) >= TAGS:
                _seen.clear()
            _seen.add(key)
            return None
        if _tags + len(tags) > TAGS:
            _kept.clear()
            _tags = 0
        _kept[tags] = _compile(tags)
        _tags += len(tags)
    template = _kept[tags]
    if template is None:
        return None
    texts = parts[::2]
    if "&" in source:
        texts = [unescape(x) for x in texts]
    return template, [x and (" ".join(x.split()) if x.isascii() else h.clean(x)) for x in texts]


def _compile(tags: tuple[str, ...]) -> Template | None:
    tree = h._Tree()
    tree.handle_data(0)
    for i, tag in enumerate(tags, 1):
        # a text's number stands for it in the tree
        if not h._feed_tag(tree, f"<{tag}>") or len(tree.open) > DEEPEST:
            return None
        tree.handle_data(i)
    return Template(h.body_of(tree.root))


def _said(text: str) -> str:
    """``html.text_of`` of a clean text."""
    return "" if text.endswith(";") and h._is_declaration(text) else text


def _text(node: h.Node) -> Piece:
    """``Node.text``"""
    found, todo = [], node.children[::-1]
    while todo:
        c = todo.pop()
        if isinstance(c, int):
            found.append(c)
        elif c.name not in h.SKIP:
            todo += reversed(c.children)
    if len(found) == 1:
        at = found[0]
        return lambda texts: texts[at]
    return lambda texts: " ".join([t for i in found if (t := texts[i])])


def _inline(node: h.Node | int, around: int) -> Piece:
    """``html.inline``"""
    if isinstance(node, int):
        return lambda texts: _said(texts[node])
    if h._hidden(node):
        return lambda texts: ""
    if node.name == "table":
        return _table(node)
    if node.name in ("ul", "ol"):
        return _list(node)
    own = h.emphasis(node) & ~around if node.name != "li" else 0
    parts = [_inline(c, around | own) for c in node.children]
    stars = "*" * own

    def go(texts: Texts) -> str:
        text = " ".join([t for p in parts if (t := p(texts))]).strip()
        return f"{stars}{text}{stars}" if text else ""

    return go


def _list(node: h.Node) -> Piece:
    items = [_inline(c, 0) for c in node.children if isinstance(c, h.Node) and c.name == "li"]
    return lambda texts: h.listed(node.name, [p(texts) for p in items])


def _table(node: h.Node) -> Piece:
    rows = [[(_text(c), any(x.name == "img" for x in c.walk()), tables.Span("", *h.spans(c))) for c in row] for row in h.rows_of(node)]
    places = tables.placed([[s for *_, s in row] for row in rows])

    def go(texts: Texts) -> str:
        cells = [[text(texts) or ("●" if image else "") for text, image, _ in row] for row in rows]
        full = [r for r in cells if any(r)]
        if len(full) <= 1:
            return h.banner(full[0] if full else [])
        return tables.markdown_of(tables.filled(places, [t for row in cells for t in row]))

    return go


def _marks(node: h.Node | int) -> Work:
    """``html.marks``"""
    if isinstance(node, int):

        def say(texts: Texts, out: list) -> None:
            if t := _said(texts[node]):
                out.append(t + " ")

        return say
    if h._hidden(node):
        return lambda texts, out: None
    block = h._is_block(node) and node.style.get("position") != "absolute"
    before = [h.BREAK] * h._breaks(node, "before") + [h.EDGE] * block
    after = [h.EDGE] * block + [h.BREAK] * h._breaks(node, "after")
    inner = _within(node, block)

    def go(texts: Texts, out: list) -> None:
        out += before
        inner(texts, out)
        out += after

    return go


def _within(node: h.Node, block: bool) -> Work:
    boxes = [c for c in node.children if isinstance(c, h.Node) and c.style.get("position") == "absolute"] if node.name == "div" and node.style.get("position") != "absolute" else []
    if boxes:
        return _layout(node, boxes, _plain(node, block))
    return _plain(node, block)


def _plain(node: h.Node, block: bool) -> Work:
    if node.name in ("table", "ul", "ol"):
        piece = _inline(node, 0)
        return lambda texts, out: out.append(piece(texts))
    if h.emphasis(node) and not block and not node.blocks:
        piece = _inline(node, 0)

        def say(texts: Texts, out: list) -> None:
            if t := piece(texts):
                out.append(t + " ")

        return say
    if node.name == "br":
        return lambda texts, out: out.append("\n")
    each = [_marks(c) for c in node.children]

    def go(texts: Texts, out: list) -> None:
        for work in each:
            work(texts, out)

    return go


def _layout(node: h.Node, boxes: list[h.Node], plain: Work) -> Work:
    """Positioned boxes, and what flows beside them; boxes without a text are no boxes."""
    placed = {id(c): (_text(c), *h.place(c)) for c in boxes}
    each = [(placed.get(id(c)), _marks(c)) for c in node.children]

    def go(texts: Texts, out: list) -> None:
        found = [(box and (text := box[0](texts)) and positioned.Box(box[1], box[2], text, box[3]), work) for box, work in each]
        if not any([box for box, _ in found]):
            return plain(texts, out)
        layout: list[positioned.Box] = []
        for box, work in found:
            if box:
                layout.append(box)
                continue
            part: list = []
            work(texts, part)
            if any(p is not h.EDGE and (p is h.BREAK or p.strip()) for p in part):
                h.lay_out(layout, out)
                out += [*part, h.EDGE]
                layout = []
        h.lay_out(layout, out)

    return go
