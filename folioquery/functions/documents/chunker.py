"""Markdown chunks within a token budget: sentences packed greedily, tables whole with their context."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from . import flat_map
from .tables import minify

Counter = Callable[[str], int]
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
_TOKEN = re.compile(r"\w+|[^\w\s]")
CONTEXT_TOKENS = 128


def count_tokens(text: str) -> int:
    """The offline counter: words and punctuation marks."""
    return len(_TOKEN.findall(text))


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s]


@dataclass(frozen=True)
class Block:
    kind: str  # header, text or table
    text: str
    page: int


def blocks_of(pages: Sequence[dict]) -> list[Block]:
    """Lines with # are headers, runs of lines with | one table (of the page where it ends), other lines text."""
    out: list[Block] = []
    table: list[str] = []
    last = 0

    def close(page: int) -> None:
        if table:
            out.append(Block("table", minify("\n".join(table)), page))
            table.clear()

    for page in pages:
        last = page["page"]
        for line in (page["content"] or "").split("\n"):
            if "|" in line:
                table.append(line)
                continue
            close(last)
            out.append(Block("header" if line.startswith("#") else "text", line, last))
    close(last)
    return out


def context_of(blocks: Sequence[Block], at: int, count: Counter) -> list[Block]:
    """What a table brings along from its page: the header above, or up to two short texts; 128 tokens at most."""
    found: list[Block] = []
    room, texts = CONTEXT_TOKENS, 0
    for b in reversed(blocks[:at]):
        if b.page != blocks[at].page or b.kind == "table" or texts == 2:
            break
        if not b.text.strip():
            continue
        room -= count(b.text)
        if room < 0:
            break
        found.insert(0, b)
        texts += b.kind == "text"
        if b.kind == "header":
            break
    return found


class _Packer:
    """Blocks of the open chunk, and the chunks closed so far."""

    def __init__(self, size: int, overlap: int, count: Counter):
        self.size, self.overlap, self.count = size, overlap, count
        self.done: list[list[Block]] = []
        self.open: list[Block] = []
        self.used = 0

    def add(self, *blocks: Block) -> None:
        self.open += blocks
        self.used += sum(self.count(b.text) for b in blocks)

    def close(self) -> None:
        """End the chunk and begin the next with what overlaps; nothing overlaps if all would."""
        if not self.open:
            return
        self.done.append(self.open)
        tail: list[Block] = []
        room = self.overlap
        for b in reversed(self.open):
            units = sentences(b.text) if b.kind == "text" else [b.text]
            kept: list[str] = []
            for u in reversed(units):
                if self.count(u) > room:
                    break
                room -= self.count(u)
                kept.insert(0, u)
            if kept:
                tail.insert(0, replace(b, text=" ".join(kept)))
            if len(kept) < len(units):
                break
        self.open = tail if tail != self.open else []
        self.used = sum(self.count(b.text) for b in self.open)


def pack(blocks: Sequence[Block], size: int = 512, overlap: int = 128, count: Counter = count_tokens) -> list[list[Block]]:
    """Chunks of blocks. A sentence above the budget is a chunk of its own; a table is never cut."""
    p = _Packer(size, overlap, count)
    for i, b in enumerate(blocks):
        if b.kind == "text":
            held: list[str] = []
            for s in sentences(b.text) or [b.text]:
                if p.used + sum(map(count, held)) + count(s) > size and (held or p.open):
                    if held:
                        p.add(replace(b, text=" ".join(held)))
                    p.close()
                    held = []
                held.append(s)
            if held and (held != [""] or p.open):
                p.add(replace(b, text=" ".join(held)))
        elif b.kind == "table":
            context = [c for c in context_of(blocks, i, count) if c not in p.open]
            if p.used + sum(count(c.text) for c in (*context, b)) <= size:
                p.add(*context, b)
            else:
                context = context_of(blocks, i, count)
                if [x for x in p.open if x.text.strip()] != context:
                    p.close()
                    p.open, p.used = [], 0
                else:
                    p.open, p.used = [], 0  # the open chunk is nothing but this table's context
                p.add(*context, b)
        else:
            table_next = i + 1 < len(blocks) and blocks[i + 1].kind == "table"
            if p.open and not (table_next and p.used < overlap) and p.used + count(b.text) > size:
                p.close()
            p.add(b)
    if any(x.text.strip() for x in p.open):
        p.done.append(p.open)
    return p.done


def finish(chunk: Sequence[Block], header: str = "") -> dict:
    """A chunk's columns: content, its text by page, the text to embed, whether it has a table."""
    by_page: dict[int, list[str]] = {}
    for b in chunk:
        by_page.setdefault(b.page, []).append(b.text)
    pages = [{"page": p, "content": "\n".join(t).strip()} for p, t in sorted(by_page.items())]
    content = "\n".join(b.text for b in chunk).strip()
    return {"page": pages[0]["page"], "pages": pages, "content": content, "embedding_text": f"{header}\n\n{content}" if header else content, "has_table": any(b.kind == "table" for b in chunk)}


def split(pages: Sequence[dict], header: str = "", size: int = 512, overlap: int = 128, count: Counter = count_tokens) -> list[dict]:
    return [finish(c, header) for c in pack(blocks_of(pages), size, overlap, count)]


CHUNK = "id long, index int, page int, pages array<struct<page:int,content:string>>, content string, embedding_text string, has_table boolean"


def chunk_pages(rows: DataFrame, size: int = 1024, overlap: int = 0, count: Counter = count_tokens) -> DataFrame:
    """From (id, pages, header) one row a chunk, index from 0."""

    def work(row: dict) -> Iterator[dict]:
        for i, c in enumerate(split(row["pages"] or [], row["header"] or "", size, overlap, count)):
            yield {"id": row["id"], "index": i, **c}

    return flat_map(rows.select("id", "pages", "header"), work, CHUNK)
