"""Table reconstruction: spans to a grid, split columns joined, headers fused, markdown out."""

from __future__ import annotations

import re
from dataclasses import dataclass

_FOOTNOTE = re.compile(r"\[[A-Za-z0-9]+\]")


@dataclass(frozen=True)
class Span:
    text: str
    rows: int = 1
    cols: int = 1


def span(value: str | None) -> int:
    digits = re.sub(r"\D", "", value or "")
    return max(1, int(digits)) if digits else 1


def placed(cells: list[list[Span]]) -> list[list[int]]:
    """Where spans put the cells: a grid of their numbers in reading order, -1 where a position is spanned or left free."""
    width = max((sum(c.cols for c in r) for r in cells), default=0)
    taken: dict[tuple[int, int], int] = {}
    n = -1
    for i, row in enumerate(cells):
        j, first = 0, n
        n += len(row)
        for k, c in enumerate(row, first + 1):
            while (i, j) in taken:
                j += 1
            if j >= width:
                break
            for di in range(min(c.rows, len(cells) - i)):
                for dj in range(c.cols):
                    taken.setdefault((i + di, j + dj), -1 if di or dj else k)
            j += c.cols
    return [[taken.get((i, j), -1) for j in range(width)] for i in range(len(cells))]


def filled(places: list[list[int]], texts: list[str]) -> list[list[str]]:
    """Spanned positions are blank; rows and columns without text go."""
    texts = [*map(str.strip, texts), ""]  # -1 is the last one
    grid = [[texts[k] for k in row] for row in places]
    rows = [r for r in grid if any(r)]
    keep = [any(col) for col in zip(*rows, strict=True)]
    return rows if all(keep) else [[x for x, kept in zip(r, keep, strict=True) if kept] for r in rows]


def grid_of(cells: list[list[Span]]) -> list[list[str]]:
    return filled(placed(cells), [c.text for row in cells for c in row])


def _joins(left: str, right: str) -> bool:
    return not left or not right or left == "$" or right == "%" or (right[0] == "[" and bool(_FOOTNOTE.fullmatch(right)))


def join_columns(grid: list[list[str]]) -> list[list[str]]:
    """Neighbours become one column where every body row allows it; the left header stays."""
    columns: list[list[str]] = []
    for col in map(list, zip(*grid, strict=True)):
        if columns and all(_joins(a, b) for a, b in zip(columns[-1][1:], col[1:], strict=True)):
            last = columns[-1]
            columns[-1] = [last[0] or col[0], *[f"{a} {b}" if a and b else a or b for a, b in zip(last[1:], col[1:], strict=True)]]
        else:
            columns.append(col)
    return [list(r) for r in zip(*columns, strict=True)]


def split_header(grid: list[list[str]]) -> tuple[list[str], list[list[str]]]:
    """A sparse first row over a filled second one is fused with it by a dash."""
    if len(grid) < 2:
        return [""] * len(grid[0]), grid
    top, second, n = grid[0], grid[1], len(grid[0])
    half = max(2, n // 2)
    if top.count("") >= half and sum(map(bool, second)) >= half:
        return [" — ".join(x for x in pair if x) for pair in zip(top, second, strict=True)], grid[2:]
    return top, grid[1:]


def to_markdown(cells: list[list[Span]]) -> str:
    """The first column is the stub; body columns and rows without text are left out."""
    return markdown_of(grid_of(cells))


def markdown_of(grid: list[list[str]]) -> str:
    if not grid:
        return ""
    header, body = split_header(join_columns(grid))
    body = [r for r in body if any(r)]
    if not body:
        return ""
    keep = [j for j, col in enumerate(zip(*body, strict=True)) if j == 0 or any(col)]
    whole = len(keep) == len(header)
    line = lambda r: "| " + " | ".join(r if whole else [r[j] for j in keep]) + " |"
    rows = [header, *body]
    if any("|" in x for r in rows for x in r):
        rows = [[x.replace("|", "\\|") for x in r] for r in rows]
    first, *others = map(line, rows)
    return "\n".join([first, "|" + "---|" * len(keep), *others])


def minify(table: str) -> str:
    """Cells trimmed, white space collapsed, the separator line in its shortest form."""
    out = []
    for i, raw in enumerate(table.strip().split("\n")):
        cells = [re.sub(r"\s+", " ", c).strip() for c in raw.strip().strip("|").split("|")]
        if i == 1 and all(re.fullmatch(r":?-+:?", c) for c in cells):
            cells = ["---"] * len(cells)
        out.append("|" + "|".join(cells) + "|")
    return "\n".join(out)
