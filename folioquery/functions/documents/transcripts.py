"""Transcripts: speakers, segments, chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import flat_map
from .chunker import count_tokens

_TURN = re.compile(r"^([A-Za-z .]{2,50}):", re.M)
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
# Lines that open a transcript and name no turn.
_LEADS = ("Executives: ", "Analysts: ", "Company Representatives")


def parse(text: str | None) -> list[dict]:
    """[{speaker, content}]; text before the first speaker, and empty turns, are left out."""
    text = text or ""
    for lead in _LEADS:
        if text.startswith(lead):
            text = text.partition("\n")[2]
    found = list(_TURN.finditer(text))
    ends = [*(m.start() for m in found[1:]), len(text)] if found else []
    turns = [{"speaker": m[1].strip(), "content": text[m.end() : end].strip()} for m, end in zip(found, ends, strict=True)]
    return [t for t in turns if t["speaker"] and t["content"]]


def pieces(turn: dict, most: int, count: Callable[[str], int]) -> list[dict]:
    """A turn within ``most`` tokens, or cut at sentence ends into parts that keep the speaker."""
    if count(turn["content"]) <= most:
        return [turn]
    parts: list[list[str]] = []
    used = 0
    for s in filter(None, map(str.strip, _SENTENCE.split(turn["content"]))):
        if not parts or used + count(s) > most:
            parts.append([])
            used = 0
        parts[-1].append(s)
        used += count(s)
    return [{"speaker": turn["speaker"], "content": " ".join(p)} for p in parts]


def split(turns: Sequence[dict], chunk: int = 1024, section: int = 512, count: Callable[[str], int] = count_tokens) -> list[list[dict]]:
    """Chunks of turns; each turn of the Operator starts a new one."""
    out: list[list[dict]] = []
    used = 0
    for turn in turns:
        fresh = turn["speaker"] == "Operator"
        for piece in pieces(turn, section, count):
            n = count(piece["content"])
            if not out or fresh or used + n > chunk:
                out.append([])
                used, fresh = 0, False
            out[-1].append(piece)
            used += n
    return out


TURNS = "array<struct<speaker:string,content:string>>"


def parse_transcripts(rows: DataFrame) -> DataFrame:
    """From (transcript_id, text) the sections column."""
    return flat_map(rows.select("transcript_id", "text"), lambda r: [{"transcript_id": r["transcript_id"], "sections": parse(r["text"])}], f"transcript_id long, sections {TURNS}")


def chunk_transcripts(rows: DataFrame, chunk: int = 1024, section: int = 512) -> DataFrame:
    """From (transcript_id, sections) one row a chunk; index starts at 1."""

    def work(row: dict) -> Iterator[dict]:
        for i, c in enumerate(split(row["sections"] or [], chunk, section), 1):
            yield {"transcript_id": row["transcript_id"], "index": i, "sections": c, "embedding_text": "\n\n".join(f"{t['speaker']}: {t['content']}" for t in c)}

    return flat_map(rows.select("transcript_id", "sections"), work, f"transcript_id long, index int, sections {TURNS}, embedding_text string")


def fiscal_period(quarter: Column) -> Column:
    """Calls stay with their quarter, the last one too."""
    return F.concat(F.lit("Q"), quarter.cast("string"))
