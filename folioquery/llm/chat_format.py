"""Chat formatting with a grammar round trip.

A turn is rendered as ``### <role>: <text>`` and a closing line ``</turn>``. A deterministic parser reads
rendered text back. A turn is first rendered as it is and parsed; where the turns recovered differ from the
source, the control strings that the parser stumbled over are escaped (one more backslash before each)
and it is rendered again, until what comes back is identical.

Turns are rendered and verified one by one in parallel, as the grammar does not look across turns. Only
reading a conversation back in order is sequential: its turns stream, sorted, through running digests, so
memory is bounded by a turn, not by a conversation.

Defined cases: a null text or role is empty; turns sort by turn (null last), then role and text, so ties have one
order; equal rows are turns of their own; rows with a null conv_id form one conversation; an empty table gives an
empty result. Roles may hold any characters. Other input columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

# Fixed values of the template.
OPEN, CLOSE = "### ", "\n</turn>\n"
CONTROLS = ("###", "</turn>")
_HEADER = re.compile(r"### ((?:\\.|[^\\:\n])*): ", re.S)
_CLOSE = re.compile(r"\n(</turn>)\n")
_ESCAPED = re.compile(r"\\(\\*(?:" + "|".join(map(re.escape, CONTROLS)) + "))")


class GrammarError(ValueError):
    """Rendered text that the grammar does not accept; ``at`` is where."""

    def __init__(self, at: int):
        super().__init__(f"no turn at {at}")
        self.at = at


def _role_out(role: str) -> str:
    return re.sub(r"[\\:\n]", lambda m: {"\n": "\\n"}.get(m[0], "\\" + m[0]), role)


def _role_in(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: {"n": "\n"}.get(m[1], m[1]), text, flags=re.S)


def escape(text: str, control: str) -> str:
    """One more backslash before every (escaped or plain) occurrence of a control string."""
    return re.sub(r"(\\*)" + re.escape(control), lambda m: m[1] + "\\" + control, text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """A turn without escapes in its text, and where the text begins."""
    head = f"{OPEN}{_role_out(role)}: "
    return head + text + CLOSE, len(head)


def parse(rendered: str) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn; start and end bound the text, still escaped, in ``rendered``."""
    at = 0
    while at < len(rendered):
        head = _HEADER.match(rendered, at)
        if not head:
            raise GrammarError(at)
        stop = _CLOSE.search(rendered, head.end() - 1)
        while stop and stop.start() < head.end():
            stop = _CLOSE.search(rendered, stop.start() + 1)
        if not stop:
            raise GrammarError(head.end())
        yield _role_in(head[1]), unescape(rendered[head.end() : stop.start()]), head.end(), stop.start()
        at = stop.end()


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered, start, end): the turn such that parsing returns exactly (role, text)."""
    body, todo = text, list(CONTROLS)
    while True:
        rendered, start = render(role, body)
        try:
            back = [(r, t) for r, t, _, _ in parse(rendered)]
        except GrammarError:
            back = []
        if back == [(role, text)]:
            return rendered, start, start + len(body)
        # escape the first control string, in order, that the text still holds plain or as if escaped
        control = next((c for c in todo if c in body), None)
        if control is None:
            raise GrammarError(start)
        todo.remove(control)
        body = escape(body, control)


TURN = "conv_id long, turn long, role string, text string, rendered string, start long, end long, in_loss boolean"


def format_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Each row with ``rendered``, the text's span (code points within ``rendered``) and whether the loss mask covers it.

    A conversation's formatted text is its turns' ``rendered`` in order, joined by nothing.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"))

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(2).to_pylist()
            made = [format_turn(r, t) for r, t in zip(roles, batch.column(3).to_pylist(), strict=True)]
            more = [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64()), pa.array([r == loss_role for r in roles], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], ["conv_id", "turn", "role", "text", "rendered", "start", "end", "in_loss"])

    return rows.transform(kit.mapping, go, TURN)


class _Reader:
    """Digests of one conversation, read back from its rendered turns."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, rendered: str, in_loss: bool, start: int, end: int) -> None:
        self.chars += len(rendered)
        for role, text, _, _ in parse(rendered):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        if in_loss:
            masked = unescape(rendered[start:end])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from the output of ``format_turns``."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            done = []
            for conv, rendered, loss, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "in_loss", "start", "end")), strict=True):
                if reader is None or conv != reader.conv_id:
                    if reader is not None:
                        done.append(reader.row())
                    reader = _Reader(conv)
                reader.read(rendered, loss, start, end)
            if done:
                yield out(done)
        if reader is not None:
            yield out([reader.row()])

    order = [F.col("conv_id").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("text").asc()]
    dealt = formatted.repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "rendered", "in_loss", "start", "end")
    return dealt.transform(kit.mapping, go, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
