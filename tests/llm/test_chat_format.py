import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import chat_format as op

PIECES = st.lists(st.sampled_from(["###", "</turn>", "\\", "\n", " ", ":", "### a: ", "x", "é", "\n</turn>\n", "𝒳"]), max_size=9).map("".join)


@settings(max_examples=400, deadline=None)
@given(PIECES, PIECES)
def test_round_trip(role, text):
    rendered, start, end = op.format_turn(role, text)
    assert [(r, t) for r, t, _, _ in op.parse(rendered)] == [(role, text)]
    assert op.unescape(rendered[start:end]) == text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), max_size=5))
def test_conversations_parse_as_a_whole(turns):
    whole = "".join(op.format_turn(r, t)[0] for r, t in turns)
    assert [(r, t) for r, t, _, _ in op.parse(whole)] == turns


def test_only_conflicts_are_escaped():
    assert op.format_turn("user", "a ### b </turn> c")[0] == "### user: a ### b </turn> c\n</turn>\n"
    assert op.format_turn("user", r"\### x")[0] == "### user: \\\\### x\n</turn>\n"
    with pytest.raises(op.GrammarError):
        list(op.parse("no header"))


def test_digests_and_order(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (1, None, None, "z"), (None, 0, "assistant", "\n</turn>\n"), (2, 0, "user", "")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    got = {r.conv_id: r for r in op.read_back(op.format_turns(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("user\n\nassistant\na\nassistant\nb\n\nz\n") and got[1].n_turns == 4
    assert (got[1].loss_chars, got[1].loss_sha256) == (2, sha("ab"))
    assert got[None].loss_sha256 == sha("\n</turn>\n") and got[2].loss_sha256 == sha("")
    assert op.read_back(op.format_turns(df.where("false"))).collect() == []
