import numpy as np
import pyarrow as pa
from helpers import words
from hypothesis import given, settings
from hypothesis import strategies as st

from folioquery.llm import kit

TEXT = st.text(alphabet=st.sampled_from(list("aB é\n\t\x0b\x1c　ß𝒳")), max_size=30)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8), st.integers(1, 40))
def test_words_are_the_words(texts, most):
    seen = {}
    got = []
    for _, _, data, bounds in kit.slices(pa.array(texts, pa.string()), most):
        w = kit.Words(data, bounds)
        packed, s, e = w.packed()
        each = [packed[a:b].decode() for a, b in zip(s, e)]
        assert packed.decode() == " ".join(each)
        for x, h in zip(each, w.hashes().tolist()):
            assert seen.setdefault(h, x) == x
        got += [each[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
    assert got == [words(t) for t in texts]


def test_lower_case_is_ascii_only():
    w = kit.Words(*kit.text_arrays(pa.array(["ÀB Zß"])), lower=True)
    assert w.packed()[0].decode() == "Àb zß"


def test_spans_depend_on_content_and_length():
    s = kit.Spans(np.array([5, 7, 5, 7, 5], np.uint64))
    a = s.of(np.array([0, 2, 0, 1]), np.array([2, 4, 3, 3]))
    assert a[0] == a[1] and len(set(a.tolist())) == 3


def test_files(tmp_path):
    kit.put_file(f"file://{tmp_path}/d/x", np.arange(5, dtype="<u8").tobytes())
    assert kit.map_file(f"file://{tmp_path}/d/x", "<u8", 0, 5).tolist() == [0, 1, 2, 3, 4]
    kit.put_file(f"{tmp_path}/d/none", b"")
    assert len(kit.map_file(f"{tmp_path}/d/none", "<u8", 0, 0)) == 0
