import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from invq.llm import chunks
from invq.llm import words as W
from tests.llm import cases
from tests.llm.cases import split

texts = st.lists(st.one_of(st.none(), st.text(alphabet="ab é☃\n\t  ", max_size=30)), max_size=8)


@settings(max_examples=200, deadline=None)
@given(texts, st.integers(1, 40))
def test_words_equal_the_pattern(column, limit):
    found = []
    for part in W.slices(pa.array(column, pa.string()), limit):
        made = W.words(part)
        raw = part.data.tobytes()
        for row, a, b in zip(made.row, made.start, made.end, strict=True):
            found.append((part.first + row, raw[a:b].decode()))
    assert found == [(i, w) for i, t in enumerate(column) for w in split(t)]


def test_equal_words_and_windows_have_equal_hashes():
    parts = list(W.slices(pa.array(["x a b c", "a b c d", None, "a b c"]), 4))
    windows = []
    for part in parts:
        made = W.words(part)
        key, fits = W.windows(made, 3)
        raw = part.data.tobytes()
        for i in np.flatnonzero(fits):
            windows.append((raw[made.start[i] : made.end[i + 2]], key[i]))
    by_text, by_key = {}, {}
    for text, key in windows:
        assert by_text.setdefault(text, key) == key
        assert by_key.setdefault(key, text) == text
    assert len(windows) == 5 and len(by_text) == 3


def test_no_text_at_all():
    assert list(W.slices(pa.array([], pa.string()))) == []
    part = next(W.slices(pa.array([None, ""], pa.string())))
    assert part.n == 2 and len(W.words(part).key) == 0


def test_one_key_for_many_documents_is_not_one_chunk(spark, monkeypatch):
    """A third of the rows without a key, a third with the same: no chunk has much more than its share."""
    monkeypatch.setattr(chunks, "CHUNK_BYTES", 3000)
    pairs = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} " * 3) for i in range(1500)]
    dealt, size = chunks.dealt(cases.table(spark, pairs), "doc_id", "text")
    held = [r["count"] for r in dealt.groupBy("chunk").count().collect()]
    assert sum(held) == 1500 and len(held) > 15 and max(held) < 3 * 1500 / len(held)
