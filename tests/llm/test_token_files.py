import io
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from invq.llm import queries
from invq.llm import token_files as T
from invq.llm.words import slices
from tests.llm import cases

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def expected(tokenizer, texts):
    out, start = [], 0
    for text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1500))
def test_any_token_is_found_alone(ids):
    codes = T.Codes(T.pack(np.array(ids, np.uint32)))
    assert len(codes) == len(ids)
    assert codes.span(0, len(ids)).tolist() == ids
    for i in range(0, len(ids), 37):
        assert codes.token(i) == ids[i]
    half = len(ids) // 2
    assert codes.span(half, len(ids)).tolist() == ids[half:]


def test_other_bytes_are_refused():
    with pytest.raises(ValueError):
        T.Codes(b"nonsense")


def test_query_equals_the_library(spark, tokenizer):
    _, pairs = cases.documents(spark)
    rows = sorted(queries.op8_token_files(spark, "/root/testdata/sf0.001").collect())
    wanted = expected(tokenizer, [t for _, t in pairs])
    assert [tuple(r) for r in rows] == [(k, *w) for (k, _), w in zip(pairs, wanted, strict=True)]


def test_pieces_may_be_encoded_apart(spark, tokenizer):
    texts = [
        "ΑΣ ΟΔΟΣ. Σ", "á ́b é\ń", "x y z\x1cq\u0085w", "<|endoftext|> a<|startoftext|>b",
        "İstanbul ǅ ﬁ", "it's we'll 12 345", "𝔘𝔫𝔦 ☃☃ ​ ﻿", "  lead\t\ttrail  ", "한국어 조합 각",
    ]
    files = T.write(cases.table(spark, list(enumerate(texts))), PATH, 2)
    rows = sorted(T.read(files).collect())
    assert [tuple(r)[1:] for r in rows] == expected(tokenizer, texts)


_BITS = [*"aAsStTlLhHkKiIeE'',.-<|>!?09 \n\té̸̱́̇ÉßñİΣςЖй\u0085\x1c\x00😀한"]
_BITS += ["<|endoftext|>", "<|ENDOFTEXT|>", "'LL", "H\u0331", "word", "Word", "<|", "|>"]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from(_BITS), max_size=25).map("".join), min_size=1, max_size=20))
def test_pieces_of_odd_texts_equal_the_library(texts):
    library = Tokenizer.from_file(PATH)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["key", "text"])
    (file,) = T._files(PATH, 2)([batch])
    documents, codes = T.unpacked_file(file.column(0)[0].as_py())
    stops = np.cumsum(documents.column("length"))
    ids = [codes.span(a, b).tolist() for a, b in zip([0, *stops], stops)]  # noqa: B905
    assert ids == [[*library.encode(text, add_special_tokens=False).ids, 2] for text in texts]


def test_a_word_is_one_piece_whatever_its_capitals_and_marks():
    (texts,) = slices(pa.array(['Word, word. WORD "word" well-known\n', "it's <|endoftext|> x", "a\x1cB"]))
    row, begin, end, data = T.pieces(texts)
    made = [(r, data[a:b].tobytes().decode()) for r, a, b in zip(row.tolist(), begin.tolist(), end.tolist(), strict=True)]
    first = ["word", ",", "word", ".", "word", '"', "word", '"', "well", "-", "known"]
    assert made == [(0, p) for p in first] + [(1, p) for p in ("it", "'s", "<|endoftext|>", "x")] + [(2, "a\x1cB")]


class Counted(io.BytesIO):
    """A file that says how much of it was read."""

    total = 0

    def read(self, n=-1):
        made = super().read(n)
        self.total += len(made)
        return made


def test_one_token_reads_one_rank_block_a_level(spark, tokenizer, tmp_path):
    folder = str(tmp_path / "files")
    T.write(cases.table(spark, [(i, cases.LONG[i * 900 : i * 900 + 40_000]) for i in range(9)]), PATH, 2, folder=folder)
    names = [p for p in (tmp_path / "files").glob("part-*") if p.stat().st_size > 100]
    assert names
    for name in names:
        data = name.read_bytes()
        _, codes = T.unpacked_file(data)
        file = Counted(data)
        opened = T.CodeFile(file)
        assert opened.n_tokens == len(codes) and file.total < 64
        for i in range(0, len(codes), 997):
            file.total = 0
            assert opened.token(i) == codes.token(i)
            assert file.total <= len(opened.levels) * (1 + T.BLOCK // 8 + 4)
    assert max(len(T.CodeFile(io.BytesIO(n.read_bytes())).levels) for n in names) == 2


def test_edges(spark, tokenizer, monkeypatch):
    monkeypatch.setattr(T, "FILE_BYTES", 500)
    rows = sorted((tuple(r) for r in T.read(T.write(cases.odd(spark), PATH, 2)).collect()), key=lambda r: r[1])
    order = sorted(cases.ROWS, key=lambda r: (-1 if r[0] is None else r[0], r[1] or ""))
    assert rows == [(r[0], *w) for r, w in zip(order, expected(tokenizer, [r[1] for r in order]), strict=True)]
    assert T.read(T.write(cases.none(spark), PATH, 2)).collect() == []
