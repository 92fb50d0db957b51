import hashlib
import random
import tracemalloc

import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from invq.llm import bpe, queries
from invq.llm.words import slices
from tests.llm import cases

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def library():
    ranks = {token: i for i, token in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, P.PATTERN)


def ids(encoder, texts):
    out = []
    for part in slices(pa.array(texts, pa.string()), 50):
        n, flat = encoder.encode(part)
        at = 0
        for k in n.tolist():
            out.append(flat[at : at + k].tolist())
            at += k
    return out


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(), st.sampled_from("ab 's\n\t  .!1é"))), max_size=6))
def test_ids_equal_the_library(encoder, library, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_every_kind_of_white_space(encoder, library):
    texts = [f"a{chr(c)}b {chr(c)}c{chr(c)} d" for c in range(0x3100) if chr(c).isspace() or c in (0x180E, 0x200B)]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_states_are_forgotten_without_changing_results(library, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    encoder = bpe.Encoder(PATH, P.PATTERN)
    encoder.memory.limit = 3
    texts = [cases.PROSE, cases.PROSE.upper(), "antidisestablishmentarianism" * 50]
    assert ids(encoder, texts) == [library.encode_ordinary(t) for t in texts]


def test_decoder_holds_back_unfinished_characters(library):
    text = "naïve ☃ 𝔘𝔫𝔦 café"
    found = library.encode_ordinary(text)
    decoder, parts = bpe.StreamDecoder(bpe.read_ranks(PATH)), []
    for i in found:
        parts.append(decoder.feed([i]))
        assert "�" not in parts[-1]
    assert "".join(parts) + decoder.end() == text


@settings(max_examples=500, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=6), st.text(max_size=3).map(lambda t: t.encode("utf-8", "ignore"))), max_size=8))
def test_machine_equals_the_codec_on_any_bytes(parts):
    """Fed in any pieces, bytes that are no UTF-8 among them."""
    decoder = bpe.StreamDecoder(parts)
    made = "".join(decoder.feed([i]) for i in range(len(parts))) + decoder.end()
    assert made == b"".join(parts).decode("utf-8", "replace")


def test_what_a_worker_remembers_is_bounded(library, monkeypatch):
    """Words that never come again: all caches fill, and none outgrows its bound."""
    monkeypatch.setattr(bpe, "MAX_STATES", 10_000)
    monkeypatch.setattr(bpe, "MAX_FITS", 10_000)
    encoder = bpe.Encoder(PATH, P.PATTERN)
    encoder.memory.limit = 1 << 19
    rng = random.Random(1)
    tracemalloc.start()
    for _ in range(3):
        texts = [" ".join("".join(rng.choices("abcdeéstr", k=9)) for _ in range(15_000))]
        for part in slices(pa.array(texts, pa.string())):
            encoder.encode(part)
        assert len(encoder.transducer._states) <= bpe.MAX_STATES + 100 and len(encoder.transducer._fits) <= bpe.MAX_FITS + 1
    held = tracemalloc.get_traced_memory()[0]
    encoder.forget()
    left = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert left < 1 << 20 < held < 40 << 20
    assert ids(encoder, [texts[0][:999]]) == [library.encode_ordinary(texts[0][:999])]


def test_query_equals_the_library(spark, library):
    _, pairs = cases.documents(spark)
    rows = {r.doc_id: r for r in queries.op1_byte_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len(pairs)
    for doc_id, text in pairs:
        found = library.encode_ordinary(text)
        row = rows[doc_id]
        assert row.n_tokens == len(found)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, found)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_edges(spark, library):
    made = bpe.encode(cases.odd(spark), PATH, P.PATTERN)
    rows = sorted((r.doc_id or 0, r.ids) for r in made.collect())
    assert rows == sorted((r[0] or 0, library.encode_ordinary(r[1] or "")) for r in cases.ROWS)
    back = sorted((r.doc_id or 0, r.decoded) for r in bpe.decode(made, PATH).collect())
    assert back == sorted((r[0] or 0, r[1] or "") for r in cases.ROWS)
    assert bpe.round_trip(cases.none(spark), PATH, P.PATTERN).collect() == []
