import tempfile

import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from invq.llm import queries
from invq.llm import token_counts as T
from tests.llm import cases

PATH = P.path("byte_bpe_50k.json")
TEXTS = [
    "a<|endoftext|>b <|endoftext|>  c  <|endoftext|>", "<|endoftext|><|endoftext|>", "x   y\n\n z\t", "é́ İ ☃☃ 𝔘", "  a b",
    "it's we'll 12 345", "", None, "<|ENDOFTEXT|> A", " ", "한국어 조합 각", "a a a",
]


def folder():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def expected(texts, path=PATH):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return [len(model.encode(t or "")) for t in texts]
    library = Tokenizer.from_file(path)
    return [len(library.encode(t or "", add_special_tokens=False)) for t in texts]


def run(df, path=PATH, cache=None):
    return {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in T.counted(df, path, cache).collect()}


def wanted(pairs, path=PATH):
    n = expected([t for _, t in pairs], path)
    return {k: (len((t or "").encode()), m, m > 1024) for (k, t), m in zip(pairs, n, strict=True)}


def test_query_equals_the_library(spark):
    _, pairs = cases.documents(spark)
    rows = queries.op13_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in rows} == wanted(pairs) and len(rows) == len(pairs)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_each_kind_of_file(spark, name):
    pairs = list(enumerate([*TEXTS, cases.PROSE, cases.PROSE.upper(), cases.LONG]))
    assert run(cases.table(spark, pairs), P.path(name)) == wanted(pairs, P.path(name))


@pytest.mark.parametrize("sent", [T.SENT_ROWS, 0])
def test_only_misses_are_encoded_and_appended(spark, sent, monkeypatch):
    monkeypatch.setattr(T, "SENT_ROWS", sent)
    cache, first = folder(), [(i, f"text {i % 7}") for i in range(60)]
    second = [(i, f"text {i % 11}") for i in range(40)]
    assert run(cases.table(spark, first), cache=cache) == wanted(first)
    at = f"{cache}/version={T.version(PATH)}"
    assert spark.read.parquet(at).count() == 7
    assert run(cases.table(spark, second), cache=cache) == wanted(second)
    kept = spark.read.parquet(at)
    assert kept.count() == 11 == kept.select("content").distinct().count()
    assert run(cases.table(spark, first), cache=cache) == wanted(first)
    assert spark.read.parquet(at).count() == 11


def test_counts_come_from_the_cache_of_their_version(spark):
    cache, pairs = folder(), [(1, "one two"), (2, "three")]
    df = cases.table(spark, pairs)
    marked = T.digested(df, PATH).where("text = 'three'").select("content", F.lit(5000).cast("bigint").alias("n_tokens"))
    marked.write.parquet(f"{cache}/version={T.version(PATH)}")
    marked.write.mode("append").parquet(f"{cache}/version={T.version(PATH)}")  # left by a run that was repeated
    assert run(df, cache=cache) == wanted(pairs[:1]) | {2: (5, 5000, True)}
    other = P.path("word_bpe_49k.json")
    assert T.version(other) != T.version(PATH)
    assert run(df, other, cache) == wanted(pairs, other)


def test_texts_of_one_normal_form_are_one_entry(spark):
    cache, path = folder(), P.path("word_bpe_49k.json")
    pairs = [(1, "Some Text"), (2, "some text"), (3, "some  TEXT"), (4, "<|endoftext|> x"), (5, "<|ENDOFTEXT|> x")]
    assert run(cases.table(spark, pairs), path, cache) == wanted(pairs, path)
    assert spark.read.parquet(f"{cache}/version={T.version(path)}").count() == 3


def test_edges(spark):
    rows = sorted(map(tuple, T.counted(cases.odd(spark), PATH).collect()), key=repr)
    n = expected([r[1] for r in cases.ROWS])
    assert rows == sorted(
        ((r[0], len((r[1] or "").encode()), m, m > 1024) for r, m in zip(cases.ROWS, n, strict=True)), key=repr
    )
    assert T.counted(cases.none(spark), PATH).collect() == []


def test_a_text_in_most_rows(spark):
    pairs = [(i, "hot text" if i % 3 else f"own {i}") for i in range(3000)]
    assert run(cases.table(spark, pairs)) == wanted(pairs)
