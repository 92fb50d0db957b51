"""Token counts with a cache of digests: a text is encoded once for each version of a tokenizer.

The cache is a folder of Parquet files under `version=<digest>`, the digest of the tokenizer's file, its
library and that library's version; each row has the SHA-256 of a text's normal form and its count. A run
takes one pass over the texts for digests, joins the distinct ones to the cache, encodes one text for each
that is missing, appends those counts and looks all rows up. Copies are reduced to one in the map tasks, so
a text in a third of all rows costs one row a task.

Appending is safe to repeat: a count depends on the digest and the version alone, so rows that a lost or
a concurrent run has left are right, and readers take one of each digest.

The normal form of a text is the text itself, or what the tokenizer's own normaliser makes of it; a text
that holds an added token's string is always taken as it is, since such strings are found before.

Defined results: a null text is empty; empty texts have no tokens; rows that are equal keep their own rows;
null keys are keys; columns other than the key and the text are ignored. No rows append nothing.
"""

from __future__ import annotations

import hashlib
import importlib
import importlib.metadata
import json
import os
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from ..session import scratch
from .bpe import chunks, strange_space
from .common import SENT_ROWS, type_of, written
from .pieces import Memory
from .words import Texts, slices, span_keys

#: Texts of more tokens are over the limit.
LIMIT = 1024
#: Bytes of text whose counts leave a task together.
BATCH = 1 << 21
_ROW = "content binary, n_tokens bigint"


def library(path: str) -> str:
    """The library that reads a tokenizer's file, by the file's ending."""
    known = {".json": "tokenizers", ".model": "sentencepiece"}
    ending = os.path.splitext(path)[1]
    if ending not in known:
        raise ValueError(f"no library for {path}")
    return known[ending]


def version(path: str) -> str:
    """Digest of all that decides a count besides the text."""
    name = library(path)
    with open(path, "rb") as file:
        parts = [name, importlib.metadata.version(name), hashlib.sha256(file.read()).hexdigest(), "no special tokens added"]
    return hashlib.sha256("\n".join(parts).encode()).hexdigest()


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if library(path) == "sentencepiece":
        return importlib.import_module("sentencepiece").SentencePieceProcessor(model_file=path)
    made = importlib.import_module("tokenizers").Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _settings(path: str) -> dict:
    if library(path) == "sentencepiece":
        return {}
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    return {name: made.get(name) for name in ("normalizer", "pre_tokenizer", "added_tokens")}


def cuts_at_space(settings: dict) -> bool:
    """Whether a text may be cut before white space that follows a word: a byte-level pattern without a
    normaliser, and no added token that reaches over white space or looks at its neighbours."""
    before = settings.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    special = settings.get("added_tokens") or []
    alone = all(
        not (t["lstrip"] or t["rstrip"] or t["single_word"]) and not any(c.isspace() for c in t["content"]) for t in special
    )
    return plain and alone and settings.get("normalizer") is None


@lru_cache(maxsize=1)
def counter(path: str) -> Callable[[Texts], np.ndarray]:
    """Number of tokens of each text of a slice. A worker keeps it, with a bounded number of counted pieces."""
    tokenizer, sentence = _tokenizer(path), library(path) == "sentencepiece"

    def lengths(texts: list[str]) -> list[int]:
        if sentence:
            return [len(ids) for ids in tokenizer.encode(texts, num_threads=1)]
        return [len(made) for made in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def whole(texts: Texts) -> np.ndarray:
        raw, at = texts.data.tobytes(), texts.bounds.tolist()
        return np.array(lengths([raw[a:b].decode() for a, b in zip(at[:-1], at[1:], strict=True)]), np.int64)

    memory = Memory(lambda pieces: [[n] for n in lengths([piece.decode() for piece in pieces])])

    def by_piece(texts: Texts) -> np.ndarray:
        row, begin, end = chunks(texts, strange_space(texts))
        _, n = memory.lookup(span_keys(texts.data, begin, end), begin, end, texts.data)
        return np.bincount(row, n, texts.n).astype(np.int64)

    return by_piece if cuts_at_space(_settings(path)) else whole


def _counted(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for batch in batches:
            for texts in slices(batch.column(1), BATCH):
                made = [batch.column(0).slice(texts.first, texts.n), pa.array(count(texts), pa.int64())]
                yield pa.RecordBatch.from_arrays(made, names=["content", "n_tokens"])

    return run


def _normal(path: str, special: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normalise = _tokenizer(path).normalizer.normalize_str
        for batch in batches:
            texts = batch.column(1).to_pylist()
            raw = [any(token in text for token in special) for text in texts]
            forms = ["=" + t if r else "~" + normalise(t) for t, r in zip(texts, raw, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(forms, pa.string())], names=["key", "text", "form"])

    return run


def digested(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text (null: empty) and `content`, the digest of the text's normal form."""
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    settings = _settings(path)
    form = F.col("text")
    if settings.get("normalizer") is not None:
        special = [t["content"] for t in settings["added_tokens"] or []]
        rows = rows.mapInArrow(_normal(path, special), f"key {type_of(df, key)}, text string, form string")
        form = F.col("form")
    return rows.select("key", "text", F.unhex(F.sha2(form, 256)).alias("content"))


def known(spark: SparkSession, folder: str) -> DataFrame:
    """The cached counts of one version, one row a digest; a folder that is not there is made."""
    try:
        rows = spark.read.schema(_ROW).parquet(folder)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        spark.createDataFrame([], _ROW).write.mode("append").parquet(folder)
        rows = spark.read.schema(_ROW).parquet(folder)
    return rows.groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))


def _texts(rows: DataFrame, misses: DataFrame) -> DataFrame:
    """One text for each digest of `misses`.

    Few digests are sent to the tasks, and no other text moves. Otherwise copies meet in the map tasks first and
    one text a digest and task moves; Spark's runtime Bloom filter keeps those of hits where they are.
    """
    first = F.first("text").alias("text")
    if misses.count() <= SENT_ROWS:
        return rows.join(F.broadcast(misses), "content", "left_semi").groupBy("content").agg(first)
    return rows.groupBy("content").agg(first).join(misses, "content", "left_semi")


def counted(
    df: DataFrame, path: str, cache: str | None = None, key: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """Key, n_bytes, n_tokens and over_limit of every row, by the tokenizer in `path` (a file that all
    tasks can open). `cache` is a folder that all tasks share; without it a new one is taken."""
    spark = df.sparkSession
    folder = f"{(cache or scratch(spark, 'token-cache')).rstrip('/')}/version={version(path)}"
    texts = digested(df, path, key, text)
    rows = written(texts.select("key", "content", F.octet_length("text").cast("bigint").alias("n_bytes")), "token-rows")
    distinct = rows.groupBy("content").agg(F.count(F.lit(1)).alias("n"))
    looked = written(distinct.join(known(spark, folder), "content", "left"), "token-hits")
    misses = looked.where("n_tokens is null").select("content")
    new = written(_texts(texts, misses).select("content", "text").mapInArrow(_counted(path), _ROW), "token-misses")
    new.write.mode("append").parquet(folder)
    counts = looked.where("n_tokens is not null").select("content", "n_tokens").unionByName(new)
    made = hot_join(rows, counts, ["content"], counts=looked.select("content", "n"))
    return made.select(
        F.col("key").alias(key), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
