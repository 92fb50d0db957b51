"""Small tables for the edges that every operator has a defined result for."""

from __future__ import annotations

import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "key string, row long, kept string, words long, chunk string, ids long, shard string, n string, print string"
)
LONG = " ".join(f"word{i % 977} thing{i % 613}" for i in range(30_000))
PROSE = (
    "the quick brown fox jumps over the lazy dog while seven wizards mix potions by the old stone bridge and "
    "nobody watches the river run slowly down towards the distant harbour where small boats wait for morning tide "
    "under pale light that falls across wet sand before gulls return from far islands with news of storms"
)

ROWS = [
    (1, PROSE, "en", "a"),
    (2, PROSE, "en", None),  # a copy
    (3, None, "en", "a"),
    (4, "", None, "a"),
    (5, " \n\t ", "de", "a"),
    (6, LONG, "en", "b"),
    (7, "one two", None, None),
    (7, "one two", None, None),  # a repeated row
    (8, "one two", "en", "a"),
    (None, "no key here", "en", "a"),
    (9, "12345 !!! ###", "en", "a"),
    (10, "Größe, café – naïve coöperation ☃ 𝔘𝔫𝔦", "de", "a"),
    (11, PROSE + "\n" + PROSE.upper() + "\n" + PROSE, "en", "a"),
]


def odd(spark, rows=ROWS):
    """Nulls, empty and long texts, ties, repeats, and extra columns whose names an operator might use itself."""
    full = [(*r, None if r[1] is None else len(r[1]), "k", 1, "x", 2, "c", 3, "s", "n", None) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def table(spark, pairs):
    """Documents from (doc_id, text) pairs."""
    return spark.createDataFrame([(i, t, "en", "a") for i, t in pairs], "doc_id long, text string, lang string, source string")


def documents(spark, n=None):
    """The smallest supplied documents, and as (doc_id, text) pairs."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    df = df if n is None else df.where(f"doc_id < {n}")
    return df, sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())
