"""Documents dealt into chunks of bounded size, and tables of hashes exchanged between chunks.

A chunk holds whole documents, dealt by a hash of key and text, and is small enough for one task's
memory, however many documents share a key or have none. (Rows equal in both are in one chunk.) Each chunk first reduces what it has to say about a hash to one entry, so however many
documents share a passage, a hash comes at most once from each chunk. Entries travel packed, some
thousands to a row, dealt by the top bits of the hash.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text that a chunk holds on average, and entries that a bucket of hashes holds.
CHUNK_BYTES = 6 << 20
BUCKET_ENTRIES = 1_000_000


def dealt(df: DataFrame, key: str, text: str) -> tuple[DataFrame, int]:
    """`key`, `text` and `chunk` of each document, and the number of bytes of all texts."""
    size = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(1, -(-size // CHUNK_BYTES))
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(n)).cast("int")), size


def bits_for(entries: int) -> int:
    """Bits of a hash that name its bucket, so that a bucket holds BUCKET_ENTRIES or so."""
    return max(0, int(np.ceil(np.log2(max(1, entries / BUCKET_ENTRIES)))))


def split(keys: np.ndarray, bits: int) -> list[tuple[int, slice]]:
    """The buckets of sorted 64-bit hashes, by their top bits, and where each lies."""
    if not bits:
        return [(0, slice(0, len(keys)))] if len(keys) else []
    edges = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
    edges = np.concatenate(([0], edges, [len(keys)]))
    return [(b, slice(edges[b], edges[b + 1])) for b in range(1 << bits) if edges[b] < edges[b + 1]]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values occur in the sorted array `among`."""
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(among, values), len(among) - 1)
    return among[at] == values
