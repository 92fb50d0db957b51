"""Benchmark decontamination: size-partitioned MinHash containment search, verified exactly.

Containment is the share of an item's distinct windows of five words that a document has anywhere, so a
short item counts wherever it lies in a long document. A sketch of the long document would hardly ever hold
the item's few windows, so only items are sketched: they are partitioned by their number of windows, and
each partition keeps as many minima of a hash as make sure that an item contained to the threshold
shares one (drawing without replacement; for small items that is certain, for large ones it fails
less than once in 10**9). All windows of a document are looked up among those minima; documents
with too few windows for an item are not its candidates; candidates are then counted exactly.

Items travel to the tasks in blocks of bounded size, each set of windows once however many items have it; every
block is held against all documents in a pass of its own, written before the next block is sent. Words are runs of letters and digits in lower case, so case, punctuation
and white space of any script make no difference.

Defined results: null texts have no words; an item of fewer than five words has one window of all its
words; an item without a word is never found; repeated items and documents each keep their own rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from .common import type_of, written
from .words import Texts, Words, mix, runs, slices, windows, words

SHINGLE = 5
THRESHOLD = 0.8
MISS = 1e-9
#: Windows of items that one block holds at most, or those of a single item.
BLOCK = 2_000_000

#: Bytes that are no part of a word; bytes beyond ASCII are letters once `_SEPARATORS` are blanks.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


_SEPARATORS = r"[\p{P}\p{Z}\x{0085}]+"


def worded(column) -> Iterator[tuple[Texts, Words]]:
    """Slices of the column in lower case, and their words."""
    for texts in slices(pc.replace_substring_regex(pc.utf8_lower(column), _SEPARATORS, " ")):
        yield texts, words(texts, APART)


def distinct_windows(found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of each distinct window, sorted."""
    key, fits = windows(found, length)
    row, key = found.row[fits], key[fits]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (key[1:] != key[:-1])
    return row[new], key[new]


def sketch_size(n: int, threshold: float = THRESHOLD, miss: float = MISS) -> int:
    """Minima to keep of n windows so that, of those shared by a document, one is among them."""
    apart, chance = n - int(np.ceil(threshold * n - 1e-9)), 1.0
    for k in range(n):
        if chance <= miss or apart < k:
            return max(1, k)
        chance *= (apart - k) / (n - k)
    return n


def _item_rows(length: int):
    """Item, words of a window (fewer than `length` in a shorter item), number of windows and their hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts, found in worded(batch.column(1)):
                n_words = np.bincount(found.row, minlength=texts.n)
                of = np.minimum(n_words, length)
                sizes, blobs = np.zeros(texts.n, np.int64), [b""] * texts.n
                for m in np.unique(of[of > 0]).tolist():
                    row, key = distinct_windows(found, m)
                    at = np.searchsorted(row, np.arange(texts.n + 1))
                    for i in np.flatnonzero(of == m).tolist():
                        sizes[i], blobs[i] = at[i + 1] - at[i], key[at[i] : at[i + 1]].tobytes()
                columns = [
                    batch.column(0).slice(texts.first, texts.n),
                    pa.array(of, pa.int32()),
                    pa.array(sizes, pa.int64()),
                    pa.array(blobs, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["item", "length", "n", "hashes"])

    return run


class Block:
    """Some items: their windows and, by partition of size, the minima that stand for them.

    `items` are (item, number of windows, hashes), all of windows of one length.
    """

    def __init__(self, items: list, threshold: float):
        self.items = np.array([item for item, _, _ in items], np.int64)
        self.n = np.array([n for _, n, _ in items], np.int64)
        of = np.repeat(np.arange(len(items)), self.n)
        key = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(h, np.uint64) for _, _, h in items)])
        partition = np.floor(np.log2(np.maximum(self.n, 1))).astype(int)
        kept = []
        for size in np.unique(partition):  # the largest item of a partition sets its sketch
            k = max(sketch_size(int(n), threshold) for n in np.unique(self.n[partition == size]))
            inside = np.flatnonzero(partition[of] == size)
            order = inside[np.lexsort((mix(key[inside]), of[inside]))]
            at, count = runs(of[order])
            rank = np.arange(len(order)) - np.repeat(at, count)
            kept.append(order[rank < k])
        chosen = np.concatenate([np.zeros(0, np.int64), *kept])
        self.sketch = self._by_key(key[chosen], of[chosen])
        self.whole = self._by_key(key, of)

    @staticmethod
    def _by_key(key: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(key, kind="stable")
        key, of = key[order], of[order]
        at, n = runs(key)
        return key[at], at, n, of

    @staticmethod
    def _hits(table, row: np.ndarray, key: np.ndarray, n_items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows and items that share windows of `table`, and how many."""
        keys, at, n, of = table
        none = np.zeros(0, np.int64)
        if not len(keys) or not len(key):
            return none, none, none
        place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        met = keys[place] == key
        place, row = place[met], row[met]
        count = n[place]
        total = np.cumsum(count)
        item = of[np.repeat(at[place] - (total - count), count) + np.arange(total[-1] if len(total) else 0)]
        pair, times = np.unique(np.repeat(row, count) * n_items + item, return_counts=True)
        return pair // n_items, pair % n_items, times

    def search(self, n_rows: int, row: np.ndarray, key: np.ndarray, threshold: float):
        """Rows, items and shared windows of every pair that reaches the threshold."""
        size = np.bincount(row, minlength=n_rows)
        near, item, _ = self._hits(self.sketch, row, key, len(self.items))
        fits = size[near] >= threshold * self.n[item] - 1e-9
        candidate = np.zeros(n_rows, bool)
        candidate[near[fits]] = True
        inside = candidate[row]
        at, item, shared = self._hits(self.whole, row[inside], key[inside], len(self.items))
        enough = shared >= threshold * self.n[item] - 1e-9
        return at[enough], item[enough], shared[enough]


class Blocks:
    """One block for each length of window."""

    def __init__(self, rows: list, threshold: float):
        self.threshold = threshold
        lengths = sorted({r.length for r in rows})
        self.parts = {m: Block([(r.item, r.n, r.hashes) for r in rows if r.length == m], threshold) for m in lengths}

    def search(self, texts: Texts, found: Words):
        """Rows, items, shared windows and windows in all of every pair that reaches the threshold."""
        out = [[np.zeros(0, np.int64)] * 4]
        for length, block in self.parts.items():
            at, item, shared = block.search(texts.n, *distinct_windows(found, length), self.threshold)
            out.append([at, block.items[item], shared, block.n[item]])
        return [np.concatenate(x) for x in zip(*out, strict=True)]


def item_windows(items: DataFrame, key: str, text: str, length: int) -> DataFrame:
    """Items with a word, their windows and `same`, which items of equal windows share."""
    rows = items.select(F.col(key).alias("item"), F.col(text).alias("text"))
    schema = f"item {type_of(items, key)}, length int, n bigint, hashes binary"
    made = rows.mapInArrow(_item_rows(length), schema).where("n > 0")
    return written(made.withColumn("same", F.xxhash64("length", "hashes")), "item-windows")


def blocks(made: DataFrame, threshold: float) -> Iterator[tuple[Broadcast, bool]]:
    """All different sets of windows, a block at a time, sent to the tasks, and whether it is the last.

    The driver holds one block; the tasks are rid of it when the next is asked for, so what uses it must
    have been written by then."""
    first = [F.first(c).alias(c) for c in ("length", "n", "hashes")]
    sets = written(made.groupBy(F.col("same").alias("item")).agg(*first), "item-sets")
    total = sets.agg(F.sum("n")).first()[0] or 0
    n_blocks = -(-total // BLOCK)
    for i in range(n_blocks):
        mine = sets.where(F.pmod(F.xxhash64("item"), F.lit(n_blocks)) == i)
        sent = made.sparkSession.sparkContext.broadcast(Blocks(mine.collect(), threshold))
        yield sent, i + 1 == n_blocks
        if i + 1 < n_blocks:
            sent.destroy()


def found(
    docs: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    length: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """Every (document, item) with containment of at least the threshold, windows shared and in all."""
    spark = docs.sparkSession
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {type_of(docs, key)}, same bigint, n_shared bigint, n_windows bigint"
    made = item_windows(items, item_key, item_text, length)
    passes = [spark.createDataFrame([], schema)]
    for sent, _ in blocks(made, threshold):

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, words_ in worded(batch.column(1)):
                    at, *told = sent.value.search(texts, words_)
                    columns = [batch.column(0).take(pa.array(texts.first + at)), *(pa.array(x, pa.int64()) for x in told)]
                    if len(at):
                        yield pa.RecordBatch.from_arrays(columns, names=["key", "same", "n_shared", "n_windows"])

        passes.append(written(rows.mapInArrow(run, schema), "item-matches"))
    out = reduce(DataFrame.unionByName, passes)
    named = made.select("same", "item")
    counts = out.groupBy("same").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.join(named.groupBy("same").agg(F.count(F.lit(1)).alias("m")), "same")
    out = hot_join(out, named, ["same"], counts=counts).select("key", "item", "n_shared", "n_windows")
    out = out.withColumn("containment", F.col("n_shared") / F.col("n_windows"))
    return out.withColumnRenamed("key", key).withColumnRenamed("item", item_key)


def cleaned(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    length: int = SHINGLE,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """The documents that hold no item; their columns are unchanged."""
    for sent, last in blocks(item_windows(items, item_key, item_text, length), threshold):
        place = docs.columns.index(text)

        def run(batches: Iterable[pa.RecordBatch], sent=sent, place=place) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for texts, words_ in worded(pc.struct_field(batch.column(0), [place])):
                    stay = np.ones(texts.n, bool)
                    stay[sent.value.search(texts, words_)[0]] = False
                    rows = batch.column(0).slice(texts.first, texts.n).filter(pa.array(stay))
                    yield pa.RecordBatch.from_arrays([rows], names=["row"])

        rows = docs.select(F.struct("*").alias("row"))
        kind = rows.schema["row"].dataType.simpleString()
        docs = rows.mapInArrow(run, f"row {kind}").select("row.*")
        docs = docs if last else written(docs, "cleaned")
    return docs
