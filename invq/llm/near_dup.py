"""MinHash near-dedup: consistent weighted sampling over TF-IDF shingles, banded, verified.

A document is the multiset of its windows of five words (all its words, if fewer). A shingle weighs its
count times 1 + ln((1 + N) / (1 + df)) / ln(1 + N), with df counted over all N documents; the weight stays
between one and two counts, so that a shingle which thousands of copies share does not vanish beside
one that an edit made. Improved consistent weighted sampling draws a shingle and a level from each
document, alike in two of them with the probability of their weighted Jaccard similarity; `ROWS`
draws make a band, and documents that agree in one of `BANDS` are compared exactly.

* A document whose shared shingles weigh less than the threshold's share of it can have no partner;
  it is not sampled. That loses nothing.
* Documents with equal shingles are one class from the start; only its least key goes on.
* Within a band's bucket, all are compared with the one that shares most of its weight with others (the
  original, among edited copies). Documents not yet connected to the largest part of the bucket are then
  compared with all that they are not connected to, unless what each shares with any document at all is
  too little for the pair, or the triangle inequality rules it out. Links within a connected part change
  no class, so nothing of use is left out, and a bucket of thousands of near copies costs about one
  comparison each, plus those of its outliers.

Defined results: every row has a class, the least key among those connected to it; null and wordless
texts are alone; rows with equal keys share a class; a null key gets a null class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import chunks as C
from .common import written
from .graph import components
from .words import Texts, Words, mix, runs, slices, windows, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 12, 4
#: Bits of a shingle's hash.
BITS = 48


def shingles(texts: Texts, found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of every shingle of a slice of texts."""
    key, fits = windows(found, length)
    row = [found.row[fits]]
    out = [key[fits]]
    n = np.bincount(found.row, minlength=texts.n)
    first = np.searchsorted(found.row, np.arange(texts.n))
    for short in range(1, length):
        few = np.flatnonzero(n == short)
        if len(few):
            key, _ = windows(found, short)
            row.append(few)
            out.append(key[first[few]])
    return np.concatenate(row), np.concatenate(out) >> np.uint64(64 - BITS)


def _narrow(hash_: np.ndarray) -> bytes:
    """48-bit hashes as six bytes each."""
    return np.ascontiguousarray(hash_.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _wide(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


_ENTRIES = "bucket int, chunk int, hashes binary, n binary"


def _count(length: int, bits: int):
    """Per chunk: each shingle once, with the number of documents that have it."""

    def run(docs: pa.Table) -> pa.Table:
        rows, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for texts in slices(docs.column("text")):
            row, hash_ = shingles(texts, words(texts), length)
            order = np.argsort(row, kind="stable")
            rows.append(texts.first + row[order])
            hashes.append(hash_[order])
        row, hash_ = np.concatenate(rows), np.concatenate(hashes)
        order = np.argsort(hash_, kind="stable")
        row, hash_ = row[order], hash_[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
        hash_ = hash_[new]
        at, n = runs(hash_)
        hash_, n = hash_[at], n.astype(np.uint32)
        chunk = docs.column("chunk")[0].as_py()
        spans = C.split(hash_ << np.uint64(64 - BITS), bits)
        return pa.table(
            {
                "bucket": pa.array([b for b, _ in spans], pa.int32()),
                "chunk": pa.array([chunk] * len(spans), pa.int32()),
                "hashes": pa.array([_narrow(hash_[s]) for _, s in spans], pa.binary()),
                "n": pa.array([n[s].tobytes() for _, s in spans], pa.binary()),
            }
        )

    return run


def _sum(entries: pa.Table) -> pa.Table:
    """Per bucket: document frequencies above one, told to every chunk that has the shingle."""
    chunk = np.array(entries.column("chunk").to_pylist(), np.int32)
    hashes = [_wide(x) for x in entries.column("hashes").to_pylist()]
    n = np.concatenate([np.frombuffer(x, np.uint32) for x in entries.column("n").to_pylist()]).astype(np.int64)
    of = np.repeat(np.arange(len(chunk), dtype=np.int32), [len(x) for x in hashes])
    hash_ = np.concatenate(hashes)
    order = np.argsort(hash_, kind="stable")
    hash_, n, of = hash_[order], n[order], of[order]
    at, length = runs(hash_)
    total = np.repeat(np.add.reduceat(n, at), length)
    keep = total > 1
    hash_, total, of = hash_[keep], total[keep], of[keep]
    order = np.argsort(of, kind="stable")
    hash_, total, of = hash_[order], total[order], of[order]
    at, length = runs(of)
    spans = [slice(a, a + k) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
    return pa.table(
        {
            "chunk": pa.array(chunk[of[at]], pa.int32()),
            "hashes": pa.array([_narrow(hash_[s]) for s in spans], pa.binary()),
            "n": pa.array([total[s].astype(np.uint32).tobytes() for s in spans], pa.binary()),
        }
    )


def _uniform(n: int, seed: int) -> np.ndarray:
    return (mix(np.arange(n, dtype=np.uint64) + np.uint64(seed)) >> np.uint64(11)) * 2.0**-53 + 2.0**-54


def _gamma(seed: int) -> np.ndarray:
    """65,536 draws of Gamma(2, 1), the same in every process."""
    n = 1 << 16
    return -np.log(_uniform(n, seed) * _uniform(n, seed + n))


_R, _LOG_C = _gamma(1), np.log(_gamma(1 << 20))


def sample(hash_: np.ndarray, weight: np.ndarray, at: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash per band (columns) for each document (rows); `at` tells where each one's shingles begin."""
    n = np.diff(np.append(at, len(hash_)))
    log_w = np.log(weight)
    out = np.zeros((len(at), bands), np.uint64)
    for k in range(bands * rows):
        draw = mix(hash_ ^ mix(np.full(1, k + 1, np.uint64)))
        r = _R[draw & np.uint64(0xFFFF)]
        beta = (draw >> np.uint64(32)) * 2.0**-32
        level = np.floor(log_w / r + beta)
        log_a = _LOG_C[(draw >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (level - beta) - r
        least = np.flatnonzero(log_a == np.repeat(np.minimum.reduceat(log_a, at), n))
        least = least[np.searchsorted(least, at)]
        drawn = mix(hash_[least] ^ mix(level[least].astype(np.int64).view(np.uint64)))
        band = out[:, k // rows]
        band[:] = mix(band * np.uint64(0x9E3779B97F4A7C15) + drawn)
    return out


_VECTORS = (
    "key bigint, same_1 bigint, same_2 bigint, whole double, shared double, "
    "bands array<bigint>, hashes binary, weights binary"
)


def _vectors(length: int, n_docs: int, threshold: float, bands: int, rows: int):
    """Per chunk: the documents that may have a partner; one of those with equal shingles has the rest."""

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known = np.concatenate([np.zeros(0, np.uint64), *map(_wide, back.column("hashes").to_pylist())])
        df = np.frombuffer(b"".join(back.column("n").to_pylist()), np.uint32)
        order = np.argsort(known)
        known, df = known[order], df[order].astype(np.int64)
        keys = docs.column("key").to_pylist()
        out, seen = [], {}
        for texts in slices(docs.column("text")):
            row, hash_ = shingles(texts, words(texts), length)
            order = np.lexsort((hash_, row))
            row, hash_ = row[order], hash_[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (hash_[1:] != hash_[:-1])
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(row)))
            row, hash_ = row[at], hash_[at]
            often = np.ones(len(hash_), np.int64)
            if len(known):
                place = np.minimum(np.searchsorted(known, hash_), len(known) - 1)
                often = np.where(known[place] == hash_, df[place], 1)
            weight = count * (1 + np.log((1 + n_docs) / (1 + often)) / np.log(1 + n_docs))
            whole = np.bincount(row, weight, texts.n)
            shared = np.bincount(row, weight * (often > 1), texts.n)
            likely = (whole > 0) & (shared >= threshold * whole * (1 - 1e-9))
            stay = likely[row]
            row, hash_, weight, count = row[stay], hash_[stay], weight[stay], count[stay].astype(np.uint64)
            at, n = runs(row)
            if not len(at):
                continue
            print_1 = np.add.reduceat(mix(hash_ * np.uint64(2) + mix(count)), at).view(np.int64)
            print_2 = np.add.reduceat(mix(mix(hash_) + count), at).view(np.int64)
            drawn = sample(hash_, weight, at, bands, rows).view(np.int64)
            for i, (a, k) in enumerate(zip(at.tolist(), n.tolist(), strict=True)):
                key = keys[texts.first + row[a]]
                if key is None:
                    continue
                same = int(print_1[i]), int(print_2[i])
                same = (*same, float(whole[row[a]]), float(shared[row[a]]))
                vector = drawn[i], _narrow(hash_[a : a + k]), weight[a : a + k].astype(np.float32).tobytes()
                if same not in seen:
                    seen[same] = len(out)
                elif out[seen[same]][0] <= key:
                    vector = None, None, None
                else:  # the least key of the class keeps the vector
                    out[seen[same]] = (*out[seen[same]][:5], None, None, None)
                    seen[same] = len(out)
                out.append((key, *same, *vector))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        number, real = pa.int64(), pa.float64()
        kinds = (number, number, number, real, real, pa.list_(number), pa.binary(), pa.binary())
        names = ("key", "same_1", "same_2", "whole", "shared", "bands", "hashes", "weights")
        return pa.table({m: pa.array(c, k) for m, c, k in zip(names, columns, kinds, strict=True)})

    return run


def weighted_jaccard(a: np.ndarray, wa: np.ndarray, b: np.ndarray, wb: np.ndarray) -> float:
    """Of two vectors with sorted hashes. Equal shingles differ in weight by their counts alone."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = float(np.minimum(wa[ia], wb[ib]).sum(dtype=np.float64))
    return both / (float(wa.sum(dtype=np.float64)) + float(wb.sum(dtype=np.float64)) - both)


def _compared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(2, 6)]
        found = [
            weighted_jaccard(_wide(ha), np.frombuffer(wa, np.float32), _wide(hb), np.frombuffer(wb, np.float32))
            for ha, wa, hb, wb in zip(*columns, strict=True)
        ]
        arrays = [batch.column(0), batch.column(1), pa.array(found, pa.float64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "similarity"])


def _similarities(pairs: DataFrame, vectors: DataFrame, purpose: str) -> DataFrame:
    """The pairs (a, b) with their weighted Jaccard similarity."""
    left = vectors.select(F.col("key").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    right = vectors.select(F.col("key").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb")
    return written(joined.mapInArrow(_compared, "a bigint, b bigint, similarity double"), purpose)


def _possible(x: str, y: str, threshold: float) -> Column:
    """What two entries of a bucket must satisfy to be similar, and to be named in this bucket.

    Two vectors have no more in common than the lesser of what each shares with any document. One
    minus the similarity is a metric, so both lie about as far from the bucket's leader. A pair is
    named in the first band alone in which it agrees.
    """
    column = lambda side, name: F.col(f"{side}.{name}")
    both = F.least(column(x, "shared"), column(y, "shared"))
    room = both * (1 + threshold) >= threshold * (column(x, "whole") + column(y, "whole")) * (1 - 1e-9)
    level = F.abs(column(x, "near") - column(y, "near")) <= 1 - threshold + 1e-5
    agree = F.zip_with(column(x, "bands"), column(y, "bands"), lambda p, q: p == q)
    return room & level & (F.array_position(agree, True) == column(x, "band") + 1)


def _later_pairs(entries: DataFrame, known: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Pairs in one bucket that are not connected yet, one of them outside the bucket's largest part.

    `known` has the similarity of each entry to its bucket's leader.
    """
    at = ["band", "h"]
    placed = entries.join(labels.withColumnRenamed("node", "key"), "key", "left")
    placed = placed.withColumn("label", F.coalesce("label", "key"))
    parts = placed.groupBy(*at, "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = parts.groupBy(*at).agg(
        F.max_by("label", F.struct("n", "label")).alias("home"), F.count(F.lit(1)).alias("n_parts")
    )
    inside = placed.join(mixed.where("n_parts > 1").drop("n_parts"), at).where("key <> leader")
    inside = inside.withColumn("a", F.least("key", "leader")).withColumn("b", F.greatest("key", "leader"))
    inside = inside.join(known.withColumnRenamed("similarity", "near"), ["a", "b"]).drop("a", "b")
    x, y = inside.where("label <> home").alias("x"), inside.alias("y")
    same = (F.col("x.band") == F.col("y.band")) & (F.col("x.h") == F.col("y.h"))
    met = x.join(y, same & (F.col("x.label") != F.col("y.label")) & _possible("x", "y", threshold))
    return met.select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()


def classes(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    length: int = SHINGLE,
    threshold: float = THRESHOLD,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """Key (an integer), `class_id` (least key of its class) of every row."""
    docs, size = C.dealt(df, key, text)
    n_docs = df.count()
    by_chunk = docs.groupBy("chunk")
    bits = C.bits_for(size // 6)
    entries = by_chunk.applyInArrow(_count(length, bits), _ENTRIES)
    shared = written(entries.groupBy("bucket").applyInArrow(_sum, "chunk int, hashes binary, n binary"), "shingles")
    make = _vectors(length, n_docs, threshold, bands, rows)
    vectors = written(by_chunk.cogroup(shared.groupBy("chunk")).applyInArrow(make, _VECTORS), "vectors")
    whole = vectors.where("hashes is not null")
    same = ["same_1", "same_2"]
    leaders = whole.groupBy(*same).agg(F.min("key").alias("first"))
    firsts = whole.join(leaders, same).where("key = first").drop("first")
    entries = firsts.select("key", "whole", "shared", "bands", F.posexplode("bands").alias("band", "h"))
    hub = F.max_by("key", F.struct(F.col("shared") / F.col("whole"), -F.col("key")))
    buckets = entries.groupBy("band", "h").agg(hub.alias("leader"), F.count(F.lit(1)).alias("n"))
    entries = written(entries.join(buckets.where("n > 1").drop("n"), ["band", "h"]), "bands")
    whole = firsts.select("key", "hashes", "weights")
    pairs = entries.where("key <> leader").select(F.least("leader", "key").alias("a"), F.greatest("leader", "key").alias("b"))
    enough = F.col("similarity") >= threshold
    known = _similarities(pairs.distinct(), whole, "similarities")
    labels = components(known.where(enough))
    later = _later_pairs(entries, known, labels, threshold)
    more = _similarities(later, whole, "more-similarities").where(enough).select("a", "b")
    if not more.isEmpty():
        labels = components(labels.select(F.col("node").alias("a"), F.col("label").alias("b")).unionByName(more))
    of_class = leaders.join(labels.withColumnRenamed("node", "first"), "first", "left")
    of_class = of_class.select(*same, F.coalesce("label", "first").alias("class_id"))
    members = vectors.select("key", *same).join(of_class, same).groupBy("key").agg(F.min("class_id").alias("class_id"))
    joined = df.select(F.col(key).cast("bigint").alias("key")).join(members, "key", "left")
    return joined.select(F.col("key").alias(key), F.coalesce("class_id", "key").alias("class_id"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of `df` without near duplicates: of each class the document with the least key.

    Of rows with that same key one stays; rows without a key cannot be told apart and all stay.
    """
    least = classes(df, key, text, **options).where(F.col(key) == F.col("class_id")).select(F.col(key).alias("stays")).distinct()
    rows = df.select(F.struct("*").alias("row"), F.col(key).cast("bigint").alias("stays"), F.xxhash64(text).alias("print"))
    first = F.row_number().over(Window.partitionBy("stays").orderBy("print"))
    kept = rows.join(least, "stays").withColumn("nth", first).where("nth = 1").select("row.*")
    return kept.unionByName(df.where(F.col(key).isNull()))
