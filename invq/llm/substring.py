"""Substring dedup: windows of words that repeat across documents, found level by level.

Level-wise doubling: a window of many words can repeat only if the shorter windows within it do. The
shortest level takes, of each run of windows that a longest one spans, the one with the least
hash; every longer window contains such a one, so nothing repeated is missed, and a quarter of the
windows is enough. Windows that two documents share at one length are extended to twice that length
(at most the length asked for), until that length is reached or no candidate survives. Every word
covered by a window of the asked length whose word sequence also starts in a document with a smaller
key is removed, judged on the input.

Hashes are 64 bits wide. A level sends one entry per hash and chunk of documents, so a passage in
a third of all documents costs as many entries as there are chunks.

Defined results: a null text has no words; rows with equal keys are one document's parts with
respect to "smaller", so neither removes the other's words; null keys come before all others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import chunks as C
from .common import type_of, written
from .words import Texts, Words, mix, runs, slices, windows, words

LENGTH = 13
_NULL = np.iinfo(np.int64).min


def levels(length: int, shortest: int = 7) -> list[int]:
    """Window lengths from short to long, each at most twice the one before."""
    found = [length]
    while found[0] > shortest:
        found.insert(0, max((found[0] + 1) // 2, min(shortest, found[0])))
    return found


def _anchors(found: Words, short: int, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of `length` words: where it starts, and place and hash of its least short window."""
    key, _ = windows(found, short)
    n = len(key) - length + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64)
    start = np.flatnonzero(found.row[:n] == found.row[length - 1 :])
    least, place = key[:n].copy(), np.arange(n)
    for i in range(1, length - short + 1):
        smaller = key[i : i + n] < least
        least[smaller] = key[i : i + n][smaller]
        place[smaller] = np.flatnonzero(smaller) + i
    return start, place[start], mix(least[start])  # least hashes lie low; buckets go by top bits


def _keys(docs: pa.Table) -> np.ndarray:
    return docs.column("key").cast(pa.int64()).fill_null(_NULL).to_numpy()


def _level_entries(table: pa.Table, known: list[np.ndarray], level: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidate windows of the next level: sorted hashes, least key of each, whether several keys have it.

    `known` has the surviving hashes of the levels before, shortest first.
    """
    keys = _keys(table)
    hashes, owners = [], []
    for texts in slices(table.column("text")):
        found = words(texts)
        start, hash_ = _candidates(found, known, level)
        hashes.append(hash_)
        owners.append(keys[texts.first + found.row[start]])
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, bool)
    hash_, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.lexsort((owner, hash_))
    hash_, owner = hash_[order], owner[order]
    at, n = runs(hash_)
    return hash_[at], owner[at], owner[at] != owner[at + n - 1]


def _candidates(found: Words, known: list[np.ndarray], level: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows at level len(known) that contain survivors of the level before."""
    step = len(known)
    if step == 0:
        if len(level) == 1:
            key, fits = windows(found, level[0])
            start = np.flatnonzero(fits)
            return start, key[start]
        _, place, hash_ = _anchors(found, level[0], level[1])
        keep = np.flatnonzero(np.diff(place, prepend=-1) != 0) if len(place) else place
        return place[keep], hash_[keep]
    if step == 1:
        start, _, hash_ = _anchors(found, level[0], level[1])
        start = start[C.member(hash_, known[0])]
    else:
        before, hash_ = _candidates(found, known[:-1], level)
        alive = np.zeros(len(found.key), bool)
        alive[before[C.member(hash_, known[-1])]] = True
        ahead = level[step] - level[step - 1]
        start = np.flatnonzero(alive[: len(alive) - ahead] & alive[ahead:]) if ahead < len(alive) else np.zeros(0, np.int64)
        start = start[found.row[start] == found.row[start + level[step] - 1]] if len(start) else start
    key, _ = windows(found, level[step])
    return start, key[start]


_ENTRIES = "bucket int, chunk int, hashes binary, owners binary, several binary"
_BACK = "chunk int, level int, hashes binary, owners binary"


def _packed(chunk: int, hash_: np.ndarray, owner: np.ndarray, several: np.ndarray, bits: int, last: bool) -> pa.Table:
    rows = [
        (b, chunk, hash_[s].tobytes(), owner[s].tobytes() if last else b"", np.packbits(several[s]).tobytes())
        for b, s in C.split(hash_, bits)
    ]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    names = ("bucket", "chunk", "hashes", "owners", "several")
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def _known(back: pa.Table, upto: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Surviving hashes per level below `upto`, sorted; hashes and least keys of the last level."""
    level = back.column("level").to_pylist()
    hashes = back.column("hashes").to_pylist()
    owners = back.column("owners").to_pylist()
    known, last, least = [], np.zeros(0, np.uint64), np.zeros(0, np.int64)
    for step in range(upto):
        mine = [i for i, v in enumerate(level) if v == step]
        joined = b"".join(hashes[i] for i in mine)
        hash_ = np.frombuffer(joined, np.uint64)
        order = np.argsort(hash_)
        known.append(hash_[order])
        if step == upto - 1:
            last, told = hash_[order], b"".join(owners[i] for i in mine)
            if told:
                least = np.frombuffer(told, np.int64)[order]
    return known, last, least


def _meet(step: int):
    """Per bucket: which hashes two documents share, told to every chunk that has them."""

    def run(table: pa.Table) -> pa.Table:
        chunk = np.array(table.column("chunk").to_pylist(), np.int32)
        hashes = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        n = np.array([len(x) for x in hashes])
        several = [
            np.unpackbits(np.frombuffer(x, np.uint8), count=k)
            for x, k in zip(table.column("several").to_pylist(), n.tolist(), strict=True)
        ]
        hash_ = np.concatenate(hashes)
        owners = b"".join(table.column("owners").to_pylist())
        owner = np.frombuffer(owners, np.int64) if owners else np.zeros(len(hash_), np.int64)
        alone = ~np.concatenate(several).astype(bool)
        of = np.repeat(np.arange(len(chunk)), n)
        order = np.argsort(hash_, kind="stable")
        hash_, owner, alone, of = hash_[order], owner[order], alone[order], of[order]
        at, length = runs(hash_)
        least = np.minimum.reduceat(owner, at)
        shared = (length > 1) | ~np.logical_and.reduceat(alone, at)
        keep = np.repeat(shared, length)
        least, hash_, of = np.repeat(least, length)[keep], hash_[keep], of[keep]
        order = np.argsort(of, kind="stable")
        hash_, least, of = hash_[order], least[order], of[order]
        at, length = runs(of)
        spans = [slice(a, a + k) for a, k in zip(at.tolist(), length.tolist(), strict=True)]
        return pa.table(
            {
                "chunk": pa.array(chunk[of[at]], pa.int32()),
                "level": pa.array(np.full(len(at), step, np.int32)),
                "hashes": pa.array([hash_[s].tobytes() for s in spans], pa.binary()),
                "owners": pa.array([least[s].tobytes() if owners else b"" for s in spans], pa.binary()),
            }
        )

    return run


def _find(step: int, level: list[int], bits: int):
    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known, _, _ = _known(back, step)
        hash_, owner, several = _level_entries(docs, known, level)
        chunk = docs.column("chunk")[0].as_py() if docs.num_rows else 0
        return _packed(chunk, hash_, owner, several, bits, step == len(level) - 1)

    return run


def _alone(find):
    return lambda docs: find(docs, _NOTHING)


def _mark(level: list[int]):
    """Rewrites the texts of a chunk without the words that repeated windows cover."""
    length = level[-1]

    def run(docs: pa.Table, back: pa.Table) -> pa.Table:
        known, last, least = _known(back, len(level))
        keys = _keys(docs)
        total, gone, texts_out = [], [], []
        for texts in slices(docs.column("text")):
            found = words(texts)
            start, hash_ = _candidates(found, known[:-1], level)
            hit = C.member(hash_, last)
            start, hash_ = start[hit], hash_[hit]
            later = keys[texts.first + found.row[start]] > least[np.searchsorted(last, hash_)]
            cover = np.zeros(len(found.key) + length, np.int32)
            np.add.at(cover, start[later], 1)
            np.subtract.at(cover, start[later] + length, 1)
            removed = np.cumsum(cover)[: len(found.key)] > 0
            total.append(np.bincount(found.row, minlength=texts.n))
            gone.append(np.bincount(found.row[removed], minlength=texts.n))
            texts_out += _kept(texts, found, removed)
        return pa.table(
            {
                "key": docs.column("key"),
                "n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *total]), pa.int64()),
                "n_removed": pa.array(np.concatenate([np.zeros(0, np.int64), *gone]), pa.int64()),
                "kept": pa.array(texts_out, pa.string()),
            }
        )

    return run


def _kept(texts: Texts, found: Words, removed: np.ndarray) -> list[str]:
    """Kept words of each text, joined by one space."""
    stay = np.flatnonzero(~removed)
    row, start, end = found.row[stay], found.start[stay], found.end[stay]
    size = end - start + 1
    total = np.cumsum(size)
    out = np.full(int(total[-1]) if len(total) else 0, ord(" "), np.uint8)
    if len(total):
        inside = np.ones(len(out), bool)
        inside[total - 1] = False
        within = np.repeat(start - (total - size), size) + np.arange(len(out))
        out[inside] = texts.data[within[inside]]
    raw = out.tobytes()
    edge = np.concatenate(([0], total))[np.searchsorted(row, np.arange(texts.n + 1))]
    return [raw[a : max(a, b - 1)].decode() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]


def remove_repeats(df: DataFrame, length: int = LENGTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key (an integer), n_words, n_removed and `kept`: the text's words outside repeated windows."""
    docs, size = C.dealt(df, key, text)
    level = levels(length)
    bits = C.bits_for(size // 12)
    by_chunk = docs.groupBy("chunk")
    back = None
    for step in range(len(level)):
        find = _find(step, level, bits)
        if back is None:
            entries = by_chunk.applyInArrow(_alone(find), _ENTRIES)
        else:
            entries = by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(find, _ENTRIES)
        met = written(entries.groupBy("bucket").applyInArrow(_meet(step), _BACK), f"windows-{level[step]}")
        back = met if back is None else back.unionByName(met)
    out = f"key {type_of(df, key)}, n_words bigint, n_removed bigint, kept string"
    made = by_chunk.cogroup(back.groupBy("chunk")).applyInArrow(_mark(level), out)
    return made.withColumnRenamed("key", key)


_NOTHING = pa.table(
    {
        "chunk": pa.array([], pa.int32()),
        "level": pa.array([], pa.int32()),
        "hashes": pa.array([], pa.binary()),
        "owners": pa.array([], pa.binary()),
    }
)
