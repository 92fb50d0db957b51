"""Ids of many texts at once: each distinct chunk of bytes is encoded once and then looked up."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


#: Bytes that a Python worker remembers at most from task to task; twice that while it adds to them.
REMEMBERED = 64 << 20


class Memory:
    """Ids by the 64-bit hash of a chunk, in sorted arrays; emptied when it holds too many bytes."""

    def __init__(self, encode: Callable[[list[bytes]], list[list[int]]], limit: int = REMEMBERED):
        self.encode, self.limit = encode, limit
        self.empty()

    def empty(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start = np.zeros(0, np.uint32)
        self.n = np.zeros(0, np.uint32)
        self.ids = np.zeros(0, np.int32)

    @property
    def full(self) -> bool:
        return self.keys.nbytes + self.start.nbytes + self.n.nbytes + self.ids.nbytes > self.limit

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        if self.full:
            self.empty()
        known = np.zeros(len(keys), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            known = self.keys[at] == keys
        keys, chunks = keys[~known], [c for c, k in zip(chunks, known.tolist(), strict=True) if not k]
        if not chunks:
            return
        made = self.encode(chunks)
        n = np.fromiter(map(len, made), np.int64, len(made))
        new = np.fromiter((i for ids in made for i in ids), np.int32, int(n.sum()))
        start = len(self.ids) + np.cumsum(n) - n
        order = np.argsort(joined := np.concatenate((self.keys, keys)), kind="stable")
        self.keys = joined[order]
        self.start = np.concatenate((self.start, start.astype(np.uint32)))[order]
        self.n = np.concatenate((self.n, n.astype(np.uint32)))[order]
        self.ids = np.concatenate((self.ids, new))

    def lookup(self, keys: np.ndarray, begin: np.ndarray, end: np.ndarray, data: np.ndarray):
        """Number of ids of each chunk data[begin:end] with hash key, and all ids in order."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int32)
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        raw = data.tobytes()
        missing = np.ones(len(distinct), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            missing = self.keys[at] != distinct
        if missing.any():
            if self.full:
                missing[:] = True
            which = first[missing]
            spans = zip(begin[which].tolist(), end[which].tolist(), strict=True)
            self._learn(distinct[missing], [raw[b:e] for b, e in spans])
        at = np.searchsorted(self.keys, distinct)[back]
        n = self.n[at].astype(np.int64)
        total = np.cumsum(n)
        where = np.repeat(self.start[at].astype(np.int64) - (total - n), n) + np.arange(total[-1])
        return n, self.ids[where]
