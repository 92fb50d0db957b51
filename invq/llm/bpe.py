"""Byte-level BPE by a lazily determinised transducer, and streaming decoding.

The merges say which two tokens may stand side by side: a token sequence is the encoding of its
bytes exactly when merging each neighbouring pair's bytes gives that pair again. That makes a
finite-state transducer over bytes: a configuration is a place in the trie of tokens together
with the token before it, and reading a byte either goes down the trie or, where a token ends that
may follow, back to the root. Several configurations stay alive until enough bytes were seen; the
tokens on which all agree are emitted at once, so output lags by a bounded lookahead (no token is
longer than the longest of the vocabulary). Sets of configurations become states when they are
first met and are forgotten together once there are too many, so memory is bounded; a Python worker that
is kept for the next task keeps the trie and a bounded number of encoded pieces.

Defined results: a null text is empty and has no ids; ids decode to the very bytes; bytes that are
no UTF-8 (ids of part of a text) decode to U+FFFD as Python's incremental decoder does. Columns
other than the key and the text are ignored; repeated keys keep their own rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pieces import Memory
from .words import Texts, slices, span_keys, words

#: The transducer starts anew beyond so many states or four times as many moves, and asks anew which tokens may
#: be neighbours beyond so many answers. Its states go when the task ends.
MAX_STATES, MAX_FITS = 200_000, 400_000
#: Bytes of text that are looked at, and whose rows leave a task, together.
BATCH = 1 << 19


def read_ranks(path: str) -> list[bytes]:
    """Tokens in order of id from a file of base64 texts and ids."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    tokens = [b""] * (1 + max(int(rank) for _, rank in pairs))
    for text, rank in pairs:
        tokens[int(rank)] = base64.b64decode(text)
    return tokens


class Transducer:
    """Bytes of one piece in, token ids out."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {token: i for i, token in enumerate(tokens) if token}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int | None] = [None]
        for token, i in self.rank.items():
            if len(token) > 1 and self._merge(token) != [i]:
                continue  # merging never makes it; only a piece of its own can be it
            node = 0
            for byte in token:
                if byte not in self.children[node]:
                    self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                node = self.children[node][byte]
            self.ends[node] = i
        self.forget()

    def forget(self) -> None:
        self._fits: dict[int, bool] = {}
        self._start()

    def _start(self) -> None:
        start = ((0, -1, ()),)
        self._ids = {start: 0}
        self._states = [start]
        #: (state, byte) as one number -> (next state, ids emitted)
        self._moves: dict[int, tuple[int, tuple[int, ...]]] = {}

    def _merge(self, data: bytes) -> list[int]:
        """Merges the neighbours of lowest rank until none can be merged."""
        rank = self.rank
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [rank[part] for part in parts]

    def _follows(self, before: int, token: int) -> bool:
        if before < 0:
            return True
        known = self._fits.get(before << 32 | token)
        if known is None:
            if len(self._fits) > MAX_FITS:
                self._fits.clear()
            known = self._merge(self.tokens[before] + self.tokens[token]) == [before, token]
            self._fits[before << 32 | token] = known
        return known

    def _move(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Makes the transition that has not been taken before.

        Configurations stay in the order of where their unfinished token begins, so the one at the
        root, whose tokens end just here, is the last.
        """
        children, ends = self.children, self.ends
        alive, root = [], None
        for node, before, out in self._states[state]:
            child = children[node].get(byte)
            if child is None:
                continue
            if children[child]:
                alive.append((child, before, out))
            token = ends[child]
            if root is None and token is not None and self._follows(before, token):
                root = (0, token, (*out, token))
        if alive:
            alive.append(root)
            first, n = alive[0][2], 0
            for id_ in first:
                if any(len(c[2]) <= n or c[2][n] != id_ for c in alive):
                    break
                n += 1
            first = first[:n]
            following = tuple((node, before, out[n:]) for node, before, out in alive) if n else tuple(alive)
        else:  # all agree on what has been read
            first, following = root[2], ((0, root[1], ()),)
        to = self._ids.get(following)
        if to is None:
            to = self._ids[following] = len(self._states)
            self._states.append(following)
        move = self._moves[state << 8 | byte] = to, first
        return move

    def encode(self, piece: bytes) -> list[int]:
        whole = self.rank.get(piece)
        if whole is not None:
            return [whole]
        if len(self._states) > MAX_STATES or len(self._moves) > 4 * MAX_STATES:
            self._start()
        state, out, known = 0, [], self._moves.get
        for byte in piece:
            state, emitted = known(state << 8 | byte) or self._move(state, byte)
            if emitted:
                out += emitted
        out += self._states[state][-1][2]
        return out


class Encoder:
    """Whole texts to ids: each match of the pattern by the transducer, remembered by chunk.

    No match of the pattern crosses from a character that is no white space to one that is, and none
    looks behind, so a text may be cut there. Chunks are cut at plain white space only; a text with
    any other kind is not cut.
    """

    def __init__(self, path: str, pattern: str):
        self.transducer = Transducer(read_ranks(path))
        self.split = regex.compile(pattern).findall
        self.memory = Memory(self._encode)

    def _encode(self, chunks: list[bytes]) -> list[list[int]]:
        split, encode = self.split, self.transducer.encode
        made = []
        for chunk in chunks:
            if chunk.lstrip(b" ").isalpha() and not chunk.startswith(b"  "):
                made.append(encode(chunk))  # ASCII letters after a space at most: one match
                continue
            out: list[int] = []
            for piece in split(chunk.decode()):
                out += encode(piece.encode())
            made.append(out)
        return made

    def forget(self) -> None:
        """Drops all that was learned from texts."""
        self.transducer.forget()
        self.memory.empty()

    def encode(self, texts: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each text of a slice, and all ids in order."""
        row, begin, end = chunks(texts, strange_space(texts))
        n, ids = self.memory.lookup(span_keys(texts.data, begin, end), begin, end, texts.data)
        return np.bincount(row, n, texts.n).astype(np.int64), ids


def chunks(texts: Texts, whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the pieces into which texts are cut after each of their words.

    A piece reaches from the end of the word before, or from the text's start, to its own end; white
    space after the last word is a piece. Rows flagged in `whole` are not cut.
    """
    found = words(texts)
    first = np.diff(found.row, prepend=-1) > 0
    begin = np.where(first, texts.bounds[found.row], np.roll(found.end, 1))
    last = texts.bounds[:-1].copy()
    last[found.row] = found.end
    last[whole] = texts.bounds[:-1][whole]
    rest = np.flatnonzero(last < texts.bounds[1:])
    cut = ~whole[found.row]
    row = np.concatenate((found.row[cut], rest))
    begin = np.concatenate((begin[cut], last[rest]))
    end = np.concatenate((found.end[cut], texts.bounds[1:][rest]))
    order = np.argsort(begin, kind="stable")
    return row[order], begin[order], end[order]


def strange_space(texts: Texts) -> np.ndarray:
    """Rows with white space, or what some library takes for it, beyond the plain ASCII kind."""
    data = texts.data
    at = np.flatnonzero((data >= 0x1C) & (data <= 0x1F) | (data == 0xC2) | (data >= 0xE1) & (data <= 0xE3))
    ahead = np.concatenate((data, np.zeros(2, np.uint8)))
    a, b, c = data[at], ahead[at + 1], ahead[at + 2]
    odd = a < 0x20
    odd |= (a == 0xC2) & ((b == 0x85) | (b == 0xA0))
    odd |= (a == 0xE1) & ((b == 0x9A) | (b == 0xA0))
    odd |= (a == 0xE2) & ((b == 0x80) & ((c <= 0x8F) | (c >= 0xA8) & (c <= 0xAF)) | (b == 0x81))
    odd |= (a == 0xE3) & (b == 0x80) & (c == 0x80)
    rows = np.zeros(texts.n, bool)
    rows[np.searchsorted(texts.bounds, at[odd], "right") - 1] = True
    return rows


def _machine() -> list[bytes]:
    """Next state by state and byte. State 0 is between characters, _WRONG is where no character can go on; the others
    say which bytes may follow, as the Unicode standard's table of well-formed sequences has them."""
    tail = range(0x80, 0xC0)
    follows = {1: (tail, 0), 2: (tail, 1), 3: (range(0xA0, 0xC0), 1), 4: (range(0x80, 0xA0), 1)}
    follows |= {5: (tail, 2), 6: (range(0x90, 0xC0), 2), 7: (range(0x80, 0x90), 2)}
    leads = {1: range(0xC2, 0xE0), 2: [*range(0xE1, 0xED), 0xEE, 0xEF], 3: [0xE0], 4: [0xED]}
    leads |= {5: range(0xF1, 0xF4), 6: [0xF0], 7: [0xF4]}
    table = [bytearray([_WRONG] * 256) for _ in range(8)]
    table[0][:128] = bytes(128)
    for state, lead in leads.items():
        for byte in lead:
            table[0][byte] = state
    for state, (allowed, to) in follows.items():
        for byte in allowed:
            table[state][byte] = to
    return [bytes(row) for row in table]


_WRONG = 8
_TABLE = _machine()
_BEYOND_ASCII = re.compile(rb"[\x80-\xff]+")


class StreamDecoder:
    """Ids to text, some at a time, by a state machine over UTF-8 bytes; a character that is not yet whole
    waits for the next call. Bytes below 128 leave the machine between characters, so it only looks at runs of others.

    Where no character can go on, what there is of it becomes U+FFFD, and the byte is read anew.
    """

    def __init__(self, tokens: list[bytes]):
        self.tokens, self.state, self.held = tokens, 0, b""

    def feed(self, ids) -> str:
        data = self.held + b"".join(map(self.tokens.__getitem__, ids))
        out, done, known = [], 0, len(self.held)  # the machine has read what was held
        state, began = self.state, 0  # where the unfinished character begins
        for run in _BEYOND_ASCII.finditer(data):
            at, end = max(run.start(), known), run.end()
            while at < end:
                if not state:
                    began = at
                to = _TABLE[state][data[at]]
                if to == _WRONG:
                    out += (data[done:began].decode(), "\ufffd")
                    at += not state  # a byte that cannot begin a character is one by itself
                    done, state = at, 0
                    continue
                state, at = to, at + 1
            if state and end < len(data):  # a byte below 128 where a character should go on
                out += (data[done:began].decode(), "\ufffd")
                done, state = end, 0
        cut = began if state else len(data)
        out.append(data[done:cut].decode())
        self.state, self.held = state, data[cut:]
        return "".join(out)

    def end(self) -> str:
        rest = "\ufffd" if self.state else ""
        self.state, self.held = 0, b""
        return rest


#: Ids that a decoder takes at once.
STEP = 1 << 16


def decode_ids(decoder: StreamDecoder, ids: list[int]) -> str:
    parts = [decoder.feed(ids[i : i + STEP]) for i in range(0, len(ids), STEP)]
    return "".join([*parts, decoder.end()])


@lru_cache(maxsize=1)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=1)
def _tokens(path: str) -> list[bytes]:
    return read_ranks(path)


def _batches(batches: Iterable[pa.RecordBatch], path: str, pattern: str, back: bool) -> Iterator[pa.RecordBatch]:
    encoder = _encoder(path, pattern)
    try:
        for batch in batches:
            key, column = batch.column(0), batch.column(1)
            for texts in slices(column, BATCH):
                n, ids = encoder.encode(texts)
                at = np.concatenate(([0], np.cumsum(n)))
                out = [key.slice(texts.first, texts.n), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))]
                names = ["key", "ids"]
                if back:
                    decoder, ends = StreamDecoder(encoder.transducer.tokens), at.tolist()
                    spans = zip(ends[:-1], ends[1:], strict=True)
                    out.append(pa.array([decode_ids(decoder, ids[a:b].tolist()) for a, b in spans], pa.string()))
                    names.append("decoded")
                yield pa.RecordBatch.from_arrays(out, names=names)
    finally:
        encoder.transducer.forget()  # the pieces are packed and bounded: they may help the worker's next task
        pa.default_memory_pool().release_unused()


def encode(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key and `ids` array<int> of every text, by the ranks in `path` on each match of `pattern`."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(lambda it: _batches(it, path, pattern, False), f"key {kind}, ids array<int>")
    return made.withColumnRenamed("key", key)


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`encode`, and `decoded`: the ids turned back to text, in the same pass over the rows."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    made = rows.mapInArrow(
        lambda it: _batches(it, path, pattern, True), f"key {kind}, ids array<int>, decoded string"
    )
    return made.withColumnRenamed("key", key)


def decode(df: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Key and `decoded` text of every array of ids (null: empty)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = StreamDecoder(_tokens(path))
        for batch in batches:
            texts = [decode_ids(decoder, x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "decoded"])

    rows = df.select(F.col(key).alias("key"), F.col(ids).alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    return rows.mapInArrow(run, f"key {kind}, decoded string").withColumnRenamed("key", key)
