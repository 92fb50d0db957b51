"""Token ids in directly addressable codes: any token of a file is read without decoding others.

An id is split into chunks of `WIDTH` bits, least first. Level k holds the k-th chunk of every id that
has one, a bitmap of which of them go on to level k + 1, and a rank directory (ones before every 512th
bit), so the place of an id's next chunk is a rank query of constant time.

Files are raw: what Spark writes of a row, byte by byte and without compression, one row a file. They go through Spark's
committer, so a lost executor leaves no half file. A file has a head (ids and documents in it, the keys and the lengths of
the documents) and the code; `CodeFile` reads a token of one with a few small reads. Files follow each other in
ascending key order, by the numbers in their names; each holds whole documents, about sixteen megabytes of text.

Defined results: a null text has only the end id; null keys come first; documents with equal keys
follow each other in order of their texts.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch
from .bpe import strange_space
from .common import looked_up, shuffles_dropped, written
from .pieces import Memory
from .words import SLICE, Texts, slices, span_keys, spans

WIDTH = 8
BLOCK = 512
MAGIC = b"DAC2"
#: Text that one file is made of, and that one task writes.
FILE_BYTES, TASK_BYTES = 1 << 24, 1 << 27


def pack(ids: np.ndarray) -> bytes:
    """Magic, number of levels, then per level its length, chunks, bitmap and rank directory."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> np.uint32(WIDTH) > 0
        bits = np.packbits(more, bitorder="little").tobytes()
        ones = np.add.reduceat(more, np.arange(0, len(more), BLOCK)) if len(more) else np.zeros(0, np.int64)
        before = (np.cumsum(ones) - ones).astype(np.uint32)
        low = (rest & np.uint32((1 << WIDTH) - 1)).astype(np.uint8)
        levels.append(struct.pack("<I", len(rest)) + low.tobytes() + bits + before.tobytes())
        if not more.any():
            return MAGIC + struct.pack("<I", len(levels)) + b"".join(levels)
        rest = rest[more] >> np.uint32(WIDTH)


class Codes:
    """A packed file: `token(i)` and `span(a, b)` touch only what they return and its rank blocks."""

    def __init__(self, data: bytes):
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n_levels, at = struct.unpack_from("<I", data, 4)[0], 8
        self.levels = []
        for _ in range(n_levels):
            n = struct.unpack_from("<I", data, at)[0]
            low = np.frombuffer(data, np.uint8, n, at + 4)
            at += 4 + n
            bits = np.frombuffer(data, np.uint8, -(-n // 8), at)
            at += len(bits)
            before = np.frombuffer(data, "<u4", -(-n // BLOCK), at)
            at += 4 * len(before)
            self.levels.append((low, bits, before))

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Ones before bit i."""
        _, bits, before = self.levels[level]
        block = i // BLOCK
        if block == len(before):
            if not block:
                return 0
            block -= 1
        first = block * BLOCK // 8
        whole = np.unpackbits(bits[first : -(-i // 8)], count=i - block * BLOCK, bitorder="little")
        return int(before[block]) + int(whole.sum())

    def token(self, i: int) -> int:
        out = 0
        for level, (low, bits, _) in enumerate(self.levels):
            out |= int(low[i]) << (WIDTH * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return out

    def span(self, a: int, b: int, level: int = 0) -> np.ndarray:
        low, bits, _ = self.levels[level]
        out = low[a:b].astype(np.uint32)
        if b > a:
            first = a // 8
            more = np.unpackbits(bits[first : -(-b // 8)], count=b - first * 8, bitorder="little")[a - first * 8 :]
            if more.any():
                at = self._rank(level, a)
                ahead = self.span(at, at + int(more.sum()), level + 1)
                out[more.astype(bool)] |= ahead << np.uint32(WIDTH)
        return out


class CodeFile:
    """A raw file by small reads: its head, and for a token a byte and a rank block a level."""

    def __init__(self, file):
        self.file = file
        magic, self.n_tokens, self.n_docs, head = struct.unpack(_HEAD, self._read(0, struct.calcsize(_HEAD)))
        if magic != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        at = struct.calcsize(_HEAD) + head + len(MAGIC)
        (n_levels,) = struct.unpack("<I", self._read(at, 4))
        at, self.levels = at + 4, []
        for _ in range(n_levels):
            (n,) = struct.unpack("<I", self._read(at, 4))
            low, bits = at + 4, at + 4 + n
            before = bits + -(-n // 8)
            self.levels.append((low, bits, before))
            at = before + 4 * -(-n // BLOCK)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def token(self, i: int) -> int:
        out = 0
        for level, (low, bits, before) in enumerate(self.levels):
            out |= self._read(low + i, 1)[0] << (WIDTH * level)
            block = i // BLOCK
            upto = np.unpackbits(
                np.frombuffer(self._read(bits + block * BLOCK // 8, i // 8 + 1 - block * BLOCK // 8), np.uint8), bitorder="little"
            )
            inside = i - block * BLOCK
            if not upto[inside]:
                break
            i = struct.unpack("<I", self._read(before + 4 * block, 4))[0] + int(upto[:inside].sum())
        return out


#: Magic, ids, documents, and bytes of what tells of the documents.
_HEAD = ">4sQII"


def packed_file(ids: np.ndarray, keys: pa.Array, lengths: np.ndarray) -> bytes:
    table = pa.table({"key": keys, "length": pa.array(lengths, pa.int64())}).replace_schema_metadata(None)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    documents = sink.getvalue().to_pybytes()
    return struct.pack(_HEAD, MAGIC, len(ids), len(keys), len(documents)) + documents + pack(ids)


def unpacked_file(data: bytes) -> tuple[pa.Table, Codes]:
    """Keys and lengths of the documents, and the codes."""
    _, _, _, n = struct.unpack_from(_HEAD, data)
    at = struct.calcsize(_HEAD)
    return pa.ipc.open_stream(data[at : at + n]).read_all(), Codes(memoryview(data)[at + n :])


@lru_cache(maxsize=1)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[0x21:0x7F] = True
_MARK[0x30:0x3A] = False
_MARK &= ~_LETTER


def pieces(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of what this tokenizer encodes apart, and the bytes to encode.

    It drops white space, parts words there and between an ASCII letter and an ASCII mark (but not after an apostrophe, which may
    take the letter along), and has no capitals. So pieces end there, and ASCII capitals become small ones, but not
    before another kind of character, with which a capital and a small letter may compose differently. Words
    with `<|`, of which special tokens may be made, and rows with other white space stay as they are.
    """
    data, whole = texts.data, strange_space(texts)
    row, start, end = spans(texts)
    ahead = np.append(data[1:], 0) if len(data) else data
    special = np.zeros(len(start), bool)
    special[np.searchsorted(start, np.flatnonzero((data == ord("<")) & (ahead == ord("|"))), "right") - 1] = True
    plain = start[~special & ~whole[row]], end[~special & ~whole[row]]
    # +1 where a plain word starts, -1 where it ends: 1 within plain words
    within = np.zeros(len(data) + 1, np.int8)
    within[plain[0]] = 1
    within[plain[1]] -= 1
    within = np.cumsum(within, dtype=np.int8)[:-1].view(bool)
    last = np.zeros(len(data), bool)
    last[end - 1] = True
    capital = (data >= 0x41) & (data <= 0x5A) & within & ((ahead < 0x80) | last)
    data = data + (capital.astype(np.uint8) << 5)
    letter, mark = _LETTER[data], _MARK[data]
    cut = letter[:-1] & mark[1:] | mark[:-1] & letter[1:] & (data[:-1] != ord("'"))
    at = np.flatnonzero(cut & within[1:] & ~last[:-1]) + 1
    kept = ~whole[row]
    begin, stop = np.sort(np.concatenate((start[kept], at))), np.sort(np.concatenate((end[kept], at)))
    of = np.searchsorted(texts.bounds, begin, "right") - 1
    rest = np.flatnonzero(whole)
    row, begin = np.concatenate((of, rest)), np.concatenate((begin, texts.bounds[:-1][rest]))
    stop = np.concatenate((stop, texts.bounds[1:][rest]))
    order = np.argsort(begin, kind="stable")
    return row[order], begin[order], stop[order], data


#: Small letters that no normal form changes or joins: a run of them is one word of the tokenizer, whose last id ends it.
_ONE_WORD = re.compile("[a-zß-öø-ÿα-ωа-я]+")
#: Words that are encoded as one text.
_TOGETHER = 100


@lru_cache(maxsize=1)
def _memory(path: str) -> Memory:
    tokenizer = _tokenizer(path)
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    vocabulary = tokenizer.get_vocab(with_added_tokens=False)
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    if suffix:
        ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def apart(texts: list[str]) -> list[list[int]]:
        return [made.ids for made in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(pieces: list[bytes]) -> list[list[int]]:
        texts = [piece.decode() for piece in pieces]
        made: list = [None] * len(texts)
        single = [i for i, text in enumerate(texts) if _ONE_WORD.fullmatch(text)]
        groups = [single[i : i + _TOGETHER] for i in range(0, len(single), _TOGETHER)]
        for group, ids in zip(groups, apart([" ".join([texts[i] for i in group]) for group in groups]), strict=True):
            stops = (np.flatnonzero(ends[ids]) + 1).tolist()
            if len(stops) == len(group) and stops[-1] == len(ids):
                for i, a, b in zip(group, [0, *stops], stops):  # noqa: B905
                    made[i] = ids[a:b]
        others = [i for i, ids in enumerate(made) if ids is None]
        for i, ids in zip(others, apart([texts[i] for i in others]), strict=True):
            made[i] = ids
        return made

    return Memory(encode)


def _files(path: str, end: int):
    """Each distinct piece is encoded once and then looked up."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, held, size = _memory(path), [], 0

        def file() -> pa.RecordBatch:
            keys, count, ids = zip(*held, strict=True)
            data = packed_file(np.concatenate(ids), pa.concat_arrays(keys), np.concatenate(count))
            return pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["code"])

        for batch in batches:
            for texts in slices(batch.column(1), min(SLICE, FILE_BYTES)):
                row, begin, stop, data = pieces(texts)
                n, ids = memory.lookup(span_keys(data, begin, stop), begin, stop, data)
                count = np.bincount(row, n, texts.n).astype(np.int64)
                ids = np.insert(ids, np.cumsum(count), end).astype(np.uint32)
                held.append((batch.column(0).slice(texts.first, texts.n), count + 1, ids))
                size += len(texts.data)
                if size >= FILE_BYTES:
                    yield file()
                    held, size = [], 0
        if held:
            yield file()

    return run


def write(df: DataFrame, path: str, end: int, key: str = "doc_id", text: str = "text", folder: str | None = None) -> DataFrame:
    """Writes the ids of all texts, each text's followed by `end`, in ascending key order; gives `opened` files."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    ordered = rows.repartitionByRange(parts, "key").sortWithinPartitions("key", "text")
    made = ordered.mapInArrow(_files(path, end), "code binary")
    folder = folder or scratch(spark, "token-files")
    with shuffles_dropped(spark):
        # the text writer writes a string's bytes as they are, and a line end after them
        made.select(F.col("code").cast("string")).write.option("maxRecordsPerFile", 1).text(folder)
    return opened(spark, folder)


def opened(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a folder: part and place in the order, n_tokens and content."""
    files = spark.read.format("binaryFile").load(folder).where(F.col("length") > struct.calcsize(_HEAD))
    name = [F.regexp_extract("path", r"/part-(\d+)-[^/]*-c(\d+)[^/]*$", i).cast("int") for i in (1, 2)]
    n_tokens = F.conv(F.hex(F.substring("content", len(MAGIC) + 1, 8)), 16, 10).cast("bigint")
    return files.select(name[0].alias("part"), name[1].alias("place"), n_tokens.alias("n_tokens"), "content")


def placed(files: DataFrame) -> DataFrame:
    """Adds `start`, the ids in all files before; only one row a task's share meets in one place."""
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part")) - F.col("total")
    starts = totals.select("part", before.alias("part_start"))
    order = Window.partitionBy("part").orderBy("place")
    index = files.select("part", "place", (F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("inside"))
    index = index.join(starts, "part").select("part", "place", (F.col("part_start") + F.col("inside")).alias("start"))
    return looked_up(files, written(index, "token-starts"), ["part", "place"])


def read(files: DataFrame, key: str = "doc_id", kind: str = "bigint") -> DataFrame:
    """Key (of type `kind`), `start` (ids of all documents before), n_tokens and ids_crc32, read back from the files."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts, content = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):
                documents, codes = unpacked_file(content[i].as_py())
                n = np.asarray(documents.column("length"))
                at = np.cumsum(n) - n
                spans = zip(at.tolist(), (at + n).tolist(), strict=True)
                sums = [zlib.crc32(codes.span(a, b).astype("<u4").tobytes()) for a, b in spans]
                columns = [
                    documents.column("key").combine_chunks(),
                    pa.array(starts[i].as_py() + at, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(sums, pa.int64()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32"])

    rows = placed(files).select("start", "content")
    made = rows.mapInArrow(run, f"key {kind}, start bigint, n_tokens bigint, ids_crc32 bigint")
    return made.withColumnRenamed("key", key)
