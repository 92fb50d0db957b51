"""Merkle manifest of a table: a leaf a row, a tree a group, a tree over the groups' roots.

Where a leaf lies in its group's tree is a rank query, not a sort. Tasks reduce the keys they hold to
bitmaps of 2^12 keys each (short ones as sorted offsets), which are merged by group and range of keys;
a merged bitmap has a popcount directory, and a running sum over the bitmaps of a group says how many leaves
come before each. A key's coordinate is that sum, the directory's entry and the ones before it in its block.
Keys that occur more than once are counted beside the bitmap; their leaves follow each other in order of
digest, numbered by ranges of the digest.

Levels are then reduced in slot arrays: leaves are keyed by (group, coordinate / 16^3), each fills its slot, and
three levels of runs of 16 are hashed in place. What remains is 16^3 times smaller and goes the same way, so
the number of rounds is that of the digits of the largest group. Equal leaves travel as one run of slots.
Proofs come down the same way: a block's slots share all siblings above the block.

Defined results: keys are integers; null keys come first; rows equal in key and digest are interchangeable
and have a slot each; a null group is one of its own and comes first; a null value is `-`. No rows have no
manifest. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .grouped import flat, map_sorted, sorted_groups

#: Nodes of a run, and nodes of a block: three levels of runs.
RUN, LEVELS = 16, 3
BLOCK = RUN**LEVELS
_DIGEST = 32

#: Keys that a bitmap covers, by the bits below its bucket; offsets beyond which it is no list any more.
_BITS = 12
_KEYS = 1 << _BITS
_LIST = _KEYS // 16
#: Keys that a task holds before it sends their bitmaps, and leaves of one bitmap that meet in a task.
HELD, HOT_LEAVES = 1 << 20, 500_000
#: The bucket of null keys, below all others.
_NULL_BUCKET = -(1 << 50)


def digest_of(values: list[Column]) -> Column:
    """SHA-256 of values, each with its number of bytes before it, as 32 bytes."""
    parts = []
    for value in values:
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


# -- bitmaps of keys ---------------------------------------------------------------------------


def pack(counts: np.ndarray) -> bytes:
    """A bitmap from the number of leaves of each of its keys: its kind, the keys that repeat and how
    often beyond the first, then sorted offsets, or bits after a directory of ones before every 512th."""
    present, more = np.flatnonzero(counts), np.flatnonzero(counts > 1)
    head = np.array([len(more)], "<u4").tobytes()
    extra = more.astype("<u2").tobytes() + (counts[more] - 1).astype("<i8").tobytes()
    if len(present) <= _LIST:
        return b"L" + head + extra + present.astype("<u2").tobytes()
    bits = np.zeros(_KEYS, bool)
    bits[present] = True
    ones = bits.reshape(-1, 512).sum(1)
    before = (np.cumsum(ones) - ones).astype("<u2")
    return b"B" + head + extra + before.tobytes() + np.packbits(bits, bitorder="little").tobytes()


class Bitmap:
    def __init__(self, data: bytes):
        n = int(np.frombuffer(data, "<u4", 1, 1)[0])
        self.more = np.frombuffer(data, "<u2", n, 5)
        self.extra = np.frombuffer(data, "<i8", n, 5 + 2 * n)
        at = 5 + 10 * n
        self.listed = data[:1] == b"L"
        if self.listed:
            self.offsets = np.frombuffer(data, "<u2", -1, at)
        else:
            self.before = np.frombuffer(data, "<u2", _KEYS // 512, at)
            self.words = np.frombuffer(data, "<u8", _KEYS // 64, at + _KEYS // 256)

    def add_to(self, counts: np.ndarray) -> None:
        """Merges this bitmap into the numbers of leaves of each key."""
        if self.listed:
            counts[self.offsets] += 1
        else:
            counts += np.unpackbits(self.words.view(np.uint8), bitorder="little")
        counts[self.more] += self.extra

    def rank(self, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaves before each key of the bitmap, and whether the key has more than one."""
        if self.listed:
            ones = np.searchsorted(self.offsets, offsets)
        else:
            word, bit = offsets >> 6, (offsets & 63).astype(np.uint64)
            per_word = np.bitwise_count(self.words).reshape(-1, 8).astype(np.int64)
            inside = (np.cumsum(per_word, axis=1) - per_word).reshape(-1)
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            ones = self.before[offsets >> 9] + inside[word] + np.bitwise_count(below)
        total = np.concatenate(([0], np.cumsum(self.extra)))
        at = np.searchsorted(self.more, offsets)
        again = np.zeros(len(offsets), bool)
        if len(self.more):
            again = self.more[np.minimum(at, len(self.more) - 1)] == offsets
        return ones.astype(np.int64) + total[at], again


_BITMAP = "g string, bucket bigint, n bigint, code binary"


def _bitmap_rows(rows: list[tuple[str, int, np.ndarray]]) -> pa.RecordBatch:
    g, bucket, counts = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(g, pa.string()),
            pa.array(bucket, pa.int64()),
            pa.array([int(c.sum()) for c in counts], pa.int64()),
            pa.array([pack(c) for c in counts], pa.binary()),
        ],
        names=["g", "bucket", "n", "code"],
    )


def _partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of what one task holds."""
    held: dict[tuple[str, int], list[np.ndarray]] = {}
    n = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (g, bucket), parts in held.items():
            counts = np.bincount(np.concatenate(parts), minlength=_KEYS).astype(np.int64)
            yield _bitmap_rows([(g, bucket, counts)])

    for batch in batches:
        names = batch.column(0).dictionary_encode()
        codes, bucket, offset = (np.asarray(x) for x in (names.indices, batch.column(1), batch.column(2)))
        order = np.lexsort((bucket, codes))
        edges = np.flatnonzero(np.diff(codes[order], prepend=-1) | np.diff(bucket[order], prepend=0))
        for at in np.split(order, edges[edges > 0]):
            if len(at):
                group = names.dictionary[int(codes[at[0]])].as_py(), int(bucket[at[0]])
                held.setdefault(group, []).append(offset[at].astype(np.uint16))
        n += batch.num_rows
        if n > HELD:
            yield from out()
            held.clear()
            n = 0
    yield from out()


def _merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in sorted_groups(batches, 2):
        counts = np.zeros(_KEYS, np.int64)
        for code in rows.column("code"):
            Bitmap(code.as_py()).add_to(counts)
        yield _bitmap_rows([(rows.column("g")[0].as_py(), rows.column("bucket")[0].as_py(), counts)])


_PLACED = "g string, key bigint, leaf binary, claimed binary, pos bigint, total bigint, tied boolean"


def _ranked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rank queries: each group is a bitmap, and after it the rows whose keys it holds."""
    bitmap, before, total = None, 0, 0
    for batch in batches:
        is_row = np.asarray(batch.column("row").cast(pa.int8())).astype(bool)
        offset = np.asarray(batch.column("offset").fill_null(0))
        edges = [0, *np.flatnonzero(~is_row).tolist(), batch.num_rows]
        for begin, end in zip(edges[:-1], edges[1:], strict=True):
            if begin < end and not is_row[begin]:
                bitmap = Bitmap(batch.column("code")[begin].as_py())
                before, total = (batch.column(c)[begin].as_py() for c in ("before", "total"))
                begin += 1
            if begin < end:
                rank, tied = bitmap.rank(offset[begin:end])
                kept = [batch.column(c).slice(begin, end - begin) for c in ("g", "key", "leaf", "claimed")]
                made = [pa.array(before + rank), pa.array(np.full(end - begin, total)), pa.array(tied)]
                yield pa.RecordBatch.from_arrays([*kept, *made], names=["g", "key", "leaf", "claimed", "pos", "total", "tied"])


def coordinates(rows: DataFrame) -> DataFrame:
    """Rows (g, key, leaf, claimed) with `pos`, the leaves of their group before them, `n` of them in a
    row, and `total`, all leaves of the group. Equal rows are one."""
    whole = F.shiftright("key", _BITS)
    rows = rows.withColumn("bucket", F.coalesce(whole, F.lit(_NULL_BUCKET)))
    rows = rows.withColumn("offset", F.coalesce(F.col("key").bitwiseAND(F.lit(_KEYS - 1)), F.lit(0)).cast("int"))
    partial = rows.select("g", "bucket", "offset").mapInArrow(_partial, _BITMAP)
    bitmaps = written(map_sorted(partial, ["g", "bucket"], [], _merged, _BITMAP), "manifest-bitmaps")
    counted = bitmaps.select("g", "bucket", "n")
    before = F.sum("n").over(Window.partitionBy("g").orderBy("bucket")) - F.col("n")
    totals = counted.groupBy("g").agg(F.sum("n").alias("total"))
    index = counted.select("g", "bucket", before.alias("before")).join(totals, "g")
    # keys that repeat very often would meet in one task; at most one bitmap in HOT_LEAVES leaves is repeated
    slices = F.ceil(F.col("n") / HOT_LEAVES).cast("int")
    hot = F.broadcast(counted.where(F.col("n") > HOT_LEAVES).select("g", "bucket", slices.alias("slices")))
    rows = rows.join(hot, ["g", "bucket"], "left")
    spread = F.pmod(F.xxhash64("leaf"), F.coalesce("slices", F.lit(1))).cast("int")
    last = F.coalesce(slices, F.lit(1)) - 1
    known = bitmaps.join(index, ["g", "bucket"]).select(
        "g", "bucket", F.explode(F.sequence(F.lit(0), last)).alias("slice"), F.lit(False).alias("row"), "before", "total", "code"
    )
    asked = rows.select("g", "bucket", spread.alias("slice"), F.lit(True).alias("row"), "offset", "key", "leaf", "claimed")
    met = known.unionByName(asked, allowMissingColumns=True)
    placed = written(map_sorted(met, ["g", "bucket", "slice"], ["row"], _ranked, _PLACED), "manifest-ranks")
    single = placed.where("not tied").drop("tied").withColumn("n", F.lit(1).cast("bigint"))
    return single.unionByName(_untied(placed.where("tied")))


def _untied(rows: DataFrame) -> DataFrame:
    """Leaves of one key in order of their digests, counted by the digests' first two bytes."""
    entries = rows.groupBy("g", "key", "leaf", "claimed", "pos", "total").agg(F.count(F.lit(1)).alias("n"))
    entries = entries.withColumn("cell", F.substring("leaf", 1, 2))
    cell = ["g", "pos", "cell"]
    cells = entries.groupBy(*cell).agg(F.sum("n").alias("held"))
    before = F.sum("held").over(Window.partitionBy("g", "pos").orderBy("cell")) - F.col("held")
    cells = cells.select(*cell, before.alias("before"))
    inside = F.sum("n").over(Window.partitionBy(*cell).orderBy("leaf", "claimed")) - F.col("n")
    numbered = entries.withColumn("inside", inside).join(cells, cell)
    return numbered.select(
        "g", "key", "leaf", "claimed", (F.col("pos") + F.col("before") + F.col("inside")).alias("pos"), "total", "n"
    )


# -- levels ------------------------------------------------------------------------------------


def combined(digests: bytes) -> bytes:
    """Digest of a run of nodes, given as hex texts side by side."""
    return hashlib.sha256(digests.hex().encode()).digest()


def levels(slots: bytes, total: int) -> list[bytes]:
    """The nodes of a block level by level, its slots first; `total` nodes are on the level of the slots."""
    made, width = [slots], RUN * _DIGEST
    for _ in range(LEVELS):
        if total <= 1:
            break
        below = made[-1]
        made.append(b"".join(combined(below[i : i + width]) for i in range(0, len(below), width)))
        total = -(-total // RUN)
    return made


_BLOCK_ROW = "g string, block bigint, total bigint, slots binary, keys array<bigint>, claimed binary, top binary"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in sorted_groups(batches, 2):
        g, block, total = (rows.column(c)[0].as_py() for c in ("g", "block", "total"))
        size = min(BLOCK, total - block * BLOCK)
        at, n = (np.asarray(rows.column(c)) for c in ("at", "n"))
        if n.sum() != size:
            raise ValueError(f"{n.sum()} leaves for {size} slots")
        place = np.repeat(at - np.cumsum(n) + n, n) + np.arange(size)
        slots, keys, claimed = np.zeros((size, _DIGEST), np.uint8), np.zeros(size, np.int64), None
        leaf = b"".join(rows.column("leaf").to_pylist())
        slots[place] = np.repeat(np.frombuffer(leaf, np.uint8).reshape(-1, _DIGEST), n, axis=0)
        claims = [c if c is not None else leaf[i * _DIGEST : (i + 1) * _DIGEST] for i, c in enumerate(rows.column("claimed").to_pylist())]
        claimed = np.zeros((size, _DIGEST), np.uint8)
        claimed[place] = np.repeat(np.frombuffer(b"".join(claims), np.uint8).reshape(-1, _DIGEST), n, axis=0)
        key = flat(rows.column("key"))
        keys[place] = np.repeat(np.asarray(key.fill_null(0)), n)
        null = np.zeros(size, bool)
        null[place] = np.repeat(np.asarray(key.is_null()), n)
        made = slots.tobytes()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([g], pa.string()),
                pa.array([block], pa.int64()),
                pa.array([total], pa.int64()),
                pa.array([made], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), pa.array(keys, mask=null)),
                pa.array([claimed.tobytes()], pa.binary()),
                pa.array([levels(made, total)[-1]], pa.binary()),
            ],
            names=["g", "block", "total", "slots", "keys", "claimed", "top"],
        )


def tree(nodes: DataFrame, purpose: str) -> list[DataFrame]:
    """Blocks of nodes (g, pos, n, total, leaf, key, claimed), then blocks of those blocks' tops, and so on."""
    rounds: list[DataFrame] = []
    while True:
        first, last = F.floor(F.col("pos") / BLOCK), F.floor((F.col("pos") + F.col("n") - 1) / BLOCK)
        cut = nodes.withColumn("block", F.explode(F.sequence(first, last)))
        begin = F.greatest(F.col("pos"), F.col("block") * BLOCK)
        end = F.least(F.col("pos") + F.col("n"), (F.col("block") + 1) * BLOCK)
        slotted = cut.select(
            "g", "block", "total", (begin - F.col("block") * BLOCK).alias("at"), (end - begin).alias("n"), "leaf", "key", "claimed"
        )
        blocks = written(map_sorted(slotted, ["g", "block"], [], _blocks, _BLOCK_ROW), f"{purpose}-{len(rounds)}")
        rounds.append(blocks)
        if (blocks.agg(F.max("total")).first()[0] or 0) <= BLOCK:
            return rounds
        none = F.lit(None).cast("binary").alias("claimed")
        nodes = blocks.where(F.col("total") > BLOCK).select(
            "g",
            F.col("block").alias("pos"),
            F.lit(1).cast("bigint").alias("n"),
            F.ceil(F.col("total") / BLOCK).alias("total"),
            F.col("top").alias("leaf"),
            F.lit(None).cast("bigint").alias("key"),
            none,
        )


def roots(rounds: list[DataFrame]) -> DataFrame:
    """g and `root` of each group's tree: the top of the block that holds all that remains."""
    made = [blocks.where(F.col("total") <= BLOCK).select("g", F.col("top").alias("root")) for blocks in rounds]
    out = made[0]
    for more in made[1:]:
        out = out.unionByName(more)
    return out


# -- proofs ------------------------------------------------------------------------------------


def fold(leaf: bytes, steps: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its proof lead to. `steps` has two bytes a level: the place in the run
    and the size of the run; `siblings` the digests of the other nodes of the runs."""
    at = 0
    for i in range(0, len(steps), 2):
        place, size = steps[i] * _DIGEST, (steps[i + 1] - 1) * _DIGEST
        run = siblings[at : at + size]
        leaf, at = combined(run[:place] + leaf + run[place:]), at + size
    return leaf


def proofs_in(slots: bytes, total: int, steps: bytes, siblings: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Steps and siblings of every slot of a block, given those of the block's top."""
    width, made = RUN * _DIGEST, levels(slots, total)
    for i in range(len(slots) // _DIGEST):
        step, others, at = bytearray(), [], i
        for nodes in made[:-1]:
            first = at // RUN * width
            run, place = nodes[first : first + width], at % RUN
            step += bytes((place, len(run) // _DIGEST))
            others += (run[: place * _DIGEST], run[(place + 1) * _DIGEST :])
            at //= RUN
        yield bytes(step) + steps, b"".join((*others, siblings))


_ABOVE = "g string, block bigint, steps binary, siblings binary, subroot binary"
_PROOF = "key bigint, leaf binary, subroot binary, steps binary, siblings binary, folded_root binary"


def _paths(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every slot of a block what lies above it."""
    for batch in batches:
        for row in batch.to_pylist():
            proofs = list(proofs_in(row["slots"], row["total"], row["steps"], row["siblings"]))
            first, n = row["block"] * BLOCK, len(proofs)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([row["g"]] * n, pa.string()),
                    pa.array(range(first, first + n), pa.int64()),
                    pa.array([s for s, _ in proofs], pa.binary()),
                    pa.array([s for _, s in proofs], pa.binary()),
                    pa.array([row["subroot"]] * n, pa.binary()),
                ],
                names=["g", "block", "steps", "siblings", "subroot"],
            )


#: Leaves whose proofs leave a task together.
_TOGETHER = 512


def _proofs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            slots, total, steps, siblings, subroot, claimed = (
                batch.column(c)[i].as_py() for c in ("slots", "total", "steps", "siblings", "subroot", "claimed")
            )
            keys, out = batch.column("keys")[i].values, []
            for at, proof in enumerate(proofs_in(slots, total, steps, siblings)):
                here = slice(at * _DIGEST, (at + 1) * _DIGEST)
                out.append((slots[here], subroot, *proof, fold(claimed[here], *proof)))
                if len(out) == _TOGETHER or at + 1 == len(keys):
                    columns = [keys.slice(at + 1 - len(out), len(out))]
                    columns += [pa.array(x, pa.binary()) for x in zip(*out, strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=["key", "leaf", "subroot", "steps", "siblings", "folded_root"]
                    )
                    out = []


def _above(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The blocks of the first round with what lies above them; `tops` says it of each group's root."""
    above = tops.withColumn("block", F.lit(0).cast("bigint"))
    for i, blocks in reversed(list(enumerate(rounds))):
        joined = blocks.join(above, ["g", "block"])
        if i == 0:
            return joined
        paths = joined.select("g", "block", "total", "slots", "steps", "siblings", "subroot").mapInArrow(_paths, _ABOVE)
        here = tops.withColumn("block", F.lit(0).cast("bigint"))
        done = here.join(blocks.where(F.col("total") <= BLOCK).select("g"), "g", "left_anti")
        above = written(paths.unionByName(done), f"manifest-above-{i}")
    raise AssertionError("no rounds")


def numbered(groups: DataFrame) -> DataFrame:
    """Adds `pos`, the place of g among all, and `total`; groups are dealt by ranges of g."""
    parts = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartitionByRange(parts, "g").sortWithinPartitions("g").withColumn("id", F.monotonically_increasing_id())
    dealt = written(dealt, "manifest-groups")
    part = F.shiftright("id", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # at most a row a partition
    before = F.sum("n").over(Window.orderBy("part")) - F.col("n")
    starts = F.broadcast(sizes.select("part", before.alias("before")))
    place = F.col("before") + F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    made = dealt.withColumn("part", part).join(starts, "part").withColumn("pos", place)
    return made.withColumn("total", F.lit(dealt.count()).cast("bigint")).drop("part", "id", "before")


def proven(leaves: DataFrame) -> DataFrame:
    """The manifest's proofs of rows (g, key, leaf, claimed): key, leaf, subroot, root, `steps` and
    `siblings` (see `fold`), and `folded_root`, where the claimed digest (null: the leaf) leads with them."""
    rounds = tree(coordinates(written(leaves, "manifest-leaves")), "manifest-blocks")
    order = written(numbered(roots(rounds)), "manifest-subroots")
    none = F.lit(None)
    nodes = order.select(
        F.lit("").alias("g"), "pos", F.lit(1).cast("bigint").alias("n"), "total", F.col("root").alias("leaf"),
        none.cast("bigint").alias("key"), none.cast("binary").alias("claimed"),
    )
    upper = tree(nodes, "manifest-upper")
    root = roots(upper).first()
    empty = F.lit(b"")
    spark = leaves.sparkSession
    start = spark.range(1).select(F.lit("").alias("g"), empty.alias("steps"), empty.alias("siblings"), empty.alias("subroot"))
    paths = _above(upper, start).select("g", "block", "total", "slots", "steps", "siblings", "subroot").mapInArrow(_paths, _ABOVE)
    tops = order.join(paths.select(F.col("block").alias("pos"), "steps", "siblings"), "pos")
    tops = written(tops.select("g", "steps", "siblings", F.col("root").alias("subroot")), "manifest-tops")
    joined = _above(rounds, tops).select("slots", "total", "steps", "siblings", "subroot", "claimed", "keys")
    made = joined.mapInArrow(_proofs, _PROOF)
    return made.withColumn("root", F.lit(root.root if root else None).cast("binary"))


def leaves_of(df: DataFrame, fields: list[str], claims: list[Column], key: str, group: str) -> DataFrame:
    """g, key, leaf (digest of the fields) and claimed (that of `claims`, null where it is the same)."""
    leaf, claimed = digest_of([F.col(f) for f in fields]), digest_of(claims)
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    made = df.select(g.alias("g"), F.col(key).cast("bigint").alias("key"), leaf.alias("leaf"), claimed.alias("claimed"))
    return made.withColumn("claimed", F.nullif(F.col("claimed"), F.col("leaf")))
