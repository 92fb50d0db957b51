"""Sharding by balanced label propagation: linked documents move together, sizes stay even.

Documents with equal texts are linked. Sets that fill more than an eighth of a shard are at most some sixteen
a shard; they are placed whole on the driver, the largest first, each where it fits best; one that is larger
than a shard runs on into the next ones. Smaller sets are propagated: every document starts in a shard by a
hash of its key, weighted by the room that is left. In each round a linked set looks where most of its
documents are and the others ask to move there; how many may go from shard to shard is set from the matrix of
those wishes (shards by shards, so of fixed size) under each shard's capacity, and whole bundles (documents of a
set that are in one shard) go while their quota lasts. After the rounds a set goes where most of it is.

At the end the linked documents are numbered in order of shard and set, from the first number of their shard
on; single documents get the numbers between. The numbers are cut into equal ranges, which makes counts at
most one apart (law `rows`). A set that fits a shard is split only where a cut falls into it, so at most one
set a cut, and none while single documents fill the gaps. Tasks that number a large set share it by a salt that
has no part in where it goes.

Defined results: a null text weighs 16 bytes, has the checksum of no bytes, and is linked to other null
texts; rows that are equal in key and text are interchangeable; no rows give no shards.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from .common import written

SHARDS = 40
ROUNDS = 6
#: Share by which a shard may be fuller than the mean while documents move.
SLACK = 0.1
#: A set of more than an eighth of a shard is placed on the driver; tasks number it in parts of so many rows.
PARTS_A_SHARD, PART_ROWS = 8, 100_000
#: Rows that one task numbers.
NUMBERED_ROWS = 20_000


def _quotas(wishes: np.ndarray, load: np.ndarray, capacity: float) -> np.ndarray:
    """Share of each wish (from, to) that may be granted so that no shard ends above its capacity."""
    share = np.ones_like(wishes)
    for _ in range(50):
        moved = wishes * share
        after = load + moved.sum(0) - moved.sum(1)
        over = np.maximum(after - capacity, 0)
        if over.max() < 0.5:
            break
        into = np.maximum(moved.sum(0), 1e-9)
        share *= np.clip(1 - over / into, 0, 1)
    return share


def _draw(*columns) -> Column:
    """A number from 0 to 1 by hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1_000_003)) / F.lit(1_000_003.0)


def packed(sets: list[tuple[str, int]], sizes: np.ndarray) -> tuple[dict[str, int], np.ndarray]:
    """The shard in which each set (name, copies) begins, and the room left in each shard."""
    room, places = sizes.copy(), {}
    for name, copies in sorted(sets, key=lambda s: (-s[1], s[0])):
        fits = np.flatnonzero(room >= copies)
        empty = np.flatnonzero((room == sizes) & (sizes > 0))
        if len(fits):
            at = fits[room[fits].argmin()]
        else:
            at = empty[0] if len(empty) else room.argmax()
        places[name] = int(at)
        for s in (*range(at, len(room)), *range(at - 1, -1, -1)):
            taken = min(room[s], copies)
            room[s] -= taken
            copies -= taken
    return places, room


def propagated(
    bundles: DataFrame, load: np.ndarray, capacity: np.ndarray, n_shards: int, rounds: int = ROUNDS
) -> DataFrame:
    """`linked` and `to`, where most of each set of `bundles` (linked, home, n) is after some rounds of moves."""
    now = bundles.withColumn("shard", F.col("home"))
    current = load
    most = F.max_by("shard", F.struct(F.col("n"), F.xxhash64("linked", "shard")))
    for i in range(rounds):
        spread = now.groupBy("linked", "shard").agg(F.sum("n").alias("n"))
        wish = spread.groupBy("linked").agg(most.alias("to"))
        asked = written(now.join(wish, "linked"), f"wishes-{i}")
        wishes = np.zeros((n_shards, n_shards))
        for row in asked.groupBy("shard", "to").agg(F.sum("n").alias("n")).where("shard <> to").collect():
            wishes[row.shard, row.to] = row.n
        if not wishes.any():
            break
        share = _quotas(wishes, current, capacity)
        granted = F.get(F.array(*map(F.lit, share.reshape(-1).tolist())), F.col("shard") * n_shards + F.col("to"))
        moves = (F.col("shard") != F.col("to")) & (_draw("linked", "shard", F.lit(i)) < granted)
        now = written(
            asked.select("linked", "home", "n", F.when(moves, F.col("to")).otherwise(F.col("shard")).alias("shard")),
            f"shards-{i}",
        )
        current = load.copy()  # all but the bundles that moved are at home
        for row in now.groupBy("home", "shard").agg(F.sum("n").alias("n")).collect():
            current[row.home] -= row.n
            current[row.shard] += row.n
    return now.groupBy("linked", "shard").agg(F.sum("n").alias("n")).groupBy("linked").agg(most.alias("to"))


def _laid_out(held: list[int], firsts: list[int], n: int) -> list[int]:
    """First number of each shard's linked rows: that of the shard, unless rows of others push it on or back."""
    starts, end, after = [], 0, sum(held)
    for rows, first in zip(held, firsts, strict=True):
        starts.append(min(max(first, end), n - after))
        end, after = starts[-1] + rows, after - rows
    return starts


def _numbered(rows: DataFrame, firsts: list[int], n: int, n_shards: int) -> DataFrame:
    """Adds `rank`, gapless from 0, counted in small tasks.

    `place` is a shard for linked rows, n_shards + home for single ones, which take the numbers between.
    """
    buckets = max(1, -(-n // (n_shards * NUMBERED_ROWS)))
    by_set = F.pmod(F.xxhash64("linked"), F.lit(buckets))
    rows = rows.withColumn("bucket", F.when(F.col("salt") < 0, by_set).otherwise(F.col("linked")))
    cell = ["place", "bucket", "salt"]
    cells = rows.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"))
    within = Window.partitionBy("place").orderBy(F.col("salt") < 0, "bucket", "salt")
    cells = cells.withColumn("before", F.sum("n").over(within) - F.col("n"))
    sizes = {r.place: r.n for r in rows.groupBy("place").agg(F.count(F.lit(1)).alias("n")).collect()}
    held, single = ([sizes.get(k + s, 0) for s in range(n_shards)] for k in (0, n_shards))
    starts = _laid_out(held, firsts, n)
    linked_before = np.cumsum([0, *held]).tolist()
    singles_before = [start - sum_ for start, sum_ in zip(starts, linked_before, strict=False)]
    starts += np.cumsum([0, *single]).tolist()[:-1]
    start = F.get(_bigints(starts), F.col("place"))
    cells = cells.select(*cell, (F.col("before") + start).alias("first"))
    inside = Window.partitionBy(*cell).orderBy("linked", "key", "text_crc32", "size")
    ranked = rows.withColumn("nth", F.row_number().over(inside)).join(cells, cell)
    ranked = ranked.withColumn("nth", F.col("first") + F.col("nth") - 1)
    passed = F.size(F.filter(_bigints(singles_before), lambda x: x <= F.col("nth")))
    pushed = F.col("nth") + F.get(_bigints(linked_before), passed)
    return ranked.withColumn("rank", F.when(F.col("place") < n_shards, F.col("nth")).otherwise(pushed))


def _bigints(values: list[int]) -> Column:
    return F.array(*[F.lit(int(x)).cast("bigint") for x in values])


def sharded(df: DataFrame, n_shards: int = SHARDS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, size, text_crc32, law, shard, slot and grown_shard of every row."""
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 16).cast("bigint").alias("size"),
        F.crc32(body).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.md5(F.col(text))).otherwise("null").alias("same"),
    )
    narrow = written(narrow, "shard-rows")
    n = narrow.count()
    few, more = divmod(n, n_shards)
    large = more * (few + 1)
    sizes = np.array([few + (s < more) for s in range(n_shards)])
    counted = narrow.groupBy("same").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    sets = written(counted, "shard-sets")
    whole = sets.where(F.col("copies") * PARTS_A_SHARD > few).collect()
    places, room = packed([(r.same, r.copies) for r in whole], sizes)
    table = df.sparkSession.createDataFrame(list(places.items()), "same string, fixed int")
    fixed = sets.join(F.broadcast(table), "same", "left")
    part_rows = max(1, min(PART_ROWS, n // (n_shards * PARTS_A_SHARD)))
    salt = F.pmod(F.xxhash64("key", "text_crc32"), F.ceil(F.col("copies") / part_rows))
    free = F.pmod(F.xxhash64("key", "text_crc32"), F.lit(max(1, int(room.sum()))).cast("bigint"))
    home = F.size(F.filter(_bigints(np.cumsum(room)[:-1].tolist()), lambda x: x <= free))
    placed = hot_join(narrow, fixed, ["same"], "left", counts=sets.withColumnRenamed("copies", "n")).select(
        "key",
        "size",
        "text_crc32",
        "copies",
        "fixed",
        F.xxhash64("same").alias("linked"),
        home.cast("int").alias("home"),
        F.when(F.col("fixed").isNotNull(), salt).otherwise(F.lit(-1)).cast("bigint").alias("salt"),
    )
    placed = written(placed, "shard-homes")
    small = F.col("copies").isNotNull() & F.col("fixed").isNull()
    bundles = placed.where(small).groupBy("linked", "home").agg(F.count(F.lit(1)).alias("n"))
    load = np.zeros(n_shards)
    for row in bundles.groupBy("home").agg(F.sum("n").alias("n")).collect():
        load[row.home] = row.n
    capacity = room * max(1.0, (1 + SLACK) * load.sum() / max(room.sum(), 1))
    moved = propagated(bundles, load, capacity, n_shards)
    shown = ["key", "size", "text_crc32", "linked", "salt"]
    together = placed.where(small).join(moved, "linked").select(*shown, F.col("to").alias("place"))
    others = placed.where(~small).select(*shown, F.coalesce("fixed", F.col("home") + n_shards).alias("place"))
    firsts = np.cumsum([0, *sizes]).tolist()[:-1]
    ranked = _numbered(written(together.unionByName(others), "shard-places"), firsts, n, n_shards)
    rank = F.col("rank")
    late = (rank - large) / max(few, 1)
    shard = F.when(rank < large, F.floor(rank / (few + 1))).otherwise(more + F.floor(late))
    first = F.when(shard < more, shard * (few + 1)).otherwise(large + (shard - more) * few)
    return ranked.select(
        F.col("key").alias(key),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        shard.cast("int").alias("shard"),
        (rank - first).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
