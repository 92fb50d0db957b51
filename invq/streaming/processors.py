"""Stateful processors in event time: rows are held until the watermark has passed them, then decided in order.

The order in which files or micro-batches bring rows therefore makes no difference, as long as a row comes before the
watermark passes it. One that comes later is given out as it is, with its time in ``late_at_us``, and
takes no part in any decision.

Held rows lie in state by key: a few in one value, what is beyond that by bucket of time. One call decides a few rows and one
bucket of one key at a time, so neither a hot key's rows nor a micro-batch are ever in memory together. What a processor remembers besides is one value a key, cleared once it can no longer matter.
Where keys are few, their rows come packed by the tasks before the shuffle, many in one value, and are handled as Arrow tables.
Modules that import nothing of this package can be unpickled wherever a Python worker runs.
"""

from __future__ import annotations

import bisect
import itertools
import pickle
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

LATE = "late_at_us"


def _bytes(rows: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def _together(tables: Sequence[pa.Table]) -> pa.Table:
    return pa.concat_tables(tables, promote_options="permissive")


def _beside(rows: pa.Table, **columns: np.ndarray) -> pa.Table:
    for name, values in columns.items():
        rows = rows.append_column(name, pa.array(values))
    return rows


def _groups(rows: pa.Table, names: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers, those with the same values (null is one) one after the other, and where each group of them begins."""
    numbered = rows.select(names).append_column("row number", pa.array(np.arange(rows.num_rows)))
    lists = numbered.group_by(list(names), use_threads=False).aggregate([("row number", "list")])["row number_list"].combine_chunks()
    lengths = lists.value_lengths().to_numpy()
    return lists.flatten().to_numpy(), np.cumsum(lengths) - lengths


def packed(batches: Iterator[pa.RecordBatch], place: Sequence[str], most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """A task's rows (``at_us`` is never null) some at a time, those of a place in one value: ``packed`` has the distinct
    rows, each with all its times in order. After those, a row without a place that has their latest time in ``until_us``."""
    held, count = [], 0
    for batch in batches:
        held.append(batch)
        count += batch.num_rows
        if count >= most:
            yield _pack(pa.Table.from_batches(held), place)
            held, count = [], 0
    if count:
        yield _pack(pa.Table.from_batches(held), place)


def _pack(rows: pa.Table, place: Sequence[str]) -> pa.RecordBatch:
    alike = [name for name in rows.column_names if name != "at_us"]
    sets = rows.sort_by("at_us").group_by(alike, use_threads=False).aggregate([("at_us", "list")])
    sets = sets.rename_columns([{"at_us_list": "at_us"}.get(name, name) for name in sets.column_names])
    order, starts = _groups(sets, place)
    inside = sets.select([name for name in rows.column_names if name not in place]).take(order).combine_chunks()
    ends = [*starts[1:].tolist(), len(order)]
    values = [_bytes(inside.slice(start, end - start)) for start, end in zip(starts.tolist(), ends, strict=True)]
    places = sets.select(place).take(order[starts])
    columns = [pa.concat_arrays([*column.chunks, pa.nulls(1, column.type)]) for column in places.columns]
    until = pa.array([*[None] * len(values), pc.max(rows["at_us"]).as_py()], pa.int64())
    return pa.record_batch([*columns, until, pa.array([*values, None], pa.binary())], [*place, "until_us", "packed"])


def _passes(at_us: int) -> int:
    """The watermark, in milliseconds, at which a time has been passed."""
    return -(-at_us // 1000) + 1


class PackedProcessor(StatefulProcessor):
    """Hands on a key's rows a bucket of time at a time, for keys that are few and have very many rows each.

    Rows come as `packed` leaves them. Those that can still matter are gathered over a micro-batch and held as Arrow
    tables, a lot for each bucket, so that neither rows nor calls to the store are handled one by one.
    """

    #: Names and types of what is remembered of a key.
    MEMO = ""
    #: Rows that are gathered before they are held, and rows of a lot.
    MANY, LOT = 1 << 19, 1 << 16

    def __init__(self, keys: Sequence[str], shown: Sequence[str], results: Sequence[str], bucket: int):
        self.keys, self.results, self.bucket = list(keys), list(results), max(1, bucket)
        #: Results that late rows show.
        self.shown = list(shown)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket bigint, part bigint", "rows binary")
        self.memo = handle.getValueState("memo", self.MEMO)

    def decide(self, key, rows: pa.Table) -> Iterator[Row]:
        """Results of the next rows, which are distinct, in no order and later than all before."""
        raise NotImplementedError

    def remembered(self, nothing: tuple) -> tuple:
        return self.memo.get() if self.memo.exists() else nothing

    def row(self, key, **values) -> Row:
        """A result row of a key; columns that are not given are null."""
        named = dict(zip(self.keys, key, strict=True))
        for name in [*self.results, LATE]:
            named[name] = values.get(name)
        return Row(**named)

    def _once(self, tables: Sequence[pa.Table]) -> pa.Table:
        """Each row once, at the earliest of its times."""
        rows = _together(tables)
        names = rows.column_names
        alike = [name for name in names if name != "at_us"]
        once = rows.group_by(alike, use_threads=False).aggregate([("at_us", "min")])
        return once.rename_columns([{"at_us_min": "at_us"}.get(name, name) for name in once.column_names]).select(names)

    def _put(self, rows: pa.Table) -> None:
        """Holds rows by bucket, each lot under a number of its own so that nothing is read or written again."""
        at = rows["at_us"].to_numpy()
        order = np.argsort(at, kind="stable")
        buckets, starts = np.unique(at[order] // self.bucket, return_index=True)
        rows, ends = rows.take(order).combine_chunks(), [*starts[1:].tolist(), len(order)]
        for bucket, start, end in zip(buckets.tolist(), starts.tolist(), ends, strict=True):
            for first in range(start, end, self.LOT):
                last = min(end, first + self.LOT)
                lot = _bytes(rows.slice(first, last - first))
                self.held.updateValue((bucket, uuid.uuid4().int >> 66), (lot,))
            self.handle.registerTimer(int(at[order[end - 1]]) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, kept, count = timerValues.getCurrentWatermarkInMs(), [], 0
        for row in rows:
            pack = _table(row["packed"])
            lists = pack["at_us"].combine_chunks()
            at, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            firsts = np.cumsum(lengths) - lengths
            late = at // 1000 < watermark
            if late.any():
                whose = np.repeat(np.arange(len(lengths)), lengths)
                shown = pack.select(self.shown).take(whose[late]).to_pylist()
                for known, at_us in zip(shown, at[late].tolist(), strict=True):
                    yield self.row(key, **known, **{LATE: at_us})
                # times are in order, so that the first one in time is the one after those that are late
                gone = np.add.reduceat(late.astype(np.int64), firsts)
                pack, firsts = pack.filter(pa.array(gone < lengths)), (firsts + gone)[gone < lengths]
            if not len(firsts):
                continue
            kept.append(_beside(pack.drop_columns("at_us"), at_us=at[firsts]))
            count += len(firsts)
            if count >= self.MANY:
                kept = [self._once(kept)]
                count = kept[0].num_rows
                if count >= self.MANY // 2:
                    self._put(kept[0])
                    kept, count = [], 0
        if kept:
            self._put(self._once(kept))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        if not self.held.exists():
            return
        parts = sorted(tuple(at) for at in self.held.keys())
        for bucket, lots in itertools.groupby(parts, key=lambda at: at[0]):
            if bucket * self.bucket // 1000 >= watermark:
                break
            lots = list(lots)
            rows = self._once([_table(bytes(self.held.getValue(at)[0])) for at in lots])
            ready = rows["at_us"].to_numpy() // 1000 < watermark
            for at in lots if ready.any() else []:
                self.held.removeKey(at)
            if ready.any() and not ready.all():
                self._put(rows.filter(pa.array(~ready)))
            if ready.any():
                yield from self.decide(key, rows.filter(pa.array(ready)))

    def close(self) -> None:
        pass


class KeyedProcessor(StatefulProcessor):
    """Hands on a key's rows in order of time and of the order columns, for keys that are many and have few rows each.

    Rows are plain tuples, time first. Up to `FEW` of a key lie together in one value, so that a key costs a
    handful of calls to the store; what is beyond that lies by buckets of time, of which one is read at a time.
    """

    #: Names and types of what is remembered of a key.
    MEMO = ""
    #: Rows of a key that are held and decided together.
    FEW = 4096

    def __init__(self, keys: Sequence[str], order: Sequence[str], more: Sequence[str], results: Sequence[str], bucket: int):
        self.keys, self.order, self.results, self.bucket = list(keys), list(order), list(results), max(1, bucket)
        self.columns = ["at_us", *order, *more]
        #: Results that late rows show.
        self.shown = [name for name in order if name in results]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.near = handle.getValueState("near", "rows binary")
        self.held = handle.getMapState("held", "bucket bigint, part bigint", "rows binary")
        self.memo = handle.getValueState("memo", self.MEMO)

    def wanted(self, memo: tuple | None, rows: list[tuple]) -> list[tuple]:
        """The rows that can still matter."""
        return rows

    def decide(self, key, memo: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        """What is remembered after the next rows, which are in order and later than all before, and their results."""
        raise NotImplementedError

    def passed(self, key, memo: tuple | None, watermark: int, idle: bool) -> tuple[tuple | None, list[Row]]:
        """The same after time itself, once all rows before the watermark are decided; ``idle`` if no rows are held."""
        return memo, []

    def reminders(self, memo: tuple) -> list[int]:
        """Times that the key is to be called at."""
        return []

    def row(self, key, **values) -> Row:
        """A result row of a key; columns that are not given are null."""
        named = dict(zip(self.keys, key, strict=True))
        for name in [*self.results, LATE]:
            named[name] = values.get(name)
        return Row(**named)

    def _place(self, row: tuple):
        """Sort key: time and order columns, nulls last."""
        return row[0], *((v is None, v) for v in row[1 : 1 + len(self.order)])

    def _put(self, rows: list[tuple]) -> None:
        """Holds rows by bucket, each lot under a number of its own so that nothing is read or written again."""
        buckets: dict[int, list[tuple]] = {}
        for row in rows:
            buckets.setdefault(row[0] // self.bucket, []).append(row)
        for bucket, lot in buckets.items():
            self.held.updateValue((bucket, uuid.uuid4().int >> 66), (pickle.dumps(lot),))
            self.handle.registerTimer(max(row[0] for row in lot) // 1000 + 1)

    def _hold(self, fresh: list[tuple]) -> None:
        fresh = self.wanted(self.memo.get(), fresh)
        if not fresh:
            return
        known = self.near.get()
        near = [*(pickle.loads(bytes(known[0])) if known is not None else []), *fresh]
        if len(near) <= self.FEW:
            self.near.update((pickle.dumps(near),))
            self._call(fresh)
        else:
            self._put(fresh)

    def _call(self, rows: list[tuple]) -> None:
        """Asks for a call once the rows of the first bucket have been passed."""
        first = min(row[0] for row in rows) // self.bucket
        self.handle.registerTimer(max(row[0] for row in rows if row[0] // self.bucket == first) // 1000 + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        watermark, fresh = timerValues.getCurrentWatermarkInMs(), []
        for row in rows:
            at = row["at_us"]
            if at is None:
                continue
            if at // 1000 < watermark:
                yield self.row(key, **{name: row[name] for name in self.shown}, **{LATE: at})
                continue
            fresh.append(tuple(row[name] for name in self.columns))
            if len(fresh) == self.FEW:
                self._hold(fresh)
                fresh = []
        if fresh:
            self._hold(fresh)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        before = memo = self._remembered()
        known = self.near.get()
        near = pickle.loads(bytes(known[0])) if known is not None else []
        ready = sorted((row for row in near if row[0] // 1000 < watermark), key=self._place)
        later = [row for row in near if row[0] // 1000 >= watermark]
        lots: dict[int, list[tuple]] = {}
        if self.held.exists():
            for bucket, part in [tuple(at) for at in self.held.keys()]:
                lots.setdefault(bucket, []).append((bucket, part))
        kept = len(lots)
        for bucket in sorted(lots):
            if bucket * self.bucket // 1000 >= watermark:
                break
            lot = [row for at in lots[bucket] for row in pickle.loads(bytes(self.held.getValue(at)[0]))]
            for at in lots[bucket]:
                self.held.removeKey(at)
            rest = [row for row in lot if row[0] // 1000 >= watermark]
            if rest:
                self._put(rest)
            else:
                kept -= 1
            end = bisect.bisect_left(ready, (bucket + 1) * self.bucket, key=lambda row: row[0])
            now = sorted([*ready[:end], *(row for row in lot if row[0] // 1000 < watermark)], key=self._place)
            ready = ready[end:]
            if now:
                memo, found = self.decide(key, memo, now)
                yield from found
        if ready:
            memo, found = self.decide(key, memo, ready)
            yield from found
        if later and len(later) < len(near):
            self.near.update((pickle.dumps(later),))
            self._call(later)
        elif near and not later:
            self.near.clear()
        memo, found = self.passed(key, memo, watermark, not kept and not later)
        yield from found
        if memo is None:
            if before is not None:
                self.memo.clear()
        elif memo != before:
            self.memo.update(memo)
            for at_us in self.reminders(memo):
                if _passes(at_us) > watermark:
                    self.handle.registerTimer(_passes(at_us))

    def _remembered(self) -> tuple | None:
        memo = self.memo.get()
        return None if memo is None else tuple(memo)

    def close(self) -> None:
        pass


class SustainedProcessor(KeyedProcessor):
    """Emits a key at the first observation at or past the grace, once; with a time to live it is forgotten,
    and may come again, when it has not been present for that long."""

    # since is -1 while absent
    MEMO = "since bigint, seen bigint, captured boolean"

    def __init__(self, keys: Sequence[str], order: Sequence[str], grace: int, ttl: int | None):
        super().__init__(keys, order, ["present", "breaks"], ["since_us", "at_us", *order], grace)
        self.grace, self.ttl = grace, ttl

    def wanted(self, memo: tuple | None, rows: list[tuple]) -> list[tuple]:
        return [] if memo is not None and memo[2] and self.ttl is None else rows

    def decide(self, key, memo: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        (since, seen, captured), found = memo or (-1, -1, False), []
        for at, *order, present, breaks in rows:
            if self.ttl is not None and captured and at - seen >= self.ttl:
                since, captured = -1, False
            if not present:
                since = -1
                continue
            since, seen = at if breaks or since < 0 else since, at
            if not captured and at - since >= self.grace:
                captured = True
                found.append(self.row(key, since_us=since, at_us=at, **dict(zip(self.order, order, strict=True))))
        return (None if since < 0 and not captured else (since, seen, captured)), found

    def reminders(self, memo: tuple) -> list[int]:
        return [] if self.ttl is None else [memo[1] + self.ttl]

    def passed(self, key, memo: tuple | None, watermark: int, idle: bool) -> tuple[tuple | None, list[Row]]:
        if self.ttl is not None and memo is not None and memo[2] and idle and _passes(memo[1] + self.ttl) <= watermark:
            return None, []
        return memo, []


_NEVER = np.iinfo(np.int64).max // 2


class ThrottleProcessor(KeyedProcessor):
    """Lets a row pass when the last that passed is at least the interval ago."""

    MEMO = "passed bigint"

    def __init__(self, keys: Sequence[str], order: Sequence[str], interval: int):
        super().__init__(keys, order, [], ["at_us", *order], interval)
        self.interval = interval

    def decide(self, key, memo: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        last, found = None if memo is None else memo[0], []
        for row in rows:
            if last is None or row[0] >= last + self.interval:
                last = row[0]
                found.append(self.row(key, **dict(zip(self.columns, row, strict=True))))
        return (None if last is None else (last,)), found

    def reminders(self, memo: tuple) -> list[int]:
        return [memo[0] + self.interval]

    def passed(self, key, memo: tuple | None, watermark: int, idle: bool) -> tuple[tuple | None, list[Row]]:
        if memo is not None and _passes(memo[0] + self.interval) <= watermark:
            return None, []  # whatever comes now passes
        return memo, []


class DeadlineProcessor(KeyedProcessor):
    """Emits a key's first outcome before its deadline, or the overdue one once the watermark has
    passed that. The deadline counts from the key's first row in time, whichever micro-batch brings it.

    Rows have ``outcome`` (null while undecided) and ``detail`` (that of the last undecided one is given
    when the deadline passes). A key is remembered as decided until ``keep`` after its deadline.
    """

    MEMO = "start bigint, done boolean, detail string"

    def __init__(self, keys: Sequence[str], order: Sequence[str], timeout: int, overdue: str, keep: int):
        super().__init__(keys, order, ["outcome", "detail"], ["outcome", "elapsed_us", "detail"], timeout)
        self.timeout, self.overdue, self.keep = timeout, overdue, keep

    def wanted(self, memo: tuple | None, rows: list[tuple]) -> list[tuple]:
        if memo is None:
            return rows
        return [] if memo[1] else [row for row in rows if row[0] < memo[0] + self.timeout]

    def decide(self, key, memo: tuple | None, rows: list[tuple]) -> tuple[tuple | None, list[Row]]:
        (start, done, last), found = memo or (rows[0][0], False, None), []
        for at, *_, outcome, detail in rows:
            if done or at >= start + self.timeout:
                break
            if outcome is not None:
                done, last = True, None
                found.append(self.row(key, outcome=outcome, elapsed_us=at - start))
            else:
                last = detail
        return (start, done, last), found

    def reminders(self, memo: tuple) -> list[int]:
        return [memo[0] + self.timeout, memo[0] + self.timeout + self.keep]

    def passed(self, key, memo: tuple | None, watermark: int, idle: bool) -> tuple[tuple | None, list[Row]]:
        if memo is None:
            return memo, []
        (start, done, detail), found = memo, []
        if not done and _passes(start + self.timeout) <= watermark:
            done = True
            found.append(self.row(key, outcome=self.overdue, detail=detail))
            memo = (start, True, None)
        return (None if done and _passes(start + self.timeout + self.keep) <= watermark else memo), found


class PollsProcessor(PackedProcessor):
    """Lasting conditions out of full listings, for one slice of a scope's keys.

    Rows are polls (``poll_ok`` is not null) and sightings of keys in them. Polls are numbered as they pass. A
    key's clock runs while it is in every poll; one that the next poll does not list, or that a failed poll
    follows, is taken out of the open ones, so state holds the keys of the last poll and those captured.
    """

    MEMO = "number bigint, seq bigint, at_us bigint, ok boolean, open binary, captured binary"

    def __init__(self, scope: Sequence[str], keys: Sequence[str], grace: int, ignore_failed: bool):
        super().__init__([*scope, "slice"], keys, [*keys, "since_us", "at_us"], grace)
        self.names, self.grace, self.ignore_failed = list(keys), grace, ignore_failed

    def _numbered(self, polls: pa.Table, number: int, current: tuple) -> tuple[list[tuple], int, tuple]:
        """seq, at_us, ok and number of the polls in these rows, that of before first; a poll has failed if a row says so."""
        said: dict[int, tuple] = {}
        seqs = pc.cast(polls["poll_seq"], pa.int64())
        for seq, at_us, ok in zip(*(column.to_pylist() for column in (seqs, polls["at_us"], polls["poll_ok"])), strict=True):
            if seq is not None:
                earliest, all_ok = said.get(seq, (at_us, True))
                said[seq] = min(earliest, at_us), all_ok and ok
        known = [] if current[0] is None else [(*current, number)]
        for seq, (at_us, ok) in sorted(said.items()):
            if (current[0] is None or seq > current[0]) and (ok or not self.ignore_failed):
                number, current = number + 1, (seq, at_us, ok)
                known.append((*current, number))
        return known, number, current

    def decide(self, key, rows: pa.Table) -> Iterator[Row]:
        number, seq, at_us, ok, packed_open, packed_captured = self.remembered((0, None, None, None, None, None))
        is_poll = pc.is_valid(rows["poll_ok"])
        times, number, current = self._numbered(rows.filter(is_poll), number, (seq, at_us, ok))
        if not times:
            return
        good = np.array([(seq, nr, at) for seq, at, ok, nr in times if ok], np.int64).reshape(-1, 3)
        seen = rows.filter(pc.and_(pc.invert(is_poll), pc.is_valid(rows["poll_seq"])))
        seqs = pc.cast(seen["poll_seq"], pa.int64()).to_numpy()
        place = np.searchsorted(good[:, 0], seqs)
        known = place < len(good)
        known[known] = good[place[known], 0] == seqs[known]
        seen, (_, nr, at) = seen.filter(pa.array(known)).select(self.names), good[place[known]].T
        seen = _beside(seen, number=nr, at_us=at, since_us=np.full(len(at), _NEVER))
        if packed_open:
            seen = _together([_table(bytes(packed_open)), seen])
        captured = [_table(bytes(packed_captured))] if packed_captured else []
        latest = None
        if seen.num_rows:
            order, starts = _groups(_together([seen.select(self.names), *captured]), self.names)
            codes = np.empty(len(order), np.int64)
            codes[order] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(order)))
            gone = np.zeros(len(starts), bool)
            gone[codes[seen.num_rows :]] = True
            row, code, nr, at, since = self._clocked(seen, codes[: seen.num_rows])
            due = np.flatnonzero((at - since >= self.grace) & ~gone[code])
            due = due[np.unique(code[due], return_index=True)[1]]
            if len(due):
                names = seen.select(self.names).take(row[due])
                for values, since_us, at_us in zip(names.to_pylist(), since[due].tolist(), at[due].tolist(), strict=True):
                    yield self.row(key, **values, since_us=since_us, at_us=at_us)
                captured.append(names)
            # the last poll may have more rows to come, so a key of the one before it is not gone yet
            last = np.append(code[1:] != code[:-1], True) & (nr >= number - 1)
            if last.any():
                names = seen.select(self.names).take(row[last])
                latest = _bytes(_beside(names, number=nr[last], at_us=at[last], since_us=since[last]))
        self.memo.update((number, *current, latest, _bytes(_together(captured)) if captured else None))

    def _clocked(self, seen: pa.Table, codes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, code, number, at_us and since_us of each key in each poll, in order of code and number."""
        nr, at, since = (seen[name].to_numpy() for name in ("number", "at_us", "since_us"))
        # a key that is open and seen again in the same poll is one row, the one that knows since when
        row = np.lexsort((since, nr, codes))
        code, nr = codes[row], nr[row]
        once = np.append(True, (code[1:] != code[:-1]) | (nr[1:] != nr[:-1]))
        row, code, nr = row[once], code[once], nr[once]
        at, since = at[row], np.minimum(since, at)[row]
        starts = np.append(True, (code[1:] != code[:-1]) | (nr[1:] != nr[:-1] + 1))
        return row, code, nr, at, since[starts][np.cumsum(starts) - 1]
