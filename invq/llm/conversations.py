"""Repair of conversations: the cheapest edits that make the roles `(s?(ua)+)?`, as one integer minimum.

Rows are kept, given the role user or assistant, or deleted, and rows without text are inserted. An edit
sequence is one integer: its high part is the cost, below it are digits of three bits, one for each edit in
order, padded with zeros at the end. The digits rise with the edits' letters (D, I, K, R), so the smaller of
two integers is the cheaper sequence and, at equal cost, the one whose letters come first; nothing else is
ever compared. How many digits are in use is where the lowest one is. The states of the shortest path are a
row and what the roles so far end with: nothing, s, u or a.

Sequences over two neighbouring stretches of a conversation join by shifts and a sum, so a stretch is a four by
four table of integers, made in a task of its own from rows without their texts; one task a conversation
only joins the tables. Stretches cover a fixed range of turns; a turn with very many rows is cut by digest. Texts move
twice: once to make equal rows one row with a count, and once in order, past a task that holds one row at a time.

Defined results: a null role or text is one space, a null turn comes before all others, a null key is a
conversation of its own. Rows of one turn come in order of the digest of role and text; equal rows are neighbours.
Turns are integers. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.skew import hot_join
from .common import looked_up, type_of, written
from .grouped import map_sorted, sorted_groups

# fixed values: what edits cost, and what a kept row that ends too early adds
COST = {"D": 3, "I": 2, "K": 0, "R": 2}
TRUNCATED = 1
_SPACE, _ENDS = " \t\n\x0b\x0c\r", (".", "!", "?")

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}
WHOLE = (START, ASSISTANT)

_BITS = 3
_DIGIT = {letter: i for i, letter in enumerate(sorted(COST), 1)}
_LETTERS = str.maketrans({str(i): letter for letter, i in _DIGIT.items()})

#: Turns of a stretch, rows of one turn that are cut into stretches of their own, and rows of the tables that are joined first.
TURNS, HEAVY, PIECE = 1024, 50_000, 256


# -- integers ----------------------------------------------------------------------------------


class Weights:
    """The least integer from each state to each state over some rows, all of `width` digits."""

    def __init__(self, width: int, table: dict[tuple[int, int], int]):
        # digits that no sequence uses go
        spare = min((_unused(w, width) for w in table.values()), default=0)
        self.width = width - spare
        self.table = {at: w >> _BITS * spare for at, w in table.items()}

    def then(self, other: Weights) -> Weights:
        width, out = self.width + other.width, {}
        mask = (1 << _BITS * other.width) - 1
        parts = {at: (w >> _BITS * other.width, w & mask) for at, w in other.table.items()}
        for (begin, middle), w in self.table.items():
            free = _BITS * _unused(w, self.width)
            w <<= _BITS * other.width
            for end in STATES:
                if (middle, end) in parts:
                    cost, digits = parts[middle, end]
                    joined = w + (cost << _BITS * width) + (digits << free)
                    out[begin, end] = min(joined, out.get((begin, end), joined))
        return Weights(width, out)


def _unused(w: int, width: int) -> int:
    """Zero digits at the end."""
    low = (w & -w).bit_length() - 1
    return width if low < 0 else min(width, low // _BITS)


def _edited(w: int, width: int, letter: str, more: int = 0) -> int:
    return w + (COST[letter] + more << _BITS * width) + (_DIGIT[letter] << _BITS * (_unused(w, width) - 1))


def made_up(state: int) -> str:
    """Initial of the only role that may be put after a state."""
    return "a" if state == USER else "u"


def _inserted(reached: dict[int, int], width: int) -> dict[int, int]:
    out = dict(reached)
    for _ in range(2):  # a third row inserted at one place leads nowhere new
        for state, w in list(out.items()):
            to, w = NEXT[state, made_up(state)], _edited(w, width, "I")
            out[to] = min(w, out.get(to, w))
    return out


def weights(rows: list[tuple[str, bool, bool]]) -> Weights:
    """Over rows of (initial of the role, must be deleted, truncated)."""
    width, table = 3 * len(rows) + 2, {}
    for begin in STATES:
        reached = {begin: 0}
        for initial, must_go, truncated in rows:
            following: dict[int, int] = {}

            def reach(to: int, w: int, following: dict[int, int] = following) -> None:
                following[to] = min(w, following.get(to, w))

            for state, w in _inserted(reached, width).items():
                reach(state, _edited(w, width, "D"))
                if not must_go:
                    if (state, initial) in NEXT:
                        reach(NEXT[state, initial], _edited(w, width, "K", TRUNCATED * truncated))
                    reach(NEXT[state, made_up(state)], _edited(w, width, "R", TRUNCATED * truncated))
            reached = following
        for end, w in _inserted(reached, width).items():
            table[begin, end] = w
    return Weights(width, table)


def deleted(n: int) -> Weights:
    """Over n rows that all go."""
    w = (COST["D"] * n << _BITS * n) + _DIGIT["D"] * (((1 << _BITS * n) - 1) // ((1 << _BITS) - 1))
    return Weights(n, {(state, state): w for state in STATES})


def nothing() -> Weights:
    return Weights(0, {(state, state): 0 for state in STATES})


def decided(all_of_it: Weights) -> tuple[int, str]:
    """Cost and letters of the least sequence over a whole conversation."""
    w = min(all_of_it.table[START, end] for end in WHOLE if (START, end) in all_of_it.table)
    digits = w & ((1 << _BITS * all_of_it.width) - 1)
    return w >> _BITS * all_of_it.width, f"{digits:o}".rstrip("0").translate(_LETTERS)


# -- stretches ---------------------------------------------------------------------------------

_FAULTS = ("blank", "duplicate", "truncated", "illegal")
_TURNS = ("first_turn", "last_turn", "turns")
_STRETCH = (
    "conv string, cell bigint, cut bigint, part int, first string, last string, "
    + ", ".join(f"{c} bigint" for c in (*_FAULTS, *_TURNS))
    + ", width bigint, weights array<binary>"
)
_ORDER = ["cell", "cut", "part"]


def _stretch(rows: Iterable[dict]) -> dict:
    """The table of a stretch, its faults and its ends; rows have n copies each."""
    out = dict.fromkeys(_FAULTS, 0) | {"turns": 0, "first_turn": None, "last_turn": None}
    total, piece, last = nothing(), [], None
    for row in rows:
        initial, n, turn = row["initial"], row["n"], row["turn"]
        out.setdefault("first", initial)
        if last is not None:
            out["illegal"] += (last, initial) not in LEGAL
        last = initial
        out["illegal"] += n - 1  # no role may follow itself
        if turn is not None and turn != out["last_turn"]:
            out["turns"] += 1
            out["last_turn"] = turn
            if out["first_turn"] is None:
                out["first_turn"] = turn
        gone = row["blank"] or row["seen"]
        out["blank"] += n if row["blank"] else 0
        out["duplicate"] += 0 if row["blank"] else n if row["seen"] else n - 1
        out["truncated"] += not gone and row["truncated"]
        piece.append((initial, gone, row["truncated"]))
        if len(piece) >= PIECE or n > 1:
            total, piece = total.then(weights(piece)), []
            if n > 1:
                total = total.then(deleted(n - 1)).then(weights([]))
    if piece:
        total = total.then(weights(piece))
    return out | {"last": last, "width": total.width, "weights": _packed(total)}


def _packed(made: Weights) -> list[bytes | None]:
    found = [made.table.get((a, b)) for a in STATES for b in STATES]
    return [None if w is None else w.to_bytes(w.bit_length() // 8 + 1, "little") for w in found]


def _unpacked(width: int, packed: list[bytes | None]) -> Weights:
    at = [(a, b) for a in STATES for b in STATES]
    table = {k: int.from_bytes(w, "little") for k, w in zip(at, packed, strict=True) if w is not None}
    return Weights(width, table)


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


#: Rows that leave a task together.
_TOGETHER = 2000


def _together(rows: Iterable[dict], schema: pa.Schema, most: int = _TOGETHER) -> Iterator[pa.RecordBatch]:
    out: list[dict] = []
    for row in rows:
        out.append(row)
        if len(out) == most:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


_ARROW = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "array<binary>": pa.list_(pa.binary())}


def _arrow(ddl: str) -> pa.Schema:
    return pa.schema([(name, _ARROW[kind]) for name, kind in (field.split(" ") for field in ddl.split(", "))])


def _stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[dict]:
        for rows in sorted_groups(batches, 4):
            listed = rows.to_pylist()
            yield {c: listed[0][c] for c in ("conv", *_ORDER)} | _stretch(listed)

    yield from _together(made(), _arrow(_STRETCH))


_DECISION = "conv string, gaps bigint, " + ", ".join(f"{c} bigint" for c in _FAULTS) + ", cost bigint, audit string"


def _joined(parts: Iterable[dict]) -> dict:
    """The decision for a conversation from its stretches in order."""
    out, total = dict.fromkeys(_FAULTS, 0), nothing()
    turns, least, most, last = 0, None, None, None
    for part in parts:
        for fault in _FAULTS:
            out[fault] += part[fault]
        if last is not None:
            out["illegal"] += (last, part["first"]) not in LEGAL
        last = part["last"]
        if part["turns"]:
            turns += part["turns"] - (part["first_turn"] == most)  # a turn may go on from the stretch before
            least = part["first_turn"] if least is None else least
            most = part["last_turn"]
        total = total.then(_unpacked(part["width"], part["weights"]))
        # only what begins at the start is of use from here on
        total.table = {at: w for at, w in total.table.items() if at[0] == START}
    cost, audit = decided(total)
    return out | {"gaps": 0 if least is None else most - least + 1 - turns, "cost": cost, "audit": audit}


def _decisions(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def made() -> Iterator[dict]:
        for rows in sorted_groups(batches, 1):
            parts = (row for batch in rows.to_batches() for row in batch.to_pylist())
            yield {"conv": rows.column("conv")[0].as_py()} | _joined(parts)

    yield from _together(made(), _arrow(_DECISION))


# -- whole conversations -----------------------------------------------------------------------


def _conv(key: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("-"))


def entries(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Distinct rows of each conversation with the number `n` of their copies and what is told of them."""
    space = F.lit(" ")
    named = rows.select(
        _conv(F.col(key)).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), space).alias("role"),
        F.coalesce(F.col(text), space).alias("text"),
    )
    # equal rows meet in the map tasks first
    counted = named.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    stripped = F.rtrim("text", F.lit(_SPACE))
    return written(
        counted.select(
            "conv",
            "turn",
            F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))).alias("same"),
            "n",
            F.substring("role", 1, 1).alias("initial"),
            (stripped == "").alias("blank"),
            (~F.substring(stripped, -1, 1).isin(*_ENDS)).alias("truncated"),
            "role",
            "text",
        ),
        "conversation-rows",
    )


def _seen(narrow: DataFrame) -> DataFrame:
    """Adds `seen`: whether an earlier row of the conversation has this role and text."""
    order = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("at"))
    met = narrow.groupBy("conv", "same").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("met"))
    again = written(met.where("met > 1"), "conversation-copies")
    counts = again.select("conv", "same", F.col("met").alias("n"))
    joined = hot_join(narrow, again.drop("met"), ["conv", "same"], "left", counts=counts)
    return joined.withColumn("seen", F.coalesce(order > F.col("first"), F.lit(False))).drop("first")


def _placed(narrow: DataFrame) -> DataFrame:
    """Adds the stretch of each row: cell, and in cells with a heavy turn also the turn and a part of it."""
    narrow = narrow.withColumn("cell", F.floor(F.col("turn") / F.lit(TURNS)))
    held = narrow.groupBy("conv", "cell", "turn").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > HEAVY)
    held = held.withColumn("bits", F.least(F.lit(16), F.ceil(F.log2(F.col("held") / HEAVY))).cast("int"))
    # null turns and cells are values here
    named = held.select("conv", F.coalesce(F.col("turn").cast("string"), F.lit("-")).alias("at"), "bits")
    cells = held.select("conv", F.coalesce(F.col("cell").cast("string"), F.lit("-")).alias("in"), F.lit(True).alias("split"))
    rows = narrow.withColumn("at", F.coalesce(F.col("turn").cast("string"), F.lit("-")))
    rows = rows.withColumn("in", F.coalesce(F.col("cell").cast("string"), F.lit("-")))
    rows = looked_up(rows, written(cells.distinct(), "conversation-cells"), ["conv", "in"], "left")
    rows = looked_up(rows, written(named, "conversation-turns"), ["conv", "at"], "left")
    lead = F.conv(F.hex(F.substring("same", 1, 2)), 16, 10).cast("int")
    part = F.floor(lead / F.pow(F.lit(2), 16 - F.coalesce("bits", F.lit(0)))).cast("int")
    return rows.withColumn("cut", F.when(F.col("split"), F.col("turn"))).withColumn("part", part)


def decisions(made: DataFrame) -> DataFrame:
    """conv, gaps, the counts of faults, cost and audit of every conversation of `entries`."""
    narrow = made.drop("role", "text")
    columns = ["conv", *_ORDER, "turn", "same", "n", "initial", "blank", "truncated", "seen"]
    placed = _placed(_seen(narrow)).select(*columns)
    stretches = map_sorted(placed, ["conv", *_ORDER], ["turn", "same"], _stretches, _STRETCH)
    return map_sorted(written(stretches, "conversation-stretches"), ["conv"], _ORDER, _decisions, _DECISION)


class Walk:
    """The messages that an audit makes of a conversation's rows, which come one at a time."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _put(self, initial: str) -> str:
        self.state = NEXT[self.state, initial]
        return {"u": "user", "a": "assistant"}.get(initial, initial)

    def _insertions(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._put(made_up(self.state)), ""

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str]]:
        for _ in range(n):
            yield from self._insertions()
            edit, self.at = self.audit[self.at], self.at + 1
            if edit == "K":
                self._put(role[:1])
                yield role, text
            elif edit == "R":
                yield self._put(made_up(self.state)), text

    def end(self) -> Iterator[tuple[str, str]]:
        yield from self._insertions()
        if self.at != len(self.audit):
            raise ValueError("edits without rows")


def _walked(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, tuple[str, str] | None]]:
    """(number of the decision, message), and (number, None) where its conversation ends."""
    walk, number = None, -1
    for batch in batches:
        columns = [batch.column(c) for c in ("audit", "role", "text", "n")]
        for i in range(batch.num_rows):
            audit, role, text, n = (c[i].as_py() for c in columns)
            if role is None:  # a decision comes before the rows it is for
                if walk is not None:
                    yield from ((number, m) for m in walk.end())
                    yield number, None
                walk, number = Walk(audit), number + 1
            else:
                yield from ((number, m) for m in walk.row(role, text, n))
    if walk is not None:
        yield from ((number, m) for m in walk.end())
        yield number, None


_GIVEN = ("gaps", *_FAULTS, "cost", "audit")


def _given(batches: Iterable[pa.RecordBatch], seen: list[dict]) -> Iterator[pa.RecordBatch]:
    """Passes batches on and notes the decisions in them."""
    for batch in batches:
        heads = batch.filter(batch.column("role").is_null()).select(["key", *_GIVEN])
        seen += heads.to_pylist()
        yield batch


def _in_order(rows: DataFrame, every: DataFrame, run, schema: str) -> DataFrame:
    made = entries(rows)
    keys = every.select(F.col("conv_id").alias("key")).distinct().withColumn("conv", _conv(F.col("key")))
    zeros = {c: 0 for c in _GIVEN if c != "audit"} | {"audit": ""}
    heads = keys.join(decisions(made), "conv", "left").fillna(zeros, list(zeros))
    met = heads.unionByName(made.select("conv", "turn", "same", "n", "role", "text"), allowMissingColumns=True)
    by = F.col("role").isNotNull()
    return map_sorted(met.withColumn("is_row", by), ["conv"], ["is_row", "turn", "same"], run, schema)


def repaired(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, place (from 0), role and text of the repaired conversations.

    `rows` has conv_id, turn, role and text; `every` may name conversations (conv_id) that have no rows."""
    kind = type_of(rows, "conv_id")
    schema = f"conv_id {kind}, place bigint, role string, text string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict] = []
        first, place, key, held, out = 0, 0, None, 0, []
        for number, message in _walked(_given(batches, seen)):
            if place == 0:
                key = seen[number - first]["key"]
            if message is None:
                del seen[: number + 1 - first]
                first, place = number + 1, 0
                continue
            out.append((key, place, *message))
            place, held = place + 1, held + len(message[1])
            if held > 1 << 22:
                yield made(out)
                held, out = 0, []
        if out:
            yield made(out)

    def made(out: list[tuple]) -> pa.RecordBatch:
        kinds = [None, pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=["conv_id", "place", "role", "text"])

    return _in_order(rows, rows if every is None else every, run, schema)


def judged(rows: DataFrame, every: DataFrame | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256, the digest of
    the repaired `role:text`, joined by newlines."""
    schema = f"conv_id {type_of(rows, 'conv_id')}, " + _DECISION.split(", ", 1)[1] + ", repaired_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[dict] = []
        first, total, empty, out = 0, hashlib.sha256(), True, []

        def made() -> pa.RecordBatch:
            kinds = [pa.string() if c == "audit" else pa.int64() for c in _GIVEN]
            heads = [head for head, _ in out]
            columns = [pa.array([h["key"] for h in heads])]
            columns += [pa.array([h[c] for h in heads], t) for c, t in zip(_GIVEN, kinds, strict=True)]
            columns.append(pa.array([digest for _, digest in out], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["conv_id", *_GIVEN, "repaired_sha256"])

        for number, message in _walked(_given(batches, seen)):
            if message is not None:
                total.update(("" if empty else "\n").encode() + f"{message[0]}:{message[1]}".encode())
                empty = False
                continue
            out.append((seen[number - first], total.hexdigest()))
            del seen[: number + 1 - first]
            first, total, empty = number + 1, hashlib.sha256(), True
            if len(out) == _TOGETHER:
                yield made()
                out = []
        if out:
            yield made()

    return _in_order(rows, rows if every is None else every, run, schema)
