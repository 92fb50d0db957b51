import heapq
import random
import re
import zlib
from hashlib import md5, sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from invq.llm import checks, queries
from invq.llm import conversations as C
from tests.checker import compare, duck

SF = "/root/testdata/sf0.001"
SPACE = "\x20\t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def digest(role, text):
    return md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role = "user" if fate == 4 else role
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def faults(rows):
    """(role, text, fault or None) in order."""
    seen, out = set(), []
    for role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else None
        fault = fault or ("truncated" if body[-1] not in ".!?" else None)
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def least(rows):
    """Cost, audit and messages by trying edits in order of (cost, letters): the first to end well is the least."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, shape, made = heapq.heappop(heap)
        if (i, shape[-1:]) in done:
            continue
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", shape):
            return cost, audit, made
        done.add((i, shape[-1:]))
        options = []
        if i < len(rows):
            role, text, fault = rows[i]
            options.append(("D", 3, 1, None, None))
            if fault not in ("blank", "duplicate"):
                late = fault == "truncated"
                options.append(("K", late, 1, role, text))
                options += [("R", 2 + late, 1, r, text) for r in ("user", "assistant")]
        options += [("I", 2, 0, r, "") for r in ("user", "assistant")]
        for letter, price, step, role, text in options:
            to = shape if role is None else shape + (role[:1] or "?")
            if re.fullmatch("s?(ua)*u?", to):
                message = () if role is None else ((role, text),)
                heapq.heappush(heap, (cost + price, audit + letter, i + step, to, made + message))
    raise AssertionError


def judge(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(*r[1:])))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    found = faults([r[1:] for r in rows])
    n = [sum(f == kind for *_, f in found) for kind in ("blank", "duplicate", "truncated")]
    pairs = zip(found[:-1], found[1:], strict=True) if found else []
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
    cost, audit, made = least(found)
    return (gaps, *n, illegal, cost, audit, sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def brute(rows):
    out, after = {}, damage(rows)
    for conv in {r[0] for r in rows}:
        out[conv] = judge([r[1:] for r in after if r[0] == conv])
    return out


def found(df):
    rows = df.collect()
    assert len(rows) == len({r.conv_id for r in rows})
    return {r.conv_id: tuple(r)[1:] for r in rows}


def run(spark, rows, tmp_path):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    df.write.mode("overwrite").parquet(f"{tmp_path}/conversations.parquet")
    return found(queries.op11_conversation_repair(spark, str(tmp_path)))


def some(rng, convs, most=9):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "unknown", "", None]
    texts = ["Yes.", "No!", "cut off", "Yes. ", "", " \n", None, "So?\t", "é…", "a.b"]
    rows = []
    for conv in convs:
        turn = rng.choice([0, -3, 1000, 1020])
        for _ in range(rng.randrange(most)):
            rows.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(roles), rng.choice(texts)))
            turn += rng.choice([0, 1, 1, 1, 2, 1500])
    return rows


def test_query_equals_its_sql(spark):
    problem, n = compare(spark, duck(SF), "op11_conversation_repair", queries.op11_conversation_repair, checks.OP11_CONVERSATIONS, SF)
    assert problem is None and n > 0


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(queries.op11_conversation_repair(spark, SF)) == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_strange_conversations(spark, tmp_path, seed, monkeypatch):
    monkeypatch.setattr(C, "HEAVY", 2)
    monkeypatch.setattr(C, "TURNS", 4)
    rng = random.Random(seed)
    rows = some(rng, [*range(150), None])
    assert run(spark, rows, tmp_path) == brute(rows)


def test_a_long_conversation_and_a_row_many_times(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(C, "HEAVY", 50)
    rng = random.Random(5)
    rows = [(1, i, rng.choice(["user", "assistant"]), f"t{i}" + rng.choice([".", "", "?"])) for i in range(3000)]
    rows += [(1, 77, "user", "again")] * 900 + [(1, None, "assistant", f"x{i}.") for i in range(300)]
    rows += some(rng, [2, 3])
    assert run(spark, rows, tmp_path) == brute(rows)


def test_messages(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "assistant", "Hello."), (1, 2, "user", "What?"), (2, 0, "user", " ")]
    rows += [(3, i, "user" if i % 2 == 0 else "assistant", f"{i}.") for i in range(200)]
    made = sorted(C.repaired(spark.createDataFrame(rows, SCHEMA)).collect())
    of = {conv: [(r.place, r.role, r.text) for r in made if r.conv_id == conv] for conv in (1, 2, 3)}
    wanted = least(faults([r[2:] for r in rows if r[0] == 1]))[2]
    assert of[1] == [(i, *m) for i, m in enumerate(wanted)] and of[2] == []
    assert of[3] == [(r[1], *r[2:]) for r in rows if r[0] == 3]


def test_edges(spark, tmp_path):
    rows = [(None, None, None, None), (None, None, None, None), (0, 0, "user", "x" * 200_000), (5, None, "user", "a."), (5, None, "assistant", "b.")]
    assert run(spark, rows, tmp_path) == brute(rows)
    assert run(spark, [], f"{tmp_path}/none") == {}
    df = spark.createDataFrame([(1, 1, "user", "a.", "k", 2, 3)], SCHEMA + ", conv string, n int, audit int")
    assert C.judged(df).columns[0] == "conv_id" and C.judged(df).count() == 1


ROWS = st.lists(st.tuples(st.sampled_from("suatx"), st.booleans(), st.booleans()), max_size=9)


@settings(max_examples=200, deadline=None)
@given(ROWS, st.integers(0, 9))
def test_integers_of_two_parts_join(rows, cut):
    whole = C.weights(rows)
    joined = C.weights(rows[:cut]).then(C.weights(rows[cut:]))
    assert C.decided(whole) == C.decided(joined)
    kinds = [(role, str(i), "blank" if gone else "truncated" if late else None) for i, (role, gone, late) in enumerate(rows)]
    assert C.decided(whole) == least(kinds)[:2]


def test_many_rows_that_go():
    some_rows = [("u", False, False)]
    joined = C.weights(some_rows).then(C.deleted(40)).then(C.weights([("a", False, True)]))
    assert C.decided(joined) == (121, "K" + "D" * 40 + "K")
