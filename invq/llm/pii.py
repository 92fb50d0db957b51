"""Personal data: fixed forms first, then bootstrapped contextual extraction.

The fixed forms (email, ip, card, phone) are the seeds. Every seed and every other identifier-like token
(two digits or an at sign in it, outside the seeds, of any length) stands in a context, and so does every
longest run of neighbouring groups of digits (joined by spaces, dots, dashes or brackets); two words before, one on each side
and two after make its lexical patterns. Spark scores the graph of patterns and instances in rounds: a
pattern is as good as the share of its instances that are known or likely to be of a kind, an
instance as likely as its good patterns are together, and only what a good pattern points at counts for other
patterns in the next round, so doubtful contexts do not prop each other up. Patterns must have been
seen with `MIN_SEEDS` different seeds, and as the score counts one value more than were seen, `MIN_SCORE` asks for
four where all values are seeds and for eight where one is not; what a good one points at becomes a span of that kind, and if a run of
groups does, its single groups do not.

Defined results: a null text is empty; spans are code points, end exclusive; fixed spans always stay;
rows equal in key and text get the same spans; a token that patterns of two kinds point at gets the
likelier kind, the first listed in a tie.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import type_of, written
from .words import slices

KINDS = ("email", "ip", "card", "phone")
MIN_SEEDS = 3
MIN_SCORE = 0.8
ROUNDS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
#: An at sign or a digit of any script, as str.isdigit has it.
_MARKED = re.compile(f"[@{''.join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isdigit())}]")
_EDGE = ".,;:!?()[]{}<>\"'"
#: What may stand between the groups of one number, beside spaces.
_JOINTS = frozenset(".-()[]")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local part, at sign and domain; each character is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        domain = _DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            yield begin, domain.end()
        done = domain.end() if domain else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Kind (by its place in KINDS), start and end of the fixed forms, in that order."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x) <= 255 for x in m.group().split(".")):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m.group())
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m.group())) <= 15:
            out.append((3, *m.span()))
    return out


def _like_identifier(token: str) -> bool:
    return "@" in token or sum(map(str.isdigit, token)) >= 2


def _named(text: str, limit: int) -> str:
    """The text in lower case, of a longer one than the limit its beginning and a hash of all."""
    text = text.lower()
    return text if len(text) <= limit else f"{text[:limit]}\u0001{xxhash.xxh3_64_hexdigest(text.encode())}"


def _joined(text: str, tokens: list[tuple[int, int]], taken: np.ndarray, i: int, j: int) -> bool:
    """Whether nothing but spaces and joints stands between the digits of token i and those of token j."""
    tail, head = text[slice(*tokens[i])], text[slice(*tokens[j])]
    if not _JOINTS.issuperset(tail[len(tail.rstrip(_EDGE)) :] + head[: len(head) - len(head.lstrip(_EDGE))]):
        return False
    for k in range(i + 1, j + 1):
        if text[tokens[k - 1][1] : tokens[k][0]].strip("\x20") or taken[k]:
            return False
        if k < j and not _JOINTS.issuperset(text[slice(*tokens[k])]):
            return False
    return True


def _grouped(
    text: str, tokens: list[tuple[int, int]], taken: np.ndarray, marked: list[int]
) -> Iterator[tuple[int, int]]:
    """First and last token of each longest run of at least two neighbouring groups of digits.

    `marked` are the tokens with a digit or an at sign; a plus may stand before a run.
    """
    first = last = -1
    for i in marked:
        core = text[slice(*tokens[i])].strip(_EDGE)
        group = not taken[i] and all(c in _JOINTS or c.isdigit() for c in core.removeprefix("+"))
        if first >= 0 and group and not core.startswith("+") and _joined(text, tokens, taken, last, i):
            last = i
            continue
        if last > first:
            yield first, last
        first = last = i if group else -1
    if last > first:
        yield first, last


def occurrences(text: str, seeds: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds, other identifier-like tokens and runs of digit groups, each with the two words on either side.

    `run` is where the run begins that a token is in, `whole` is false for tokens that are part of one.
    """
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    begins, ends = np.array([a for a, _ in tokens]), np.array([b for _, b in tokens])
    taken = np.zeros(len(tokens), bool)
    places = []
    for kind, a, b in seeds:
        first, last = int(np.searchsorted(ends, a, "right")), int(np.searchsorted(begins, b))
        taken[first:last] = True
        places.append((kind, a, b, first, last, a, True))

    def core(i: int) -> tuple[int, int]:
        a, b = tokens[i]
        token = text[a:b]
        a += len(token) - len(token.lstrip(_EDGE))
        return a, a + len(token.strip(_EDGE))

    marks = np.array([m.start() for m in _MARKED.finditer(text)], np.int64)
    marked = np.unique(np.searchsorted(begins, marks, "right") - 1).tolist()
    run_of = {}
    for first, last in _grouped(text, tokens, taken, marked):
        a, b = core(first)[0], core(last)[1]
        places.append((-1, a, b, first, last + 1, a, True))
        run_of |= dict.fromkeys(range(first, last + 1), a)
    for i in marked:
        if not taken[i]:
            a, b = core(i)
            if _like_identifier(text[a:b]):
                places.append((-1, a, b, i, i + 1, run_of.get(i, a), i not in run_of))

    def word(i: int) -> str:
        return _named(text[slice(*tokens[i])].strip(_EDGE), 64) if 0 <= i < len(tokens) else ""

    return [
        {
            "kind": kind,
            "start": a,
            "end": b,
            "value": _named(text[a:b], 256),
            "context": [word(first - 2), word(first - 1), word(last), word(last + 1)],
            "run": run,
            "whole": whole,
        }
        for kind, a, b, first, last, run, whole in places
    ]


_PLACE = "struct<kind:int,start:bigint,`end`:bigint,value:string,context:array<string>,run:bigint,whole:boolean>"
_PLACE_TYPE = pa.list_(
    pa.struct(
        [
            ("kind", pa.int32()),
            ("start", pa.int64()),
            ("end", pa.int64()),
            ("value", pa.string()),
            ("context", pa.list_(pa.string())),
            ("run", pa.int64()),
            ("whole", pa.bool_()),
        ]
    )
)
_MARK = np.zeros(256, bool)
_MARK[[*range(0x30, 0x3A), ord("@"), *range(0x80, 0x100)]] = True  # beyond ASCII there may be digits too


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without a digit of any script and without an at sign are passed over; nothing that counts is in them."""
    for batch in batches:
        key, column = batch.column(0), batch.column(1)
        for texts in slices(column):
            total = np.concatenate(([0], np.cumsum(_MARK[texts.data])))
            maybe = np.diff(total[texts.bounds]) > 0
            prints, places = [], []
            for i, look in enumerate(maybe.tolist()):
                raw = texts.data[texts.bounds[i] : texts.bounds[i + 1]]
                prints.append(xxhash.xxh3_64_intdigest(raw.tobytes()) - (1 << 63) if look else 0)
                text = raw.tobytes().decode() if look else ""
                if _MARKED.search(text):
                    places.append(occurrences(text, base_spans(text)))
                else:
                    places.append([])
            columns = [
                key.slice(texts.first, texts.n),
                pa.array(prints, pa.int64()),
                pa.array(places, _PLACE_TYPE),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "print", "places"])


def scanned(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, a print of the text, and its seeds and other identifier-like tokens."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(_scan, f"key {type_of(df, key)}, print bigint, places array<{_PLACE}>")


def _patterns() -> Column:
    """Contexts with a word in each place they name."""
    c = [F.col("context")[i] for i in range(4)]
    gap = "\u0001"
    made = [
        F.when((c[0] != "") & (c[1] != ""), F.concat(F.lit("b"), c[0], F.lit(gap), c[1])),
        F.when((c[1] != "") & (c[2] != ""), F.concat(F.lit("m"), c[1], F.lit(gap), c[2])),
        F.when((c[2] != "") & (c[3] != ""), F.concat(F.lit("a"), c[2], F.lit(gap), c[3])),
    ]
    return F.filter(F.array(*made), lambda p: p.isNotNull())


def discovered(scan: DataFrame, min_seeds: int = MIN_SEEDS, min_score: float = MIN_SCORE) -> DataFrame:
    """Key, print, kind, start and end of tokens and runs that good patterns point at."""
    places = scan.select("key", "print", F.explode("places").alias("p")).select("key", "print", "p.*")
    met = places.select("key", "print", "kind", "start", "end", "run", "whole", "value", F.explode(_patterns()).alias("pattern"))
    edges = met.select("pattern", "value", "kind").distinct()
    seeds = edges.where("kind >= 0")
    able = seeds.groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_seeds)
    able = able.select("pattern").distinct()
    edges = written(edges.join(able, "pattern"), "pii-edges")
    totals = edges.groupBy("pattern").agg(F.count_distinct("value").alias("total"))
    known = edges.where("kind >= 0").select("pattern", "value", "kind", F.lit(1.0).alias("score"))
    unknown = edges.where("kind < 0").select("pattern", "value")
    likely = known
    for i in range(ROUNDS):
        sums = likely.groupBy("pattern", "kind").agg(F.sum("score").alias("score"))
        patterns = sums.join(totals, "pattern").select(
            "pattern", "kind", (F.col("score") / (F.col("total") + 1)).alias("quality")
        )
        patterns = written(patterns, f"pii-patterns-{i}")
        good = patterns.where(F.col("quality") >= min_score)
        together = F.lit(1.0) - F.exp(F.sum(F.log1p(-F.least("quality", F.lit(0.999)))))
        instances = unknown.join(good, "pattern").groupBy("value", "kind").agg(together.alias("score"))
        instances = written(instances, f"pii-instances-{i}")
        likely = known.unionByName(unknown.join(instances, "value").select("pattern", "value", "kind", "score"))
    good = good.select("pattern", F.col("kind").alias("of"))
    sure = instances.select("value", F.col("kind").alias("of"), "score")
    hits = met.where("kind < 0").join(good, "pattern").join(sure, ["value", "of"])
    likeliest = F.max_by("of", F.struct("score", -F.col("of"))).alias("kind")
    hits = hits.groupBy("key", "print", "run", "whole", "start", "end").agg(likeliest)
    as_whole = F.max("whole").over(Window.partitionBy("key", "print", "run"))
    return hits.withColumn("as_whole", as_whole).where("whole or not as_whole").drop("run", "whole", "as_whole")


def spelled(places: Column) -> Column:
    """kind:start:end by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    ordered = F.array_sort(F.transform(places, lambda p: F.struct(p["kind"], p["start"], p["end"])))
    parts = F.transform(
        ordered,
        lambda p: F.concat_ws(":", F.get(names, p["kind"]), p["start"].cast("string"), p["end"].cast("string")),
    )
    return F.array_join(parts, ",")


def found(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, `base` and `more` (arrays of kind, start, end), base spans counted by kind and spelled."""
    scan = written(scanned(df, key, text), "pii-scan")
    more = discovered(scan).groupBy("key", "print").agg(F.collect_list(F.struct("kind", "start", "end")).alias("more"))
    more = more.withColumnsRenamed({"key": "of_key", "print": "of_print"})
    base = F.transform(
        F.filter("places", lambda p: p["kind"] >= 0), lambda p: F.struct(p["kind"], p["start"], p["end"])
    )
    rows = scan.select("key", "print", base.alias("base"))
    same = F.col("key").eqNullSafe(F.col("of_key")) & (F.col("print") == F.col("of_print"))
    joined = rows.join(more, same, "left").withColumn("more", F.coalesce("more", F.filter("base", lambda _: F.lit(False))))
    kinds = F.transform("base", lambda p: p["kind"])
    counts = [
        (F.size("base") - F.size(F.array_remove(kinds, i))).cast("long").alias(f"n_{kind}")
        for i, kind in enumerate(KINDS)
    ]
    return joined.select(
        F.col("key").alias(key),
        "base",
        "more",
        *counts,
        spelled(F.col("base")).alias("base_spans"),
        spelled(F.concat("base", "more")).alias("spans"),
    )
