"""Quality rules: base rules, then robust multivariate outliers per language and source.

Each text's statistics become a vector on transformed scales. For every (language, source) the estimate
of minimum covariance determinant is searched: of the `SUPPORT` share of rows that lie together, the one whose scatter has the
least determinant. A bounded sample of each group gives the start: concentration steps (estimate centre and
scatter from the rows that lie nearest, repeat) from many small random subsets and from the medians, the least determinant
wins. From there a few steps are taken over all rows, fewer if the determinant of no group falls any more. A document is
rejected when its squared Mahalanobis distance from its group's estimate is beyond the chi-square quantile that one
normal row in 10^9 exceeds. Everything a step moves between tasks is a sum or a quantile sketch per
group, so a group may hold any share of the rows.

Defined results: a null text has no words and fails the base rules; null languages and sources are
groups of their own; rows that fail the base rules take no part in the estimates; a group of fewer than
`min_rows` rows takes the estimate of its language, that of fewer the estimate of all rows, and with
fewer in all nothing is rejected beyond the base rules. Repeated rows count as often as they occur.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import looked_up, written
from .words import WHITE, Texts, runs, slices, windows, words

#: Symbols that count, as the contract lists them.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50

FEATURES = ("x_length", "x_word", "x_symbols", "x_dup", "x_repeat")
#: Spread that each feature has at least: where nearly all texts agree (no symbol at all), a small
#: difference is not yet an outlier.
FLOOR = (0.25, 0.05, 0.03, 0.15, 0.15)
SUPPORT = 0.75
#: Rows of a group that the search for a start sees on average, random subsets it begins with, those of them it
#: follows to the end, and steps over all rows at most.
SAMPLE, STARTS, FOLLOWED, STEPS = 400, 40, 5, 3
#: A fall of the determinant's logarithm by less than this is none.
FALL = 1e-3
#: Share of normal rows that lie beyond the cut.
TAIL = 1e-9
MIN_ROWS = 60


def _repeated(row: np.ndarray, key: np.ndarray, fits: np.ndarray, n: int) -> np.ndarray:
    """Per row, words in three-word windows that occur twice or more in that row."""
    at = np.flatnonzero(fits)
    order = np.lexsort((key[at], row[at]))
    at = at[order]
    if not len(at):
        return np.zeros(n, np.int64)
    same = (key[at][1:] == key[at][:-1]) & (row[at][1:] == row[at][:-1])
    hit = np.zeros(len(at), bool)
    hit[1:] |= same
    hit[:-1] |= same
    covered = np.zeros(len(row), bool)
    for i in range(3):
        covered[at[hit] + i] = True
    return np.bincount(row[covered], minlength=n)


def _lines(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Per text, lines that hold a word, and those equal to an earlier one."""
    data, bounds, n = texts.data, texts.bounds, texts.n
    newline = np.zeros(256, bool)
    newline[ord("\n")] = True
    found = words(texts, newline)
    inside = np.concatenate(([0], np.cumsum(~WHITE[data])))
    has_word = inside[found.end] > inside[found.start]
    row, key = found.row[has_word], found.key[has_word]
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    again = np.zeros(len(row), bool)
    again[1:] = (key[1:] == key[:-1]) & (row[1:] == row[:-1])
    return np.bincount(row, minlength=n), np.bincount(row[again], minlength=n)


def measure(texts: Texts) -> list[np.ndarray]:
    """The statistics of each text of a slice, in the order of STATISTICS."""
    n, data = texts.n, texts.data
    found = words(texts)
    letters = np.concatenate(([0], np.cumsum(((data & 0xC0) != 0x80) & ~WHITE[data])))
    symbols = np.concatenate(([0], np.cumsum(SYMBOLS[data])))
    per_text = [np.diff(total[texts.bounds]) for total in (letters, symbols)]
    key, fits = windows(found, 3)
    return [np.bincount(found.row, minlength=n), *per_text, *_lines(texts), _repeated(found.row, key, fits, n)]


def statistics(df: DataFrame, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """`row` (a struct of the columns to keep, all without a list) and the statistics of each text.

    A text goes to the Python worker once, in its row or, if it is not kept, beside it."""
    keep = df.columns if keep is None else list(keep)
    place = keep.index(text) if text in keep else None

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1) if place is None else pc.struct_field(batch.column(0), [place])
            for texts in slices(column):
                made = [pa.array(x, pa.int64()) for x in measure(texts)]
                rows = batch.column(0).slice(texts.first, texts.n)
                yield pa.RecordBatch.from_arrays([rows, *made], names=["row", *STATISTICS])

    apart = [] if place is not None else [F.col(text).alias("text")]
    rows = df.select(F.struct(*keep).alias("row"), *apart)
    schema = f"row {rows.schema['row'].dataType.simpleString()}, " + ", ".join(f"{c} bigint" for c in STATISTICS)
    return rows.mapInArrow(run, schema)


def base_failed() -> Column:
    repeated = 100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")
    return (F.col("n_words") < MIN_WORDS) | repeated


def _features() -> list[Column]:
    many = F.greatest(F.col("n_words"), F.lit(1))
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    lines = F.greatest(F.col("n_lines"), F.lit(1))
    return [
        F.log(many),
        F.log(chars / many),
        F.sqrt(F.col("n_symbols") / chars),
        F.col("n_dup_lines") / lines,
        F.sqrt(F.col("n_repeat_words") / many),
    ]


def _group(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit("-"))


def prepared(stats: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Adds the base verdict, the group keys and the vector to a table of statistics with `row`."""
    made = stats.withColumn("base_failed", base_failed())
    made = made.withColumn("g_lang", _group(F.col("row")[lang])).withColumn("g_source", _group(F.col("row")[source]))
    for name, value in zip(FEATURES, _features(), strict=True):
        made = made.withColumn(name, value)
    return made


def _chi2_cdf(x: float, k: float) -> float:
    a, x = k / 2, x / 2
    term = total = 1 / a
    for i in range(1, 400):
        term *= x / (a + i)
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _chi2_quantile(share: float, k: float) -> float:
    low, high = 1e-9, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < share else (low, mid)
    return low


def consistency(p: int, support: float) -> float:
    """What makes the scatter of the nearest `support` of a normal sample that of the whole."""
    return support / _chi2_cdf(_chi2_quantile(support, p), p + 2)


_FACTOR = consistency(len(FEATURES), SUPPORT)
#: Mahalanobis distance beyond which a document is rejected.
CUTOFF = math.sqrt(_chi2_quantile(1 - TAIL, len(FEATURES)))

_PAIRS = [(i, j) for i in range(len(FEATURES)) for j in range(i, len(FEATURES))]


def _distance(x: list[Column]) -> Column:
    """Squared Mahalanobis distance; `precision` holds the upper triangle of the inverse scatter."""
    off = [x[i] - F.col("centre")[i] for i in range(len(x))]
    terms = [(1 if i == j else 2) * F.col("precision")[k] * off[i] * off[j] for k, (i, j) in enumerate(_PAIRS)]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def _widened(scatter: np.ndarray) -> np.ndarray:
    """The scatter of the whole that goes with that of the support, with the floor on its diagonal."""
    return scatter * _FACTOR + np.diag(np.square(FLOOR))


def _upper(full: np.ndarray) -> list[float]:
    return [float(full[i, j]) for i, j in _PAIRS]


_SHAPE = T.StructType([T.StructField("precision", T.ArrayType(T.DoubleType())), T.StructField("log_det", T.DoubleType())])


@F.pandas_udf(_SHAPE)
def _shape(scatter: pd.Series) -> pd.DataFrame:
    """Inverses and determinants of widened scatter matrices that are given by their upper triangles."""
    out, p = [], len(FEATURES)
    for upper in scatter:
        full = np.zeros((p, p))
        for value, (i, j) in zip(upper, _PAIRS, strict=True):
            full[i, j] = full[j, i] = value
        full = _widened(full)
        out.append((_upper(np.linalg.inv(full)), float(np.linalg.slogdet(full)[1])))
    return pd.DataFrame(out, columns=["precision", "log_det"])


def _moments(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, widened scatter and the logarithm of its determinant."""
    centre = x.mean(0)
    full = _widened((x - centre).T @ (x - centre) / len(x))
    return centre, full, float(np.linalg.slogdet(full)[1])


def _nearest(x: np.ndarray, centre: np.ndarray, full: np.ndarray) -> np.ndarray:
    """The support: the rows that lie nearest."""
    off = x - centre
    d2 = np.einsum("ij,ij->i", off @ np.linalg.inv(full), off)
    return x[np.argsort(d2, kind="stable")[: max(1, math.ceil(SUPPORT * len(x)))]]


def least_determinant(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Centre, widened scatter and log determinant of the best support that the starts lead to."""
    x = x[np.lexsort(x.T)]
    rng, p = np.random.default_rng(len(x)), x.shape[1]
    middle = np.median(x, 0)
    spread = np.diag((1.4826 * np.median(np.abs(x - middle), 0)) ** 2 + np.square(FLOOR))
    found = [(middle, spread)]
    for _ in range(STARTS):
        found.append(_moments(x[rng.choice(len(x), min(len(x), p + 1), replace=False)])[:2])
    tried = []
    for centre, full in found:
        for _ in range(2):
            centre, full, log_det = _moments(_nearest(x, centre, full))
        tried.append((log_det, centre, full))
    best = None
    for log_det, centre, full in sorted(tried, key=lambda t: t[0])[:FOLLOWED]:
        while True:
            after = _moments(_nearest(x, centre, full))
            if after[2] >= log_det - 1e-9:
                break
            centre, full, log_det = after
        if best is None or log_det < best[2]:
            best = centre, full, log_det
    return best


_KEYS = ["level", "g_lang", "g_source"]


def _levelled(vectors: DataFrame) -> DataFrame:
    """Every row under its (language, source), its language and all."""
    empty = F.lit("")
    levels = F.array(
        F.struct(F.lit(0).alias("level"), F.col("g_lang"), F.col("g_source")),
        F.struct(F.lit(1).alias("level"), F.col("g_lang"), empty.alias("g_source")),
        F.struct(F.lit(2).alias("level"), empty.alias("g_lang"), empty.alias("g_source")),
    )
    return vectors.select(F.explode(levels).alias("at"), *FEATURES).select("at.*", *FEATURES)


def _start(group: pd.DataFrame) -> pd.DataFrame:
    centre, full, _ = least_determinant(group[list(FEATURES)].to_numpy(float))
    out = group.iloc[:1][_KEYS].copy()
    return out.assign(centre=[centre.tolist()], precision=[_upper(np.linalg.inv(full))])


def fit(vectors: DataFrame) -> DataFrame:
    """Centre and precision for every group of (g_lang, g_source) among rows that passed the base rules."""
    rows = _levelled(vectors.where("not base_failed").select("g_lang", "g_source", *FEATURES))
    x = [F.col(c) for c in FEATURES]
    counts = written(rows.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n")), "mcd-groups")
    some = looked_up(rows, counts, _KEYS).where(F.rand(1) * F.col("n") < SAMPLE)
    schema = "level int, g_lang string, g_source string, centre array<double>, precision array<double>"
    start = some.groupBy(*_KEYS).applyInPandas(_start, schema)
    infinite = F.lit(float("inf")).alias("log_det")  # of a sample: nothing to compare with
    estimate = written(counts.join(start, _KEYS).select(*_KEYS, "n", "centre", "precision", infinite), "mcd-start")
    for step in range(STEPS):
        far = looked_up(rows, estimate, _KEYS).withColumn("d2", _distance(x))
        near = far.groupBy(*_KEYS).agg(F.percentile_approx("d2", SUPPORT, 10_000).alias("radius"))
        reach = written(estimate.join(near, _KEYS), f"mcd-radius-{step}")
        kept = looked_up(rows, reach, _KEYS).withColumn("d2", _distance(x)).where("d2 <= radius")
        means = [F.avg(c).alias(f"m_{c}") for c in FEATURES]
        spread = [F.covar_pop(FEATURES[i], FEATURES[j]).alias(f"c_{i}_{j}") for i, j in _PAIRS]
        moments = kept.groupBy(*_KEYS).agg(*means, *spread)
        after = moments.select(
            *_KEYS,
            F.array(*[F.col(f"m_{c}") for c in FEATURES]).alias("new_centre"),
            _shape(F.array(*[F.col(f"c_{i}_{j}") for i, j in _PAIRS])).alias("new"),
        )
        falls = F.coalesce(F.col("new.log_det") < F.col("log_det") - FALL, F.lit(False))
        chosen_ = estimate.join(after, _KEYS, "left").withColumn("falls", falls)
        estimate = written(
            chosen_.select(
                *_KEYS,
                "n",
                *[F.when(falls, F.col(new)).otherwise(F.col(old)).alias(old) for old, new in _REPLACED],
                "falls",
            ),
            f"mcd-{step}",
        )
        if estimate.where("falls").isEmpty():
            break
        estimate = estimate.drop("falls")
    return estimate


_REPLACED = (("centre", "new_centre"), ("precision", "new.precision"), ("log_det", "new.log_det"))


def chosen(estimate: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """For each (g_lang, g_source) the narrowest estimate that rests on enough rows."""
    usable = estimate.withColumn("fit", F.when(F.col("n") >= min_rows, F.struct("centre", "precision")))
    own = usable.where("level = 0").select("g_lang", "g_source", F.col("fit").alias("own"))
    lang = usable.where("level = 1").select("g_lang", F.col("fit").alias("of_lang"))
    every = usable.where("level = 2").select(F.col("fit").alias("of_all"))
    joined = own.join(lang, "g_lang", "left").crossJoin(F.broadcast(every))  # one row at most: that of all rows
    return joined.select("g_lang", "g_source", F.coalesce("own", "of_lang", "of_all").alias("fit")).select(
        "g_lang", "g_source", "fit.centre", "fit.precision"
    )


def judged(vectors: DataFrame, estimate: DataFrame, cutoff: float = CUTOFF, min_rows: int = MIN_ROWS) -> DataFrame:
    """Adds `distance` (null: nothing to compare with) and `kept`."""
    joined = looked_up(vectors, written(chosen(estimate, min_rows), "mcd"), ["g_lang", "g_source"], "left")
    joined = joined.withColumn("distance", F.sqrt(F.greatest(_distance([F.col(c) for c in FEATURES]), F.lit(0.0))))
    near = F.coalesce(F.col("distance") <= cutoff, F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & near)


def filtered(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of `df` whose texts pass; their columns are unchanged."""
    estimate = fit(written(prepared(statistics(df, text, [lang, source]), lang, source), "quality"))
    return judged(prepared(statistics(df, text), lang, source), estimate).where("kept").select("row.*")
