"""Language of words and texts by a linear-chain conditional random field.

A word speaks through hashed features: its prefixes and suffixes, its letter n-grams and, if training saw
it often enough, itself. Learned transitions tie neighbouring words; forward-backward gives every word
the probability of each language in its context, so stretches in another language stand out. A
text's language is the one with most words by expectation, its score that language's share.

Words are cut at ASCII white space. A run in a script that is written without spaces (Chinese, Japanese, Thai and
others), or of over `LONG` characters, is cut further into units of `UNIT` characters that overlap by two, so
that every character and n-gram of it takes part; units stand in the chain as words do, and the word gets the
language that its units have by expectation.

Training reads a bounded sample: at most `TRAIN_DOCS` different rows a language, chosen by a hash of key and text
from rows of any length, and of each at most `TRAIN_CHARS` characters. Their words are joined into chains that switch between
texts, so that transitions are learned from code-switched examples. Prediction reads whole texts.

Defined results: `und` and score 0 for null texts and texts without a letter, or when nothing could be
learned; a tie goes to the alphabetically first language; words without letters are neutral.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import type_of
from .words import Texts, Words, slices, span_keys, words

#: Bounds of the training sample: texts of a language, characters of a text, languages. And parts of the draw.
TRAIN_DOCS, TRAIN_CHARS, TRAIN_LANGS = 120, 8_000, 256
SLOTS = 64
#: Words of a chain; longer texts are consecutive chains, and messages pass between them.
CHAIN = 64
#: Words that stay in one text while a training chain is joined.
STRETCH = 16
BUCKETS = 1 << 16
LEXICON_COUNT = 3
STEPS, RATE, RIDGE = 40, 0.3, 1e-4

#: Characters of a unit, beside the two it shares with the next, and of the longest run that is one word.
UNIT, LONG = 6, 64

_NOT_LETTERS = re.compile(r"[\W\d_]+")
#: Blocks of 64 code points in scripts without spaces: Thai to Tibetan, Myanmar, Khmer, kana, Han and its
#: compatibility forms, half-width kana. Han beyond the first plane begins with four other bytes.
_UNSPACED = np.zeros(1024, bool)
for _a, _b in ((0xE00, 0x1000), (0x1000, 0x10A0), (0x1780, 0x1800), (0x3040, 0x3100), (0x31C0, 0xA000), (0xF900, 0xFB00), (0xFF40, 0xFFA0)):
    _UNSPACED[_a >> 6 : -(-_b >> 6)] = True


def units(texts: Texts) -> tuple[Words, np.ndarray]:
    """The words of the texts, long and unspaced ones as overlapping units, and which word each is of."""
    found, data = words(texts), texts.data
    if not len(found.key) or data.max() < 0xE0 and (found.end - found.start).max() <= LONG:
        return found, np.arange(len(found.key))
    begins = np.append((data & 0xC0) != 0x80, np.ones(1, bool))
    upto = np.concatenate(([0], np.cumsum(begins[:-1])))  # characters that begin before each byte
    n = upto[found.end] - upto[found.start]
    second = np.append(data[1:], 0)
    block = (data & 0xF).astype(np.int64) << 6 | second & 0x3F
    unspaced = ((data >> 4) == 0xE) & _UNSPACED[block] | (data == 0xF0) & (second >= 0xA0)
    total = np.concatenate(([0], np.cumsum(unspaced)))
    cut = (n > LONG) | (n > UNIT + 2) & (total[found.end] > total[found.start])
    if not cut.any():
        return found, np.arange(len(n))
    pieces = np.where(cut, np.maximum(1, -(-(n - 2) // UNIT)), 1)
    word = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    at = np.flatnonzero(begins)
    first = upto[found.start][word] + nth * UNIT
    last = nth == pieces[word] - 1
    start = at[first]
    end = np.where(last, found.end[word], at[np.minimum(first + UNIT + 2, len(at) - 1)])
    return Words(found.row[word], start, end, span_keys(data, start, end)), word


def letters(word: str) -> str:
    return "".join(c for c in _NOT_LETTERS.sub("", word.lower()) if c.isalpha())


def features(word: str, lexicon: frozenset[str]) -> list[int]:
    """Buckets of a word's features, all its n-grams among them."""
    marked = f"^{word}$"
    found = [f"p{word[:i]}" for i in (1, 2, 3)] + [f"s{word[-i:]}" for i in (1, 2, 3)]
    grams = [f"g{marked[i : i + n]}" for n in (2, 3) for i in range(len(marked) - n + 1)]
    if word in lexicon:
        found.append(f"w{word}")
    return [1 + zlib.crc32(x.encode()) % (BUCKETS - 1) for x in found + grams]


def ragged(found: list[str], lexicon: frozenset[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, one after the other, and where each word's begin.

    A word without letters has bucket 0 alone, which weighs nothing.
    """
    lists = [features(word, lexicon) if word else [0] for word in found]
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    index = np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(sizes.sum()))
    return index, np.cumsum(sizes) - sizes


class Model(NamedTuple):
    """Languages, one weight a bucket and language, transition scores and the lexicon."""

    langs: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: frozenset[str]

    def emissions(self, found: list[str]) -> np.ndarray:
        """Score of each language for each word; words without letters are neutral."""
        if not found:
            return np.zeros((0, len(self.langs)), np.float32)
        index, first = ragged(found, self.lexicon)
        return np.add.reduceat(self.weights[index], first, axis=0)


def forward_backward(scores: np.ndarray, real: np.ndarray, transitions: np.ndarray, before=None, after=None):
    """Marginals (chain, place, language) and expected transitions within chains.

    scores: (chain, place, language); real: (chain, place) flags, true up to a chain's end. `before` and `after`
    (chain, language) are the messages to the first word and to the last, from what is around the chain.
    """
    n, length, k = scores.shape
    step = np.exp(transitions)
    top = scores.max(2, keepdims=True)
    local = np.exp(scores - top)
    forward, scale = np.zeros_like(local), np.ones((n, length))
    now = np.full((n, k), 1.0 / k) if before is None else before
    end = np.ones((n, k)) if after is None else after
    for t in range(length):
        new = (now if t == 0 else now @ step) * local[:, t]
        total = new.sum(1)
        new /= total[:, None]
        now = np.where(real[:, t, None], new, now)
        scale[:, t] = np.where(real[:, t], total, 1.0)
        forward[:, t] = now
    backward = np.ones_like(local)
    backward[:, -1] = end
    for t in range(length - 2, -1, -1):
        ahead = (backward[:, t + 1] * local[:, t + 1]) @ step.T / scale[:, t + 1, None]
        backward[:, t] = np.where(real[:, t + 1, None], ahead, end)
    marginals = forward * backward * real[:, :, None]
    if after is not None:
        marginals /= np.maximum(marginals.sum(2, keepdims=True), 1e-300)
    pairs = np.zeros((k, k))
    for t in range(length - 1):
        right = backward[:, t + 1] * local[:, t + 1] / scale[:, t + 1, None] * real[:, t + 1, None]
        pairs += forward[:, t].T @ right
    return marginals, pairs * step


def transfers(scores: np.ndarray, real: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """For each chain the matrix from the message to its first word to the one from its last, but for a factor."""
    step = np.exp(transitions)
    local = np.exp(scores - scores.max(2, keepdims=True))
    out = local[:, 0, :, None] * np.eye(len(step))
    for t in range(1, scores.shape[1]):
        new = (out @ step) * local[:, t, None, :]
        out = new if real[:, t].all() else np.where(real[:, t, None, None], new, out)
        if t % 8 == 0:
            out /= out.max((1, 2), keepdims=True)
    return out


def spelled(text: str) -> list[str]:
    """The units of one text."""
    raw = text.encode()
    found, _ = units(Texts(0, np.frombuffer(raw, np.uint8), np.array([0, len(raw)])))
    return [raw[a:b].decode() for a, b in zip(found.start.tolist(), found.end.tolist(), strict=True)]


def train(texts: list[tuple[str, str]], seed: int = 7) -> Model:
    """A model from (language, text) pairs, by gradient steps on the chains' likelihood."""
    langs = sorted({lang for lang, _ in texts})
    told = [(langs.index(lang), [w for w in map(letters, spelled(text)) if w]) for lang, text in texts]
    rng = np.random.default_rng(seed)
    stretches = [
        (lang, found[i : i + STRETCH]) for lang, found in told for i in range(0, len(found), STRETCH)
    ]
    rng.shuffle(stretches)
    flat = [(word, lang) for lang, found in stretches for word in found]
    counts: dict[str, int] = {}
    for word, _ in flat:
        counts[word] = counts.get(word, 0) + 1
    lexicon = frozenset(word for word, n in counts.items() if n >= LEXICON_COUNT)
    k = len(langs)
    if not flat:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros((0, 0)), lexicon)
    distinct = list(counts)
    place = {word: i for i, word in enumerate(distinct)}
    index, first = ragged(distinct, lexicon)
    sizes = np.diff(np.append(first, len(index)))
    n = -(-len(flat) // CHAIN)
    word_at, lang_at = np.zeros(n * CHAIN, np.int64), np.zeros(n * CHAIN, np.int64)
    word_at[: len(flat)] = [place[word] for word, _ in flat]
    lang_at[: len(flat)] = [lang for _, lang in flat]
    real = (np.arange(n * CHAIN) < len(flat)).reshape(n, CHAIN)
    word_at, lang_at = word_at.reshape(n, CHAIN), lang_at.reshape(n, CHAIN)
    truth = np.zeros((n, CHAIN, k))
    np.put_along_axis(truth, lang_at[:, :, None], 1.0, 2)
    truth *= real[:, :, None]
    seen = np.zeros((k, k))
    np.add.at(seen, (lang_at[:, :-1][real[:, 1:]], lang_at[:, 1:][real[:, 1:]]), 1)
    weights, transitions = np.zeros((BUCKETS, k)), np.zeros((k, k))
    square_w, square_t = np.full_like(weights, 1e-8), np.full_like(transitions, 1e-8)
    used = real.reshape(-1)
    for _ in range(STEPS):
        scores = np.add.reduceat(weights[index], first, axis=0)[word_at]
        marginals, pairs = forward_backward(scores, real, transitions)
        wrong = ((truth - marginals) / len(flat)).reshape(-1, k)[used]
        by_word = np.stack([np.bincount(word_at.reshape(-1)[used], wrong[:, j], len(distinct)) for j in range(k)], 1)
        spread = np.repeat(by_word, sizes, axis=0)
        gradient = np.stack([np.bincount(index, spread[:, j], BUCKETS) for j in range(k)], 1)
        gradient -= RIDGE * weights / len(distinct)
        change = (seen - pairs) / len(flat) - RIDGE * transitions
        square_w += gradient**2
        square_t += change**2
        weights += RATE * gradient / np.sqrt(square_w)
        transitions += RATE * change / np.sqrt(square_t)
    return Model(langs, weights.astype(np.float32), transitions, lexicon)


def sample(df: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> list[tuple[str, str]]:
    """The training texts: rows with a text and a language, chosen by a hash of key and text.

    Of a text longer than TRAIN_CHARS a piece of that length is taken, which may begin anywhere in it, by the
    hash too. Of more than TRAIN_LANGS languages those of most texts are learned. Each language's rows are drawn in
    SLOTS parts first, so no task meets more than SLOTS times TRAIN_DOCS of them.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    held = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    learned = F.broadcast(held.orderBy(F.desc("n"), "lang").limit(TRAIN_LANGS).select("lang"))
    draw = F.xxhash64("key", "text")
    begin = F.pmod(F.xxhash64(draw), F.greatest(F.char_length("text") - TRAIN_CHARS + 1, F.lit(1))).cast("int") + 1
    rows = rows.join(learned, "lang", "left_semi")
    rows = rows.select("lang", draw.alias("draw"), F.substr("text", begin, F.lit(TRAIN_CHARS)).alias("text"))
    slot = F.pmod(F.col("draw"), F.lit(SLOTS))
    drawn = rows.select("lang", "draw").distinct().withColumn("slot", slot)
    for by in (["lang", "slot"], ["lang"]):
        nth = F.row_number().over(Window.partitionBy(*by).orderBy("draw"))
        drawn = drawn.withColumn("nth", nth).where(F.col("nth") <= TRAIN_DOCS).drop("nth")
    chosen = rows.join(F.broadcast(drawn.drop("slot")), ["lang", "draw"]).groupBy("lang", "draw").agg(F.min("text").alias("text"))
    return [(row.lang, row.text) for row in sorted(chosen.collect())]


class Memory:
    """Emission scores by a word's hash, in sorted arrays; emptied when it holds too many."""

    def __init__(self, model: Model, limit: int = 1_000_000):
        self.model, self.limit = model, limit
        self.keys = np.zeros(0, np.uint64)
        self._none()

    def _none(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(self.model.langs)), np.float32)
        self.spoken = np.zeros(0, bool)

    def lookup(self, found, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of each word, and whether it has a letter."""
        distinct, first, back = np.unique(found.key, return_index=True, return_inverse=True)
        if len(self.keys) > self.limit:
            self._none()
        missing = np.ones(len(distinct), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, distinct), len(self.keys) - 1)
            missing = self.keys[at] != distinct
        if missing.any():
            raw, which = data.tobytes(), first[missing]
            spans = zip(found.start[which].tolist(), found.end[which].tolist(), strict=True)
            new = [letters(raw[a:b].decode()) for a, b in spans]
            scores = [self.model.emissions(new[i : i + 20_000]) for i in range(0, len(new), 20_000)]
            order = np.argsort(keys := np.concatenate((self.keys, distinct[missing])), kind="stable")
            self.keys = keys[order]
            self.scores = np.concatenate((self.scores, *scores))[order]
            self.spoken = np.concatenate((self.spoken, np.array([bool(w) for w in new])))[order]
        at = np.searchsorted(self.keys, distinct)[back]
        return self.scores[at], self.spoken[at]


def chain_marginals(row: np.ndarray, scores: np.ndarray, model: Model) -> np.ndarray:
    """Each word's probabilities in its whole text, worked out in chains of at most CHAIN words."""
    out = np.zeros(scores.shape, np.float64)
    place = np.arange(len(row)) - np.searchsorted(row, row)
    at = np.flatnonzero(place % CHAIN == 0)
    size = np.diff(np.append(at, len(row)))
    groups = []
    for short in (8, 16, 32, CHAIN):  # chains of like length together
        mine = np.flatnonzero((size <= short) & (size > short // 2 if short > 8 else size <= 8))
        if len(mine):
            index = at[mine][:, None] + np.arange(short)
            real = np.arange(short) < size[mine][:, None]
            groups.append((mine, np.where(real, index, 0), real))
    before, after = _messages(row[at], groups, scores, model.transitions)
    for mine, index, real in groups:
        around = before[mine], after[mine]
        marginals, _ = forward_backward(scores[index].astype(np.float64), real, model.transitions, *around)
        out[index[real]] = marginals[real]
    return out


def _messages(text: np.ndarray, groups: list, scores: np.ndarray, transitions: np.ndarray):
    """What each chain (of the texts `text`) is told by the chains before and after it in its text."""
    n, k = len(text), scores.shape[1]
    before, after = np.full((n, k), 1.0 / k), np.ones((n, k))
    nth = np.arange(n) - np.searchsorted(text, text)
    several = np.searchsorted(text, text, "right") - np.searchsorted(text, text) > 1
    if not several.any():
        return before, after
    step, through = np.exp(transitions), np.zeros((n, k, k))
    for mine, index, real in groups:
        of = several[mine]
        if of.any():
            through[mine[of]] = transfers(scores[index[of]].astype(np.float64), real[of], transitions)
    later = np.split(np.argsort(nth, kind="stable"), np.cumsum(np.bincount(nth))[:-1])[1:]
    for c in later:
        told = (before[c - 1, None] @ through[c - 1])[:, 0] @ step
        before[c] = told / told.sum(1, keepdims=True)
    for c in reversed(later):
        told = (through[c] @ after[c][:, :, None])[:, :, 0] @ step.T
        after[c - 1] = told / told.max(1, keepdims=True)
    return before, after


_SPANS = "array<struct<first:int,n:int,lang:string>>"
_SPAN_TYPE = pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("lang", pa.string())]))


def predicted(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, `lang_pred`, `score` and `spans`: runs of words (first, how many) in one language."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memory, langs = Memory(model), np.array([*model.langs, "und"], object)
        for batch in batches:
            for texts in slices(batch.column(1)):
                pred, score = np.full(texts.n, len(langs) - 1), np.zeros(texts.n)
                spans: list[list] = [[] for _ in range(texts.n)]
                found, word = units(texts)
                if len(found.key) and model.langs:
                    scores, spoken = memory.lookup(found, texts.data)
                    marginals = chain_marginals(found.row, scores, model)
                    told = found.row[spoken]
                    sums = np.stack([np.bincount(told, m, texts.n) for m in marginals[spoken].T], 1)
                    n = np.bincount(told, minlength=texts.n)
                    best = sums.argmax(1)
                    pred = np.where(n > 0, best, pred)
                    score = np.where(n > 0, np.clip(sums.max(1) / np.maximum(n, 1), 0, 1), 0.0)
                    begin = np.flatnonzero(np.diff(word, prepend=-1))
                    row, by_word = found.row[begin], np.add.reduceat(marginals, begin, axis=0)
                    at_first = np.searchsorted(row, np.arange(texts.n))
                    _fill(spans, row, by_word.argmax(1), at_first, langs)
                columns = [
                    batch.column(0).slice(texts.first, texts.n),
                    pa.array(langs[pred].tolist(), pa.string()),
                    pa.array(score, pa.float64()),
                    pa.array(spans, _SPAN_TYPE),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "lang_pred", "score", "spans"])

    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, f"key {type_of(df, key)}, lang_pred string, score double, spans {_SPANS}")
    return made.withColumnRenamed("key", key)


def _fill(spans: list[list], row: np.ndarray, label: np.ndarray, first: np.ndarray, langs: np.ndarray) -> None:
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (label[1:] != label[:-1])
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(row)))
    for r, a, n, which in zip(row[at].tolist(), (at - first[row[at]]).tolist(), size.tolist(), label[at].tolist(), strict=True):
        spans[r].append({"first": a, "n": n, "lang": langs[which]})


def held_out(key: str = "doc_id") -> Column:
    """Rows kept from training: crc32 of the key as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))
