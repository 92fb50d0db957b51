"""Line dedup: an exact set-similarity join of lines, in DataFrame operations alone.

A line is the set of its words. Lines with equal sets are one entry, that of the first of them. Words are
ordered by rarity (counts of all lines' words in a fixed number of hash buckets, then by hash), and two
sets of similarity t can only meet if they share one of the n - ceil(t n) + 1 rarest words of each: the
prefix filter. Pairs that share a prefix word must also agree in length (t n <= m) and have enough
words left behind the shared one (positional filter). Bitmaps of the words rule out most of what remains, and the rest is verified by
Jaccard similarity of the words themselves.

A line is removed if an earlier one, in order of key and line, is as similar as the threshold asks,
whether that one is kept or not. One such line is enough, so where a share of all lines has a prefix word, each
is first held against those of the least key among them; only lines that are not removed by that
are held against all earlier ones. Thousands of variants of one line cost a comparison or a few each.

A set is named by the place of its first line: prefixes and pairs carry it, so neither order nor words need a join by set.

Words and sets are known by 64-bit hashes. Defined results: lines without a word are kept; a null text
stays null and has no lines; rows equal in key and text are one document (neither removes the other's lines);
null keys come first. Columns other than the text are unchanged.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SENT_ROWS, written

#: Jaccard similarity in hundredths.
THRESHOLD = 90
#: A word in the prefixes of more than one of so many different lines is common: those go by the least key first.
COMMON = 10_000
#: Hash buckets in which words are counted: the size of what every task is sent.
COUNTED = 1 << 17
_SPACE = r"[\x09-\x0D ]+"
#: Where a line is: key, hash of the text, number of the line. Places are in the order of lines.
_PLACE = ["doc", "print", "line"]


#: Bits of a word's hash; the bits above hold its rarity.
_HASHED = 53
_NO_WORD = "xxhash64('')"


def _parts(text: Column, lines: bool = True) -> Column:
    """The words of a text of lines or of one, and empty strings among them. Splitting at one character is the cheap case."""
    other = [text.contains(space) for space in "\t\x0b\x0c\r"]  # a search for each is cheaper than one expression
    plain = F.replace(text, F.lit("\n"), F.lit(" ")) if lines else text
    return F.when(other[0] | other[1] | other[2] | other[3], F.split(text, _SPACE)).otherwise(F.split(plain, " "))


def _words(line: Column) -> Column:
    """Hashes of the words of a line, each once."""
    return F.array_remove(F.array_distinct(F.transform(_parts(line, lines=False), lambda w: F.xxhash64(w))), F.expr(_NO_WORD))


def _identified(df: DataFrame, key: str, text: str) -> DataFrame:
    """doc and print name a row: its key and a hash of its text."""
    doc = F.coalesce(F.col(key).cast("bigint"), F.lit(-(1 << 63)))
    return df.select(doc.alias("doc"), F.xxhash64(text).alias("print"), F.col(text).alias("text"))


def _bucket(word: Column) -> Column:
    return word.bitwiseAND(F.lit(COUNTED - 1)).cast("int")


def _rarities(rows: DataFrame) -> Column:
    """How often words of each bucket occur, as 16 times the binary logarithm: a constant of COUNTED small numbers.

    The driver keeps the text of every plan, constants included, for as long as it tells of the query: hence not as
    the bits above a hash's, and not a row object a bucket.
    """
    met = rows.select(F.explode(_parts(F.col("text"))).alias("word")).groupBy(_bucket(F.xxhash64("word")).alias("bucket"))
    n = met.agg(F.count(F.lit(1)).alias("n")).select("bucket", F.round(16 * F.log2(F.col("n"))).cast("smallint").alias("n"))
    made, level = n.toArrow(), np.zeros(COUNTED, np.int16)
    level[made["bucket"].to_numpy()] = made["n"].to_numpy()
    return F.from_json(F.lit(str(level.tolist()).replace(" ", "")), "array<smallint>")


def _ceil(part: Column, whole: int) -> Column:
    return F.floor((part + (whole - 1)) / whole).cast("int")


def _bitmap(words: Column) -> Column:
    """64 bits, of which every word turns one: long sets don't fill them."""

    def with_bit(seen: Column, word: Column) -> Column:
        bit = word.bitwiseAND(F.lit(63)).cast("int")
        return seen.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), bit))

    return F.aggregate(words, F.lit(0).cast("bigint"), with_bit)


def _prefixes(rows: DataFrame, rarities: Column, threshold: int) -> DataFrame:
    """Per line with a word: id and size of its set, its prefix in order of rarity, and a bitmap of its words."""

    def ranked(word: Column) -> Column:
        level = F.coalesce(F.get(rarities, _bucket(word)), F.lit(0).cast("smallint"))  # never null: sorted as plain numbers
        return F.shiftleft(level.cast("bigint"), _HASHED).bitwiseOR(word.bitwiseAND(F.lit((1 << _HASHED) - 1)))

    split = rows.where("text is not null").select("doc", "print", F.posexplode(F.split("text", "\n")).alias("line", "body"))
    worded = split.where(F.col("body").rlike(r"[^\x09-\x0D ]"))  # asked of the text: words would be split twice
    hashed = worded.select("doc", "print", "line", _words(F.col("body")).alias("hashes"))
    # each once, none empty, the rarest first; what is around a lambda is compiled, what is in it is not
    ordered = F.sort_array(F.transform("hashes", ranked)).alias("words")
    ordered = hashed.select("doc", "print", "line", F.size("hashes").alias("n"), ordered)
    n = F.col("n")
    long_enough = (100 - threshold) * n >= threshold  # else no other set is similar enough
    return ordered.select(
        "doc",
        "print",
        "line",
        F.xxhash64("words").alias("id"),
        "n",
        F.when(long_enough, F.slice("words", F.lit(1), n - _ceil(threshold * n, 100) + 1)).alias("prefix"),
        F.when(long_enough, _bitmap(F.col("words"))).alias("bits"),
    )


def _pairs(later: DataFrame, earlier: DataFrame, threshold: int) -> DataFrame:
    """Pairs of a set and an earlier one (places `at` and `other`) that share a prefix word and pass all filters.

    Every word in only one of two sets changes at most one bit of the bitmaps, so the bits that
    differ bound those words from below and the shared ones from above.
    """
    a, b = later.alias("a"), earlier.alias("b")
    n, m = F.col("a.n"), F.col("b.n")
    sizes = 100 * F.least(n, m) >= threshold * F.greatest(n, m)
    ahead = F.least(n - F.col("a.nth"), m - F.col("b.nth"))
    enough = (100 + threshold) * ahead >= threshold * (n + m)
    apart = F.bit_count(F.col("a.bits").bitwiseXOR(F.col("b.bits")))
    room = (100 + threshold) * (n + m - apart) >= 2 * threshold * (n + m)
    order = F.col("b.line") < F.col("a.line")
    for c in ("print", "doc"):
        order = (F.col(f"b.{c}") < F.col(f"a.{c}")) | ((F.col(f"b.{c}") == F.col(f"a.{c}")) & order)
    met = a.join(b, (F.col("a.word") == F.col("b.word")) & sizes & enough & room & order)
    return met.select(*[F.col(f"a.{c}").alias(c) for c in _PLACE], *[F.col(f"b.{c}").alias(f"other_{c}") for c in _PLACE])


def _similar(pairs: DataFrame, rows: DataFrame, threshold: int, few: bool = False) -> DataFrame:
    """Places of the sets that have an earlier similar one among their pairs. few: texts of few lines are expected."""
    others = [f"other_{c}" for c in _PLACE]
    pairs = written(pairs.distinct(), "line-pairs")
    needed = pairs.select(*_PLACE).union(pairs.select(*others)).distinct()
    needed = written(needed, "line-places") if few else needed
    wanted = needed.groupBy("doc", "print").agg(F.collect_list("line").alias("wanted"))
    bodies = rows.join(F.broadcast(wanted) if few and needed.count() <= SENT_ROWS else wanted, ["doc", "print"])
    bodies = bodies.select("doc", "print", F.split("text", "\n").alias("lines"), F.explode("wanted").alias("line"))
    bodies = bodies.select(*_PLACE, F.get("lines", F.col("line")).alias("body")).dropDuplicates(_PLACE)
    made = written(bodies.select(*_PLACE, _words(F.col("body")).alias("words")), "line-words")
    left = made.withColumnRenamed("words", "words_a")
    right = made.select(*[F.col(c).alias(f"other_{c}") for c in _PLACE], F.col("words").alias("words_b"))
    both = pairs.join(left, _PLACE).join(right, others)
    shared = F.size(F.array_intersect("words_a", "words_b"))
    enough = (100 + threshold) * shared >= threshold * (F.size("words_a") + F.size("words_b"))
    return written(both.where(enough).select(*_PLACE).distinct(), "lines-gone")


def _sets(table: DataFrame) -> DataFrame:
    """Per set of words: id, number and place of its lines and first line, and what is known of its words."""
    known = [F.any_value(c).alias(c) for c in ("n", "prefix", "bits")]
    made = table.groupBy("id").agg(F.min(F.struct(*_PLACE)).alias("first"), F.count(F.lit(1)).alias("lines"), *known)
    return made.select("id", "first.*", "lines", "n", "prefix", "bits")


def _gone(sets: DataFrame, rows: DataFrame, threshold: int) -> DataFrame:
    """Places of the sets that have an earlier similar one."""
    entries = sets.where("prefix is not null")
    entries = entries.select(*_PLACE, "n", "bits", F.posexplode("prefix").alias("nth", "word"))
    shared = entries.groupBy("word").agg(F.min("doc").alias("least"), F.count(F.lit(1)).alias("met"))
    common = written(shared.where(F.col("met") > sets.count() / COMMON).select("word", "least"), "line-common")
    words = common.count()
    if not words:
        return _similar(_pairs(entries, entries, threshold), rows, threshold)
    common = F.broadcast(common) if words <= SENT_ROWS else common
    rare = entries.join(common, "word", "left_anti")
    common = written(entries.join(common, "word"), "line-prefixes")
    gone = _similar(_pairs(common, common.where("doc = least"), threshold), rows, threshold, few=True)
    others = _pairs(common.join(gone, _PLACE, "left_anti"), common.where("doc > least"), threshold)
    return gone.union(_similar(others.union(_pairs(rare, rare, threshold)), rows, threshold))


def removed_lines(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """doc, print and `removed`: the numbers (from 0) of the lines to remove from the rows that have any."""
    rows = _identified(df, key, text)
    table = written(_prefixes(rows, _rarities(rows), threshold), "lines")
    sets = written(_sets(table), "line-sets")
    gone = _gone(sets, rows, threshold)
    first = sets.where("lines > 1").select("id", F.struct(*_PLACE).alias("first"))
    again = table.select("id", *_PLACE).join(first, "id").where(F.col("first") != F.struct(*_PLACE)).select(*_PLACE)
    lost = again.union(gone).groupBy("doc", "print").agg(F.collect_set("line").alias("removed"))
    return written(lost, "lines-removed")


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The rows of `df`, as struct `row`, with `kept` (the text without its removed lines), n_lines, n_removed."""
    removed = removed_lines(df, key, text, threshold)
    rows, body = df.select(F.struct("*").alias("row")), F.col("row")[text]
    doc = F.coalesce(F.col("row")[key].cast("bigint"), F.lit(-(1 << 63)))
    rows = rows.withColumn("doc", doc).withColumn("print", F.xxhash64(body))
    joined = rows.join(removed, ["doc", "print"], "left").withColumn("lines", F.split(body, "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("removed"))
    kept = F.when(F.col("removed").isNull(), body).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    )
    return joined.select(
        "row",
        kept.alias("kept"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("removed"), F.lit(0)).cast("bigint").alias("n_removed"),
    )
