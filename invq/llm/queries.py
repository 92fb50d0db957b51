"""Registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, checks, conversations, decontaminate, langid, line_dedup, manifest, near_dup, pii, quality, sharding, substring, token_counts, token_files
from .common import written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = bpe.round_trip(
        documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )
    return made.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = quality.statistics(documents(spark, sf_dir), keep=["doc_id", "lang", "source"])
    vectors = written(quality.prepared(stats), "quality")
    return quality.judged(vectors, quality.fit(vectors)).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("distance", 6).alias("distance"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = substring.remove_repeats(documents(spark, sf_dir))
    return made.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op7_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.found(documents(spark, sf_dir), benchmark)


#: The id that ends each document in the token files.
END_ID = 2


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_files.read(files)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"n_{kind}" for kind in pii.KINDS]
    made = pii.found(documents(spark, sf_dir))
    return made.select("doc_id", *counts, F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.sharded(documents(spark, sf_dir))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(langid.sample(docs.where(~langid.held_out())))
    made = langid.predicted(docs.select("doc_id", "text"), model)
    return made.select(
        "doc_id",
        langid.held_out().alias("held_out"),
        "lang_pred",
        "score",
        F.greatest(F.size("spans") - 1, F.lit(0)).cast("long").alias("n_switches"),
    )


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = line_dedup.deduplicated(documents(spark, sf_dir).select("doc_id", "text"))
    kept = F.sha2(F.coalesce("kept", F.lit("")), 256)
    return made.select("row.doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role and text after the damage that the query's contract names."""
    space = F.lit(" ")
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), space) for c in ("conv_id", "turn")])
    fate = F.crc32(name) % 20
    role, text = F.coalesce("role", space), F.coalesce("text", space)
    bare = F.regexp_replace(text, "[.!?]", "")
    copies = F.when(fate == 0, 0).when(fate == 3, 2).otherwise(1)
    rows = rows.select(
        "conv_id",
        "turn",
        F.when(fate == 4, "user").otherwise(role).alias("role"),
        F.when(fate == 1, "").when(fate == 2, bare).otherwise(text).alias("text"),
        F.explode(F.array_repeat(F.lit(0), copies)).alias("copy"),
    )
    return rows.drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.judged(damaged(rows), rows)


#: What a leaf of the manifest covers, in this order.
MANIFEST_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of all rows, held against rows of which every fifth, by hash, has lost its capital letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fifth = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    text = F.when(fifth, F.translate("text", letters, letters.lower())).otherwise(F.col("text"))
    claims = [text if f == "text" else F.col(f) for f in MANIFEST_FIELDS]
    rows = manifest.leaves_of(documents(spark, sf_dir), MANIFEST_FIELDS, claims, "doc_id", "source")
    made = manifest.proven(rows)

    def shown(name: str):
        return F.lower(F.hex(name))

    return made.select(
        F.col("key").alias("doc_id"),
        *[shown(c).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(shown("siblings"), 256).alias("proof_sha256"),
        shown("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a cache of its own, so that every distinct text is encoded here."""
    return token_counts.counted(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


OP5_SQL = r"""
with lines as (
  select doc_id, unnest(range(len(parts))) as line, unnest(parts) as body
  from (select doc_id, string_split(text, chr(10)) as parts from documents)
), sets as (
  select doc_id, line, list_sort(list_distinct(list_filter(
    regexp_split_to_array(body, '[\x09-\x0D ]+'), lambda w: w <> ''))) as words
  from lines
), firsts as (
  select words, len(words) as n, min({'doc': doc_id, 'line': line}) as first,
         row_number() over () as id
  from sets where len(words) > 0 group by words
), wide as (
  select id, n, first, unnest(words) as word from firsts where n >= 9
), counted as (
  select word, count(*) as often from wide group by word
), ranked as (
  select id, n, first, word,
         row_number() over (partition by id order by often, word) as place
  from wide join counted using (word)
), prefixes as (
  select * from ranked where place <= n - cast(ceil(n * 90 / 100.0) as int) + 1
), candidates as (
  select distinct a.id as id, b.id as other
  from prefixes a join prefixes b on a.word = b.word and b.first < a.first
    and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
), gone as (
  select distinct c.id
  from candidates c join firsts a on a.id = c.id join firsts b on b.id = c.other
  where 190 * len(list_intersect(a.words, b.words)) >= 90 * (a.n + b.n)
), judged as (
  select s.doc_id, s.line, l.body,
         f.id is not null and (f.first <> {'doc': s.doc_id, 'line': s.line} or g.id is not null) as removed
  from sets s join lines l using (doc_id, line)
  left join firsts f on f.words = s.words left join gone g on g.id = f.id
)
select d.doc_id, count(j.line) as n_lines, count(*) filter (where j.removed) as n_removed,
       sha256(coalesce(string_agg(j.body, chr(10) order by j.line) filter (where not j.removed), '')) as kept_sha256
from documents d left join judged j using (doc_id) group by d.doc_id
"""


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_quality": op4_quality,
    "op5_line_dedup": op5_line_dedup,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_near_dup": op7_near_dup,
    "op8_token_files": op8_token_files,
    "op9_pii": op9_pii,
    "op10_sharding": op10_sharding,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_manifest": op12_manifest,
    "op13_token_counts": op13_token_counts,
}
ORACLES: dict[str, str] = {
    "op5_line_dedup": OP5_SQL,
    "op11_conversation_repair": checks.OP11_CONVERSATIONS,
    "op12_manifest": checks.OP12_MANIFEST,
}
