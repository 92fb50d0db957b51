import hashlib

import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
import corpus_pipeline
from invq.llm import bpe, queries
from tests.llm import cases, test_decontaminate, test_line_dedup, test_near_dup

SF = "/root/testdata/sf0.001"


def test_run_equals_brute_force_stage_by_stage(spark):
    docs, pairs = cases.documents(spark)
    # the estimates are tested on their own; what they keep is taken from the query
    kept = {r.doc_id for r in queries.op4_quality(spark, SF).collect() if r.kept}
    pairs = [(k, t) for k, t in pairs if k in kept]
    deduplicated = test_line_dedup.brute(pairs)
    pairs = [(k, deduplicated[k][2]) for k, _ in pairs]
    of = test_near_dup.classes(pairs)
    pairs = [(k, t) for k, t in pairs if of[k] == k]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {k for k, *_ in test_decontaminate.brute(pairs, items)}
    pairs = [(k, t) for k, t in pairs if k not in dirty]
    ranks = {token: i for i, token in enumerate(bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    wanted = {k: (library.encode_ordinary(t), hashlib.sha256(t.encode()).hexdigest()) for k, t in pairs}
    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in rows} == wanted
    assert all(r.n_tokens == len(r.ids) for r in rows) and len(rows) == len(wanted)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, docs, SF)
        assert made.dtypes == docs.dtypes
    odd = cases.odd(spark)
    assert corpus_pipeline.line_dedup_stage(spark, odd, SF).columns == odd.columns
    assert corpus_pipeline.STAGES[-1][1](spark, cases.none(spark), SF).collect() == []


def test_all_are_registered():
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {name.split("_")[0] + "_" for name in names}
    assert "pipeline" in names and "op5_line_dedup" in entry.oracle_sql()
