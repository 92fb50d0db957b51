import itertools
import zlib

import numpy as np
import pytest

from invq.llm import langid as L
from invq.llm import queries
from tests.llm import cases


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    scores, transitions = rng.normal(size=(2, 4, 3)), rng.normal(size=(3, 3))
    real = np.array([[True] * 4, [True, True, True, False]])
    marginals, pairs = L.forward_backward(scores, real, transitions)
    both = np.zeros((3, 3))
    for c, length in enumerate((4, 3)):
        weight, total = np.zeros((4, 3)), 0.0
        moves = np.zeros((3, 3))
        for path in itertools.product(range(3), repeat=length):
            steps = list(zip(path, path[1:], strict=False))
            p = np.exp(sum(scores[c, t, s] for t, s in enumerate(path)) + sum(transitions[a, b] for a, b in steps))
            total += p
            for t, s in enumerate(path):
                weight[t, s] += p
            for a, b in steps:
                moves[a, b] += p
        assert np.allclose(marginals[c], weight / total)
        both += moves / total
    assert np.allclose(pairs, both)


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return L.train(L.sample(docs.where(~L.held_out())))


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op2_language_id(spark, sf).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_switches_within_a_text_are_found(spark, model):
    docs, _ = cases.documents(spark)
    words = {lang: [] for lang in ("en", "de")}
    for r in docs.where("lang in ('en', 'de') and n_chars > 400").collect():
        words[r.lang] += [w for w in cases.split(r.text)[:60] if L.letters(w)]
    text = " ".join(words["en"][:30] + words["de"][:30])
    row = L.predicted(cases.table(spark, [(1, text)]), model).first()
    right = sum(
        (s.lang == "en") == (i < 30) for s in row.spans for i in range(s.first, s.first + s.n)
    )
    assert right >= 55 and len(row.spans) <= 5


def test_edges(spark, model):
    rows = L.predicted(cases.odd(spark), model).collect()
    assert len(rows) == len(cases.ROWS)
    for r in rows:
        und = r.doc_id in (3, 4, 5, 9)
        assert (r.lang_pred == "und") == und and (r.score == 0.0) == und
    digits = L.predicted(cases.table(spark, [(1, "12 34 !!"), (2, "_ 5")]), model).collect()
    assert {(r.lang_pred, r.score) for r in digits} == {("und", 0.0)}
    assert L.predicted(cases.none(spark), model).collect() == []
    empty = L.train(L.sample(cases.none(spark)))
    assert [r.lang_pred for r in L.predicted(cases.table(spark, [(1, "some words")]), empty).collect()] == ["und"]


def test_sample_is_bounded_and_leaves_the_key_out(spark, monkeypatch):
    monkeypatch.setattr(L, "TRAIN_DOCS", 5)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = L.sample(docs)
    assert len(texts) <= 5 * 4 and {lang for lang, _ in texts} == {"de", "en", "es", "fr"}
    assert all(len(text) <= L.TRAIN_CHARS for _, text in texts)


def test_all_ngrams_of_a_word_are_features():
    word = "donaudampfschifffahrt"
    have = set(L.features(word, frozenset()))
    grams = [f"^{word}$"[i : i + n] for n in (2, 3) for i in range(len(word) + 3 - n)]
    assert all(1 + zlib.crc32(f"g{g}".encode()) % (L.BUCKETS - 1) in have for g in grams)


def test_runs_without_spaces_are_cut_into_overlapping_units():
    for run in ("今天天气很好我们一起去公园散步吧", "วันนี้อากาศดีมากเราไปเดินเล่นกัน", "𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇𠀈𠀉", "abc" * 100):
        pieces = L.spelled(f"some {run} words")
        assert pieces[0] == "some" and pieces[-1] == "words" and max(map(len, pieces)) <= L.UNIT + 2
        assert "".join(p[2:] if i else p for i, p in enumerate(pieces[1:-1])) == run
    assert L.spelled("Rindfleischetikettierungsgesetz हिन्दुस्तानियों 한국어문장입니다요") == [
        "Rindfleischetikettierungsgesetz", "हिन्दुस्तानियों", "한국어문장입니다요"
    ]


def test_the_middle_of_a_run_without_spaces_decides(spark):
    rng = np.random.default_rng(3)
    letters = {"aa": "今天气很好我们一起去公园散步", "bb": "あいうえおかきくけこさしすせそ"}

    def run(lang, n):
        return "".join(rng.choice(list(letters[lang]), n))

    model = L.train([(lang, run(lang, 200)) for lang in letters for _ in range(20)])
    edge = run("bb", 12)
    pairs = [(1, edge + run("aa", 120) + edge), (2, run("aa", 5)), (3, f"{run('bb', 60)} {run('aa', 60)}")]
    got = {r.doc_id: r for r in L.predicted(cases.table(spark, pairs), model).collect()}
    assert got[1].lang_pred == "aa" and got[2].lang_pred == "aa" and 0.7 < got[1].score < 0.95
    assert [(s.first, s.n, s.lang) for s in got[3].spans] == [(0, 1, "bb"), (1, 1, "aa")]


def test_messages_pass_between_the_chains_of_a_text():
    rng = np.random.default_rng(8)
    sizes = [150, 3, 64, 65, 400, 129]
    row = np.repeat(np.arange(len(sizes)), sizes)
    scores, transitions = rng.normal(size=(len(row), 3)), rng.normal(size=(3, 3)) * 2
    got = L.chain_marginals(row, scores, L.Model(["a", "b", "c"], np.zeros((1, 3)), transitions, frozenset()))
    for r, n in enumerate(sizes):
        whole, _ = L.forward_backward(scores[row == r][None], np.ones((1, n), bool), transitions)
        assert np.allclose(got[row == r], whole[0])


def test_a_language_of_long_texts_is_learned(spark):
    long = [(100 + i, "kala maja vesi " * 1000 + str(i), "et") for i in range(3)]
    short = [(i, f"some plain words {i}", "en") for i in range(20)]
    texts = L.sample(spark.createDataFrame(long + short, "doc_id long, text string, lang string"))
    assert {lang for lang, _ in texts} == {"en", "et"} and all(len(text) <= L.TRAIN_CHARS for _, text in texts)
    row = L.predicted(cases.table(spark, [(1, "vesi maja kala")]), L.train(texts)).first()
    assert row.lang_pred == "et"


def test_pieces_come_from_anywhere_and_languages_are_bounded(spark, monkeypatch):
    """Pieces of long texts begin all over them; of many languages those with most texts are learned."""
    monkeypatch.setattr(L, "TRAIN_CHARS", 400)
    monkeypatch.setattr(L, "TRAIN_LANGS", 2)
    long = [(i, " ".join(f"{n:05d}" for n in range(1000)) + f" {i}", "aa") for i in range(40)]
    rows = long + [(100 + i, f"text {i}", "bb") for i in range(30)] + [(200 + i, f"one {i}", f"c{i}") for i in range(20)]
    texts = L.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert {lang for lang, _ in texts} == {"aa", "bb"}
    pieces = [text for lang, text in texts if lang == "aa"]
    begins = sorted(int(text.split()[1]) for text in pieces)
    assert all(len(text) == 400 for text in pieces) and len(pieces) == 40
    assert begins[0] < 250 and begins[-1] > 700 and len(set(begins)) > 20


def test_equal_rows_are_drawn_once(spark):
    same = [(None, "the same words", "en")] * 500
    docs = spark.createDataFrame(same + [(i, f"other words {i}", "en") for i in range(300)], "doc_id long, text string, lang string")
    texts = L.sample(docs)
    assert len(texts) == L.TRAIN_DOCS == len(set(texts))
