import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from invq.llm import pii, queries
from tests.llm import cases


def luhn(digits):
    total = 0
    for i, c in enumerate(digits[::-1]):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits(text):
    return re.sub(r"[^0-9]", "", text)


RULES = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
    (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
)


def brute(text):
    return [(k, *m.span()) for k, (p, ok) in enumerate(RULES) for m in re.finditer(p, text or "") if ok(m.group())]


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1204@.+- ()x%é", max_size=60))
def test_fixed_forms_equal_the_patterns(text):
    assert pii.base_spans(text) == brute(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from(["10.0.0.1", "1.2.3.4.5", "300.1.1.1", "a.b@c-d.org", "@x@y.z", "+1 (555) 555-0100",
                                 "4111 1111 1111 1111", "4111111111111112", " ", ".", "x"]), max_size=8))
def test_forms_side_by_side(parts):
    assert pii.base_spans("".join(parts)) == brute("".join(parts))


def test_long_runs_take_linear_time():
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "1." * 100_000) is not None


def spelled(spans):
    return ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)


def test_query_equals_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(spelled(spans).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in range(4)]
        assert set(spelled(spans).split(",")) <= set(r.spans.split(","))


def test_contexts_of_seeds_discover_unseen_identifiers(spark):
    pairs = [(i, f"please dial extension +1 (555) 555-{1000 + i} during office hours") for i in range(12)]
    pairs.append((50, "please dial extension 555-0199 during office hours"))
    pairs.append((51, "parcel number 555-0198 has left the depot"))
    rows = {r.doc_id: r for r in pii.found(cases.table(spark, pairs)).collect()}
    assert rows[50].spans == "phone:22:30" and rows[50].n_phone == 0 and rows[50].base_spans == ""
    assert rows[51].spans == ""
    assert all(rows[i].spans == rows[i].base_spans != "" for i in range(12))


def test_a_context_of_mixed_company_finds_nothing(spark):
    pairs = [(i, f"see entry +1 (555) 555-{1000 + i} below for more") for i in range(5)]
    pairs += [(20 + i, f"see entry 77{i}-{i}{i}{i} below for more") for i in range(9)]
    assert all(r.spans == r.base_spans for r in pii.found(cases.table(spark, pairs)).collect())


def test_edges(spark):
    rows = pii.found(cases.odd(spark)).collect()
    texts = {r[0]: r[1] for r in cases.ROWS}
    assert len(rows) == len(cases.ROWS)
    for r in rows:
        assert r.spans == r.base_spans == spelled(brute(texts[r.doc_id]))
    assert pii.found(cases.none(spark)).collect() == []


def test_contexts_discover_numbers_in_groups_and_of_any_length(spark):
    pairs = [(i, f"please dial extension +1 (555) 555-{1000 + i} during office hours") for i in range(60)]
    odd = ["020 7946 0958", "555 0199", "(020) 7946-0958", "1234 5678 9012 3456", "020 7946 - 0958", "9" * 70, "42"]
    pairs += [(100 + i, f"please dial extension {x} during office hours") for i, x in enumerate(odd)]
    pairs += [(200, "parcel number 020 7946 0957 has left the depot")]
    rows = {r.doc_id: r for r in pii.found(cases.table(spark, pairs)).collect()}
    for i, x in enumerate(odd):
        begin = 22 + x.startswith("(")
        assert rows[100 + i].spans == f"phone:{begin}:{22 + len(x)}" and rows[100 + i].base_spans == "", x
    assert rows[200].spans == ""


def test_runs_of_groups_end_where_the_number_ends():
    def runs(text):
        return [text[p["start"] : p["end"]] for p in pii.occurrences(text, pii.base_spans(text)) if " " in text[p["start"] : p["end"]]]

    assert runs("x12 345 678, 90 12; (1) 2") == ["345 678", "90 12", "1) 2"]
    assert runs("12\n34 a 5 - b 6 \u0663\u0664") == ["6 \u0663\u0664"]
    assert runs("12 10.0.0.1 34") == []


def test_long_values_that_begin_alike_are_different():
    values = {p["value"] for end in "12" for p in pii.occurrences("7" * 300 + end, [])}
    assert len(values) == 2


def test_digits_of_other_scripts_need_no_ascii_digit(spark):
    pairs = [(i, f"please dial extension +1 (555) 555-{1000 + i} during office hours") for i in range(12)]
    pairs.append((50, "please dial extension \u0665\u0665\u0665-\u0660\u0661\u0669\u0669 during office hours"))
    rows = {r.doc_id: r for r in pii.found(cases.table(spark, pairs)).collect()}
    assert rows[50].spans == "phone:22:30" and rows[50].base_spans == ""
