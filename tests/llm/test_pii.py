"""Personal data against plain regular expressions, and the spans that the method adds."""

import re
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.llm import pii

SF = "/root/testdata/sf0.001"
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute(text):
    """Base spans (start, end, kind) by start, then kind."""
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((m.start(), m.end(), order, kind))
    return [(s, e, k) for s, e, _, k in sorted(out, key=lambda x: (x[0], x[2]))]


def base(text):
    return [(s, e, k) for s, e, k, _ in pii.find(text) if k in pii.BASE]


CASES = [
    "", "@", "a@b", "a@b.c", "a@b.c@d.e", "x.y@z.w.", "a@@b.c", "%@a..b", "1.2.3.4.5.6.7.8", "0001.002.0255.256 1.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "4111111111111111 4111111111111111", "+1 (555) 123-4567", "+49 30 1234567890123456", "++1 234 567 890", "é +1 234 567 890 ü a@b.co", "1" * 400, "1." * 300, "a" * 300 + "@b.c",
]


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert base(text) == brute(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="1234567890.-+ ()@ab%é", max_size=60))
def test_any_text(text):
    assert base(text) == brute(text)


def test_long_texts_are_linear():
    for text in ("1" * 2_000_000, "1 " * 1_000_000, "a" * 2_000_000, "1." * 1_000_000, "a@" * 1_000_000):
        pii.find(text)


def test_added_kinds_need_a_checksum_or_a_word_nearby():
    kinds = lambda t: [k for _, _, k, _ in pii.find(t) if k not in pii.BASE]
    assert kinds("IBAN DE89 3704 0044 0532 0130 00") == ["iban"]
    assert kinds("IBAN DE88 3704 0044 0532 0130 00") == []
    assert kinds("my social security number is 123-45-6789") == ["ssn"]
    assert kinds('password = "abcdefghijkl1234"') == ["secret"]
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB83WEST12345698765432")


def test_context_is_of_whole_words():
    assert pii.score("ip", "a ship at ", 10) == pii.PRIOR["ip"] and pii.score("phone", "the hotel ", 10) == pii.PRIOR["phone"]
    assert pii.score("ip", "the IPs: ", 9) > pii.PRIOR["ip"] > pii.score("ip", "version ", 8)
    assert pii.find("insecurity of 123-45-6789") == [] and pii.find("ssn 000-00-0000") == []
    assert [k for *_, k, _s in pii.find("ssn 123-45-6789")] == ["ssn"]


def test_context_raises_the_score():
    (_, _, _, plain), = pii.find("see 10.0.0.1")
    (_, _, _, near), = pii.find("the server address 10.0.0.1")
    assert near > plain


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = pii.op1_pii(spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == sha256(",".join(f"{k}:{s}:{e}" for s, e, k in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for _, _, k in want) for kind in BASE]
        assert {f"{k}:{s}:{e}" for s, e, k in want} <= set(r.spans.split(","))


def test_nulls_repeated_rows_and_other_columns(spark):
    rows = [(1, None, "x"), (2, "", "x"), (3, "a@b.co", "y"), (3, "a@b.co", "y"), (None, "1.1.1.1", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = pii.scan(docs.select("doc_id", "text")).collect()
    assert sorted((r.doc_id or 0, len(r.found)) for r in got) == [(0, 1), (1, 0), (2, 0), (3, 1), (3, 1)]
    assert {r.text for r in pii.redact(docs).collect()} == {None, "", "[email]", "[ip]"}
    assert pii.redact(docs).columns == docs.columns
    assert pii.scan(docs.where("false")).count() == 0
