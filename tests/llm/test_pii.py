import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from dialectic.llm import pii
from tests.llm.helpers import docs

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text):
            s, d = m.group(), re.sub(r"[^0-9]", "", m.group())
            if kind == "ip" and any(int(x) > 255 for x in s.split(".")):
                continue
            if kind == "card" and not (13 <= len(d) <= 19 and sum(
                    int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10
                    for i, c in enumerate(reversed(d))) % 10 == 0):
                continue
            if kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ09.@+- ()%_é\n256", max_size=60))
def test_base_spans_match_the_plain_patterns(text):
    assert [x[:3] for x in pii.find_spans(text) if x.kind in PATTERNS] == plain_base(text)


def test_base_spans_on_planted_text():
    rnd = random.Random(2)
    parts = ["x.y@mail.example.com", "a@b.c@d.e", "10.0.0.256", "1.2.3.4.5.6.7.8", "4111 1111 1111 1111",
             "4111-1111-1111-1112", "+1 (988) 555-2485", "+12", "é@é.com", "9" * 25, "000255.1.1.1"]
    for _ in range(200):
        text = "".join(rnd.choice(parts) + rnd.choice([" ", ", ", "", "ü"]) for _ in range(12))
        assert [x[:3] for x in pii.find_spans(text) if x.kind in PATTERNS] == plain_base(text)


def test_validators_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")
    kinds = [s.kind for s in pii.find_spans("IBAN DE89 3704 0044 0532 0130 00, SSN 123-45-6789")]
    assert kinds == ["iban", "ssn"]
    assert pii.find_spans("code 123-45-6789 and DE88370400440532013000") == []
    assert [s.kind for s in pii.find_spans("call 555 123 4567")] == ["tel"]
    assert pii.find_spans("5th item 555 123 4567 of the list") == []


def test_long_runs_stay_linear():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" + "(" * 300_000, "@" * 300_000, "a." * 150_000):
        pii.find_spans(text)


def test_rows(spark):
    texts = [None, "", "mail a@b.co now", "mail a@b.co now", "é 1.2.3.4"]
    d = docs(spark, texts, [None, 1, 2, 2, 3]).withColumnRenamed("source", "found")
    got = {(r.doc_id, r.spans): r for r in pii.digests(pii.detect(d)).collect()}
    assert len(got) == 4
    r = got[(3, "ip:2:9")]
    assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (0, 1, 0, 0)
    assert r.base_sha256 == hashlib.sha256(b"ip:2:9").hexdigest() == pii.base_digest("é 1.2.3.4")
    out = pii.redact_documents(d)
    assert out.columns == d.columns and out.schema == d.schema
    assert sorted(((r.text, r.n_chars) for r in out.collect()), key=str) == sorted(
        [(None, None), ("", 0), ("mail [EMAIL] now", 16), ("mail [EMAIL] now", 16), ("é [IP]", 6)], key=str)
    assert pii.detect(docs(spark, [])).count() == 0


def test_ibans_before_upper_case_words_and_digits():
    iban, british = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"
    for text, want in [(f"{iban} EUR", [iban]), (f"{iban} BIC COBADEFF", [iban]), (f"{iban} 2024 X", [iban]),
                       (f"{iban} {british} {iban}", [iban, british, iban]), (f"AB12 XYZ 1234 FOO BAR {iban} A", [iban]),
                       (f"{iban}9 EUR", []), ("DE88 3704 0044 0532 0130 00 EUR", [])]:
        assert [text[s.start:s.end] for s in pii.find_spans(text) if s.kind == "iban"] == want, text
    assert pii.redact(f"pay {iban} EUR", pii.find_spans(f"pay {iban} EUR")) == "pay [IBAN] EUR"
    pii.find_spans("AB12 " * 60_000)
