"""Personal data: patterns propose spans, validators confirm, context adjusts."""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialectic.llm.frames import free_name, slices, texts

# --- fixed values: base kinds, in the order of the digests, then added kinds
BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn", "tel")
# ---------------------------------------------------------------------------
_ORDER = {k: i for i, k in enumerate(BASE_KINDS + ADDED_KINDS)}

# The possessive forms accept the same spans as the plain ones but never retry
# inside a run, so long runs stay linear.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_TEL = re.compile(r"(?<![0-9+(])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

#: Letters and digits of an account number by country (ISO 13616 registry).
IBAN_LENGTH = {c: n for n, countries in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
    21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
    24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC",
    33: "RU"}.items() for c in countries.split()}
#: Characters on either side in which context words count.
CONTEXT_CHARS = 40
#: Score without context, score that a context word adds, least score of an added span.
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "tel": 0.3}
CONTEXT_GAIN = 0.4
LEAST_SCORE = 0.6
CONTEXT_WORDS = {
    "email": {"mail", "email", "contact", "correo", "courriel"},
    "ip": {"ip", "address", "host", "server", "adresse"},
    "card": {"card", "visa", "mastercard", "credit", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "téléphone"},
    "iban": {"iban", "account", "bank", "konto", "cuenta", "compte"},
    "ssn": {"ssn", "social", "security"},
    "tel": {"phone", "tel", "call", "mobile", "fax", "telefon", "telefono", "teléfono", "téléphone"},
}


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Luhn checksum of a digit string."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 13616 check: the rearranged number is 1 modulo 97."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses: the local part is the run of its
    characters before each ``@``, cut at the previous match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def base_candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of the four base kinds whose validator holds."""
    if "@" in text:
        for start, end in _emails(text):
            yield "email", start, end
    if not _DIGIT.search(text):
        return
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m.group())) <= 15:
                yield "phone", m.start(), m.end()


def _iban_end(span: str) -> int:
    """Where the number at the start of ``span`` ends, or 0: at the word end at
    its country's length, else at the end of the span, if mod-97 holds there."""
    size = IBAN_LENGTH.get(span[:2])
    ends = [i for i in range(1, len(span)) if span[i] == " " and i - span.count(" ", 0, i) == size]
    return next((i for i in [*ends, len(span)] if mod97(span[:i].replace(" ", ""))), 0)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping numbers; where none ends, the search goes on
    at the next word."""
    m = _IBAN.search(text)
    while m:
        size = _iban_end(m.group())
        if size:
            yield m.start(), m.start() + size
        m = _IBAN.search(text, m.start() + max(1, size))


def added_candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Proposals of the added kinds: IBANs confirmed by mod-97; social security
    and local telephone numbers, which need a context word."""
    if not _DIGIT.search(text):
        return
    for start, end in _ibans(text):
        yield "iban", start, end
    if "-" in text:
        for m in _SSN.finditer(text):
            yield "ssn", m.start(), m.end()
    for m in _TEL.finditer(text):
        yield "tel", m.start(), m.end()


def _score(kind: str, text: str, start: int, end: int) -> float:
    near = text[max(0, start - CONTEXT_CHARS):start] + " " + text[end:end + CONTEXT_CHARS]
    hit = any(w in CONTEXT_WORDS[kind] for w in _WORD.findall(near.lower()))
    return min(1.0, BASE_SCORE[kind] + CONTEXT_GAIN * hit)


def _apart(ranges: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the ranges with overlaps joined, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b in sorted(ranges):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def find_spans(text: str) -> list[Span]:
    """All spans by kind, then start (code points, end exclusive). Base spans
    always stay; an added one needs ``LEAST_SCORE`` and must not overlap a
    base span or an earlier added one. Empty text: none."""
    base = [Span(k, a, b, _score(k, text, a, b)) for k, a, b in base_candidates(text)]
    starts, ends = _apart([(s.start, s.end) for s in base])
    added: list[Span] = []
    for k, a, b in added_candidates(text):
        score = _score(k, text, a, b)
        at = bisect.bisect_left(starts, b)  # the last taken stretch that begins before b
        if score >= LEAST_SCORE and not (at and ends[at - 1] > a):
            added.append(Span(k, a, b, score))
            starts.insert(at, a)
            ends.insert(at, b)
    return sorted(base + added, key=lambda s: (_ORDER[s.kind], s.start))


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span (overlaps joined) replaced by ``[KIND]``."""
    out, done = [], 0
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start >= done:
            out += [text[done:s.start], f"[{s.kind.upper()}]"]
        done = max(done, s.end)
    return "".join([*out, text[done:]])


SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                                ("score", pa.float64())]))


def detect(docs: DataFrame) -> DataFrame:
    """(doc_id, found: array of (kind, start, end, score), redacted text) per
    row of ``docs``. Null text counts as empty and stays null when redacted; a
    null id stays null; repeated rows repeat; other columns are not read."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = [find_spans(t) for t in texts(part)]
                rows = [[s._asdict() for s in f] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(rows, SPAN_TYPE)], names=["doc_id", "found"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>")


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by ``[KIND]`` and, where
    the column exists, ``n_chars`` set to the new length of a changed text.
    Null text stays null; all columns and rows stay."""
    names = docs.columns
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                new = [None if t is None else redact(t, find_spans(t)) for t in part.column("text").to_pylist()]
                i = part.schema.get_field_index("text")
                cols = list(part.columns)
                cols[i] = pa.array(new, part.schema.field(i).type)
                yield pa.RecordBatch.from_arrays(cols, names=part.schema.names)

    if "n_chars" not in names:
        return docs.mapInArrow(run, schema)
    was = free_name(names, "_was")
    out = docs.withColumn(was, F.char_length("text"))
    out = out.mapInArrow(run, out.schema)
    length = F.char_length("text")
    return out.withColumn("n_chars", F.when(length != F.col(was), length.cast(schema["n_chars"].dataType))
                          .otherwise(F.col("n_chars"))).select(*names)


def digests(detected: DataFrame) -> DataFrame:
    """The contract's columns of ``detect``'s rows."""
    def of(*kinds: str):
        return F.filter("found", lambda s: s.kind.isin(*kinds))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    return detected.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def base_digest(text: str) -> str:
    """The digest of one text, for tests and samples."""
    s = [s for s in find_spans(text) if s.kind in BASE_KINDS]
    return hashlib.sha256(",".join(f"{x.kind}:{x.start}:{x.end}" for x in s).encode()).hexdigest()
