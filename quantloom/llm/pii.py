"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from math import log2
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from ._text import keep

#: Kinds in the order in which equal starts are listed; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "aba", "ssn", "key", "secret")
BASE = 4

# Words that make a kind likelier when they stand near a span, by kind.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "debit", "carte", "karte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "cuenta", "compte", "bic", "swift"),
    "aba": ("routing", "aba", "bank", "account", "transit", "wire"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
    "key": ("key", "token", "secret", "credential", "credentials"),
    "secret": ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "bearer", "credential", "credentials"),
}
# Score of a span that has passed its check, before its context is read.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.7, "phone": 0.7, "iban": 0.9, "aba": 0.2, "ssn": 0.3, "key": 0.8, "secret": 0.3}
#: Added to the score for a context word within NEAR characters; an added kind needs LEAST.
BOOST, NEAR, LEAST = 0.3, 40, 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_ABA = re.compile(r"(?<![0-9A-Za-z.-])[0-9]{9}(?![0-9A-Za-z-])")
_SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,512}(?![A-Za-z0-9_+/=-])")
# How issued access keys begin.
_KEY = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}\Z|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,}\Z|gh[opsur]_[A-Za-z0-9]{36,}\Z|xox[abprs]-[A-Za-z0-9-]{10,}\Z|AIza[A-Za-z0-9_-]{35}\Z")
#: Bits of entropy in each character, from which on a run of letters and digits may be a secret.
RANDOM = 3.0
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


class Span(NamedTuple):
    start: int
    end: int
    kind: int
    score: float


def luhn(digits: str) -> bool:
    """Checksum of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Checksum of international account numbers."""
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def routing(digits: str) -> bool:
    """Checksum of nine-digit bank routing numbers."""
    d = [int(c) for c in digits]
    total = 3 * (d[0] + d[3] + d[6]) + 7 * (d[1] + d[4] + d[7]) + d[2] + d[5] + d[8]
    return total > 0 and total % 10 == 0


def issued(number: str) -> bool:
    """Whether a social security number of the form 3-2-4 can have been issued."""
    area, group, serial = number.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def random(run: str) -> bool:
    """Whether a run holds letters and digits and its characters are spread as those of a random key are."""
    if run.isalpha() or not any(c.isalpha() for c in run) or not any(c.isdigit() for c in run):
        return False
    return -sum(n / len(run) * log2(n / len(run)) for n in Counter(run).values()) >= RANDOM


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As the one pattern local@domain would match from the left, in linear time: each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        # Local parts are read backwards in growing steps, since a run may be long.
        step = 64
        while True:
            low = max(done, at - step)
            start = at - _LOCAL.match(text[low:at][::-1]).end()
            if start > low or low == done:
                break
            step *= 4
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base kinds in code points; leftmost, non-overlapping per kind, failing matches dropped."""
    found = [(a, b, 0) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append((m.start(), m.end(), 1))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), 2))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
                found.append((m.start(), m.end(), 3))
    return found


def _score(text: str, start: int, end: int, kind: int) -> float:
    near = {w.lower() for w in _WORD.findall(text[max(0, start - NEAR) : start]) + _WORD.findall(text[end : end + NEAR])}
    return min(1.0, PRIOR[KINDS[kind]] + (BOOST if near & set(CONTEXT[KINDS[kind]]) else 0.0))


def find(text: str) -> list[Span]:
    """All spans of a text by start, then kind.  Base spans stay whatever their score; added kinds (account numbers by
    mod 97, routing numbers by their checksum, social security numbers by what can be issued, access keys by their
    beginning, other secrets by their entropy) need LEAST, so that some count only near a context word."""
    found = [Span(a, b, k, _score(text, a, b, k)) for a, b, k in base_spans(text)]
    for m in _IBAN.finditer(text):
        # The longest head of the proposal that passes counts, since words in capitals may follow.
        raw = m[0]
        for cut in range(len(raw), 14, -1):
            if raw[cut - 1] != " " and (cut == len(raw) or raw[cut] == " ") and mod97(raw[:cut].replace(" ", "")):
                found.append(Span(m.start(), m.start() + cut, 4, _score(text, m.start(), m.start() + cut, 4)))
                break
    for m in _ABA.finditer(text):
        if routing(m[0]) and (s := _score(text, m.start(), m.end(), 5)) >= LEAST:
            found.append(Span(m.start(), m.end(), 5, s))
    for m in _SSN.finditer(text):
        if issued(m[0]) and (s := _score(text, m.start(), m.end(), 6)) >= LEAST:
            found.append(Span(m.start(), m.end(), 6, s))
    for m in _SECRET.finditer(text):
        kind = 7 if _KEY.match(m[0]) else 8
        if random(m[0]) and (s := _score(text, m.start(), m.end(), kind)) >= LEAST:
            found.append(Span(m.start(), m.end(), kind, s))
    return sorted(found)


def detect(docs: DataFrame) -> DataFrame:
    """Spans of every text: doc_id, spans array<struct<kind, start, end, score>>.

    A null or empty text has no spans; repeated rows give a row each; a null doc_id stays null; an
    empty table gives no rows.  Only ``doc_id`` and ``text`` are read.
    """
    item = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[(KINDS[s.kind], s.start, s.end, s.score) for s in find(x)] if x else [] for x in batch.column(1).to_pylist()]
            spans = [[dict(zip(("kind", "start", "end", "score"), s, strict=True)) for s in row] for row in spans]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, pa.list_(item))], ["doc_id", "spans"])

    return keep(docs, "doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,score:double>>")


def listing(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[s.kind]}:{s.start}:{s.end}" for s in spans)


def report(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, a digest of the base spans, all spans as text and their number.
    Nulls, repeats and empty tables as in ``detect``."""
    names = ["doc_id", *(f"n_{k}" for k in KINDS[:BASE]), "base_sha256", "spans", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(x) if x else [] for x in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s.kind == k for s in row) for row in found], pa.int64()) for k in range(BASE)]
            digest = pa.array([hashlib.sha256(listing([s for s in row if s.kind < BASE]).encode()).hexdigest() for row in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([listing(row) for row in found], pa.string()), pa.array([len(row) for row in found], pa.int64())], names)

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"
    return keep(docs, "doc_id", "text").mapInArrow(run, schema)


def mask(text: str) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    spans = find(text)
    while spans:
        first = spans.pop(0)
        end = first.end
        while spans and spans[0].start < end:
            end = max(end, spans.pop(0).end)
        out += [text[at : first.start], f"[{KINDS[first.kind].upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """The table with every span masked and ``n_chars`` counted anew where it is a column; other columns
    as they are.  A null text stays null."""
    names = docs.columns
    t, n = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [mask(x) if x else x for x in batch.column(t).to_pylist()]
            columns = list(batch.columns)
            columns[t] = pa.array(texts, batch.schema.field(t).type)
            if n is not None:
                columns[n] = pa.array([None if x is None else len(x) for x in texts], pa.int64()).cast(batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
