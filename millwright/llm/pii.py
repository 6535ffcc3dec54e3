"""Personal data in texts: patterns propose spans, checksums confirm them, words nearby adjust their scores.

Kinds ``email``, ``ip``, ``card`` and ``phone`` are the base kinds: a pattern match that passes its validator
is always a span. The kinds ``iban`` (mod-97) and ``id`` (a bare number group that only a context word turns
into personal data) are added by the method and kept from ``THRESHOLD`` on.

Every pattern is matched in time linear in the text: e-mail addresses are anchored at their ``@`` and
numeric kinds are looked for only inside runs of digits and separators, so one very long run of
letters or digits costs no more than other text.

Edge cases: a null text counts as empty; an empty text has no spans; rows are judged one by one, so repeated rows
give repeated results and an empty table gives an empty one; columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from millwright.llm.common import Batcher, as_py, narrow, rows

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "id")
ORDER = {k: i for i, k in enumerate(KINDS)}

#: Score of a confirmed match before context, by kind.
PRIOR = {"email": 0.9, "ip": 0.7, "card": 0.85, "phone": 0.75, "iban": 0.9, "id": 0.3}
#: Words that raise a kind's score when they stand within WINDOW characters before or after a span, in English, German, French and Spanish.
CONTEXT = {
    "email": "mail email contact write address kontakt schreiben adresse courriel écrire correo escribir dirección contacto".split(),
    "ip": "ip address server host login adresse rechner anmeldung serveur hôte connexion servidor dirección acceso".split(),
    "card": "card visa mastercard amex credit debit payment cvv karte kreditkarte zahlung carte crédit paiement tarjeta crédito pago".split(),
    "phone": "phone tel call mobile fax cell whatsapp telefon anrufen handy mobil téléphone appeler portable teléfono llamar móvil".split(),
    "iban": "iban bank account transfer bic swift konto überweisung banque compte virement banco cuenta transferencia".split(),
    "id": "ssn social passport licence license tax identity insurance pass ausweis steuer versicherung passeport permis impôt identité assurance pasaporte licencia impuesto identidad seguro".split(),
}
#: Words that lower any numeric kind's score.
AGAINST = "version section isbn example release abschnitt beispiel exemple versión sección ejemplo".split()
WINDOW, RAISE, LOWER, THRESHOLD = 40, 0.3, 0.25, 0.5

_LOCAL_BACK = regex.compile(r"(?r)[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_RUN = re.compile(r"[0-9][0-9 .()\-]*+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_ID = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_WORD = re.compile(r"[^\W\d_]+")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    """The card checksum: every second digit from the right doubled, digit sums added, a multiple of ten."""
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The bank account checksum: first four characters moved to the end, letters as 10 to 35, remainder 1."""
    s = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        left = _LOCAL_BACK.match(text, end, at) if at > end else None
        right = _DOMAIN.match(text, at + 1) if left else None
        if right:
            yield left.start(), right.end()
            end = right.end()
        at = text.find("@", max(end, at + 1))


def _byte(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def _proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed matches of every kind, in no order."""
    for s, e in _emails(text):
        yield "email", s, e
    for run in _RUN.finditer(text):
        a, b = run.span()
        while text[b - 1] not in "0123456789":
            b -= 1
        if a and text[a - 1] == "+" and b - a >= 3:
            digits = len(_NOT_DIGIT.sub("", text[a:b]))
            if 9 <= digits <= 15:
                yield "phone", a - 1, b
        if b - a >= 7:
            for m in _IP.finditer(text, a, b):
                if all(map(_byte, m[0].split("."))):
                    yield "ip", *m.span()
        if b - a >= 11:
            for m in _ID.finditer(text, a, b):
                yield "id", *m.span()
        if b - a >= 12:
            for m in _CARD.finditer(text, a, b):
                digits = _NOT_DIGIT.sub("", m[0]) if m.end() - m.start() <= 37 else ""
                if 12 <= len(digits) <= 19 and luhn(digits):
                    yield "card", *m.span()
        if a >= 2 and "A" <= text[a - 1] <= "Z" and "A" <= text[a - 2] <= "Z" and not text[a - 3 : a - 2].isalnum():
            m = _IBAN.match(text, a - 2)
            number = m[0] if m else ""
            while len(number) >= 15 and not mod97(number):  # it may have run into words in capitals
                number = number.rpartition(" ")[0]
            if len(number) >= 15:
                yield "iban", a - 2, a - 2 + len(number)


def _score(text: str, kind: str, start: int, end: int) -> float:
    near = set(_WORD.findall((text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()))
    score = PRIOR[kind]
    if not near.isdisjoint(CONTEXT[kind]):
        score += RAISE
    if kind != "email" and not near.isdisjoint(AGAINST):
        score -= LOWER
    return round(min(1.0, max(0.0, score)), 2)


def find(text: str | None) -> list[Span]:
    """All spans of one text by start and kind; positions are code points, ends exclusive."""
    found = (Span(k, s, e, _score(text, k, s, e)) for k, s, e in _proposals(text or ""))
    return sorted((x for x in found if x.kind in BASE_KINDS or x.score >= THRESHOLD), key=lambda x: (x.start, ORDER[x.kind]))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are replaced together."""
    if not spans:
        return text
    out, at = [], 0
    for x in spans:
        if x.start >= at:
            out += [text[at : x.start], f"[{x.kind.upper()}]"]
        at = max(at, x.end)
    return "".join([*out, text[at:]])


def told(spans: Iterable[Span]) -> str:
    return ",".join(f"{x.kind}:{x.start}:{x.end}" for x in spans)


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: ``doc_id`` and ``found``, an array of (kind, start, end, score)."""
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("found", pa.list_(kind))])

    def each(batches):
        out = Batcher(schema)
        for i, text in rows(batches):
            if out.add((i, [x._asdict() for x in find(text)])):
                yield out.take()
        yield out.take()

    return narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, found array<struct<kind:string,start:int,end:int,score:double>>")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns with spans replaced in the text; null texts stay null."""
    at = docs.columns.index(text_col)
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))  # names with dots would be taken for fields of structs

    def each(batches):
        for batch in batches:
            texts = pa.array((redacted(t, find(t)) for t in map(as_py, batch.column(at))), pa.string())
            yield pa.RecordBatch.from_arrays([texts if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return plain.mapInArrow(each, plain.schema).toDF(*docs.columns)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The result of ``op1_pii``: counts of the base kinds, the digest of their spans, and all spans; then counts of the other kinds and the spans' scores."""
    more = [k for k in KINDS if k not in BASE_KINDS]
    schema = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in BASE_KINDS), ("base_sha256", pa.string()), ("spans", pa.string()), *((f"n_{k}", pa.int64()) for k in more), ("scores", pa.string()), ("top_score", pa.float64())])

    def each(batches):
        out = Batcher(schema)
        for i, text in rows(batches):
            found = find(text)
            kinds = [x.kind for x in found]
            base = told(x for x in found if x.kind in BASE_KINDS)
            sha = hashlib.sha256(base.encode()).hexdigest()
            scores = ",".join(f"{x.score:g}" for x in found)
            if out.add((i, *map(kinds.count, BASE_KINDS), sha, told(found), *map(kinds.count, more), scores, max((x.score for x in found), default=0.0))):
                yield out.take()
        yield out.take()

    return narrow(docs, id_col, text_col).mapInArrow(each, "doc_id long, " + ", ".join(f"n_{k} long" for k in BASE_KINDS) + ", base_sha256 string, spans string, " + ", ".join(f"n_{k} long" for k in more) + ", scores string, top_score double")
