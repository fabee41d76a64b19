"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust the score.

Base kinds (email, ip, card, phone) are always kept once their own check holds. The method adds two kinds,
kept from a score of 0.5: ``iban`` (its country's length, and mod-97 confirms) and ``ssn`` (no checksum, so only context
words carry it over the line). Scanning is linear in the text: each pattern is anchored at a rare character or runs over
maximal digit blocks, so a very long run of one class costs no more than any other text.

Defined cases: a null text counts as empty; a null id stays null; a very long text is scanned whole; spans of one start
and kind go by their end; repeated rows give repeated results; an empty table gives an empty result; only id and text are
looked at, whatever the other columns are called; offsets are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_BLOCK = re.compile(r"[0-9]+(?:[\x20.-][0-9]+)*")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=\x20?[A-Z0-9])")
# The characters of an account number, by country.
IBAN_LENGTHS = {
    c[:2]: int(c[2:])
    for c in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 "
        "GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 "
        "MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 "
        "TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_NON_DIGIT = re.compile(r"[^0-9]")
# Words, in English, German, French and Spanish, that make a kind likelier when they stand close to a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "kontakt", "courriel", "correo", "contacto"),
    "ip": ("ip", "host", "server", "address", "adresse", "serveur", "servidor", "dirección"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "karte", "kreditkarte", "carte", "paiement", "tarjeta", "pago"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "handy", "anruf", "téléphone", "teléfono", "móvil"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "überweisung", "compte", "virement", "banque", "cuenta", "banco", "transferencia"),
    "ssn": ("ssn", "social", "security", "sozialversicherung", "sécurité", "sociale", "seguridad"),
}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.3}
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
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


def _part(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the base kinds and of the digit-block kinds of the method, in no order."""
    out = [(s, "email", e) for s, e in _emails(text)] if "@" in text else []
    for block in _BLOCK.finditer(text):
        at, found = block.start(), block.group()
        if len(found) < 7:
            continue
        for m in _IP.finditer(found):
            if all(map(_part, m.groups())):
                out.append((at + m.start(), "ip", at + m.end()))
        if len(found) >= 11:
            for m in _CARD.finditer(found):
                digits = _NON_DIGIT.sub("", m.group())
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((at + m.start(), "card", at + m.end()))
            for m in _SSN.finditer(found):
                out.append((at + m.start(), "ssn", at + m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NON_DIGIT.sub("", m.group())) <= 15:
                out.append((m.start(), "phone", m.end()))
    return out


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Account numbers of their country's length that mod-97 confirms; single spaces may stand inside."""
    for m in _IBAN.finditer(text):
        left, at = IBAN_LENGTHS.get(text[m.start() : m.start() + 2], 0) - 4, m.end()
        raw = [m.group()]
        while left > 0:
            if text[at : at + 1] == " ":
                at += 1
            c = text[at : at + 1]
            if not c.isascii() or not (c.isdigit() or c.isupper()):
                break
            raw.append(c)
            at, left = at + 1, left - 1
        if left == 0 and not (text[at : at + 1].isascii() and text[at : at + 1].isalnum()) and mod97("".join(raw)):
            yield m.start(), at


def find_pii(text: str | None) -> list[tuple[int, str, int, float]]:
    """All spans as (start, kind, end, score), by start and then kind as listed in ``KINDS``."""
    text = text or ""
    found = base_spans(text)
    found += [(start, "iban", end) for start, end in _ibans(text)]
    out = []
    for start, kind, end in found:
        near = text[max(0, start - 40) : start].lower() + " " + text[end : end + 20].lower()
        score = min(1.0, PRIOR[kind] + (0.3 if set(_WORD.findall(near)) & set(CONTEXT[kind]) else 0.0))
        if kind in BASE or score >= 0.5:
            out.append((start, kind, end, round(score, 2)))
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and ``pii``, an array of (kind, start, end, score), per row. One pass over the texts, no shuffle."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"kind": k, "start": s, "end": e, "score": p} for s, k, e, p in find_pii(t)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, _SPANS)], names=["doc_id", "pii"])

    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, pii array<struct<kind:string,start:bigint,end:bigint,score:double>>")


def digest(spans: list[str]) -> str:
    return hashlib.sha256(",".join(spans).encode()).hexdigest()
