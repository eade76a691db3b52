"""Personal data: patterns propose spans, checksums confirm them, context words adjust their score.

Kinds and what confirms them: email (shape), ip (parts up to 255), card (12 to 19 digits, Luhn), phone (9 to 15
digits), iban (mod-97 is 1 and 15 to 34 characters; as words behind one may match too, it ends at its country's length if mod-97
holds there, and for countries not in the table at the last space where it holds), ssn (number ranges in use,
and a context word nearby). The first four are the base kinds: leftmost non-overlapping matches of their patterns,
whose failing matches are dropped without another try. Context words change scores only, never the base spans.

Nulls count as empty text; empty texts have no spans. Repeated rows are scanned each, extra columns are ignored
unless carried, and an empty table gives an empty result. Whole texts are scanned, in time linear in their length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, bounded_batches

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "ssn")

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A whole chain of numbers with single dots between: four parts at a time are an address.
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

# Words that make a kind likelier when they stand near a span.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo"),
    "ip": ("ip", "address", "host", "server", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "teléfono"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
#: Score of a confirmed span without context, and what a context word within CONTEXT_CHARS adds.
BASE_SCORE = {"email": 0.9, "ip": 0.8, "card": 0.85, "phone": 0.75, "iban": 0.9, "ssn": 0.4}
CONTEXT_BONUS = 0.3
CONTEXT_CHARS = 40
#: Spans of the kinds beyond the base ones count from this score on.
MIN_SCORE = 0.6

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27,
    "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24,
    "PL": 28, "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "SO": 23, "ST": 25,
    "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}

_CONTEXT_RE = {k: re.compile(r"\b(?:" + "|".join(map(re.escape, w)) + r")\b", re.I) for k, w in CONTEXT.items()}


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float


def luhn(digits: str) -> bool:
    """Luhn's checksum over a string of digits."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 mod 97-10 check of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of EMAIL, found from each @: a run of local characters before it always begins the match."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_CHARS:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m.span()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[tuple[int, int]]:
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                yield at, end
            at = end + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        d = _digits(m.group())
        if 12 <= len(d) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while m := IBAN.search(text, at):
        end = _iban_end(m.group())
        if end:
            yield m.start(), m.start() + end
        # a failing match may hide an IBAN behind its first word
        at = m.start() + (end or 4)


def _iban_end(match: str) -> int:
    """Where the IBAN that a match begins with ends; 0 if there is none."""
    solid = [k + 1 for k, c in enumerate(match) if c != " "]
    length = IBAN_LENGTHS.get(match[:2])
    if length is None:
        ends = [k for k in range(len(match), 0, -1) if k == len(match) or match[k] == " "]
    else:
        ends = [*solid[length - 1 : length], len(match)]
    for end in ends:
        iban = match[:end].replace(" ", "")
        if len(iban) >= 15 and mod97(iban):
            return end
    return 0


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": addresses, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def scan(text: str | None) -> list[Span]:
    """All confirmed spans by start, then kind; offsets count code points, the end is exclusive."""
    text = text or ""
    found = []
    for kind, finder in FINDERS.items():
        for start, end in finder(text):
            near = _CONTEXT_RE[kind].search(text[max(0, start - CONTEXT_CHARS) : start]) or _CONTEXT_RE[kind].search(text[end : end + CONTEXT_CHARS])
            score = min(1.0, BASE_SCORE[kind] + CONTEXT_BONUS * bool(near))
            if kind in BASE_KINDS or score >= MIN_SCORE:
                found.append((start, KINDS.index(kind), end, score))
    return [Span(s, KINDS[k], e, score) for s, k, e, score in sorted(found)]


def written(spans: list[Span]) -> str:
    """Spans as kind:start:end, joined by commas."""
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans merge under the first one's kind."""
    if text is None or not spans:
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        start, kind, end = spans[k].start, spans[k].kind, spans[k].end
        k += 1
        while k < len(spans) and spans[k].start < end:
            end = max(end, spans[k].end)
            k += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join([*out, text[at:]])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: the id, `carry`, spans (array of start, kind, end, score) and redacted. No shuffle."""
    bounded_batches(docs.sparkSession)
    through = Carried(docs, (id_col, *carry))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = [t if isinstance(t, str) else None for t in frame["text"]]
            spans = [scan(t) for t in texts]
            out = frame[through.names].copy()
            out["spans"] = [[s._asdict() for s in x] for x in spans]
            out["redacted"] = [redact(t, x) for t, x in zip(texts, spans, strict=True)]
            yield out

    given = docs.select(*through.given(), F.col(f"`{text_col}`").cast("string").alias("text"))
    found = given.mapInPandas(run, ", ".join([*through.kinds(), "spans array<struct<start:int,kind:string,end:int,score:double>>", "redacted string"]))
    return found.select(*through.restored(), "spans", "redacted")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of the base kinds, digest of the base spans and all spans as text, per row."""
    found = detect(docs, id_col, text_col)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    of_kind = lambda kind: F.filter("spans", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    best = F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0))
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), best.alias("max_score"))
