"""Personal data in text: regular expressions propose spans, checksums confirm them, context words adjust the score.

Defined results: a null or empty text has no spans; repeated rows get equal results; extra columns pass through.
All offsets are code points, ends exclusive. Every pattern runs in time linear in the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import works

#: Kinds in the order in which spans of equal start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only start at the start of a run of digits, for each try inside a run fails as the run does.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"""\b(?:token|secret|password|api_?key|access_?key)\x20?[=:]\x20?["']([A-Za-z0-9_+/=-]{16,})["']""", re.I)
NOT_DIGIT = re.compile(r"[^0-9]+")

#: Words near a span that raise the score of its kind.
CONTEXT = {
    "email": ("mail", "contact", "write", "@"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "cvv"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer", "bic"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("token", "secret", "password", "key"),
}
#: Score before context: what the pattern and its checksum alone are worth.
START = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.9, "ssn": 0.3, "secret": 0.7}
#: Kinds outside the base are kept from this score on.
LEAST = 0.5
WINDOW = 40

SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])
)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(text: str) -> bool:
    """ISO 13616: the first four characters move to the end, letters count from 10, the remainder is 1."""
    s = text.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    at, least = text.find("@"), 0
    while at >= 0:
        start = at
        while start > least and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
        # A start inside the local part would need the same domain, so only the next at sign can match.
        least = m.end() if m else at + 1
        at = text.find("@", least)


def proposed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans that pattern and validator agree on, by kind."""
    for start, end in emails(text):
        yield "email", start, end
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            yield "ip", m.start(), m.end()
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for m in IBAN.finditer(text):
        if mod97(m[0]):
            yield "iban", m.start(), m.end()
    for m in SSN.finditer(text):
        yield "ssn", m.start(), m.end()
    if '"' in text or "'" in text:
        for m in SECRET.finditer(text):
            yield "secret", m.start(1), m.end(1)


RANK = {k: i for i, k in enumerate(KINDS)}


def find(text: str | None) -> list[tuple[str, int, int, float]]:
    """All spans of a text by start, then kind. Base spans always stay; others need LEAST after context."""
    out = []
    for kind, start, end in proposed(text or ""):
        near = (text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]).lower()
        score = min(1.0, START[kind] + (0.3 if any(w in near for w in CONTEXT[kind]) else 0.0))
        if score >= LEAST or RANK[kind] < 4:
            out.append((kind, start, end, score))
    out.sort(key=lambda s: (s[1], RANK[s[0]], s[2]))
    return out


@F.pandas_udf(SPAN)
def _spans(texts: pd.Series) -> pd.Series:
    return pd.Series([find(t) for t in texts], dtype=object)


def pii_spans(text: Column | str) -> Column:
    """array<struct<kind, start, end, score>> of the personal data in a text column."""
    return _spans(F.col(text) if isinstance(text, str) else text)


def redacted(text: str, spans: list) -> str:
    """The text with each span replaced by its kind; overlapping spans are masked as one, by the kind that starts first, then the longest."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s[1], -s[2])):
        if s[1] >= at:
            out += [text[at : s[1]], f"<{s[0].upper()}>"]
        at = max(at, s[2])
    return "".join([*out, text[at:]])


@F.pandas_udf(T.StringType())
def _redact(texts: pd.Series) -> pd.Series:
    works("pii")
    return pd.Series([t if t is None else redacted(t, find(t)) for t in texts], dtype=object)


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with the personal data of its text column masked. Null stays null."""
    return df.withColumn(text, _redact(F.col(f"`{text}`")))
