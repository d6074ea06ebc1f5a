"""Personal data by anchor expansion.

One Aho-Corasick pass finds anchors: at-signs, plus signs, URL schemes and cues that
announce an identifier. Runs of digits are anchors too. A deterministic parser then expands
each anchor to the left and right and validates what it found; parsers look at the
characters of a candidate only, so the work is linear in the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache
from itertools import pairwise

from pyspark.sql import DataFrame

from detlake.llm.common import whole_text, with_computed

# Kinds in the order in which spans of one start are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "iban", "account", "secret")

# Anchors by the parser that expands them.
SCHEMES = ("http://", "https://", "ftp://", "www.")
IBAN_CUES = ("iban",)
ACCOUNT_CUES = ("account", "acct", "konto", "cuenta", "compte", "passport", "ssn")
SECRET_CUES = ("token", "api_key", "apikey", "password", "passwd", "secret")

# Characters of an IBAN by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27,
    "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26,
    "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23,
    "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_PHONE_BODY = re.compile(r"[\x20().0-9-]+")
_URL_BODY = re.compile(r"[^\x00-\x20<>\"'{}|\\^`\x7f-\xa0]+")
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IBAN = re.compile(r"[\x20:=#]{0,4}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_ACCOUNT = re.compile(r"(?:\x20(?:no|number|nr)\b\.?)?[\x20:=#]{1,4}([A-Z]{0,3}[0-9][0-9-]{4,22}[0-9])(?![A-Za-z0-9])")
_SECRET = re.compile(r"[\x20]{0,2}[:=][\x20]{0,2}[\"']?([A-Za-z0-9_+/.-]{12,})")


@cache
def _anchors():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, words in (("url", SCHEMES), ("iban", IBAN_CUES), ("account", ACCOUNT_CUES), ("secret", SECRET_CUES)):
        for word in words:
            for form in {word, word.upper(), word.capitalize()}:
                found.add_word(form, (kind, len(form)))
    for mark in "@+":
        found.add_word(mark, (mark, 1))
    found.make_automaton()
    return found


def luhn(digits: str) -> bool:
    total = sum(int(d) for d in digits[-1::-2])
    return (total + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])) % 10 == 0


def _email(text: str, at: int, least: int) -> tuple[int, int] | None:
    low = at
    while low > least and text[low - 1] in _LOCAL:
        low -= 1
    domain = _DOMAIN.match(text, at + 1)
    return (low, domain.end()) if low < at and domain else None


def _phone(text: str, at: int) -> tuple[int, int] | None:
    """A plus, a digit, what a number may hold, and a digit at the end."""
    if not "0" <= text[at + 1 : at + 2] <= "9":
        return None
    body = _PHONE_BODY.match(text, at + 2)
    high = body.end() if body else 0
    while high > at + 3 and not "0" <= text[high - 1] <= "9":
        high -= 1
    return (at, high) if high > at + 3 else None


def _digit_spans(text: str) -> Iterator[tuple[str, int, int]]:
    """Addresses and cards from the runs of digits, each kind leftmost without overlaps."""
    runs = [m.span() for m in _DIGITS.finditer(text)]
    i = 0
    while i + 3 < len(runs):
        four = runs[i : i + 4]
        if all(b[0] - a[1] == 1 and text[a[1]] == "." for a, b in pairwise(four)):
            parts = [text[a:b].lstrip("0") for a, b in four]
            if all(len(p) <= 3 and int(p or "0") <= 255 for p in parts):
                yield "ip", four[0][0], four[3][1]
            i += 4
        else:
            i += 1
    i = 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
        digits = sum(b - a for a, b in runs[i : j + 1])
        if 14 <= digits <= 19 and luhn("".join(text[a:b] for a, b in runs[i : j + 1])):
            yield "card", runs[i][0], runs[j][1]
        i = j + 1


def _url(text: str, at: int, scheme: int) -> tuple[int, int] | None:
    """The host is checked first: what has none is not expanded."""
    if at and (text[at - 1].isalnum() or text[at - 1] in "/@."):
        return None
    if not _HOST.match(text, at if text[at] in "wW" else at + scheme):
        return None
    return at, at + len(_URL_BODY.match(text, at)[0].rstrip(".,;:!?)]"))


def _iban(text: str, at: int) -> tuple[int, int] | None:
    """An account number of its country's length, with or without spaces, whose check digits hold."""
    found = _IBAN.match(text, at)
    if not found:
        return None
    low, high = found.start(1), found.start(1)
    size = IBAN_LENGTHS.get(text[low : low + 2], 0)
    code = ""
    while high < found.end(1) and len(code) < size:
        code += text[high].strip()
        high += 1
    if not size or len(code) < size or text[high : high + 1].isalnum():
        return None
    return (low, high) if int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1 else None


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, order of the kind, kind, end), sorted; code points, end exclusive."""
    spans = [(low, KINDS.index(kind), kind, high) for kind, low, high in _digit_spans(text)]
    done = dict.fromkeys((*KINDS, "@", "+"), 0)
    for last, (kind, length) in _anchors().iter(text):
        at = last - length + 1
        if at < done[kind]:
            continue
        if kind == "@":
            name, found = "email", _email(text, at, done["@"])
        elif kind == "+":
            name, found = "phone", _phone(text, at)
        elif kind == "url":
            name, found = "url", _url(text, at, length)
        elif kind == "iban":
            name, found = "iban", _iban(text, last + 1)
        else:
            name = kind
            match = (_ACCOUNT if kind == "account" else _SECRET).match(text, last + 1)
            found = match.span(1) if match else None
            if found and kind == "secret" and not any(c.isdigit() for c in match[1]):
                found = None
        if found:
            done[kind] = found[1]
            if name == "phone" and not 10 <= sum("0" <= c <= "9" for c in text[found[0] : found[1]]) <= 15:
                continue
            spans.append((found[0], KINDS.index(name), name, found[1]))
    return sorted(spans)


def _listed(spans) -> str:
    return ",".join(f"{kind}:{low}:{high}" for low, _, kind, high in spans)


def _marks(texts) -> list[tuple]:
    """Columns: counts of the base kinds, the digest of their spans, all spans."""
    rows = []
    for text in texts:
        spans = find_spans(text.as_py())
        base = [s for s in spans if s[2] in BASE_KINDS]
        counts = [sum(s[2] == k for s in base) for k in BASE_KINDS]
        rows.append((*counts, hashlib.sha256(_listed(base).encode()).hexdigest(), _listed(spans)))
    return list(zip(*rows, strict=True)) if rows else [()] * (len(BASE_KINDS) + 2)


def personal_data(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without ``text``, with counts of the base kinds, ``base_sha256`` and ``spans``.

    ``spans`` lists kind:start:end of all kinds by start. Null and empty texts have none.
    Columns of these names are replaced; an empty table gives an empty table. Repeated rows are
    marked each time; very long texts are read whole, in time that grows with their length.
    """
    kinds = {**{f"n_{k}": "long" for k in BASE_KINDS}, "base_sha256": "string", "spans": "string"}
    return with_computed(df.withColumn(text, whole_text(f"`{text}`")), text, kinds, lambda: _marks)


def op5_personal_data(spark, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
