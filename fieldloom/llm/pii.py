"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score.

Kinds, in this order: email, ip, card (Luhn), phone, iban (mod-97), ssn, key. The first four are the base: leftmost
non-overlapping matches of their patterns, dropped when their check fails. The others are added by the method:
an IBAN when its remainder is 1 at its country's length (at any end of 15 to 34 characters, the longest first, for
countries without a known length), a social security number or a run of 32, 40 or 64 hexadecimal digits (key) only when
words near it raise its score to ADD_SCORE; a key with a well-known prefix needs none. A base span stays whatever its score. Offsets count code points, the end is exclusive.

Patterns are scanned in linear time: runs of digits are consumed whole and an address is found from its ``@``.

Defined cases: a null or empty text has no spans; repeated rows give equal results; a long text is scanned whole; an empty
table gives an empty result; other columns stay untouched, since the finder maps one column to another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key")
BASE = KINDS[:4]
#: Score of a kind without any context, what a context word near it adds, and how near (code points) it must be.
START = {"email": 0.9, "ip": 0.5, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "key": 0.3}
CONTEXT_ADDS, NEAR, ADD_SCORE = 0.3, 40, 0.5
CONTEXT = {
    "email": ("mail", "contact", "write to"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "credit", "visa", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security", "taxpayer"),
    "key": ("token", "key", "secret", "password", "api"),
}
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"[0-9]++(?:\.[0-9]++){3}|[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}")
_IBAN_REST = re.compile(r"(?: ?[A-Z0-9]){0,30}")
IBAN_LENGTH = {
    x[:2]: int(x[2:])
    for x in (
        "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 "
        "GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
        "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
    ).split()
}
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|[0-9a-f]{32}(?:[0-9a-f]{8}(?:[0-9a-f]{24})?)?)(?![A-Za-z0-9])")
#: Score that a well-known prefix adds.
PREFIX_ADDS = 0.5
_NEAR = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + r")(?![a-z])") if k != "email" else re.compile("|".join(v)) for k, v in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(code: str) -> bool:
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        at = start = m.start()
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at:
            end = m.end()
            yield start, end


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in _IBAN.finditer(text):
        start = m.start()
        if start < done:
            continue
        code, ends = m.group(), {}
        stop = _IBAN_REST.match(text, m.end()).end()
        for k in range(m.end(), stop):
            if text[k] != " ":
                code += text[k]
                if not (text[k + 1 : k + 2].isascii() and text[k + 1 : k + 2].isalnum()):
                    ends[len(code)] = k + 1
        known = IBAN_LENGTH.get(code[:2])
        for n in [known] if known else sorted(ends, reverse=True):
            if n >= 15 and n in ends and mod97(code[:n]):
                done = ends[n]
                yield start, done
                break


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def spans(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, kind number, end, score), sorted."""
    if not text:
        return []
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in _emails(text)]
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if m.group().count(".") == 3 and all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m.group().split("."))]
    for m in _CARD.finditer(text):
        if 12 <= len(m.group()) and 12 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]
    found += [(a, 4, b) for a, b in _ibans(text)]
    found += [(m.start(), 5, m.end()) for m in _SSN.finditer(text)]
    found += [(m.start(), 6, m.end()) for m in _KEY.finditer(text)]
    out = []
    for a, k, b in sorted(found):
        kind = KINDS[k]
        near = (text[max(0, a - NEAR) : a] + " " + text[b : b + NEAR]).lower()
        score = min(1.0, START[kind] + CONTEXT_ADDS * bool(_NEAR[kind].search(near)) + PREFIX_ADDS * (k == 6 and text[a] in "Ag"))
        if k < len(BASE) or score >= ADD_SCORE:
            out.append((a, k, b, round(score, 3)))
    return out


_SPAN = T.StructType().add("kind", "string").add("start", "integer").add("end", "integer").add("score", "double")
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


@F.arrow_udf(T.ArrayType(_SPAN))
def _find(texts: pa.Array) -> pa.Array:
    return pa.array(([{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in spans(x.as_py())] for x in texts), _ARROW)


def find_pii(text: Column) -> Column:
    """All spans of a text: array of (kind, start, end, score), by start, then kind in the order of KINDS."""
    return _find(text)


def redact(text: Column, found: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans, the first counts."""
    at = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))
    step = lambda acc, s: F.when(s["start"] >= acc["end"], F.struct(F.concat(acc["out"], F.substring(text, acc["end"] + 1, s["start"] - acc["end"]), F.lit("["), s["kind"], F.lit("]")).alias("out"), s["end"].alias("end"))).otherwise(acc)
    return F.aggregate(found, at, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["end"] + 1, F.char_length(text))))


def listed(found: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
