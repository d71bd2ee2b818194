"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Base kinds (always kept): ``email``, ``ip`` (parts up to 255), ``card`` (14-19
digits, Luhn), ``phone`` (+, 10-15 digits). The method adds ``iban`` (mod-97),
``email`` written with (at)/(dot), ``phone`` without + and ``ssn`` where words
nearby speak for them, and ``secret``: keys of known form, and long values given
to a name like key, token or password whose characters carry at least
``ENTROPY`` bits each. A span's score starts from its kind, a checksum raises
it, and words within ``NEAR`` characters raise or lower it; added spans need
``KEEP`` and lie apart from all spans before them. Patterns run in time linear in
the text; a span is held against the others by bisection.

Offsets are code points, end exclusive. Defined results: null and empty texts
have no spans; repeated rows count each.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from promptscreen.llm.common import column, text_chunks

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
NEAR, KEEP, ENTROPY = 40, 0.6, 3.0
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
SPOKEN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({]dot[\])}])\x20?[A-Za-z0-9-]++)+")
LOCAL_PHONE = re.compile(r"(?<![+0-9.\w])\(?[0-9]{2,5}\)?(?:[\x20.-]?[0-9]{2,5}){2,4}(?![0-9\w])")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?:key|token|secret|passw(?:or)?d|pwd|auth)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9+/=_.~-]{16,}+)", re.I)
KEY = re.compile(r"(?<![A-Za-z0-9_-])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+"
                 r"|eyJ[A-Za-z0-9_-]{10,}+\.eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+)(?![A-Za-z0-9_-])")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.5, "phone": 0.6, "iban": 0.5, "ssn": 0.4, "spoken": 0.6, "local": 0.35, "secret": 0.6}
SIGNS = {
    "email": (r"mail|contact|write|reach", r"example only"),
    "ip": (r"\bip\b|address|host|server", r"version|release|section"),
    "card": (r"card|visa|master|credit|payment|carte|karte|tarjeta", r"order|invoice|tracking|isbn"),
    "phone": (r"phone|tel|call|mobile|cell|fax|whatsapp|appel|anruf|llam", r"order|invoice|tracking|isbn|version"),
    "iban": (r"iban|bank|account|konto|compte|cuenta", r"serial|order|part"),
    "ssn": (r"ssn|social security", r"part|model|order"),
    "secret": (r"key|token|secret|passw|auth|bearer", r"checksum|digest|commit|etag|example"),
}
SIGNS = {k: tuple(re.compile(x, re.I) for x in v) for k, v in SIGNS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    iban = iban.replace(" ", "")
    moved, rest = iban[4:] + iban[:4], 0
    for c in moved:
        v = ord(c) - 48 if c.isdigit() else ord(c) - 55
        rest = (rest * (10 if v < 10 else 100) + v) % 97
    return rest == 1 and 15 <= len(iban) <= 34


def entropy(s: str) -> float:
    """Bits a character, by the characters' shares."""
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str):
    """Leftmost non-overlapping addresses, found from their @ signs."""
    done, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > done and text[left - 1] in LOCAL:
            left -= 1
        m = HOST.match(text, at) if left < at else None
        if m:
            yield left, m.end()
            done = m.end()
        at = text.find("@", done if m else at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base kinds."""
    out = [(a, b, "email") for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((*m.span(), "ip"))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 40 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m[0])) <= 15:
                out.append((*m.span(), "phone"))
    return out


def context_score(text: str, start: int, end: int, kind: str, prior: float) -> float:
    good, bad = SIGNS[kind]
    around = text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]
    return max(0.0, min(1.0, prior + 0.3 * bool(good.search(around)) - 0.3 * bool(bad.search(around))))


def united(spans) -> tuple[list[int], list[int]]:
    """Starts and ends of the parts that spans cover together, in order."""
    starts, ends = [], []
    for a, b in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a), ends.append(b)
    return starts, ends


def find(text: str | None) -> list[dict]:
    """All spans of a text by start, then kind as listed."""
    if not text:
        return []
    found = []
    has_digit = re.search("[0-9]", text) is not None
    base = base_spans(text) if has_digit or "@" in text else []
    for a, b, kind in base:
        prior = PRIOR[kind] + (0.4 if kind == "card" else 0)
        found.append((a, KINDS.index(kind), b, context_score(text, a, b, kind, prior), True))
    starts, ends = united((a, b) for a, b, _ in base)

    def add(pattern, kind, prior, valid=lambda s: True, bonus=0.0):
        nonlocal starts, ends
        fresh = []
        for m in pattern.finditer(text):
            a, b = m.span(pattern.groups)
            at = bisect_left(ends, a + 1)           # the first span that ends after the start
            if (at < len(starts) and starts[at] < b) or not valid(m[pattern.groups]):
                continue
            s = context_score(text, a, b, kind, PRIOR[prior] + bonus)
            if s >= KEEP:
                fresh.append((a, b))
                found.append((a, KINDS.index(kind), b, s, False))
        if fresh:
            starts, ends = united([*zip(starts, ends, strict=True), *fresh])

    if has_digit:
        add(KEY, "secret", "secret", bonus=0.3)
        add(SECRET, "secret", "secret", lambda s: entropy(s) >= ENTROPY and re.search("[0-9]", s) is not None)
        add(IBAN, "iban", "iban", mod97, 0.4)
        add(SSN, "ssn", "ssn")
        add(LOCAL_PHONE, "phone", "local", lambda s: 10 <= len(digits_of(s)) <= 15)
    if "at]" in text or "at)" in text or "at}" in text:
        add(SPOKEN, "email", "spoken")
    return [{"kind": KINDS[k], "start": a, "end": b, "score": s, "base": base} for a, k, b, s, base in sorted(found)]


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                     T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType()),
                     T.StructField("base", T.BooleanType())])
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                             ("score", pa.float64()), ("base", pa.bool_())]))


def scan(docs: DataFrame, text: str = "text", into: str = "pii") -> DataFrame:
    """All rows and columns of ``docs`` with ``into``: the spans found (a
    column of that name is replaced)."""
    keep = [c for c in docs.columns if c != into]

    def look(batches):
        for rb in text_chunks(batches, text):
            spans = pa.array([find(t) for t in column(rb, text).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*(column(rb, c) for c in keep), spans], [*keep, into])

    src = docs.select(*keep)
    return src.mapInArrow(look, T.StructType([*src.schema.fields, T.StructField(into, T.ArrayType(SPAN))]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets."""
    def cut(batches):
        for rb in text_chunks(batches, text):
            texts = []
            for t in column(rb, text).to_pylist():
                at, out = 0, []
                for s in find(t):
                    if s["start"] >= at:
                        out += [t[at:s["start"]], f"[{s['kind']}]"]
                        at = s["end"]
                texts.append(t if not out else "".join([*out, t[at:]]))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if c == text else column(rb, c) for c in rb.schema.names],
                                             rb.schema.names)

    return docs.mapInArrow(cut, docs.schema)


def as_string(spans) -> F.Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
