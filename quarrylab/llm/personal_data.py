"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust their score (op10_personal_data)."""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_slices, mapped, read
from .words import frames


class Span(NamedTuple):
    start: int
    kind: str
    end: int
    score: float


#: Kinds in the order of listing; the first four are always reported, the others from THRESHOLD on.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key", "secret")
BASE = KINDS[:4]
THRESHOLD = 0.5
#: Score of a confirmed span before its context is looked at, and characters of context before and after it.
PRIOR = {"email": 0.9, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "key": 0.9, "secret": 0.3}
CONTEXT = 60
#: Words that make a kind likelier (+0.2) or less likely (-0.2) when one stands nearby.
LIKELIER = {
    "email": ("email", "e-mail", "mail", "contact"),
    "ip": ("ip", "address", "host", "server", "login"),
    "card": ("card", "credit", "visa", "mastercard", "payment", "cvv"),
    "phone": ("phone", "tel", "telephone", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
    "ssn": ("ssn", "social", "security"),
    "key": ("key", "token", "secret"),
    "secret": ("password", "passwd", "pwd", "passphrase", "token", "secret", "key", "apikey", "api-key", "access-key", "accesskey", "credential", "credentials", "auth", "bearer"),
}
LESS_LIKELY = {"ip": ("version", "release", "build"), "card": ("isbn", "serial", "order"), "phone": ("order", "serial"), "ssn": ("part", "order", "serial"), "secret": ("commit", "checksum", "digest", "sha", "md", "etag", "revision")}
#: IBAN lengths outside 15..34 don't exist.
IBAN_LENGTH = range(15, 35)
#: A country's own length, from the IBAN registry and the countries that use IBANs without an entry there.
COUNTRY_LENGTH = {
    country: length
    for length, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
        23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST", 26: "DZ IR IS TR",
        27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
        31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN_START = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?=\x20?[A-Z0-9])")
_IBAN_REST = {n: re.compile(r"(?:\x20?[A-Z0-9]){%d}(?![A-Za-z0-9])" % (n - 4)) for n in set(COUNTRY_LENGTH.values())}
_IBAN_ANY = re.compile(r"(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_WORD = re.compile(r"[a-z][a-z-]*")
#: Beginnings, alphabets and lengths that issuers give their keys.
_KEY = re.compile(
    r"(?<![A-Za-z0-9_-])(?:(?:AKIA|ASIA)[A-Z2-7]{16}|gh[pousr]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{82}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|[rs]k_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})(?![A-Za-z0-9_])"
)
#: A run of 16 and more letters and digits; it is a secret if it is as mixed as a random one, and its context says so.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
#: A value given to something that is called a secret, whole whatever its length.
_ASSIGNED = re.compile(r"(?i)(?:password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key)[\"']?[\x20\t]*[:=][\x20\t]*[\"']?([^\s\"']{6,})")
#: Headers, as of an encrypted key, may come before the key's bytes.
_PEM = re.compile(r"-----BEGIN (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----(?:\s+[A-Za-z][A-Za-z-]*:[^\n]*(?=\n))*[A-Za-z0-9+/=\s]+-----END (?:[A-Z]{1,16} ){0,4}PRIVATE KEY-----")
#: Runs of lesser entropy (bits a character) are words.
SECRET_BITS = 2.5
#: Beginnings that the patterns for keys start with, and parts of the words that a secret needs nearby: a text without any is not searched.
_KEY_MARKS = ("AKIA", "ASIA", "gh", "github_pat_", "xox", "sk-", "k_live_", "AIza", "eyJ")
_SECRET_MARKS = ("passw", "pwd", "passphrase", "token", "secret", "key", "credential", "auth", "bearer")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def entropy(text: str) -> float:
    """Bits a character, by the text's own characters."""
    return -sum(n / len(text) * math.log2(n / len(text)) for n in Counter(text).values())


def _secrets(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits and letters mixed, as random ones are, and values with a digit and a letter that are given to a secret's name.

    Where some of them overlap, all that they cover is one span, so that no end of one is left over.
    """
    lowered = text.lower()
    if not any(mark in lowered for mark in _SECRET_MARKS):
        return
    mixed = lambda run, n: sum(c.isdigit() for c in run) >= n and sum(c.isalpha() for c in run) >= n
    runs = [m.span() for m in _RUN.finditer(text) if mixed(m[0], 2) and entropy(m[0]) >= SECRET_BITS]
    values = [m.span(1) for m in _ASSIGNED.finditer(text) if mixed(m[1], 1)] if "=" in text or ":" in text else []
    joined: list[list[int]] = []
    for start, end in sorted(runs + values):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    yield from map(tuple, joined)


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, found from each @ backwards and forwards, in linear time."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            free = domain.end()
            yield start, free
        at = text.find("@", max(at + 1, free))


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Spans that hold mod-97, each as long as its country's IBANs are, or as far as it goes where no length is known for the country."""
    free = 0
    for m in _IBAN_START.finditer(text):
        if m.start() < free or not (rest := _IBAN_REST.get(COUNTRY_LENGTH.get(m[1]), _IBAN_ANY).match(text, m.end())):
            continue
        if len(compact := text[m.start() : rest.end()].replace(" ", "")) in IBAN_LENGTH and mod97(compact):
            free = rest.end()
            yield m.start(), free


def proposals(text: str) -> Iterator[tuple[str, int, int]]:
    """Confirmed spans of all kinds; a match of a base kind that a check refuses is dropped and not tried again shorter."""
    if "@" in text:
        yield from (("email", a, b) for a, b in _emails(text))
    for m in _IP.finditer(text):
        if all(len(part) <= 3 and int(part or "0") <= 255 for part in (p.lstrip("0") for p in m[0].split("."))):
            yield "ip", *m.span()
    for m in _CARD.finditer(text):
        if 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            yield "card", *m.span()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", *m.span()
    yield from (("iban", a, b) for a, b in _ibans(text))
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", *m.span()
    keys = ([m.span() for m in _KEY.finditer(text)] if any(mark in text for mark in _KEY_MARKS) else []) + ([m.span() for m in _PEM.finditer(text)] if "PRIVATE KEY" in text else [])
    yield from (("key", a, b) for a, b in keys)
    taken = sorted(keys)
    for a, b in _secrets(text):
        at = bisect(taken, (a, math.inf))
        if not at or taken[at - 1][1] < b:  # what a key doesn't cover whole
            yield "secret", a, b


def find(text: str | None) -> list[Span]:
    """All spans of a text by start, then kind; null has none."""
    found = []
    for kind, start, end in proposals(text or ""):
        near = set(_WORD.findall((text[max(0, start - CONTEXT) : start] + " \n " + text[end : end + CONTEXT]).lower()))
        score = PRIOR[kind] + 0.2 * (not near.isdisjoint(LIKELIER[kind])) - 0.2 * (not near.isdisjoint(LESS_LIKELY.get(kind, ())))
        score = round(min(1.0, max(0.0, score)), 2)
        if kind in BASE or score >= THRESHOLD:
            found.append(Span(start, kind, end, score))
    return sorted(found, key=lambda s: (s.start, KINDS.index(s.kind)))


def redact(text: str | None, spans: list[Span]) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    if not spans:
        return text
    out, at = [], 0
    merged: list[list] = []
    for s in spans:
        if merged and s.start < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], s.end)
        else:
            merged.append([s.start, s.end, s.kind])
    for start, end, kind in merged:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def candidate(text: Column) -> Column:
    """The text if it may hold a span, else null: a span has a digit or an @, but for a few keys that have a fixed beginning."""
    return F.when(text.rlike("[0-9@]|PRIVATE KEY|AKIA|ASIA|AIza|eyJ|xox[abprs]-|sk-|k_live_|gh[pousr]_|github_pat_"), text)


def personal_data(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, counts by kind, base_sha256, spans, and the spans' scores.

    Row-local, without a shuffle: rows may repeat, texts may be null, empty or long (each pattern takes linear
    time), other columns are ignored. A text that can hold no span isn't sent to Python.
    """
    names = [f"n_{k}" for k in KINDS] + ["n_spans", "base_sha256", "spans", "scores"]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for text in batch.candidate.tolist():
                spans = find(text)
                base = listed([s for s in spans if s.kind in BASE])
                counts = [sum(s.kind == k for s in spans) for k in KINDS]
                rows.append([*counts, len(spans), hashlib.sha256(base.encode()).hexdigest(), listed(spans), ",".join(f"{s.score:g}" for s in spans)])
            yield pd.concat([batch[["doc_id"]].astype("Int64").reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    fields = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_spans long, base_sha256 string, spans string, scores string"
    return in_slices(docs.select(F.col("doc_id").cast("long"), candidate(F.col("text")).alias("candidate")), scan, fields, by="candidate")


def redacted(docs: DataFrame) -> DataFrame:
    """The rows of docs, with each span of text replaced by its kind in brackets; null stays null. Row-local, as personal_data.

    n_chars, where docs has it, follows a changed text; all other columns stay as they are, whatever their names.
    """
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames(batches, "text"):
            texts = frame.column(at).to_pylist()
            made = [redact(t, find(t)) for t in texts]
            columns = frame.columns
            columns[at] = pa.array(made, frame.schema.field(at).type)
            if length is not None:
                sizes = [n if new == old else len(new) for n, new, old in zip(columns[length].to_pylist(), made, texts)]
                columns[length] = pa.array(sizes, frame.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, schema=frame.schema)

    return mapped(docs, apply, docs.schema)


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))
