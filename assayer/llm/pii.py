"""Personal data: regular expressions propose spans, checksums confirm them, context words nearby adjust the score.

Runs over Arrow batches of whole texts in Python workers; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

#: Fixed values of the result contract: base kinds in the listed order.
BASE_KINDS = ("email", "ip", "card", "phone")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Proposals of this scan's own kinds, confirmed below. An IBAN may be followed by words that look like its groups.
IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b")
SSN = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b")
#: Whole words that make a kind likelier when they stand within NEAR characters before the span.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address", "kontakt", "courriel", "correo"),
    "ip": ("ip", "server", "host", "address", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "payment", "kreditkarte", "carte", "tarjeta"),
    "phone": ("phone", "call", "tel", "telephone", "mobile", "fax", "telefon", "telefono"),
    "iban": ("iban", "account", "bank", "transfer", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social", "security"),
}
NEAR_WORDS = {k: re.compile(rf"(?<![^\W_])(?:{'|'.join(v)})(?![^\W_])") for k, v in CONTEXT.items()}
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.9, "ssn": 0.3}
NEAR, BONUS, LEAST_SCORE = 48, 0.3, 0.5
SCHEMA = "id string, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, scores array<double>"


def luhn(digits: str) -> bool:
    """Whether the last digit is right by the Luhn checksum."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """Whether the check digits of an IBAN are right."""
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def email_spans(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping matches of the local part's characters, @ and a dotted domain: from each @ leftwards, down
    to the end of the last match, so that long runs of letters are walked once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL_PART:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def ip_spans(text: str) -> Iterator[tuple[int, int]]:
    """Of each chain of dotted numbers, four at a time from the left, if none is over 255; a chain is walked once."""
    for m in DOTTED.finditer(text):
        if m[0].count(".") >= 3:
            parts, begin = m[0].split("."), m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = begin + sum(map(len, four)) + 3
                if all(len(x := part.lstrip("0")) < 4 and int(x or 0) <= 255 for part in four):
                    yield begin, end
                begin = end + 1


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's place, end, kind) of every confirmed base span. A cheap test of a character that any match must
    hold comes first; it can't change the result."""
    out = [(s, 0, e, "email") for s, e in email_spans(text)]
    if "." in text:
        out += [(s, 1, e, "ip") for s, e in ip_spans(text)]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    if "+" in text:
        out += [(m.start(), 3, m.end(), "phone") for m in PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def iban_spans(text: str) -> Iterator[tuple[int, int]]:
    """Proposals whose check digits are right, at the longest end of a group for which they are."""
    for m in IBAN.finditer(text):
        ends = [m.end(), *[m.start() + i for i in range(len(m[0]) - 1, 14, -1) if m[0][i] == " "]]
        end = next((e for e in ends if mod97(text[m.start() : e])), None)
        if end:
            yield m.start(), end


def score(text: str, start: int, kind: str) -> float:
    """The kind's prior, raised if a context word stands near before the span. Words are whole ones, in lower case."""
    near = text[max(0, start - NEAR) : start].lower()
    return min(1.0, PRIOR[kind] + BONUS * bool(NEAR_WORDS[kind].search(near)))


def scan_text(text: str) -> tuple[list, list, list[float]]:
    """Base spans, all spans, and the score of each of all. Spans of own kinds need a right checksum, or for kinds
    without one a score of LEAST_SCORE; base spans stay whatever their score."""
    base = sorted(base_spans(text))
    more = [(s, 4, e, "iban") for s, e in iban_spans(text)]
    more += [(m.start(), 5, m.end(), "ssn") for m in SSN.finditer(text) if score(text, m.start(), "ssn") >= LEAST_SCORE]
    every = sorted(base + more)
    return base, every, [score(text, s[0], s[3]) for s in every]


def spelled(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [[], [], [], []]
        sha, spans, scores = [], [], []
        for text in batch.column(1).to_pylist():
            base, every, marks = scan_text(text)
            for k in range(4):
                counts[k].append(sum(s[1] == k for s in base))
            sha.append(hashlib.sha256(spelled(base).encode()).hexdigest())
            spans.append(spelled(every))
            scores.append(marks)
        columns = [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(scores, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, ["id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "scores"])


def scan_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, counts of the base kinds, base_sha256, spans (kind:start:end) and their scores.

    Null texts count as empty; repeated rows are each scanned; null ids stay null; other columns don't matter.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("text"))
    return rows.mapInArrow(_batches, SCHEMA.replace("id string", f"id {kind}", 1)).withColumnRenamed("id", id_col)
