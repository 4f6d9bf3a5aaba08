"""Personal data in texts: patterns propose, checksums confirm, context adjusts.

Four base kinds are found by fixed patterns and kept whatever their score.
Further kinds (international bank account numbers, social security numbers,
secrets in assignments) are added where their checksum holds or a word
nearby speaks for them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import slices

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")
BASE = KINDS[:4]

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: The look-behinds only skip starts inside a run of digits, where a match would have begun at the run's start; they keep long runs linear.
IP = re.compile(r"[0-9](?<![0-9][0-9])[0-9]*(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"[A-Z]{2}(?<![A-Za-z0-9][A-Z]{2})[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
SSN = re.compile(r"[0-9]{3}(?<![0-9-][0-9]{3})-[0-9]{2}-[0-9]{4}(?![0-9-])")
SECRET = re.compile(r"(?:password|passwd|secret|token|api_key)\s*[=:]\s*\"?([A-Za-z0-9_/+-]{12,})")
DIGIT = re.compile(r"[0-9]")

#: Words that raise a kind's score when they stand, whole or in the plural, within NEAR code points before the span.
CONTEXT = {
    "email": ("mail", "email", "e-mail", "contact", "write"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment"),
    "phone": ("phone", "call", "tel", "mobile"),
    "iban": ("iban", "bank", "account"),
    "ssn": ("ssn", "social", "security"),
    "secret": ("password", "passwd", "secret", "token", "api_key", "key"),
}
#: Words before a span that speak against its being anybody's.
AGAINST = ("example", "sample", "dummy", "version", "placeholder")
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4, "secret": 0.7}
NEAR = 48
BONUS, MALUS = 0.2, 0.2
LEAST = 0.5
_FOR = {k: re.compile(r"(?<![a-z0-9_-])(?:" + "|".join(map(re.escape, words)) + r")s?(?![a-z0-9-])") for k, words in CONTEXT.items()}
_AGAINST = re.compile(r"(?<![a-z0-9_-])(?:" + "|".join(AGAINST) + r")s?(?![a-z0-9-])")


def luhn(digits: str) -> bool:
    """Whether the digits pass the Luhn check."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def mod97(account: str) -> bool:
    """Whether an account number passes the mod-97 check: country and check digits at the end, letters as 10 to 35."""
    moved = account[4:] + account[:4]
    return 15 <= len(account) <= 34 and int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the e-mail pattern, found from each @ outwards.

    The local part cannot hold an @, so a match has exactly one, and starts
    with the longest run of local characters before it that no earlier match has taken.
    """
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def score(kind: str, text: str, start: int) -> float:
    """The kind's prior, raised by its context words shortly before the span and lowered by words that speak against it."""
    before = text[max(0, start - NEAR) : start].lower()
    value = PRIOR[kind] + BONUS * bool(_FOR[kind].search(before)) - MALUS * bool(_AGAINST.search(before))
    return round(min(1.0, max(0.0, value)), 2)


def find(text: str) -> list[tuple[int, int, str, float]]:
    """All spans (start, end, kind, score) of a text in code points, by start, then kind in KINDS' order."""
    spans: list[tuple[int, int, str]] = [(s, e, "email") for s, e in emails(text)] if "@" in text else []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(x.lstrip("0")) <= 3 and int(x[-3:]) <= 255 for x in m[0].split(".")):
                spans.append((m.start(), m.end(), "ip"))
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 12:
                digits = m[0].replace(" ", "").replace("-", "")
                if 12 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                    spans.append((m.start(), m.end(), "phone"))
        for m in IBAN.finditer(text):
            if mod97(m[0].replace(" ", "")):
                spans.append((m.start(), m.end(), "iban"))
        if "-" in text:
            for m in SSN.finditer(text):
                if m[0][:3] in ("000", "666") or m[0][0] == "9" or m[0][4:6] == "00" or m[0][7:] == "0000":
                    continue  # numbers that are never given out
                spans.append((m.start(), m.end(), "ssn"))
    if "=" in text or ":" in text:
        for m in SECRET.finditer(text):
            spans.append((m.start(1), m.end(1), "secret"))
    scored = [(s, e, k, score(k, text, s)) for s, e, k in spans]
    kept = [x for x in scored if x[2] in BASE or x[3] >= LEAST]
    return sorted(kept, key=lambda x: (x[0], KINDS.index(x[2])))


def scan(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """For every row: the ``keep`` columns and found array<struct<start, end, kind, score>>.

    Null and empty texts have no spans. Offsets are code points, the end is
    exclusive; spans of different kinds may overlap. Long texts are scanned whole.
    """
    keep = ["doc_id"] if keep is None else keep
    n = len(keep)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("score", pa.float64())]))
    out_type = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + ["found array<struct<start: bigint, end: bigint, kind: string, score: double>>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = [[] if not t else [{"start": s, "end": e, "kind": k, "score": x} for s, e, k, x in find(t)] for t in batch.column(n).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], pa.array(found, kind)], [*keep, "found"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], "text").mapInArrow(run, out_type)


def redact_text(text: str | None) -> str | None:
    """The text with each span replaced by its kind in brackets; overlapping spans are replaced as one, by the kind of the first, then the longest."""
    if not text:
        return text
    out, free = [], 0
    for s, e, kind, _ in sorted(find(text), key=lambda x: (x[0], -x[1])):
        if s >= free:
            out += [text[free:s], f"[{kind}]"]
        free = max(free, e)
    return "".join(out) + text[free:] if out else text


def redact(docs: DataFrame) -> DataFrame:
    """All columns and rows, with personal data in text replaced. Nulls stay null."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            new = pa.array([redact_text(t) for t in batch.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([new if k == at else c for k, c in enumerate(batch.columns)], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Counts, digest, list and scores of the personal data in every document; null and empty texts have none, an empty list and the digest of an empty text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    said = F.transform("found", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("found", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    n = [count(kind) for kind in BASE]
    found = scan(docs.select("doc_id", "text"))
    text = F.array_join(F.transform(base, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *n, F.sha2(text.cast("binary"), 256).alias("base_sha256"), F.array_join(said, ",").alias("spans"), F.array_join(F.transform("found", lambda x: x["score"].cast("string")), ",").alias("scores"))
