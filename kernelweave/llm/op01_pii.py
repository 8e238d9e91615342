"""Personal data: patterns propose spans, checksums confirm them, nearby context words adjust a score.

``find_pii(documents)`` returns for each row its spans (kind, start, end, score). The four base kinds (email, ip,
card, phone) follow fixed patterns and are always kept once their checks hold; their score only tells how sure the
method is. Further kinds and weaker patterns (IBAN by mod 97, cards and phone numbers in stricter forms, phone numbers
without a plus, national ids, secrets and access keys) are kept when checksum and context lift their score to ``threshold``.

Null or empty texts have no spans. Repeated rows are handled alone; other columns are passed by.
A private key counts from its first line to its last one, or, where that is missing, to the end of what can be a key's
body. Of overlapping proposals of one kind that of the earlier pattern stays.
Offsets are code points, the end is exclusive. Patterns and the check for overlaps take time linear in the text.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kernelweave.session import prepare, table

KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "secret")  # the order of ties

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DIGITS = re.compile(r"[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# each starts with a plain set of characters, which the scanner skips to quickly; what stands before is looked at after
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_SSN = re.compile(r"[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SECRET = re.compile(r"[:=]\s{0,3}[\"']?([A-Za-z0-9+/_.-]{8,})")
_SECRET_FORM = re.compile(r"(?:A[KS]IA[A-Z0-9]{16}|ghp_[A-Za-z0-9]{36})(?![A-Za-z0-9])")  # fixed forms of access keys
_KEY_BEGIN = re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----")
_KEY_END = re.compile(r"-----(?:END|BEGIN) [A-Z ]{0,20}PRIVATE KEY-----")
_KEY_BODY = re.compile(r"[A-Za-z0-9+/=:,\s-]*")
_PLUS_PHONE = re.compile(r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])")
_CARD_GROUPS = re.compile(r"[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])")
_SECRET_NAME = re.compile(r"(?i)\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)\s{0,3}\Z")
_WORD = re.compile(r"[a-z]+")

#: words within ``WINDOW`` code points of a span that lift its score
CONTEXT = {
    "email": {"mail", "email", "contact", "write", "reply"},
    "ip": {"ip", "host", "server", "address", "login"},
    "card": {"card", "visa", "mastercard", "amex", "credit", "payment", "debit"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax"},
    "iban": {"iban", "bank", "account", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "secret": set(),
}
WINDOW = 40


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the e-mail pattern, found from each @ outwards so that long runs of letters cost linear time."""
    at, floor = text.find("@"), 0
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            floor = m.end()
        else:
            floor = at + 1
        at = text.find("@", floor)


def ips(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost dotted quads; whole digit runs are read once, so that long runs of digits cost linear time."""
    held: list[tuple[int, int]] = []
    for m in _DIGITS.finditer(text):
        if held and not (m.start() == held[-1][1] + 1 and text[m.start() - 1] == "."):
            held = []
        held.append(m.span())
        if len(held) == 4:
            parts = [text[s:e].lstrip("0") or "0" for s, e in held]
            if all(len(x) <= 3 and int(x) <= 255 for x in parts):
                yield held[0][0], held[3][1]
            held = []


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the four base kinds; a match that fails its check is dropped and not tried again."""
    found = [(s, "email", e) for s, e in emails(text)] if "@" in text else []
    found += [(s, "ip", e) for s, e in ips(text)]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start():
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), "card", m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), "phone", m.end()))
    return found


def _near(text: str, start: int, end: int, kind: str) -> int:
    near = text[max(0, start - WINDOW) : start] + " " + text[end : end + WINDOW]
    return len(CONTEXT[kind].intersection(_WORD.findall(near.lower())))


def private_keys(text: str) -> Iterator[tuple[int, int]]:
    """From each first line of a key to its last line; a key that is cut off ends where its body does."""
    m = _KEY_BEGIN.search(text) if "PRIVATE KEY" in text else None
    while m:
        last = _KEY_END.search(text, m.end())
        whole = last is not None and last.group().startswith("-----END")
        end = last.end() if whole else _KEY_BODY.match(text, m.end(), last.start() if last else len(text)).end()
        yield m.start(), end
        m = _KEY_BEGIN.search(text, end)


def more_spans(text: str) -> list[tuple[int, str, int, float]]:
    """Proposals of the weaker patterns with the score of pattern and checksum, pattern by pattern; context is added later."""
    found = []
    free = lambda m: not (m.start() and (text[m.start() - 1].isalnum() or text[m.start() - 1] in "+.-"))
    for m in _IBAN.finditer(text):
        if free(m) and mod97(m.group()):
            found.append((m.start(), "iban", m.end(), 0.9))
    for m in _SSN.finditer(text):
        a, b, c = m.group().split("-")
        if free(m) and a not in ("000", "666") and a < "900" and b != "00" and c != "0000":
            found.append((m.start(), "ssn", m.end(), 0.3))
    for m in _LOCAL_PHONE.finditer(text):
        if free(m):
            found.append((m.start() - (")" in m.group() and text[m.start() - 1 : m.start()] == "("), "phone", m.end(), 0.3))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m.group().replace(" ", "").replace("-", "")
            if len(digits) == 13 and luhn(digits):
                found.append((m.start(), "card", m.end(), 0.3))
    # numbers that stand next to each other make one long base match that fails; the stricter forms find each alone
    for m in _CARD_GROUPS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if free(m) and 13 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), "card", m.end(), 0.6))
    if "+" in text:
        for m in _PLUS_PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append((m.start(), "phone", m.end(), 0.6))
    for m in _SECRET_FORM.finditer(text):
        if free(m):
            found.append((m.start(), "secret", m.end(), 0.9))
    found += [(s, "secret", e, 0.9) for s, e in private_keys(text)]
    for m in _SECRET.finditer(text):
        if any(c.isdigit() for c in m.group(1)) and _SECRET_NAME.search(text[max(0, m.start() - 24) : m.start()]):
            found.append((m.start(1), "secret", m.end(1), 0.8))
    return found


def spans(text: str, threshold: float = 0.5) -> list[tuple[str, int, int, float, bool]]:
    """All spans of a text as (kind, start, end, score, base), by start and then kind."""
    held: dict[str, list] = {k: [] for k in KINDS}
    for s, k, e in base_spans(text):
        held[k].append((k, s, e, min(1.0, 0.8 + 0.1 * _near(text, s, e, k)), True))
    # proposals come pattern by pattern; those of one pattern and kind are in order and apart
    for (k, _), group in itertools.groupby(_numbered(more_spans(text)), key=lambda x: x[0]):
        scored = [(k, s, e, min(1.0, score + 0.3 * _near(text, s, e, k)), False) for _, (s, _, e, score) in group]
        held[k] = _merged(held[k], [x for x in scored if x[3] >= threshold])
    return sorted((x for own in held.values() for x in own), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def _numbered(proposals: list[tuple[int, str, int, float]]) -> Iterator[tuple[tuple[str, int], tuple]]:
    """Each proposal under its kind and the number of its run; a run ends where the kind changes or the place goes back."""
    run, last = 0, None
    for x in proposals:
        if last and (x[1] != last[1] or x[0] < last[2]):
            run += 1
        yield (x[1], run), x
        last = x


def _merged(first: list, more: list) -> list:
    """Both lists of spans that are in order and apart, without those of ``more`` that overlap one of ``first``."""
    out, i = [], 0
    for x in more:
        while i < len(first) and first[i][2] <= x[1]:
            out.append(first[i])
            i += 1
        if i == len(first) or x[2] <= first[i][1]:
            out.append(x)
    return out + first[i:]


def find_pii(documents: DataFrame, text: str = "text", key: str = "doc_id", threshold: float = 0.5) -> DataFrame:
    """One row per document: key, spans array<struct<kind,start,end,score,base>>. One map over the whole texts, no shuffle."""
    prepare(documents.sparkSession)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("base", pa.bool_())]))

    def run(batches):
        for b in batches:
            found = [[dict(zip(("kind", "start", "end", "score", "base"), x)) for x in spans(t or "", threshold)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=[key, "spans"])

    return documents.select(F.col(key), F.col(text).alias("text")).mapInArrow(run, f"{key} {documents.schema[key].dataType.simpleString()}, spans array<struct<kind:string,start:bigint,end:bigint,score:double,base:boolean>>")


def redact(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents with each span replaced by ``<KIND>``; overlapping spans become one, named by the first."""
    prepare(documents.sparkSession)
    schema = documents.schema
    at = schema.names.index("text")

    def clean(t: str) -> str:
        out, end = [], 0
        for k, s, e, _, _ in spans(t, threshold):
            if s >= end:
                out += [t[end:s], f"<{k.upper()}>"]
            end = max(end, e)
        return "".join(out) + t[end:] if out else t

    def run(batches):
        for b in batches:
            text = pa.array([None if t is None else clean(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([text if i == at else c for i, c in enumerate(b.columns)], names=b.schema.names)

    return documents.mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["base"])
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    kinds = F.transform(base, lambda x: x["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"))
