"""Personal data by anchor expansion: an Aho-Corasick automaton finds cues, small parsers grow and check the spans.

Anchors are at-signs (emails), scheme separators (web addresses), plus signs (phones), and words that announce an account
or an identity number. Digit runs anchor addresses of hosts and cards. From an anchor, a parser walks left and right over
the characters its kind allows, bounded by the end of the span before, and validates: octets, the Luhn checksum, digit
counts, the IBAN checksum. Each parser is linear in what it walks over, also in hostile texts.

Null and empty texts give no spans. A null doc_id stays null, repeated rows each get their row, other columns are ignored,
and an empty table gives no rows. Spans of one kind never overlap, those of different kinds may.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "url", "account")
LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9][0-9.]*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SCHEME = re.compile(r"(?:https?|ftps?|sftp|ssh)\Z", re.I)
URL_REST = re.compile(r"[A-Za-z0-9\[\]._~:/?#@!$&'()*+,;=%-]+")
#: Words before an account or identity number, in lower case; the number follows within a few characters.
CUES = ("iban", "account no", "account number", "acct", "routing number", "sort code", "ssn", "social security", "passport", "tax id", "national id", "konto", "cuenta", "compte")
BEFORE_NUMBER = r"(?:[\x20\t]|no\.?|nr\.?|number|is|[:#=.-]){0,8}?"
IBAN = re.compile(BEFORE_NUMBER + r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})", re.I)
NUMBER = re.compile(BEFORE_NUMBER + r"([A-Z]{0,3}[0-9](?:[\x20-]?[0-9]){5,19})(?![A-Za-z0-9])", re.I)
_automaton = None


def automaton():
    global _automaton
    if _automaton is None:
        a = ahocorasick.Automaton()
        for cue in ("@", "://", "+", *(v for c in CUES for v in (c, c.title(), c.upper(), c.capitalize()))):
            a.add_word(cue, cue)
        a.make_automaton()
        _automaton = a
    return _automaton


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def iban_end(text: str, start: int, stop: int) -> int | None:
    """Where the longest valid IBAN from `start` ends, at the end of a word."""
    best, value, n = None, 0, 0
    head = "".join(str(int(c, 36)) for c in text[start : start + 4])
    for at in range(start + 4, stop):
        if text[at] == " ":
            continue
        d = int(text[at], 36)
        value, n = (value * (100 if d > 9 else 10) + d) % 97, n + 1
        if 11 <= n <= 30 and not text[at + 1 : at + 2].isalnum() and (value * 10 ** len(head) + int(head)) % 97 == 1:
            best = at + 1
    return best


def emails(text: str, ats: list[int]) -> Iterator[tuple[int, int]]:
    floor = 0
    for at in ats:
        start = at
        while start > floor and text[start - 1] in LOCAL_PART:
            start -= 1
        if at >= floor and start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = max(floor, at + 1)  # no local part reaches over an at-sign


def ips(text: str) -> Iterator[tuple[int, int]]:
    for run in DOTTED.finditer(text):
        if run.group().count(".") < 3:
            continue
        at, chain = run.start(), []
        for part in [*run.group().split("."), ""]:
            if part:
                chain.append((at, at + len(part), part))
                if len(chain) == 4:
                    if all(len(p) <= 3 and int(p) <= 255 or int(p[-3:]) <= 255 and not p[:-3].strip("0") for _, _, p in chain):
                        yield chain[0][0], chain[3][1]
                    chain = []
            else:
                chain = []
            at += len(part) + 1


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            yield m.span()


def urls(text: str, ends: list[int]) -> Iterator[tuple[int, int]]:
    floor = 0
    for end in ends:  # of a scheme separator
        m = SCHEME.search(text, max(floor, end - 8), end - 3) if end - 3 >= floor else None
        rest = URL_REST.match(text, end) if m else None
        if m and rest:
            stop = end + len(rest.group().rstrip(".,;:!?'()"))
            if stop > end:
                yield m.start(), stop
            floor = stop  # what a scheme has been read for is not read again


def accounts(text: str, ends: list[int]) -> Iterator[tuple[int, int]]:
    floor = 0
    for end in ends:  # of a cue
        if end < floor:
            continue
        m = IBAN.match(text, end)
        stop = iban_end(text, m.start(1), m.end(1)) if m else None
        if not stop and (m := NUMBER.match(text, end)):
            number = m.group(1)
            if not (number[:2].isalpha() and number[2:4].isdigit() and sum(map(str.isalnum, number)) >= 15):  # else an IBAN that isn't valid
                stop = m.end(1)
        if stop:
            yield m.start(1), stop
            floor = stop


def find(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive, ascending."""
    at: dict[str, list[int]] = {}
    for last, cue in automaton().iter(text):
        at.setdefault(cue if cue in ("@", "://", "+") else "account", []).append(last)
    found = {"email": list(emails(text, at["@"])) if "@" in at else []}
    found["ip"] = list(ips(text))
    found["card"] = list(cards(text))
    found["phone"] = list(phones(text)) if "+" in at else []
    found["url"] = list(urls(text, [x + 1 for x in at["://"]])) if "://" in at else []
    found["account"] = list(accounts(text, sorted({x + 1 for x in at["account"]}))) if "account" in at else []
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k in kinds for s, e in found[k])


def personal_data(docs: DataFrame) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_email, n_ip, n_card, n_phone, n_url, n_account, base_sha256, spans."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py() or "") for t in b.column(1)]
            columns = {"doc_id": b.column(0)} | {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS}
            columns["base_sha256"] = pa.array([hashlib.sha256(listed(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string())
            columns["spans"] = pa.array([listed(f, KINDS) for f in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")
