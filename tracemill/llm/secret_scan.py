"""Secrets: known shapes by pattern, and unknown ones by their zstandard novelty against what surrounds them.

Beside the base patterns, a string of 16 or more key characters within REACH characters of a sensitive cue, before or behind it, is a
candidate, and so is one on the line after or before such a secret, and on from there; a cue within a string parts it. Its novelty
is what it adds to the compressed size of its surroundings, per character: the compressor is primed with a dictionary of
identifiers and common code, and the text before and after the candidate comes first, so a name that is spelled out of
known words or stands nearby costs little, and a random key costs nearly its length. Candidates at `least` bytes a
character or more are reported as `novel`, unless a base span overlaps them. Shape rules: strings of which
SPELLED or more is spelled out in pieces that look like words, as paths and names with numbers are, are not reported; nor are strings without a digit if `wordlike` or more of their pairs of letters are common ones of words (a long word costs as much as a key, so no
bound on novelty tells them apart), and strings without a letter are not reported. Each line is a span. Two forms are taken without their own novelty: a line of less than
16 key characters that ends a secret of several lines (after two of equal length if it is no word, before a PEM end, or
itself ending in =),
and all lines of key characters in a PEM private key that has a novel one.

Null and empty texts give no spans. A null doc_id stays null, repeated rows each get their row, other columns are ignored by
secrets() and kept by redact(); an empty table gives no rows. Spans of one kind never overlap, those of different kinds may
(both are listed); masks cover their union once. The time is linear in the text's length.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "novel")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
CUES = ("key", "token", "secret", "passw", "pwd", "auth", "bearer", "credential", "private")
#: How words with a cue go on, else a cue within a longer word, as in keyboard or author, is none.
ENDINGS = re.compile(r"(?:s|ord|ords|d|ds|phrase|orization|entication|orized|entials)?(?![a-z])", re.IGNORECASE | re.ASCII)
#: Characters between a cue and a candidate at most, and characters of surroundings on each side.
REACH, AROUND = 48, 256
#: Share of spelled-out characters from which a string is a path or a name, whatever its digits.
SPELLED = 0.4
#: What stands between two lines of a secret, a short last line, and the lines of a PEM private key.
GAP = re.compile(r"""[ \t"',;+\\]{0,8}(?:\r?\n|\\r|\\n)[ \t"'>*#\\]{0,32}""")
TAIL = re.compile(GAP.pattern + r"(?!-----)([A-Za-z0-9+/_=-]{1,15})(?![A-Za-z0-9+/_=-])")
ALONE = re.compile(r"""["',;\\]*[ \t]*(?:\r?\n|\\r|\\n|\Z)|["']""")
PEM_BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]{0,32}PRIVATE KEY[A-Z ]{0,32}-----")
PEM_LINE = re.compile(r"""^[ \t"'>*#]*([A-Za-z0-9+/=]+)[ \t"',;+\\]*\r?$""", re.MULTILINE)
#: Identifiers and common code, as they stand around secrets without being any.
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key secret_key private_key public_key client_id client_secret auth authorization bearer "
    "credentials username user_name email host hostname port url endpoint config configuration settings environment environ getenv os.environ "
    "import from return function def class const let var public private static final void string String int Integer boolean true false null None "
    "self this new response request session cookie header headers content type application json text html charset utf-8 http https localhost "
    "database db_name connection connect server client service account project region bucket example test sample default value values name key "
    "id uuid hash digest sha256 md5 base64 encode decode encrypt decrypt signature sign verify certificate BEGIN END PRIVATE PUBLIC KEY CERTIFICATE "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 the and for with that this from are was not have "
)
_state: dict[str, object] = {}


#: Common pairs of letters in English, German, French and Spanish words.
PAIRS = frozenset(
    "th he in er an re nd at on nt ha es st en ed to it ou ea hi is or ti as te et ng of al de se le sa si ar ve ra ld ur ch ei ie ge un ic be ne di "
    "sc hr au ss la ai me em ue os ad ta co ci io no do pr tr ro li il ri ce ol om ma mi po pe pa ca ho us ut um ul lo na ni ns su ab ac am ap ba bi "
    "bl br bu cl ct da ec ee el ev ex fi fo fr gr id ig im iv ll mp mo nc op ot ow pl qu rs rt ry sh so sp tu vi we wi rd rm rk sk ck gu ag "
    "tt nn mm pp ff ef ft ga gi hn ht ke ki ko kt lt lu ls mu nk nu od og oo rb rg rn ru rv sw tz ud ug va vo zu ze ub ir ay ey".split()
)


def word_pairs(candidate: str) -> float:
    """The share of a string's pairs of neighbouring letters that are common in words; 1 if it has none."""
    low = candidate.lower()
    pairs = [a + b for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
    return sum(p in PAIRS for p in pairs) / len(pairs) if pairs else 1.0


PIECE = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def spelled(candidate: str, wordlike: float) -> float:
    """The share of a string's characters in pieces of four letters and more whose pairs are those of words; digits, signs and capitals part pieces."""
    return sum(len(p) for p in PIECE.findall(candidate) if len(p) >= 4 and word_pairs(p) >= wordlike) / len(candidate)


def is_cue(text: str, start: int, end: int) -> bool:
    """Whether a cue is a word, or a part of a name that a sign, a digit or a capital parts."""
    before = text[start - 1 : start]
    if before.isascii() and before.isalpha() and (before.islower() == text[start].islower() or before.isupper()):
        return False
    rest = ENDINGS.match(text, end)
    return rest is not None or text[start:end].islower() and text[end : end + 1].isupper()


def tools():
    if not _state:
        a = ahocorasick.Automaton()
        for c in CUES:
            for v in (c, c.upper(), c.capitalize()):
                a.add_word(v, len(v))
        a.make_automaton()
        primed = zstandard.ZstdCompressionDict(IDENTIFIERS.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        _state.update(cues=a, packer=zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False))
    return _state["cues"], _state["packer"]


def novelty(candidate: str, around: str) -> float:
    """Compressed bytes that the candidate adds to its surroundings, per byte of its own."""
    _, packer = tools()
    base = around.encode()
    own = candidate.encode()
    return (len(packer.compress(base + own)) - len(packer.compress(base))) / len(own)


def candidates(text: str) -> Iterator[tuple[int, int, list[tuple[int, int]], bool]]:
    """Strings of key characters in texts with a cue: start, end, the cues within, and whether there is a cue close by."""
    cues = [(last + 1 - size, last + 1) for last, size in tools()[0].iter(text) if is_cue(text, last + 1 - size, last + 1)]
    at = 0  # the first cue that ends at or behind the string's start
    for m in CANDIDATE.finditer(text) if cues else ():
        s, e = m.span()
        while at < len(cues) and cues[at][1] <= s:
            at += 1
        stop = at
        while stop < len(cues) and cues[stop][0] < e:
            stop += 1
        close = (at > 0 and s - cues[at - 1][1] <= REACH) or (stop < len(cues) and cues[stop][0] - e <= REACH)
        yield s, e, cues[at:stop], close


def pem_bodies(text: str) -> Iterator[tuple[int, int]]:
    """Where the bodies of PEM private keys start and stop, each from a BEGIN to the next END."""
    at = 0
    while m := PEM_BEGIN.search(text, at):
        stop = text.find("-----END", m.end())
        if stop < 0:
            return
        yield m.end(), stop
        at = stop + 8


def meet(spans: list[tuple[int, int]], others: list[tuple[int, int]], whole: bool = False) -> list[bool]:
    """For each of the spans whether one of the others overlaps it, or holds it whole; both are sorted and disjoint in themselves."""
    found, k = [], 0
    for s, e in spans:
        while k < len(others) and others[k][1] <= s:
            k += 1
        found.append(k < len(others) and (others[k][0] <= s and e <= others[k][1] if whole else others[k][0] < e))
    return found


def next_line(text: str, end: int, start: int) -> bool:
    """Whether a string that ends at `end` is followed by one that starts the next line at `start`; the n of an escaped end of line is a key character."""
    return GAP.fullmatch(text, end, start) is not None or (text[start - 1] == "\\" and text[start] in "nr" and GAP.fullmatch(text, end, start + 1) is not None)


def find(text: str, least: float = 0.7, wordlike: float = 0.65) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in code points, end exclusive, ascending."""
    found = {"assign": [m.span() for m in ASSIGN.finditer(text) if len(m.group(2)) >= 12] if ":" in text or "=" in text else []}
    found["access"] = [m.span() for m in ACCESS.finditer(text) if len(m.group()) >= 18] if "AKIA" in text else []
    found["hex"] = [m.span() for m in HEX.finditer(text)]
    covered: list[tuple[int, int]] = []
    for a, b in sorted(x for spans in found.values() for x in spans):
        covered.append((a, b))
        if len(covered) > 1 and a < covered[-2][1]:
            covered[-2:] = [(covered[-2][0], max(b, covered[-2][1]))]

    def free(s: int, e: int) -> bool:
        k = bisect_left(covered, (e, -1))
        return not k or covered[k - 1][1] <= s

    def is_novel(s: int, e: int) -> bool:
        own = text[s:e]
        if e - s < 16 or not any(map(str.isalpha, own)) or not free(s, e):
            return False
        if spelled(own, wordlike) >= SPELLED or not any("0" <= c <= "9" for c in own) and word_pairs(own) >= wordlike:
            return False
        return novelty(own, text[max(0, s - AROUND) : s] + text[e : e + AROUND]) >= least

    novel, ended, width = [], -1, 0  # where the last secret ended and its last line's length
    last, waiting = -1, []  # where the last string ended, and lines up to there that no cue is near
    for s, e, inner, close in candidates(text):
        joined = last >= 0 and s - last <= 48 and next_line(text, last, s)
        goes_on, waiting, last = joined and last == ended, waiting if joined else [], e
        if not (close or inner or goes_on):
            waiting.append((s, e))
            continue
        if free(s, e):
            own = [(s, e)] if (close or goes_on) and is_novel(s, e) else []
            if not own and inner:
                own = [x for x in ((s, inner[0][0]), (inner[0][1], e)) if is_novel(*x)]
            if not own and len(inner) > 1:
                own = [x for x in zip([b for _, b in inner], [a for a, _ in inner[1:]] + [e]) if is_novel(*x)]
        else:  # a cue within parts the string, so a base span may leave a secret beside it
            own = [x for x in zip([s] + [b for _, b in inner], [a for a, _ in inner] + [e]) if inner and is_novel(*x)]
        novel += own
        if not own and free(s, e):
            waiting.append((s, e))
        elif not own or own[0][0] == s:
            while waiting and is_novel(*waiting[-1]):
                novel.append(waiting.pop())
            waiting = []
        if (own and own[-1][1] == e) or not free(s, e):
            again, width, ended = goes_on and e - s == width, e - s, e
            if (m := TAIL.match(text, e)) and ALONE.match(text, m.end(1)) and free(*m.span(1)):
                letters = not any("0" <= c <= "9" for c in m[1]) and word_pairs(m[1]) >= wordlike
                if (again and not letters) or m[1][-1] == "=" or "-----END" in text[m.end(1) : m.end(1) + 32]:
                    novel.append(m.span(1))
    novel.sort()
    for start, stop in pem_bodies(text) if "PRIVATE KEY" in text else ():
        own = [x.span(1) for x in PEM_LINE.finditer(text, start, stop) if free(*x.span(1))]
        first, last = bisect_left(novel, (start, -1)), bisect_left(novel, (stop, -1))
        if any(meet(own, novel[first:last])) or any(is_novel(*x) for x in own):
            inside = {x for x, hit in zip(novel[first:last], meet(novel[first:last], own, whole=True)) if hit}
            novel[first:last] = sorted([x for x in novel[first:last] if x not in inside] + own)
    found["novel"] = sorted(novel)
    return found


def listed(found: dict[str, list[tuple[int, int]]], kinds: tuple[str, ...]) -> str:
    order = sorted((s, kinds.index(k), e) for k in kinds for s, e in found[k])
    return ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in order)


def masked(text: str, found: dict[str, list[tuple[int, int]]], mask: str = "[SECRET]") -> str:
    """The text with every span of secrets replaced; overlapping spans are one."""
    out, at = [], 0
    for s, e in sorted(x for spans in found.values() for x in spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def secrets(docs: DataFrame, least: float = 0.7) -> DataFrame:
    """For each row of docs(doc_id, text): doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [find(t.as_py() or "", least) for t in b.column(1)]
            columns = {"doc_id": b.column(0)} | {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in KINDS}
            columns["base_sha256"] = pa.array([hashlib.sha256(listed(f, BASE_KINDS).encode()).hexdigest() for f in found], pa.string())
            columns["spans"] = pa.array([listed(f, KINDS) for f in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string")


def redact(docs: DataFrame, mask: str = "[SECRET]", least: float = 0.7) -> DataFrame:
    """docs with the secrets in `text` masked and n_chars, if there, set anew; all other columns and rows as they were. A null text stays null."""
    common.small_batches(docs.sparkSession)
    schema, at = docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else masked(t, find(t, least), mask) for t in b.column(at).to_pylist()]
            yield b.set_column(at, b.schema.names[at], pa.array(texts, pa.string()))

    out = common.map_rows(docs, run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
