"""Main text of web pages by a maximum-scoring run of tokens.

A page is a sequence of words and tags. Each has a weight: the log-odds of standing inside the main content rather than
outside it, learned from labelled pages, which are pages with one article (or main) element, whose inside is the label.
Words are told apart by the kind of element they stand in (a link, a list, a footer, an advert, ...), so words of prose
score above zero and tags, and words of boilerplate, below. A linear scan (running sum, restarted when it falls to zero)
finds the run with the greatest sum: the content region. Boilerplate elements inside the region are left out, and what
is left is cut into blocks at block-level tags.

Boilerplate is told by tag or role (menus, footers, asides, forms, ...), or by class or id, where a whole name must say so:
`related` or `comment-list`, but not `related-work` or `notice-board`. An element whose class says so is none
if it holds more than half of the page's words and no article or main element stands outside it. Where an article or main element holds nearly all words of the best run,
the region is widened to the whole element, the smallest such; it is never cut.

Null and empty pages give an empty text. Repeated rows each get their row, other columns are ignored, and an empty table
gives no rows. Unclosed tags, broken comments and stray brackets are read as browsers do, as far as this needs; the time
is linear in the page's length, however tags are nested.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)>|[^<]+|<", re.S)
#: Elements whose text is no text of the page; of the first ones the content is no markup either.
RAW = frozenset("script style noscript template textarea iframe".split())
UNSEEN = RAW | frozenset("select title head".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
INLINE = frozenset("b i em strong a span font u small code".split())
#: Elements that end tags of other elements do not close.
BARRIERS = frozenset("article main table body".split())
#: Elements that are boilerplate; elements, roles and names in class or id (alone or with qualifiers only) that are unless they hold most of the page.
DROPPED = frozenset("nav footer aside button menu search".split()) | UNSEEN
WRAPPERS = frozenset("form dialog".split())
ROLES = frozenset("navigation banner complementary contentinfo search menu menubar dialog alertdialog form".split())
NAMES = frozenset(
    "nav navbar navigation menu footer sidebar aside ad ads advert adverts advertisement banner promo promotion sponsor sponsored cookie cookies consent notice popup modal "
    "newsletter subscribe share sharing social comment comments replies disqus respond related recommended breadcrumb breadcrumbs pagination pager widget toolbar masthead "
    "copyright disclaimer login search".split()
)
QUALIFIERS = frozenset(
    "site page top bottom left right main primary secondary global header mobile desktop box block list bar section area wrapper wrap container inner outer content button "
    "buttons link links icon icons form signup slot unit posts articles stories items item thread count author text body reader user google media policy privacy".split()
)
ATTRIBUTES = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
TELLING = re.compile(r"class|id|role|hidden", re.I)
CLOSES_P = BLOCKS - {"br", "button", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "html", "body", "option", "optgroup", "legend", "li", "dd", "dt"}
SPACE = re.compile(r"\s+")
WORD = re.compile(r"\S+")


def says_boilerplate(names: str) -> bool:
    """Whether one of the names of a class or id attribute is a boilerplate name with nothing but qualifiers beside it."""
    for name in names.lower().split():
        words = [w.rstrip("0123456789") for w in re.split(r"[-_]+", name)]
        words = [w for w in words if w]
        if any(w in NAMES for w in words) and all(w in NAMES or w in QUALIFIERS for w in words):
            return True
    return False


def boilerplate(tag: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element is boilerplate by its tag, and whether its kind, role, class or id or being hidden says so."""
    if tag in DROPPED or tag in WRAPPERS:
        return tag in DROPPED, tag in WRAPPERS
    if not attributes or tag in ("html", "body", "article", "main") or not TELLING.search(attributes):
        return False, False
    named = False
    for name, *value in ATTRIBUTES.findall(attributes):
        name, text = name.lower(), "".join(value)
        named = named or name == "hidden" or name == "role" and text.strip().lower() in ROLES or name in ("class", "id") and says_boilerplate(text)
    return False, named


class Open(NamedTuple):
    """An open element: its tag, whether it is boilerplate or within such, its first token, where a p is that a block closes, or -1, and
    whether something says that it is boilerplate."""

    tag: str
    drop: bool
    first: int
    p: int
    named: bool


class Page:
    """Tokens of a page: `kinds` are what weights are for, `texts` the words of text tokens, `drop` whether a token is in boilerplate.

    Tokens are tags and pieces of text between tags; a piece counts for its words. `elements` lists each article or main
    element as (first token, end), `block` the tokens that end a block.
    """

    def __init__(self, page: str) -> None:
        self.kinds: list[str] = []
        self.sizes: list[int] = []
        self.texts: list[str | None] = []
        self.drop: list[bool] = []
        self.block: list[bool] = []
        self.elements: list[tuple[int, int]] = []
        self.named: list[tuple[int, int]] = []  # elements that something says are boilerplate, as (first token, end)
        self.stack: list[Open] = []
        self.places: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a tag are
        self.barriers: list[int] = []
        stack, at, low, last = self.stack, 0, None, page.rfind(">")
        while m := TOKEN.match(page, at):
            if m.group() == "<" and page[at + 1 : at + 2].isalpha() or at > last and m.group()[:1] == "<" and not m.group().startswith("<!--"):
                self.add_text(page[at:])  # no tag ends any more
                break
            at = m.end()
            tag = m.group(2)
            if tag is None:
                if not m.group().startswith(("<!", "<?")):
                    self.add_text(m.group())
                continue
            tag = tag.lower()
            if m.group(1):
                self.close(tag)
                continue
            bad, named = boilerplate(tag, m.group(3))
            bad = bad or tag == "header" and not self.places["article"] and not self.places["main"]
            if tag in CLOSES_P and stack and stack[-1].p >= 0:
                self.pop_to(stack[-1].p)
            elif tag in ("li", "td", "th", "tr", "option", "dd", "dt", "a") and self.places[tag] and (tag == "a" and self.in_link() or stack[-1].tag == tag):
                self.pop_to(self.places[tag][-1])
            inside = bool(stack) and stack[-1].drop
            self.add(f"<{tag}{' bad' if (bad or named) and tag not in DROPPED | WRAPPERS else ''}", 1, None, bad or inside, tag in BLOCKS)
            if tag in VOID or m.group(3).endswith("/") and tag not in BLOCKS:
                continue
            here = len(stack)
            if tag in BARRIERS:
                self.barriers.append(here)
            self.places[tag].append(here)
            stack.append(Open(tag, bad or inside, len(self.kinds) - 1, here if tag == "p" else stack[-1].p if tag in INLINE and stack else -1, named and not (bad or inside)))
            if tag in RAW or tag == "title" and self.places["head"]:
                low = low or page.lower() if page.isascii() else low or re.sub(r"[A-Z]+", lambda x: x.group().lower(), page)
                end = low.find(f"</{tag}", at)
                at = len(page) if end < 0 else end
        self.pop_to(0)
        self.drop_named()

    def add(self, kind: str, size: int, text: str | None, drop: bool, block: bool) -> None:
        self.kinds.append(kind)
        self.sizes.append(size)
        self.texts.append(text)
        self.drop.append(drop)
        self.block.append(block)

    def in_link(self) -> bool:
        return bool(self.places["a"]) and (not self.barriers or self.places["a"][-1] > self.barriers[-1])

    def add_text(self, text: str) -> None:
        n = len(WORD.findall(text))
        drop = bool(self.stack) and self.stack[-1].drop
        if n == 0:
            if self.texts and text:
                self.add("space", 0, text, drop, False)
            return
        where = "bad" if drop else "link" if self.in_link() else "list" if self.stack and self.stack[-1].tag in ("li", "td", "th") else "prose"
        self.add(f"word {where}", n, text, drop, False)

    def pop_to(self, depth: int) -> None:
        """Close open elements until only `depth` are left."""
        while len(self.stack) > depth:
            tag, drop, first, _, named = self.stack.pop()
            self.places[tag].pop()
            if tag in BARRIERS:
                self.barriers.pop()
            self.add(f"</{tag}", 1, None, drop, tag in BLOCKS)
            if tag in ("article", "main"):
                self.elements.append((first, len(self.kinds)))
            if named:
                self.named.append((first, len(self.kinds)))

    def close(self, tag: str) -> None:
        places = self.places.get(tag)
        if not places:
            return
        if tag not in ("html", "body", "article", "main", "table", "div", "section") and self.barriers and self.barriers[-1] > places[-1]:
            return  # a stray end tag doesn't close what holds it
        self.pop_to(places[-1])

    def drop_named(self) -> None:
        """Mark what is in elements that something says are boilerplate, but for one that holds more than half of the words and any article there
        is, such as a form around the whole page; within that, elements are looked at for themselves."""
        words = [0]
        for size, text, drop in zip(self.sizes, self.texts, self.drop):
            words.append(words[-1] + size * (text is not None and not drop))
        starts, done = sorted(a for a, _ in self.elements), 0
        for first, end in sorted(self.named):
            if first < done:
                continue
            inside = bisect_left(starts, end) - bisect_left(starts, first)  # elements do not cross
            if 2 * (words[end] - words[first]) <= words[-1] or inside < len(starts):
                done = end
                for k in range(first, end):
                    self.drop[k] = True
                    if self.sizes[k] and self.texts[k] is not None:
                        self.kinds[k] = "word bad"

    def best_run(self, weights: dict[str, float]) -> tuple[int, int]:
        """First token and end of the run with the greatest sum; the first such run, empty if none is above zero."""
        best, begin, total, found = 0.0, 0, 0.0, (0, 0)
        for k, (kind, size, drop) in enumerate(zip(self.kinds, self.sizes, self.drop)):
            if total <= 0:
                total, begin = 0.0, k
            weight = weights.get(kind)
            if weight is None:
                weight = DEFAULT_TAG if kind[0] == "<" else DEFAULT_WORDS.get(kind, 0.0)
            total += weight * size * (IN_BOILERPLATE if drop else 1)
            if total > best:
                best, found = total, (begin, k + 1)
        return found

    def text(self, weights: dict[str, float]) -> str:
        first, end = self.best_run(weights)
        words = [0]
        for kind, size, drop in zip(self.kinds, self.sizes, self.drop):
            words.append(words[-1] + size * (kind[0] == "w" and not drop))
        held = [e for e in self.elements if words[min(end, e[1])] - words[min(max(first, e[0]), min(end, e[1]))] >= HELD * (words[end] - words[first])]
        if held and first < end:
            whole = min(held, key=lambda e: e[1] - e[0])
            first, end = min(first, whole[0]), max(end, whole[1])
        out, block = [], []

        def flush() -> None:
            if line := SPACE.sub(" ", entities.unescape("".join(block))).strip():
                out.append(line)
            block.clear()

        for k in range(first, end):
            if self.texts[k] is not None:
                if not self.drop[k]:
                    block.append(self.texts[k])
            elif self.block[k]:
                flush()
        flush()
        return "\n".join(out)


#: Weights of kinds that no labelled page has, the limits of weights, how much tokens count that are left out anyway, and
#: the share of the run's words that an element must hold to be the region.
DEFAULT_TAG, DEFAULT_WORDS = -1.0, {"word prose": 0.5, "word list": 0.2, "word link": -0.5, "word bad": -1.0}
WORD_LIMIT, TAG_LIMIT, IN_BOILERPLATE, HELD = 1.0, 3.0, 0.05, 0.9


def kind_counts(page: str) -> Counter:
    """(kind, inside) -> words or tags, for a page with exactly one outermost article or main element; empty for others."""
    p = Page(page)
    outer = [e for e in p.elements if not any(o != e and o[0] <= e[0] and e[1] <= o[1] for o in p.elements)]
    if len(outer) != 1:
        return Counter()
    found: Counter = Counter()
    for k, (kind, size) in enumerate(zip(p.kinds, p.sizes)):
        if size:
            found[kind, outer[0][0] <= k < outer[0][1]] += size
    return found


def learn(pages: DataFrame, sample_rows: int = 2000, smoothing: float = 5.0) -> dict[str, float]:
    """Weights by kind of token from labelled pages, a sample of at most sample_rows by a hash of the page's id.

    Kinds are tag names and a few kinds of word, so what reaches the driver is small. Weights are held within
    WORD_LIMIT and TAG_LIMIT; words in boilerplate are never above zero, words of prose at least 0.1, and no tag is above zero.
    """
    common.small_batches(pages.sparkSession)
    labelled = pages.where(F.col("html").contains("<article") | F.col("html").contains("<main"))
    # ids first: only the chosen pages' html moves, however many tasks there are
    chosen = labelled.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample_rows)
    rows = labelled.join(F.broadcast(chosen), labelled["page_id"].eqNullSafe(chosen["page_id"]), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in batches:
            for page in b.column(0).to_pylist():
                total.update(kind_counts(page or ""))
        keys = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([i for _, i in keys], pa.bool_()), pa.array([total[k] for k in keys], pa.int64())], names=["kind", "inside", "n"])

    counted = rows.select(F.col("html").cast("string").alias("html")).mapInArrow(run, "kind string, inside boolean, n long")
    by: dict[str, list[int]] = {}
    for r in counted.groupBy("kind").agg(F.sum(F.col("n") * F.col("inside").cast("int")).alias("i"), F.sum("n").alias("n")).collect():
        by[r.kind] = [r.i, r.n - r.i]
    inside, outside = (sum(v[k] for v in by.values()) for k in (0, 1))
    weights = {}
    for kind, (i, o) in by.items():
        w = math.log((i + smoothing) / (inside + smoothing * 50)) - math.log((o + smoothing) / (outside + smoothing * 50))
        limit = TAG_LIMIT if kind[0] == "<" else WORD_LIMIT
        low, high = {"word prose": (0.1, limit), "word bad": (-limit, 0.0)}.get(kind, (-limit, -0.05 if kind[0] == "<" else limit))
        weights[kind] = max(low, min(high, w))
    return weights


def main_texts(pages: DataFrame, weights: dict[str, float] | None = None, sample_rows: int = 2000) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of pages(page_id, url, html)."""
    common.small_batches(pages.sparkSession)
    weights = learn(pages, sample_rows) if weights is None else weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [Page(t or "").text(weights) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
