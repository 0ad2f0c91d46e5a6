"""Benchmark decontamination by CGK embedding: passages within a small edit distance of a benchmark item.

Texts are words in lower case, split at white space. An item of n words is found in a document where a window of the
document is within floor(max_edits * n) word edits of it.
1. Windows: items of 2 * SEGMENT words or more are cut into parts of SEGMENT words or a little more, shorter ones are one
   part. Of an item within its edits some part is within its share of them. A window is as wide as a part and starts at any
   word; windows with more words that no item has than the part may have edits are left out, which loses no match.
2. Candidates: the CGK random walk embeds windows and parts into strings whose Hamming distance follows the edit distance. It
   gives out the symbol it stands at and then stays or moves on, as a hash of repetition, step and symbol says, so it needs
   no table. Each repetition has its own walk and its own sample of steps, taken from those in which the walk is still within
   the part (twice as many as it has words). The sampled symbols are the key of a hash table of the parts; a window and a
   part with equal keys in some repetition are a candidate. The number of repetitions follows from `recall`, the number of
   samples from how many parts there are, so that few windows meet a part by chance.
3. Verification: the exact edit distance of the item to the best substring around the window.

Items are a stated query set: they are read in blocks of at most `block_bytes` and each block is one pass over the
documents, so that what the tasks are sent stays bounded however many items there are; a worker's memory is a small
multiple of the block, whatever an item's length, and a long document is worked on in parts.

Null and empty texts contain nothing; null or empty items match nothing. Null ids are kept in the result. Repeated rows
are found each. Items of fewer than `least_words` words are only looked for as they are. Other columns are ignored by
contaminated() and kept by clean(); empty tables give no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Steps of two walks that differ for each edit of words, on average, before they meet again; of a part's 2 * words steps.
WALK_COST = 4.0
#: Words of a part at least, windows that are walked at once, and bits of the table that says whether a key is worth a look.
SEGMENT, WALKS, TABLE_BITS = 16, 2048, 20
SCHEMA = "doc_id long, item_id long, start_word long, n_words long, edits long"


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def edits_allowed(n: int, max_edits: float) -> int:
    return int(n * max_edits + 1e-9)


def repetitions(length: int, edits: int, samples: int, recall: float) -> int:
    """Repetitions after which a pair at these edits agrees in all samples of one, if each edit costs the walk WALK_COST steps."""
    share = min(0.6, WALK_COST * edits / (2 * length))
    hit = (1 - share) ** samples
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - hit))) if hit < 1 else 1


def parts_of(length: int) -> list[tuple[int, int]]:
    """(start, words) of the parts of an item."""
    n = max(1, length // SEGMENT)
    cuts = [length * k // n for k in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


class Parts:
    """The hash table of all parts of one width: for each repetition, the parts by the symbols that the walk gives at its samples."""

    def __init__(self, width: int, found: list[tuple[int, int]], words: list[np.ndarray], symbols: np.ndarray, edits: int, samples: int, recall: float, seed: int) -> None:
        self.width, self.edits = width, edits
        self.items, self.starts = (np.array([f[k] for f in found], dtype=np.int64) for k in (0, 1))
        rng = np.random.default_rng([seed, width])
        reps = repetitions(width, edits, samples, recall)
        self.turns = rng.integers(0, 1 << 63, (2 * width, reps, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.salts = rng.integers(0, 1 << 63, (reps, 1), dtype=np.uint64)
        # the repetitions that sample each step, and how far there is something to sample
        chosen = rng.random((reps, 2 * width)).argsort(axis=1)[:, :samples]
        self.sampled = [np.flatnonzero((chosen == step).any(axis=1)) for step in range(int(chosen.max()) + 1)]
        flat = np.concatenate([np.append(words[k][at : at + 3 * width], np.zeros(3 * width, dtype=np.int64))[: 3 * width] for k, at in found])
        keys = self.keys(symbols[flat], np.arange(len(found)) * 3 * width).ravel()
        owner = np.tile(np.arange(len(found)), reps)
        order = np.argsort(keys, kind="stable")
        self.sorted_keys, self.owners = keys[order], owner[order]
        self.worth = np.zeros(1 << TABLE_BITS, dtype=bool)
        self.worth[keys >> np.uint64(64 - TABLE_BITS)] = True

    def keys(self, hashed: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """(repetition, window) -> key of the symbols that the walk from each start gives at the sampled steps; hashed reaches 2 * width beyond."""
        at = np.repeat(starts[None, :], len(self.salts), axis=0)
        found = np.repeat(self.salts, len(starts), axis=1)
        for turn, sampled in zip(self.turns, self.sampled):
            there = hashed.take(at)
            for k in sampled:
                found[k] = (found[k] ^ there[k]) * np.uint64(0x9E3779B97F4A7C15)
            there *= turn
            there >>= np.uint64(63)
            at += there.view(np.int64)
        return (found ^ (found >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)

    def candidates(self, hashed: np.ndarray, starts: np.ndarray) -> set[tuple[int, int]]:
        """(item, where it would start) of windows whose key is a part's in some repetition."""
        found: set[tuple[int, int]] = set()
        for lo in range(0, len(starts), WALKS):
            own = starts[lo : lo + WALKS]
            keys = self.keys(hashed, own)
            rep, window = np.nonzero(self.worth[keys >> np.uint64(64 - TABLE_BITS)])
            asked = keys[rep, window]
            first, last = np.searchsorted(self.sorted_keys, asked, "left"), np.searchsorted(self.sorted_keys, asked, "right")
            times = last - first
            part = self.owners[np.repeat(first, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
            found.update(zip(self.items[part].tolist(), (np.repeat(own[window], times) - self.starts[part]).tolist()))
        return found


class Items:
    """A block of benchmark items, ready to be looked for."""

    def __init__(self, rows: list[tuple[int | None, str | None]], max_edits: float, recall: float, samples: int | None, least_words: int, seed: int) -> None:
        found = [(i, w) for i, t in rows if (w := words_of(t))]
        self.ids = [i for i, _ in found]
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({x for _, w in found for x in w}))}
        self.words = [np.array([self.vocabulary[x] for x in w], dtype=np.int64) for _, w in found]
        self.edits = [edits_allowed(len(w), max_edits) if len(w) >= least_words else 0 for w in self.words]
        # hashes of the words; zero is any word that no item has
        self.symbols = np.random.default_rng(seed).integers(0, 1 << 63, len(self.vocabulary) + 1, dtype=np.uint64) * np.uint64(2)
        by: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for k, (w, e) in enumerate(zip(self.words, self.edits)):
            cut = parts_of(len(w))
            for at, width in cut:
                by[width, e // len(cut)].append((k, at))
        total = sum(map(len, by.values()))
        if samples is None and total:
            counts = np.bincount(np.concatenate(self.words)).astype(float)
            meet = max(1e-4, min(0.5, ((counts / counts.sum()) ** 2).sum()))  # chance that two words are equal
            samples = max(3, math.ceil(math.log(20 * total) / -math.log(meet)))
        self.parts = [Parts(width, f, self.words, self.symbols, e, min(samples, 2 * width), recall, seed) for (width, e), f in sorted(by.items())]
        self.widest = max((p.width for p in self.parts), default=0)


def best_substring(item: np.ndarray, text: np.ndarray, most: int | None = None) -> tuple[int, int]:
    """(edits, end) of the substring of text with the least edit distance to the item; the first such end.

    Beyond `most` edits, which only grow from word to word of the item, it gives up with one more.
    """
    m = len(text)
    row = np.zeros(m + 1, dtype=np.int64)
    steps = np.arange(m + 1)
    for i, x in enumerate(item):
        new = np.minimum(row + 1, np.concatenate([[i + 1], row[:-1] + (text != x)]))
        row = np.minimum.accumulate(new - steps) + steps
        if most is not None and row.min() > most:
            return most + 1, 0
    end = int(row.argmin())
    return int(row[end]), end


def matches(items: Items, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(index of text, index of item, first word of the window, words of the item, edits) of the best match of each item in each text."""
    known = items.vocabulary
    coded = [np.fromiter(map(known.get, ws, repeat(0)), dtype=np.int64, count=len(ws)) for ws in map(words_of, texts)]
    if not coded or not items.words:
        return []
    # all texts in one row of codes, kept apart by more zeros than any walk is long
    gap = np.zeros(3 * items.widest, dtype=np.int64)
    starts, at, joined = [], len(gap), [gap]
    for c in coded:
        starts.append(at)
        joined += [c, gap]
        at += len(c) + len(gap)
    flat, starts = np.concatenate(joined), np.array(starts)
    before = np.concatenate([[0], np.cumsum(flat > 0)])
    hashed, near = items.symbols[flat], set()
    for p in items.parts:
        there = np.flatnonzero(before[p.width : -2 * p.width] - before[: -3 * p.width] >= p.width - p.edits)
        near |= p.candidates(hashed, there)
    seen = np.zeros(len(known) + 1, dtype=bool)
    best: dict[tuple[int, int], tuple[int, int]] = {}
    done: dict[tuple[int, int], int] = {}
    for k, p in sorted(near):
        n, e = len(items.words[k]), items.edits[k]
        doc = max(0, int(np.searchsorted(starts, p + n // 2, side="right")) - 1)
        if best.get((doc, k), (1, 0))[0] == 0 or p - done.get((doc, k), -(1 << 60)) < max(1, e // 2):
            continue  # found as it is already, or verified with what lies around a moment ago
        done[doc, k] = p
        low, high = int(starts[doc]), int(starts[doc]) + len(coded[doc])
        lo = max(p - 2 * e, low)
        around = flat[lo : max(lo, min(p + n + 3 * e, high))]
        seen[around] = True
        lacks = n - int(seen[items.words[k]].sum())  # words of the item that are nowhere around are an edit each
        seen[around] = False
        if lacks > e:
            continue
        edits, end = best_substring(items.words[k], around, e)
        if edits <= e and edits < best.get((doc, k), (1 << 60, 0))[0]:
            best[doc, k] = edits, max(0, lo + end - n - low)
    return [(doc, k, at, len(items.words[k]), edits) for (doc, k), (edits, at) in sorted(best.items())]


def item_blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, str | None]]]:
    """The items in blocks of about block_bytes, each read by itself."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(total / block_bytes))
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block) if blocks > 1 else items
        yield sorted(((r.item_id, r.text) for r in own.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99, samples: int | None = None, least_words: int = 5, block_bytes: int = 4 << 20, seed: int = 11
) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, edits): one row for each row of docs(doc_id, text) and item found in it."""
    spark = docs.sparkSession
    common.small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def look(block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items(sent.value, max_edits, recall, samples, least_words, seed)
            for b in batches:
                ids = b.column(0).to_pylist()
                found = matches(ready, b.column(1).to_pylist())
                columns = [[ids[m[0]] for m in found], [ready.ids[m[1]] for m in found], *([m[k] for m in found] for k in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "start_word", "n_words", "edits"])

        return rows.mapInArrow(run, SCHEMA)

    return reduce(DataFrame.unionByName, map(look, item_blocks(benchmark, block_bytes)))


def clean(
    docs: DataFrame, benchmark: DataFrame, max_edits: float = 0.2, recall: float = 0.99, samples: int | None = None, least_words: int = 5, block_bytes: int = 4 << 20, seed: int = 11
) -> DataFrame:
    """The rows of docs whose text has no item in it, with all their columns. No shuffle: each block of items is a filter."""
    spark = docs.sparkSession
    common.small_batches(spark)
    at = docs.columns.index("text")

    def drop(df: DataFrame, block: list) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ready = Items(sent.value, max_edits, recall, samples, least_words, seed)
            for b in batches:
                dirty = {m[0] for m in matches(ready, b.column(at).to_pylist())}
                yield b.filter(pa.array([k not in dirty for k in range(b.num_rows)], pa.bool_()))

        return common.map_rows(df, run, df.schema)

    return reduce(drop, item_blocks(benchmark, block_bytes), docs)
