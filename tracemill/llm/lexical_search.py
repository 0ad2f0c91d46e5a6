"""Ranked lexical search with MaxScore in shards: long lists of weak terms are looked at only for documents that can still win.

Documents are read once for each block of items. A document gives the number of its terms and its counts of the items' terms, which
are kept as a table; the corpus' counts are sums over that table. A shard is a number of neighbouring rows of it. There each
term has a posting list of documents in the order of their ids, its exact share of a score for each, and its largest share, the upper
bound. For an item, its terms in the order of their bounds are split: the bounds of the non-essential ones together do not beat the
shard's present k-th best score, so a document that has none of the essential ones is never looked at. Candidates of the essential
lists take their scores from these, and non-essential lists, the strongest first, are probed only for candidates that could
still get in. Documents go through in blocks of growing ids, and the split is made anew after each. Shards send k rows an item.

Scores are 64-bit integers and exact, so the shards' bests are the corpus' bests. Equal scores rank by doc_id, one without an id last.

Nulls and edge cases: a null text has no terms and is in no count; an empty table, or one without terms, gives no rows, nor does an item
that is null or has no terms; repeated documents and items each have rows of their own; texts are taken whole, whatever their length;
extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keep, small_batches

#: Bytes of item texts of a block; documents of a shard at most, and of a step through it.
ITEM_BYTES, SHARD, STEP = 4 << 20, 1 << 14, 1 << 11
#: The parts of terms in UTF-8, all bytes from 128 on and ASCII letters and digits, A-Z lower-cased; all else parts terms.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


def weight(n_docs: int, with_term: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * with_term + 1)))


class Items:
    """A block of items: (row, item_id, its terms as numbers with how often each)."""

    def __init__(self, rows: list[tuple[int, int | None, str | None]]) -> None:
        self.numbers: dict[bytes, int] = {}
        self.items: list[tuple[int, int | None, Counter]] = []
        for row, item, text in rows:
            own = Counter(self.numbers.setdefault(t, len(self.numbers)) for t in terms_of(text))
            if own:
                self.items.append((row, item, own))


def item_blocks(items: DataFrame, item_id: str, text: str) -> Iterator[Items]:
    """All items in blocks of ITEM_BYTES of text, one block at a time on the driver."""
    rows, size = [], 0
    for row, r in enumerate(items.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).toLocalIterator()):
        rows.append((row, r.i, r.t))
        size += len(r.t or "")
        if size >= ITEM_BYTES:
            yield Items(rows)
            rows, size = [], 0
    if rows:
        yield Items(rows)


def _counts(numbers: dict[bytes, int]):
    """Batches of (doc_id, text) -> (doc_id, n, terms, times) of the documents with terms; terms are the items' ones that they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.keys()
        for b in batches:
            ids, ns, terms, times = [], [], [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = Counter((text or b"").translate(TABLE).split())
                n = found.total()
                if not n:
                    continue
                own = sorted((numbers[t], found[t]) for t in found.keys() & known)
                ids.append(doc)
                ns.append(n)
                terms.append([t for t, _ in own])
                times.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "times"])

    return run


def shares(weights: np.ndarray, times: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What each of its terms gives a document: weights, counts in the document, and terms of the document, all integers."""
    m = 100 - 75 + (75 * lengths * n_docs) // n_terms
    return weights * ((1_000_000_000 * times) // (1000 * times + 8 * m))


class Shard:
    """Posting lists of some documents, which are numbered by their ids."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, held: np.ndarray, terms: np.ndarray, times: np.ndarray, weights: np.ndarray, n_docs: int, n_terms: int) -> None:
        """ids, lengths: of each document, and held, how many of the terms and times it has."""
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), dtype=np.int64)
        number = np.empty(len(ids), dtype=np.int64)
        number[order] = np.arange(len(ids))
        self.ids = [ids[i] for i in order]
        row = np.repeat(np.arange(len(ids)), held)
        share = shares(weights[terms], times, lengths[row], n_docs, n_terms)
        by = np.lexsort((number[row], terms))
        self.docs, self.share = number[row][by], share[by]
        term = terms[by]
        head = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, dtype=np.int64)
        ends = np.append(head[1:], len(term))
        bounds = np.maximum.reduceat(self.share, head) if len(head) else head
        self.lists = {int(term[x]): (int(x), int(y), int(u)) for x, y, u in zip(head, ends, bounds)}
        self.probed = 0  # postings looked at, to tell what the bounds save

    def best(self, terms: Counter, k: int) -> list[tuple[int, int]]:
        """(score, document's number) of the k best with a score above zero, the best first."""
        own = sorted(((u * times, x, y, times) for t, times in terms.items() if t in self.lists for x, y, u in [self.lists[t]] if u > 0))
        if not own:
            return []
        top = np.cumsum([u for u, *_ in own])  # what a term and all weaker ones give at most
        docs, scores, least = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), 0
        for begin in range(0, len(self.ids), STEP):
            weak = int(np.searchsorted(top, least, "right"))  # terms 0..weak-1 are not essential
            if weak == len(own):
                break
            sums = np.zeros(STEP, dtype=np.int64)
            for _, x, y, times in own[weak:]:
                lo, hi = x + np.searchsorted(self.docs[x:y], (begin, begin + STEP))
                sums[self.docs[lo:hi] - begin] += self.share[lo:hi] * times
                self.probed += int(hi - lo)
            found = np.flatnonzero(sums)
            for j in range(weak - 1, -1, -1):
                found = found[sums[found] + top[j] > least]
                if not len(found):
                    break
                _, x, y, times = own[j]
                at = x + np.searchsorted(self.docs[x:y], found + begin)
                at, there = np.minimum(at, y - 1), at < y
                there &= self.docs[at] == found + begin
                sums[found[there]] += self.share[at[there]] * times
                self.probed += len(found)
            found = found[sums[found] > least]
            if len(found):
                docs, scores = np.append(docs, found + begin), np.append(scores, sums[found])
                keep_these = np.lexsort((docs, -scores))[:k]
                docs, scores = docs[keep_these], scores[keep_these]
                least = int(scores[-1]) if len(scores) == k else 0
        return list(zip(scores.tolist(), docs.tolist()))


def _searched(block: Items, weights: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Batches of (doc_id, n, terms, times) -> each shard's k best (row, item_id, doc_id, score) of every item."""

    def best(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        terms, times = (t.column(c).combine_chunks().flatten().to_numpy().astype(np.int64) for c in ("terms", "times"))
        of = t.column("terms").combine_chunks().value_lengths().to_numpy()
        shard = Shard(t.column("doc_id").to_pylist(), t.column("n").to_numpy(), of, terms, times, weights, n_docs, n_terms)
        rows = [(row, item, shard.ids[d], score) for row, item, own in block.items for score, d in shard.best(own, k)]
        columns = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "item_id", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held, n = [*held, b], n + b.num_rows
            if n >= SHARD:
                yield best(held)
                held, n = [], 0
        if held:
            yield best(held)

    return run


def search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's k best documents with a score above zero.

    Items are a stated set of queries and may be any number: they go in blocks of ITEM_BYTES of text, each with a pass over docs.
    """
    spark = docs.sparkSession
    small_batches(spark)
    out = spark.createDataFrame([], "row long, item_id long, doc_id long, score long")
    texts = docs.where(F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    for block in item_blocks(items, item_id, item_text):
        if not block.items:
            continue
        counted = keep(texts.mapInArrow(_counts(block.numbers), "doc_id long, n long, terms array<int>, times array<long>"))
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs:
            break
        weights = np.full(len(block.numbers), weight(n_docs, 0), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():  # no more rows than the block has terms
            weights[r.t] = weight(n_docs, r.df)
        out = out.unionByName(counted.mapInArrow(_searched(block, weights, n_docs, n_terms, k), "row long, item_id long, doc_id long, score long"))
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
