"""Quality scores by a factorisation machine over hashed words, structure statistics and size.

A text is a vector: the histogram of its words hashed into WORD_BINS bins, and statistics of its structure (share of upper
case, marked, repeated, numeric and very long words, distinct words, repeated lines, the worst line of each kind, size),
each also as a bin indicator. The machine scores it as w0 + <w, x> + sum over f of ((<v_f, x>)^2 - <v_f^2, x^2>) / 2, the
pairwise interactions of rank RANK in time linear in x by the sum-of-squares identity, through a logistic function.

Features are made in Spark tasks from whole texts. The machine is fitted with Adam on a sample of at most `sample_rows`
labelled rows, chosen by a hash of doc_id, whose feature vectors (not texts) reach the driver: at most sample_rows *
WIDTH floats. Labels, lang, source and doc_id are never features.

Null and empty texts get the score of a text without words. With no labelled rows every score is 0.5. A null doc_id stays
null and is not held out; repeated rows each get their row; a doc_id with several labels is learned with each of them. An empty
table gives no rows; other columns are ignored by quality() and kept by with_scores(), whose column's name must be free.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common

WORD_BINS, RANK, STAT_BINS = 256, 8, 8
UPPER, MARKED, BAR, DIGIT, LONG, SHORT, PLAIN = range(7)
FLAGS = 7
STATS = FLAGS + 2 + 5 + 4  # shares of words; repeated and distinct; worst lines; size and lines
WIDTH = WORD_BINS + STATS * (1 + STAT_BINS)
KEEP_WORDS = 150_000
MARKS = frozenset("#$%&*!|~^<>{}[]=+\\/@_")


class Codes(dict):
    """Word -> its hash in the low 32 bits and its flags above."""

    def __missing__(self, word: str) -> int:
        marked = sum(c in MARKS for c in word)
        letters = sum(map(str.isalpha, word))
        flags = (word.isupper() and letters > 1) << UPPER | (marked > 0) << MARKED | (word == "|") << BAR
        flags |= any(map(str.isdigit, word)) << DIGIT | (len(word) > 14) << LONG | (len(word) < 3) << SHORT | (letters >= len(word) - 1) << PLAIN
        code = zlib.crc32(word.lower().encode()) | flags << 32
        if len(self) > KEEP_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = code
        return code


_codes = Codes()


def features(text: str) -> np.ndarray:
    """The vector of a whole text, float32 of length WIDTH."""
    lines = [line.split() for line in text.split("\n")]
    sizes = np.array([n for n in map(len, lines) if n])
    x = np.zeros(WIDTH, dtype=np.float32)
    stats = np.zeros(STATS)
    n = int(sizes.sum())
    if n:
        codes = np.fromiter((_codes[w] for line in lines for w in line), dtype=np.int64, count=n)
        hashes = codes & 0xFFFFFFFF
        x[:WORD_BINS] = np.bincount(hashes % WORD_BINS, minlength=WORD_BINS) / n
        flags = ((codes[:, None] >> np.arange(32, 32 + FLAGS)) & 1).astype(np.float64)
        again = np.zeros((n, 1))
        again[1:, 0] = hashes[1:] == hashes[:-1]
        distinct = len(np.unique(hashes))
        stats[:FLAGS] = flags.mean(axis=0)
        stats[FLAGS] = again.mean()
        stats[FLAGS + 1] = distinct / n**0.8
        by_line = np.add.reduceat(np.hstack([flags[:, [UPPER, MARKED, BAR, DIGIT]], again]), np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0)
        stats[FLAGS + 2 : FLAGS + 7] = (by_line / (sizes + 4.0)[:, None]).max(axis=0)  # short lines count for less
        keys = [" ".join(line) for line in lines if line]
        stats[FLAGS + 7] = 1 - len(set(keys)) / len(keys)
        stats[FLAGS + 8] = np.log1p(n) / 12
        stats[FLAGS + 9] = np.log1p(len(keys)) / 10
        stats[FLAGS + 10] = len(text) / n / 20
    stats = np.clip(stats, 0, 1)
    x[WORD_BINS : WORD_BINS + STATS] = stats
    # fine bins near zero, where a few odd words in a long text show
    bins = np.minimum((np.sqrt(stats) * STAT_BINS).astype(int), STAT_BINS - 1)
    x[WORD_BINS + STATS + np.arange(STATS) * STAT_BINS + bins] = 1
    return x


@dataclass
class Machine:
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        return self.bias + x @ self.linear + ((x @ self.factors) ** 2 - (x * x) @ (self.factors**2)).sum(axis=1) / 2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margins(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.02, decay: float = 1e-4, seed: int = 7) -> Machine:
    """Adam on the logistic loss with a small L2 penalty."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    params = [np.zeros(1), np.zeros(d), rng.normal(0, 0.05, (d, RANK))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            k = order[at : at + batch]
            xb, machine = x[k], Machine(params[0][0], params[1], params[2])
            e = (machine.scores(xb) - y[k]) / len(k)
            pulled = xb @ params[2]
            grads = [np.array([e.sum()]), xb.T @ e, xb.T @ (e[:, None] * pulled) - ((xb * xb).T @ e)[:, None] * params[2]]
            step += 1
            now = rate * (1 - epoch / epochs) + 1e-4
            for j, g in enumerate(grads):
                g = g + decay * params[j]
                first[j] = 0.9 * first[j] + 0.1 * g
                second[j] = 0.999 * second[j] + 0.001 * g * g
                params[j] = params[j] - now * (first[j] / (1 - 0.9**step)) / (np.sqrt(second[j] / (1 - 0.999**step)) + 1e-8)
    return Machine(float(params[0][0]), params[1], params[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 6000) -> Machine | None:
    """A machine for labels.quality, from rows that are not held out; None without any."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    chosen = chosen.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "quality").limit(sample_rows)  # so the broadcast is bounded
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [features(t or "").tobytes() for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.binary()), b.column(2)], names=["doc_id", "x", "quality"])

    vectors = rows.select("text", "doc_id", "quality").mapInArrow(run, "doc_id long, x binary, quality int")
    got = vectors.orderBy(F.xxhash64("doc_id"), "quality", F.xxhash64("x")).limit(sample_rows).collect()
    if not got:
        return None
    return fit(np.stack([np.frombuffer(r.x, dtype=np.float32) for r in got]).astype(np.float64), np.array([r.quality for r in got], dtype=np.float64))


def with_scores(docs: DataFrame, machine: Machine | None, column: str = "score") -> DataFrame:
    """docs with a column of scores for `text`."""
    common.small_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(at).to_pylist()
            s = machine.scores(np.stack([features(t or "") for t in texts]).astype(np.float64)) if machine and texts else np.full(len(texts), 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], names=[f"c{k}" for k in range(b.num_columns + 1)])

    return common.map_rows(docs, run, StructType([*docs.schema.fields, StructField(column, DoubleType())]))


def quality(docs: DataFrame, labels: DataFrame, accept: float = 0.7, sample_rows: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of docs(doc_id, text)."""
    common.small_batches(docs.sparkSession)
    machine = train(docs, labels, sample_rows)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = with_scores(rows, machine)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= accept).cast("int").alias("predicted"))
