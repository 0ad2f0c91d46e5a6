"""Bulk-synchronous best-fit packing of tokenized documents into fixed-length sequences.

Documents are cut into pieces of at most `size` tokens (only longer ones, the first piece being the shorter), sorted by
length, and placed in rounds, longest first. A round matches all pieces of one length with the smallest gap that holds
them (the successor in the sorted gaps), as many pieces to a gap as fit; pieces and gaps of equal size are told apart by
their rank, so the k-th piece takes the k-th gap and no two pieces want the same one; the gaps shrink and the sweep goes
on with the next. As lengths are at most `size`, sorted pieces and gaps are runs of (length, count): the sweep works on
those runs, at most `size` of them, and its outcome is a table of runs (length, ranks -> sequences, offset) that is
joined to the pieces. Ranks are dealt in 64 parts of a length, or more of about `part_rows` pieces each, so a length that a third of all
pieces have is no single task, however many they are. A piece's place follows from its length and rank alone.

Null texts are empty documents, which have one token, the end id. Repeated rows are packed each. Null doc_ids stay null.
Other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, tokens

_memory: dict[str, tuple[tokens.Memory, tokens.Memory, np.ndarray]] = {}


def byte_lengths(path: str) -> np.ndarray:
    """Bytes of text that each id of a byte-level vocabulary stands for; special tokens stand for their string."""
    t = tokens.library(path)
    special = {i: len(a.content.encode()) for i, a in t.get_added_tokens_decoder().items()}
    sizes = np.zeros(t.get_vocab_size(), dtype=np.int64)
    for token, i in t.get_vocab().items():
        sizes[i] = special.get(i, len(token))  # the vocabulary writes each byte as one character
    return sizes


def encoded(texts: list[str], path: str) -> Iterator[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers, as the library gives them for the whole text.

    A text's inner parts stand for themselves with the space before them. New ones are encoded in one call, as a text of
    their own; the bytes that each id stands for tell which ids are whose. First and last parts may begin or end with
    white space and are encoded one by one.
    """
    if path not in _memory:
        _memory[path] = tokens.Memory(), tokens.Memory(), byte_lengths(path)
    inner, outer, sizes = _memory[path]
    library = tokens.library(path)
    for run in tokens.blocks(texts):
        parts = [tokens.space_parts(t) for t in run]
        middle = [p[1:-1] for p in parts]
        ends = [(p[0], " " + p[-1] if len(p) > 1 else "") for p in parts]
        if new := inner.missing(middle):
            ids = np.array(library.encode_batch_fast([" " + " ".join(new)], add_special_tokens=False)[0].ids, dtype="<u4")
            stops = np.cumsum(np.fromiter((len(p.encode()) + 1 for p in new), dtype=np.int64, count=len(new)))
            stops = (4 * np.searchsorted(np.cumsum(sizes[ids]), stops) + 4).tolist()
            flat = ids.tobytes()
            inner.known.update(zip(new, [flat[a:b] for a, b in zip([0, *stops], stops)]))
        odd = outer.missing(ends)
        for p, e in zip(odd, library.encode_batch_fast(odd, add_special_tokens=False)):
            outer.known[p] = np.array(e.ids, dtype="<u4").tobytes()
        for m, (first, last) in zip(middle, ends):
            yield b"".join([outer.known[first], *map(inner.known.__getitem__, m), outer.known[last]])
        inner.settle(new)
        outer.settle(odd)


def pieces(docs: DataFrame, path: str, size: int, end_id: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document of docs(doc_id, text)."""
    common.small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, piece, start, length, crc = [], [], [], [], []
            for d, ids in zip(b.column(0).to_pylist(), encoded([t.as_py() or "" for t in b.column(1)], path)):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range((n - 1) % size + 1, n + 1, size)]
                for k, (x, y) in enumerate(zip(cuts, cuts[1:])):
                    doc.append(d)
                    piece.append(k)
                    start.append(x)
                    length.append(y - x)
                    crc.append(zlib.crc32(ids[4 * x : 4 * y]))
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(have: dict[int, int], size: int) -> list[tuple[int, int, int, int, int]]:
    """Rounds of best fit over runs of equal lengths: have[length] = pieces. Returns (length, first rank, ranks, first sequence, offset)."""
    runs: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    sizes: list[int] = []  # sorted sizes of the gaps there are
    opened = 0

    def widen(gap: int, first: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(sizes, gap)
            gaps[gap].append((first, count))

    for length in sorted(have, reverse=True):
        rank, left = 0, have[length]
        while left:
            at = bisect_left(sizes, length)
            if at < len(sizes):
                gap = sizes[at]
                first, count = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    del sizes[at]
            else:
                gap, first = size, opened
                count = -(-left // (size // length))
                opened += count
            each = gap // length
            full = min(count, left // each)
            rest = left - full * each if full < count else 0  # of a last gap that is not filled by this length
            for k in range(each if full else 0):
                runs.append((length, rank, full, first, size - gap + k * length))
                rank += full
            widen(gap - each * length, first, full)
            rest = min(rest, each)
            for k in range(rest):
                runs.append((length, rank, 1, first + full, size - gap + k * length))
                rank += 1
            used = full + bool(rest)
            if rest:
                widen(gap - rest * length, first + full, 1)
            widen(gap, first + used, count - used)
            left = have[length] - rank
    return runs


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 2, part_rows: int = 250_000, parts: int = 64) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    The driver has a count for each length (`size` rows at most) and the sweep's runs; broadcast are these, and a row for each part
    of a length: `parts` of them, or one for each part_rows pieces if that is more.
    """
    spark = docs.sparkSession
    cut = common.keep(pieces(docs, path, size, end_id))
    counts = cut.groupBy("length").agg(F.count("*").alias("n"))
    have = {r.length: r.n for r in counts.collect()}
    salts = spark.createDataFrame([(k, max(parts, -(-n // part_rows))) for k, n in have.items()], "length long, salts int")
    salted = cut.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("salts")).cast("int")).drop("salts")
    counted = common.keep(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    bases = counted.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    plan = spark.createDataFrame([list(r) for r in sweep(have, size)], "length long, rank_from long, ranks long, sequence_from long, offset long")
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = salted.withColumn("k", F.row_number().over(within) - 1).join(F.broadcast(bases), ["length", "salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k")).alias("rank"))
    there = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_from") + F.col("ranks"))
    placed = ranked.join(F.broadcast(plan), "length").where(there)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
