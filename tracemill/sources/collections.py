"""Whole GeoJSON collections in files of any size, read in many tasks.

Spark cuts a file at closing braces (the text source's record separator), wherever its splits end: also inside a feature, or in
a string that holds braces. What a split begins in is found first: a task runs over its split twice, as if it began inside and
outside a string, and sums each run up as the brackets it closes and those it leaves open. A file's sums, one row a split, are
put together in order, which gives every split the brackets that are open before it. A second pass then takes out the features,
and those that lie across splits come as fragments, put together by the split in which they begin.

A feature is an object that is an element of the array `features` of an object at the top; other members of the collection may be anything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..stages import keep

QUOTE, BACKSLASH = b'"\\'
OPEN_OBJECT, CLOSE_OBJECT, OPEN_ARRAY, CLOSE_ARRAY = b"{}[]"
STEP = np.zeros(256, dtype=np.int64)
STEP[[OPEN_OBJECT, OPEN_ARRAY]], STEP[[CLOSE_OBJECT, CLOSE_ARRAY]] = 1, -1
SUMS = "path string, block long, quoted boolean, ends_quoted boolean, closed int, opened string"
STATES = "path string, block long, quoted boolean, open string, since long"
BROADCAST_SPLITS = 500_000  # of about 200 bytes each


class Text:
    """A buffer of JSON text that ends in a brace, with its quotes and brackets found."""

    def __init__(self, data: bytes):
        self.data, at = data, np.frombuffer(data, np.uint8)
        self.quotes = np.flatnonzero(at == QUOTE)
        if b"\\" in data:  # a quote behind an odd number of backslashes is none
            last = np.maximum.accumulate(np.where(at != BACKSLASH, np.arange(len(at)), -1))
            before = np.maximum(self.quotes - 1, 0)
            self.quotes = self.quotes[(self.quotes == 0) | ((before - last[before]) % 2 == 0)]
        self.brackets = np.flatnonzero(STEP[at])
        self.strings = np.searchsorted(self.quotes, self.brackets)
        self.kinds = at[self.brackets]

    def outside(self, quoted: bool) -> tuple[np.ndarray, np.ndarray, bool]:
        """(places, kinds) of the brackets outside strings, and whether the text ends in a string, if it begins in one or not."""
        chosen = (self.strings + quoted) % 2 == 0
        return self.brackets[chosen], self.kinds[chosen], (len(self.quotes) + quoted) % 2 == 1

    def named_features(self, at: int) -> bool:
        """Whether the array that opens there is the value of a key `features`."""
        head = self.data[:at].rstrip()
        head = head[:-1].rstrip() if head.endswith(b":") else b""
        return head.endswith(b'"features"') and not head.endswith(b'\\"features"')


class Scan:
    """Runs over JSON text and keeps what is open: O an object, F an array of features, A another array.

    `closed` counts the brackets closed that were opened before the scan. Of an unknown beginning every array that is named
    `features` and may be at the top of a collection is marked F.
    """

    def __init__(self, quoted: bool, open_: str | None = None):
        self.quoted, self.stack, self.known, self.closed = quoted, list(open_ or ""), open_ is not None, 0

    def one(self, text: Text, at: int, kind: int) -> None:
        """One bracket."""
        if STEP[kind] < 0:
            if self.stack:
                self.stack.pop()
            else:
                self.closed += 1
        elif kind == OPEN_OBJECT:
            self.stack.append("O")
        else:
            top = self.stack == ["O"] if self.known else len(self.stack) <= 1
            self.stack.append("F" if top and text.named_features(at) else "A")

    def over(self, text: Text) -> None:
        """The whole text: brackets that it closes and those that it leaves open."""
        places, kinds, self.quoted = text.outside(self.quoted)
        if not len(places):
            return
        depth = np.cumsum(STEP[kinds])
        for _ in range(max(0, -int(depth.min()))):
            self.one(text, 0, CLOSE_OBJECT)
        after = np.minimum.accumulate(depth[::-1])[::-1]
        left = np.flatnonzero((STEP[kinds] > 0) & (np.append(after[1:], depth[-1]) >= depth))
        for k in left:
            self.one(text, int(places[k]), int(kinds[k]))

    def features(self, text: Text) -> tuple[list[int], list[int]]:
        """Places where features begin and end; one that is open before the text has only its end."""
        places, kinds, ends_quoted = text.outside(self.quoted)
        depth = np.cumsum(STEP[kinds]) + len(self.stack)
        if self.stack[:2] == ["O", "F"] and (not len(depth) or depth.min() >= 2):
            begins, ends = places[(kinds == OPEN_OBJECT) & (depth == 3)].tolist(), places[(kinds == CLOSE_OBJECT) & (depth == 2)].tolist()
            self.over(text)
            return begins, ends
        begins, ends = [], []
        for at, kind in zip(places.tolist(), kinds.tolist()):  # the array of features begins or ends here, or other members
            if kind == OPEN_OBJECT and self.stack == ["O", "F"]:
                begins.append(at)
            self.one(text, at, kind)
            if kind == CLOSE_OBJECT and self.stack == ["O", "F"]:
                ends.append(at)
        self.quoted = ends_quoted
        return begins, ends


def buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, Text]]:
    """(split with its state, text) for the runs of rows of one split in each batch; every row gets its brace again."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.union1d(*(pc.run_end_encode(b.column(k)).run_ends.to_numpy() for k in (1, 2)))  # a run has one path and one block
        begins = np.concatenate([[0], ends[:-1]])
        runs = pa.LargeListArray.from_arrays(np.append(begins, b.num_rows), b.column(0).cast(pa.large_binary()))
        joined = pc.binary_join(runs, pa.scalar(b"}", pa.large_binary()))
        for k, at in enumerate(begins.tolist()):
            yield tuple(c[at].as_py() for c in b.columns[1:]), Text(joined[k].as_py() + b"}")


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each split summed up twice, as beginning outside and inside a string."""

    def rows(split, scans) -> pa.RecordBatch:
        found = [(*split, quoted, s.quoted, s.closed, "".join(s.stack)) for quoted, s in zip((False, True), scans)]
        names = ("path", "block", "quoted", "ends_quoted", "closed", "opened")
        types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.int32(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    now, scans = None, ()
    for split, text in buffers(batches):
        if split != now:
            if now:
                yield rows(now, scans)
            now, scans = split, (Scan(False), Scan(True)) if split[1] else (Scan(False),)
        for scan in scans:
            scan.over(text)
    if now:
        yield rows(now, scans)


def folded(sums: pd.DataFrame) -> pd.DataFrame:
    """The state before each split of a file: in a string or not, what is open, the split in which an open feature began."""
    quoted, open_, since, states = False, "", None, []
    by = {(r.block, r.quoted): r for r in sums.itertuples()}
    for block in sorted(set(sums["block"])):
        states.append((sums["path"].iloc[0], block, quoted, open_, since))
        r = by[block, quoted]
        left = open_[: max(0, len(open_) - r.closed)]
        # an array named features counts at the top of a collection only; a scan that didn't know its depth also marks others
        opened = "".join("F" if c == "F" and left + r.opened[:k] == "O" else "A" if c == "F" else c for k, c in enumerate(r.opened))
        if not left.startswith("OFO"):
            since = block if (left + opened).startswith("OFO") else None
        quoted, open_ = r.ends_quoted, left + opened
    return pd.DataFrame(states, columns=["path", "block", "quoted", "open", "since"]).astype({"since": "Int64"})


def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole features (`since` null) and fragments of those across splits, of splits with their states.

    A feature that is open at a buffer's end is kept until it closes or its split ends, where it becomes a fragment.
    """

    def rows(found: list[tuple]) -> pa.RecordBatch:
        columns = zip(*found) if found else ((), (), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t).cast(u) for c, t, u in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["path", "since", "block", "value"])

    now, scan, since, inside, parts = None, None, None, False, []
    for state, text in buffers(batches):
        found = []
        if state != now:
            if parts:
                found.append((now[0], since, now[1], b"".join(parts)))
            if state[2] is None:
                raise RuntimeError(f"{state[0]} was cut elsewhere when it was read again, at {state[1]}")
            now, scan, parts = state, Scan(state[2], state[3]), []
            since, inside = state[4], state[3].startswith("OFO")
        begins, ends = scan.features(text)
        if inside:
            begins.insert(0, 0)
        for begin, end in zip(begins, ends):
            if not inside:
                since = now[1]
            found.append((now[0], None if since == now[1] else since, now[1], b"".join([*parts, text.data[begin : end + 1]])))
            inside, parts = False, []
        if len(begins) > len(ends):
            if not inside:
                since = now[1]
            inside = True
            parts.append(text.data[begins[-1] :])
        yield rows(found)
    if parts:
        yield rows([(now[0], since, now[1], b"".join(parts))])


def splits(spark: SparkSession, path: str) -> DataFrame:
    """(value, path, block): the text between closing braces, in order within each split (path, block)."""
    text = spark.read.option("lineSep", "}").text(path)
    return text.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))


def features(spark: SparkSession, path: str, schema: str, broadcast_splits: int = BROADCAST_SPLITS) -> DataFrame:
    """(feature struct) of all features of the collections below path; what does not fit the schema is null.

    Reads the files twice, at once. One row a split holds its state; they are broadcast up to `broadcast_splits` of them, beyond
    that the rows are shuffled to their states. Parsed features and fragments are kept below spark.checkpoint.dir.
    """
    name = "spark.sql.files.minPartitionNum"  # else a lost executor could move the ends of splits between the readings
    before = spark.conf.get(name, None)
    spark.conf.set(name, before or str(spark.sparkContext.defaultParallelism))
    try:
        pieces = splits(spark, path)
        states = keep(pieces.mapInArrow(summed, SUMS).groupBy("path").applyInPandas(folded, STATES))
        if states.count() <= broadcast_splits:
            known = pieces.join(F.broadcast(states), ["path", "block"], "left")
        else:
            known = pieces.withColumn("row", F.monotonically_increasing_id()).join(states.hint("merge"), ["path", "block"], "left")
            known = known.repartition("path", "block").sortWithinPartitions("path", "block", "row")
        rows = known.select("value", "path", "block", "quoted", "open", "since").mapInArrow(taken, "path string, since long, block long, value string")
        whole = F.col("since").isNull()
        rows = keep(rows.select("path", "since", "block", F.when(~whole, F.col("value")).alias("value"), F.when(whole, F.from_json("value", schema)).alias("feature")))
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    parts = rows.where("since IS NOT NULL").groupBy("path", "since").agg(F.array_sort(F.collect_list(F.struct("block", "value"))).alias("parts"))
    joined = parts.select(F.from_json(F.array_join("parts.value", ""), schema).alias("feature"))
    return rows.where("since IS NULL").select("feature").unionByName(joined)
