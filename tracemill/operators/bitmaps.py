"""Group counts from bitmaps: traces are compressed bitmaps, and a group's counts are bit-sliced counters that bitmaps are added to.

The cells of the grid are numbered, roi * n_epochs + epoch, and cut into chunks of 65,536. A user's cells of a chunk are one row: as
places of two bytes each where they are few, else as one bit a cell. So a member of a group is a row in the shuffles, not each of its
cells. A group's counts of a chunk are planes of bits: plane k has bit k of every cell's count, and adding a bitmap is a carry through
the planes, 64 cells a machine word. Places are collected and added a run at a time. Groups are added up in parts of
`part` members, wherever these are, and parts of a group are added plane by plane afterwards, so no task holds a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType, StringType

#: Cells of a chunk, a fixed size as places have two bytes; places from which a bitmap is the smaller form.
CHUNK, FEW = 1 << 16, 1 << 12


class Counters:
    """Counts of a chunk's cells as planes of bits, the lowest first."""

    def __init__(self, planes: list[np.ndarray] | None = None) -> None:
        self.planes = planes or []

    def carry(self, bits: np.ndarray, plane: int = 0) -> None:
        """Add a bitmap of 2^plane each."""
        while bits.any():
            while plane >= len(self.planes):
                self.planes.append(np.zeros(CHUNK // 64, dtype=np.uint64))
            now = self.planes[plane]
            self.planes[plane], bits, plane = now ^ bits, now & bits, plane + 1

    def add(self, other: Counters) -> None:
        for k, bits in enumerate(other.planes):
            self.carry(bits, k)

    def add_places(self, places: np.ndarray) -> None:
        """Add one for each place, of which there may be repeated ones: their counts are cut into planes once for all."""
        counts = np.bincount(places, minlength=CHUNK)
        k = 0
        while counts.any():
            self.carry(np.packbits((counts & 1).astype(bool), bitorder="little").view(np.uint64), k)
            counts >>= 1
            k += 1

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(places, counts) that are not zero."""
        total = np.zeros(CHUNK, dtype=np.int64)
        for k, plane in enumerate(self.planes):
            total += np.unpackbits(plane.view(np.uint8), bitorder="little").astype(np.int64) << k
        places = np.flatnonzero(total)
        return places, total[places]

    def packed(self) -> bytes:
        """The shorter form: places with counts, or planes."""
        places, counts = self.counts()
        if len(places) * 10 <= len(self.planes) * CHUNK // 8:
            return b"p" + places.astype(np.uint16).tobytes() + counts.tobytes()
        return b"b" + b"".join(p.tobytes() for p in self.planes)

    @classmethod
    def of(cls, packed: bytes) -> Counters:
        if packed[:1] == b"b":
            return cls(list(np.frombuffer(packed[1:], dtype=np.uint64).reshape(-1, CHUNK // 64).copy()))
        n = (len(packed) - 1) // 10
        out = cls()
        out.add_places(np.repeat(np.frombuffer(packed[1 : 1 + 2 * n], dtype=np.uint16), np.frombuffer(packed[1 + 2 * n :], dtype=np.int64)))
        return out


def of_traces(cells: DataFrame, n_epochs: int) -> DataFrame:
    """(user_id, chunk, n, bits) of cells(user_id, roi, epoch), where repeats count once: n places as shorts, or a bitmap where there are FEW or more."""
    cell = F.col("roi").cast("long") * n_epochs + F.col("epoch")
    placed = cells.select("user_id", F.floor(cell / CHUNK).cast("int").alias("chunk"), (cell % CHUNK).cast("int").alias("place"))
    return packed(placed.groupBy("user_id", "chunk").agg(F.collect_set("place").alias("places")), ["user_id"])  # CHUNK places at most


def of_lists(lists: DataFrame, n_epochs: int, by: list[str]) -> DataFrame:
    """The same of lists(by, cells), where a user's cells are an array of different roi * 2^32 + epoch. Nothing is shuffled."""
    numbers = F.transform("cells", lambda c: F.shiftright(c, 32) * n_epochs + c.bitwiseAND(F.lit((1 << 32) - 1)))
    cut = lists.select(*by, numbers.alias("_all")).withColumn("chunk", F.explode(F.array_distinct(F.transform("_all", lambda c: F.shiftright(c, 16).cast("int")))))
    places = F.transform(F.filter("_all", lambda c: F.shiftright(c, 16) == F.col("chunk")), lambda c: c.bitwiseAND(F.lit(CHUNK - 1)).cast("int"))
    return packed(cut.select(*by, "chunk", places.alias("places")), by)


def packed(lists: DataFrame, by: list[str]) -> DataFrame:
    """(by, chunk, n, bits) of (by, chunk, places)."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            places = b.column("places")
            flat, ends = places.flatten().to_numpy(zero_copy_only=False), np.cumsum(places.value_lengths().to_numpy(zero_copy_only=False))
            out = []
            for x, y in zip([0, *ends.tolist()], ends.tolist()):
                if y - x < FEW:
                    out.append(np.sort(flat[x:y]).astype(np.uint16).tobytes())
                else:
                    bits = np.zeros(CHUNK, dtype=bool)
                    bits[flat[x:y]] = True
                    out.append(np.packbits(bits, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in by), b.column("chunk"), places.value_lengths(), pa.array(out, pa.binary())], [*by, "chunk", "n", "bits"])

    kinds = ", ".join(f"`{c}` {lists.schema[c].dataType.simpleString()}" for c in by)
    return lists.mapInArrow(pack, f"{kinds}, chunk int, n int, bits binary")


def _counted(fields: list[pa.Field], key: tuple, counters: Counters, n_epochs: int) -> Iterator[pa.RecordBatch]:
    """The counts of a chunk as rows of cells; key: the values of `fields`, and the chunk's number."""
    places, counts = counters.counts()
    cell = places + key[-1] * CHUNK
    same = [pa.repeat(pa.scalar(x, f.type), len(cell)) for x, f in zip(key, fields)]
    yield pa.RecordBatch.from_arrays([*same, pa.array((cell // n_epochs).astype(np.int32)), pa.array((cell % n_epochs).astype(np.int32)), pa.array(counts)], [*(f.name for f in fields), "roi", "epoch", "cnt"])


def _summed(names: list[str], value: str, n_epochs: int | None = None):
    """Of a partition sorted by the names, the last of them the chunk: one row of packed counters for each, or with n_epochs rows of cells, in
    the same Python worker. Holds one counter, whatever the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, counters, places, waiting = None, Counters(), [], 0
        out: list[tuple] = []
        schema = None

        def settle() -> None:
            nonlocal waiting
            if places:
                counters.add_places(np.concatenate(places))
                places.clear()
            waiting = 0

        def flush() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [[] for _ in schema]
            rows = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
            out.clear()
            return rows

        for b in batches:
            schema = schema or pa.schema([*(b.schema.field(n) for n in names), pa.field("sums", pa.binary())])
            for key, bits in zip(zip(*(b.column(n).to_pylist() for n in names)), b.column(value).to_pylist()):
                if key != now:
                    if now is not None:
                        settle()
                        if n_epochs:
                            yield from _counted(list(schema)[: len(names) - 1], now, counters, n_epochs)
                        else:
                            out.append((*now, counters.packed()))
                    now, counters = key, Counters()
                if value == "sums":
                    counters.add(Counters.of(bits))
                elif len(bits) < CHUNK // 8:
                    places.append(np.frombuffer(bits, dtype=np.uint16))
                    waiting += len(places[-1])
                    if waiting > CHUNK:
                        settle()
                else:
                    counters.carry(np.frombuffer(bits, dtype=np.uint64))
            if len(out) >= 256:
                yield flush()
        if now is not None:
            settle()
            if n_epochs:
                yield from _counted(list(schema)[: len(names) - 1], now, counters, n_epochs)
            else:
                out.append((*now, counters.packed()))
                yield flush()

    return run


def group_counts(members: DataFrame, traces: DataFrame, keys: list[str], n_epochs: int, part: int = 4096, by: list[str] | None = None) -> DataFrame:
    """Counts of the members' cells: keys, roi, epoch, cnt. traces: of_traces() or of_lists() with the same n_epochs; by: what names a user
    there, user_id and keys.

    A key column may be a string or an integer. Members that repeat count each time. One part of a group and chunk is added up in one
    task; more than one part are those of groups with more than `part` members.
    """
    members = members.select(*keys, "user_id")
    wrong = [k for k in keys if not isinstance(members.schema[k].dataType, (StringType, LongType, IntegerType, ShortType, ByteType))]
    if wrong:
        raise TypeError(f"keys are strings or integers: {wrong}")
    kinds = ", ".join(f"`{k}` {members.schema[k].dataType.simpleString()}" for k in keys)
    sizes = members.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > part)
    dealt = members.join(sizes, keys, "left").withColumn("_part", F.pmod(F.xxhash64("user_id"), F.coalesce(F.ceil(F.col("_n") / part), F.lit(1))).cast("int")).drop("_n")
    names = [*keys, "_part", "chunk"]
    rows = dealt.join(traces.hint("merge"), by or ["user_id"]).select(*names, "bits")  # members are more than Spark takes them for, not to be broadcast
    parts = rows.repartition(*names).sortWithinPartitions(*names).mapInArrow(_summed(names, "bits"), f"{kinds}, _part int, chunk int, sums binary")
    whole = [*keys, "chunk"]
    return parts.repartition(*whole).sortWithinPartitions(*whole).mapInArrow(_summed(whole, "sums", n_epochs), f"{kinds}, roi int, epoch int, cnt long")
