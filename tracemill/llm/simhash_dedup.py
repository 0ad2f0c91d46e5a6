"""SimHash near-dedup: documents are linked whose fingerprints differ in few bits; BK-trees find the links.

A document's fingerprint is the bitwise majority over the XXH64 hashes of its word shingles. Equal fingerprints are
merged first, so a group of copies of any size is one row. The distinct fingerprints are dealt to shards: of the blocks
that the 64 bits are cut into, two fingerprints at distance `radius` or less share at least `agree`, so each
fingerprint goes to one shard for each choice of `agree` blocks, and any linked pair meets in a shard. Each shard has a
BK-tree (children keyed by their integer distance to the parent); a query follows only the edges within `radius` of its
own distance to the node. A shard tree goes to its queries through a shuffle and not a broadcast, as all trees
together grow with the data. Shards above `hot_rows` rows are dealt anew as pairs of blocks, a tree of one block and
queries of another, so that no task holds a whole group. A shard returns a spanning forest of its links, never pairs.

similar_documents() links two texts if the Jaccard similarity of their word shingle sets is at least `similarity`. Texts of
equal words are one node. Candidates are texts whose fingerprints are within the radius, by BK-trees, and, as fingerprints
count words as often as they stand and sets once, so that no radius holds all similar pairs, texts that share a band: a hash
of BAND_ROWS min-hashes of the set, equal for two sets with probability similarity ** BAND_ROWS. There are as many bands as a
pair that is just similar enough needs to share one with probability `recall`. Candidates' components are groups outside
which there is no link; within a group sets are compared exactly. A group beyond one block is first compared with a leader
(star_round), which settles a group of near copies of one text in time proportional to its rows; what is left of it is
dealt in pairs of blocks of about `block_rows` rows, so n texts that are neither like the leader nor ruled out by it
make n * n / block_rows rows. The same holds of a hot shard, where n distinct fingerprints make n * n / hot_rows rows.

Nulls and empty texts have fingerprint zero and are linked like any other. Repeated rows each get their row. A null
doc_id keeps its row and takes part in links; it is the component_id only of a component that has no other. Columns besides
doc_id and text are ignored by the operator; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations, groupby, islice
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
BYTE_AT = np.arange(8, dtype=np.int64) * 256
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose hashes are in memory at once.
HASH_BLOCK = 1 << 18
#: Min-hashes in a band.
BAND_ROWS = 6


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned 64-bit SimHash of a text; zero if it has no words."""
    words = (text or "").encode().translate(LOWER_ASCII).split()
    if not words:
        return 0
    hash64 = xxhash.xxh64_intdigest
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words])
    ones, total = np.zeros((8, 8)), 0
    while (hashes := np.fromiter((hash64(b" ".join(g), 42) for g in islice(grams, HASH_BLOCK)), dtype=np.uint64)).size:
        at = hashes.view(np.uint8).reshape(-1, 8) + BYTE_AT
        ones += np.bincount(at.ravel(), minlength=2048).reshape(8, 256) @ BYTE_BITS
        total += hashes.size
    return int(np.packbits((ones * 2 > total).ravel(), bitorder="little").view(np.uint64)[0])


def with_fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """(doc_id, fp): a signed 64-bit fingerprint for each row."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """Burkhard-Keller tree over 64-bit integers: children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """Index of the value's node, a new one if the value is new."""
        values, children = self.values, self.children
        if not values:
            values.append(value)
            children.append({})
            return 0
        at = 0
        while d := (values[at] ^ value).bit_count():
            nxt = children[at].get(d)
            if nxt is None:
                children[at][d] = nxt = len(values)
                values.append(value)
                children.append({})
                return nxt
            at = nxt
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """Indexes of nodes within the radius; only edges that can lead there are followed."""
        values, children, found = self.values, self.children, []
        stack = [0] if values else []
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            if children[at]:
                stack += [c for edge, c in children[at].items() if d - radius <= edge <= d + radius]
        return found


def forest(tree_rows: list[tuple[int, int]], query_rows: list[tuple[int, int]], radius: int) -> list[tuple[int, int]]:
    """Spanning forest of the links of a shard as (node, root) edges. Rows: (fingerprint, node id). With no queries, tree against itself."""
    tree, parent, owner = BKTree(), {}, []

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def link(x: int, y: int) -> None:
        x, y = find(x), find(y)
        if x != y:
            parent[max(x, y)] = min(x, y)

    for fp, node in tree_rows:
        if not query_rows:
            for k in tree.within(fp, radius):
                link(owner[k], node)
        if tree.add(fp) == len(owner):
            owner.append(node)
    for fp, node in query_rows:
        for k in tree.within(fp, radius):
            link(owner[k], node)
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def tables_for(rows: int, radius: int, shard_rows: int) -> tuple[int, int]:
    """(agree, key bits): the fewest agreeing blocks for which a shard of random fingerprints has at most shard_rows rows."""
    for agree in range(1, 5):
        bits = 64 // (radius + agree) * agree
        if rows >> bits <= shard_rows:
            break
    return agree, bits


def shard_keys(fp: Column, radius: int, agree: int) -> Column:
    """An array of one long for each choice of blocks: the blocks' bits and the number of the choice."""
    n = radius + agree
    edges = [64 * i // n for i in range(n + 1)]
    keys = []
    for t, chosen in enumerate(combinations(range(n), agree)):
        key = F.lit(0).cast("long")
        for b in chosen:
            width = edges[b + 1] - edges[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, edges[b]).bitwiseAND(F.lit((1 << width) - 1).cast("long")))
        keys.append(F.shiftleft(key, 9).bitwiseOR(F.lit(t).cast("long")))
    return F.array(*keys)


def pairs_of(blocks: Column, own: Column) -> Column:
    """The pairs (i, j) of blocks, i <= j, that a row of block `own` takes part in."""
    return F.transform(F.sequence(F.lit(0), blocks - 1), lambda x: F.struct(F.least(x, own).alias("i"), F.greatest(x, own).alias("j")))


def edges_of(found: list[tuple], node: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], node) for k in (0, 1)], names=["src", "dst"])


def edge_schema(df: DataFrame) -> str:
    kind = df.schema["node"].dataType.simpleString()
    return f"src {kind}, dst {kind}"


def shard_links(nodes: DataFrame, radius: int, rows: int, shard_rows: int = 64, hot_rows: int = 2048) -> DataFrame:
    """Links among distinct fingerprints (fp, node) as (src, dst) edges of nodes that span every shard's components."""
    agree, _ = tables_for(rows, radius, shard_rows)
    dealt = nodes.select("fp", "node", F.explode(shard_keys(F.col("fp"), radius, agree)).alias("shard"))
    hot = dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows)
    hot = common.keep(hot.select("shard", F.ceil(F.col("n") / hot_rows).cast("int").alias("blocks")))
    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))
    if hot.isEmpty():
        dealt = dealt.select("shard", "fp", "node", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("b"))
    else:
        block = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        dealt = dealt.join(hot, "shard", "left").withColumn("b", F.coalesce(block, F.lit(0)))
        pairs = F.when(F.col("blocks").isNull(), one).otherwise(pairs_of(F.col("blocks"), F.col("b")))
        dealt = dealt.select("shard", "fp", "node", "b", F.explode(pairs).alias("p")).select("shard", "fp", "node", "p.i", "p.j", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key, rows):
            if len(rows) < 2:
                return []
            if key[1] == key[2]:
                return forest([x[:2] for x in rows], [], radius)
            mine, other = [x[:2] for x in rows if x[2] == key[1]], [x[:2] for x in rows if x[2] == key[2]]
            return forest(mine, other, radius) if mine and other else []

        now, rows, kind = None, [], pa.int64()
        for b in batches:
            out, kind = [], b.schema.field("node").type
            for shard, fp, node, i, j, side in zip(*(c.to_pylist() for c in b.columns)):
                if (key := (shard, i, j)) != now:
                    out += solved(now, rows)
                    now, rows = key, []
                rows.append((fp & 0xFFFFFFFFFFFFFFFF, node, side))
            if out:
                yield edges_of(out, kind)
        if out := solved(now, rows):
            yield edges_of(out, kind)

    by = ["shard", "i", "j"]
    return dealt.select(*by[:1], "fp", "node", *by[1:], "b").repartition(*by).sortWithinPartitions(*by).mapInArrow(run, edge_schema(nodes))


def near_duplicates(docs: DataFrame, shingle: int = 4, radius: int = 4, shard_rows: int = 64, hot_rows: int = 2048) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text): the component's smallest doc_id."""
    marked = common.keep(with_fingerprints(docs, shingle))
    prints = common.keep(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    linked = common.components(shard_links(prints.select("fp", F.col("fp").alias("node")), radius, prints.count(), shard_rows, hot_rows))
    grouped = prints.join(linked, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("grp"))
    least = grouped.groupBy("grp").agg(F.min("first").alias("component_id"))
    return marked.join(grouped.join(least, "grp"), "fp").select("doc_id", "fp", "component_id")


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWER_ASCII).split()


def shingle_set(text: str | None, shingle: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of a text's word shingles; of the whole sequence if there are fewer words, none without words."""
    words = words_of(text)
    grams = zip(*(words[i:] for i in range(shingle))) if len(words) >= shingle else iter([words] if words else [])
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams), dtype=np.uint64))


def common_hashes(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    return int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0


def jaccard_reaches(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity; two empty ones are equal."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)):
        return False
    both = common_hashes(a, b)
    return both >= similarity * (len(a) + len(b) - both)


def bands_for(similarity: float, recall: float) -> int:
    """The fewest bands of which two sets of this similarity share one with probability `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity**BAND_ROWS))


def band_keys(sets: list[np.ndarray], bands: int) -> list[np.ndarray]:
    """For each shingle set a key for each band; none for an empty set."""
    keys = [np.empty(0, dtype=np.int64)] * len(sets)
    at, mix = 0, [np.uint32(xxhash.xxh32_intdigest(str(k).encode(), 42) | 1) for k in range(2 * BAND_ROWS * bands)]
    while at < len(sets):
        chosen, size = [], 0
        while at < len(sets) and (not chosen or size + len(sets[at]) <= HASH_BLOCK):
            if len(sets[at]):
                chosen.append(at)
                size += len(sets[at])
            at += 1
        if not chosen:
            break
        flat = (np.concatenate([sets[k] for k in chosen]) >> np.uint64(32)).astype(np.uint32)
        starts, mixed = np.cumsum([0, *(len(sets[k]) for k in chosen[:-1])]), np.empty_like(flat)
        found = np.empty((len(chosen), bands), dtype=np.uint64)
        for band in range(bands):
            key = np.full(len(chosen), band, dtype=np.uint64)
            for k in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
                np.bitwise_xor(flat, mix[2 * k], out=mixed)
                np.multiply(mixed, mix[2 * k + 1], out=mixed)
                key = (key ^ np.minimum.reduceat(mixed, starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(31)
            found[:, band] = key
        for k, row in zip(chosen, found.view(np.int64)):
            keys[k] = row
    return keys


def band_links(nodes: DataFrame) -> DataFrame:
    """Each node (node, bands) with the smallest node of each band that it shares, as (src, dst) edges."""
    dealt = nodes.select("node", F.explode("bands").alias("band"))
    shared = dealt.groupBy("band").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("band", "least")
    return common.lookup(dealt, shared, ["band"], ["node"]).where("node <> least").select(F.col("node").alias("src"), F.col("least").alias("dst"))


def similar_forest(rows: list[tuple[object, np.ndarray]], others: list[tuple[object, np.ndarray]], similarity: float) -> list[tuple]:
    """Spanning forest of the links among rows (node, shingle set), or of rows with others, as (node, root) edges."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    def look(node, grams: np.ndarray, held: list) -> None:
        mine = find(node)
        for known, there in held:
            if (root := find(known)) != mine and jaccard_reaches(grams, there, similarity):
                parent[max(root, mine)] = mine = min(root, mine)

    for k, (node, grams) in enumerate(rows if not others else others):
        look(node, grams, rows if others else rows[:k])
    return [(x, r) for x in list(parent) if (r := find(x)) != x]


def with_marks(rows: DataFrame, votes: int, shingle: int, bands: int) -> DataFrame:
    """rows(doc_id, k1, k2, text) without text, but with the fingerprint, a 128-bit hash of the sequence of words, and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(3).to_pylist()
            fp = np.array([fingerprint(t, votes) for t in texts], dtype=np.uint64).view(np.int64)
            words = [xxhash.xxh3_128_digest(b" ".join(words_of(t))) for t in texts]
            keys = band_keys([shingle_set(t, shingle) for t in texts], bands)
            columns = [*b.columns[:3], pa.array(fp), pa.array(words, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "k1", "k2", "fp", "words", "bands"])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, fp long, words binary, bands array<long>")


def shingle_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(grp, node, grams) of rows (grp, node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grams = pa.array([shingle_set(t, shingle).tobytes() for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*b.columns[:2], grams], names=["grp", "node", "grams"])

    return rows.select("grp", "node", "text").mapInArrow(run, "grp binary, node binary, grams binary")


def blocks_of(sets: DataFrame, block_rows: int, block_bytes: int) -> DataFrame:
    """(grp, texts, blocks, leader): how many texts a group has, how many blocks it needs, and one of its texts, the same on every run."""
    needs = F.greatest(F.ceil(F.count("*") / block_rows), F.ceil(F.sum(F.octet_length("grams")) / block_bytes))
    return sets.groupBy("grp").agg(F.count("*").alias("texts"), needs.cast("int").alias("blocks"), F.min_by("node", F.struct(F.xxhash64("node"), "node")).alias("leader"))


def block(blocks: Column) -> Column:
    return F.pmod(F.xxhash64("node"), blocks).cast("int")


def star_round(sets: DataFrame, sizes: DataFrame, similarity: float, block_rows: int, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(links, what is left) of groups of several blocks, by comparing each text with its group's leader.

    Texts like the leader are linked to it and are done with each other. Jaccard distance is a metric, so another text can
    be like one of them only if it is no further from the leader than the bound plus the farthest of them; only such texts
    are compared with the leader's, one link being enough. All that are not linked to the leader are left.
    """
    dealt = common.lookup(sets, sizes, ["grp"], ["node"]).withColumn("first", F.col("node") == F.col("leader"))
    places = F.when(F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(block(F.col("blocks"))))
    dealt = dealt.select("grp", F.explode(places).alias("b"), "first", "node", "leader", "grams").repartition("grp", "b").sortWithinPartitions("grp", "b", F.desc("first"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lead = None, None
        for batch in batches:
            alike, far = [], []
            for grp, b, first, grams in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 5))):
                own = np.frombuffer(grams, dtype=np.uint64)
                if first and (grp, b) != now:
                    now, lead = (grp, b), own
                both = common_hashes(own, lead)
                either = len(own) + len(lead) - both
                alike.append(both >= similarity * either)
                far.append(1 - both / either if either else 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in (0, 2, 3, 4, 5)), pa.array(alike, pa.bool_()), pa.array(far, pa.float64())], names=["grp", "first", "node", "leader", "grams", "alike", "far"])

    seen = common.keep(dealt.mapInArrow(run, "grp binary, first boolean, node binary, leader binary, grams binary, alike boolean, far double"))
    links = seen.where("alike and not first").select(F.col("node").alias("src"), F.col("leader").alias("dst"))
    reach = seen.groupBy("grp").agg(F.max(F.when(F.col("alike"), F.col("far"))).alias("reach"))
    placed = common.lookup(seen.where("not first"), reach, ["grp"], ["node"])
    near = placed.where(F.col("alike") | (F.col("far") <= F.col("reach") + (1 - similarity) + 1e-9))
    counts = near.groupBy("grp", "alike").agg(F.ceil(F.greatest(F.count("*") / block_rows, F.sum(F.octet_length("grams")) / block_bytes)).cast("int").alias("blocks"))
    both = counts.groupBy("grp").agg(F.max(F.when(F.col("alike"), F.col("blocks"))).alias("likes"), F.max(F.when(~F.col("alike"), F.col("blocks"))).alias("others")).where("likes is not null and others is not null")
    fringe = common.lookup(near.select("grp", "node", "alike", "grams"), both, ["grp"], ["node"])
    own = F.when(F.col("alike"), block(F.col("likes"))).otherwise(block(F.col("others")))
    across = F.explode(F.sequence(F.lit(0), F.when(F.col("alike"), F.col("others")).otherwise(F.col("likes")) - 1))
    fringe = fringe.select("grp", "node", "alike", "grams", own.alias("own"), across.alias("across"))
    i, j = F.when(F.col("alike"), F.col("own")).otherwise(F.col("across")), F.when(F.col("alike"), F.col("across")).otherwise(F.col("own"))
    fringe = fringe.select("grp", i.alias("i"), j.alias("j"), "node", "alike", "grams").repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", F.desc("alike"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            out = []
            for grp, i, j, node, alike, grams in zip(*(c.to_pylist() for c in batch.columns)):
                if (grp, i, j) != now:
                    now, held = (grp, i, j), []
                own = np.frombuffer(grams, dtype=np.uint64)
                if alike:
                    held.append((node, own))
                elif (hit := next((x for x, there in held if jaccard_reaches(own, there, similarity)), None)) is not None:
                    out.append((node, hit))
            if out:
                yield edges_of(out, pa.binary())

    links = links.unionByName(fringe.mapInArrow(meet, "src binary, dst binary"))
    return common.keep(links), common.keep(seen.where("not alike").select("grp", "node", "grams"))


def similar_links(sets: DataFrame, similarity: float, block_rows: int, block_bytes: int, rounds: int = 4) -> DataFrame:
    """Links among the texts of each group as (src, dst) edges that span it: stars of large groups first, then pairs of blocks.

    Stars go on for `rounds` rounds at most, and only while a round settles half of the texts of large groups.
    """
    links, small, left, before = [], [], sets, None
    for _ in range(rounds):
        sizes = common.keep(blocks_of(left, block_rows, block_bytes))
        now = sizes.where("blocks > 1").agg(F.sum("texts")).first()[0]
        if not now or before and 2 * now > before:
            break
        before = now
        small.append(common.lookup(left, sizes.where("blocks = 1").select("grp"), ["grp"], ["node"]))
        found, left = star_round(left, sizes.where("blocks > 1").drop("texts"), similarity, block_rows, block_bytes)
        links.append(found)
    left = reduce(DataFrame.unionByName, small, left)  # a group is small in one round only, so no group is mixed
    dealt = common.lookup(left, blocks_of(left, block_rows, block_bytes).select("grp", "blocks"), ["grp"], ["node"]).withColumn("b", block(F.col("blocks")))
    dealt = dealt.select("grp", F.explode(pairs_of(F.col("blocks"), F.col("b"))).alias("p"), "node", "b", "grams").select("grp", "p.i", "p.j", "node", "b", "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for (_, i, j), group in groupby(rows, itemgetter(0, 1, 2)):
            sides = {i: [], j: []}
            for _, _, _, node, b, grams in group:
                sides[b].append((node, np.frombuffer(grams, dtype=np.uint64)))
            if i == j or (sides[i] and sides[j]):
                if out := similar_forest(sides[i], sides[j] if i != j else [], similarity):
                    yield edges_of(out, pa.binary())

    by = ["grp", "i", "j"]
    return reduce(DataFrame.unionByName, links, dealt.repartition(*by).sortWithinPartitions(*by).mapInArrow(run, "src binary, dst binary"))


def row_keys(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row's doc_id and text, which tell other rows apart."""
    own = [docs["doc_id"].cast("long"), docs["doc_id"].isNull(), docs["text"].cast("string"), docs["text"].isNull()]
    return F.xxhash64(*own), F.xxhash64(F.lit("other"), *own)


def classified(
    docs: DataFrame, similarity: float = 0.8, shingle: int = 5, votes: int = 2, radius: int = 8, recall: float = 0.9999, shard_rows: int = 256, hot_rows: int = 2048, block_rows: int = 256, block_bytes: int = 8 << 20
) -> DataFrame:
    """(doc_id, k1, k2, fp, grp) for each row of docs(doc_id, text): rows with equal grp are linked, k1 and k2 are row_keys()."""
    common.small_batches(docs.sparkSession)
    k1, k2 = row_keys(docs)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), docs["text"].cast("string").alias("text"))
    marked = common.keep(with_marks(rows, votes, shingle, bands_for(similarity, recall)))
    row = F.struct("k1", "k2")
    nodes = common.keep(marked.groupBy("words").agg(F.first("fp").alias("fp"), F.first("bands").alias("bands"), F.min(row).alias("row")).withColumnRenamed("words", "node"))
    prints = common.keep(nodes.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")))
    near = shard_links(prints.select("fp", F.col("first").alias("node")), radius, prints.count(), shard_rows, hot_rows)
    same = nodes.select("fp", "node").join(prints.where("n > 1"), "fp").where("node <> first").select(F.col("node").alias("src"), F.col("first").alias("dst"))
    near = common.components(near.unionByName(same).unionByName(band_links(nodes)))
    # only texts that have a candidate are read again; others are classes of their own
    roots = near.select("root").distinct().select(F.col("root").alias("node"), F.col("root"))
    wanted = near.unionByName(roots).join(nodes.select("node", "row"), "node").select("node", F.col("root").alias("grp"), "row.k1", "row.k2")
    texts = rows.select("k1", "k2", "text").join(wanted, ["k1", "k2"])
    if not marked.groupBy("k1", "k2").count().where("count > 1").isEmpty():  # rows that are repeated whole
        texts = texts.groupBy("node", "grp").agg(F.first("text").alias("text"))
    linked = common.components(similar_links(common.keep(shingle_sets(texts, shingle)), similarity, block_rows, block_bytes))
    classes = nodes.join(linked, "node", "left").select(F.col("node").alias("words"), F.coalesce("root", "node").alias("grp"))
    return marked.join(classes, "words").select("doc_id", "k1", "k2", "fp", "grp")


def similar_documents(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs(doc_id, text), linked by similarity; settings are those of classified().

    Two texts without words are equal to each other; fewer than `shingle` words are one shingle. A pair just at the similarity
    is found with probability `recall` at least. A doc_id that is repeated with another text has a row, and may have a class,
    for each text.
    """
    found = common.keep(classified(docs, **settings))
    least = found.groupBy("grp").agg(F.min("doc_id").alias("component_id"))
    return found.join(least, "grp").select("doc_id", "fp", "component_id")


def deduplicated(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs with all their columns, one of each class of similar documents; settings are those of classified().

    The one with the smallest doc_id stays, one without a doc_id only where none of its class has any; of several texts with
    that doc_id in the class one stays, and so does one of several rows of that text. Two rows of one doc_id whose texts are
    not alike are two documents.
    """
    found = common.keep(classified(docs, **settings))
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "k1", "k2")
    chosen = common.keep(found.groupBy("grp").agg(F.min(order).alias("c")).select("c.k1", "c.k2"))
    keys = common.keep(found.groupBy("k1", "k2").agg(F.count("*").alias("n")))
    columns = docs.columns
    names = [common.free_name(columns, "k1"), common.free_name(columns, "k2")]
    own = docs.withColumns(dict(zip(names, row_keys(docs))))
    kept = own.join(keys.join(chosen, ["k1", "k2"], "left_anti").select("k1", "k2").toDF(*names), names, "left_anti")
    again = common.keep(keys.where("n > 1").join(chosen, ["k1", "k2"]).select("k1", "k2").toDF(*names))
    if again.isEmpty():
        return kept.select(*common.quoted(columns))
    row, by = F.struct(*common.quoted(columns)), F.xxhash64(*common.quoted([c for c, kind in docs.dtypes if "map<" not in kind and kind != "variant"]))
    several = kept.join(again, names, "left_semi").groupBy(*names).agg(F.min_by(row, by).alias("row")).select("row.*")
    return kept.join(again, names, "left_anti").select(*common.quoted(columns)).unionByName(several)


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
