"""Exact k-means by filtering kd-trees: whole nodes go to a centroid where no other can be nearest to any of their vectors.

Vectors become integer points, so all sums and distances are exact. Each partition builds trees over its own points, once; a tree has
the box, the count and the sum of every node, and is a row of a table. In a round every tree is walked with the present
centroids. In a node, the centroid nearest to the box's middle is compared with each other one; one that is farther away even from
the corner of the box that lies most in its favour is dominated and goes. A node with one centroid left gives it its count and sum; a
leaf with several left compares its points with these only. Dominated means strictly farther, so ties are decided by the smaller
number. Trees send a count and a sum for each centroid, which Spark adds up; the driver sees these k rows and the centroids, no points.

Nulls and edge cases: a vector that is null, of another length, or has a null or non-finite component is left out; components count as at
most 524,288 either way, so that squared distances fit a long; repeated rows count each time; a row without an id is clustered but is
no first centroid, and rows that share an id are first centroids in the order of their points; with fewer vectors than centroids
there are as many centroids as vectors with an id, with none there are no rows. Extra columns are not returned, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep, small_batches

#: Points of a leaf, and of a tree, at most; what a component is at most.
LEAF, TREE, MOST = 32, 8192, 1 << 27
FIELDS = ("lo", "hi", "total", "n", "below", "at", "points", "ids", "known")


def build(points: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """A kd-tree's nodes in the order of a walk, and its points' order: a node's are n from `at` on; `below` counts its subtree's nodes."""
    order, nodes = np.arange(len(points)), []

    def add(at: int, n: int) -> int:
        own = points[order[at : at + n]]
        lo, hi = own.min(axis=0), own.max(axis=0)
        node, me = [lo, hi, own.sum(axis=0), n, 1, at], len(nodes)
        nodes.append(node)
        axis = int((hi - lo).argmax())
        if n > LEAF and hi[axis] > lo[axis]:
            order[at : at + n] = order[at : at + n][np.argsort(own[:, axis], kind="stable")]
            add(at, n // 2)
            add(at + n // 2, n - n // 2)
        node[4] = len(nodes) - me
        return node[4]

    add(0, len(points))
    return {k: np.array(v) for k, v in zip(("lo", "hi", "total", "n", "below", "at"), zip(*nodes))}, order


def _trees(width: int):
    """Batches of (id, x) -> a row for each tree of at most TREE points, its arrays as bytes."""

    def tree(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        points = t.column("x").combine_chunks().flatten().to_numpy().reshape(-1, width)
        known = t.column("id").is_valid().to_numpy()
        ids = t.column("id").fill_null(0).to_numpy()
        nodes, order = build(points)
        parts = nodes | {"points": points[order].astype(np.int32), "ids": ids[order], "known": known[order]}
        return pa.RecordBatch.from_arrays([pa.array([parts[k].tobytes()], pa.binary()) for k in FIELDS], list(FIELDS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            while b.num_rows:
                held.append(b.slice(0, TREE - n))
                n, b = n + held[-1].num_rows, b.slice(TREE - n)
                if n == TREE:
                    yield tree(held)
                    held, n = [], 0
        if held:
            yield tree(held)

    return run


def unpacked(row: dict, width: int) -> dict[str, np.ndarray]:
    kinds = dict.fromkeys(FIELDS, np.int64) | {"points": np.int32, "known": np.bool_}
    out = {k: np.frombuffer(row[k], dtype=kinds[k]) for k in FIELDS}
    return out | {k: out[k].reshape(-1, width) for k in ("lo", "hi", "total", "points")}


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, exact: by matrix products of doubles where all numbers are below 2^53, else by integers."""
    p, c = points.astype(np.int64), centroids
    if max(np.abs(p).max(initial=0), np.abs(c).max(initial=0)) <= 1 << 21 and p.shape[1] <= 1 << 8:
        p, c = p.astype(np.float64), c.astype(np.float64)
        return ((p * p).sum(axis=1)[:, None] - 2.0 * (p @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((p - one) ** 2).sum(axis=1) for one in c], axis=1)


def undominated(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids may be nearest to a point of the box: those that are not strictly farther than its middle's nearest one at every corner."""
    best = int(((2 * centroids - (lo + hi)) ** 2).sum(axis=1).argmin())
    corner = np.where(centroids > centroids[best], hi, lo)
    return np.flatnonzero(((centroids - corner) ** 2).sum(axis=1) <= ((centroids[best] - corner) ** 2).sum(axis=1))


def walk(tree: dict[str, np.ndarray], centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(node, centroids left) of nodes that part the tree's points: whole nodes with one centroid left, and leaves."""
    stack = [(0, np.arange(len(centroids)))]
    while stack:
        i, left = stack.pop()
        left = left[undominated(tree["lo"][i], tree["hi"][i], centroids[left])] if len(left) > 1 else left
        if len(left) == 1 or tree["below"][i] == 1:
            yield i, left
        else:
            stack += [(i + 1, left), (i + 1 + int(tree["below"][i + 1]), left)]


def sums(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Count and sum of the tree's points that are nearest to each centroid."""
    n, total = np.zeros(len(centroids), dtype=np.int64), np.zeros(centroids.shape, dtype=np.int64)
    for i, left in walk(tree, centroids):
        if len(left) == 1:
            n[left[0]] += tree["n"][i]
            total[left[0]] += tree["total"][i]
        else:
            own = tree["points"][tree["at"][i] : tree["at"][i] + tree["n"][i]]
            to = left[distances(own, centroids[left]).argmin(axis=1)]
            np.add.at(n, to, 1)
            np.add.at(total, to, own.astype(np.int64))
    return n, total


def assigned(tree: dict[str, np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid and squared distance of each of the tree's points."""
    to, far = np.empty(len(tree["points"]), dtype=np.int32), np.empty(len(tree["points"]), dtype=np.int64)
    for i, left in walk(tree, centroids):
        y = slice(int(tree["at"][i]), int(tree["at"][i] + tree["n"][i]))
        d = distances(tree["points"][y], centroids[left])
        best = d.argmin(axis=1)
        to[y], far[y] = left[best], d[np.arange(len(d)), best]
    return to, far


def points_of(vectors: DataFrame, id_column: str, vector: str, width: int, scale: int) -> DataFrame:
    """(id, x): the vectors that are whole, as integer points."""
    v: Column = F.col(vector).cast("array<double>")
    whole = (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    point = F.transform(v, lambda x: F.greatest(F.least(F.floor(F.greatest(F.least(x, F.lit(1e9)), F.lit(-1e9)) * scale), F.lit(MOST)), F.lit(-MOST)).cast("long"))
    return vectors.where(whole).select(F.col(id_column).cast("long").alias("id"), point.alias("x"))


def cluster(vectors: DataFrame, id_column: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: str = "2") -> tuple[DataFrame, list[list[int]]]:
    """((id, cluster, distance) of every whole vector, the final centroids).

    First centroids are the k vectors whose sha256 of `salt:id` are smallest. Each round assigns all vectors to their nearest
    centroids and moves every centroid that has any to the floor of their mean; then they are assigned once more.
    """
    spark = vectors.sparkSession
    points = points_of(vectors, id_column, vector, width, scale)
    drawn = points.where("id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256))
    first = [r.x for r in drawn.orderBy("h", "x").limit(k).collect()]
    if not first:
        return spark.createDataFrame([], "id long, cluster int, distance long"), []
    small_batches(spark)
    trees = keep(points.mapInArrow(_trees(width), ", ".join(f"{c} binary" for c in FIELDS)))
    centroids = np.array(first, dtype=np.int64)
    for _ in range(rounds):
        centroids = _moved(trees, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                tree = unpacked(row, width)
                to, far = assigned(tree, centroids)
                yield pa.RecordBatch.from_arrays([pa.array(tree["ids"], pa.int64(), mask=~tree["known"]), pa.array(to, pa.int32()), pa.array(far, pa.int64())], ["id", "cluster", "distance"])

    return trees.mapInArrow(run, "id long, cluster int, distance long"), centroids.tolist()


def _moved(trees: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, dtype=np.int64), np.zeros((k, width), dtype=np.int64)
        for b in batches:
            for row in b.to_pylist():
                more = sums(unpacked(row, width), centroids)
                n, total = n + more[0], total + more[1]
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    parts = trees.mapInArrow(run, "cluster int, n long, total array<long>")
    each = [F.sum(F.get("total", F.lit(i)).cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
    new = centroids.copy()
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *each).collect():
        new[r["cluster"]] = [int(r[f"t{i}"]) // r["n"] for i in range(width)]
    return new


def with_inertia(found: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) for what cluster() returns."""
    each = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # a row for each centroid
    both = each.crossJoin(F.broadcast(each.agg(F.sum("cluster_inertia").alias("inertia"))))
    digests = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    digest = found.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return found.join(F.broadcast(both.join(F.broadcast(digest), "cluster")), "cluster").select("id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
