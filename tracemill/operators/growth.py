"""Connected clusters grown at random over a table of neighbours: a step of every cluster is a join of all of them with that table.

Nothing is collected. A cluster carries its frontier, the neighbours of its ROIs that are not in it. Each has a keyed draw of its own in
each step, and the one with the smallest joins the cluster, which is a random ROI of the frontier; its neighbours are looked up in
the table. A start in a component that is too small for the cluster is moved to a random ROI of those that have the room, so
sizes are exact whenever any component has it; without one, the cluster becomes a whole component of the greatest size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..stages import keep
from .prep import dense_index

#: Steps after which what is grown is written down, so that no plan has more joins than these.
WRITTEN = 12


def both_ways(adjacency: DataFrame) -> DataFrame:
    """(roi, nbr), each pair both ways and once, without loops."""
    pairs = adjacency.where("roi <> nbr").select(F.col("roi").cast("int").alias("roi"), F.col("nbr").cast("int").alias("nbr"))
    return pairs.unionByName(pairs.select(F.col("nbr").alias("roi"), F.col("roi").alias("nbr"))).distinct()


def components(adjacency: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(roi, root, size) of every ROI with a neighbour: the least ROI of its component and the component's number of ROIs.

    A round takes the least root of the neighbours and then the root's root, so long chains take a logarithm of rounds, about.
    """
    edges = keep(both_ways(adjacency))
    now, before = keep(edges.select("roi").distinct().withColumn("root", F.col("roi"))), None
    for _ in range(max_rounds):
        near = edges.join(now.select(F.col("roi").alias("nbr"), "root"), "nbr").groupBy("roi").agg(F.min("root").alias("_least"))
        low = now.join(near, "roi").select("roi", "root", F.least("root", "_least").alias("_least"))
        # a root takes the least that any of its members has seen
        hooks = low.groupBy("root").agg(F.min("_least").alias("_top"))
        hooked = low.join(hooks, "root").select("roi", F.least("_least", "_top").alias("root"))
        jump = hooked.select(F.col("roi").alias("root"), F.col("root").alias("_up"))
        now = keep(hooked.join(jump, "root").select("roi", F.least("root", "_up").alias("root")))
        total = now.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if total == before:
            break
        before = total
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.join(now.groupBy("root").agg(F.count("*").alias("size")), "root").select("roi", "root", "size")


@dataclass(frozen=True)
class Neighbours:
    """An adjacency ready for growing: lists(roi, nbrs), and rooms(roi, size, nth), ROIs numbered from those of the largest components on."""

    lists: DataFrame
    rooms: DataFrame

    @classmethod
    def of(cls, adjacency: DataFrame | Neighbours) -> Neighbours:
        if isinstance(adjacency, Neighbours):
            return adjacency
        lists = keep(both_ways(adjacency).groupBy("roi").agg(F.sort_array(F.collect_set("nbr")).alias("nbrs")))
        return cls(lists, keep(dense_index(components(adjacency), F.desc("size"), F.asc("roi"), name="nth").select("roi", "size", "nth")))


def clusters(starts: DataFrame, adjacency: DataFrame | Neighbours, size: int, seed: int = 42) -> DataFrame:
    """(key columns, cluster array<int>) for each row of starts(start and key columns); the start, or the ROI it was moved to, comes first.

    adjacency(roi, nbr): both ways or one. A null start gives a row only if it is moved.
    """
    near, keys = Neighbours.of(adjacency), [c for c in starts.columns if c != "start"]
    named = [F.col(c) for c in keys]
    want = min(size, near.rooms.agg(F.max("size")).first()[0] or 1)
    roomy = near.rooms.where(F.col("size") >= want).count() if want > 1 else 0
    at = starts.withColumn("start", F.col("start").cast("int"))
    if roomy:
        placed = at.join(near.rooms.select(F.col("roi").alias("start"), "size"), "start", "left").withColumn("_nth", F.when(F.coalesce("size", F.lit(0)) < want, F.floor(uniform("restart", seed, *named) * roomy).cast("long")))
        at = placed.join(near.rooms.select(F.col("nth").alias("_nth"), F.col("roi").alias("_new")), "_nth", "left").select(*keys, F.coalesce("_new", "start").alias("start"))
    none = F.array().cast("array<int>")
    now = at.select(*keys, F.array("start").alias("cluster"), none.alias("frontier"), F.col("start").alias("_roi"))
    for step in range(1, want):
        known = now.join(near.lists.withColumnRenamed("roi", "_roi"), "_roi", "left")
        edge = F.array_except(F.array_union("frontier", F.coalesce("nbrs", none)), "cluster")
        drawn = known.select(*keys, "cluster", edge.alias("frontier"))
        pick = F.array_min(F.transform("frontier", lambda x: F.struct(uniform("grow", seed, step, *named, x).alias("u"), x.alias("x"))))["x"]
        chosen = drawn.withColumn("_roi", pick)
        now = chosen.withColumn("cluster", F.when(F.col("_roi").isNotNull(), F.concat("cluster", F.array("_roi"))).otherwise(F.col("cluster")))
        now = keep(now) if step % WRITTEN == 0 else now
    return now.select(*keys, "cluster")
