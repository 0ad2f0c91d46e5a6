"""Synthetic users made from what a release tells: places, times and activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..stages import keep
from .growth import Neighbours, clusters
from .marginals import activity_draw


def cumulative(shares: DataFrame, axis: str, keys: list[str], p: str = "p") -> DataFrame:
    """(keys, axis, lo, hi): each value's interval of the distribution function; together they part [0, 2), the last one reaching beyond 1."""
    up = Window.partitionBy(*keys).orderBy(axis)
    last = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(axis))) == 1
    ends = shares.select(*keys, axis, F.when(last, 2.0).otherwise(F.sum(p).over(up.rowsBetween(Window.unboundedPreceding, 0))).alias("hi"))
    return ends.select(*keys, axis, F.coalesce(F.lag("hi").over(up), F.lit(0.0)).alias("lo"), "hi")


def indexed(intervals: DataFrame, axis: str, keys: list[str], buckets: int | None = None) -> DataFrame:
    """(keys, bucket, n, axis, lo, hi): the intervals by the equal parts of [0, 1) that they reach into, n parts for each key.

    With as many parts as intervals (the default) the rows are at most twice the intervals, so an average part has two.
    """
    n = F.count("*").over(Window.partitionBy(*keys)) if buckets is None else F.lit(buckets).cast("long")
    part = lambda x: F.least(F.floor(F.col(x) * F.col("n")), F.col("n") - 1)
    return intervals.withColumn("n", n).where("lo < hi").withColumn("bucket", F.explode(F.sequence(part("lo"), part("hi")))).select(*keys, "bucket", "n", axis, "lo", "hi")


def draw(draws: DataFrame, intervals: DataFrame, axis: str, keys: list[str], u: str = "u", buckets: int | None = None) -> DataFrame:
    """draws with the value whose interval holds the draw: one row in, one row out, for keys that have intervals.

    An index of the intervals is joined on the part of [0, 1) that the draw is in, so a draw meets two intervals on average, whatever
    their number, and no table of them travels with the draws. Both sides are shuffled: Spark takes draws made by exploding for as few as
    the rows they come from, and would broadcast them.
    """
    index = indexed(intervals, axis, keys, buckets)
    if buckets is not None:
        asked = draws.withColumn("_n", F.lit(buckets).cast("long"))
    elif keys:
        asked = draws.join(intervals.groupBy(*keys).agg(F.count("*").alias("_n")).hint("merge"), keys)
    else:
        asked = draws.crossJoin(F.broadcast(intervals.agg(F.count("*").alias("_n"))))
    asked = asked.withColumn("bucket", F.floor(F.col(u) * F.col("_n"))).drop("_n")
    return asked.join(index.drop("n").hint("merge"), [*keys, "bucket"]).where((F.col("lo") <= F.col(u)) & (F.col(u) < F.col("hi"))).drop("bucket", "lo", "hi")


#: Visits of a synthetic user above which cells are drawn instead of visits; users that a row makes, and a task.
HEAVY, ROW, TASK = 4096, 256, 16_384
#: Cells in arrays are roi * WIDE + epoch.
WIDE = 1 << 32


def users(heads: DataFrame, keys: list[str], n: int) -> DataFrame:
    """heads with user_id -1..-n for each row, dealt out to tasks: rows of heads are few and small, and would all be in one."""
    heads = keep(heads)
    tasks = max(1, -(-heads.count() * n // TASK))
    parts = heads.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((n - 1) // ROW).cast("long")))).repartition(tasks, *keys, "_part")
    ids = F.sequence(-F.col("_part") * ROW - 1, F.greatest(-(F.col("_part") + 1) * ROW, F.lit(-n).cast("long")), F.lit(-1).cast("long"))
    return parts.withColumn("user_id", F.explode(ids)).drop("_part")


def traces(roi_shares: DataFrame, epoch_shares: DataFrame, adjacency: DataFrame | Neighbours, keys: list[str], n: int, mean: float, activity: str = "exp", cluster_size: int = 10, skew: float = 3.0, seed: int = 42) -> DataFrame:
    """traces_at with one mean for all keys."""
    return traces_at(roi_shares.withColumn("mean", F.lit(float(mean))), epoch_shares, adjacency, keys, n, activity, cluster_size, skew, seed)


def traces_at(roi_shares: DataFrame, epoch_shares: DataFrame, adjacency: DataFrame | Neighbours, keys: list[str], n: int, activity: str = "exp", cluster_size: int = 10, skew: float = 3.0, seed: int = 42, population: DataFrame | None = None) -> DataFrame:
    """(keys, user_id, roi, epoch): cells of n synthetic users (ids below zero) for each key of roi_shares(keys, roi, p, mean), each cell once."""
    return opened(visited(roi_shares, epoch_shares, adjacency, keys, n, activity, cluster_size, skew, seed, population))


def opened(lists: DataFrame) -> DataFrame:
    """Rows with roi and epoch for the cells of visited() rows."""
    cell = F.col("_cell")
    return lists.withColumn("_cell", F.explode("cells")).withColumns({"roi": F.shiftright(cell, 32).cast("int"), "epoch": cell.bitwiseAND(F.lit(WIDE - 1)).cast("int")}).drop("_cell", "cells")


def visited(roi_shares: DataFrame, epoch_shares: DataFrame, adjacency: DataFrame | Neighbours, keys: list[str], n: int, activity: str = "exp", cluster_size: int = 10, skew: float = 3.0, seed: int = 42, population: DataFrame | None = None) -> DataFrame:
    """(keys, user_id, cells array<bigint>): n synthetic users (ids below zero) for each key of roi_shares(keys, roi, p, mean), and their cells.

    A user starts at an ROI drawn from the place marginal, a cluster is grown around it, and visits are drawn with
    replacement: the ROI from the place marginal within the cluster, the epoch from the time marginal. Repeats count once.
    With the activity `true`, numbers of visits are drawn from those of population(n_visits, n_users) and `mean` is not used.
    A power law asks some users for any number of visits: beyond HEAVY, each cell of the cluster is visited with the probability
    that it is in so many visits, so a user has no more cells than the cluster has.

    A user is one row from the cluster on: it takes its ROIs' intervals and its key's times along, in parts of [0, 1) as an index has
    them, and its visits are drawn within the row, so what is shuffled is users and never visits.
    """
    key_cols = [F.col(c) for c in keys]
    made = users(roi_shares.select(*keys, "mean").distinct(), keys, n).withColumn("u", uniform("start", seed, *key_cols, F.col("user_id")))
    starts = draw(made, cumulative(roi_shares, "roi", keys), "roi", keys).withColumnRenamed("roi", "start").select(*keys, "user_id", "start", "mean")
    grown = keep(clusters(starts, adjacency, cluster_size, seed))  # written, so that Spark knows how many users there are
    u = uniform("activity", seed, *key_cols, F.col("user_id"))
    if activity == "true":
        if population is None:
            raise ValueError("the activity `true` needs the population's numbers of visits")
        known = population.select("n_visits", (F.col("n_users") / F.sum("n_users").over(Window.partitionBy())).alias("p"))
        asked = draw(grown.select(*keys, "user_id", "cluster", u.alias("u")), cumulative(known, "n_visits", []), "n_visits", [])
        active = asked.select(*keys, "user_id", "cluster", F.col("n_visits").alias("_n"))
    else:
        n_visits = activity_draw(activity, F.col("mean"), u, uniform("activity2", seed, *key_cols, F.col("user_id")), skew)
        active = grown.select(*keys, "user_id", "cluster", n_visits.alias("_n"))
    near = active.where("_n >= 1").select(*keys, "user_id", "_n", F.explode("cluster").alias("roi")).join(roi_shares.select(*keys, "roi", "p"), [*keys, "roi"])
    inside = near.groupBy(*keys, "user_id", "_n").agg(F.sort_array(F.collect_list(F.struct("roi", "p"))).alias("_in"))
    inside = inside.withColumn("_total", F.aggregate("_in", F.lit(0.0), lambda a, x: a + x["p"])).where("_total > 0")
    inside = inside.withColumn("_in", F.transform("_in", lambda x: F.struct(x["roi"].cast("long").alias("roi"), (x["p"] / F.col("_total")).alias("p"))))
    ends = F.transform("_in", lambda x, i: F.struct(x["roi"].alias("roi"), F.when(i == F.size("_in") - 1, 2.0).otherwise(F.aggregate(F.slice("_in", 1, i + 1), F.lit(0.0), lambda a, y: a + y["p"])).alias("hi")))
    parts = indexed(cumulative(epoch_shares, "epoch", keys), "epoch", keys).groupBy(*keys, "bucket").agg(F.sort_array(F.collect_list(F.struct("hi", F.col("epoch").cast("long").alias("epoch")))).alias("_some"))
    index = parts.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "_some")))["_some"].alias("_parts"))
    times = epoch_shares.where("p > 0").groupBy(*keys).agg(F.collect_list(F.struct(F.col("epoch").cast("long").alias("epoch"), F.col("p").alias("q"))).alias("_times"))
    ready = inside.withColumn("_ends", ends).join(index.join(times, keys), keys)
    # an array of draws first, as a draw in a filter would be made for each thing that is filtered
    drawn = F.transform(F.sequence(F.lit(1), F.col("_n").cast("int")), lambda v: F.struct(uniform("roi", seed, *key_cols, F.col("user_id"), v).alias("a"), uniform("epoch", seed, *key_cols, F.col("user_id"), v).alias("b")))
    place = lambda d: F.filter("_ends", lambda x: x["hi"] > d["a"])[0]["roi"]
    time = lambda d: F.filter(F.col("_parts")[F.floor(d["b"] * F.size("_parts")).cast("int")], lambda x: x["hi"] > d["b"])[0]["epoch"]
    light = F.array_distinct(F.transform(drawn, lambda d: place(d) * WIDE + time(d)))
    seen = lambda x, t: uniform("heavy", seed, *key_cols, F.col("user_id"), x["roi"], t["epoch"]) >= F.pow(1.0 - x["p"] * t["q"], F.col("_n").cast("double"))
    heavy = F.flatten(F.transform(F.filter("_in", lambda x: x["p"] > 0), lambda x: F.transform(F.filter("_times", lambda t: seen(x, t)), lambda t: x["roi"] * WIDE + t["epoch"])))
    return ready.select(*keys, "user_id", F.when(F.col("_n") > HEAVY, heavy).otherwise(light).alias("cells"))
