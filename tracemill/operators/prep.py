"""From points to traces: trimming, gridding, regular users, dense ids, visited cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spatial import Box
from ..functions.temporal import epoch
from ..stages import keep


#: Parts that a bracket is cut into in a pass of a selection, and values that are few enough to look at.
PARTS, FEW = 1024, 4096


def order_statistics(df: DataFrame, ranks: dict[str, list[int]]) -> dict[tuple[str, int], float]:
    """{(column, rank): value}: the values at ranks from 0 in the order of each column's values, nulls left out.

    A pass counts the values in PARTS equal parts of a bracket around each rank, with the least and greatest value of each part, and the
    bracket becomes the part that has the rank. All ranks go together, in a pass for each factor of PARTS or so. When a
    bracket has FEW values or a single one, it is settled. Tasks keep counts of parts, the driver sees these and FEW values a rank.
    """
    ends = df.agg(*(f(c).cast("double").alias(f"{n}_{c}") for c in ranks for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count)))).first()
    found: dict[tuple[str, int], float] = {}
    todo = {(c, r): (ends[f"lo_{c}"], ends[f"hi_{c}"], r, int(ends[f"n_{c}"])) for c, own in ranks.items() for r in own}  # bracket, rank within, values
    if wrong := [key for key, (_, _, r, n) in todo.items() if not 0 <= r < n]:
        raise ValueError(f"no values at {wrong}")
    while todo:
        found |= {key: lo for key, (lo, hi, _, _) in todo.items() if lo == hi}
        brackets = sorted({(c, lo, hi, n) for (c, _), (lo, hi, _, n) in todo.items() if lo != hi})
        number = {b[:3]: i for i, b in enumerate(brackets)}
        if not brackets:
            break
        tagged = []
        for i, (c, lo, hi, n) in enumerate(brackets):
            v = F.col(c).cast("double")
            part = F.when(F.lit(n <= FEW), F.lit(0)).otherwise(F.least(F.lit(PARTS - 1), F.floor((v / 2 - F.lit(lo / 2)) / F.lit(hi / 2 - lo / 2) * PARTS)).cast("int"))
            tagged.append(F.when(v.between(lo, hi), F.struct(F.lit(i).alias("b"), part.alias("part"), v.alias("v"))))
        rows = df.select(F.explode(F.filter(F.array(*tagged), lambda x: x.isNotNull())).alias("x")).select("x.*")
        small = [i for i, b in enumerate(brackets) if b[3] <= FEW]
        values = {r.b: sorted(r.all) for r in rows.where(F.col("b").isin(small)).groupBy("b").agg(F.collect_list("v").alias("all")).collect()} if small else {}
        parts: dict[int, list] = {}
        if len(small) < len(brackets):
            for r in rows.where(~F.col("b").isin(small)).groupBy("b", "part").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                parts.setdefault(r.b, []).append((r.part, r.n, r.lo, r.hi))
        left = {}
        for key, (lo, hi, r, n) in todo.items():
            if lo == hi:
                continue
            i = number[key[0], lo, hi]
            if i in values:
                found[key] = values[i][r]
                continue
            for _, n, lo, hi in sorted(parts[i]):
                if r < n:
                    left[key] = (lo, hi, r, n)
                    break
                r -= n
        todo = left
    return found


def percentile_box(points: DataFrame, low: float = 0.005, high: float = 0.995, approximate: bool = False) -> DataFrame:
    """One row: the box that holds the middle of the coordinates, and their extremes; nulls without points.

    Exact percentiles, between neighbours where a rank falls between them, are selected in a few passes that keep counts only
    (order_statistics); `approximate` keeps a bounded sketch and takes one pass.
    """
    axes = {"lon": ("min_lon", "max_lon"), "lat": ("min_lat", "max_lat")}
    extremes = [f(c).alias(f"{n}_{c}") for c in axes for n, f in (("least", F.min), ("most", F.max))]
    if approximate:
        cuts = [F.percentile_approx(c, F.array(F.lit(low), F.lit(high))).alias(f"_{c}") for c in axes]
        return points.agg(*cuts, *extremes).select(*(F.get(f"_{c}", F.lit(k)).alias(n) for c, names in axes.items() for k, n in enumerate(names)), "least_lon", "most_lon", "least_lat", "most_lat")
    counts = points.agg(*(F.count(c).alias(c) for c in axes)).first()
    at = {(c, q): q * (counts[c] - 1) for c in axes if counts[c] for q in (low, high)}
    ranks = {c: sorted({r for (own, _), x in at.items() if own == c for r in (math.floor(x), math.ceil(x))}) for c in axes if counts[c]}
    values = order_statistics(points, ranks) if ranks else {}

    def cut(c: str, q: float) -> float | None:
        x = at.get((c, q))
        return None if x is None else values[c, math.floor(x)] + (values[c, math.ceil(x)] - values[c, math.floor(x)]) * (x - math.floor(x))

    return points.agg(*extremes).select(*(F.lit(cut(c, q)).cast("double").alias(n) for c, names in axes.items() for n, q in zip(names, (low, high))), "least_lon", "most_lon", "least_lat", "most_lat")


def trim(points: DataFrame, box: Box, stop: int | None = None) -> DataFrame:
    """Points before `stop` and strictly inside the box; both filters reach the scan."""
    if stop is not None:
        points = points.where(F.col("ts") < stop)
    return points.where(box.contains(F.col("lon"), F.col("lat")))


def grid(points: DataFrame, box: Box) -> DataFrame:
    return points.withColumn("roi", box.cell(F.col("lon"), F.col("lat")).cast("int"))


def with_epoch(visits: DataFrame, grain: int = 3600, align: bool = False) -> DataFrame:
    """Visits with the epoch counted from the earliest of them; the minimum is one broadcast row, not a collect."""
    first = visits.agg(F.min("ts").alias("_first"))
    return visits.crossJoin(F.broadcast(first)).withColumn("epoch", epoch(F.col("ts"), F.col("_first"), grain, align)).drop("_first")


def user_stats(visits: DataFrame, region: DataFrame) -> DataFrame:
    """(user_id, n_visits, n_inside, n_rois): visits in all, visits in the region's ROIs, distinct ROIs of those."""
    inside = visits.join(region.select("roi").distinct().withColumn("_in", F.lit(True)), "roi", "left")
    return inside.groupBy("user_id").agg(F.count("*").alias("n_visits"), F.count_if("_in").alias("n_inside"), F.count_distinct(F.when(F.col("_in"), F.col("roi"))).alias("n_rois"))


def regular_users(visits: DataFrame, region: DataFrame, share: float = 0.5) -> DataFrame:
    """user_stats of users with at least `share` of their visits inside the region."""
    return user_stats(visits, region).where(F.col("n_inside") >= share * F.col("n_visits"))


def setting_stats(visits: DataFrame, region: DataFrame, share: float = 0.5) -> DataFrame:
    """One row: users, regular users, and their share."""
    s = user_stats(visits, region).select((F.col("n_inside") >= share * F.col("n_visits")).alias("ok"))
    return s.agg(F.count("*").alias("n_users"), F.count_if("ok").alias("n_valid"), F.avg(F.col("ok").cast("double")).alias("share_valid"))


def restrict(visits: DataFrame, users: DataFrame, region: DataFrame) -> DataFrame:
    """Visits of the given users in the given ROIs: two semi joins."""
    return visits.join(users.select("user_id"), "user_id", "left_semi").join(region.select("roi"), "roi", "left_semi").select(*visits.columns)


def dense_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """df with a gapless index from 0 in the given order, without bringing all rows to one task.

    Rows are range-partitioned and sorted; a row's index is its place in its partition and the sizes of the ones before.
    """
    spread = keep(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = spread.groupBy(part.alias("_part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = spread.withColumn("_part", part).join(F.broadcast(before), "_part")
    return placed.withColumn(name, (F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("_before")).cast("long")).drop("_at", "_part", "_before")


def first_seen(df: DataFrame, column: str, row_id: str) -> DataFrame:
    """(column, idx): values numbered from 0 by where they first appear, row_id being the stable order of rows."""
    return dense_index(df.groupBy(column).agg(F.min(row_id).alias("_first")), "_first", column).select(column, "idx")


def contiguous_users(visits: DataFrame) -> DataFrame:
    """(user_id, new_id): users numbered from 1 in the order of their ids."""
    return dense_index(visits.select("user_id").distinct(), "user_id").select("user_id", (F.col("idx") + 1).alias("new_id"))


def shuffled_labels(values: DataFrame, column: str, draw: Column) -> DataFrame:
    """(column, idx): values numbered from 0 in the order of a keyed draw."""
    return dense_index(values.select(column).distinct().withColumn("_u", draw), "_u", column).select(column, "idx")


def relabel(df: DataFrame, mapping: DataFrame, column: str, keep_unmatched: bool = False) -> DataFrame:
    """df with `column` replaced by mapping's idx; rows without a match go, or get a null."""
    return df.join(mapping.select(column, F.col("idx").alias("_new")), column, "left" if keep_unmatched else "inner").withColumn(column, F.col("_new")).drop("_new").select(*df.columns)


def traces(visits: DataFrame) -> DataFrame:
    """Visited cells of each user, each once."""
    return visits.select("user_id", "roi", "epoch").distinct()


def sizes(cells: DataFrame) -> DataFrame:
    """(user_id, n_visits): visited cells of each user."""
    return cells.groupBy("user_id").agg(F.count("*").alias("n_visits"))


def activity(cells: DataFrame) -> DataFrame:
    """(n_visits, n_users): how many users have how many visits."""
    return sizes(cells).groupBy("n_visits").agg(F.count("*").alias("n_users"))


def size_blocks(cells: DataFrame, k: int) -> DataFrame:
    """(user_id, n_visits, block): users from the largest trace to the smallest, in k blocks of ceil(n / k)."""
    ranked = dense_index(sizes(cells), F.desc("n_visits"), F.asc("user_id"))
    block = ranked.agg(F.ceil(F.count("*") / k).alias("_size"))
    return ranked.crossJoin(F.broadcast(block)).select("user_id", "n_visits", F.floor(F.col("idx") / F.col("_size")).cast("long").alias("block"))
