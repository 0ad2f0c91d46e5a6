"""The contradiction rule: cells of a raw release that rule a target out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contradicted(groups: DataFrame, aggregates: DataFrame, cells: DataFrame, group_size: int) -> DataFrame:
    """(target, agg_id, contradiction): whether some cell shows that the target isn't in the group.

    That is a cell that the target visited and nobody of the group did, or one that everybody did and the target did not.
    groups: target, agg_id; aggregates: target, agg_id, roi, epoch, cnt; cells: target, roi, epoch.
    """
    key = ["target", "agg_id", "roi", "epoch"]
    visited = groups.select("target", "agg_id").join(cells.select("target", "roi", "epoch"), "target")
    counted = aggregates.where("cnt > 0").select(*key).hint("merge")  # all cells of all groups: small as a file, too much for a broadcast
    missed = visited.join(counted, key, "left_anti").select("target", "agg_id")
    everyone = aggregates.where(F.col("cnt") == group_size).select(*key)
    absent = everyone.join(cells.select("target", "roi", "epoch"), ["target", "roi", "epoch"], "left_anti").select("target", "agg_id")
    out = missed.unionByName(absent).distinct().withColumn("_hit", F.lit(True))
    return groups.select("target", "agg_id").join(out, ["target", "agg_id"], "left").select("target", "agg_id", F.coalesce("_hit", F.lit(False)).alias("contradiction"))
