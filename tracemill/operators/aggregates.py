"""Group aggregates: how many members of a group were in each cell."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bitmaps


def group_counts(members: DataFrame, cells: DataFrame, keys: list[str], n_epochs: int | None = None) -> DataFrame:
    """Sums of the members' traces: keys, roi, epoch, cnt. Bitmaps of whole traces are shuffled and added, not cells.

    cells: user_id, roi, epoch from 0, each cell once. n_epochs: above every epoch; where it is not given, one row tells it.
    """
    if n_epochs is None:
        n_epochs = (cells.agg(F.max("epoch")).first()[0] or 0) + 1
    return bitmaps.group_counts(members, bitmaps.of_traces(cells, n_epochs), keys, n_epochs)


def pair_counts(paired: DataFrame, cells: DataFrame, n_epochs: int | None = None) -> DataFrame:
    """Aggregates of pairs of groups: the common members are summed once, then each side's own member is added.

    paired: groups_paired rows. Returns target, split, pair_id, label, roi, epoch, cnt.
    """
    if n_epochs is None:
        n_epochs = (cells.agg(F.max("epoch")).first()[0] or 0) + 1
    return pair_sums(paired, bitmaps.of_traces(cells, n_epochs), n_epochs)


def pair_sums(paired: DataFrame, traces: DataFrame, n_epochs: int, by: list[str] | None = None) -> DataFrame:
    """pair_counts of bitmaps; by: what names a user in them."""
    keys = ["target", "split", "pair_id"]
    sides = {"common": F.array(F.lit(1), F.lit(0)), "in": F.array(F.lit(1)), "out": F.array(F.lit(0))}
    labels = F.when(F.col("role") == "common", sides["common"]).when(F.col("role") == "in", sides["in"]).otherwise(sides["out"])
    both = bitmaps.group_counts(paired, traces, [*keys, "role"], n_epochs, by=by).withColumn("label", F.explode(labels))
    return both.groupBy(*keys, "label", "roi", "epoch").agg(F.sum("cnt").alias("cnt"))


def swap_traces(aggregates: DataFrame, full: DataFrame, partial: DataFrame, keys: list[str]) -> DataFrame:
    """IN aggregates with the targets' full traces replaced by partial ones: a signed sum, zeros left out.

    aggregates: keys (with target and label), roi, epoch, cnt; full and partial: target, roi, epoch.
    """
    groups = aggregates.where("label = 1").select(*keys).distinct()
    signed = [aggregates.select(*keys, "roi", "epoch", "cnt")]
    for cells, weight in ((full, -1), (partial, 1)):
        signed.append(groups.join(cells.select("target", "roi", "epoch"), "target").select(*keys, "roi", "epoch", F.lit(weight).cast("long").alias("cnt")))
    return signed[0].unionByName(signed[1]).unionByName(signed[2]).groupBy(*keys, "roi", "epoch").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
