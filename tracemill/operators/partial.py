"""What an observer knows of a target's trace: all of it, a random part, or places only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform


def random_part(cells: DataFrame, share: float, seed: int = 42) -> DataFrame:
    """Cells (target, roi, epoch) with int(n * (1 - share)) random ones deleted of each target's n."""
    w = Window.partitionBy("target")
    drawn = cells.withColumn("_u", uniform("part", seed, F.col("target"), F.col("roi"), F.col("epoch")))
    ranked = drawn.withColumn("_rank", F.row_number().over(w.orderBy("_u", "roi", "epoch"))).withColumn("_n", F.count("*").over(w))
    return ranked.where(F.col("_rank") > (F.col("_n") * (1.0 - share)).cast("int")).select("target", "roi", "epoch")


def top_rois(cells: DataFrame, k: int) -> DataFrame:
    """(target, roi, cnt): each target's k most visited ROIs, the smaller ROI first among equals."""
    counts = cells.groupBy("target", "roi").agg(F.count("*").alias("cnt"))
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("cnt"), "roi"))
    return counts.withColumn("_rank", rank).where(F.col("_rank") <= k).drop("_rank")


def top_part(cells: DataFrame, k: int) -> DataFrame:
    """Cells in each target's k most visited ROIs."""
    return cells.join(top_rois(cells, k).select("target", "roi"), ["target", "roi"], "left_semi").select("target", "roi", "epoch")


def _always(rois: DataFrame, n_epochs: int) -> DataFrame:
    return rois.select("target", "roi").distinct().withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))


def all_rois(cells: DataFrame, n_epochs: int) -> DataFrame:
    """Every visited ROI in every epoch: the places are known, the times are not."""
    return _always(cells, n_epochs)


def top_rois_always(cells: DataFrame, k: int, n_epochs: int) -> DataFrame:
    return _always(top_rois(cells, k), n_epochs)


def known(cells: DataFrame, mode: str | None, n_epochs: int, share: float | None = None, k: int | None = None, seed: int = 42) -> DataFrame:
    """The part of (target, roi, epoch) that is known under the named mode."""
    if mode is None:
        return cells
    if mode == "random":
        return random_part(cells, 1.0 if share is None else share, seed)
    if mode == "time_and_top_k_locations":
        return top_part(cells, k)
    if mode == "only_rois_greedy":
        return all_rois(cells, n_epochs)
    if mode == "only_rois_top_k_locations":
        return top_rois_always(cells, k, n_epochs)
    raise ValueError(f"unknown partial trace mode {mode!r}")
