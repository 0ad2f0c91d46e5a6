"""Accuracy, area under the ROC curve, and the threshold by Youden's index, for all targets at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def accuracy(predictions: DataFrame, by: list[str]) -> DataFrame:
    return predictions.groupBy(*by).agg(F.avg((F.col("y") == F.col("pred")).cast("double")).alias("acc"))


def auc(predictions: DataFrame, by: list[str], score: str = "p") -> DataFrame:
    """By the rank sum of positives, equal scores sharing their mean rank; null without both classes.

    Rows are first summed by score, so that the window has a row for each distinct score.
    """
    steps = predictions.groupBy(*by, score).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = steps.withColumn("_rank", before + (F.col("n") + 1) / 2.0)
    sums = ranked.groupBy(*by).agg(F.sum(F.col("pos") * F.col("_rank")).alias("_r"), F.sum("pos").cast("double").alias("_p"), F.sum(F.col("n") - F.col("pos")).cast("double").alias("_n"))
    area = F.when((F.col("_p") > 0) & (F.col("_n") > 0), (F.col("_r") - F.col("_p") * (F.col("_p") + 1.0) / 2.0) / (F.col("_p") * F.col("_n")))
    return sums.select(*by, area.alias("auc"))


def youden(predictions: DataFrame, by: list[str], score: str = "p") -> DataFrame:
    """(by, thr, j): the largest score threshold with the greatest true minus false positive rate; infinite if none is above zero."""
    steps = predictions.groupBy(*by, score).agg(F.count_if(F.col("y") == 1).alias("pos"), F.count("*").alias("n"))
    down, every = Window.partitionBy(*by).orderBy(F.desc(score)), Window.partitionBy(*by)
    neg = F.col("n") - F.col("pos")
    rates = steps.withColumn("j", F.sum("pos").over(down) / F.sum("pos").over(every) - F.sum(neg).over(down) / F.sum(neg).over(every))
    best = rates.groupBy(*by).agg(F.max(F.struct(F.round("j", 12).alias("j"), F.col(score).alias("thr"))).alias("b"))
    return best.select(*by, F.when(F.col("b.j") > 0, F.col("b.thr")).otherwise(F.lit(float("inf"))).alias("thr"), F.greatest(F.col("b.j"), F.lit(0.0)).alias("j"))


def scores(predictions: DataFrame) -> DataFrame:
    """(target, acc, auc) of predictions(target, y, p, pred)."""
    return accuracy(predictions, ["target"]).join(auc(predictions, ["target"]), "target", "left")
