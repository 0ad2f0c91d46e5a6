"""Epochs and observation windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def epoch(ts: Column, start: Column | int, grain: int, align: bool = False) -> Column:
    """Epoch of a Unix time: the start of its grain, counted from the window's start, cut towards zero.

    Unless the window starts on the grain, its first part and the next whole grain are both epoch 0; `align` counts from
    the grain that the window starts in instead.
    """
    start = start if isinstance(start, Column) else F.lit(start)
    floored = F.lit(float(grain)) * F.floor(ts / float(grain))
    origin = F.lit(float(grain)) * F.floor(start / float(grain)) if align else start
    return ((floored - origin) / float(grain)).cast("int")


def observation_window(points: DataFrame, grain: int = 3600, stop: int | None = None) -> DataFrame:
    """One row: min_ts, max_ts, n_epochs of the window up to `stop` (the largest time if none is given)."""
    end = F.max("ts") if stop is None else F.lit(stop)
    return points.agg(F.min("ts").cast("long").alias("min_ts"), F.max("ts").cast("long").alias("max_ts"), (((end - F.min("ts")) / float(grain)).cast("int") + 1).cast("long").alias("n_epochs"))


def as_text(ts: Column) -> Column:
    """Unix seconds as text, in the session's zone."""
    return F.from_unixtime(ts)
