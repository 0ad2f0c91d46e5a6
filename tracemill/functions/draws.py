"""Keyed randomness: every draw is a function of its key, so results don't depend on partitions, order or retries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Part = Column | str | int | float


def uniform(*key: Part) -> Column:
    """A uniform draw in (0, 1) for the key: strings are literals, columns their values."""
    parts = [F.lit(str(k)) if not isinstance(k, Column) else k.cast("string") for k in key]
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0


def laplace(u: Column, scale: Column | float) -> Column:
    """Laplace draw by inverse distribution function."""
    return -scale * F.signum(u - 0.5) * F.log(1.0 - 2.0 * F.abs(u - 0.5))


def exponential(u: Column, mean: Column | float) -> Column:
    return -mean * F.log(1.0 - u)


def pareto(u: Column, mean: Column | float) -> Column:
    """Power law with shape 1 + 1/mean, support from 1."""
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    return F.pow(1.0 - u, -1.0 / (1.0 + 1.0 / mean))


def normal(u: Column, v: Column) -> Column:
    """Standard normal draw from two uniform ones (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(6.283185307179586) * v)
