"""What a release tells: marginals over places and times, their transforms, and activity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import exponential, normal, pareto, uniform


def marginals(aggregates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, axis, idx, total, p): shares of each ROI (axis `roi`) and epoch (axis `epoch`), and the grand total (axis `all`, idx -1), in one pass."""
    both = aggregates.groupingSets([[*keys, "roi"], [*keys, "epoch"], [*keys]], *keys, "roi", "epoch").agg(F.sum("cnt").alias("total"))
    axis = F.when(F.col("roi").isNotNull(), "roi").when(F.col("epoch").isNotNull(), "epoch").otherwise("all")
    rows = both.select(*keys, axis.alias("axis"), F.coalesce("roi", "epoch", F.lit(-1)).alias("idx"), "total")
    return rows.withColumn("p", F.col("total") / F.max("total").over(Window.partitionBy(*keys)))


def marginal(aggregates: DataFrame, axis: str, keys: list[str]) -> DataFrame:
    """(keys, axis, total, p) along one axis."""
    totals = aggregates.groupBy(*keys, axis).agg(F.sum("cnt").alias("total"))
    return totals.withColumn("p", F.col("total") / F.sum("total").over(Window.partitionBy(*keys)))


def log_compressed(shares: DataFrame, keys: list[str], p: str = "p") -> DataFrame:
    """Shares as ln(p / least positive p + 1), normalised."""
    w = Window.partitionBy(*keys)
    squeezed = F.log(F.col(p) / F.min(F.when(F.col(p) > 0, F.col(p))).over(w) + 1.0)
    return shares.withColumn(p, squeezed).withColumn(p, F.col(p) / F.sum(p).over(w))


def powered(shares: DataFrame, keys: list[str], exponent: Column | float, p: str = "p") -> DataFrame:
    """Shares to a power, normalised; 0 to the power 0 is 1."""
    w = Window.partitionBy(*keys)
    return shares.withColumn(p, F.pow(F.col(p), exponent)).withColumn(p, F.col(p) / F.sum(p).over(w))


def power_exponent(shares: DataFrame, keys: list[str], reference: Column | float, p: str = "p") -> DataFrame:
    """(keys, variance, exponent): 0.001 where the shares vary more than twice as much as the reference, else 0.

    This is where a search in steps of 0.001 from 0 stops that ends when the powered shares' variance is within the
    reference of it: at exponent 0 the variance is zero, and it stays below twice the reference at 0.001.
    """
    v = shares.groupBy(*keys).agg(F.var_pop(p).alias("variance"))
    return v.withColumn("exponent", F.when(F.col("variance") > 2.0 * reference, 0.001).otherwise(0.0))


def reference_variance(n: int, seed: int, axis: str) -> Column:
    """Population variance of n normalised uniform draws, as one expression over an array."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: uniform("power", seed, axis, i))
    total = F.aggregate(draws, F.lit(0.0), lambda a, x: a + x)
    return F.aggregate(draws, F.lit(0.0), lambda a, x: a + F.pow(x / total - 1.0 / n, F.lit(2.0))) / float(n)


def lognormal_parameters(mean: Column | float, skew: float) -> tuple[float, Column]:
    """(sigma, median) of a lognormal with this mean and skewness, in closed form."""
    q = skew**2 + math.sqrt(skew**4 + 4 * skew**2) + 2
    variance = math.log((q / 2) ** (1 / 3) + (2 / q) ** (1 / 3) - 1)
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    return math.sqrt(variance), mean / math.exp(variance / 2)


def activity_draw(kind: str, mean: Column | float, u: Column, v: Column | None = None, skew: float = 3.0) -> Column:
    """Number of visits of a synthetic user: a draw of the named kind with this mean, cut to a whole number."""
    if kind == "constant":
        x = mean if isinstance(mean, Column) else F.lit(float(mean))
    elif kind == "exp":
        x = exponential(u, mean)
    elif kind == "powerlaw":
        x = pareto(u, mean)
    elif kind == "lognormal":
        sigma, median = lognormal_parameters(mean, skew)
        x = median * F.exp(sigma * normal(u, v))
    else:
        raise ValueError(f"unknown activity {kind!r}; `true` takes users' own numbers instead of a draw")
    return F.least(x, F.lit(1e15)).cast("long")
