"""Disclosure controls: noise on every cell, clipping, suppression of small counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import exponential, laplace, uniform


def suppress(aggregates: DataFrame, k: int) -> DataFrame:
    """Counts of at most k become zero, and zeros are left out."""
    return aggregates.where(F.col("cnt") > k)


def noisy_counts(cnt: Column, draw: Column, scale: float, group_size: int) -> Column:
    """Counts with Laplace noise cut towards zero, kept within 0 and the group's size."""
    return F.greatest(F.lit(0), F.least(F.lit(group_size), F.coalesce(cnt, F.lit(0)) + laplace(draw, scale).cast("long"))).cast("long")


@dataclass(frozen=True)
class Skips:
    """How empty cells are skipped. Noise lifts an empty cell above k with chance p, so the next one lies a geometric gap ahead.

    The grid is cut into blocks of `block` cells with `expected` such cells each, and `draws` gaps are drawn for a block: they reach
    its end but for a chance of 1e-14. What noise gives such a cell is k + 1 and more, exponentially.
    """

    scale: float
    k: int
    n_cells: int
    expected: int = 1024

    @property
    def p(self) -> float:
        return 0.5 * math.exp(-(self.k + 1) / self.scale)

    @property
    def block(self) -> int:
        return max(1, math.ceil(self.expected / self.p)) if self.p > self.expected / 2**53 else 2**62

    @property
    def draws(self) -> int:
        mean = min(self.block, self.n_cells) * self.p
        return math.ceil(mean + 8.0 * math.sqrt(mean) + 32.0)


def lifted(noise_groups: DataFrame, key: list[str], skips: Skips, n_epochs: int, seed: int) -> DataFrame:
    """(key, roi, epoch, z): the empty cells that noise lifts above k in each row of noise_groups(key), and to what. As many rows as there are such cells, about."""
    columns = [F.col(c) for c in key]
    if skips.p <= 0.0 or not skips.n_cells:
        return noise_groups.select(*key, *(F.lit(0).cast(t).alias(c) for c, t in (("roi", "int"), ("epoch", "int"), ("z", "long")))).limit(0)
    blocks = noise_groups.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit((skips.n_cells - 1) // skips.block).cast("long"))))
    drawn = blocks.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(skips.draws - 1))))
    gap = F.floor(F.log(uniform("skip", seed, *columns, F.col("_b"), F.col("_i"))) / F.lit(math.log(1.0 - skips.p))) + 1
    place = F.sum("_gap").over(Window.partitionBy(*key, "_b").orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)) - 1
    placed = drawn.withColumn("_gap", gap).withColumn("_at", place).where(F.col("_at") < skips.block).withColumn("_cell", F.col("_b") * skips.block + F.col("_at")).where(F.col("_cell") < skips.n_cells)
    z = (exponential(uniform("tail", seed, *columns, F.col("_b"), F.col("_i")), skips.scale)).cast("long") + (skips.k + 1)
    return placed.select(*key, F.floor(F.col("_cell") / n_epochs).cast("int").alias("roi"), (F.col("_cell") % n_epochs).cast("int").alias("epoch"), z.alias("z"))


def release(aggregates: DataFrame, groups: DataFrame, keys: list[str], noise_key: list[str], n_rois: int, n_epochs: int, group_size: int, eps: float | None = None, sens: float | None = None, k: int = 0, seed: int = 42) -> DataFrame:
    """What is released of aggregates: noise on all cells (zeros too), then clipping, then suppression.

    Without both eps and sens there is no noise. Groups of the same noise_key, as the two of a pair, have the same noise in every cell.
    groups: one row for each aggregate, with keys and noise_key, so that groups without a visit are released too.
    Only cells that some group of the noise_key counts have a draw of their own; of the others, those that survive are found by
    geometric gaps (lifted), so the cost is in counted and released cells, whatever the size of the grid.
    """
    if eps is None or sens is None:
        return suppress(aggregates, k) if k else aggregates
    all_keys = list(dict.fromkeys([*keys, *noise_key]))
    named = groups.select(*all_keys).distinct()
    seen = aggregates.select(*keys, "roi", "epoch", "cnt")
    seen = seen if set(noise_key) <= set(keys) else seen.join(named, keys)
    counted = seen.select(*noise_key, "roi", "epoch").distinct()
    if noise_key == keys:
        own = seen
    else:  # a cell that the other group of a pair counts has its draw here too
        own = named.join(counted, noise_key).join(seen.select(*all_keys, "roi", "epoch", "cnt"), [*all_keys, "roi", "epoch"], "left")
    draw = uniform("noise", seed, *(F.col(c) for c in noise_key), F.col("roi"), F.col("epoch"))
    noisy = own.withColumn("cnt", noisy_counts(F.col("cnt"), draw, sens / eps, group_size))
    empty = lifted(named.select(*noise_key).distinct(), noise_key, Skips(sens / eps, k, n_rois * n_epochs), n_epochs, seed).join(counted, [*noise_key, "roi", "epoch"], "left_anti")
    risen = named.join(empty, noise_key).withColumn("cnt", F.least(F.lit(group_size).cast("long"), F.col("z")))
    out = noisy.select(*keys, "roi", "epoch", "cnt").unionByName(risen.select(*keys, "roi", "epoch", "cnt"))
    return out.where(F.col("cnt") > k)
