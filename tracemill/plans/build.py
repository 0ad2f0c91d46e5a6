"""From traces to a bundle of aggregates for all targets and splits, in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import BuildConfig
from ..operators import aggregates, bitmaps, prep, sampling
from ..stages import keep

KEYS = ["target", "split", "agg_id", "pair_id", "label"]


def membership(sizes: DataFrame, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """(paired training members with roles, validation and test members): who is in which group, of the users in sizes(user_id, n_visits)."""
    chosen = sampling.targets(sizes, config.n_targets, config.min_visits, config.seed)
    pool, rest = sampling.reference(chosen, sizes, config.reference_size, config.seed)
    train = sampling.groups_paired(pool, "train", config.group_size, config.train, config.seed)
    validation = sampling.groups(pool, "validation", config.group_size, config.validation, config.seed)
    test = sampling.groups(rest, "test", config.group_size, config.test, config.seed)
    return train, validation.unionByName(test)


def bundle(cells: DataFrame, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """(groups, aggregates) of a bundle: one row for each group, and its non-empty cells."""
    n_epochs = (cells.agg(F.max("epoch")).first()[0] or 0) + 1
    return bundle_of(bitmaps.of_traces(cells, n_epochs), prep.sizes(cells), n_epochs, config)


def bundle_of(traces: DataFrame, sizes: DataFrame, n_epochs: int, config: BuildConfig) -> tuple[DataFrame, DataFrame]:
    """The same of traces as bitmaps.of_traces has them, with their sizes(user_id, n_visits).

    Who is in which group is written down first, as groups and aggregates are both read from it.
    """
    train, others = (keep(m) for m in membership(sizes, config))
    pairs = aggregates.pair_sums(train, traces, n_epochs).withColumn("agg_id", F.concat_ws("-", "pair_id", "label"))
    singles = bitmaps.group_counts(others, traces, ["target", "split", "agg_id", "label"], n_epochs).withColumn("pair_id", F.col("agg_id"))
    columns = [*KEYS, "roi", "epoch", "cnt"]
    groups = sampling.members(train).select(*KEYS).distinct().unionByName(others.withColumn("pair_id", F.col("agg_id")).select(*KEYS).distinct())
    return groups, pairs.select(*columns).unionByName(singles.select(*columns))


def target_cells(cells: DataFrame, groups: DataFrame) -> DataFrame:
    """(target, roi, epoch): the traces of the bundle's targets. Repeats of cells, as in visits, are left in."""
    chosen = groups.select("target").distinct()
    return chosen.join(cells, chosen["target"] == cells["user_id"]).select("target", "roi", "epoch")
