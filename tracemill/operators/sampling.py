"""Targets, references and groups of users, drawn without replacement: exact sizes, the same on every run and any cluster.

Users are numbered from 0. For each target, a keyed permutation of the other users' numbers deals them out: the first ones are its
reference, the rest its test pool, both as a range of places, so neither is written down. A group's members are the first
places of a permutation of its own over such a range. Each is worked out by itself and joined to the table of users: the rows made
are the members, whatever the number of users. A pool that has fewer users than a group needs raises.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import uniform
from ..functions.permute import permuted
from ..stages import keep
from .prep import dense_index


def _lowest(df: DataFrame, by: list[str], n: Column | int, order: str = "_u") -> DataFrame:
    """Rows with their rank `_rank` by the draw within `by`, the first n of each."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*by).orderBy(order, "user_id"))).where(F.col("_rank") <= n)


def targets(sizes: DataFrame, n: int, min_visits: int = 10, seed: int = 42) -> DataFrame:
    """n users with at least min_visits visited cells, as (target)."""
    fit = sizes.where(F.col("n_visits") >= min_visits).withColumn("_u", uniform("target", seed, F.col("user_id")))
    return fit.orderBy("_u", "user_id").limit(n).select(F.col("user_id").alias("target"))


def targets_by_stratum(strata: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n users of each stratum of strata(user_id, block), as (target, block)."""
    drawn = strata.withColumn("_u", uniform("stratum", seed, F.col("user_id")))
    return _lowest(drawn, ["block"], n).select(F.col("user_id").alias("target"), "block")


#: Members that a task draws, and that a row is made into.
TASK, ROW = 65_536, 1024


@dataclass(frozen=True)
class Dealt:
    """For each target of `targets` (target, number), the users other than it at places first..first+size-1 of its permutation."""

    targets: DataFrame
    users: DataFrame
    n_users: int
    first: int
    size: int
    seed: int

    def sizes(self) -> DataFrame:
        """(target, size)"""
        return self.targets.select("target", F.lit(self.size).cast("long").alias("size"))

    def at(self, asked: DataFrame) -> DataFrame:
        """asked(target, place and others), places from 0 within the range, with the user_id there in place of `place`."""
        numbered = asked.join(F.broadcast(self.targets), "target")  # a stated set
        other = permuted(F.col("place") + self.first, max(1, self.n_users - 1), "others", self.seed, F.col("target"))
        # the target's own number is left out of the count
        found = numbered.withColumn("_other", other).withColumn("number", F.col("_other") + (F.col("_other") >= F.col("_number")).cast("long"))
        return found.join(self.users, "number").drop("number", "_number", "_other", "place")

    def listed(self) -> DataFrame:
        """(target, user_id): all of them."""
        if not self.size:
            return self.targets.join(self.users).select("target", "user_id").limit(0)
        return self.at(self.targets.select("target").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.size - 1).cast("long"))))).select("target", "user_id")


class Listed:
    """A pool given by its rows pool(target, user_id); the target itself is not drawn from it."""

    def __init__(self, pool: DataFrame) -> None:
        others = pool.where(F.col("user_id") != F.col("target")).select("target", "user_id")
        self._heads = pool.select("target").distinct()
        self._others = keep(dense_index(others, "target", "user_id", name="_nth"))
        self._sizes = self._others.groupBy("target").agg(F.count("*").alias("size"), F.min("_nth").alias("_first"))

    def sizes(self) -> DataFrame:
        return self._heads.join(self._sizes, "target", "left").select("target", F.coalesce("size", F.lit(0).cast("long")).alias("size"))

    def at(self, asked: DataFrame) -> DataFrame:
        placed = asked.join(self._sizes.select("target", "_first"), "target").withColumn("_nth", F.col("place") + F.col("_first"))
        return placed.join(self._others.select("_nth", "user_id"), "_nth").drop("_nth", "_first", "place")


@dataclass(frozen=True)
class Synthetic:
    """Users -1..-size of each target of heads(target), as synthesis makes them, also those without a visit."""

    heads: DataFrame
    size: int

    def sizes(self) -> DataFrame:
        return self.heads.select("target", F.lit(self.size).cast("long").alias("size"))

    def at(self, asked: DataFrame) -> DataFrame:
        return asked.withColumn("user_id", -F.col("place") - 1).drop("place")


Pool = Dealt | Listed | Synthetic


def numbered(users: DataFrame) -> tuple[DataFrame, int]:
    """((user_id, number) in the order of ids, how many): the table that draws are joined with."""
    table = keep(dense_index(users.select("user_id").distinct(), "user_id", name="number"))
    return table, table.count()


def everyone(targets: DataFrame, users: DataFrame, seed: int = 42) -> Dealt:
    """All users but the target, as each target's pool."""
    return reference(targets, users, 0, seed)[1]


def reference(targets: DataFrame, users: DataFrame, size: int, seed: int = 42) -> tuple[Dealt, Dealt]:
    """(reference, test pool) of each target: the reference has `size` users, of whom the target is one and not listed here; the rest is the pool.

    Without a reference (size 0) all others are the pool. More than there are users raises.
    """
    table, n = numbered(users)
    if size > n:
        raise ValueError(f"a reference of {size} of {n} users")
    own = keep(targets.select(F.col("target").alias("user_id")).join(table, "user_id").select(F.col("user_id").alias("target"), F.col("number").alias("_number")))
    taken = max(0, size - 1)
    return Dealt(own, table, n, 0, taken, seed), Dealt(own, table, n, taken, max(0, n - 1 - taken), seed)


def reference_static(users: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """One reference for all targets, as (user_id)."""
    return users.select("user_id").withColumn("_u", uniform("static", seed, F.col("user_id"))).orderBy("_u", "user_id").limit(size).select("user_id")


def include_target(static: DataFrame, targets: DataFrame, seed: int = 42) -> DataFrame:
    """(target, user_id): the static reference with each target in it.

    A target that isn't in takes the place of a random real user (id above zero); with only synthetic ones it is added.
    """
    own = static.crossJoin(F.broadcast(targets.select("target")))
    own = own.withColumn("_u", F.when(F.col("user_id") > 0, uniform("evict", seed, F.col("target"), F.col("user_id"))))
    there = own.groupBy("target").agg(F.max(F.col("user_id") == F.col("target")).alias("_there"), F.min_by(F.when(F.col("_u").isNotNull(), F.col("user_id")), F.struct(F.coalesce("_u", F.lit(2.0)), "user_id")).alias("_out"))
    left = own.join(F.broadcast(there), "target").where(F.col("_there") | F.col("_out").isNull() | (F.col("user_id") != F.col("_out"))).select("target", "user_id")
    return left.unionByName(there.where(~F.col("_there")).select("target", F.col("target").alias("user_id")))


def _drawn(pool: Pool | DataFrame, split: str, group: str, n_groups: int, size: int, seed: int) -> DataFrame:
    """(target, group, nth, user_id): `size` different users of the pool for each of n_groups groups of each target, nth from 0.

    Rows of targets are few and small, and would all be in one task: they are dealt out before members are made of them.
    """
    pool = Listed(pool) if isinstance(pool, DataFrame) else pool
    short = pool.sizes().where(F.col("size") < size).orderBy("target").limit(5).collect()
    if short:
        raise ValueError(f"groups need {size} users besides the target; pools of {split} have {[(r['target'], r['size']) for r in short]}")
    tasks = max(1, -(-pool.sizes().count() * n_groups * size // TASK))
    heads = pool.sizes().withColumn(group, F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    parts = heads.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit((size - 1) // ROW)))).repartition(tasks, "target", group, "_part")
    asked = parts.withColumn("nth", F.explode(F.sequence(F.col("_part") * ROW, F.least(F.col("_part") * ROW + (ROW - 1), F.lit(size - 1)))))
    return pool.at(asked.select("target", group, "nth", permuted(F.col("nth"), F.col("size"), split, seed, F.col("target"), F.col(group)).alias("place")))


def groups_paired(pool: Pool | DataFrame, split: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """Members of n/2 pairs of groups for each target of a pool, or of pool(target, user_id): (target, split, pair_id, role, user_id).

    Both groups of a pair have its `common` members; IN also has the target (role `in`), OUT another user (role `out`). A pool of
    fewer than `size` users besides the target raises.
    """
    if n % 2:
        raise ValueError("pairs need an even number of groups")
    drawn = _drawn(pool, split, "pair", n // 2, size, seed)
    pair_id = F.concat_ws("-", "target", F.lit(split), "pair").alias("pair_id")
    return drawn.select("target", F.lit(split).alias("split"), pair_id, F.explode(
        F.when(F.col("nth") < size - 1, F.array(F.struct(F.lit("common").alias("role"), "user_id")))
        .otherwise(F.array(F.struct(F.lit("out").alias("role"), "user_id"), F.struct(F.lit("in").alias("role"), F.col("target").alias("user_id"))))
    ).alias("_m")).select("target", "split", "pair_id", "_m.role", "_m.user_id")


def groups(pool: Pool | DataFrame, split: str, size: int, n: int, seed: int = 42) -> DataFrame:
    """Members of n independent groups for each target, half with it: (target, split, agg_id, label, user_id).

    A pool of fewer than `size` users besides the target raises.
    """
    if n % 2:
        raise ValueError("half of the groups have the target, so their number is even")
    agg_id, label = F.concat_ws("-", "target", F.lit(split), "grp").alias("agg_id"), (F.col("grp") < n // 2).cast("int").alias("label")
    drawn = _drawn(pool, split, "grp", n, size, seed)
    user = F.when((F.col("grp") < n // 2) & (F.col("nth") == size - 1), F.col("target")).otherwise(F.col("user_id"))  # the target is the last of its groups
    return drawn.select("target", F.lit(split).alias("split"), agg_id, label, user.alias("user_id"))


def members(paired: DataFrame) -> DataFrame:
    """groups_paired rows as plain membership: (target, split, pair_id, agg_id, label, user_id)."""
    labels = F.when(F.col("role") == "common", F.array(F.lit(1), F.lit(0))).when(F.col("role") == "in", F.array(F.lit(1))).otherwise(F.array(F.lit(0)))
    out = paired.withColumn("label", F.explode(labels))
    return out.select("target", "split", "pair_id", F.concat_ws("-", "pair_id", "label").alias("agg_id"), "label", "user_id")


def subsample(aggregates: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n aggregates of each target and label of (target, label, agg_id)."""
    drawn = aggregates.select("target", "label", "agg_id").distinct().withColumn("_u", uniform("sub", seed, F.col("agg_id")))
    rank = F.row_number().over(Window.partitionBy("target", "label").orderBy("_u", "agg_id"))
    return drawn.withColumn("_rank", rank).where(F.col("_rank") <= n).select("target", "label", "agg_id")


def first_pairs(aggregates: DataFrame, n: int) -> DataFrame:
    """The first n aggregates of each target and label by pair, so pairs stay whole."""
    rank = F.row_number().over(Window.partitionBy("target", "label").orderBy("pair_id"))
    return aggregates.select("target", "label", "pair_id", "agg_id").distinct().withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
