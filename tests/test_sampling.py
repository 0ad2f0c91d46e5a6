"""Groups by keyed permutations: exact sizes, uniform draws, no row that is not a member."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.config import BuildConfig
from tracemill.functions import permute
from tracemill.operators import sampling
from tracemill.plans import build


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 3000), st.lists(st.integers(0, 4095), min_size=8, max_size=8))
def test_permutations_have_every_value_once(n, keys):
    got = permute.values(np.arange(n), np.full(n, n), np.tile(np.array(keys), (n, 1)))
    assert sorted(got.tolist()) == list(range(n))


def test_permutations_of_large_ranges_stay_inside():
    n = np.array([2**53 - 1, 10**12, 1, 2] * 50)
    place = np.array([2**53 - 2, 10**12 - 1, 0, 1] * 50)
    got = permute.values(place, n, np.random.default_rng(1).integers(0, 4096, (200, 8)))
    assert ((0 <= got) & (got < n)).all() and len(set(got[::4].tolist())) > 40


def test_pairs_of_places_are_uniform(spark):
    """Over 8,000 keys all 42 ordered pairs of the first two of seven come up about equally often."""
    df = spark.range(8400).select(*(permute.permuted(F.lit(k), 7, "x", F.col("id")).alias(f"p{k}") for k in (0, 1)))
    found = Counter((r.p0, r.p1) for r in df.collect())
    assert len(found) == 42 and sum((n - 200) ** 2 / 200 for n in found.values()) < 90


@pytest.fixture(scope="module")
def users(spark):
    return spark.range(1, 201).select((F.col("id") * 10).alias("user_id"))


def test_reference_and_pool_part_the_others(spark, users):
    t = spark.createDataFrame([(10,), (1000,), (2000,)], "target long")
    inside, rest = sampling.reference(t, users, 30)
    of = lambda df, target: {r.user_id for r in df.where(F.col("target") == target).collect()}
    for target in (10, 1000, 2000):
        a, b = of(inside.listed(), target), of(rest.listed(), target)
        assert len(a) == 29 and len(b) == 170 and not a & b and a | b == {10 * k for k in range(1, 201)} - {target}
    assert of(inside.listed(), 10) != of(inside.listed(), 1000)
    nobody, all_others = sampling.reference(t, users, 0)
    assert nobody.listed().count() == 0 and all_others.listed().count() == 3 * 199
    with pytest.raises(ValueError):
        sampling.reference(t, users, 201)


def test_groups_have_exact_sizes_or_raise(spark, users):
    t = spark.createDataFrame([(10,), (20,)], "target long")
    inside, rest = sampling.reference(t, users, 9)  # pools of 8 and 191 besides the target
    for r in sampling.groups(inside, "validation", 8, 6).groupBy("target", "agg_id", "label").agg(F.count_distinct("user_id").alias("n"), F.max((F.col("user_id") == F.col("target")).cast("int")).alias("has")).collect():
        assert (r.n, r.has) == (8, r.label)
    assert sampling.groups(rest, "test", 100, 4).groupBy("agg_id").agg(F.count_distinct("user_id").alias("n")).where("n = 100").count() == 8
    pairs = sampling.members(sampling.groups_paired(inside, "train", 8, 4)).groupBy("pair_id", "label").agg(F.collect_set("user_id").alias("u"), F.first("target").alias("t")).collect()
    by = {(r.pair_id, r.label): (set(r.u), r.t) for r in pairs}
    for (pair, label), (members, target) in by.items():
        assert len(members) == 8 and (target in members) == (label == 1) and len(members & by[pair, 1 - label][0]) == 7
    for pool in (inside, inside.listed(), sampling.Synthetic(t, 8)):
        with pytest.raises(ValueError, match="8"):
            sampling.groups(pool, "test", 9, 2)
        with pytest.raises(ValueError, match="8"):
            sampling.groups_paired(pool, "train", 9, 2)
    with pytest.raises(ValueError):
        sampling.groups(t.select("target", F.col("target").alias("user_id")), "test", 1, 2)  # nobody but the target
    assert {r.user_id for r in sampling.groups(sampling.Synthetic(t, 8), "test", 8, 2).where("label = 0").collect()} == set(range(-8, 0))


def test_listed_pools_draw_from_their_rows_only(spark):
    rows = [(1, u) for u in range(1, 21)] + [(2, u) for u in range(2, 13)]
    pool = spark.createDataFrame(rows, "target long, user_id long")
    got = sampling.groups(pool.repartition(5), "test", 9, 8)
    assert got.join(pool, ["target", "user_id"], "left_anti").count() == 0
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, sampling.groups(pool, "test", 9, 8).collect()))
    assert {r["count"] for r in got.groupBy("agg_id").count().collect()} == {9}


def test_members_alone_are_made(spark):
    """50 targets and 12 groups of each over a million users: as many rows leave the draws as there are members."""
    many = spark.range(1, 1_000_001).select(F.col("id").alias("user_id"))
    t = many.where("user_id % 20000 = 0").select(F.col("user_id").alias("target"))
    _, rest = sampling.reference(t, many, 2500)
    got = sampling.groups(rest, "test", 100, 12)
    assert "CartesianProduct" not in got._jdf.queryExecution().toString() and "BroadcastNestedLoopJoin" not in got._jdf.queryExecution().toString()
    assert got.count() == 50 * 12 * 100 and got.select("agg_id", "user_id").distinct().count() == 50 * 12 * 100


def test_a_bundle_from_too_few_users_raises(spark):
    cells = spark.range(40).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("roi")).withColumn("epoch", F.lit(0))
    with pytest.raises(ValueError):
        build.bundle(cells, BuildConfig(group_size=20, n_targets=1, min_visits=10, reference_size=30, train=2, test=2, validation=2, seed=1))
    groups, _ = build.bundle(cells, BuildConfig(group_size=10, n_targets=1, min_visits=10, reference_size=20, train=2, test=2, validation=2, seed=1))
    assert groups.count() == 6


def test_few_targets_are_dealt_out_before_members_are_made(spark):
    """Rows of targets are few and would be in one task; a bundle's groups are read from what was drawn, not drawn again."""
    heads = spark.range(1, 4).select(F.col("id").alias("target")).coalesce(1)
    got = sampling.groups(sampling.Synthetic(heads, 6000), "test", 5000, 20)
    assert got.select("agg_id", "user_id").distinct().count() == 3 * 20 * 5000
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    cells = spark.range(40).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("roi")).withColumn("epoch", F.lit(0))
    config = BuildConfig(group_size=10, n_targets=1, min_visits=10, reference_size=20, train=2, test=2, validation=2, seed=1)
    groups, counts = build.bundle(cells.unionByName(cells), config)  # repeats count once
    assert "ArrowEvalPython" not in groups._jdf.queryExecution().toString()
    assert {r.cnt for r in counts.collect()} == {10}
