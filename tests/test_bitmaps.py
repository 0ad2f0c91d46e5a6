"""Group counts from bitmaps are those of a join of members and cells."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill.operators import bitmaps


def plain(members, cells, keys):
    """Members exploded into cells."""
    return sorted(map(tuple, members.join(cells, "user_id").groupBy(*keys, "roi", "epoch").agg(F.count("*").alias("cnt")).select(*keys, "roi", "epoch", "cnt").collect()))


def found(members, cells, keys, n_epochs, **options):
    return sorted(map(tuple, bitmaps.group_counts(members, bitmaps.of_traces(cells, n_epochs), keys, n_epochs, **options).select(*keys, "roi", "epoch", "cnt").collect()))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, bitmaps.CHUNK - 1), max_size=40), max_size=12))
def test_counters_count(rows):
    """Places, bitmaps and sums of counters, packed and unpacked, give the same counts."""
    want = np.bincount([p for r in rows for p in set(r)], minlength=bitmaps.CHUNK)
    a, b, c = bitmaps.Counters(), bitmaps.Counters(), bitmaps.Counters()
    for k, r in enumerate(rows):
        own = np.array(sorted(set(r)), dtype=np.uint16)
        a.add_places(own)
        bits = np.zeros(bitmaps.CHUNK, dtype=bool)
        bits[own] = True
        (b if k % 2 else c).carry(np.packbits(bits, bitorder="little").view(np.uint64))
    b.add(bitmaps.Counters.of(c.packed()))
    for x in (a, b, bitmaps.Counters.of(b.packed())):
        places, counts = x.counts()
        assert places.tolist() == np.flatnonzero(want).tolist() and counts.tolist() == want[want > 0].tolist()


def test_dense_counters_are_packed_as_planes():
    x = bitmaps.Counters()
    for _ in range(5):
        x.carry(np.full(bitmaps.CHUNK // 64, 2**64 - 1, dtype=np.uint64))
    packed = x.packed()
    assert packed[:1] == b"b" and len(packed) == 1 + 3 * bitmaps.CHUNK // 8
    assert set(bitmaps.Counters.of(packed).counts()[1].tolist()) == {5}


@pytest.mark.parametrize("part", [3, 4096])
def test_group_counts(spark, part):
    """Light and heavy users, several chunks, repeated members, groups without cells, string and whole-number keys."""
    light = spark.range(60).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("k")).select("user_id", ((F.col("user_id") * 7 + F.col("k") * 131) % 500).cast("int").alias("roi"), ((F.col("user_id") * F.col("k")) % 700).cast("int").alias("epoch")).distinct()
    heavy = spark.range(9000).select(F.lit(100).cast("long").alias("user_id"), (F.col("id") % 90).cast("int").alias("roi"), F.floor(F.col("id") / 90).cast("int").alias("epoch"))
    cells = light.unionByName(heavy)
    rows = [(f"g{g}", g % 2, u) for g in range(4) for u in range(g * 5, g * 5 + 20)] + [("g0", 0, 100), ("g0", 0, 100), ("g1", 1, 100), ("none", 0, 999)]
    members = spark.createDataFrame(rows, "agg_id string, label int, user_id long")
    assert found(members, cells, ["agg_id", "label"], 700, part=part) == plain(members, cells, ["agg_id", "label"])
    assert found(members.limit(0), cells, ["agg_id"], 700) == [] == found(members, cells.limit(0), ["agg_id"], 700)
    with pytest.raises(TypeError):
        bitmaps.group_counts(members.withColumn("x", F.lit(0.5)), cells, ["x"], 700)


def test_a_member_is_a_row_of_the_shuffle(spark):
    cells = spark.range(50).select(F.col("id").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(199))).alias("roi")).withColumn("epoch", F.lit(0))
    traces = bitmaps.of_traces(cells, 1)
    assert traces.count() == 50 and traces.agg(F.max(F.length("bits"))).first()[0] == 400


def test_counts_are_added_and_opened_in_one_worker(spark):
    """A task of the last step has one Python worker and not two: packing, adding parts, adding parts and opening are all."""
    cells = spark.createDataFrame([(1, 0, 0), (2, 1, 3)], "user_id long, roi int, epoch int")
    counted = bitmaps.group_counts(spark.createDataFrame([("a", 1), ("a", 2)], "agg_id string, user_id long"), bitmaps.of_traces(cells, 4), ["agg_id"], 4)
    plan = counted._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 3
    assert sorted(map(tuple, counted.collect())) == [("a", 0, 0, 1), ("a", 1, 3, 1)]
