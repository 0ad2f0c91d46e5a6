"""Clusters grown by joins: connected, of exact size where a component has the room, uniform in what they take."""

from collections import Counter

from pyspark.sql import functions as F

from tracemill.operators import growth


def grid(spark, side, offset=0):
    ids = spark.range(side * side).select((F.col("id") + offset).cast("int").alias("roi"), (F.col("id") % side).alias("x"))
    right = ids.where(f"x < {side - 1}").select("roi", (F.col("roi") + 1).alias("nbr"))
    down = ids.where(f"roi - {offset} < {side * (side - 1)}").select("roi", (F.col("roi") + side).alias("nbr"))
    return right.unionByName(down)


def test_components_of_chains_grids_and_stars(spark):
    chain = spark.range(1000, 1200).select(F.col("id").cast("int").alias("roi"), (F.col("id") + 1).cast("int").alias("nbr"))
    star = spark.range(2001, 2100).select(F.col("id").cast("int").alias("roi"), F.lit(2000).alias("nbr"))
    loop = spark.createDataFrame([(5000, 5000)], "roi int, nbr int")
    got = growth.components(grid(spark, 6).unionByName(chain).unionByName(star).unionByName(loop)).collect()
    assert Counter((r.root, r["size"]) for r in got) == {(0, 36): 36, (1000, 201): 201, (2000, 100): 100}


def test_clusters_are_connected_and_exact(spark):
    edges = grid(spark, 8).unionByName(grid(spark, 2, 100)).unionByName(spark.createDataFrame([(200, 201)], "roi int, nbr int"))
    near = {(r.roi, r.nbr) for r in growth.both_ways(edges).collect()}
    starts = spark.range(300).select(F.col("id").alias("user_id"), (F.col("id") % 64).cast("int").alias("start"))
    lost = spark.createDataFrame([(1000 + k, s) for k, s in enumerate((100, 103, 200, 999, None))], "user_id long, start int")  # too small, unknown, null
    out = growth.clusters(starts.unionByName(lost), edges, 15, seed=3).collect()
    assert len(out) == 305 and len({r.user_id for r in out}) == 305
    for r in out:
        assert len(set(r.cluster)) == 15 and set(r.cluster) <= set(range(64))
        assert all(any((a, b) in near for a in r.cluster[:k]) for k, b in enumerate(r.cluster) if k)
        assert r.user_id >= 1000 or r.cluster[0] == r.user_id % 64
    again = growth.clusters(starts.repartition(7).unionByName(lost), growth.Neighbours.of(edges.repartition(3)), 15, seed=3).collect()
    assert sorted(map(tuple, out), key=str) == sorted(map(tuple, again), key=str)


def test_larger_than_every_component(spark):
    edges = grid(spark, 2).unionByName(spark.createDataFrame([(10, 11)], "roi int, nbr int"))
    starts = spark.createDataFrame([(1, 0), (2, 10)], "k long, start int")
    assert [sorted(r.cluster) for r in growth.clusters(starts, edges, 50).orderBy("k").collect()] == [[0, 1, 2, 3]] * 2
    alone = growth.clusters(starts, edges.limit(0), 5).orderBy("k").collect()
    assert [r.cluster for r in alone] == [[0], [10]]
    assert growth.clusters(starts.limit(0), edges, 5).count() == 0


def test_each_of_the_frontier_is_as_likely(spark):
    """From the middle of a star of six arms the second ROI is any arm's, and the third any other arm's or the next of the second's."""
    edges = spark.createDataFrame([(0, k) for k in range(1, 7)] + [(k, k + 10) for k in range(1, 7)], "roi int, nbr int")
    starts = spark.range(4200).select(F.col("id").alias("k"), F.lit(0).alias("start"))
    out = growth.clusters(starts, edges, 3).collect()
    second = Counter(r.cluster[1] for r in out)
    assert set(second) == set(range(1, 7)) and sum((n - 700) ** 2 / 700 for n in second.values()) < 25
    onward = sum(r.cluster[2] == r.cluster[1] + 10 for r in out)
    assert abs(onward - 700) < 5 * (700 * 5 / 6) ** 0.5


def test_many_steps_are_written_in_between(spark, monkeypatch):
    monkeypatch.setattr(growth, "WRITTEN", 3)
    out = growth.clusters(spark.createDataFrame([(1, 0)], "k long, start int"), grid(spark, 5), 20).first()
    assert len(set(out.cluster)) == 20
