"""Hand-checked cases and invariants of the operators."""

import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracemill import config, schema
from tracemill.functions import draws
from tracemill.functions.spatial import Box
from tracemill.functions.temporal import epoch
from tracemill.operators import adjacency, aggregates, classify, marginals, metrics, partial, prep, privacy, rules, sampling
from tracemill.sources import readers, sinks
from tracemill.streaming import release


def test_epochs(spark):
    start = 1383284733
    df = spark.createDataFrame([(start,), (1383285600,), (1383289200,)], "ts long")
    assert [r[0] for r in df.select(epoch(F.col("ts"), start, 3600)).collect()] == [0, 0, 1]
    assert [r[0] for r in df.select(epoch(F.col("ts"), start, 3600, align=True)).collect()] == [0, 1, 2]


def test_grid_of_named_region(spark):
    box = Box(*config.region("Milano"), 1.6)
    n, columns = spark.range(1).select(box.n_cells(), box.n_columns()).first()
    assert (n, columns) == (100, 9)
    places = box.centroids(spark, 100).collect()
    assert all(box.min_lon < r.lon < box.max_lon and box.min_lat < r.lat < box.max_lat for r in places)
    with pytest.raises(ValueError):
        config.region("Atlantis")


def test_release(spark):
    c = spark.createDataFrame([("a", 0, e, n) for e, n in enumerate((1, 2, 3))], "agg_id string, roi int, epoch int, cnt long")
    assert {r.cnt for r in privacy.suppress(c, 2).collect()} == {3}
    values = spark.range(1).select(privacy.noisy_counts(F.lit(3), F.lit(0.99999), 1.0, 5), privacy.noisy_counts(F.lit(3), F.lit(0.00001), 1.0, 5)).first()
    assert tuple(values) == (5, 0)
    out = privacy.release(c, c, ["agg_id"], ["agg_id"], 2, 4, 5, 0.5, 1.0, k=1).collect()
    assert all(1 < r.cnt <= 5 for r in out)
    assert privacy.release(c, c, ["agg_id"], ["agg_id"], 2, 4, 5, eps=0.5).count() == 3


def test_rule(spark):
    groups = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z")], "target long, agg_id string")
    counts = spark.createDataFrame([(1, "x", 0, 1, 1), (1, "y", 0, 0, 1), (1, "y", 0, 1, 2), (2, "z", 0, 0, 3)], "target long, agg_id string, roi int, epoch int, cnt long")
    cells = spark.createDataFrame([(1, 0, 0)], "target long, roi int, epoch int")
    assert {(r.agg_id, r.contradiction) for r in rules.contradicted(groups, counts, cells, 3).collect()} == {("x", True), ("y", False), ("z", True)}


def test_partial_and_blocks(spark):
    cells = spark.createDataFrame([(1, r, 0) for r in range(10)], "target long, roi int, epoch int")
    assert partial.random_part(cells, 0.25).count() == 3
    assert partial.known(cells, None, 5).count() == 10
    with pytest.raises(ValueError):
        partial.known(cells, "nothing", 5)
    users = spark.createDataFrame([(u, 0, e) for u in range(10) for e in range(u + 1)], "user_id long, roi int, epoch int")
    assert sorted(r["count"] for r in prep.size_blocks(users, 3).groupBy("block").count().collect()) == [2, 4, 4]


def test_metrics(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.1), (2, 1, 0.5), (2, 0, 0.5)], "target long, y int, p double")
    assert {r.target: r.auc for r in metrics.auc(df, ["target"]).collect()} == {1: 1.0, 2: 0.5}
    assert {r.target: r.thr for r in metrics.youden(df, ["target"]).collect()} == {1: 0.9, 2: math.inf}


@settings(max_examples=50, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.integers(0, 9)), min_size=2, max_size=40))
def test_youden_in_numpy(data):
    y, p = np.array([a for a, _ in data], int), np.array([b for _, b in data]) / 10
    thr = classify.youden_threshold(y, p)
    if len(set(y)) == 2:
        def j(t):
            return (p[y == 1] >= t).mean() - (p[y == 0] >= t).mean()
        best = max(j(t) for t in [*set(p), math.inf])
        assert j(thr) == pytest.approx(best)


def test_log_compression(spark):
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 1, 0.25), ("a", 2, 0.75)], "k string, roi int, p double")
    got = {r.roi: r.p for r in marginals.log_compressed(df, ["k"]).collect()}
    assert got[0] == 0 and got[1] == pytest.approx(1 / 3) and got[2] == pytest.approx(2 / 3)


def test_pairs(spark):
    cells = spark.createDataFrame([(u, u % 3, e) for u in range(1, 13) for e in range(u % 4 + 1)], "user_id long, roi int, epoch int")
    pool = cells.select("user_id").distinct().crossJoin(spark.createDataFrame([(1,), (2,)], "target long"))
    paired = sampling.groups_paired(pool, "train", 4, 6)
    members = {}
    for r in sampling.members(paired).collect():
        members.setdefault((r.target, r.pair_id, r.label), []).append(r.user_id)
    assert len(members) == 12
    for (target, pair, label), users in members.items():
        assert len(users) == len(set(users)) == 4 and (target in users) == bool(label)
        assert label or len(set(users) & set(members[target, pair, 1])) == 3
    counts = aggregates.pair_counts(paired, cells).groupBy("target", "pair_id", "label").agg(F.sum("cnt").alias("n")).collect()
    size = {r.user_id: r.n_visits for r in prep.sizes(cells).collect()}
    assert all(r.n == sum(size[u] for u in members[r.target, r.pair_id, r.label]) for r in counts)
    again = sampling.members(sampling.groups_paired(pool.repartition(7), "train", 4, 6))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, sampling.members(paired).collect()))
    with pytest.raises(ValueError):
        sampling.groups_paired(pool, "train", 4, 5)


def test_include_target(spark):
    static = spark.createDataFrame([(5,), (6,)], "user_id long")
    t = spark.createDataFrame([(5,), (9,)], "target long")
    got = {}
    for r in sampling.include_target(static, t).collect():
        got.setdefault(r.target, set()).add(r.user_id)
    assert got[5] == {5, 6} and 9 in got[9] and len(got[9]) == 2
    fake = spark.createDataFrame([(-1,), (-2,)], "user_id long")
    assert {r.user_id for r in sampling.include_target(fake, t.where("target = 9")).collect()} == {-1, -2, 9}


def test_shared_places_are_neighbours(spark):
    roi_map = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0)], "roi int, lon double, lat double")
    near = {(r.roi, r.nbr) for r in adjacency.neighbours(roi_map).collect()}
    assert {(0, 1), (1, 0), (0, 2), (1, 2), (2, 1), (2, 3)} <= near


def test_config():
    c = config.AuditConfig(suppress=2).coupled()
    assert c.log_compression and c.rf_trees is None and c.partial_fraction is None and not c.power_transform
    c = config.AuditConfig(suppress=2, dp_eps=1.0).coupled()
    assert not c.log_compression and c.power_transform and not c.noisy
    assert len(config.sweep(config.AuditConfig(), "suppression")) == 6
    assert config.to_bool("True") and not config.to_bool("False")
    for bad in (lambda: config.AuditConfig(mode="x"), lambda: config.AuditConfig(partial="x"), lambda: config.AuditConfig(classifier="x"), lambda: config.AuditConfig(suppress=-1), lambda: config.BuildConfig(train=3), lambda: config.to_bool("yes")):
        with pytest.raises(ValueError):
            bad()


def test_schema(spark):
    roi_map = spark.createDataFrame([(0, 1.0, 2.0)], schema.ROI_MAP)
    good = spark.createDataFrame([(1, 5, 0)], "user_id long, ts long, roi int")
    schema.check(good, roi_map)
    bad = spark.createDataFrame([(2, 5.0, 7)], "user_id long, ts double, roi int")
    assert len(schema.problems(bad, roi_map)) == 3
    with pytest.raises(schema.FormatError):
        schema.check(bad, roi_map)


def test_sources_and_sinks(spark, tmp_path):
    point = {"user": "u", "timestamp": 5, "geomPoint.geom": {"type": "Point", "coordinates": [9.0, 45.0, 1.0]}}
    line = point | {"geomPoint.geom": {"type": "LineString", "coordinates": [9.0, 45.0]}}
    short = point | {"geomPoint.geom": {"type": "Point", "coordinates": [9.0]}}
    (tmp_path / "p.json").write_text(json.dumps({"type": "FeatureCollection", "features": [point, line, short]}, indent=1))
    assert [tuple(r) for r in readers.geojson(spark, str(tmp_path / "p.json")).collect()] == [("u", 5, 9.0, 45.0)]
    assert [tuple(r) for r in readers.geojson(spark, str(tmp_path / "p.json"), cut=False).collect()] == [("u", 5, 9.0, 45.0)]
    (tmp_path / "p.jsonl").write_text("\n".join(map(json.dumps, [point, line, short])))
    assert [tuple(r) for r in readers.geojson(spark, str(tmp_path / "p.jsonl"), lines=True).collect()] == [("u", 5, 9.0, 45.0)]
    (tmp_path / "s.csv").write_text("site_id,arr_id,lon,lat\n1,2,9.0,45.0\n8,2,9.1,45.0\n")
    assert readers.sites(spark, str(tmp_path / "s.csv"), 5).count() == 1
    scores = spark.createDataFrame([(1, 0.5, 0.75)], "target long, acc double, auc double")
    predictions = spark.createDataFrame([(1, "a", 1)], "target long, agg_id string, y int")
    out, meta = str(tmp_path / "out"), sinks.run_meta(spark, config.AuditConfig())
    ids = {sinks.results(scores, predictions, m, out) for m in (meta, sinks.run_meta(spark, config.AuditConfig()))}
    assert {r.run_id for r in readers.runs(spark, out, "scores").collect()} == ids == {r.run_id for r in readers.runs(spark, out, "settings").collect()} and len(ids) == 2
    with pytest.raises(FileExistsError):
        sinks.results(scores.limit(0), predictions, meta, out)
    broken = predictions.withColumn("y", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        sinks.results(scores, broken, sinks.run_meta(spark, config.AuditConfig(), "third"), out)
    assert {r.run_id for r in readers.runs(spark, out, "scores").collect()} == ids and not (tmp_path / "out/third").exists()
    assert sinks.summary(scores).first()["mean_auc"] == 0.75


def test_published_windows_and_neighbours_of_a_place(spark, tmp_path):
    rows = [(datetime(2024, 1, 1) + timedelta(hours=k // 3), k % 2) for k in range(30)]
    spark.createDataFrame(rows, "ts timestamp, roi int").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, roi int").parquet(str(tmp_path / "in"))
    q = release.publish(release.windowed(stream, "1 hour", 0, "0 seconds"), str(tmp_path / "out"), str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert 0 < out.count() == out.distinct().count() and out.columns == ["day", "roi", "cnt"]
    near = spark.createDataFrame([(0, 1), (0, 2), (1, 0)], schema.ROI_ADJ)
    assert sorted(r.nbr for r in adjacency.of_roi(near, 0).collect()) == [1, 2]


def test_stream(spark, tmp_path):
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=20 * k), k % 2) for k in range(30)]
    spark.createDataFrame(rows, "user_id long, ts timestamp, roi int").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = release.windowed(stream, "1 hour", 1).writeStream.format("memory").queryName("released").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("released").collect())) == sorted(map(tuple, release.windowed(batch, "1 hour", 1).collect()))
    assert release.sessions(batch.withColumn("user_id", F.lit(1)), "30 minutes").count() == 1


def test_draws_do_not_depend_on_partitions(spark):
    df = spark.range(200).select("id", draws.uniform("x", F.col("id")).alias("u"))
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, df.repartition(13).collect()))
    values = [r.u for r in df.collect()]
    assert 0 < min(values) and max(values) < 1 and abs(sum(values) / 200 - 0.5) < 0.1
    assert abs(spark.range(4000).select(F.avg(draws.normal(draws.uniform("n", F.col("id")), draws.uniform("m", F.col("id"))))).first()[0]) < 0.1


def test_dense_index(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"))
    got = prep.dense_index(df.repartition(9), "v").collect()
    assert all(r.v == r.idx for r in got) and len(got) == 1000


def test_draws_by_an_interval_index(spark):
    """As a search in the distribution function, with zero shares, one value, many keys; each draw once; two intervals a draw on average."""
    from tracemill.operators import synthesis

    rng = np.random.default_rng(8)
    shares, rows = {}, []
    for key, n in (("a", 1), ("b", 7), ("c", 400)):
        p = rng.random(n) ** 6 * (rng.random(n) < 0.6) + (np.arange(n) == 0) * 1e-3
        shares[key] = p / p.sum()
        rows += [(key, i, float(x)) for i, x in enumerate(shares[key])]
    df = spark.createDataFrame(rows, "k string, v int, p double")
    asked = [(k, i, float(x)) for k in "abc" for i, x in enumerate([0.0, 1e-12, 1 - 1e-12, *rng.random(300)])] + [("none", 0, 0.5)]
    draws_ = spark.createDataFrame(asked, "k string, i int, u double")
    table = synthesis.cumulative(df, "v", ["k"])
    ends = {k: [(r.hi, r.v) for r in table.where(F.col("k") == k).orderBy("v").collect()] for k in "abc"}
    want = sorted((k, i, next(v for hi, v in ends[k] if hi > u)) for k, i, u in asked if k in ends)
    for buckets in (None, 16):
        assert sorted((r.k, r.i, r.v) for r in synthesis.draw(draws_, table, "v", ["k"], buckets=buckets).collect()) == want
    assert synthesis.indexed(table, "v", ["k"]).where("k = 'c'").count() <= 2 * 400
    one = synthesis.draw(draws_.where("k = 'b'").drop("k"), table.where("k = 'b'").drop("k"), "v", []).collect()
    assert sorted(("b", r.i, r.v) for r in one) == [w for w in want if w[0] == "b"]


def test_draws_from_many_values_take_constant_work(spark):
    """10^5 values and 2 x 10^5 draws: the join of the index makes about two rows a draw."""
    from tracemill.operators import synthesis

    n = 100_000
    shares = spark.range(n).select(F.col("id").cast("int").alias("v"), (F.pow(F.lit(1.0) / (F.col("id") + 1), 1.1)).alias("w"))
    shares = shares.crossJoin(shares.agg(F.sum("w").alias("s"))).select("v", (F.col("w") / F.col("s")).alias("p"))
    index = synthesis.indexed(synthesis.cumulative(shares, "v", []), "v", [])
    asked = spark.range(200_000).select("id", draws.uniform("many", F.col("id")).alias("u")).withColumn("bucket", F.floor(F.col("u") * n))
    assert asked.join(index, "bucket").count() < 3 * 200_000
    got = synthesis.draw(asked.drop("bucket"), synthesis.cumulative(shares, "v", []), "v", [])
    first = shares.where("v = 0").first().p
    assert got.count() == 200_000 and abs(got.where("v = 0").count() / 200_000 - first) < 5 * (first / 200_000) ** 0.5


def test_the_rule_does_not_broadcast_the_groups_cells(spark, tmp_path):
    """Counts of many groups are small files and large tables, so they are merged and never sent to the driver."""
    counts = spark.createDataFrame([(1, "a", 0, 0, 2), (1, "b", 5, 0, 1), (2, "c", 1, 1, 1)], "target long, agg_id string, roi int, epoch int, cnt long")
    counts.write.parquet(f"{tmp_path}/counts")
    own = spark.createDataFrame([(1, 0, 0), (2, 1, 1)], "target long, roi int, epoch int")
    found = rules.contradicted(counts.select("target", "agg_id"), spark.read.parquet(f"{tmp_path}/counts"), own, 2)
    anti = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "LeftAnti" in x and "agg_id" in x]
    assert anti and all("SortMergeJoin" in x for x in anti)
    assert sorted(map(tuple, found.collect())) == [(1, "a", False), (1, "b", True), (2, "c", False)]
