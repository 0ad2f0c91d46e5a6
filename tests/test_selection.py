"""Percentiles by selection are those of a sort."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracemill.operators import prep


def columns():
    rng = np.random.default_rng(5)
    yield "spread", rng.normal(size=3000)
    yield "many equal", rng.integers(0, 4, 3000).astype(float)
    yield "one value", np.full(3000, 2.5)
    yield "far apart", np.concatenate([rng.random(1500) * 1e-300, rng.random(1500) * 1e300, [-1.7e308, 1.7e308]])
    yield "heaped", np.concatenate([np.full(2000, 7.0), np.nextafter(7.0, 8.0) + np.arange(5) * 1e-15, rng.random(995)])


@pytest.mark.parametrize("name,values", list(columns()), ids=[n for n, _ in columns()])
@pytest.mark.parametrize("few", [1, 50])
def test_order_statistics(spark, monkeypatch, name, values, few):
    monkeypatch.setattr(prep, "FEW", few)
    monkeypatch.setattr(prep, "PARTS", 16)
    df = spark.createDataFrame([(float(v), float(-v)) for v in values] + [(None, None)] * 7, "x double, y double")
    ranks = [0, 1, 15, len(values) // 2, len(values) - 1]
    got = prep.order_statistics(df, {"x": ranks, "y": [3]})
    assert got == {("x", r): float(np.sort(values)[r]) for r in ranks} | {("y", 3): float(np.sort(-values)[3])}


def test_percentile_box(spark):
    rng = np.random.default_rng(6)
    lon, lat = rng.normal(9, 1, 6000), rng.integers(0, 50, 6000) / 7
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(lon, lat)], "lon double, lat double")
    box = prep.percentile_box(df).first()
    want = [*np.quantile(lon, [0.005, 0.995]), *np.quantile(lat, [0.005, 0.995]), lon.min(), lon.max(), lat.min(), lat.max()]
    assert np.allclose(list(box), want, rtol=0, atol=1e-12)
    rough = prep.percentile_box(df, approximate=True).first()
    assert rough.asDict().keys() == box.asDict().keys() and abs(rough.min_lon - box.min_lon) < 0.05
    assert list(prep.percentile_box(df.limit(0)).first()) == [None] * 8
    one = prep.percentile_box(df.limit(1)).first()
    assert one.min_lon == one.max_lon == one.least_lon
    with pytest.raises(ValueError):
        prep.order_statistics(df, {"lon": [6000]})
    assert math.isclose(prep.percentile_box(df.withColumn("lon", F.when(F.col("lon") > 9, F.col("lon")))).first().min_lon, float(np.quantile(lon[lon > 9], 0.005)))
