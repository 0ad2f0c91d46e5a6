"""The sparse release has the distribution of noise on every cell, and costs what it releases."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tracemill.functions.draws import uniform
from tracemill.operators import privacy


def dense(aggregates, groups, keys, noise_key, n_rois, n_epochs, group_size, eps, sens, k=0, seed=42):
    """Noise on a row for every cell of the grid."""
    cells = groups.select(*dict.fromkeys([*keys, *noise_key])).distinct().withColumn("roi", F.explode(F.sequence(F.lit(0), F.lit(n_rois - 1)))).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(n_epochs - 1))))
    draw = uniform("noise", seed, *(F.col(c) for c in noise_key), F.col("roi"), F.col("epoch"))
    out = cells.join(aggregates.select(*keys, "roi", "epoch", "cnt"), [*keys, "roi", "epoch"], "left").withColumn("cnt", privacy.noisy_counts(F.col("cnt"), draw, sens / eps, group_size))
    return out.where(F.col("cnt") > k).select(*keys, "roi", "epoch", "cnt")


@pytest.fixture(scope="module")
def counts(spark):
    return spark.createDataFrame([(f"a{g}", r, e, 1 + (g + r) % 4) for g in range(8) for r in range(0, 40, 4) for e in (0, 7)], "agg_id string, roi int, epoch int, cnt long")


@pytest.mark.parametrize("eps,k", [(1.0, 0), (0.5, 2), (0.1, 1)])
def test_counted_cells_are_the_dense_ones_and_empty_ones_have_their_distribution(spark, counts, eps, k):
    args = (counts, counts, ["agg_id"], ["agg_id"], 40, 100, 30, eps, 1.0, k)
    a = {(r.agg_id, r.roi, r.epoch): r.cnt for r in privacy.release(*args).collect()}
    b = {(r.agg_id, r.roi, r.epoch): r.cnt for r in dense(*args).collect()}
    seen = {(r.agg_id, r.roi, r.epoch) for r in counts.collect()}
    assert {c: v for c, v in a.items() if c in seen} == {c: v for c, v in b.items() if c in seen}
    cells, p = 8 * 4000 - len(seen), 0.5 * math.exp(-(k + 1) * eps)
    for found in (a, b):  # how many survive, and what they are
        empty = {c: v for c, v in found.items() if c not in seen}
        assert abs(len(empty) - cells * p) < 5 * math.sqrt(cells * p * (1 - p))
        values = Counter(empty.values())
        assert min(values) == k + 1 and max(values) <= 30
        for v in range(k + 1, k + 6):
            want = cells * p * (1 - math.exp(-eps)) * math.exp(-eps * (v - k - 1))
            assert abs(values[v] - want) < 5 * math.sqrt(want) + 1
    empty = [c for c in a if c not in seen]  # anywhere in the grid
    for part in range(4):
        assert abs(sum(r // 10 == part for _, r, _ in empty) - len(empty) / 4) < 5 * math.sqrt(len(empty) / 4)
    gaps = Counter((b[1] * 100 + b[2]) - (a_[1] * 100 + a_[2]) for a_, b in zip(sorted(empty), sorted(empty)[1:]) if a_[0] == b[0])
    assert abs(gaps[1] / max(1, sum(gaps.values())) - p) < 5 * math.sqrt(p / max(1, sum(gaps.values()))) + 0.01


def test_pairs_share_their_noise(spark):
    """Cells that one, both or neither of a pair count have the same noise in both; other pairs have other noise."""
    c = spark.createDataFrame([("p", 1, 0, 0, 5), ("p", 0, 0, 0, 5), ("p", 1, 1, 0, 5), ("q", 1, 0, 0, 5)], "pair_id string, label int, roi int, epoch int, cnt long")
    groups = spark.createDataFrame([(p, x) for p in "pq" for x in (0, 1)], "pair_id string, label int")
    out = {(r.pair_id, r.label, r.roi, r.epoch): r.cnt for r in privacy.release(c, groups, ["pair_id", "label"], ["pair_id"], 50, 50, 10**6, 0.2, 1.0).collect()}
    base = {(r.pair_id, r.label, r.roi, r.epoch): r.cnt for r in c.collect()}
    cells = {(p, r, e) for p, _, r, e in out}
    for p, r, e in cells:
        if not any((p, x, r, e) in base for x in (0, 1)):
            assert out[p, 0, r, e] == out[p, 1, r, e] > 0
    assert out[("p", 1, 0, 0)] == out[("p", 0, 0, 0)]
    z = out.get(("p", 0, 1, 0), 0)
    assert max(0, z) == max(0, out.get(("p", 1, 1, 0), 0) - 5) or z == 0  # the same draw on a count of five and of none
    assert {k[2:] for k in out if k[0] == "p"} != {k[2:] for k in out if k[0] == "q"}


def test_cost_is_in_released_cells(spark):
    """A grid of 10^13 cells of which noise lifts about a thousand above k."""
    skips = privacy.Skips(1.0, 22, 10**13)
    want = 10**13 * skips.p
    groups = spark.createDataFrame([("a",)], "agg_id string")
    got = privacy.lifted(groups, ["agg_id"], skips, 10**6, 1)
    n, least = got.agg(F.count("*"), F.min("z")).first()
    assert abs(n - want) < 5 * math.sqrt(want) and least >= 23
    assert skips.draws < 4 * 1024


def test_release_edges(spark, counts):
    none = counts.limit(0)
    groups = spark.createDataFrame([("x",), ("y",)], "agg_id string")
    got = privacy.release(none, groups, ["agg_id"], ["agg_id"], 5, 5, 3, 0.5, 1.0).collect()  # groups without a visit
    assert got and all(1 <= r.cnt <= 3 for r in got) and len({(r.agg_id, r.roi, r.epoch) for r in got}) == len(got)
    assert privacy.release(none, groups, ["agg_id"], ["agg_id"], 5, 5, 3, 0.5, 1.0, k=3).count() == 0  # clipped to the size, then suppressed
    assert privacy.release(none, groups.limit(0), ["agg_id"], ["agg_id"], 5, 5, 3, 0.5, 1.0).count() == 0
    assert privacy.release(counts, counts, ["agg_id"], ["agg_id"], 40, 100, 30, 1000.0, 1.0).count() == counts.count()  # next to no noise
