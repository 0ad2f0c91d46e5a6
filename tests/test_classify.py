"""Classifiers on sparse rows give what plain dense arithmetic gives, in bounded memory, for all targets in one job."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tracemill.config import AuditConfig
from tracemill.operators import classify


@pytest.fixture
def data():
    """A sparse matrix as lists, dense, with labels and training rows."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((40, 60)) < 0.2, rng.integers(1, 9, (40, 60)), 0).astype(float)
    x[:, 7] = 2.0  # a constant column, and two that some rows lack
    idx = [np.flatnonzero(r) * 3 for r in x]
    used = np.flatnonzero(x.any(axis=0))
    y = (x[:, 0] + x[:, 3] > 2).astype(float)
    return classify.Sparse(idx, [r[r != 0] for r in x]), x[:, used], y, np.arange(40) < 28


@pytest.mark.parametrize("kind", [None, "Standard", "MinMax"])
def test_designs_are_scaled_matrices(data, kind, monkeypatch):
    monkeypatch.setattr(classify.Design, "BLOCK", 7)
    x, dense, _, train = data
    shift, scale = {None: (0, 1), "Standard": (dense[train].mean(axis=0), dense[train].std(axis=0)), "MinMax": (dense[train].min(axis=0), np.ptp(dense[train], axis=0))}[kind]
    z = (dense - shift) / np.where(np.asarray(scale) > 0, scale, 1)
    d = classify.Design(x, kind, train)
    rng = np.random.default_rng(1)
    w, r = rng.normal(size=z.shape[1]), rng.normal(size=40)
    assert np.allclose(d.dot(w), z @ w) and np.allclose(d.tdot(r), z.T @ r) and np.allclose(d.gram(), z @ z.T)
    assert np.allclose(d.columns(np.array([5, 0, 9])), z[:, [5, 0, 9]])
    assert np.allclose(np.concatenate([b for _, b in d.blocks()], axis=1), z)


def test_components_are_those_of_a_decomposition(data):
    x, _, _, train = data
    d = classify.Design(x, "Standard", train)
    z = np.concatenate([b for _, b in d.blocks()], axis=1)
    c = z - z[train].mean(axis=0)
    _, s, axes = np.linalg.svd(c[train], full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2) / (s**2).sum(), 0.9)) + 1
    got, want = classify.components(d, 0.9, train), c @ axes[:k].T
    assert got.shape == want.shape and np.allclose(np.abs(got), np.abs(want), atol=1e-6)


def test_logistic_minimises_its_objective(data):
    x, _, y, train = data
    d = classify.Design(x, "Standard", train)
    z = np.column_stack([np.concatenate([b for _, b in d.blocks()], axis=1), np.ones(40)])
    w = classify.Logistic(c=1.0, max_iter=2000, tol=1e-9).fit(d, y, train).w

    def objective(v):
        return np.abs(v).sum() + np.logaddexp(0, -(2 * y[train] - 1) * (z[train] @ v)).sum()

    rng = np.random.default_rng(2)
    assert all(objective(w) <= objective(w + e * rng.normal(size=len(w))) + 1e-9 for e in (1e-4, 1e-3, 1e-2, 0.1) for _ in range(20))
    assert (w == 0).sum() > len(w) / 2  # sparse


def test_perceptron_is_plain_descent(data):
    """With weights and gradients over the columns written out, scores are the same."""
    x, _, y, train = data
    d = classify.Design(x, "Standard", train)
    z, rows = np.concatenate([b for _, b in d.blocks()], axis=1), np.flatnonzero(train)
    p = classify.Perceptron(hidden=20, rounds=15, batch=9, rate=0.05)
    rng = np.random.default_rng([p.seed, 0])
    bound = np.sqrt(6.0 / (z.shape[1] + 20))
    w1, b1, rng = rng.uniform(-bound, bound, (z.shape[1], 20)), np.zeros(20), np.random.default_rng(p.seed)
    w2, b2 = rng.uniform(-1, 1, 20) * np.sqrt(6.0 / 21), 0.0
    moved = [np.zeros_like(w1), np.zeros(20), np.zeros(20), 0.0]
    rate = p.rate / max(1.0, (z[rows] ** 2).sum(axis=1).mean() / np.sqrt(z.shape[1]))
    for _ in range(15):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), 9):
            some = rows[order[at : at + 9]]
            pre = z[some] @ w1 + b1
            act = np.maximum(pre, 0)
            error = (1 / (1 + np.exp(-(act @ w2 + b2))) - y[some]) / len(some)
            back = np.outer(error, w2) * (pre > 0)
            steps = [rate * (z[some].T @ back + p.penalty * w1), rate * back.sum(axis=0), p.rate * (act.T @ error + p.penalty * w2), p.rate * error.sum()]
            moved = [0.9 * m - s for m, s in zip(moved, steps)]
            w1, b1, w2, b2 = w1 + moved[0], b1 + moved[1], w2 + moved[2], b2 + moved[3]
    want = 1 / (1 + np.exp(-(np.maximum(z @ w1 + b1, 0) @ w2 + b2)))
    assert np.allclose(p.fit_scores(d, y, train), want, atol=1e-8)


def frame(n, cells, signal, target=1, seed=0, nnz=40):
    """n aggregates of which those with label 1 have `signal` cells of their own, if any."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        idx = np.unique(np.append(rng.integers(10, cells, nnz), np.arange(signal) if k % 2 else []).astype(np.int64))
        out.append((target, ["train", "train", "validation", "test"][k // 2 % 4], f"a{k}", k % 2, idx, rng.integers(1, 5, len(idx)).astype(float)))
    return pd.DataFrame(out, columns=["target", "split", "agg_id", "label", "idx", "cnt"])


KINDS = [{"classifier": "LR"}, {"classifier": "RF"}, {"classifier": "MLP", "scaler": "MinMax"}, {"classifier": "RF", "pca": 0.9}, {"classifier": "MLP", "pca": 0.9}, {"classifier": "LR", "scaler": "Standard", "pca": 0.95}]


@pytest.mark.parametrize("changed", KINDS)
def test_every_kind_tells_planted_cells_and_nothing_where_there_are_none(changed):
    """Ten of sixty cells tell; with none, scores are near chance."""
    got = classify.attack(frame(200, 60, 10, nnz=15), AuditConfig(**changed))
    assert ((got["p"].to_numpy()[:, None] > got["p"].to_numpy()) * (got["y"].to_numpy()[:, None] > got["y"].to_numpy())).sum() / (got["y"].sum() * (1 - got["y"]).sum()) > 0.95
    none = classify.attack(frame(400, 60, 0, nnz=15, seed=5), AuditConfig(**changed))
    auc = ((none["p"].to_numpy()[:, None] > none["p"].to_numpy()) * (none["y"].to_numpy()[:, None] > none["y"].to_numpy())).sum() / (none["y"].sum() * (1 - none["y"]).sum())
    assert 0.3 < auc < 0.7


@pytest.mark.parametrize("changed", [{"classifier": "LR", "scaler": "Standard", "lr_max_iter": 2}, {"classifier": "RF", "rf_trees": 5}, {"classifier": "MLP", "scaler": "Standard"}])
def test_large_grids_fit_into_a_gigabyte(changed):
    """10^4 ROIs by 720 epochs, 120 aggregates of 5,000 cells: as a dense matrix 0.6 GB, and the perceptron's weights 1 GB."""
    rows = frame(120, 7_200_000, 10, nnz=5_000)
    tracemalloc.start()
    got = classify.attack(rows, AuditConfig(**changed))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 30 and peak < 400 << 20


def test_edges_of_training():
    config = AuditConfig(classifier="RF")
    one = frame(40, 60, 5)
    one.loc[one["split"] == "train", "label"] = 1
    assert set(classify.attack(one, config)["p"]) == {1.0}
    assert set(classify.attack(one[one["split"] != "train"], config)["p"]) == {0.5}
    empty = frame(40, 60, 0).assign(idx=[np.empty(0, dtype=int)] * 40, cnt=[np.empty(0)] * 40)
    for kind in ("LR", "RF", "MLP"):
        assert set(np.round(classify.attack(empty, AuditConfig(classifier=kind))["p"], 3)) == {0.5}


@pytest.mark.parametrize("kind", ["LR", "RF", "MLP"])
def test_all_targets_in_one_job(spark, kind):
    parts = pd.concat([frame(64, 60, 10, target=t, seed=t, nnz=10) for t in range(50)])
    rows = spark.createDataFrame(parts.assign(idx=parts["idx"].map(lambda v: v.tolist()), cnt=parts["cnt"].map(lambda v: v.tolist())), "target long, split string, agg_id string, label int, idx array<int>, cnt array<double>")
    spark.sparkContext.setJobGroup("fits", "fits")
    got = classify.predict(rows, AuditConfig(classifier=kind, rf_trees=40)).toPandas()
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("fits")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 50 * 16 and got["target"].nunique() == 50 and len(jobs) < 10
    assert (got["y"] == got["pred"]).mean() > (0.65 if kind == "RF" else 0.85)  # 32 rows to learn from
