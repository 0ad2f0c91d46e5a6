"""Classifiers that decide membership from an aggregate's cells: thousands of small ones, one for each target, in tasks.

A target's rows (at most a few hundred aggregates) meet in one task as sparse cells and stay sparse: a design has the rows' cells, and a
shift and a scale for each cell that are applied where products are taken. What is dense is a vector over the cells, a matrix of
rows by rows, or a block of columns. All targets' classifiers, of whichever kind, are one job.

- Logistic regression works with products of the design and its transpose.
- Principal components come from the Gram matrix of the rows, and so does the first layer of the perceptron: gradient steps change its
  weights by sums of rows, so the products of rows tell all that training and scoring need.
- Forests look at a few columns at a time, by histograms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import AuditConfig

PREDICTIONS = "target long, agg_id string, y int, p double, pred int, thr double"


def features(aggregates: DataFrame, groups: DataFrame, n_epochs: int) -> DataFrame:
    """(target, split, agg_id, label, idx, cnt): sparse cell lists of each aggregate, also of those without a visit."""
    cells = F.sort_array(F.collect_list(F.struct((F.col("roi") * n_epochs + F.col("epoch")).alias("idx"), F.col("cnt").cast("double").alias("cnt"))))
    lists = aggregates.groupBy("target", "agg_id").agg(cells.alias("_cells"))
    joined = groups.select("target", "split", "agg_id", "label").join(lists, ["target", "agg_id"], "left")
    empty = F.expr("array()")
    return joined.select("target", "split", "agg_id", "label", F.coalesce(F.col("_cells.idx"), empty.cast("array<int>")).alias("idx"), F.coalesce(F.col("_cells.cnt"), empty.cast("array<double>")).alias("cnt"))


class Sparse:
    """Rows of (column, value) over the columns that any of them has, all others being zero."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray]) -> None:
        lengths = [len(c) for c in columns]
        self.cells, at = np.unique(np.concatenate([*columns, np.empty(0, dtype=np.int64)]).astype(np.int64), return_inverse=True)
        self.row, self.column, self.value = np.repeat(np.arange(len(columns), dtype=np.int32), lengths), at.astype(np.int32), np.concatenate([*values, np.empty(0)])
        self.shape = (len(columns), len(self.cells))
        by = np.argsort(self.column, kind="stable")  # column after column, for blocks
        self.row, self.column, self.value = self.row[by], self.column[by], self.value[by]
        self.first = np.searchsorted(self.column, np.arange(self.shape[1] + 1))

    def columns(self, some: np.ndarray) -> np.ndarray:
        """The columns as a dense block."""
        out = np.zeros((self.shape[0], len(some)))
        n = self.first[some + 1] - self.first[some]
        at = np.repeat(self.first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())
        out[self.row[at], np.repeat(np.arange(len(some)), n)] = self.value[at]
        return out

    def _sum(self, weights: np.ndarray, keep: np.ndarray) -> np.ndarray:
        return np.bincount(self.column[keep], weights[keep], minlength=self.shape[1])

    def moments(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of each column over the rows of a mask, zeros counted."""
        keep, n = rows[self.row], max(1, int(rows.sum()))
        mean = self._sum(self.value, keep) / n
        there = self._sum(np.ones(len(self.value)), keep)
        squares = self._sum((self.value - mean[self.column]) ** 2, keep) + (n - there) * mean**2
        return mean, np.sqrt(squares / n)

    def extremes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keep = rows[self.row]
        full = np.bincount(self.column[keep], minlength=self.shape[1]) == rows.sum()
        low, high = (np.where(full, edge, 0.0) for edge in (np.inf, -np.inf))
        np.minimum.at(low, self.column[keep], self.value[keep])
        np.maximum.at(high, self.column[keep], self.value[keep])
        return low, high


class Design:
    """(x - shift) / scale for the rows of a sparse matrix, which is never made."""

    BLOCK = 4096

    def __init__(self, x: Sparse, kind: str | None, rows: np.ndarray) -> None:
        """kind: Standard, MinMax or none, by the rows of a mask."""
        self.x, self.shape = x, x.shape
        self.shift, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])
        if kind == "Standard" and rows.any():
            self.shift, scale = x.moments(rows)
        elif kind == "MinMax" and rows.any():
            low, high = x.extremes(rows)
            self.shift, scale = low, high - low
        self.scale = np.where(scale > 1e-12, scale, 1.0)

    def dot(self, w: np.ndarray) -> np.ndarray:
        w = w / self.scale
        return np.bincount(self.x.row, self.x.value * w[self.x.column], minlength=self.shape[0]) - self.shift @ w

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return (np.bincount(self.x.column, self.x.value * r[self.x.row], minlength=self.shape[1]) - self.shift * r.sum()) / self.scale

    def columns(self, some: np.ndarray) -> np.ndarray:
        return (self.x.columns(some) - self.shift[some]) / self.scale[some]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(columns, dense block) of all columns, a block at a time."""
        for at in range(0, self.shape[1], self.BLOCK):
            some = np.arange(at, min(at + self.BLOCK, self.shape[1]))
            yield some, self.columns(some)

    def gram(self) -> np.ndarray:
        """Products of all rows with all rows."""
        out = np.zeros((self.shape[0], self.shape[0]))
        for _, block in self.blocks():
            out += block @ block.T
        return out


class Dense:
    """The same for a matrix of few columns, such as components."""

    def __init__(self, x: np.ndarray) -> None:
        self.x, self.shape = x, x.shape

    def dot(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def tdot(self, r: np.ndarray) -> np.ndarray:
        return self.x.T @ r

    def columns(self, some: np.ndarray) -> np.ndarray:
        return self.x[:, some]

    def blocks(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        yield np.arange(self.shape[1]), self.x

    def gram(self) -> np.ndarray:
        return self.x @ self.x.T


def components(design: Design | Dense, share: float, train: np.ndarray) -> np.ndarray:
    """All rows in the principal components of the rows of a mask that hold a share of their variance, from the rows' products."""
    g = design.gram()
    own = g[:, train] - g[:, train].mean(axis=1, keepdims=True)  # products with the centred training rows
    both = own - own[train].mean(axis=0, keepdims=True)  # of rows from the training mean
    values, vectors = np.linalg.eigh((both[train] + both[train].T) / 2)
    order = np.argsort(values)[::-1]
    values = np.clip(values[order], 0, None)
    k = int(np.searchsorted(np.cumsum(values) / max(values.sum(), 1e-300), share)) + 1
    k = min(k, int((values > 1e-9 * max(values[0], 1e-300)).sum()) or 1)
    return (both @ vectors[:, order[:k]]) / np.sqrt(np.maximum(values[:k], 1e-300))


class Logistic:
    """Logistic regression with an L1 penalty, bias included: minimises |w|_1 + c * sum of losses by accelerated proximal steps."""

    def __init__(self, c: float = 1.0, max_iter: int = 100, tol: float = 1e-4) -> None:
        self.c, self.max_iter, self.tol = c, max_iter, tol

    def fit(self, design: Design | Dense, y: np.ndarray, train: np.ndarray) -> Logistic:
        """On the rows of a mask."""
        on = train.astype(float)

        def forward(w: np.ndarray) -> np.ndarray:
            return design.dot(w[:-1]) + w[-1]

        def back(r: np.ndarray) -> np.ndarray:
            return np.append(design.tdot(r * on), (r * on).sum())

        v = np.random.default_rng(0).random(design.shape[1] + 1)  # the largest eigenvalue, by powers
        for _ in range(30):
            v = back(forward(v / max(np.linalg.norm(v), 1e-300)))
        lipschitz = self.c * 0.25 * 1.1 * max(float(np.linalg.norm(v)), 1e-12)
        w = z = np.zeros(design.shape[1] + 1)
        t = 1.0
        for _ in range(self.max_iter * 10):
            g = self.c * back(1 / (1 + np.exp(-np.clip(forward(z), -50, 50))) - y)
            step = z - g / lipschitz
            new = np.sign(step) * np.maximum(np.abs(step) - 1 / lipschitz, 0)
            t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
            z = new + (before - 1) / t * (new - w)
            moved = np.abs(new - w).max(initial=0)
            w = new
            if moved <= self.tol * max(1e-12, np.abs(w).max(initial=0)) * 0.1:
                break
        self.w = w
        return self

    def scores(self, design: Design | Dense) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(design.dot(self.w[:-1]) + self.w[-1], -50, 50)))


class Perceptron:
    """One hidden layer of rectified units, a logistic output, mini-batch gradient descent with momentum.

    The first layer's weights are the random ones at the start, times a factor, plus a sum of training rows: its value for a row needs the
    row's products with the start and with the training rows only, so neither weights nor gradients over the cells are kept.
    """

    def __init__(self, hidden: int = 200, rounds: int = 200, batch: int = 200, rate: float = 0.01, momentum: float = 0.9, penalty: float = 1e-4, seed: int = 42) -> None:
        self.hidden, self.rounds, self.batch, self.rate, self.momentum, self.penalty, self.seed = hidden, rounds, batch, rate, momentum, penalty, seed

    def start(self, design: Design | Dense) -> np.ndarray:
        """Products of all rows with the first weights, which are drawn for a block of columns at a time."""
        out, bound = np.zeros((design.shape[0], self.hidden)), np.sqrt(6.0 / (design.shape[1] + self.hidden))
        for some, block in design.blocks():
            rng = np.random.default_rng([self.seed, int(some[0]) if len(some) else 0])
            out += block @ rng.uniform(-bound, bound, (len(some), self.hidden))
        return out

    def fit_scores(self, design: Design | Dense, y: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Scores of all rows after training on those of a mask."""
        rows = np.flatnonzero(train)
        size = np.sqrt(max(design.shape[1], 1))
        first, products = self.start(design), design.gram()[:, rows]
        rng = np.random.default_rng(self.seed)
        factor, sums = 1.0, np.zeros((len(rows), self.hidden))  # weights = factor * start + rows.T @ sums
        bias, out, out_bias = np.zeros(self.hidden), rng.uniform(-1, 1, self.hidden) * np.sqrt(6.0 / (self.hidden + 1)), 0.0
        v_factor, v_sums, v_bias, v_out, v_out_bias = 0.0, np.zeros_like(sums), np.zeros_like(bias), np.zeros_like(out), 0.0
        rate = self.rate / max(1.0, float(np.diag(products[rows]).mean()) / size)  # long rows take small steps

        def hidden(of: np.ndarray) -> np.ndarray:
            return factor * first[of] + products[of] @ sums + bias

        for _ in range(self.rounds):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), self.batch):
                some = order[at : at + self.batch]
                pre = hidden(rows[some])
                act = np.maximum(pre, 0)
                error = (1 / (1 + np.exp(-np.clip(act @ out + out_bias, -50, 50))) - y[rows[some]]) / len(some)
                back = np.outer(error, out) * (pre > 0)
                v_factor = self.momentum * v_factor - rate * self.penalty * factor
                v_sums = self.momentum * v_sums - rate * self.penalty * sums
                v_sums[some] -= rate * back
                v_bias = self.momentum * v_bias - rate * back.sum(axis=0)
                v_out = self.momentum * v_out - self.rate * (act.T @ error + self.penalty * out)
                v_out_bias = self.momentum * v_out_bias - self.rate * error.sum()
                factor, sums, bias, out, out_bias = factor + v_factor, sums + v_sums, bias + v_bias, out + v_out, out_bias + v_out_bias
        act = np.maximum(hidden(np.arange(design.shape[0])), 0)
        return 1 / (1 + np.exp(-np.clip(act @ out + out_bias, -50, 50)))


class Forest:
    """Trees on drawn rows; each node looks at drawn columns, cut into `bins` equal parts, for the split that lowers the Gini impurity most."""

    def __init__(self, trees: int = 100, depth: int = 5, bins: int = 32, seed: int = 42) -> None:
        self.trees, self.depth, self.bins, self.seed = trees, depth, bins, seed

    def fit_scores(self, design: Design | Dense, y: np.ndarray, train: np.ndarray) -> np.ndarray:
        """Mean share of label 1 in the leaves that each row ends in."""
        rng, rows, total = np.random.default_rng(self.seed), np.flatnonzero(train), np.zeros(design.shape[0])
        for _ in range(self.trees):
            weight = np.bincount(rng.choice(rows, len(rows)), minlength=design.shape[0]).astype(float)
            todo = [(np.arange(design.shape[0]), 0)]
            while todo:  # all rows go down the tree, those of the mask with their weights
                here, level = todo.pop()
                w, label = weight[here], y[here]
                share = (w * label).sum() / w.sum()
                split = self.split(design, here, w, label, rng) if level < self.depth and 0 < share < 1 else None
                if split is None:
                    total[here] += share
                else:
                    todo += [(here[split], level + 1), (here[~split], level + 1)]
        return total / self.trees

    def split(self, design: Design | Dense, here: np.ndarray, w: np.ndarray, label: np.ndarray, rng: np.random.Generator) -> np.ndarray | None:
        """Which rows go to the lower side, or none if no drawn column parts the weighted ones."""
        some = rng.choice(design.shape[1], max(1, int(np.sqrt(design.shape[1]))), replace=False)
        x = design.columns(some)[here]
        drawn = w > 0
        low, high = x[drawn].min(axis=0), x[drawn].max(axis=0)
        span = np.where(high > low, high - low, 1.0)
        place = np.clip(((x - low) / span * self.bins).astype(np.int64), 0, self.bins - 1)
        flat = (place + np.arange(len(some)) * self.bins)[drawn].ravel()
        ones, all_ = (np.bincount(flat, np.repeat(v[drawn], len(some)), minlength=len(some) * self.bins).reshape(-1, self.bins).cumsum(axis=1) for v in (w * label, w))
        left, right = all_[:, :-1], all_[:, -1:] - all_[:, :-1]
        with np.errstate(divide="ignore", invalid="ignore"):
            kept = ones[:, :-1] ** 2 / left + (left - ones[:, :-1]) ** 2 / left + (ones[:, -1:] - ones[:, :-1]) ** 2 / right + (right - ones[:, -1:] + ones[:, :-1]) ** 2 / right
        kept = np.where((left > 0) & (right > 0), kept, -1.0)  # the more, the purer
        best = int(kept.argmax())
        column, cut = divmod(best, self.bins - 1)
        return place[:, column] <= cut if kept.ravel()[best] >= 0 else None


def youden_threshold(y: np.ndarray, p: np.ndarray) -> float:
    """The largest threshold with the greatest true minus false positive rate; infinite if none is above zero, 0.5 without both classes."""
    if len(set(y.tolist())) < 2:
        return 0.5
    order = np.argsort(-p, kind="stable")
    hits, misses = np.cumsum(y[order] == 1), np.cumsum(y[order] == 0)
    last = np.append(p[order][1:] != p[order][:-1], True)
    j = np.where(last, hits / hits[-1] - misses / misses[-1], -1)
    best = int(j.argmax())
    return float(p[order][best]) if j[best] > 1e-12 else float("inf")


def sparse(rows: pd.DataFrame) -> Sparse:
    """features() rows of a target."""
    return Sparse([np.asarray(i, dtype=np.int64) for i in rows["idx"]], [np.asarray(c, dtype=float) for c in rows["cnt"]])


def scaled(rows: DataFrame, kind: str | None) -> DataFrame:
    """(target, agg_id, idx, z) for features() rows: each target's cells that any of its rows has, scaled over all its rows."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        design = Design(sparse(f), kind, np.ones(len(f), dtype=bool))
        z = np.concatenate([block for _, block in design.blocks()], axis=1) if design.shape[1] else np.empty((len(f), 0))
        cells = design.x.cells
        return pd.DataFrame({"target": np.repeat(f["target"].to_numpy(), len(cells)), "agg_id": np.repeat(f["agg_id"].to_numpy(), len(cells)), "idx": np.tile(cells, len(f)), "z": z.ravel()})

    return rows.groupBy("target").applyInPandas(run, "target long, agg_id string, idx int, z double")


def attack(rows: pd.DataFrame, config: AuditConfig) -> pd.DataFrame:
    """Train on a target's `train` rows, choose the threshold on `validation`, predict `test`.

    Cells are scaled by the training and validation rows; components are those of the training rows. Without training rows of both
    labels there is nothing to learn, and every score is their share of label 1, or 0.5.
    """
    rows = rows.sort_values(["split", "agg_id"])  # what is drawn of them does not depend on how they came
    of, y = {s: (rows["split"] == s).to_numpy() for s in ("train", "validation", "test")}, rows["label"].to_numpy(dtype=float)
    train = of["train"]
    if len(set(y[train].tolist())) < 2:
        p = np.full(len(rows), y[train].mean() if train.any() else 0.5)
    else:
        design: Design | Dense = Design(sparse(rows), config.scaler, train | of["validation"])
        if config.pca:
            design = Dense(components(design, config.pca, train))
        if config.classifier == "LR":
            p = Logistic(config.lr_c, config.lr_max_iter, config.lr_tol).fit(design, y, train).scores(design)
        elif not design.shape[1]:
            p = np.full(len(rows), y[train].mean())
        elif config.classifier == "RF":
            p = Forest(config.rf_trees or 100, config.rf_depth or 5).fit_scores(design, y, train)
        else:
            p = Perceptron().fit_scores(design, y, train)
    thr = youden_threshold(y[of["validation"]], p[of["validation"]]) if of["validation"].any() else 0.5
    test = rows[of["test"]]
    return pd.DataFrame({"target": test["target"], "agg_id": test["agg_id"], "y": test["label"], "p": p[of["test"]], "pred": (p[of["test"]] >= thr).astype(int), "thr": thr})


def predict(rows: DataFrame, config: AuditConfig) -> DataFrame:
    """Predictions for all targets' `test` rows of features(): a task a target, in one job, whichever classifier."""
    return rows.groupBy("target").applyInPandas(lambda f: attack(f, config), PREDICTIONS)
