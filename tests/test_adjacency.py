"""The triangulation by cells is the one of all places at once, and circles of its triangles are empty."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracemill.operators import adjacency


def at_once(points):
    """Edges of one triangulation of all places, numbered in the order of lon and lat."""
    p = np.array(sorted(points), dtype=float)
    span = float(np.ptp(p, axis=0).max()) or 1.0
    corners, circles = adjacency.triangles(np.vstack([adjacency.nudged((p - p.min(axis=0)) / span, np.arange(len(p))), adjacency.FAR]))
    return {(min(a, b), max(a, b)) for t in corners.tolist() for a, b in zip(t, t[1:] + t[:1]) if max(a, b) < len(p)}


@settings(max_examples=30, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40, unique=True))
def test_triangulation(points):
    edges, n = at_once(points), len(points)
    assert n < 3 or len(edges) <= 3 * n - 6
    if n > 1:
        linked, queue = {0}, [0]
        while queue:
            x = queue.pop()
            for a, b in edges:
                if x in (a, b) and (a + b - x) not in linked:
                    linked.add(a + b - x)
                    queue.append(a + b - x)
        assert len(linked) == n


def test_circles_are_empty():
    rng = np.random.default_rng(4)
    p = np.vstack([adjacency.nudged(rng.random((300, 2)), np.arange(300)), adjacency.FAR])
    corners, circles = adjacency.triangles(p)
    far = ((p[None, :300] - circles[:, None, :2]) ** 2).sum(axis=2) - circles[:, None, 2]
    assert (far > -1e-9 * circles[:, None, 2]).all() and len(corners) == 2 * 300 + 1


def maps():
    rng = np.random.default_rng(9)
    yield "random", rng.random((700, 2)) * [3.0, 1.0]
    yield "grid", np.array([(x, y) for x in range(24) for y in range(24)], dtype=float) * 0.25
    yield "clusters with gaps", np.concatenate([rng.normal(c, 0.02, (150, 2)) for c in ((0, 0), (5, 0), (5, 3), (1, 4))])
    yield "on a line", np.column_stack([np.arange(60.0), np.zeros(60)])
    yield "on a circle", np.column_stack([np.cos(np.arange(120) / 19.1), np.sin(np.arange(120) / 19.1)])


@pytest.mark.parametrize("name,points", list(maps()), ids=[n for n, _ in maps()])
def test_cells_give_the_edges_of_one_triangulation(spark, name, points):
    points = sorted({(float(a), float(b)) for a, b in points})
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(points)], "k long, lon double, lat double")
    got = {(r.a, r.b) for r in adjacency.edges_of(df, per_cell=40, margin=0.2).collect()}
    assert got == at_once(points)


def test_neighbours_of_few_and_shared_places(spark):
    rows = [(0, 0.0, 0.0), (1, 0.0, 0.0), (2, 1.0, 0.0), (3, 0.0, 1.0), (4, None, 1.0)]
    near = sorted((r.roi, r.nbr) for r in adjacency.neighbours(spark.createDataFrame(rows, "roi int, lon double, lat double")).collect())
    assert near == sorted({(a, b) for a in range(4) for b in range(4) if a != b})
    one = spark.createDataFrame(rows[:1], "roi int, lon double, lat double")
    assert adjacency.neighbours(one).count() == 0 == adjacency.neighbours(one.limit(0)).count()
    two = spark.createDataFrame([rows[0], rows[2]], "roi int, lon double, lat double")
    assert sorted((r.roi, r.nbr) for r in adjacency.neighbours(two).collect()) == [(0, 2), (2, 0)]
