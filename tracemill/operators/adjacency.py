"""Which ROIs are neighbours: edges of the Delaunay triangulation of their places, made by cells.

The map is cut into equal cells of some hundred places. Each cell triangulates its own places with those in a margin around it, and
keeps the triangles at its own places. Such a triangle is one of the whole map if no place at all lies in its circle: circles
within the margin have shown that, for the others all places of the cells that a circle reaches are looked at, and a place in it
joins the cell's, which is triangulated again. When no circle of a cell has a place in it, its edges are those of one triangulation
of the whole map. A round is a few joins for all cells that are left. A cell's places meet in one task, so a map with most of
its places in a spot takes long; there is no limit to the places of a map.
"""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stages import keep
from .prep import dense_index


#: Corners of a triangle around all places, in units of the map's extent.
FAR = np.array([[-50.0, -50.0], [50.0, -50.0], [0.5, 80.0]])


def nudged(p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Places in units of the extent, moved by a ten millionth by their numbers: of the triangulations of points on one circle it is always the same."""
    return p + 1e-7 * np.column_stack([np.sin(k * 12.9898), np.cos(k * 78.233)])


def triangles(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(corners, circles) of a Delaunay triangulation of points, of which the last three are FAR, by inserting them one by one; a circle is x, y, r * r."""

    def circumcircles(tri: np.ndarray) -> np.ndarray:
        a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        d = np.where(d == 0, 1e-30, d)
        s = [(q**2).sum(axis=1) for q in (a, b, c)]
        x = (s[0] * (b[:, 1] - c[:, 1]) + s[1] * (c[:, 1] - a[:, 1]) + s[2] * (a[:, 1] - b[:, 1])) / d
        y = (s[0] * (c[:, 0] - b[:, 0]) + s[1] * (a[:, 0] - c[:, 0]) + s[2] * (b[:, 0] - a[:, 0])) / d
        return np.column_stack([x, y, (a[:, 0] - x) ** 2 + (a[:, 1] - y) ** 2])

    n = len(p) - 3
    corners = np.array([[n, n + 1, n + 2]])
    circles = circumcircles(corners)
    for i in range(n):
        bad = (p[i, 0] - circles[:, 0]) ** 2 + (p[i, 1] - circles[:, 1]) ** 2 < circles[:, 2]
        hole: dict[tuple[int, int], int] = defaultdict(int)
        for t in corners[bad]:
            for x, y in ((0, 1), (1, 2), (2, 0)):
                hole[min(t[x], t[y]), max(t[x], t[y])] += 1
        fresh = np.array([[x, y, i] for (x, y), times in hole.items() if times == 1]).reshape(-1, 3).astype(int)
        corners = np.vstack([corners[~bad], fresh])
        circles = np.vstack([circles[~bad], circumcircles(fresh)])
    return corners, circles


def _cell(f: pd.DataFrame, side: tuple[float, float], margin: float, extent: tuple[float, float]) -> pd.DataFrame:
    """Of a cell's places (i, j, k, x, y, own): rows (a, b) of the edges at its own ones, and (cx, cy, r2) of circles that reach beyond the margin."""
    f = f.sort_values("k")
    k, own = f["k"].to_numpy(), np.append(f["own"].to_numpy(), [False] * 3)
    corners, circles = triangles(np.vstack([f[["x", "y"]].to_numpy(), FAR]))
    mine = own[corners].any(axis=1)
    corners, circles = corners[mine], circles[mine]
    edges = {(min(a, b), max(a, b)) for t in corners.tolist() for a, b in zip(t, t[1:] + t[:1]) if max(a, b) < len(k) and (own[a] or own[b])}
    i, j, r = int(f["i"].iloc[0]), int(f["j"].iloc[0]), np.sqrt(circles[:, 2])
    beyond = np.zeros(len(circles), dtype=bool)
    for axis, (at, width, most) in enumerate(zip((i, j), side, extent)):
        for edge, reach, ends in ((at - margin, circles[:, axis] - r, -1), (at + 1 + margin, circles[:, axis] + r, 1)):
            if 0 < edge * width < most:  # beyond it there are places that the cell does not have; 1e-6, as places are nudged
                beyond |= ends * (reach - edge * width) > -1e-6
    ab = np.array(sorted(edges), dtype=np.int64).reshape(-1, 2)
    out = pd.DataFrame({"a": k[ab[:, 0]], "b": k[ab[:, 1]]}).astype("Int64")
    out = pd.concat([out, pd.DataFrame(circles[beyond], columns=["cx", "cy", "r2"])])
    return out.assign(i=i, j=j)[["i", "j", "a", "b", "cx", "cy", "r2"]]


def edges_of(places: DataFrame, per_cell: int = 200, margin: float = 0.5, max_rounds: int = 60) -> DataFrame:
    """(a, b), a < b: numbers of neighbouring places of places(k, lon, lat), k numbering different places in any order."""
    n, west, east, south, north = places.agg(F.count("*"), F.min("lon"), F.max("lon"), F.min("lat"), F.max("lat")).first()
    schema = "i int, j int, a long, b long, cx double, cy double, r2 double"
    if n < 2:
        return places.sparkSession.createDataFrame([], schema).select("a", "b")
    span = max(east - west, north - south) or 1.0
    g, extent = max(1, math.ceil(math.sqrt(n / per_cell))), ((east - west) / span, (north - south) / span)
    side = tuple((e or 1.0) / g for e in extent)

    def cell_of(x: Column, width: float) -> Column:
        return F.least(F.greatest(F.floor(x / width), F.lit(0)), F.lit(g - 1)).cast("int")

    plain = places.select("k", ((F.col("lon") - west) / span).alias("x0"), ((F.col("lat") - south) / span).alias("y0"))
    moved = plain.withColumns({"x": F.col("x0") + 1e-7 * F.sin(F.col("k") * 12.9898), "y": F.col("y0") + 1e-7 * F.cos(F.col("k") * 78.233)})
    homes = keep(moved.withColumns({"i": cell_of(F.col("x0"), side[0]), "j": cell_of(F.col("y0"), side[1])}))
    around = F.array(*(F.struct(F.lit(di).alias("di"), F.lit(dj).alias("dj")) for di in (-1, 0, 1) for dj in (-1, 0, 1)))
    near = homes.withColumn("d", F.explode(around)).withColumns({"own": F.expr("d.di = 0 and d.dj = 0"), "i": F.col("i") + F.col("d.di"), "j": F.col("j") + F.col("d.dj")})
    near = near.where((F.col("i").between(0, g - 1)) & F.col("j").between(0, g - 1))
    for axis, at, width in (("x0", "i", side[0]), ("y0", "j", side[1])):
        near = near.where((F.col(axis) >= (F.col(at) - margin) * width) & (F.col(axis) <= (F.col(at) + 1 + margin) * width))
    state = keep(near.select("i", "j", "k", "x", "y", "own").join(homes.select("i", "j").distinct(), ["i", "j"], "left_semi"))
    done = None
    for _ in range(max_rounds):
        made = keep(state.groupBy("i", "j").applyInPandas(lambda f: _cell(f, side, margin, extent), schema))
        # the cells of a row that a circle reaches lie between the ends of its chord there
        circles = made.where("r2 is not null").select("i", "j", "cx", "cy", "r2")
        row = lambda y: cell_of(y, side[1])
        rows = circles.withColumn("cj", F.explode(F.sequence(row(F.col("cy") - F.sqrt("r2") - 1e-6), row(F.col("cy") + F.sqrt("r2") + 1e-6))))
        off = F.greatest(F.col("cj") * side[1] - F.col("cy"), F.col("cy") - (F.col("cj") + 1) * side[1], F.lit(0.0))
        half = F.sqrt(F.greatest(F.col("r2") - off * off, F.lit(0.0))) + 1e-6
        reached = rows.withColumn("half", half).withColumn("ci", F.explode(F.sequence(cell_of(F.col("cx") - F.col("half"), side[0]), cell_of(F.col("cx") + F.col("half"), side[0]))))
        there = reached.join(homes.select(F.col("i").alias("ci"), F.col("j").alias("cj"), "k", "x", "y"), ["ci", "cj"])
        inside = there.where((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2 < F.col("r2") * (1 - 1e-12)).select("i", "j", "k", "x", "y", F.lit(False).alias("own")).distinct()
        more = keep(inside.join(state.select("i", "j", "k"), ["i", "j", "k"], "left_anti"))
        again = more.select("i", "j").distinct()
        settled = made.where("a is not null").join(again, ["i", "j"], "left_anti").select("a", "b")
        done = settled if done is None else done.unionByName(settled)
        if more.isEmpty():
            return done.distinct()
        state = keep(state.join(again, ["i", "j"], "left_semi").unionByName(more))
    raise RuntimeError(f"circles did not come empty in {max_rounds} rounds")


def neighbours(roi_map: DataFrame, per_cell: int = 200) -> DataFrame:
    """(roi, nbr) for roi_map(roi, lon, lat), both ways. ROIs at the same place share their neighbours and are each other's; one without a place has none."""
    whole = roi_map.where("roi is not null and lon is not null and lat is not null").groupBy("lon", "lat").agg(F.collect_set("roi").alias("rois"))
    places = keep(dense_index(whole, "lon", "lat", name="k"))
    same = places.where(F.size("rois") > 1).select(F.explode("rois").alias("roi"), F.col("rois").alias("others")).select("roi", F.explode("others").alias("nbr")).where("roi <> nbr")
    edges = edges_of(places, per_cell)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = both.join(places.select(F.col("k").alias("a"), F.col("rois").alias("of_a")), "a").join(places.select(F.col("k").alias("b"), F.col("rois").alias("of_b")), "b")
    near = named.select(F.explode("of_a").alias("roi"), "of_b").select("roi", F.explode("of_b").alias("nbr"))
    return near.unionByName(same).select(F.col("roi").cast("int").alias("roi"), F.col("nbr").cast("int").alias("nbr"))


def of_roi(adjacency: DataFrame, roi: int) -> DataFrame:
    """The neighbours of one ROI."""
    return adjacency.where(F.col("roi") == roi).select("nbr")
