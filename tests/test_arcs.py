"""Simplified outlines: neighbours stay joined, areas add up, lines keep within the tolerance, corners and holes."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratum.operators import arcs as A


def cells(spark, *grids):
    rows = [(k, r, c, int(v) or None) for k, g in enumerate(grids) for (r, c), v in np.ndenumerate(g) if v or (r + c) % 2]
    return spark.createDataFrame(rows, "raster int, row int, col int, label bigint").repartition(3)


def random_map(seed, size=24, labels=5):
    rng = np.random.default_rng(seed)
    spots = rng.random((labels * 2, 2)) * size
    y, x = np.mgrid[0:size, 0:size]
    near = np.argmin((y[..., None] - spots[:, 0]) ** 2 + (x[..., None] - spots[:, 1]) ** 2, -1)
    g = np.where(near >= labels, 0, near + 1)
    g[5:8, 5:8], g[6, 6] = 3, 0
    return g


def test_without_tolerance_areas_are_cells(spark):
    a, b = random_map(1), random_map(2, 15)
    rows = A.polygons(cells(spark, a, b), 0.0).collect()
    for k, g in enumerate((a, b)):
        for label in np.unique(g[g > 0]):
            mine = [r for r in rows if r["raster"] == k and r["label"] == label]
            assert sum(r["area"] for r in mine) == (g == label).sum()
            for r in mine:
                assert r["ring"][0] == r["ring"][-1] and len({(p["x"], p["y"]) for p in r["ring"]}) == r["points"]


@pytest.mark.parametrize("tolerance", [0.8, 2.5])
def test_neighbours_stay_joined(spark, tolerance):
    g = random_map(3)
    rows = A.polygons(cells(spark, g), tolerance).collect()
    steps = [((p["x"], p["y"]), (q["x"], q["y"])) for r in rows for p, q in zip(r["ring"][:-1], r["ring"][1:], strict=True)]
    inner = [s for s in steps if s[::-1] in set(steps)]
    outline = [s for s in steps if s[::-1] not in set(steps)]
    assert len(set(steps)) == len(steps) and len(inner) > 4 and len(outline) > 5
    # what all labels cover together is what their common outline encloses
    total = sum(a[0] * b[1] - b[0] * a[1] for a, b in outline) / 2
    assert total == pytest.approx(sum(r["area"] for r in rows))
    assert len(steps) < sum(len(r["ring"]) for r in A.polygons(cells(spark, g), 0.0).collect())


def plain(points, tolerance):
    """The same choice by recursion."""
    a, b = points[0], points[-1]
    away = [np.linalg.norm(p - a - np.clip((p - a) @ (b - a) / max((b - a) @ (b - a), 1e-300), 0, 1) * (b - a)) for p in points[1:-1]]
    if not away or max(away) <= tolerance:
        return [a, b]
    k = int(np.argmax(away)) + 1
    return plain(points[: k + 1], tolerance)[:-1] + plain(points[k:], tolerance)


def test_lines_by_recursion():
    rng = np.random.default_rng(4)
    for n in (2, 3, 10, 60):
        p = np.cumsum(rng.integers(-1, 2, (n, 2)), 0).astype(float)
        if (p[0] != p[-1]).any():
            assert np.array_equal(A.simplified(p, 1.0), np.array(plain(p, 1.0)))
    square = np.array([[0, 0], [1, 0], [2, 0], [2, 1], [2, 2], [1, 2], [0, 2], [0, 1], [0, 0]], float)
    assert A.simplified(square, 0.5).tolist() == [[0, 0], [2, 0], [2, 2], [0, 2], [0, 0]]


def test_corners_and_holes(spark):
    g = np.zeros((6, 6), int)
    g[0, 0] = g[1, 1] = 1  # touch at a corner
    g[3:6, 3:6], g[4, 4] = 2, 0
    rows = A.polygons(cells(spark, g), 0.0).collect()
    assert sorted(r["area"] for r in rows if r["label"] == 1) == [1, 1]
    assert sorted(r["area"] for r in rows if r["label"] == 2) == [-1, 9]


def test_on_the_ground(spark):
    g = np.zeros((4, 4), int)
    g[1:3, 1:3] = 1
    t = F.array(*map(F.lit, (10.0, 0.0, 3.9e6, 0.0, -10.0, 4.7e6)))
    (r,) = A.on_the_ground(A.polygons(cells(spark, g), 0.0), t, F.lit("EPSG:3857")).collect()
    assert r["ring"][0]["x"] == 3.9e6 + 10 and 235 < r["area_m2"] < 250  # 400 by the scale of Mercator at 39 degrees
    assert A.polygons(cells(spark, np.zeros((3, 3), int)), 1.0).count() == 0


@pytest.mark.parametrize("tolerance", [0.0, 0.8])
def test_tiles_make_no_difference(spark, tolerance):
    noise = np.random.default_rng(6).integers(0, 4, (70, 45))
    wide = np.ones((70, 45), int)  # one border through all tiles, and a hole that runs along it
    wide[1:-1, 1:-1] = 2
    wide[3, 3:40] = wide[3:66, 20] = 3
    df = cells(spark, noise, wide, random_map(7)).selectExpr("raster", "row - 11 AS row", "col - 30 AS col", "label").cache()

    def told(tile):
        out = []
        for r in A.polygons(df, tolerance, tile=tile).collect():
            ring = [(p["x"], p["y"]) for p in r["ring"]]
            assert ring[0] == ring[-1] and len(ring) == r["points"] + 1
            k = min(range(len(ring) - 1), key=lambda i: ring[i:-1] + ring[:i])
            out.append((r["raster"], r["label"], r["part"], ring[k:-1] + ring[:k], r["area"]))
        return sorted(out)

    whole = told(256)
    assert len({r[:3] for r in whole}) == len(whole) > 100
    assert told(1) == told(3) == told(16) == whole
    for (k, label), n in {(k, v): (g == v).sum() for k, g in enumerate((noise, wide)) for v in np.unique(g[g > 0])}.items():
        assert tolerance or sum(r[4] for r in whole if r[:2] == (k, label)) == n


def test_no_task_holds_a_label(spark):
    plan = A.polygons(cells(spark, random_map(1)), 0.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsInPandas" not in plan
