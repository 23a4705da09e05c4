"""Ground filter against plain loops; tiles, clouds, gaps, outliers and crowded cells."""

import math

import numpy as np
import pytest
from stratum.operators import pointcloud as P

RULE = P.GroundRule(cell=1.0, window=3.0, fill=3)


def scene(seed, size=16):
    """Points over a slope with a house, a plant, a low outlier, a gap and a crowded cell."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(size * size * 2):
        x, y = rng.random(2) * size
        if 9 <= x < 12 and 2 <= y < 4:
            continue
        z = 0.1 * x + 0.05 * y + rng.random() * 0.02 + (4 if 4 <= x < 8 and 5 <= y < 8 else 0) + (2 if rng.random() < 0.1 else 0)
        out.append((float(x), float(y), float(z)))
    return [*out, (13.5, 13.5, -20.0), *[(1.2, 1.3, 0.2 + k * 1e-3) for k in range(200)]]


def loops(points, rule):
    """The same rule by loops over cells: ground surface, steepness, objects by cell, and which points are ground."""
    cells = {}
    for x, y, z in points:
        key = math.floor(y / rule.cell), math.floor(x / rule.cell)
        cells[key] = min(z, cells.get(key, math.inf))
    rows, cols = range(min(k[0] for k in cells), max(k[0] for k in cells) + 1), range(min(k[1] for k in cells), max(k[1] for k in cells) + 1)
    every = [(r, c) for r in rows for c in cols]

    def filled(v):
        out = dict(v)
        for r, c in every:
            if (r, c) in v:
                continue
            for h in range(1, rule.fill + 1):
                ring = [v[a, b] for a in range(r - h, r + h + 1) for b in range(c - h, c + h + 1) if max(abs(a - r), abs(b - c)) == h and (a, b) in v]
                if ring:
                    out[r, c] = sum(ring) / len(ring)
                    break
        return out

    def diamond(v, fn, n):
        near = {k: [v[a, b] for a in range(k[0] - n, k[0] + n + 1) for b in range(k[1] - n, k[1] + n + 1) if abs(a - k[0]) + abs(b - k[1]) <= n and (a, b) in v] for k in every}
        return {k: fn(x) for k, x in near.items() if x}

    def standing(v, slope, steps):
        last, out = v, set()
        for n in range(1, steps + 1):
            opened = diamond(diamond(v, min, n), max, n)
            out |= {k for k in last if k in opened and last[k] - opened[k] > slope * rule.cell * n}
            last = opened
        return out

    low = filled(cells)
    marked = standing({k: -x for k, x in low.items()}, rule.low_slope, 1) | standing(low, rule.slope, rule.steps)
    ground = filled({k: x for k, x in cells.items() if k not in marked})

    def step(r, c, dr, dc):
        a, b = ground.get((r - dr, c - dc)), ground.get((r + dr, c + dc))
        own = ground[r, c]
        return ((own if b is None else b) - (own if a is None else a)) / ((2 if a is not None and b is not None else 1) * rule.cell)

    steep = filled({k: math.hypot(step(*k, 0, 1), step(*k, 1, 0)) for k in ground})
    flags = []
    for x, y, z in points:
        key = math.floor(y / rule.cell), math.floor(x / rule.cell)
        flags.append(key in ground and abs(z - ground[key]) <= rule.threshold + rule.scalar * steep.get(key, 0))
    return cells, ground, marked, flags


def frame(spark, *clouds):
    rows = [(k, *p) for k, points in enumerate(clouds) for p in points]
    return spark.createDataFrame([*rows, (0, None, 1.0, 1.0), (0, 1.0, float("nan"), 1.0)], "cloud int, x double, y double, z double").repartition(3)


@pytest.mark.parametrize("tile", [5, 64])
def test_ground(spark, tile):
    a, b = scene(1), scene(2, 9)
    df = frame(spark, a, b)
    got = P.surface(P.placed(df, RULE.cell), RULE, tile).collect()
    told = P.classified(df, RULE, tile).collect()
    for k, points in enumerate((a, b)):
        cells, ground, marked, flags = loops(points, RULE)
        mine = {(r["row"], r["col"]): r for r in got if r["cloud"] == k}
        assert set(mine) == set(cells) and {key for key, r in mine.items() if r["object"]} == marked & set(cells)
        assert all(mine[key]["ground"] == pytest.approx(ground[key]) for key in cells if key in ground)
        want = sorted((*p, f) for p, f in zip(points, flags, strict=True))
        assert sorted((r["x"], r["y"], r["z"], r["is_ground"]) for r in told if r["cloud"] == k) == want
    high = [r for r in told if r["cloud"] == 0 and 5 <= r["x"] < 7 and 5.5 <= r["y"] < 7.5]
    assert high and not any(r["is_ground"] for r in high) and not [r for r in told if r["z"] == -20.0][0]["is_ground"]
    assert sum(r["is_ground"] for r in told) > 0.6 * len(told)


def test_grid(spark):
    rng = np.random.default_rng(4)
    points = [(float(x), float(y), float(z)) for x, y, z in rng.random((150, 3)) * [8, 6, 2]] + [(2.5, 3.5, 9.0), (2.5, 3.5, 7.0)]
    got = {(r["row"], r["col"]): (r["v"], r["n"]) for r in P.gridded(frame(spark, points).where("cloud = 0 AND x IS NOT NULL AND NOT isnan(y)"), 1.0).collect()}
    for r in range(-1, 8):
        for c in range(-1, 10):
            near = [(math.hypot(x - c - 0.5, y - r - 0.5), z) for x, y, z in points]
            near = [(d, z) for d, z in near if d <= 1.5]
            own = [z for d, z in near if d == 0]
            if not near:
                assert (r, c) not in got
            else:
                want = sum(own) / len(own) if own else sum(z / d for d, z in near) / sum(1 / d for d, z in near)
                assert got[r, c] == (pytest.approx(want), len(near))
    assert got[3, 2][0] == 8.0


def test_terrain_stays_in_bounds(spark):
    points = scene(3, 10)
    tiles = [{(r["row"], r["col"]): r["v"] for r in P.terrain(frame(spark, points), RULE, tile).collect()} for tile in (4, 32)]
    assert tiles[0].keys() == tiles[1].keys() and all(tiles[0][k] == pytest.approx(v, abs=1e-12) for k, v in tiles[1].items())
    assert min(tiles[0])[0] >= 0 and max(r for r, _ in tiles[0]) <= 13 and all(v < 3 for v in tiles[0].values())


def test_nothing(spark):
    none = spark.createDataFrame([], "x double, y double, z double")
    assert P.terrain(none).count() == 0 and P.classified(none).count() == 0
