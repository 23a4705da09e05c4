"""Projections there and back, warping against plain interpolation, grids that are the same, apart or unknown."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratum.functions import geo
from stratum.functions import projections as J
from stratum.operators import warp as WP


@pytest.mark.parametrize("crs", ["EPSG:4326", "EPSG:3857", "EPSG:32636", "epsg:32736", "EPSG:32601"])
def test_there_and_back(crs):
    zone = int(crs[-2:]) if ":32" in crs else 36
    lon, lat = np.meshgrid(np.linspace(zone * 6 - 186, zone * 6 - 180, 13), np.linspace(-70, 80, 31))
    x, y = J.from_lonlat(crs, lon, lat)
    a, b = J.to_lonlat(crs, x, y)
    assert np.abs(a - lon).max() < 1e-9 and np.abs(b - lat).max() < 1e-9


def test_known_places_and_columns(spark):
    x, y = J.from_lonlat("EPSG:32636", np.array([33.0, 35.0]), np.array([0.0, 39.0]))
    assert x[0] == pytest.approx(500000) and y[0] == pytest.approx(0, abs=1e-6) and (x[1], y[1]) == pytest.approx((673127.2, 4318754.8), abs=2000)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "x double, y double")
    lon, lat = geo.to_wgs84(F.col("x"), F.col("y"), F.lit("EPSG:32636"))
    got = df.select(lon.alias("lon"), lat.alias("lat")).collect()
    assert [(r["lon"], r["lat"]) for r in got] == [pytest.approx((33.0, 0.0), abs=1e-8), pytest.approx((35.0, 39.0), abs=1e-8)]
    assert not J.known("EPSG:2319") and not J.known(None) and J.known("epsg:32760")
    with pytest.raises(ValueError):
        J.to_lonlat("EPSG:32661", x, y)


def cells(spark, g):
    return spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(g)], "row int, col int, v double").repartition(3)


def plain(g, source, target):
    out = np.full((target.height, target.width), np.nan)
    for r in range(target.height):
        for c in range(target.width):
            x, y = target.at(r + 0.5, c + 0.5)
            x, y = J.between(target.crs, source.crs, np.array(x), np.array(y))
            fr, fc = (float(k) - 0.5 for k in source.place(x, y))
            if not (-0.5 <= fr <= source.height - 0.5 and -0.5 <= fc <= source.width - 0.5):
                continue
            a, b = math.floor(fr), math.floor(fc)
            near = [((1 - abs(fr - i)) * (1 - abs(fc - j)), g[i, j]) for i in (a, a + 1) for j in (b, b + 1) if 0 <= i < source.height and 0 <= j < source.width and not np.isnan(g[i, j])]
            w = sum(k for k, _ in near)
            out[r, c] = sum(k * v for k, v in near) / w if w > 1e-12 else np.nan
    return out


@pytest.mark.parametrize("tile", [7, 16, 64])
def test_degrees_to_metres(spark, tile):
    g = np.random.default_rng(1).random((31, 43))
    g[4:9, 10:20] = np.nan
    source = WP.GridSpec("EPSG:4326", (1e-5, 2e-7, 35.0, 1e-7, -1e-5, 39.0), 31, 43)
    x, y = (float(k) for k in J.from_lonlat("EPSG:32636", np.array(35.0), np.array(39.0)))
    target = WP.GridSpec("EPSG:32636", (0.9, 0.05, x - 4, -0.03, -1.1, y + 5), 40, 50)
    assert WP.relation(source, target) == "warp"
    out = np.full((40, 50), np.nan)
    rows = WP.warped(cells(spark, g), source, target, tile).collect()
    for r in rows:
        out[r["row"], r["col"]] = np.nan if r["v"] is None else r["v"]
    want = plain(g, source, target)
    assert len(rows) == 2000 and (np.isnan(out) == np.isnan(want)).all() and np.nanmax(np.abs(out - want)) < 1e-6 and np.isnan(want).any() and (~np.isnan(want)).sum() > 500


def test_views_on_one_grid(spark):
    g = np.random.default_rng(2).random((8, 8))
    spec = WP.GridSpec("EPSG:3857", (2.0, 0.0, 100.0, 0.0, -2.0, 100.0), 8, 8)
    far = WP.GridSpec("EPSG:3857", (2.0, 0.0, 9000.0, 0.0, -2.0, 100.0), 8, 8)
    views = {"same": (cells(spark, g), spec), "half": (cells(spark, g), WP.GridSpec("EPSG:3857", (1.0, 0.0, 100.0, 0.0, -1.0, 100.0), 8, 8)), "far": (cells(spark, g), far), "odd": (cells(spark, g), WP.GridSpec(None, spec.transform, 8, 8))}
    out, told = WP.aligned(views, spec, 4)
    assert told == {"same": "same", "half": "warp", "far": "apart", "odd": "unknown"} and set(out) == {"same", "half"}
    half = {(r["row"], r["col"]): r["v"] for r in out["half"].collect()}
    assert half[0, 0] == pytest.approx(g[:2, :2].mean()) and half[7, 7] is None
    assert WP.warped(cells(spark, g), far, spec).where("v IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        WP.warped(cells(spark, g), WP.GridSpec("EPSG:9999", spec.transform, 8, 8), spec)
