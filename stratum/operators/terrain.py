"""Terrain products and classical scores over pixel rows, and tile scoring with an injected function."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators import blocks as B
from stratum.operators import raster as R
from stratum.sources.shared import stored

#: Weights of the terms of the relief score (fixed values): Laplacian of Gaussian, local relief, sky view (turned), slope,
#: negative openness, variance.
RELIEF_WEIGHTS = {"log": 0.30, "lrm": 0.20, "svf": 0.15, "slope": 0.15, "openness": 0.10, "variance": 0.10}
#: Scales (fixed values): of the Laplacian and the ridges, of openings; sigma of the gradient; window of the variance; sigma of the relief.
SIGMAS, SIZES, GRADIENT_SIGMA, VARIANCE_SIZE, RELIEF_SIGMA = (1.0, 2.0, 4.0, 8.0), (3, 5, 9, 15), 1.5, 7, 6.0


def local_relief(rows: DataFrame, sigma: float = RELIEF_SIGMA, tile: int = B.TILE) -> DataFrame:
    """``lrm``: height above the smoothed surface, which is mirrored at its edges."""
    return B.stencil(rows, B.gaussian_reach(sigma), lambda g: {"lrm": relief(g["v"], sigma)}, ["lrm"], tile=tile)


def relief(g: B.Grid, sigma: float) -> B.Grid:
    return B.combined(np.subtract, g, B.gaussian(g, sigma, mode="reflect"))


def position_index(rows: DataFrame, halves: tuple[int, ...] = (5, 15, 30), tile: int = B.TILE) -> DataFrame:
    """``tpi``: mean over scales of the height above the box mean, by three of its deviations, clipped to -1..1."""
    names = [f"__m{i}" for i in range(len(halves))]
    chain = lambda g: {n: B.combined(np.subtract, g["v"], B.box_mean(g["v"], h, "reflect")) for n, h in zip(names, halves, strict=True)}
    out = stored(B.stencil(rows, max(halves), chain, names, tile=tile))
    key = [c for c in out.columns if c == "raster"]
    spread = out.groupBy(*key).agg(*(F.stddev_pop(n).alias(f"{n}s") for n in names))
    one = out.join(spread, key) if key else out.crossJoin(F.broadcast(spread))  # one row
    part = lambda n: F.greatest(F.least(F.when(F.col(f"{n}s") > 0, F.col(n) / (3 * F.col(f"{n}s"))).otherwise(F.col(n)), F.lit(1.0)), F.lit(-1.0))
    return one.withColumn("tpi", sum((part(n) for n in names), F.lit(0.0)) / len(names)).drop(*names, *(f"{n}s" for n in names))


def curvature(rows: DataFrame, cell: float = 1.0, limit: float = 0.1) -> DataFrame:
    """``plan`` and ``profile`` curvature from differences of differences, clipped."""
    g = R.gradient(rows, cell)
    g = g.withColumns({"__xy": R.difference("gx", "row", cell), "__yy": R.difference("gy", "row", cell)}).withColumn("__xx", R.difference("gx", "col", cell))
    p, q = F.col("gx") * F.col("gx"), F.col("gy") * F.col("gy")
    mixed, below = 2 * F.col("__xy") * F.col("gx") * F.col("gy"), F.pow(F.greatest(p + q, F.lit(1e-10)), F.lit(1.5))
    clip = lambda x: F.greatest(F.least(x, F.lit(limit)), F.lit(-limit))
    plan, profile = -(F.col("__xx") * q - mixed + F.col("__yy") * p) / below, -(F.col("__xx") * p + mixed + F.col("__yy") * q) / below
    return g.withColumns({"plan": clip(plan), "profile": clip(profile)}).drop("gx", "gy", "__xx", "__xy", "__yy")


def hessian(rows: DataFrame, sigmas: tuple[float, ...] = SIGMAS, tile: int = B.TILE) -> DataFrame:
    """``ridge``: the largest over scales of the normalised sizes of the Hessian's smaller eigenvalue; all scales in one pass over tiles."""
    names = [f"__r{i}" for i in range(len(sigmas))]
    chain = lambda g: {n: B.ridge_size(g["v"], s) for n, s in zip(names, sigmas, strict=True)}
    out = R.normalised_columns(B.stencil(rows, B.gaussian_reach(max(sigmas)), chain, names, tile=tile), names)
    return out.withColumn("ridge", F.array_max(F.array(*names))).drop("v", *names)


def prominence(rows: DataFrame, sizes: tuple[int, ...] = SIZES, tile: int = B.TILE) -> DataFrame:
    """``prominence``: the largest of the top-hats of all sizes, each normalised."""
    names = [f"__{k}{s}" for s in sizes for k in "wb"]

    def chain(g):
        v = g["v"]
        white = {f"__w{s}": B.combined(np.subtract, v, B.opening(v, s)) for s in sizes}
        return white | {f"__b{s}": B.combined(np.subtract, B.closing(v, s), v) for s in sizes}

    out = R.normalised_columns(B.stencil(rows, 2 * max(sizes), chain, names, tile=tile), names)
    return out.withColumn("prominence", F.array_max(F.array(*names))).drop("v", *names)


def relief_score(rows: DataFrame, svf: DataFrame | int, openness: DataFrame | None = None, sigmas: tuple[float, ...] = SIGMAS, relief_sigma: float = RELIEF_SIGMA, gradient_sigma: float = GRADIENT_SIGMA, variance_size: int = VARIANCE_SIZE, tile: int = B.TILE) -> DataFrame:
    """``score``: the weighted sum of normalised terms; sky view counts turned, missing ``openness`` as 0.

    ``svf`` is a table (row, col, svf), or the radius of a sky view that the same pass over tiles computes."""
    radius = svf if isinstance(svf, int) else 0
    own = radius > 0
    names = [n for n in RELIEF_WEIGHTS if n != "openness" and (own or n != "svf")]

    def chain(g):
        v = g["v"]
        out = {"log": B.combined(lambda *x: np.max(x, 0), *(B.blob_size(v, s) for s in sigmas)), "lrm": relief(v, relief_sigma), "slope": B.gradient_size(v, gradient_sigma), "variance": B.local_variance(v, variance_size // 2)}
        return out | ({"svf": _sky_grid(v, radius)} if own else {})

    reach = max(B.gaussian_reach(max(*sigmas, relief_sigma, gradient_sigma)), variance_size // 2, radius)
    g = B.stencil(rows, reach, chain, names, tile=tile)
    key = [c for c in g.columns if c in ("raster", "row", "col")]
    if not own:
        g = g.join(svf.select(*key, "svf"), key)
    g = g.join(openness.select(*key, "openness"), key) if openness is not None else g.withColumn("openness", F.lit(0.0))
    g = R.normalised_columns(g.select(*key, *RELIEF_WEIGHTS), list(RELIEF_WEIGHTS)).withColumn("svf", 1 - F.col("svf"))
    g = R.normalised_columns(g, ["svf"])
    return g.select(*key, sum((w * F.col(n) for n, w in RELIEF_WEIGHTS.items()), F.lit(0.0)).alias("score"))


def ground(rows: DataFrame, size: int, sigma: float, tile: int = B.TILE) -> DataFrame:
    """A terrain surface from a surface with objects: opened, smoothed, and nowhere above the input.
    Missing cells count as the highest value and 100 more while opening."""
    key = [c for c in rows.columns if c == "raster"]
    high = rows.groupBy(*key).agg((F.max("v") + 100).alias("__h"))
    held = rows.join(high, key) if key else rows.crossJoin(F.broadcast(high))  # one row
    held = held.withColumn("__g", F.coalesce("v", "__h"))
    low = B.stencil(held, 2 * size + B.gaussian_reach(sigma), lambda g: {"__s": B.gaussian(B.opening(g["__g"], size), sigma)}, ["__s"], ["v", "__g"], tile)
    return low.select(*key, "row", "col", F.least("v", "__s").alias("v"))


def _sky_view(grid: np.ndarray, radius: int, directions: int, cell: float) -> np.ndarray:
    """One less the mean sine of horizon angles."""
    total = np.zeros_like(grid)
    h, w = grid.shape
    pad = np.pad(grid, radius, constant_values=-np.inf)
    for k in range(directions):
        a = 2 * math.pi * k / directions
        best = np.zeros_like(grid)
        for step in range(1, radius + 1):
            dr, dc = round(step * math.sin(a)), round(step * math.cos(a))
            rise = pad[radius + dr : radius + dr + h, radius + dc : radius + dc + w] - grid
            best = np.fmax(best, rise / (math.hypot(dr, dc) * cell))
        total += np.sin(np.arctan(best))
    return 1 - total / directions


def _sky_grid(g: B.Grid, radius: int, directions: int = 16, cell: float = 1.0) -> B.Grid:
    """Sky view of a grid; within a rim of the radius it isn't right yet, so that is cut off but for where the raster ends."""
    out = g.like(np.where(np.isnan(g.v), np.nan, _sky_view(g.v, radius, directions, cell)))
    top, left, below, right = (0 if end else radius for end in g.ends)
    return out.cut(g.row + top, g.col + left, g.v.shape[0] - top - below, g.v.shape[1] - left - right)


def sky_view(rows: DataFrame, radius: int, directions: int = 16, cell: float = 1.0, tile: int = B.TILE) -> DataFrame:
    """``svf`` of each cell, tile by tile with a halo of the radius, so that seams make no difference."""
    return B.stencil(rows, radius, lambda g: {"svf": _sky_grid(g["v"], radius, directions, cell)}, ["svf"], tile=tile).drop("v")


def gradients(g: B.Grid, cell: float = 1.0) -> tuple[B.Grid, B.Grid]:
    """Central differences along rows and along columns of cells, one-sided where a neighbour is missing."""

    def step(axis: int) -> B.Grid:
        def one(w: np.ndarray) -> np.ndarray:
            low, mid, high = w[..., 0], w[..., 1], w[..., 2]
            both = ~np.isnan(low) & ~np.isnan(high)
            return (np.where(np.isnan(high), mid, high) - np.where(np.isnan(low), mid, low)) / (np.where(both, 2.0, 1.0) * cell)

        return B.along(g, axis, 1, 1, np.nan, one)

    return tuple(B.common(step(1), step(0)))


def shades(gx: B.Grid, gy: B.Grid, azimuth: float = 315.0, altitude: float = 45.0) -> B.Grid:
    """Lambert shading in 0..255, as raster.hillshade."""
    az, alt = math.radians(azimuth), math.radians(altitude)

    def light(x, y):
        at = (math.sin(alt) - math.cos(alt) * math.sin(az) * x + math.cos(alt) * math.cos(az) * y) / np.sqrt(1 + x * x + y * y)
        return np.clip((at + 1) / 2, 0, 1) * 255

    return B.combined(light, gx, gy)


def products(rows: DataFrame, names: tuple[str, ...] = ("hillshade", "svf", "slrm", "slope"), cell: float = 1.0, relief_sigma: float = RELIEF_SIGMA, svf_radius: int = 10, tile: int = B.TILE, fill_reach: int = 0) -> DataFrame:
    """A column for each product asked for, all from one pass over tiles.

    With ``fill_reach`` missing cells take the nearest value at most so many cells away while products are computed, and are
    masked out of them afterwards."""

    def chain(g):
        v, hole = g["v"], np.isnan(g["v"].v)
        if fill_reach:
            v = B.Grid(B.nearest_valid(v.v, fill_reach), v.row, v.col, v.ends)
            top, left, below, right = (0 if end else fill_reach for end in v.ends)
            v = v.cut(v.row + top, v.col + left, v.v.shape[0] - top - below, v.v.shape[1] - left - right)
        out = {}
        if {"hillshade", "slope"} & set(names):
            gx, gy = gradients(v, cell)
            out = {"hillshade": shades(gx, gy), "slope": B.combined(lambda x, y: np.degrees(np.arctan(np.sqrt(x * x + y * y))), gx, gy)}
        if "slrm" in names:
            out["slrm"] = relief(v, relief_sigma)
        if "svf" in names:
            out["svf"] = _sky_grid(v, svf_radius, cell=cell)
        if fill_reach:
            out = {n: B.combined(lambda x, h: np.where(h, np.nan, x), x, g["v"].like(hole)) for n, x in out.items()}
        return out

    reach = fill_reach + max(1, B.gaussian_reach(relief_sigma) if "slrm" in names else 0, svf_radius if "svf" in names else 0)
    return B.stencil(rows, reach, chain, list(names), tile=tile).drop("v")


def score_tiles(tiles: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], size: int, skip: Column | None = None) -> DataFrame:
    """(tile, p, score): an injected model's score of every cell.  ``tiles`` has (tile, values array of size * size).

    Tiles for which ``skip`` holds never reach the model."""
    rows = tiles.where(~F.coalesce(skip, F.lit(False))) if skip is not None else tiles

    def each(batches):
        for pdf in batches:
            if len(pdf):
                stack = np.stack([np.array([np.nan if x is None else x for x in v], float) for v in pdf["values"]]).reshape(-1, size, size)
                yield pd.DataFrame({"tile": pdf["tile"], "scores": list(scorer(stack).reshape(len(pdf), -1))})

    scored = rows.select("tile", "values").mapInPandas(each, "tile bigint, scores array<double>")
    return scored.select("tile", F.posexplode("scores").alias("p", "score"))


def losses(pairs: DataFrame, positive_weight: float = 1.0, alpha: float = 0.25, gamma: float = 2.0, smooth: float = 1.0) -> DataFrame:
    """Dice loss, weighted cross-entropy, half of each together, and focal loss of (logit, truth): one row."""
    x, t = F.col("logit").cast("double"), F.col("truth").cast("double")
    p = 1 / (1 + F.exp(-x))
    softplus = lambda y: F.greatest(y, F.lit(0.0)) + F.log1p(F.exp(-F.abs(y)))
    plain = t * softplus(-x) + (1 - t) * softplus(x)
    cross = positive_weight * t * softplus(-x) + (1 - t) * softplus(x)
    out = pairs.agg(
        (1 - (2 * F.sum(p * t) + smooth) / (F.sum(p) + F.sum(t) + smooth)).alias("dice"), F.avg(cross).alias("cross_entropy"),
        F.avg(alpha * F.pow(1 - F.exp(-plain), F.lit(gamma)) * plain).alias("focal"),
    )
    return out.withColumn("combined", (F.col("dice") + F.col("cross_entropy")) / 2)
