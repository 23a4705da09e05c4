"""Rasters brought onto another grid, in another coordinate system if need be: bilinear, by tiles of the target.

Each target tile asks for the source tiles that its cells fall into; source cells are shuffled to the target tiles that need them, and a
task maps the centres of a tile's cells back into the source.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions import projections as J
from stratum.sources.shared import stored

TILE = 256
#: Rasters that share less of the smaller one's extent are apart (a fixed value).
LEAST_SHARE = 0.05
#: Pairs of tiles that are sent to all tasks; more are joined.
SENT_PAIRS = 1 << 18


@dataclass(frozen=True)
class GridSpec:
    """A grid: coordinate system, (a, b, c, d, e, f) with x = c + a col + b row and y = f + d col + e row, and size."""

    crs: str | None
    transform: tuple[float, float, float, float, float, float]
    height: int
    width: int

    def at(self, row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d, e, f = self.transform
        return c + a * col + b * row, f + d * col + e * row

    def place(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fractional row and column."""
        a, b, c, d, e, f = self.transform
        det = a * e - b * d
        return (a * (y - f) - d * (x - c)) / det, (e * (x - c) - b * (y - f)) / det

    def extent(self, crs: str | None = None, steps: int = 21) -> tuple[float, float, float, float]:
        """(x1, y1, x2, y2), seen from another system by points along the edges."""
        k = np.linspace(0, 1, steps)
        rows = np.concatenate([0 * k, 0 * k + 1, k, k]) * self.height
        cols = np.concatenate([k, k, 0 * k, 0 * k + 1]) * self.width
        x, y = self.at(rows, cols)
        if crs and self.crs:
            x, y = J.between(self.crs, crs, x, y)
        return float(np.min(x)), float(np.min(y)), float(np.max(x)), float(np.max(y))


def relation(source: GridSpec, target: GridSpec, tolerance: float = 1e-9) -> str:
    """``same`` grid, ``apart`` (hardly any shared extent), ``unknown`` (no usable coordinate system), or ``warp``."""
    alike = source.crs == target.crs and (source.height, source.width) == (target.height, target.width)
    if alike and np.allclose(source.transform, target.transform, rtol=0, atol=tolerance):
        return "same"
    if source.crs != target.crs and not (J.known(source.crs) and J.known(target.crs)):
        return "unknown"
    a, b = source.extent(target.crs), target.extent()
    shared = max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    least = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
    return "apart" if least <= 0 or shared / least < LEAST_SHARE else "warp"


def _back(source: GridSpec, target: GridSpec, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the centres of target cells lie in the source, counted from the centre of its first cell."""
    x, y = target.at(rows + 0.5, cols + 0.5)
    if source.crs != target.crs:
        x, y = J.between(target.crs, source.crs, x, y)
    r, c = source.place(x, y)
    return r - 0.5, c - 0.5


def bilinear(grid: np.ndarray, top: int, left: int, r: np.ndarray, c: np.ndarray, height: int, width: int) -> np.ndarray:
    """Values at fractional places of a raster of which ``grid`` holds the part from (top, left) on.

    Missing neighbours don't count; beyond half a cell outside the raster there is no value."""
    inside = (r >= -0.5) & (r <= height - 0.5) & (c >= -0.5) & (c <= width - 0.5)
    r0, c0 = np.floor(r).astype(int), np.floor(c).astype(int)
    total, weights = np.zeros(r.shape), np.zeros(r.shape)
    for i in (0, 1):
        for j in (0, 1):
            w = (r - r0 if i else 1 - (r - r0)) * (c - c0 if j else 1 - (c - c0))
            a, b = r0 + i - top, c0 + j - left
            ok = inside & (a >= 0) & (a < grid.shape[0]) & (b >= 0) & (b < grid.shape[1])
            v = np.full(r.shape, np.nan)
            v[ok] = grid[a[ok], b[ok]]
            there = ~np.isnan(v)
            total += np.where(there, w * np.where(there, v, 0.0), 0.0)
            weights += np.where(there, w, 0.0)
    return np.where(weights > 1e-12, total / np.maximum(weights, 1e-12), np.nan)


def warped(cells: DataFrame, source: GridSpec, target: GridSpec, tile: int = TILE) -> DataFrame:
    """(row, col, v) of every target cell; ``cells`` (row, col, v) lie on the ``source`` grid.  NULL where the source has no value.

    A task holds one target tile and the source tiles that it meets."""
    spark = cells.sparkSession
    if (how := relation(source, target)) == "unknown":
        raise ValueError(f"no way from {source.crs} to {target.crs}")
    down, across = -(-target.height // tile), -(-target.width // tile)

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for k in batch["id"].to_pylist():
                i, j = divmod(k, across)
                found.append((i, j, -1, -1))  # so that tiles beyond the source are there too
                h, w = min(tile, target.height - i * tile), min(tile, target.width - j * tile)
                if how == "apart":
                    continue
                edge = np.unique(np.concatenate([np.arange(0, h, max(1, h // 16)), [h - 1]])), np.unique(np.concatenate([np.arange(0, w, max(1, w // 16)), [w - 1]]))
                rows, cols = np.meshgrid(*edge, indexing="ij")
                r, c = _back(source, target, rows + i * tile, cols + j * tile)
                r, c = r[np.isfinite(r) & np.isfinite(c)], c[np.isfinite(r) & np.isfinite(c)]
                if not len(r):
                    continue
                # between the points that were looked at a projection hardly bends: one step of them more is room enough
                room_r, room_c = 2 + np.ptp(r) / 16, 2 + np.ptp(c) / 16
                a, b = int(max(np.floor(r.min() - room_r), 0)), int(min(np.ceil(r.max() + room_r), source.height - 1))
                e, f = int(max(np.floor(c.min() - room_c), 0)), int(min(np.ceil(c.max() + room_c), source.width - 1))
                found += [(i, j, p, q) for p in range(a // tile, b // tile + 1) for q in range(e // tile, f // tile + 1)] if a <= b and e <= f else []
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int32()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int32())] * 4, ["i", "j", "p", "q"])

    pairs = stored(spark.range(down * across).mapInArrow(asked, "i int, j int, p int, q int"))
    n = pairs.count()
    rows = cells.select(F.col("row").cast("int"), F.col("col").cast("int"), F.col("v").cast("double"))
    held = rows.withColumns({"p": F.floor(F.col("row") / tile).cast("int"), "q": F.floor(F.col("col") / tile).cast("int")})
    needed = F.broadcast(pairs) if n <= SENT_PAIRS else pairs
    sent = held.join(needed, ["p", "q"]).select("i", "j", "row", "col", "v")
    frame = pairs.where("p = -1").select("i", "j", F.lit(None).cast("int").alias("row"), F.lit(None).cast("int").alias("col"), F.lit(None).cast("double").alias("v"))

    def each(t: pa.Table) -> pa.Table:
        i, j = t["i"][0].as_py(), t["j"][0].as_py()
        h, w = min(tile, target.height - i * tile), min(tile, target.width - j * tile)
        rows, cols = np.mgrid[i * tile : i * tile + h, j * tile : j * tile + w]
        t = t.filter(t["row"].is_valid())
        v = np.full((h, w), np.nan)
        if t.num_rows:
            r, c = np.asarray(t["row"]), np.asarray(t["col"])
            grid = np.full((r.max() - r.min() + 1, c.max() - c.min() + 1), np.nan)
            grid[r - r.min(), c - c.min()] = t["v"].to_numpy()
            with np.errstate(invalid="ignore"):
                at = _back(source, target, rows, cols)
            at = tuple(np.where(np.isfinite(x), x, -1e9) for x in at)
            v = bilinear(grid, int(r.min()), int(c.min()), *at, source.height, source.width)
        v = v.ravel()
        return pa.table([pa.array(rows.ravel().astype(np.int32)), pa.array(cols.ravel().astype(np.int32)), pa.array(v, mask=np.isnan(v))], ["row", "col", "v"])

    return sent.unionByName(frame).groupBy("i", "j").applyInArrow(each, "row int, col int, v double")


def aligned(views: dict[str, tuple[DataFrame, GridSpec]], target: GridSpec, tile: int = TILE) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Views brought onto one grid; and what became of each: taken as it is (``same``), ``warp``, or left out (``apart``, ``unknown``)."""
    told = {name: relation(spec, target) for name, (_, spec) in views.items()}
    out = {}
    for name, (cells, spec) in views.items():
        if told[name] in ("same", "warp"):
            out[name] = cells if told[name] == "same" else warped(cells, spec, target, tile)
    return out, told
