"""Ground of point clouds: lowest points by cell, progressive openings, points near the surface that is left, a grid by inverse distances.

Points are (x, y, z), and ``cloud`` if there are several.  Cell (row, col) holds the points of
row * cell <= y < (row + 1) * cell and col * cell <= x < (col + 1) * cell.  Points are only ever summed up by cell or joined
with one row of their cell, so a cell that holds a third of all points is split like any skewed key; surfaces are worked on by tiles.

Points without x, y or z play no part.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators import blocks as B
from stratum.sources.shared import stored


@dataclass(frozen=True)
class GroundRule:
    """Cell size; the steepest terrain (rise over run); how far a point may lie off the surface, and how much more by unit of slope; the
    widest opening (in units of length); how far, in cells, gaps are filled from; slope that marks a low outlier."""

    cell: float = 1.0
    slope: float = 0.15
    threshold: float = 0.5
    scalar: float = 1.25
    window: float = 18.0
    fill: int = 8
    low_slope: float = 5.0

    @property
    def steps(self) -> int:
        return max(1, math.ceil(self.window / self.cell))

    @property
    def halo(self) -> int:
        """Cells that the surface of a cell can depend on: filling, low outliers, openings, filling again, gradient, filling it."""
        return self.fill + 2 + 2 * self.steps + self.fill + 1 + self.fill


def placed(points: DataFrame, cell: float) -> DataFrame:
    """Valid points with their cell: cloud, row, col, x, y, z."""
    cloud = "cloud" if "cloud" in points.columns else F.lit(0).alias("cloud")
    rows = points.select(cloud, *(F.col(c).cast("double").alias(c) for c in "xyz")).where("NOT (isnan(x) OR isnan(y) OR isnan(z)) AND x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL")
    return rows.withColumns({"row": F.floor(F.col("y") / cell).cast("int"), "col": F.floor(F.col("x") / cell).cast("int")})


def lowest(points: DataFrame) -> DataFrame:
    """(raster, row, col, v): the lowest point of each cell that has any."""
    return points.groupBy(F.col("cloud").alias("raster"), "row", "col").agg(F.min("z").alias("v"))


def gap_filled(v: np.ndarray, reach: int) -> np.ndarray:
    """Missing cells take the mean of the valid cells of the nearest square ring around them that has any, up to ``reach`` cells away.

    Rings are summed up in one order, so that the result is the same to the last bit however a raster is cut into tiles."""
    out = v.copy()
    rows, cols = np.nonzero(np.isnan(v))
    big = np.pad(v, reach, constant_values=np.nan)
    for half in range(1, reach + 1):
        if not len(rows):
            break
        total, count = np.zeros(len(rows)), np.zeros(len(rows))
        for dr in range(-half, half + 1):
            for dc in range(-half, half + 1) if abs(dr) == half else (-half, half):
                x = big[rows + dr + reach, cols + dc + reach]
                there = ~np.isnan(x)
                total += np.where(there, x, 0.0)
                count += there
        found = count > 0
        out[rows[found], cols[found]] = total[found] / count[found]
        rows, cols = rows[~found], cols[~found]
    return out


def _spread(v: np.ndarray, highest: bool) -> np.ndarray:
    """Least or greatest of each cell and its four neighbours."""
    none = -np.inf if highest else np.inf
    big = np.pad(v, 1, constant_values=none)
    pick = np.maximum if highest else np.minimum
    return pick(pick(pick(big[:-2, 1:-1], big[2:, 1:-1]), pick(big[1:-1, :-2], big[1:-1, 2:])), v)


def objects(v: np.ndarray, slope: float, cell: float, steps: int) -> np.ndarray:
    """Cells that stand out: openings by diamonds of growing radius, each held against the one before by a limit that grows with the radius."""
    hole = np.isnan(v)
    last, eroded, out = v, np.where(hole, np.inf, v), np.zeros(v.shape, bool)
    for radius in range(1, steps + 1):
        eroded = _spread(eroded, False)
        opened = np.where(np.isinf(eroded), -np.inf, eroded)
        for _ in range(radius):
            opened = _spread(opened, True)
        opened = np.where(np.isinf(opened), np.nan, opened)
        with np.errstate(invalid="ignore"):
            out |= last - opened > slope * cell * radius
        last = opened
    return out


def surface_grid(v: np.ndarray, rule: GroundRule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the lowest points of a grid: the ground surface, its steepness, and the cells taken as objects or outliers."""
    low = gap_filled(v, rule.fill)
    outlier = objects(-low, rule.low_slope, rule.cell, 1)
    marked = outlier | objects(low, rule.slope, rule.cell, rule.steps)
    ground = gap_filled(np.where(marked | np.isnan(v), np.nan, low), rule.fill)
    big = np.pad(ground, 1, constant_values=np.nan)

    def step(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        both = ~np.isnan(before) & ~np.isnan(after)
        return (np.where(np.isnan(after), ground, after) - np.where(np.isnan(before), ground, before)) / (np.where(both, 2.0, 1.0) * rule.cell)

    steep = np.hypot(step(big[1:-1, :-2], big[1:-1, 2:]), step(big[:-2, 1:-1], big[2:, 1:-1]))
    return ground, gap_filled(steep, rule.fill), marked


def surface(points: DataFrame, rule: GroundRule = GroundRule(), tile: int = B.TILE) -> DataFrame:
    """(cloud, row, col, lowest, ground, steep, object) of each cell that has points; ``points`` as of placed()."""

    def chain(g):
        ground, steep, marked = surface_grid(g["v"].v, rule)
        return {"ground": g["v"].like(ground), "steep": g["v"].like(steep), "object": g["v"].like(marked.astype(float))}

    out = B.stencil(lowest(points), rule.halo, chain, ["ground", "steep", "object"], tile=tile)
    return out.select(F.col("raster").alias("cloud"), "row", "col", F.col("v").alias("lowest"), "ground", "steep", (F.col("object") > 0).alias("object"))


def classified(points: DataFrame, rule: GroundRule = GroundRule(), tile: int = B.TILE) -> DataFrame:
    """The valid points with ``height`` above the ground surface of their cell and ``is_ground``: no farther off it than the rule allows."""
    rows = placed(points, rule.cell)
    held = rows.join(surface(rows, rule, tile).select("cloud", "row", "col", "ground", "steep"), ["cloud", "row", "col"])
    height = F.col("z") - F.col("ground")
    near = F.abs(height) <= rule.threshold + rule.scalar * F.coalesce("steep", F.lit(0.0))
    return held.select("cloud", "x", "y", "z", "row", "col", height.alias("height"), F.coalesce(near, F.lit(False)).alias("is_ground"))


def gridded(points: DataFrame, cell: float, radius: float | None = None) -> DataFrame:
    """(cloud, row, col, v, n): mean height by inverse distance of the points at most ``radius`` (1.5 cells) from a cell's middle.

    A point at the middle itself decides alone; of several such ones their mean.  Each point goes to the few cells that it reaches."""
    radius = radius or 1.5 * cell
    near = lambda c: F.explode(F.sequence(F.ceil((F.col(c) - radius) / cell - 0.5).cast("int"), F.floor((F.col(c) + radius) / cell - 0.5).cast("int")))
    spots = points.select("cloud", "x", "y", "z").withColumn("row", near("y")).withColumn("col", near("x"))
    dx, dy = F.col("x") - (F.col("col") + 0.5) * cell, F.col("y") - (F.col("row") + 0.5) * cell
    spots = spots.withColumn("d", F.sqrt(dx * dx + dy * dy)).where(F.col("d") <= radius)
    at = F.col("d") == 0
    w = F.when(~at, 1 / F.when(~at, F.col("d")))
    sums = spots.groupBy("cloud", "row", "col").agg(F.sum(w * F.col("z")).alias("s"), F.sum(w).alias("w"), F.avg(F.when(at, F.col("z"))).alias("own"), F.count(F.lit(1)).alias("n"))
    return sums.select("cloud", "row", "col", F.coalesce("own", F.try_divide("s", "w")).alias("v"), "n")


def terrain(points: DataFrame, rule: GroundRule = GroundRule(), tile: int = B.TILE, radius: float | None = None) -> DataFrame:
    """(cloud, row, col, v, n): the ground points' heights as a grid, in the bounds of each cloud."""
    rows = stored(classified(points, rule, tile))
    ends = rows.groupBy("cloud").agg(F.min("row").alias("a"), F.max("row").alias("b"), F.min("col").alias("c"), F.max("col").alias("d"))
    grid = gridded(rows.where("is_ground"), rule.cell, radius)
    return grid.join(ends, "cloud").where("row BETWEEN a AND b AND col BETWEEN c AND d").drop("a", "b", "c", "d")
