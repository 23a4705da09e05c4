"""Outlines of labelled cells, simplified so that neighbours stay joined.

Sides between cells of different labels are followed round each label, and the rings cut into arcs where more than two borders meet.  An
arc is simplified (Douglas and Peucker, ends kept) in one direction, whichever of its two labels is followed, so that both get the same
line and no gap or overlap arises.

Cells are (row, col, label), and ``raster`` if there are several; null labels and absent cells are 0, outside of all.  Rings are followed
within tiles; what leaves a tile is joined in tiles of eight times the side, and so on, so that a task holds a tile, then the lines
that cross the seams within one, and of a ring no more than its corners.  Of labels that touch at a corner only, rings stay apart there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.functions import geo
from stratum.sources.shared import stored

#: Cells a side of the tiles in which sides are followed first, and tiles a side of the next larger ones.
TILE, WIDER = 256, 8
LINES = "raster {kind}, tr int, tc int, label bigint, head bigint, tail bigint, closed boolean, x array<int>, y array<int>, f array<tinyint>"


def _number(x: np.ndarray, y: np.ndarray, way: np.ndarray) -> np.ndarray:
    """The number of the side from corner (x, y) on in direction ``way``: 0 right, 1 down, 2 left, 3 up, the next one a turn to the right, as y grows downwards."""
    return (y.astype(np.int64) << 33) | ((x.astype(np.int64) + (1 << 30)) << 2) | way


def _followed(label: np.ndarray, row: int, col: int) -> tuple[np.ndarray, ...]:
    """The directed sides that begin at the corners (row, col) and on, the label at their right hand, from cells that begin one row above and one column to the left.

    Gives x, y, label, number, the number of the side before, and flags: 1 for a corner where other than two sides meet, 2 if the lower label is at the left hand, 4 if the way turns there."""
    # the cells around a corner, in the order of turns: below right, below left, above left, above right
    around = np.stack([label[1:, 1:], label[1:, :-1], label[:-1, :-1], label[:-1, 1:]])
    many = (around != np.roll(around, 1, 0)).sum(0) > 2
    parts = []
    for way in range(4):
        right, left = around[way], around[(way - 1) % 4]  # of the side that leaves
        y, x = np.nonzero((right != left) & ((right > 0) | (right > left)))
        a, b, c = (around[(way + k) % 4][y, x] for k in (1, 2, 3))
        me = right[y, x]
        # a side comes in turning right if the next cell round is another label's, else straight on, else turning left
        turn = np.where(a != me, 1, np.where(b != me, 0, -1))
        before = (way - turn) % 4
        dx, dy = np.array([1, 0, -1, 0])[before], np.array([0, 1, 0, -1])[before]
        x, y, joint = x + col, y + row, many[y, x]
        flags = joint | ((c < me) << 1) | ((turn != 0) << 2)
        parts.append((x, y, me, _number(x, y, np.full(len(x), way)), _number(x - dx, y - dy, before), flags))
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


def _chained(head: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces put in order, where one goes on that has another's tail as its head: their order, where each line begins in it (and the end), and which lines are closed."""
    by = np.argsort(tail, kind="stable")
    at = np.minimum(np.searchsorted(tail[by], head), len(tail) - 1)
    before = np.where(tail[by][at] == head, by[at], -1)
    after = np.full(len(head), -1)
    after[before[before >= 0]] = np.flatnonzero(before >= 0)
    after_, left = after.tolist(), bytearray(b"\x01") * len(head)
    order, cuts, closed = [], [0], []
    for first in (np.flatnonzero(before < 0).tolist(), range(len(head))):
        ring = isinstance(first, range)
        for k in first:
            if not left[k]:
                continue
            while k >= 0 and left[k]:
                left[k] = 0
                order.append(k)
                k = after_[k]
            cuts.append(len(order))
            closed.append(ring)
    return np.array(order, int), np.array(cuts), np.array(closed, bool)


def _lines(cells: DataFrame, tile: int) -> DataFrame:
    """(raster, tr, tc, label, head, tail, closed, x, y, f): lines of sides within tiles, from the number of the side before to that of the last one, with their corners."""
    span = lambda c: F.explode(F.sequence(F.floor(F.col(c) / tile).cast("int"), F.floor((F.col(c) + 1) / tile).cast("int")))
    raster = "raster" if "raster" in cells.columns else F.lit(0).alias("raster")
    rows = cells.select(raster, F.col("row").cast("int"), F.col("col").cast("int"), F.coalesce(F.col("label"), F.lit(0)).cast("bigint").alias("label"))
    kind = rows.schema["raster"].dataType.simpleString()

    def each(t: pa.Table) -> pa.Table:
        tr, tc = t["tr"][0].as_py(), t["tc"][0].as_py()
        row, col = tr * tile, tc * tile
        grid = np.zeros((tile + 1, tile + 1), np.int64)
        t = t.sort_by("label")  # of cells given twice the largest label counts, in each tile
        grid[t["row"].to_numpy() - row + 1, t["col"].to_numpy() - col + 1] = t["label"].to_numpy()
        x, y, label, number, before, flags = _followed(grid, row, col)
        order, cuts, closed = _chained(before, number)
        kept = (flags[order] & 5) > 0
        corners = order[kept]
        counts = np.append(0, np.cumsum(kept))[cuts]
        return _told(t["raster"][0], tr, tc, label[order[cuts[:-1]]], before[order[cuts[:-1]]], number[order[cuts[1:] - 1]], closed, x[corners], y[corners], flags[corners] & 3, counts)

    return rows.withColumn("tr", span("row")).withColumn("tc", span("col")).groupBy("raster", "tr", "tc").applyInArrow(each, LINES.format(kind=kind))


def _told(raster: pa.Scalar, tr: int, tc: int, label, head, tail, closed, x, y, f, cuts) -> pa.Table:
    n, to = len(label), pa.array(cuts, pa.int32())
    lists = [pa.ListArray.from_arrays(to, pa.array(v.astype(t), k)) for v, t, k in ((x, np.int32, pa.int32()), (y, np.int32, pa.int32()), (f, np.int8, pa.int8()))]
    same = lambda v: pa.array(np.full(n, v, np.int32))
    columns = [pa.repeat(raster, n), same(tr), same(tc), *(pa.array(v.astype(np.int64)) for v in (label, head, tail)), pa.array(closed), *lists]
    return pa.Table.from_arrays(columns, ["raster", "tr", "tc", "label", "head", "tail", "closed", "x", "y", "f"])


def _joined(lines: DataFrame) -> DataFrame:
    """Open lines joined within tiles of WIDER times the side."""
    kind = lines.schema["raster"].dataType.simpleString()
    wider = lambda c: F.floor(F.col(c) / WIDER).cast("int").alias(c)

    def each(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        label, head, tail = (t[c].to_numpy() for c in ("label", "head", "tail"))
        order, cuts, closed = _chained(head, tail)
        parts = t.take(pa.array(order)).combine_chunks()
        counts = np.append(0, np.cumsum(parts["x"].combine_chunks().value_lengths().to_numpy()))[cuts]
        x, y, f = (parts[c].combine_chunks().flatten().to_numpy() for c in "xyf")
        return _told(t["raster"][0], t["tr"][0].as_py(), t["tc"][0].as_py(), label[order[cuts[:-1]]], head[order[cuts[:-1]]], tail[order[cuts[1:] - 1]], closed, x, y, f, counts)

    return lines.select("raster", wider("tr"), wider("tc"), "label", "head", "tail", "x", "y", "f").groupBy("raster", "tr", "tc").applyInArrow(each, LINES.format(kind=kind))


def _closed(cells: DataFrame, tile: int) -> DataFrame:
    """(raster, label, x, y, f): the corners of all rings, in order."""
    lines = stored(_lines(cells, tile))
    rings = lines.where("closed")
    low = lines.where("NOT closed").agg(F.min("tr"), F.min("tc")).first()
    if low[0] is not None:  # tiles are numbered from 0 on, as what lies on both sides of 0 would never meet in a wider one
        lines = lines.withColumns({"tr": F.col("tr") - low[0], "tc": F.col("tc") - low[1]})
    while not lines.where("NOT closed").isEmpty():
        lines = stored(_joined(lines.where("NOT closed")))
        rings = rings.unionByName(lines.where("closed"))
    return rings.select("raster", "label", "x", "y", "f")


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """Douglas and Peucker's choice of a line's points, by straight distance to the chord; a closed line is first cut at the point farthest from its ends."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    spans = [(0, len(points) - 1)]
    if len(points) > 2 and (points[0] == points[-1]).all():
        far = int(np.argmax(((points - points[0]) ** 2).sum(1)))
        keep[far] = True
        spans = [(0, far), (far, len(points) - 1)]
    while spans:
        a, b = spans.pop()
        if b - a < 2:
            continue
        p, chord = points[a + 1 : b] - points[a], points[b] - points[a]
        share = np.clip(p @ chord / max(chord @ chord, 1e-300), 0, 1)
        away = np.hypot(*(p - share[:, None] * chord).T)
        k = int(np.argmax(away))
        if away[k] > tolerance:
            keep[a + 1 + k] = True
            spans += [(a, a + 1 + k), (a + 1 + k, b)]
    return points[keep]


def _ring(points: np.ndarray, flags: np.ndarray, tolerance: float) -> np.ndarray:
    """A closed ring of corners, each of its arcs simplified with the lower label at the left hand."""
    joints = np.flatnonzero(flags & 1)
    first = joints[0] if len(joints) else np.lexsort((points[:, 1], points[:, 0]))[0]
    points, flags = np.roll(points, -first, 0), np.roll(flags, -first)
    cuts = [*(np.flatnonzero(flags & 1) if len(joints) else [0]), len(points)]
    points = np.concatenate([points, points[:1]])
    out = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        line = points[a : b + 1]
        if len(line) > 2:
            line = simplified(line, tolerance) if flags[a] & 2 else simplified(line[::-1], tolerance)[::-1]
        out.append(line[:-1])
    return np.concatenate([*out, points[:1]])


def polygons(cells: DataFrame, tolerance: float, tile: int = TILE) -> DataFrame:
    """(raster, label, part, ring, area, points): closed rings of each label in corners of cells; ``area`` in cells, negative for holes;
    ``part`` tells a label's rings apart.  Rings that simplifying leaves no area are left out."""
    rings = _closed(cells, tile)
    kind = rings.schema["raster"].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            x, y, f = (batch[c].flatten().to_numpy() for c in "xyf")
            n = batch["x"].value_lengths().to_numpy()
            starts = np.cumsum(n) - n
            # no two rings of a label have the same highest corner (of these, the first from the left)
            part = np.minimum.reduceat((y.astype(np.int64) << 32) + x, starts)
            points = np.stack([x, y], 1).astype(float)
            lines = [_ring(points[a : a + k], f[a : a + k], tolerance) if tolerance > 0 else np.concatenate([points[a : a + k], points[a : a + 1]]) for a, k in zip(starts, n, strict=True)]
            kept = np.flatnonzero([len(r) >= 4 for r in lines])
            if not len(kept):
                continue
            lines = [lines[k] for k in kept]
            area = [float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2) for r in lines]
            sizes, flat = np.array([len(r) for r in lines]), np.concatenate(lines)
            ring = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"]))
            of = batch.take(pa.array(kept))
            columns = [of["raster"], of["label"], pa.array(part[kept]), ring, pa.array(area, pa.float64()), pa.array((sizes - 1).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["raster", "label", "part", "ring", "area", "points"])

    return rings.mapInArrow(each, f"raster {kind}, label bigint, part bigint, ring array<struct<x:double,y:double>>, area double, points int")


def on_the_ground(rings: DataFrame, transform: Column, crs: Column) -> DataFrame:
    """Rings in a raster's coordinates, with ``area_m2`` of the equal-area projection (negative for holes; NULL for unknown systems)."""

    def flat(p: Column) -> Column:
        x, y = geo.equal_area(*geo.to_wgs84(p["x"], p["y"], crs))
        return F.struct(x.alias("x"), y.alias("y"))

    def placed(p: Column) -> Column:
        x, y = geo.affine(transform, p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    rows = rings.withColumn("ring", F.transform("ring", placed))
    return rows.withColumn("area_m2", F.signum("area") * geo.ring_area(F.transform("ring", flat)))
