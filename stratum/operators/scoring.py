"""From tiles to candidates: injected models over windows, detections as maps, products of a terrain, pictures, checks of grids."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.operators import candidates as C
from stratum.operators import components as G
from stratum.operators import raster as R
from stratum.operators import terrain as T

#: Transforms of two grids are equal if no coefficient differs by more.
GRID_TOLERANCE = 1e-5
#: Cells a side of the blocks in which detections are painted, and blocks painted at once.
BLOCK, STACK = 64, 64


def tiled_scores(cells: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], tile: int, overlap: int) -> DataFrame:
    """(row, col, prob): an injected model's scores of overlapping windows, blended with feathered weights.

    ``scorer`` maps windows (n, tile, tile), in which missing cells and those beyond the raster are NaN, to scores of
    the same shape.  Windows with less than a hundredth of valid cells, or none above 0.01, never reach it; cells that
    no window scores are left out.  A task holds the windows of one Arrow batch."""
    extent = cells.agg((F.max("row") + 1).alias("nr"), (F.max("col") + 1).alias("nc"))  # one row
    place = ((F.col("row") - F.col("row_off")) * tile + F.col("col") - F.col("col_off")).cast("int")
    windows = R.pixels_in_tiles(cells.select("row", "col", "v"), tile, overlap).groupBy("row_off", "col_off")
    windows = windows.agg(F.collect_list(F.struct(place.alias("p"), "v")).alias("cells"), F.max("v").alias("most"), F.count("v").alias("n"))
    windows = windows.where((F.col("most") > 0.01) & (F.col("n") >= 0.01 * F.size("cells")))

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            stack = np.full((len(pdf), tile * tile), np.nan)
            for i, (p, v) in enumerate(zip(pdf["p"], pdf["v"], strict=True)):
                stack[i, np.asarray(p)] = np.asarray(v, float)
            out = np.asarray(scorer(stack.reshape(-1, tile, tile)), float).reshape(len(pdf), -1)
            out[np.isnan(stack)] = np.nan
            yield pdf[["row_off", "col_off", "p"]].assign(score=[s[np.asarray(p)] for s, p in zip(out, pdf["p"], strict=True)])

    windows = windows.select("row_off", "col_off", F.col("cells.p").alias("p"), F.col("cells.v").alias("v"))
    scored = windows.mapInPandas(each, "row_off int, col_off int, p array<int>, score array<double>")
    scored = scored.select("row_off", "col_off", F.explode(F.arrays_zip("p", "score")).alias("c")).select("row_off", "col_off", "c.*")
    row, col = (F.col("p") / tile).cast("int"), F.col("p") % tile
    size = lambda n, at: F.least(F.lit(tile), F.col(n) - F.col(at))
    weight = R.feather(row, size("nr", "row_off"), tile, overlap) * R.feather(col, size("nc", "col_off"), tile, overlap)
    rows = scored.crossJoin(F.broadcast(extent))
    rows = rows.select((F.col("row_off") + row).alias("row"), (F.col("col_off") + col).alias("col"), F.col("score").alias("p"), weight.alias("w"), (~F.isnan("score")).alias("valid"))
    return R.blend(rows)


def scored_candidates(scores: DataFrame, width: int, cell: float = 1.0, least_area: float = 0.0, cut: float | None = None, tile: int = 256) -> DataFrame:
    """Candidate rows of a map (row, col, prob): components of the cells at or above ``cut``, by default Otsu's
    threshold, with at least ``least_area``; ids without gaps."""
    limit = R.otsu(scores.withColumnRenamed("prob", "v")) if cut is None else scores.sparkSession.range(1).select(F.lit(cut).alias("threshold"))
    mask = F.coalesce((F.col("prob") >= F.col("threshold")).cast("int"), F.lit(0))
    labels = G.label_mask(scores.crossJoin(F.broadcast(limit)).select("row", "col", mask.alias("mask")), width, tile=tile)  # one row
    boxes = G.component_boxes(labels, scores.select("row", "col", F.col("prob").alias("v")), cell, least_area)
    return C.dense_ids(boxes, ["label"], cell * cell, least_area, "cells")


def _painted(boxes: DataFrame, size: int, key: str, each: Callable[..., tuple[np.ndarray, dict]], columns: str, block: int) -> DataFrame:
    """Rows that ``each`` makes of blocks of tiles, of at most ``block`` cells a side: boxes, not their cells, are dealt to the blocks that
    they meet, and painted there from the least confidence up.

    ``each`` gets for each cell of a stack of blocks the number of the box seen there, from 1 on, or 0; the boxes' confidences and
    which of them are known; each box's block; the blocks' first rows and columns.  It gives the blocks of its rows, and columns.
    A task holds a stack of blocks and a batch of boxes; of the boxes of one block, never more than twice its cells and a batch."""
    low = lambda c: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), F.lit(size - 1)))
    high = lambda c: F.greatest(F.lit(0), F.least(F.col(c).cast("int"), F.lit(size)))
    met = lambda a, b: F.explode(F.expr(f"sequence(cast({a} div {block} AS int), cast(({b} - 1) div {block} AS int))")) if size > block else F.lit(0)
    rows = boxes.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL")
    rows = rows.select(key, F.col("conf").cast("double").alias("conf"), low("x1").alias("a"), high("x2").alias("b"), low("y1").alias("c"), high("y2").alias("d")).where("b > a AND d > c")
    place, side = [key, "br", "bc"], min(size, block)
    rows = rows.withColumn("br", met("c", "d")).withColumn("bc", met("a", "b")).repartition(*place).sortWithinPartitions(*place, "conf")

    def starts(t: pa.Table) -> np.ndarray:
        new = np.ones(len(t), bool)
        codes = [t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy(zero_copy_only=False) for c in place]
        new[1:] = np.any([c[1:] != c[:-1] for c in codes], 0)
        return np.flatnonzero(new)

    def stacks(t: pa.Table) -> Iterator[tuple]:
        at = np.append(starts(t), len(t))
        for k in range(0, len(at) - 1, STACK):
            part = at[k : k + STACK + 1]
            here = t.slice(part[0], part[-1] - part[0])
            of = np.repeat(np.arange(len(part) - 1), np.diff(part))
            top, left = (here[c].to_numpy() * block for c in ("br", "bc"))
            x1, x2 = (np.clip(here[c].to_numpy() - left, 0, side).tolist() for c in "ab")
            y1, y2 = (np.clip(here[c].to_numpy() - top, 0, side).tolist() for c in "cd")
            seen = np.zeros((len(part) - 1, side, side), np.int32)
            for i, (k, a, b, c, d) in enumerate(zip(of.tolist(), x1, x2, y1, y2, strict=True), 1):
                seen[k, c:d, a:b] = i
            first = part[:-1] - part[0]
            conf = here["conf"].combine_chunks()
            yield here, seen, conf.fill_null(0.0).to_numpy(), conf.is_valid().to_numpy(zero_copy_only=False), of, top[first], left[first], first

    def thinned(t: pa.Table) -> pa.Table:
        """What is seen of the boxes of one block so far, each cell as a box."""
        ((here, seen, _, _, _, top, left, _),) = stacks(t)
        _, r, c = np.nonzero(seen)
        i = seen[0, r, c] - 1
        order = np.argsort(i, kind="stable")
        x, y = (c + left[0])[order].astype(np.int32), (r + top[0])[order].astype(np.int32)
        cut = {"a": x, "b": x + 1, "c": y, "d": y + 1}
        out = here.take(pa.array(i[order]))
        return pa.table([pa.array(cut[n], pa.int32()) if n in cut else out[n] for n in out.column_names], out.schema)

    def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for here, *stack, first in stacks(t):
            of, out = each(*stack)
            yield from pa.table({key: here[key].take(pa.array(first[of])), **out}).to_batches()

    def batches(given: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in given:
            if not len(batch):
                continue
            t = pa.Table.from_batches([batch])
            t = t if left is None else pa.concat_tables([left, t])
            cut = starts(t)[-1]
            if cut:
                yield from told(t.slice(0, cut))
            left = t.slice(cut)
            left = thinned(left) if len(left) > 2 * side * side else left
        if left is not None:
            yield from told(left)

    return rows.mapInArrow(batches, f"{key} {rows.schema[key].dataType.simpleString()}, {columns}")


def detection_map(boxes: DataFrame, size: int, key: str = "tile_id", block: int = BLOCK) -> DataFrame:
    """(key, row, col, prob): the largest confidence of the boxes over each cell of a tile.

    Corners are cut to whole cells and to the tile; boxes without a cell, or with a missing corner, add nothing."""

    def each(seen, conf, known, of, top, left):
        k, r, c = np.nonzero(seen)
        i = seen[k, r, c] - 1
        return k, {"row": pa.array((r + top[k]).astype(np.int32)), "col": pa.array((c + left[k]).astype(np.int32)), "prob": pa.array(conf[i], pa.float64(), mask=~known[i])}

    return _painted(boxes, size, key, each, "row int, col int, prob double", block)


def detection_sums(boxes: DataFrame, size: int, key: str = "tile_id", block: int = BLOCK) -> DataFrame:
    """(key, cells, prob_max, prob_sum) of each tile of ``detection_map``, whose cells are counted by box where they are painted."""

    def each(seen, conf, known, of, top, left):
        times = np.bincount(seen.ravel(), minlength=len(conf) + 1)[1:]
        last = np.append(np.flatnonzero(of[1:] != of[:-1]), len(of) - 1)  # of the largest confidence, so it is seen
        total = np.bincount(of, np.where(known & (times > 0), conf, 0.0) * times)
        one = lambda x: pa.array(x, pa.float64(), mask=~known[last])
        return np.arange(len(seen)), {"cells": pa.array(np.bincount(of, times).astype(np.int64)), "prob_max": one(conf[last]), "prob_sum": one(total)}

    sums = _painted(boxes, size, key, each, "cells bigint, prob_max double, prob_sum double", block)
    return sums if size <= block else sums.groupBy(key).agg(F.sum("cells").alias("cells"), F.max("prob_max").alias("prob_max"), F.sum("prob_sum").alias("prob_sum"))


def png(pixels: np.ndarray) -> bytes:
    """An 8-bit PNG of (height, width) grey values or (height, width, 3) colours."""
    shape = pixels.shape
    rows = pixels.astype(np.uint8).reshape(shape[0], -1)
    raw = np.concatenate([np.zeros((shape[0], 1), np.uint8), rows], 1).tobytes()
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", shape[1], shape[0], 8, 2 if len(shape) == 3 else 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", head) + part(b"IDAT", zlib.compress(raw, 6)) + part(b"IEND", b"")


def tile_pictures(tiles: DataFrame, size: int, low: float = 2, high: float = 98) -> DataFrame:
    """(tile, url): each tile (tile, p, v) stretched between two percentiles of its own, as the data URL of a PNG.

    Missing cells are black; a tile whose percentiles are equal, or without a value, is black."""
    grey = F.coalesce(R.scale_uint8(F.col("v"), F.col("lo"), F.col("hi")), F.lit(0))
    by = tiles.groupBy("tile").agg(F.percentile("v", low / 100).alias("lo"), F.percentile("v", high / 100).alias("hi"))
    rows = tiles.join(by, "tile").select("tile", "p", F.when(F.col("hi") > F.col("lo"), grey).otherwise(0).alias("u"))
    rows = rows.groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("p", "u"))).alias("cells")).select("tile", F.col("cells.u").alias("u"))

    @F.pandas_udf("string")
    def url(u: pd.Series) -> pd.Series:
        return u.map(lambda v: "data:image/png;base64," + base64.b64encode(png(np.repeat(np.asarray(v).reshape(size, size, 1), 3, 2))).decode())

    return rows.select("tile", url("u").alias("url"))


def grid_faults(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """What keeps raster ``a`` from being read beside ``b``: of size, crs, transform (sizes, name, array of numbers)."""
    moved = F.exists(F.zip_with(a["transform"], b["transform"], lambda x, y: F.abs(x - y) > GRID_TOLERANCE), lambda x: F.coalesce(x, F.lit(True)))
    size = ~(a["height"].eqNullSafe(b["height"]) & a["width"].eqNullSafe(b["width"]))
    return F.array_compact(F.array(F.when(size, "size"), F.when(~a["crs"].eqNullSafe(b["crs"]), "crs"), F.when(F.coalesce(moved, F.lit(True)), "transform")))


def band_faults(types: Column, asked: list[int]) -> Column:
    """What keeps the bands asked for (from 1) from being read from a raster of these band types."""
    out = [F.when(F.size(types) < max(asked), "bands")]
    if len(asked) >= 5:
        eight = lambda k: F.coalesce(F.try_element_at(types, F.lit(k)).isin("uint8", "int8"), F.lit(False))
        out.append(F.when(eight(asked[3]) & eight(asked[4]), "heights of 8 bits"))
    return F.array_compact(F.array(*out))


def sheet_values(df: DataFrame) -> DataFrame:
    """Values that a sheet can hold: infinities and NaN become missing."""
    number = lambda c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).alias(c)
    return df.select(*(number(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def layer_values(df: DataFrame) -> DataFrame:
    """Values that a vector layer can hold: booleans become 0 and 1, what is neither number nor text becomes text."""
    plain = ("double", "float", "bigint", "int", "smallint", "tinyint", "string")
    return df.select(*(F.col(c) if t in plain else F.col(c).cast("int").alias(c) if t == "boolean" else F.col(c).cast("string").alias(c) for c, t in df.dtypes))
