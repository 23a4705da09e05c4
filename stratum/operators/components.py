"""Connected components: of edge lists, and of the set cells of a raster."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.sources.shared import dropped, stored, stored_at


def label_edges(edges: DataFrame) -> DataFrame:
    """(id, label) for the ends of edges (a, b): the smallest id that can be reached.

    Every round hangs each node's neighbours under the smallest of them; paths at least halve, so the
    rounds grow with the logarithm of the longest path. It ends when all edges are stars: no node hangs
    under two others, and none under one that hangs itself. Each round is a written table, so that lost
    executors cost one round at most; the round before it is deleted then.
    """
    now, path = stored_at(edges.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct())
    while True:
        twice = now.groupBy("hi").count().where("count > 1").select(F.col("hi").alias("id"))
        hung = now.select(F.col("lo").alias("id")).join(now.select(F.col("hi").alias("id")), "id", "left_semi")
        if twice.unionByName(hung).isEmpty():
            return now.select(F.col("hi").alias("id"), F.col("lo").alias("label"))
        ways = now.select(F.col("lo").alias("n"), F.col("hi").alias("m")).unionByName(now.select(F.col("hi").alias("n"), F.col("lo").alias("m")))
        root = ways.groupBy("n").agg(F.least(F.col("n"), F.min("m")).alias("root"))
        up = ways.join(root, "n").where("m > n").select(F.col("root").alias("lo"), F.col("m").alias("hi")).distinct()
        root = up.groupBy("hi").agg(F.min("lo").alias("root"))
        down = up.join(root, "hi").select(F.inline(F.array(F.struct(F.col("root").alias("lo"), F.col("lo").alias("hi")), F.struct(F.col("root").alias("lo"), F.col("hi")))))
        old = path
        now, path = stored_at(down.where("lo <> hi").distinct())
        dropped(now.sparkSession, old)


def _label_tile(r: np.ndarray, c: np.ndarray, eight: bool) -> np.ndarray:
    """For the set cells of a tile: the index of the first cell (row-major) of each one's component.

    Labels hang on the smallest label beside any of their cells, and then on its root, until nothing changes."""
    h, w = int(r.max() - r.min()) + 3, int(c.max() - c.min()) + 3
    place = (r - r.min() + 1) * w + (c - c.min() + 1)
    at = np.sort(place)
    index = np.full(h * w, -1, np.int64)
    index[at] = np.arange(len(at))
    steps = (-1, 1, -w, w, -w - 1, -w + 1, w - 1, w + 1) if eight else (-1, 1, -w, w)
    ends = [(np.flatnonzero(n >= 0), n[n >= 0]) for s in steps if (n := index[at + s]) is not None]
    label = np.arange(len(at))
    while True:
        up = np.arange(len(at))
        for a, b in ends:
            np.minimum.at(up, label[a], label[b])
        while (nxt := up[up]).tolist() != up.tolist():
            up = nxt
        new = up[label]
        if (new == label).all():
            break
        label = new
    origin = np.argsort(place)
    return origin[label[index[place]]]


def label_mask(pixels: DataFrame, width: int, eight: bool = True, tile: int = 256) -> DataFrame:
    """(row, col, label) of the set cells (row, col, mask > 0): ``label`` is the place (row * width + col) of the
    component's first cell.  Tiles are labelled each for itself; cells across their seams give edges between
    tile components, whose components are then found as a graph."""
    set_ = pixels.where("mask > 0").select("row", "col")
    keyed = set_.withColumns({"tr": (F.col("row") / tile).cast("int"), "tc": (F.col("col") / tile).cast("int")})

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy(), pdf["col"].to_numpy()
        first = _label_tile(r, c, eight)
        return pd.DataFrame({"row": r, "col": c, "part": r[first].astype(np.int64) * width + c[first]})

    parts = stored(keyed.groupBy("tr", "tc").applyInPandas(each, "row int, col int, part bigint"))
    border = parts.where(f"row % {tile} IN (0, {tile - 1}) OR col % {tile} IN (0, {tile - 1})")
    steps = [(0, 1), (1, 0), (1, 1), (1, -1)] if eight else [(0, 1), (1, 0)]
    ahead = border.select(F.col("part").alias("a"), F.inline(F.array(*(F.struct((F.col("row") + i).alias("row"), (F.col("col") + j).alias("col")) for i, j in steps))))
    edges = ahead.join(border.withColumnRenamed("part", "b"), ["row", "col"]).where("a <> b").select("a", "b").distinct()
    labels = label_edges(edges)
    return parts.join(labels, parts["part"] == labels["id"], "left").select("row", "col", F.coalesce("label", "part").alias("label"))


def component_boxes(labels: DataFrame, scores: DataFrame, cell: float = 1.0, least_area: float = 0.0) -> DataFrame:
    """One row per component of at least ``least_area``: cells, area, mean and largest score, centre, bounds."""
    rows = labels.join(scores, ["row", "col"])
    out = rows.groupBy("label").agg(
        F.count(F.lit(1)).alias("cells"), F.avg("v").alias("score_mean"), F.max("v").alias("score_max"), F.avg("row").alias("row_mean"), F.avg("col").alias("col_mean"),
        F.min("row").alias("row_min"), F.max("row").alias("row_max"), F.min("col").alias("col_min"), F.max("col").alias("col_max"),
    )
    return out.withColumn("area", F.col("cells") * cell * cell).where(F.col("area") >= least_area)


def suppress_across(boxes: DataFrame, order: str, pairs: DataFrame) -> DataFrame:
    """Greedy suppression over a whole table, ``pairs`` (a, b) being the boxes, by ``order``, that overlap too much.

    In each round the boxes that are stronger than all they still overlap stay, and those they overlap go: what is left
    is what a fold from the strongest to the weakest box leaves.  The rounds grow with the longest chain of falling
    strength, and the table of open pairs shrinks with each."""
    told = lambda c: boxes.select(F.col(order).alias(c), F.struct(F.coalesce("conf", F.lit(float("-inf"))).alias("k"), (-F.col(order)).alias("o")).alias(f"k{c}"))
    both = pairs.where("a <> b").join(told("a"), "a").join(told("b"), "b")
    first = F.col("ka") > F.col("kb")
    open_, path = stored_at(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("s"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("w")).distinct())
    gone, rounds = None, []
    while not open_.isEmpty():
        stay = open_.join(open_.select(F.col("w").alias("s")).distinct(), "s", "left_anti")
        new, at = stored_at(stay.select(F.col("w").alias("g")).distinct())
        gone = new if gone is None else gone.unionByName(new)
        rounds.append(at)
        left = open_.join(new, open_["s"] == new["g"], "left_anti")
        left = left.join(new, left["w"] == new["g"], "left_anti")
        old = path
        open_, path = stored_at(left)
        dropped(boxes.sparkSession, old)
    if gone is None:
        return boxes
    gone = stored(gone)  # a box goes in one round only
    for at in rounds:
        dropped(boxes.sparkSession, at)
    return boxes.join(gone, boxes[order] == gone["g"], "left_anti")


def rings(segments: DataFrame) -> DataFrame:
    """Closed rings (label, ring, n) from the outline segments of ``raster.outline``: corners in order, inside on the right
    of the way, so outer boundaries and holes run in opposite senses.  A group holds one component's boundary, not its area."""

    def trace(pdf: pd.DataFrame) -> list[list[tuple[int, int]]]:
        ways: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for side, line, a, b in zip(pdf["side"], pdf["line"], pdf["start"], pdf["end"], strict=True):
            p, q = ((a, line), (b, line)) if side in ("top", "bottom") else ((line, a), (line, b))
            if side in ("bottom", "left"):
                p, q = q, p
            ways.setdefault(p, []).append(q)
        out = []
        while ways:
            start = min(ways)
            ring, at, before = [start], start, None
            while True:
                ahead = ways[at]
                if before is not None and len(ahead) > 1:  # where two corners touch, the way turns right
                    dx, dy = at[0] - before[0], at[1] - before[1]
                    ahead.sort(key=lambda q: dx * (q[1] - at[1]) - dy * (q[0] - at[0]) < 0)
                before, to = at, ahead.pop(0)
                if not ways[before]:
                    del ways[before]
                at = to
                if at == start:
                    break
                ring.append(at)
            out.append(ring)
        return out

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            if not len(held):
                continue
            whole = held["label"] != held["label"].iloc[-1]  # the last label may go on in the next batch
            yield told(held[whole])
            held = held[~whole]
        if held is not None and len(held):
            yield told(held)

    def told(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [(label, r) for label, part in pdf.groupby("label", sort=False) for r in trace(part)]
        return pd.DataFrame({"label": [k for k, _ in out], "ring": [[{"x": float(x), "y": float(y)} for x, y in r] for _, r in out], "n": [len(r) for _, r in out]})

    kind = segments.schema["label"].dataType.simpleString()
    dealt = segments.select("label", "side", "line", "start", "end").repartition("label").sortWithinPartitions("label")
    return dealt.mapInPandas(each, f"label {kind}, ring array<struct<x: double, y: double>>, n int")
