"""Operators on small inputs whose results are worked out by hand."""

import hashlib
import io
import json
import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratum.functions import geo, text
from stratum.operators import blocks, candidates, components, evaluation, raster, sampling, scanlog, terrain
from stratum.sources import files
from stratum.streaming import scan as streams


def cells(spark, grid):
    rows = [(r, c, None if v is None else float(v)) for r, line in enumerate(grid) for c, v in enumerate(line)]
    return spark.createDataFrame(rows, "row int, col int, v double")


def grid(df, value="v"):
    rows = df.collect()
    out = np.full((max(r["row"] for r in rows) + 1, max(r["col"] for r in rows) + 1), np.nan)
    for r in rows:
        out[r["row"], r["col"]] = np.nan if r[value] is None else r[value]
    return out


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_bands_and_tiers(spark):
    bands = [one(spark, candidates.priority_band(F.lit(s).cast("double"))) for s in (0.8, 0.79, 0.6, 0.0, None)]
    assert bands == ["Yuksek", "Orta", "Orta", "Dusuk", "Bilinmiyor"]
    assert [one(spark, candidates.confidence_tier(F.lit(s).cast("double"))) for s in (0.95, 0.9, 0.75, 0.1, 0.0, None)] == ["very_high_095", "strong_090", "candidate_075", "below_075", "none", "none"]


def test_fallback(spark):
    a, b = spark.createDataFrame([(1, 0.5)], "id int, s double"), spark.createDataFrame([(2, 0.1), (3, 0.9), (4, 0.5)], "id int, s double")
    assert [r["id"] for r in candidates.with_fallback(a, b, [F.desc("s")], 2).collect()] == [1]
    assert sorted(r["id"] for r in candidates.with_fallback(a.limit(0), b, [F.desc("s")], 2).collect()) == [3, 4]


def test_suppression(spark):
    rows = [(1, 1, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 2, 1.0, 1.0, 10.0, 10.0, 0.8), (1, 3, 20.0, 0.0, 30.0, 10.0, 0.7), (1, 4, None, None, None, None, 0.1), (2, 1, 0.0, 0.0, 10.0, 10.0, 0.2)]
    df = spark.createDataFrame(rows, "tile int, ord int, x1 double, y1 double, x2 double, y2 double, conf double")
    assert sorted((r["tile"], r["ord"]) for r in candidates.suppress(df, "tile", 0.75).collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]


def test_chain_of_distances(spark):
    points = [(1, 0.0, 0.0, "a"), (2, 20.0, 0.0, "a"), (3, 40.0, 0.0, "a"), (4, 61.0, 0.0, "a"), (5, 0.0, 1.0, "b"), (6, None, None, "a"), (7, 0.0, 0.0, " "), (8, 0.0, 0.0, "Unknown"), (9, 0.0, 0.0, None)]
    df = spark.createDataFrame(points, "candidate_id bigint, x double, y double, native_crs string")
    assert {(r["id"], r["label"]) for r in components.label_edges(candidates.distance_links(df, 20.0)).collect()} == {(2, 1), (3, 1)}


def test_links_by_brute_force(spark):
    rng = np.random.default_rng(5)
    xy = np.concatenate([rng.random((150, 2)) * 40 - 20, rng.integers(0, 5, (60, 2)) * 1.0])
    df = spark.createDataFrame([(i, float(x), float(y), "a") for i, (x, y) in enumerate(xy)], "candidate_id bigint, x double, y double, native_crs string")
    near = ((xy[:, None] - xy[None]) ** 2).sum(2) <= 4.0
    label = np.arange(len(xy))
    for _ in xy:
        label = np.min(np.where(near, label[None], len(xy)), 1)
    got = {r["id"]: r["label"] for r in components.label_edges(candidates.distance_links(df, 2.0)).collect()}
    assert [got.get(i, i) for i in range(len(xy))] == label.tolist()


def test_suppression_across_tiles(spark):
    rng = np.random.default_rng(6)
    rows = [(int(i), float(x), float(y), float(x + 6), float(y + 6), None if i % 11 == 0 else round(float(c), 1)) for i, (x, y, c) in enumerate(rng.random((120, 3)) * (30, 30, 1))]
    df = spark.createDataFrame(rows, "ord bigint, x1 double, y1 double, x2 double, y2 double, conf double")
    pairs = candidates.iou_pairs(df.withColumn("k", F.lit(1)), "k", "ord", 0.3)
    kept = []
    for r in sorted(rows, key=lambda r: (float("inf") if r[5] is None else -r[5], r[0])):
        if all(one_iou(r, k) < 0.3 for k in kept):
            kept.append(r)
    assert {r["ord"] for r in components.suppress_across(df, "ord", pairs).collect()} == {r[0] for r in kept}


def one_iou(a, b):
    w, h = max(0, min(a[3], b[3]) - max(a[1], b[1])), max(0, min(a[4], b[4]) - max(a[2], b[2]))
    return w * h / (72 - w * h)


def test_ranks_and_draws(spark):
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 3 == 0 else float(rng.integers(0, 4)) / 2, None if i % 5 == 0 else 1.0, "ab"[i % 2], 1) for i in range(200)]
    df = spark.createDataFrame(rows, "candidate_id bigint, score_mean double, area_m2 double, source_label string, scale_level int").repartition(5)
    want = [r[0] for r in sorted(rows, key=lambda r: (-(-1 if r[1] is None else r[1]), -(-1 if r[2] is None else r[2]), r[3], r[4], r[0]))]
    got = {r["priority_rank"]: r["candidate_id"] for r in candidates.priority_rank(df).collect()}
    assert [got[k + 1] for k in range(200)] == want
    import hashlib

    drawn = sampling._ranked(df, ["source_label"], "candidate_id", 3).collect()
    for s in "ab":
        order = sorted((r[0] for r in rows if r[3] == s), key=lambda i: hashlib.md5(f"{i}:3".encode()).hexdigest())
        assert [r["candidate_id"] for r in sorted(drawn, key=lambda r: r["__n"]) if r["source_label"] == s] == order


def test_fingerprints(spark):
    import hashlib
    import json

    fields = {"b": F.lit("x"), "a": F.lit(1), "c": F.lit(None).cast("string")}
    raw = json.dumps({"a": 1, "b": "x", "c": None}, sort_keys=True, separators=(",", ":")).encode()
    assert one(spark, scanlog.fingerprint(fields)) == hashlib.sha256(raw).hexdigest() and one(spark, scanlog.cache_key(fields)) == hashlib.sha1(raw).hexdigest()[:16]


def test_suppressed_top_k(spark):
    g = np.zeros((12, 12))
    g[2, 2], g[2, 3], g[9, 9], g[2, 9] = 0.9, 0.8, 0.9, 0.5
    assert [(r["row"], r["col"]) for r in candidates.suppressed_top_k(cells(spark, g), 3, 2, 0.1).collect()] == [(2, 2), (9, 9), (2, 9)]


def test_components_across_seams(spark):
    rng = np.random.default_rng(1)
    mask = (rng.random((23, 31)) < 0.45).astype(int)
    df = cells(spark, mask).withColumn("mask", F.col("v").cast("int"))
    for eight in (True, False):
        got = {(r["row"], r["col"]): r["label"] for r in components.label_mask(df, 31, eight, tile=7).collect()}
        near = [(a, b) for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (eight or not (a and b))]
        want = {}
        for r, c in zip(*np.nonzero(mask), strict=True):
            if (r, c) not in want:
                stack, first = [(r, c)], r * 31 + c
                while stack:
                    p = stack.pop()
                    if p not in want and 0 <= p[0] < 23 and 0 <= p[1] < 31 and mask[p]:
                        want[p] = first
                        stack += [(p[0] + a, p[1] + b) for a, b in near]
        assert got == {(int(a), int(b)): int(v) for (a, b), v in want.items()}


def test_component_boxes(spark):
    labels = spark.createDataFrame([(1, 2, 7), (1, 3, 7), (2, 2, 7), (2, 3, 7), (0, 0, 0)], "row int, col int, label bigint")
    scores = cells(spark, [[0.1, 0, 0, 0], [0, 0, 0.7, 0.8], [0, 0, 0.9, 1.0]])
    (r,) = components.component_boxes(labels, scores, 2.0, 5.0).collect()
    assert (r["cells"], r["area"], round(r["score_mean"], 9), r["score_max"], r["row_mean"], r["col_mean"], r["col_max"]) == (4, 16.0, 0.85, 1.0, 1.5, 2.5, 3)


def test_metrics(spark):
    pairs = spark.createDataFrame([(0.1, 0), (0.2, 0), (0.0, 0), (0.9, 1), (None, 1)], "prob double, truth int")
    r = evaluation.evaluate(pairs).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"]) == (1, 0, 1, 3)
    assert evaluation.evaluate(pairs, 0.9, strict=True).first()["tp"] == 0
    assert evaluation.evaluate(pairs.limit(0), eps=None).first()["f1"] == 0
    swept = {r["threshold"]: (r["tp"], r["fp"]) for r in evaluation.sweep(pairs).collect()}
    assert swept[0.1] == (1, 2) and swept[0.2] == (1, 1) and swept[0.9] == (1, 0)
    perfect = spark.createDataFrame([(0.9, 1), (0.1, 0)], "prob double, truth int")
    assert evaluation.auc(evaluation.pr_curve(perfect)).first()["auc"] == pytest.approx(0.5, abs=0.51)


def test_clip_stretch_and_fuse(spark):
    v = lambda x: F.lit(x).cast("double")
    assert one(spark, raster.clip01(v(5.0), v(0.0), v(10.0))) == 0.5 and one(spark, raster.clip01(v(3.5), v(3.0), v(3.0))) == 0.5 and one(spark, raster.clip01(v(None), v(0.0), v(1.0))) == 0
    assert one(spark, raster.stretch_uint8(v(0.5), v(0.0), v(1.0))) == 127 and one(spark, raster.scale_uint8(v(0.5), v(0.0), v(1.0))) == 128
    assert one(spark, raster.fuse(v(1.0), v(None), 0.6)) == 0.6 and one(spark, raster.fuse(v(None), v(None), 0.6)) is None
    assert one(spark, raster.threshold(v(None), 0.5)) == 0 and one(spark, raster.ndsm(v(5.0), v(2.0))) == 3
    ramp = one(spark, raster.colour_ramp(v(None)))
    assert tuple(ramp) == (0, 0, 0) and tuple(one(spark, raster.colour_ramp(v(0.5)))) == (255, 255, 0) and tuple(one(spark, raster.colour_ramp(v(1.0)))) == (255, 0, 0) and tuple(one(spark, raster.colour_ramp(v(0.0)))) == (0, 0, 255)


def test_otsu(spark):
    low, high = np.full((5, 5), 0.1), np.full((5, 5), 0.9)
    t = raster.otsu(cells(spark, np.concatenate([low, high]))).first()["threshold"]
    assert 0.1 < t < 0.9
    assert raster.otsu(cells(spark, [[None]])).first()["threshold"] == 0.5


def filtered(g, down, across, mode):
    """Weights along columns, then along rows; ``symmetric`` mirrors the edges, ``edge`` repeats them."""
    h = len(down) // 2
    big = np.pad(g, h, mode=mode)
    one = sum(w * big[a : a + g.shape[0]] for a, w in enumerate(down))
    return sum(w * one[:, b : b + g.shape[1]] for b, w in enumerate(across))


def bell(sigma, order=0):
    x = np.arange(-int(4 * sigma + 0.5), int(4 * sigma + 0.5) + 1)
    k = np.exp(-0.5 * (x / sigma) ** 2)
    return k / k.sum() * (1, x / sigma**2, (x * x / sigma**2 - 1) / sigma**2)[order]


def norm(a):
    lo, hi = np.percentile(a, [2, 98])
    return np.clip((a - lo) / (hi - lo) if hi - lo > 1e-6 else a - lo, 0, 1)


def opened(g, size, first, then):
    """Frames of an even size reach one cell further before for minima, after for maxima."""
    for fn in (first, then):
        before = size // 2 if fn is np.min else size - 1 - size // 2
        big = np.pad(g, ((before, size - 1 - before),) * 2, mode="edge")
        g = fn([big[a : a + g.shape[0], b : b + g.shape[1]] for a in range(size) for b in range(size)], 0)
    return g


def test_terrain_scores_by_numpy(spark):
    g = np.random.default_rng(7).random((14, 17)) * 3
    df = cells(spark, g)
    flat = lambda h: np.full(2 * h + 1, 1 / (2 * h + 1))
    assert np.allclose(grid(blocks.box_means(df, 2, tile=5), "mean"), filtered(g, flat(2), flat(2), "edge")) and np.allclose(grid(blocks.box_means(df, 20, mode="reflect"), "mean"), filtered(g, flat(20), flat(20), "symmetric"))
    variance = np.maximum(filtered(g * g, flat(3), flat(3), "edge") - filtered(g, flat(3), flat(3), "edge") ** 2, 0)
    assert np.allclose(grid(blocks.variances(df, 3, tile=4), "variance"), variance)
    above = [g - filtered(g, flat(h), flat(h), "symmetric") for h in (2, 5)]
    assert np.allclose(grid(terrain.position_index(df, (2, 5)), "tpi"), np.mean([np.clip(a / (3 * a.std()), -1, 1) for a in above], 0))
    fy, fx = np.gradient(g)
    (fyy, _), (fxy, fxx) = np.gradient(fy), np.gradient(fx)
    p, q = fx**2, fy**2
    below = np.maximum(p + q, 1e-10) ** 1.5
    c = terrain.curvature(df)
    assert np.allclose(grid(c, "plan"), np.clip(-(fxx * q - 2 * fxy * fx * fy + fyy * p) / below, -0.1, 0.1)) and np.allclose(grid(c, "profile"), np.clip(-(fxx * p + 2 * fxy * fx * fy + fyy * q) / below, -0.1, 0.1))

    def second(s):
        return [filtered(g, bell(s, y), bell(s, x), "edge") for y, x in ((2, 0), (1, 1), (0, 2))]

    def ridge(s):
        yy, xy, xx = second(s)
        return norm(np.abs((xx + yy) / 2 - np.sqrt(np.maximum((xx + yy) ** 2 / 4 - (xx * yy - xy * xy), 0))))

    assert np.allclose(grid(terrain.hessian(df, (1.0, 2.0)), "ridge"), np.maximum(ridge(1.0), ridge(2.0)))
    hats = [norm(x) for s in (3, 4) for x in (g - opened(g, s, np.min, np.max), opened(g, s, np.max, np.min) - g)]
    assert np.allclose(grid(terrain.prominence(df, (3, 4)), "prominence"), np.max(hats, 0))
    svf = np.random.default_rng(8).random(g.shape)
    blob = np.max([np.abs(second(s)[0] + second(s)[2]) for s in (1.0, 2.0)], 0)
    slope = np.hypot(filtered(g, bell(1.5, 1), bell(1.5), "edge"), filtered(g, bell(1.5), bell(1.5, 1), "edge"))
    lrm = g - filtered(g, bell(2.0), bell(2.0), "symmetric")
    want = 0.3 * norm(blob) + 0.2 * norm(lrm) + 0.15 * norm(1 - norm(svf)) + 0.15 * norm(slope) + 0.1 * norm(variance)
    got = terrain.relief_score(df, cells(spark, svf).withColumnRenamed("v", "svf"), sigmas=(1.0, 2.0), relief_sigma=2.0)
    assert np.allclose(grid(got, "score"), want)


def test_percentiles_by_numpy(spark):
    rng = np.random.default_rng(3)
    for x in (rng.random(500), np.array([0.0, 10, 50, 90, 100]), np.ones(7), np.r_[np.zeros(400), rng.random(3)], np.array([4.0]), rng.integers(0, 4, 100) * 1e-9):
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
        (r,) = raster.percentiles(df, "v", 2, 98).collect()
        assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(x, [2, 98])))
    clipped = raster.normalised(cells(spark, [[0, 10, 50, 90, 100]]))
    assert np.allclose(grid(clipped), norm(np.array([[0.0, 10, 50, 90, 100]])))
    assert raster.percentiles(spark.createDataFrame([], "v double"), "v", 2, 98).first()["lo"] is None


def test_shading_and_losses_by_hand(spark):
    flat = raster.hillshade(cells(spark, np.ones((3, 3)))).first()
    assert flat["shade"] == pytest.approx((np.sin(np.pi / 4) + 1) * 127.5) and flat["shade8"] == 218
    pairs = spark.createDataFrame([(0.0, 1), (0.0, 0)], "logit double, truth int")
    r = terrain.losses(pairs).first()
    assert r["cross_entropy"] == pytest.approx(np.log(2)) and r["focal"] == pytest.approx(0.25 * 0.25 * np.log(2)) and r["dice"] == pytest.approx(1 - 2 / 3) and r["combined"] == pytest.approx((np.log(2) + 1 / 3) / 2)


def test_stencils_by_numpy(spark):
    g = np.random.default_rng(2).random((9, 11))
    df = cells(spark, g)
    gy, gx = np.gradient(g)
    assert np.allclose(grid(raster.slope(df), "slope"), np.degrees(np.arctan(np.hypot(gx, gy))))
    pad = np.pad(g, 1, mode="edge")
    low = np.min([pad[a : a + 9, b : b + 11] for a in range(3) for b in range(3)], 0)
    assert np.allclose(grid(blocks.stencil(df, 1, lambda g: {"low": blocks.extreme(g["v"], 3, False)}, ["low"], tile=4), "low"), low)
    x = np.arange(-4, 5)
    k = np.exp(-0.5 * x * x) / np.exp(-0.5 * x * x).sum()
    big = np.pad(g, 4, mode="edge")
    smooth = sum(k[a] * big[a : a + 9] for a in range(9))
    smooth = sum(k[b] * smooth[:, b : b + 11] for b in range(9))
    assert np.allclose(grid(blocks.smoothed(df, 1.0, tile=4), "smooth"), smooth)
    assert np.allclose(grid(terrain.local_relief(df, 1.0), "lrm"), g - filtered(g, bell(1.0), bell(1.0), "symmetric"))
    whole, tiled = grid(terrain.sky_view(df, 3, tile=64), "svf"), grid(terrain.sky_view(df, 3, tile=4), "svf")
    assert np.allclose(whole, tiled) and whole.max() <= 1
    assert grid(terrain.sky_view(cells(spark, np.ones((6, 6))), 2), "svf").min() == 1


def test_tiles(spark):
    tiles = [tuple(t) for t in one(spark, raster.tile_grid(F.lit(10), F.lit(7), 4, 1))]
    assert {(r, c) for r, c, *_ in tiles} == {(r, c) for r in (0, 3, 6, 9) for c in (0, 3, 6)} and (9, 6, 1, 1) in tiles
    assert len(one(spark, raster.tile_grid(F.lit(10), F.lit(7), 4, 1, full=True))) == 6 and one(spark, raster.tile_grid(F.lit(3), F.lit(7), 4, 1, full=True)) == []
    with pytest.raises(ValueError):
        raster.tile_grid(F.lit(1), F.lit(1), 4, 4)
    inside = raster.pixels_in_tiles(cells(spark, np.zeros((10, 7))), 4, 1).collect()
    want = [(r, c, a, b) for a in (0, 3, 6, 9) for b in (0, 3, 6) for r in range(a, min(a + 4, 10)) for c in range(b, min(b + 4, 7))]
    assert sorted((r["row"], r["col"], r["row_off"], r["col_off"]) for r in inside) == sorted(want)
    w = [one(spark, raster.feather(F.lit(i), F.lit(8), 8, 2)) for i in range(8)]
    assert w[0] == 0 and w[3] == 1 and w[1] == pytest.approx(0.5) and [one(spark, raster.feather(F.lit(i), F.lit(8), 8, 0)) for i in range(8)] == [1] * 8
    scores = spark.createDataFrame([(0, 0, 0.2, 1.0, True), (0, 0, 0.8, 3.0, True), (0, 1, 0.5, 0.0, True), (0, 2, None, 1.0, False)], "row int, col int, p double, w double, valid boolean")
    assert {r["col"]: r["prob"] for r in raster.blend(scores).collect()} == {0: pytest.approx(0.65), 1: 0.0, 2: None}


def test_fill_rules(spark):
    df = spark.createDataFrame([(0, 0, 0, 0, 0), (0, 0, 0, -10000, -10000), (0, 0, 0, 5, 5), (1, 0, 0, 0, 0), (0, 0, 0, -9999, 3)], "r int, g int, b int, s int, t int")
    assert [r["x"] for r in df.select(raster.implicit_fill([F.col(c) for c in "rgb"], [F.col("s"), F.col("t")]).alias("x")).collect()] == [True, True, False, False, False]


def test_splits(spark):
    two = [one(spark, sampling.split_rows_two(F.lit(r), 128, 320, 0.5)) for r in (0, 64, 192, 256)]
    assert two == ["train", "discard", "val", "val"]
    wins = spark.createDataFrame([(0, 0), (64, 0), (192, 0), (256, 0)], "row_off int, col_off int")
    assert {r["mode"] for r in sampling.split_or_fallback(wins, 128, 320, 0.5, 1).collect()} == {"spatial"}
    few = sampling.split_or_fallback(wins.where("row_off < 100"), 128, 200, 0.8, 1).collect()
    assert {r["mode"] for r in few} == {"random_fallback"} and {r["split"] for r in few} == {"train", "val"}
    assert [one(spark, sampling.split_rows_three(F.lit(r), 10, 100, 0.6, 0.2, 0.2)) for r in (0, 50, 55, 60, 75, 90, 95)] == ["train", "train", None, "val", None, "test", None]
    assert one(spark, sampling.windows_of_box(F.lit(10.0), F.lit(20.0), 16, 12, 64)) == [0, 12]
    rows = spark.createDataFrame([(i, i % 2 if i else 2) for i in range(11)], "k int, c int")
    held = sampling.holdout(rows, "c", "k", 0.2, 1).groupBy("c").agg(F.count_if("held").alias("n")).collect()
    assert {r["c"]: r["n"] for r in held} == {0: 1, 1: 1, 2: 0}
    assert sampling.negatives_to_positives(rows.where("c < 2"), "c", "k", 0.6, 1).where("c = 0").count() == 3


def test_logs(spark):
    log = spark.createDataFrame([(1, 1, 1, "a"), (1, 1, 2, "b"), (1, None, 3, "old"), (2, None, 1, "c"), (2, None, 2, "d")], "t int, c int, n int, s string")
    assert sorted((r["t"], r["s"]) for r in scanlog.with_legacy(log, "t", "c", "n").collect()) == [(1, "b"), (2, "d")]
    assert [one(spark, scanlog.error_kind(F.lit(m))) for m in ("Request timed out", "Bad JSON", "no models loaded", "the model x was\nnot found", "huh")] == ["connection_failed", "invalid_json", "model_not_loaded", "model_not_found", "api_error"]
    assert [one(spark, scanlog.transient(F.lit(m))) for m in ("HTTP 429", "bad request", None)] == [True, False, False]
    plan = {"view": "rgb", "mode": "m", "kind": "k", "fingerprint": "f"}
    assert one(spark, scanlog.matches_plan(F.lit(""), F.lit("m"), F.lit(None), F.lit("f"), plan)) and not one(spark, scanlog.matches_plan(F.lit(""), F.lit("m"), F.lit("k"), F.lit(None), plan))


def test_answers(spark):
    said = 'see {"a": 1} and {candidates: [{"x": "}"}],} or {"b": {"c": 2}} {"d'
    assert text.balanced_objects(said) == ['{"a": 1}', '{candidates: [{"x": "}"}],}', '{"b": {"c": 2}}']
    df = spark.createDataFrame([(said,), (None,), ("no",), ('{"q": 1} {"r": 2}',), ('He wrote "{" and then {"candidate": 1}',), ('{candidate: "{a: 1,}",}',), ('```json\n{"confirmed": true}\n```',)], "t string")
    assert [r["x"] for r in df.select(text.model_answer("t").alias("x")).collect()] == ['{"candidates": [{"x": "}"}]}', None, None, None, '{"candidate": 1}', '{"candidate": "{a: 1,}"}', '{"confirmed": true}']
    assert one(spark, text.csv_ints(F.lit(" 1, x,3"))) == [1, 3] and one(spark, text.trimmed_number(F.lit(0.50))) == "0.5" and one(spark, text.scale_token(F.lit(None).cast("double"))) == "-"


def test_geometry(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 3), (0, 3))))
    assert one(spark, geo.ring_area(ring)) == 12
    lon, lat = geo.to_wgs84(F.lit(500.0), F.lit(500.0), F.lit("EPSG:3857"))
    assert one(spark, lon) == pytest.approx(0.00449, abs=1e-5) and one(spark, lat) == pytest.approx(0.00449, abs=1e-5)
    x, y = geo.equal_area(F.lit(1.0), F.lit(0.0))
    assert one(spark, x) == pytest.approx(96486.3, abs=1) and one(spark, y) == pytest.approx(0, abs=1e-6)
    assert one(spark, geo.clamped_box(F.array(*map(F.lit, (-1.0, 0.0, 5.0, 9.0))), 4, 4)) == [0, 0, 4, 4] and one(spark, geo.clamped_box(F.array(F.lit(1.0)), 4, 4)) is None


def test_tiff_and_text_files(spark, tmp_path):
    image = np.array([[1.5, -9999.0], [np.nan, 4.0]], "<f4")
    body = image.tobytes()
    tags = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 32), (259, 3, 1, 1), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, len(body)), (339, 3, 1, 3)]
    out = io.BytesIO()
    out.write(b"II*\0" + struct.pack("<I", 8 + len(body) + 6) + body + b"-9999\0")
    out.write(struct.pack("<H", len(tags) + 1))
    for t, k, n, v in tags:
        out.write(struct.pack("<HHI", t, k, n) + (struct.pack("<HH", v, 0) if k == 3 else struct.pack("<I", v)))
    out.write(struct.pack("<HHII", 42113, 2, 6, 8 + len(body)) + struct.pack("<I", 0))
    (tmp_path / "a.tif").write_bytes(out.getvalue())
    got = {(r["row"], r["col"]): r["v"] for r in files.tiff_cells(spark, f"file://{tmp_path}").collect()}
    assert got == {(0, 0): 1.5, (0, 1): None, (1, 0): None, (1, 1): 4.0}
    (tmp_path / "log.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [(r["a"], r["_bad"]) for r in files.json_log(spark, f"file://{tmp_path}/log.jsonl", "a int").collect()] == [(1, None), (None, "broken")]
    assert files.newest(spark, f"file://{tmp_path}").first()["path"].endswith("log.jsonl")
    box = spark.range(1).select(F.col("id"), geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("ring"), F.array(F.lit(1)).alias("list"))
    assert '"coordinates":[[[0.0,0.0],[1.0,0.0]' in files.geojson(box, "ring").first()["value"]
    files.write_csv(box, f"file://{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["id", "ring", "list"]
    cells(spark, [[1, 2], [3, 4]]).write.parquet(f"file://{tmp_path}/cells")
    assert [r["v"] for r in files.cells(spark, f"file://{tmp_path}/cells", (1, 1), (0, 0), ["v"]).collect()] == [3.0]


def test_export_again(spark, tmp_path):
    spark.range(10).selectExpr("id", "id % 3 = 0 AS bad").write.parquet(f"file://{tmp_path}/in")
    schema = "id bigint, bad boolean"
    paths = [f"file://{tmp_path}/{n}" for n in ("good", "bad", "check")]
    for _ in range(2):
        streams.export(streams.source(spark, f"file://{tmp_path}/in", schema), *paths, valid="NOT bad").awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 6 and spark.read.parquet(paths[1]).count() == 4
    assert streams.merged(spark, paths[0], ["bad"], "id").first()["id"] == 8
    with pytest.raises(Exception):
        streams.export(streams.source(spark, f"file://{tmp_path}/in", schema), *[p + "2" for p in paths], valid="NOT bad", fatal=lambda b: b.count() > 0).awaitTermination()


def test_sheets_and_annotations(spark, tmp_path):
    import zipfile

    (tmp_path / "img1.txt").write_text("1,2,3,4,1,5,0,0\n1,2,0,4,1,5,0,0\n1,2,3\n1,2,3,4,1,11,0,0\n")
    assert [tuple(r) for r in files.annotations(spark, f"file://{tmp_path}/img1.txt").collect()] == [("img1", 1, 2, 3, 4, 5)]
    df = spark.createDataFrame([(1, "a<b", None, True), (2, "é", 1.5, False)], "n int, s string, v double, b boolean")
    assert files.write_xlsx(df, str(tmp_path / "x.xlsx")) == 2
    sheet = zipfile.ZipFile(tmp_path / "x.xlsx").read("xl/worksheets/sheet1.xml").decode()
    assert "a&lt;b" in sheet and "<v>1.5</v>" in sheet and sheet.count("<row>") == 3


def test_channels(spark):
    from stratum.functions import channels

    assert channels.mode(" TOPO7 ").computed == ("SVF", "SLRM", "Slope", "nDSM") and channels.mode("rgb3").source_bands == 3
    assert channels.mode(["r", "G", "b", "svf", "slrm"]) == channels.MODES["topo5"] and channels.band_indexes("1,2,3,0,4", 4) == (1, 2, 3, 0, 4) and channels.band_indexes(None, 7) == (1, 2, 3, 4, 5)
    for bad in (lambda: channels.mode("x"), lambda: channels.mode(["G", "R", "B"]), lambda: channels.band_indexes("1,2", 3), lambda: channels.band_indexes("", 2)):
        with pytest.raises(ValueError):
            bad()
    plan = spark.createDataFrame([("b.tif", "rgb", 1), ("a.tif", "rgb", 1), ("c.tif", "dsm", 2)], "path string, view string, p int")
    assert {(r["path"], r["reference"]) for r in channels.reference_raster(plan, F.col("p")).collect()} == {("a.tif", True), ("c.tif", False)}
    box = lambda *q: tuple(F.lit(float(x)) for x in q)
    assert one(spark, channels.overlap_share(box(0, 0, 10, 10), box(5, 0, 9, 5))) == 1.0 and one(spark, channels.overlap_share(box(0, 0, 1, 1), box(5, 5, 6, 6))) == 0


def test_shapes_by_hand(spark):
    ring = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 0), (3, 2), (0, 2))))
    got = raster.burn(spark.range(1).select("id", ring.alias("ring")), "id", "ring").collect()
    assert sorted((r["row"], r["col"]) for r in got) == [(r, c) for r in range(2) for c in range(3)]
    labels = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 1)], "row int, col int, label int")
    segments = {(r["side"], r["line"], r["start"], r["end"]) for r in raster.outline(labels).collect()}
    assert segments == {("top", 0, 0, 2), ("left", 0, 0, 2), ("bottom", 1, 1, 2), ("bottom", 2, 0, 1), ("right", 2, 0, 1), ("right", 1, 1, 2)}
    g = np.arange(12.0).reshape(3, 4)
    assert np.allclose(grid(raster.resample(cells(spark, g), (3, 4), (3, 4))), g) and np.allclose(grid(raster.resample(cells(spark, g), (3, 4), (5, 7), corners=True))[::2, ::2], g)
    tile = cells(spark, np.arange(9.0).reshape(3, 3))
    assert np.allclose(grid(raster.turned(tile, F.lit(1), 3)), np.rot90(np.arange(9.0).reshape(3, 3))) and np.allclose(grid(raster.turned(tile, F.lit(4), 3)), np.fliplr(np.arange(9.0).reshape(3, 3)))


def test_vectors(spark, tmp_path):
    from stratum.sources import vectors

    rows = spark.range(2).select("id", geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0)).alias("ring"), F.lit("né").alias("name"), F.array(F.lit(1)).alias("list"))
    assert vectors.write_gpkg(rows, "ring", str(tmp_path / "a.gpkg"), "found", 3857) == 2
    got = vectors.gpkg(spark, f"file://{tmp_path}").collect()
    assert [(r["layer"], r["srs"], r["fid"]) for r in got] == [("found", 3857, 1), ("found", 3857, 2)] and '"name": "n\\u00e9"' in got[0]["properties"]
    assert bytes(got[0]["wkb"]) == vectors.wkb_polygon([(0, 0), (2, 0), (2, 1), (0, 1)])
    head = bytearray(400)
    head[:4], head[24:26] = b"LASF", b"\x01\x02"
    struct.pack_into("<I", head, 107, 50)
    struct.pack_into("<4d", head, 179, 10.0, 0.0, 20.0, 0.0)
    (tmp_path / "p.las").write_bytes(bytes(head))
    (r,) = vectors.las_headers(spark, f"file://{tmp_path}").collect()
    assert (r["points"], r["x2"], r["y2"], r["cell"]) == (50, 10.0, 20.0, 2.0)
    np.save(tmp_path / "t.npy", np.array([[1.0, np.nan]]))
    np.savez(tmp_path / "u.npz", image=np.ones((1, 2, 2)), mask=np.zeros((2, 2), np.uint8))
    tiles = {r["name"]: (r["shape"], r["values"]) for r in vectors.numpy_tiles(spark, f"file://{tmp_path}").collect()}
    assert tiles == {"": ([1, 2], [1.0, None]), "image": ([1, 2, 2], [1.0] * 4), "mask": ([2, 2], [0.0] * 4)}


def test_rings(spark):
    ring = [(0, 0, 1), (0, 1, 1), (0, 2, 1), (1, 0, 1), (1, 2, 1), (2, 0, 1), (2, 1, 1), (2, 2, 1), (5, 5, 2), (6, 6, 2)]
    got = components.rings(raster.outline(spark.createDataFrame(ring, "row int, col int, label int"))).collect()
    sizes = sorted((r["label"], r["n"]) for r in got)
    assert sizes == [(1, 4), (1, 4), (2, 4), (2, 4)] or sizes == [(1, 4), (1, 4), (2, 8)]


def test_model_records_by_hand(spark):
    from stratum.operators import answers

    box = lambda conf, b, **more: {"confidence": conf, "candidate_type": "mound", "bbox_xyxy": b, **more}
    told = {
        "disjoint": {"candidates": [box(0.8, [0, 0, 3, 3]), box(0.9, [4, 4, 8, 8])]}, "overlap": {"candidates": [box(0.71, [1, 1, 5, 5]), box(0.92, [1, 1, 5, 5])]},
        "many": {"candidates": [box(c / 10, [c, 0, c + 1, 1]) for c in range(5)]}, "bad box": {"candidates": [box(0.9, [5, 5, 5, 8]), "text", {"candidate": False}]}, "none": {"candidates": []},
        "alone": {"candidate": True, "confidence": 3, "_candidate_type": "Tumulus", "bbox_xyxy": [0, 0, 20, 2]}, "null": {"candidates": None, "candidate": None}, "null type": box(0.5, [0, 0, 1, 1], candidate=True, candidate_type=None),
    }
    rows = [(k, json.dumps(v)) for k, v in told.items()] + [("no json", "{"), ("no answer", None), ("list", "[1]")]
    got: dict = {}
    for r in answers.records(spark.createDataFrame(rows, "tile string, answer string"), "tile", 8, 8).orderBy("tile", "candidate_index").collect():
        got.setdefault(r["tile"], []).append((r["candidate_index"], r["candidate_count"], r["conf"], r["candidate_type"], r["status"], r["x2"]))
    assert got["disjoint"] == [(1, 2, 0.9, "mound", "ok", 8.0), (2, 2, 0.8, "mound", "ok", 3.0)] and got["overlap"] == [(1, 1, 0.92, "mound", "ok", 5.0)]
    assert [(i, n, c) for i, n, c, *_ in got["many"]] == [(1, 3, 0.4), (2, 3, 0.3), (3, 3, 0.2)] and got["bad box"] == [(0, 0, 0.0, "none", "warning", None)]
    assert got["alone"] == [(1, 1, 1.0, "tumulus", "ok", 8.0)] and got["null type"] == [(1, 1, 0.5, "none", "ok", 1.0)]
    assert all(got[k] == [(0, 0, 0.0, "none", "ok", None)] for k in ("none", "null", "no json", "no answer", "list")) and len(got) == len(rows)
    assert answers.records(spark.createDataFrame([], "tile string, answer string"), "tile", 8, 8).count() == 0


def test_numbers_by_hand(spark):
    rows = spark.createDataFrame([("a", 0.0, 2, 1.0, "x"), ("b", None, 3, 0.0, None), ("c", 0.5, 1, None, "y"), ("d", None, 2, 1.0, "w")], "k string, s double, n int, area double, label string")
    assert [r["k"] for r in candidates.numbered_clusters(rows, "s", "n", "area", "label", "k").orderBy("cluster_id").collect()] == ["c", "b", "d", "a"]
    found = spark.createDataFrame([(7, 4), (9, 0), (3, 1), (12, 5)], "first int, pixels int")
    assert [(r["first"], r["id"], r["area_m2"]) for r in candidates.dense_ids(found, ["first"], 4.0, 16.0).orderBy("id").collect()] == [(7, 1, 16.0), (12, 2, 20.0)]
    names = {0: "mound", 1: " Terrace ", 2: ""}
    assert candidates.class_ids("terrace, 0,TERRACE", names) == [1, 0] and candidates.class_ids(" ALL ", names) is None and candidates.class_ids(None, names) is None
    for bad in ("2", "tomb", "mound,9", ",", " , ,"):
        with pytest.raises(ValueError):
            candidates.class_ids(bad, names)
    medians = evaluation.upper_median(spark.createDataFrame([("a", 1.0), ("a", 4.0), ("b", 3.0), ("b", 1.0), ("b", 2.0), ("c", None)], "k string, v double"), ["k"], "v")
    assert {r["k"]: r["median"] for r in medians.collect()} == {"a": 4.0, "b": 2.0, "c": None}
    assert geo.halo(0.5, (10.0, 20.0), 1.5, (3, 5)) == 40 and geo.halo(1.0) == 2 and [one(spark, geo.stencil_cells(F.lit(r), 1.0)) for r in (1.0, 20.0, 90.0)] == [10, 20, 50]


def test_places_by_hand(spark):
    at = lambda x, y, crs: tuple(one(spark, c) for c in geo.to_wgs84(F.lit(float(x)), F.lit(float(y)), F.lit(crs)))
    lon, lat = at(500000, 4200000, "EPSG:32636")
    # on the central meridian the northing is the meridian's length times the scale
    e2, p = geo.ECC**2, np.linspace(0, np.radians(lat), 200001)
    m = geo.SPHERE * (1 - e2) / (1 - e2 * np.sin(p) ** 2) ** 1.5
    assert abs(lon - 33) < 1e-12 and abs(np.trapezoid(m, p) * 0.9996 - 4200000) < 1e-3
    south = at(500000, 1e7 - 4200000, "epsg:32736")
    assert np.allclose(south, (33, -lat), atol=1e-10) and at(5, 7, "EPSG:4326") == (5.0, 7.0)
    assert at(1, 1, "EPSG:32699") == at(1, 1, "EPSG:2320") == at(1, 1, "unknown") == (None, None)
    lon, lat = at(500, 500, "EPSG:3857")
    assert abs(lon - 0.00449) < 1e-5 and abs(lat - 0.00449) < 1e-5


def test_selections_by_hand(spark):
    rows = [(i, "train", 1 if i < 2 else 0, 0.5 if i < 4 else 0.0) for i in range(10)] + [(10 + i, "val", 1 if i == 0 else 0, 0.1) for i in range(4)]
    got = sampling.selected_regions(spark.createDataFrame(rows, "id int, split string, label int, share double"), "split", "share", "label", "id", 2.0, 1).collect()
    train, val = [r for r in got if r["split"] == "train"], [r for r in got if r["split"] == "val"]
    assert sum(r["label"] for r in train) == 2 and [r["share"] for r in train if not r["label"]] == [0.0] * 4 and len(val) == 3
    w = spark.createDataFrame([("train", 0, 0), ("train", 0, 64), ("val", 0, 64)], "split string, row_off int, col_off int")
    assert sorted(map(tuple, sampling.negative_windows(w, w.where("split = 'val'")).collect())) == [("train", 0, 0), ("train", 0, 64)]
    order = w.withColumn("source_name", F.lit("s")).unionByName(spark.createDataFrame([("test", 0, 0, "a")], "split string, row_off int, col_off int, source_name string")).orderBy(*sampling.manifest_order())
    assert [r["split"] for r in order.collect()] == ["train", "train", "val", "test"]
    assert one(spark, raster.without_tall(F.lit(0.7), F.lit(3.0), 2.0)) == 0.0 and one(spark, raster.without_tall(F.lit(0.7), F.lit(None).cast("double"), 2.0)) == 0.7
    again = lambda *c: one(spark, scanlog.retryable(*map(F.lit, c)))
    assert again("error", "reasoning_only", None) and again("needs_retry", "api_error", "HTTP 429") and not again("ok", "invalid_json", "") and not again("error", "api_error", "bad request")
    plan = spark.createDataFrame([(1, 0, 0, 8, 8)], "tile_index int, tile_row int, tile_col int, tile_width int, tile_height int")
    assert scanlog.in_plan(plan.unionByName(plan.withColumn("tile_width", F.lit(9))), plan).count() == 1


def test_source_kinds_by_hand(spark):
    from stratum.functions import channels

    kind = lambda words, views, single: one(spark, channels.source_kind(F.lit(words), F.array(*map(F.lit, views)) if views else F.array().cast("array<string>"), F.lit(single)))
    assert kind("a", ["svf", "dsm"], True) == "terrain_derivative" and kind("hillshade", ["svf"], False) == "mixed_topo" and kind("Hillshade", ["svf"], True) == "hillshade"
    assert kind("slope dsm", [], True) == "slope" and kind(None, ["svf"], True) == "terrain_derivative" and kind(None, [], True) == "single_band" and kind("x", [], False) == "rgb"


def test_datasets_by_hand(spark, tmp_path):
    from stratum.operators import datasets

    rows = spark.createDataFrame([(1, 2, None), (1, 0, 5.0), (1, 1, 6.0), (2, 0, 7.0)], "tile int, p int, v double")
    tiles = datasets.tile_arrays(rows, ["tile"], "p", "v")
    assert {r["tile"]: r["values"] for r in tiles.collect()} == {1: [5.0, 6.0, None], 2: [7.0]}
    path, facts = f"file://{tmp_path}/tiles", {"bands": [1, 2, 3], "tile_size": 8}
    placed = tiles.withColumns({"split": F.lit("train"), "label": F.lit(1)})
    datasets.append_tiles(placed, path, facts)
    datasets.append_tiles(placed.where("tile = 2").withColumn("split", F.lit("val")), path, facts)
    assert sorted((r["tile"], r["split"], r["label"]) for r in datasets.tiles(spark, path).collect()) == [(1, "train", 1), (2, "train", 1), (2, "val", 1)]
    for bad in (lambda: datasets.append_tiles(placed, path, {**facts, "tile_size": 16}), lambda: datasets.append_tiles(placed.withColumn("more", F.lit(1)), path, facts)):
        with pytest.raises(ValueError):
            bad()
    said, seen = spark.createDataFrame([("a", 2, 1), ("b", 1, 0)], "split string, total long, positives long"), spark.createDataFrame([("a", 2, 1), ("c", 1, 1)], "split string, total long, positives long")
    got = {r["split"]: (r["told"], r["found"], r["agree"]) for r in datasets.reconciled(said, seen, "split", "total").collect()}
    assert got == {"a": (2, 2, True), "b": (1, None, False), "c": (None, 1, False)}
    lines = datasets.markdown(spark.createDataFrame([("x|y", 0.5, None), ("z", 0.75, 1.0)], "model string, iou double, f1 double"), "model", ["iou", "f1"])
    assert lines == ["| model | iou | f1 |", "|-|-|-|", "| z | 0.7500 | 1.0000 |", r"| x\|y | 0.5000 | - |"]


def _ramp(n, overlap):
    m = max(1, min(overlap, n // 2))
    w = np.ones(n)
    for i in range(m):
        w[i] = w[n - 1 - i] = 0.5 * (1 - np.cos(np.pi * i / m))
    return w


def test_scoring_by_numpy(spark):
    from stratum.operators import scoring

    rng = np.random.default_rng(5)
    grid = rng.random((37, 45))
    grid[10:14, 20:25] = np.nan
    grid[:8, 16:24] += 3
    grid[24:, 36:] = 0.0  # the last window of all holds nothing
    cells = spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(grid)], "row int, col int, v double")
    model = lambda x: x / (1 + np.nanmax(x, (1, 2), keepdims=True))
    got = {(r["row"], r["col"]): r["prob"] for r in scoring.tiled_scores(cells, model, 16, 4).collect()}
    a, b, seen = np.zeros(grid.shape), np.zeros(grid.shape), np.zeros(grid.shape, bool)
    for r in range(0, 37, 12):
        for c in range(0, 45, 12):
            x = grid[r : r + 16, c : c + 16]
            if np.isfinite(x).mean() < 0.01 or np.nanmax(x) <= 0.01:
                continue
            w, ok, s = np.outer(_ramp(x.shape[0], 4), _ramp(x.shape[1], 4)), np.isfinite(x), x / (1 + np.nanmax(x))
            a[r : r + 16, c : c + 16] += np.where(ok, s * w, 0)
            b[r : r + 16, c : c + 16] += np.where(ok, w, 0)
            seen[r : r + 16, c : c + 16] = True
    assert set(got) == {(int(r), int(c)) for r, c in np.argwhere(seen)} and len(got) < grid.size
    for (r, c), p in got.items():
        if np.isnan(grid[r, c]):
            assert p is None
        else:
            assert p == pytest.approx(a[r, c] / b[r, c] if b[r, c] > 0 else 0.0)
    # candidates of the map, by filling
    scores = spark.createDataFrame([(*k, p) for k, p in got.items()], "row int, col int, prob double")
    high = {k for k, p in got.items() if p is not None and p >= 0.47}
    parts, left = [], set(high)
    while left:
        todo, part = [left.pop()], []
        while todo:
            r, c = todo.pop()
            part.append((r, c))
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
        parts.append(part)
    rows = scoring.scored_candidates(scores, 45, 2.0, 12.0, cut=0.47, tile=8).collect()
    assert sorted((r["cells"], round(r["score_max"], 9)) for r in rows) == sorted((len(p), round(max(got[k] for k in p), 9)) for p in parts if len(p) >= 3) and len(rows) > 1
    assert sorted(r["id"] for r in rows) == list(range(1, len(rows) + 1))
    assert scoring.scored_candidates(scores, 45).count() >= 1  # Otsu's threshold
    nothing = scoring.tiled_scores(cells.limit(0), model, 16, 4)
    assert nothing.count() == 0


def test_detections_by_hand(spark):
    from stratum.operators import scoring

    boxes = [(1, 0.9, 1.9, 1.0, 3.2, 2.0), (1, 0.5, 2.0, 0.0, 9.0, 2.0), (1, 0.7, 3.0, 3.0, 3.5, 4.0), (2, 0.4, -5.0, -5.0, 1.0, 1.9), (2, 0.8, None, 0.0, 2.0, 2.0)]
    df = spark.createDataFrame(boxes, "tile_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    got = {(r["tile_id"], r["row"], r["col"]): r["prob"] for r in scoring.detection_map(df, 4).collect()}
    assert got == {(1, 1, 1): 0.9, (1, 1, 2): 0.9, (1, 0, 2): 0.5, (1, 0, 3): 0.5, (1, 1, 3): 0.5, (2, 0, 0): 0.4}


def test_pictures(spark):
    import base64
    import zlib

    from stratum.operators import scoring

    tiles = [(1, p, float(p)) for p in range(4)] + [(2, p, None) for p in range(4)] + [(3, p, 7.0) for p in range(4)]
    rows = scoring.tile_pictures(spark.createDataFrame(tiles, "tile int, p int, v double"), 2, 0, 100).collect()
    grey = {}
    for r in rows:
        head, _, data = r["url"].partition(",")
        raw = base64.b64decode(data)
        assert head == "data:image/png;base64" and raw[:8] == b"\x89PNG\r\n\x1a\n" and struct.unpack(">IIBB", raw[16:26]) == (2, 2, 8, 2)
        at = raw.index(b"IDAT")
        size = struct.unpack(">I", raw[at - 4 : at])[0]
        assert struct.unpack(">I", raw[at + 4 + size : at + 8 + size])[0] == zlib.crc32(raw[at : at + 4 + size])
        grey[r["tile"]] = np.frombuffer(zlib.decompress(raw[at + 4 : at + 4 + size]), np.uint8).reshape(2, 7)[:, 1::3].ravel().tolist()
    assert grey == {1: [0, 85, 170, 255], 2: [0] * 4, 3: [0] * 4}


def test_checks_and_cells_by_hand(spark):
    import datetime

    from stratum.operators import scoring

    side = lambda h, crs, t: {"height": F.lit(h), "width": F.lit(5), "crs": F.lit(crs).cast("string"), "transform": F.array(*map(F.lit, t))}
    ask = lambda a, b: spark.range(1).select(scoring.grid_faults(a, b).alias("x")).first()["x"]
    one = side(4, "EPSG:3857", (2.0, 0.0))
    assert ask(one, side(4, "EPSG:3857", (2.000001, 0.0))) == []
    assert ask(one, side(5, None, (2.1, 0.0))) == ["size", "crs", "transform"] and ask(one, side(4, "EPSG:3857", (2.0,))) == ["transform"]
    bands = lambda types, asked: spark.range(1).select(scoring.band_faults(F.array(*map(F.lit, types)), asked).alias("x")).first()["x"]
    assert bands(["uint8"] * 3, [1, 2, 3, 4]) == ["bands"] and bands(["uint8"] * 5, [1, 2, 3, 4, 5]) == ["heights of 8 bits"]
    assert bands(["uint8"] * 3 + ["float32"] * 2, [1, 2, 3, 4, 5]) == []
    df = spark.createDataFrame([(1, float("nan"), True, datetime.date(2024, 1, 2)), (2, 1.5, None, None), (3, float("-inf"), False, None)], "k int, v double, b boolean, d date")
    assert [tuple(r) for r in scoring.layer_values(scoring.sheet_values(df)).orderBy("k").collect()] == [(1, None, 1, "2024-01-02"), (2, 1.5, None, None), (3, None, 0, None)]
    cells = spark.createDataFrame([(r, c, float(r * c % 5)) for r in range(9) for c in range(7)], "row int, col int, v double")
    out = terrain.products(cells, svf_radius=2, relief_sigma=1.0, tile=4)
    assert out.columns == ["row", "col", "hillshade", "svf", "slrm", "slope"] and out.count() == 63 and out.where("hillshade IS NULL OR svf IS NULL OR slrm IS NULL OR slope IS NULL").count() == 0


def test_rows_without_a_class_stay(spark):
    rows = spark.createDataFrame([(i, [0, 1, None][i % 3], ["a", None][i % 2]) for i in range(30)], "k int, c int, s string")
    assert sampling.holdout(rows, "c", "k", 0.2, 1).count() == 30 and sampling.keep_ratio(rows, ["c"], "k", 1.0, 1).count() == 30
    held = {r["c"]: r["n"] for r in sampling.holdout(rows, "c", "k", 0.2, 1).groupBy("c").agg(F.count_if("held").alias("n")).collect()}
    assert held == {0: 2, 1: 2, None: 2}
    assert sampling.negatives_to_positives(rows, "c", "k", 9.0, 1).count() == 30 and sampling.negatives_to_positives(rows, "c", "k", 1.0, 1).count() == 20
    got = sampling.selected_regions(rows.withColumn("share", F.lit(0.0)), "s", "share", "c", "k", 1.0, 1).collect()
    assert sum(r["c"] == 0 and r["s"] is None for r in got) == 5 == sum(r["c"] == 0 and r["s"] == "a" for r in got)


def test_records_told_by_hand(spark):
    ask = lambda conf, shape, status: one(spark, scanlog.needs_review(F.lit(True), F.lit(conf), F.lit(shape), 0.5, F.lit(status)))
    assert ask(0.5, True, None) and ask(0.9, True, " ") and not ask(0.9, False, None) and not ask(0.4, True, None) and not ask(0.9, True, "ok")
    load = "Please Load a Model with lms load"
    assert one(spark, scanlog.error_kind(F.lit(load))) == "model_not_loaded" and one(spark, scanlog.transient(F.lit(load))) and one(spark, scanlog.stops_scan(F.lit("api_error"), F.lit(load)))


def test_normaliser_crops_and_counts_empty_tiles(spark):
    rows = [(t, p, None if t == 2 else 100.0 if p // 4 in (0, 3) or p % 4 in (0, 3) else float(t)) for t in range(3) for p in range(16)]
    df = spark.createDataFrame(rows, "tile int, p int, v double")
    r = raster.global_normaliser(df, 9, size=4, crop=2).first()
    assert (r["lo"], r["hi"]) == (0.0, 1.0) and raster.global_normaliser(df, 9).first()["hi"] == 100.0
    r = raster.global_normaliser(df.where("tile = 2"), 9).first()
    assert (r["lo"], r["hi"]) == (0.0, 1.0)


def test_second_layer_of_a_package(spark, tmp_path):
    from stratum.sources import vectors

    rows = spark.range(2).select("id", geo.box_ring(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(1.0)).alias("ring"))
    for layer in ("first", "second"):
        assert vectors.write_gpkg(rows, "ring", str(tmp_path / "a.gpkg"), layer, 3857) == 2
    assert {(r["layer"], r["fid"]) for r in vectors.gpkg(spark, f"file://{tmp_path}").collect()} == {(n, k) for n in ("first", "second") for k in (1, 2)}


def test_sampling_until_enough(spark):
    rows = spark.createDataFrame([(i, i % 7) for i in range(600)] + [(5, 0)], "k int, c int")
    keep = lambda r: r[1] == 0
    order = sorted((hashlib.md5(f"{k}:3".encode()).hexdigest(), k, c) for k, c in [tuple(r) for r in rows.collect()])
    want = [(k, c) for _, k, c in order if keep((k, c))]
    for target, spare in ((1, 1.0), (20, 1.01), (50, 3.0), (500, 1.2)):
        seen = []

        def accept(batch):
            seen.append(batch.count())
            return batch.where("c = 0")

        got = sampling.sampled_until(rows.repartition(3), "k", target, accept, 3, spare)
        assert sorted(tuple(r) for r in got.collect()) == sorted(want[:target]) and got.columns == ["k", "c"]
        assert sum(seen) < 601 or target > 20
    assert sampling.sampled_until(rows.limit(0), "k", 5, lambda b: b, 3).count() == 0 and sampling.sampled_until(rows, "k", 5, lambda b: b.limit(0), 3).count() == 0


def test_windows_counted_by_blocks(spark):
    rng = np.random.default_rng(5)
    g = np.where(rng.random((30, 41)) < 0.2, np.nan, rng.random((30, 41)))
    g[:, 20:] = np.minimum(g[:, 20:], 0.5)
    df = spark.createDataFrame([(r, c, None if np.isnan(v) else float(v)) for (r, c), v in np.ndenumerate(g)], "row int, col int, v double")
    for tile, stride in ((8, 4), (9, 6), (10, 7), (41, 5)):
        blocks = sampling.block_counts(df, math.gcd(tile, stride), F.col("v") > 0.6, F.col("v").isNotNull())
        want = {}
        for a in range(0, 30 - tile + 1, stride):
            for b in range(0, 41 - tile + 1, stride):
                part = g[a : a + tile, b : b + tile]
                want[a, b] = int((part > 0.6).sum()), int((~np.isnan(part)).sum())
        full = sampling.window_counts(blocks, tile, stride, 30, 41).collect()
        assert {(r["row_off"], r["col_off"]): (r["n_positive"], r["n_valid"]) for r in full} == want
        some = sampling.window_counts(blocks, tile, stride, 30, 41, positive_only=True).collect()
        assert {(r["row_off"], r["col_off"]): (r["n_positive"], r["n_valid"]) for r in some} == {k: v for k, v in want.items() if v[0]}
