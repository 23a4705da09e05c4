"""Derivatives kept by tile: one changed cell costs its tile and the neighbours, nothing costs nothing."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratum.operators import blocks as B
from stratum.operators import derived as D


def table(spark, *grids):
    rows = [(k, r, c, None if np.isnan(v) else float(v)) for k, g in enumerate(grids) for (r, c), v in np.ndenumerate(g)]
    return spark.createDataFrame(rows, "raster int, row int, col int, v double").repartition(3)


CHAIN = lambda g: {"m": B.box_mean(g["v"], 2)}


def same(a, b):
    key = lambda df: sorted((r["raster"], r["row"], r["col"], round(r["m"], 9)) for r in df.collect())
    return key(a) == key(b)


def test_only_what_changed(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rng = np.random.default_rng(1)
    a, b = rng.random((40, 48)), rng.random((9, 9))
    run = lambda *grids, plan="box 2": D.refreshed(table(spark, *grids), 2, CHAIN, ["m"], path, plan, tile=8)
    out, n = run(a, b)
    assert n == 30 + 4 and same(out, B.box_means(table(spark, a, b), 2, "m"))
    assert run(a, b)[1] == 0
    a[20, 20] += 1
    out, n = run(a, b)
    assert n == 9 and same(out, B.box_means(table(spark, a, b), 2, "m"))
    a[0, 0] += 1
    assert run(a, b)[1] == 4
    b[4, 4] = 0
    out, n = run(a, b)
    assert n == 4 and same(out, B.box_means(table(spark, a, b), 2, "m"))
    out, n = run(a)  # a raster that is gone
    assert n == 0 and out.where("raster = 1").count() == 0
    wider = np.pad(a, ((0, 0), (0, 3)))
    out, n = run(wider)  # other bounds: edges may lie elsewhere
    assert n == 5 * 7 and same(out, B.box_means(table(spark, wider), 2, "m"))
    assert run(wider, plan="box 3")[1] == 35
    before = D.kept(spark, path).count()
    assert D.swept(spark, path) >= 5 and D.kept(spark, path).count() == before and D.swept(spark, path) == 0


def test_an_unfinished_manifest_is_passed_over(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    g = np.random.default_rng(2).random((10, 10))
    D.refreshed(table(spark, g), 2, CHAIN, ["m"], path, "box", tile=8)
    spark.range(1).write.parquet(f"{path}/manifest/7")
    (tmp_path / "store/manifest/7/_SUCCESS").unlink()
    assert D.kept(spark, path).count() == 100 and D.refreshed(table(spark, g), 2, CHAIN, ["m"], path, "box", tile=8)[1] == 0
    with pytest.raises(ValueError, match="no complete"):
        D.kept(spark, f"file://{tmp_path}/none")


def test_order_and_doubles(spark):
    g = np.random.default_rng(3).random((6, 6))
    a = D.contents(table(spark, g), 4, 1, ["v"], "p").collect()
    b = D.contents(table(spark, g).orderBy(F.desc("row")), 4, 1, ["v"], "p").collect()
    assert sorted(a) == sorted(b)
    swapped = g.copy()
    swapped[0, 0], swapped[0, 1] = g[0, 1], g[0, 0]
    assert not {r["digest"] for r in D.contents(table(spark, swapped), 4, 1, ["v"], "p").collect()} & {r["digest"] for r in a}
