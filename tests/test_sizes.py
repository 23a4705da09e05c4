"""Work that grows with the answer, not with the cells behind it."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratum.operators import raster, scoring


@pytest.mark.parametrize("tile, overlap", [(32, 8), (5, 4), (8, 0), (7, 6), (1, 0)])
def test_feather_sums(spark, tile, overlap):
    n = F.col("id").cast("int") + 1
    one = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + raster.feather(i, n, tile, overlap))
    rows = spark.range(tile).select(one.alias("listed"), raster.feather_sum(n, tile, overlap).alias("summed")).collect()
    assert len(rows) == tile and all(r["summed"] == pytest.approx(r["listed"]) for r in rows)


def test_feather_weights_list_no_cells(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["feather_weights"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "cos(" not in plan.lower()


def test_detections_by_brute_force(spark):
    rng = np.random.default_rng(9)
    rows = [(int(k) if k else None, None if c < 0.1 else float(round(c, 2)), *map(float, xy)) for k, c, xy in zip(rng.integers(0, 4, 400), rng.random(400), rng.integers(-3, 22, (400, 4)) + 0.5, strict=True)]
    rows += [(9, None, 1.0, 1.0, 3.0, 4.0), (8, float("nan"), 0.0, 0.0, 2.0, 2.0), (8, 0.5, 1.0, 0.0, 3.0, 2.0)]
    want = {}
    for k, conf, x1, y1, x2, y2 in rows:
        cut = lambda v, most: max(0, min(int(v), most))
        for r in range(cut(y1, 18), cut(y2, 19)):
            for c in range(cut(x1, 18), cut(x2, 19)):
                old = want.get((k, r, c))
                want[k, r, c] = conf if old is None else old if conf is None or old != old or conf <= old else conf  # NaN is largest
    df = spark.createDataFrame(rows, "tile_id int, conf double, x1 double, y1 double, x2 double, y2 double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for block in (64, 5, 1):  # small ones are thinned many times
            got = {(r["tile_id"], r["row"], r["col"]): r["prob"] for r in scoring.detection_map(df, 19, block=block).collect()}
            assert repr(sorted(got.items(), key=repr)) == repr(sorted(want.items(), key=repr))
            sums = {r["tile_id"]: r for r in scoring.detection_sums(df, 19, block=block).collect()}
            assert sums.keys() == {k for k, _, _ in want}
            for k, r in sums.items():
                mine = [v for (t, _, _), v in want.items() if t == k]
                known = [v for v in mine if v is not None]
                assert r["cells"] == len(mine) and (r["prob_sum"] == pytest.approx(sum(known), nan_ok=True) if known else r["prob_sum"] is None and r["prob_max"] is None)
                assert not known or r["prob_max"] == pytest.approx(np.max(known), nan_ok=True)
        assert scoring.detection_sums(df.limit(0), 19).count() == 0
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_detection_map_lists_no_cells(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["detection_map"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" not in plan


def test_burning_by_brute_force(spark):
    rng = np.random.default_rng(11)
    shapes = [(k % 7, [(float(x), float(y)) for x, y in np.round(rng.random((n, 2)) * 12 - 2, 1)]) for k, n in enumerate(rng.integers(1, 7, 20))] + [(8, [(0.0, 0.0), (0.1, 0.0), (0.1, 9.0)]), (9, None), (10, [])]
    want = set()
    for key in range(11):
        sides = [(p, q) for k, r in shapes if k == key and r and len(r) >= 3 for p, q in zip(r, r[1:] + r[:1], strict=True)]
        for row in range(-4, 14):
            for col in range(-4, 14):
                y, x = row + 0.5, col + 0.5
                left = sum((a[1] <= y) != (b[1] <= y) and a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) <= x for a, b in sides)
                if left % 2:
                    want.add((key, row, col))
    df = spark.createDataFrame([(k, None if r is None else [{"x": x, "y": y} for x, y in r]) for k, r in shapes], "k int, ring array<struct<x:double,y:double>>").repartition(3)
    got = [tuple(r) for r in raster.burn(df, "k", "ring").select("k", "row", "col").collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
    sums = {r["k"]: (r["n_rows"], r["n_cells"]) for r in raster.burn_sums(df, ["k"], "ring").collect()}
    assert sums == {k: (len({r for t, r, _ in want if t == k}), sum(t == k for t, _, _ in want)) for k in {t for t, _, _ in want}}
    tall = spark.range(3).selectExpr("id", "array(struct(0D AS x, 0D AS y), struct(3D AS x, 0D AS y), struct(3D AS x, 400000D AS y), struct(0D AS x, 400000D AS y)) AS ring")
    assert {tuple(r) for r in raster.burn_sums(tall, "id", "ring", whole=True).collect()} == {(k, 400000, 1200000) for k in range(3)} and raster.burn(tall, "id", "ring", whole=True).count() == 3600000


def test_burn_triangles_shuffles_no_crossings(spark):
    import __spark_entry__ as entry

    plan = entry.queries()["burn_triangles"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Generate" not in plan
