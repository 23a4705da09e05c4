"""Candidate tables: bands, ranks, summaries, fallbacks, clusters, suppression of overlaps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.sources.shared import stored

#: Bands of the mean score (fixed values): high, medium, low, unknown.
HIGH, MEDIUM, LOW, UNKNOWN = "Yuksek", "Orta", "Dusuk", "Bilinmiyor"
#: Type of candidates that were taken for want of others (fixed value).
FALLBACK = "fallback_top_score"
#: Tiers of a confidence (fixed values), by their lower bounds.
TIERS = ((0.95, "very_high_095"), (0.90, "strong_090"), (0.75, "candidate_075"))


def priority_band(score: Column) -> Column:
    return F.when(score.isNull(), UNKNOWN).when(score >= 0.8, HIGH).when(score >= 0.6, MEDIUM).otherwise(LOW)


def confidence_tier(confidence: Column) -> Column:
    out = F.when(confidence.isNull() | (confidence <= 0), "none")
    for least, name in TIERS:
        out = out.when(confidence >= least, name)
    return out.otherwise("below_075")


def ranked(rows: DataFrame, order: list[Column], into: str) -> DataFrame:
    """Numbers from 1 in a whole order, without a window over all rows.

    Rows are dealt out by ranges of the whole order and sorted within them; a row's number is its place in its range and
    the rows of the ranges before."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = stored(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before = F.coalesce(F.sum("count").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("__part").count().select("__part", before.alias("__before"))  # a row for each range
    return dealt.join(F.broadcast(sizes), "__part").withColumn(into, (F.col("__at") + F.col("__before") + 1).cast("bigint")).drop("__part", "__at", "__before")


def priority_rank(rows: DataFrame, into: str = "priority_rank") -> DataFrame:
    """Global rank: score descending, nulls last; then area, source, scale and id."""
    score, area = F.coalesce("score_mean", F.lit(-1.0)), F.coalesce("area_m2", F.lit(-1.0))
    order = [score.desc(), area.desc(), F.asc("source_label"), F.coalesce("scale_level", F.lit(999999)).asc(), F.coalesce("candidate_id", F.lit(999999)).asc()]
    return ranked(rows, order, into)


def numbered_clusters(clusters: DataFrame, score: str, members: str, area: str, label: str, tie: str, into: str = "cluster_id") -> DataFrame:
    """Numbers of clusters: best score, members and area descending, then label. A score or area of 0 counts as a missing one."""
    told = lambda c: F.coalesce(F.nullif(F.col(c).cast("double"), F.lit(0.0)), F.lit(-1.0)).desc()
    return ranked(clusters, [told(score), F.desc(members), told(area), F.coalesce(label, F.lit("")).asc(), F.asc(tie)], into)


def dense_ids(components: DataFrame, order: list[str], cell_area: float, least: float, pixels: str = "pixels", into: str = "id") -> DataFrame:
    """Components with ``area_m2`` of at least ``least``, numbered without gaps in their order."""
    rows = components.where(F.col(pixels) > 0).withColumn("area_m2", F.col(pixels) * cell_area).where(F.col("area_m2") >= least)
    return ranked(rows, [F.asc(c) for c in order], into)


def class_ids(wanted: str | None, names: dict[int, str]) -> list[int] | None:
    """Ids of classes named, by name or id, in a comma-separated list; None for all of them.  A list without any name is refused."""
    text = (wanted or "").strip()
    if text.lower() in ("", "all"):
        return None
    parts = [p.strip() for p in text.split(",") if p.strip()]
    if not parts:
        raise ValueError(f"no classes in {text}")
    known = {str(k): k for k, v in names.items() if v.strip()} | {v.strip().lower(): k for k, v in names.items() if v.strip() and not v.strip().isdigit()}
    unknown = [p for p in parts if p.lower() not in known]
    if unknown:
        raise ValueError(f"no such classes: {', '.join(unknown)}")
    return list(dict.fromkeys(known[p.lower()] for p in parts))


def of_classes(rows: DataFrame, column: str, wanted: str | None, names: dict[int, str]) -> DataFrame:
    """The rows of the wanted classes."""
    ids = class_ids(wanted, names)
    return rows if ids is None else rows.where(F.col(column).isin(*ids))


def group_summary(rows: DataFrame) -> DataFrame:
    """Per source and scale: counts by band, mean and largest score, area and largest area; missing sources are ``''``, areas that are all missing sum up to 0."""
    band = priority_band(F.col("score_mean"))
    count = lambda b: F.count_if(band == b)
    return rows.groupBy(F.coalesce("source_label", F.lit("")).alias("source_label"), "scale_level", "scale_factor").agg(
        F.count(F.lit(1)).alias("n_candidates"), count(HIGH).alias("n_high"), count(MEDIUM).alias("n_medium"), count(LOW).alias("n_low"),
        F.avg("score_mean").alias("score_avg"), F.max("score_mean").alias("score_max"), F.coalesce(F.sum("area_m2"), F.lit(0.0)).alias("area_sum"),
        F.max("area_m2").alias("area_max"),
    )


def summary_order() -> list[Column]:
    """The order of group summaries: largest score (0 counts as missing, which is -1), count, source, scale."""
    best = F.coalesce(F.when(F.col("score_max") != 0, F.col("score_max")), F.lit(-1.0))
    return [best.desc(), F.desc("n_candidates"), F.asc("source_label"), F.coalesce("scale_level", F.lit(999_999)).asc(), F.asc_nulls_first("scale_factor")]


def summary_metrics(rows: DataFrame, clusters: DataFrame, reach: float) -> DataFrame:
    """The twelve metrics of a whole run, in long form; ``clusters`` has a row for each cluster, found at the distance ``reach``."""
    band = priority_band(F.col("score_mean"))
    label = F.trim("source_label")
    metrics = {
        "toplam_aday_sayisi": F.count(F.lit(1)), "fallback_aday_sayisi": F.count_if(F.col("candidate_type") == FALLBACK), "benzersiz_kaynak_sayisi": F.count_distinct(F.when(label != "", label)),
        "benzersiz_scale_sayisi": F.count_distinct("scale_factor"), "yuksek_oncelik_aday_sayisi": F.count_if(band == HIGH), "orta_oncelik_aday_sayisi": F.count_if(band == MEDIUM),
        "dusuk_oncelik_aday_sayisi": F.count_if(band == LOW), "score_mean_avg": F.avg("score_mean"), "score_mean_max": F.max("score_mean"), "area_m2_sum": F.sum("area_m2"),
    }
    one = rows.agg(*(m.cast("double").alias(k) for k, m in metrics.items()), F.lit(float(reach)).alias("cluster_distance_m"))
    one = one.crossJoin(F.broadcast(clusters.agg(F.count(F.lit(1)).cast("double").alias("toplam_kume_sayisi"))))  # one row
    return one.selectExpr(f"stack({len(one.columns)}, " + ", ".join(f"'{k}', {k}" for k in one.columns) + ") AS (metric, amount)")


def best_per_group(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The row of the largest score in each group; ties go to the smallest ``tie``; null scores come last."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(score), F.lit(-1.0)), -F.col(tie)))
    return rows.groupBy(*keys).agg(best.alias("b")).select(*keys, *(f"b.{c}" for c in rest))


def with_fallback(primary: DataFrame, fallback: DataFrame, order: list[Column], k: int) -> DataFrame:
    """``primary``, or the first k rows of ``fallback`` where it is empty."""
    empty = primary.limit(1).agg(F.count(F.lit(1)).alias("__n")).where("__n = 0").select(F.lit(True).alias("__empty"))  # one row or none
    return primary.unionByName(fallback.orderBy(*order).limit(k).join(F.broadcast(empty)).drop("__empty"))


def top_n(rows: DataFrame, key: str, order: list[Column], n: int, into: str = "rank") -> DataFrame:
    """The first n rows of each key."""
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(into) <= n)


def sequence_fields(rows: DataFrame, key: str, order: str) -> DataFrame:
    """``candidate_index`` from 1 and ``candidate_count`` within each tile."""
    w = Window.partitionBy(key)
    return rows.withColumns({"candidate_index": F.row_number().over(w.orderBy(order)), "candidate_count": F.count(F.lit(1)).over(w)})


def exportable(candidate: Column, confidence: Column, threshold: float, has_geometry: Column) -> Column:
    return candidate & (confidence >= threshold) & has_geometry


def not_found_reason(status: Column, candidate: Column, has_geometry: Column, confidence: Column, review_status: Column, review_confirmed: Column, review_confidence: Column, threshold: float) -> Column:
    """Why a record isn't among the confirmed ones; the first reason that holds. Missing confidences count as 0."""
    plain = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    confirmed, least = F.coalesce(review_confirmed, F.lit(False)), F.lit(threshold)
    return (
        F.when(plain(status).isin("skipped", "needs_retry", "error", "warning"), plain(status))
        .when(~F.coalesce(candidate, F.lit(False)), "no_candidate")
        .when(~has_geometry, "missing_geometry")
        .when(plain(review_status) == "error", "review_error")
        .when(confirmed & (F.coalesce(review_confidence, F.lit(0.0)) < least), "review_below_threshold")
        .when((plain(review_status) == "ok") & ~confirmed, "review_rejected")
        .when(F.coalesce(confidence, F.lit(0.0)) >= least, "not_reviewed")
        .otherwise("below_threshold")
    )


def review_confirmed(candidate: Column, confidence: Column, has_geometry: Column, confirmed: Column, review_confidence: Column, threshold: float) -> Column:
    """Exportable, and confirmed by a review with enough confidence."""
    return exportable(candidate, confidence, threshold, has_geometry) & F.coalesce(confirmed, F.lit(False)) & (F.coalesce(review_confidence, F.lit(0.0)) >= threshold)


def review_lists(rows: DataFrame, exported: Column, confirmed: Column, confidence: str = "confidence", tile: str = "tile_index") -> DataFrame:
    """The exportable rows (``stage`` 1), and those of them that a review confirmed (``stage`` 2), each by falling confidence, then tile."""
    stages = F.filter(F.array(F.when(exported, 1), F.when(confirmed, 2)), lambda x: x.isNotNull())
    return rows.withColumn("stage", F.explode(stages)).orderBy("stage", F.coalesce(F.col(confidence), F.lit(0.0)).desc(), tile)


def bbox_iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where one is missing or has no area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    size = lambda q: F.greatest(q[2] - q[0], F.lit(0.0)) * F.greatest(q[3] - q[1], F.lit(0.0))
    union = size(a) + size(b) - w * h
    return F.coalesce(F.when(union > 0, w * h / union), F.lit(0.0))


def iou_pairs(rows: DataFrame, key: str, order: str, least: float) -> DataFrame:
    """Pairs of boxes of one key that overlap by at least ``least``: (key, a, b, iou) with a before b."""
    side = lambda s: rows.select(key, *(F.col(c).alias(f"{c}_{s}") for c in (order, "x1", "y1", "x2", "y2")))
    pairs = side("a").join(side("b"), key).where(F.col(f"{order}_a") < F.col(f"{order}_b"))
    box = lambda s: tuple(F.col(f"{c}_{s}") for c in ("x1", "y1", "x2", "y2"))
    return pairs.withColumn("iou", bbox_iou(box("a"), box("b"))).where(F.col("iou") >= least).select(key, F.col(f"{order}_a").alias("a"), F.col(f"{order}_b").alias("b"), "iou")


def suppress(rows: DataFrame, key: str, least: float) -> DataFrame:
    """Greedy suppression within each key: by falling confidence,
    boxes are kept that overlap none of those kept. Boxes without corners are always kept; ties go by ``ord``.

    A key's boxes are folded in one array, so a key should be a tile, not a whole raster (see ``components.suppress_across``)."""
    rest = [c for c in rows.columns if c != key]
    order = F.struct(F.coalesce(-F.col("conf"), F.lit(float("inf"))).alias("k"), F.col("ord").alias("o"), F.struct(*rest).alias("b"))
    box = lambda r: tuple(r["b"][c] for c in ("x1", "y1", "x2", "y2"))
    boxes = rows.groupBy(key).agg(F.sort_array(F.collect_list(order)).alias("all"))
    keep = lambda kept, r: F.when(F.exists(kept, lambda k: bbox_iou(box(k), box(r)) >= least), kept).otherwise(F.array_append(kept, r))
    kept = boxes.select(key, F.explode(F.aggregate("all", F.slice("all", 1, 0), keep)).alias("r"))
    return kept.select(*(F.col(key) if c == key else F.col(f"r.b.{c}").alias(c) for c in rows.columns))


def distance_links(rows: DataFrame, reach: float, key: str = "candidate_id") -> DataFrame:
    """Links (a, b) whose components are those of all pairs of points at most ``reach`` apart, within one known coordinate system.

    A cell's diagonal is at most ``reach``, so its points hang on its smallest one; points of different cells are compared by
    place, once for all points at that place, and give one link for each two cells."""
    cell = lambda c: F.floor(F.col(c) / (reach / 1.41422)).cast("bigint")
    points = rows.where("x IS NOT NULL AND y IS NOT NULL AND lower(trim(native_crs)) NOT IN ('', 'unknown')")
    points = points.select(F.col(key).alias("id"), "native_crs", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), cell("x").alias("cx"), cell("y").alias("cy"))
    one = ["native_crs", "cx", "cy"]
    heads = points.groupBy(*one).agg(F.min("id").alias("a"))
    inner = points.join(heads, one).where("id <> a").select("a", F.col("id").alias("b"))
    places = points.select(*one, "x", "y").distinct().join(heads, one)
    steps = [(i, j) for i in range(3) for j in range(-2, 3) if i > 0 or j > 0]  # each two cells once
    near = F.inline(F.array(*(F.struct((F.col("cx") + i).alias("nx"), (F.col("cy") + j).alias("ny")) for i, j in steps)))
    left = places.select("native_crs", F.col("x").alias("xa"), F.col("y").alias("ya"), "a", near)
    right = places.select("native_crs", F.col("cx").alias("nx"), F.col("cy").alias("ny"), "x", "y", F.col("a").alias("b"))
    d = lambda p, q: (F.col(p) - F.col(q)) * (F.col(p) - F.col(q))
    outer = left.join(right, ["native_crs", "nx", "ny"]).where(d("xa", "x") + d("ya", "y") <= reach * reach).select("a", "b").distinct()
    return inner.unionByName(outer)


def cluster_rollup(rows: DataFrame, cluster: str = "cluster") -> DataFrame:
    """One row per cluster: its best member, mean position, sources and levels seen, sums."""
    best = F.max_by("candidate_id", F.struct(F.coalesce("score_mean", F.lit(-1.0)), F.coalesce("area_m2", F.lit(-1.0)), -F.col("candidate_id")))
    seen = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), ", ")
    return rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("members"), best.alias("best_id"), F.avg("x").alias("x_mean"), F.avg("y").alias("y_mean"), seen("source_label").alias("sources_seen"),
        seen("scale_level").alias("scale_levels_seen"), F.sum("area_m2").alias("area_sum"), F.max("score_mean").alias("score_max"),
    )


def suppressed_top_k(pixels: DataFrame, k: int, radius: int, least: float) -> DataFrame:
    """The k best pixels, each more than ``radius`` (Chebyshev) from those picked before; ties go to the first in row-major order.

    A pick removes at most (2 r + 1)^2 pixels, so the best k (2 r + 1)^2 pixels are enough: a number
    that doesn't grow with the raster."""
    few = pixels.where(F.col("v") >= least).orderBy(F.desc("v"), "row", "col").limit(k * (2 * radius + 1) ** 2)

    def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([*batches, pd.DataFrame({"row": [], "col": [], "v": []})]).sort_values(["v", "row", "col"], ascending=[False, True, True])
        kept: list[tuple[int, int, float]] = []
        for r, c, v in zip(pdf["row"], pdf["col"], pdf["v"], strict=True):
            if len(kept) < k and all(max(abs(r - a), abs(c - b)) > radius for a, b, _ in kept):
                kept.append((int(r), int(c), float(v)))
        yield pd.DataFrame(kept, columns=["row", "col", "v"]).assign(rank=range(1, len(kept) + 1)).astype({"row": "int32", "col": "int32", "rank": "int32"})

    return few.coalesce(1).mapInPandas(pick, "row int, col int, v double, rank int")
