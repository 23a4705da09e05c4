"""Predictions against truth: confusion counts and their metrics, threshold sweeps, curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.operators.raster import percentiles

#: Thresholds of the sweep (fixed values).
SWEEP = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)


def confusion(predicted: Column, truth: Column) -> dict[str, Column]:
    """Counts tp, fp, fn and tn of two boolean columns, as aggregates."""
    n = lambda c: F.count_if(c)
    return {"tp": n(predicted & truth), "fp": n(predicted & ~truth), "fn": n(~predicted & truth), "tn": n(~predicted & ~truth)}


def metrics(eps: float) -> dict[str, Column]:
    """Metrics from count columns, with ``eps`` in every denominator."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    p, r = tp / (tp + fp + eps), tp / (tp + fn + eps)
    return {"precision": p, "recall": r, "f1": 2 * p * r / (p + r + eps), "iou": tp / (tp + fp + fn + eps), "accuracy": (tp + tn) / (tp + fp + fn + tn + eps), "specificity": tn / (tn + fp + eps), "dice": 2 * tp / (2 * tp + fp + fn + eps)}


def guarded_metrics() -> dict[str, Column]:
    """The same with 0 where a denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": ratio(2 * p * r, p + r), "accuracy": ratio(tp + tn, tp + fp + fn + tn)}


def evaluate(pairs: DataFrame, threshold: float = 0.5, strict: bool = False, eps: float | None = 1e-8, by: list[str] | None = None) -> DataFrame:
    """Counts and metrics of (prob, truth) at a threshold: ``>=``, or ``>`` if strict; guarded ones if ``eps`` is None."""
    hit = F.col("prob") > threshold if strict else F.col("prob") >= threshold
    counts = confusion(F.coalesce(hit, F.lit(False)), F.col("truth") > 0)
    return pairs.groupBy(*(by or [])).agg(*(c.alias(k) for k, c in counts.items())).withColumns(guarded_metrics() if eps is None else metrics(eps))


def binary(pairs: DataFrame, value: str, into: str) -> DataFrame:
    """A prediction as 0 or 1: above 0 if it only holds 0 and 1 or leaves [0, 1], else a half at least."""
    facts = pairs.agg(F.bool_and(F.col(value).isin(0, 1)).alias("__only"), F.min(value).alias("__min"), F.max(value).alias("__max"))  # one row
    least = F.when(F.col("__only") | (F.col("__min") < 0) | (F.col("__max") > 1), F.col(value) > 0).otherwise(F.col(value) >= 0.5)
    return pairs.crossJoin(F.broadcast(facts)).withColumn(into, F.coalesce(least.cast("int"), F.lit(0))).drop("__only", "__min", "__max")


def sweep(pairs: DataFrame, thresholds: tuple[float, ...] = SWEEP, eps: float = 1e-8) -> DataFrame:
    """Counts and metrics at each threshold, from one pass: rows are first counted by how many thresholds they reach."""
    reached = sum((F.coalesce(F.col("prob") >= t, F.lit(False)).cast("int") for t in thresholds), F.lit(0))
    few = pairs.groupBy(reached.alias("k"), (F.col("truth") > 0).alias("t")).agg(F.count(F.lit(1)).alias("n"))  # two rows a threshold
    steps = F.posexplode(F.array(*map(F.lit, sorted(thresholds)))).alias("i", "threshold")
    dealt = few.select("k", "t", "n", steps)
    hit = F.col("k") > F.col("i")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    counts = dealt.groupBy("threshold").agg(total(hit & F.col("t")).alias("tp"), total(hit & ~F.col("t")).alias("fp"), total(~hit & F.col("t")).alias("fn"), total(~hit & ~F.col("t")).alias("tn"))
    return counts.withColumns(metrics(eps))


def best_threshold(swept: DataFrame, by: str = "f1") -> DataFrame:
    """The threshold of the best metric; the first one of equals, and 0.5 if none is above 0."""
    best = swept.agg(F.max_by("threshold", F.struct(F.col(by), -F.col("threshold"))).alias("threshold"), F.max(by).alias(by))
    return best.withColumn("threshold", F.when(F.col(by) > 0, F.col("threshold")).otherwise(0.5))


def pr_curve(pairs: DataFrame, points: int = 100) -> DataFrame:
    """Precision and recall at evenly spaced thresholds over [0, 1], with 1e-8 in the denominators."""
    grid = tuple(i / (points - 1) for i in range(points))
    swept = sweep(pairs, grid)
    return swept.select("threshold", "precision", "recall")


def auc(curve: DataFrame) -> DataFrame:
    """Area under a curve by trapezoids over its points in order of recall (as many rows as the curve has points)."""
    w = Window.orderBy("recall", F.desc("threshold"))
    area = (F.col("recall") - F.lag("recall").over(w)) * (F.col("precision") + F.lag("precision").over(w)) / 2
    return curve.select(area.alias("a")).agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("auc"))


def confidence_histogram(rows: DataFrame, value: str) -> DataFrame:
    """Counts of five buckets of a confidence (missing counts as 0), and the median and 90th percentile of all rows."""
    c = F.coalesce(F.col(value).cast("double"), F.lit(0.0))
    rows = rows.select(c.alias("v"))
    c = F.col("v")
    bucket = F.when(c < 0.5, "0.0-0.5").when(c < 0.75, "0.5-0.75").when(c < 0.85, "0.75-0.85").when(c < 0.95, "0.85-0.95").otherwise("0.95-1.0")
    q = percentiles(rows, "v", 50, 90).select(F.col("lo").alias("median"), F.col("hi").alias("p90"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(q))  # one row


def upper_median(rows: DataFrame, by: list[str], value: str, into: str = "median") -> DataFrame:
    """The median of each group; of two middle values the larger one."""
    return rows.groupBy(*by).agg((-F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY -`{value}`)")).alias(into))
