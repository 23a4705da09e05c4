"""Samples and splits for training data. Orders come from MD5 of key and seed, so they are the same in any engine.

Target counts round half to even.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.sources.shared import stored


def draw(key: Column, seed: int) -> Column:
    """The order in which keys are drawn."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def _beside(rows: DataFrame, facts: DataFrame, by: list[str], sent: bool = False) -> DataFrame:
    """``rows`` with the columns of ``facts``, one row for each group; null is a group like any other."""
    other = facts.withColumnsRenamed({c: f"__by_{c}" for c in by})
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    return rows.join(F.broadcast(other) if sent else other, same).drop(*(f"__by_{c}" for c in by))


def _ranked(rows: DataFrame, by: list[str], key: str, seed: int, ties: tuple[str, ...] = ()) -> DataFrame:
    """``__n``: the place of a row in its group's order of drawing.

    Draws are counted by their first four digits, at most 65,536 counts a group; rows are numbered within these and
    moved on by what is counted before, so that no task sorts a whole group."""
    rows = rows.withColumn("__d", draw(F.col(key), seed)).withColumn("__p", F.substring("__d", 1, 4))
    one = rows.groupBy(*by, "__p").agg(F.count(F.lit(1)).alias("__c"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(*by, "__p").orderBy("__d", key, *ties))
    rows = _beside(rows.withColumn("__n", place), one.withColumn("__b", before).drop("__c"), [*by, "__p"])
    return rows.withColumn("__n", F.col("__n") + F.col("__b")).drop("__d", "__p", "__b")


def keep_ratio(rows: DataFrame, by: list[str], key: str, ratio: float, seed: int) -> DataFrame:
    """A share of each group, one row at least; rows whose group is null are one too."""
    sizes = rows.groupBy(*by).agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * ratio).cast("bigint")).alias("__take"))
    return _beside(_ranked(rows, by, key, seed), sizes, by).where("__n <= __take").drop("__n", "__take")


def holdout(rows: DataFrame, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """``held``: a share of each class, one row at least and never all; a class of one row gives none.  Rows without a class are one."""
    n = F.count(F.lit(1))
    sizes = rows.groupBy(label).agg(F.least(n - 1, F.greatest(F.lit(1), F.bround(n * ratio).cast("bigint"))).alias("__take"))
    return _beside(_ranked(rows, [label], key, seed), sizes, [label]).withColumn("held", F.col("__n") <= F.col("__take")).drop("__n", "__take")


def negatives_to_positives(rows: DataFrame, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """All positives, and negatives up to ``ratio`` times as many; rows without a label count as negatives."""
    positive = F.coalesce(F.col(label) > 0, F.lit(False))
    take = rows.agg(F.bround(F.count_if(positive) * ratio).cast("bigint").alias("__take"))  # one row
    ranked = _ranked(rows.withColumn("__positive", positive), ["__positive"], key, seed)
    return ranked.crossJoin(F.broadcast(take)).where(F.col("__positive") | (F.col("__n") <= F.col("__take"))).drop("__positive", "__n", "__take")


#: Splits in the order of manifests (fixed values).
SPLITS = ("train", "val", "test")


def manifest_order(split: str = "split", source: str = "source_name", row: str = "row_off", col: str = "col_off") -> list[Column]:
    """The order of manifests: split, source, row, column."""
    place = F.array_position(F.array(*map(F.lit, SPLITS)), F.col(split))
    return [place.asc(), F.asc(source), F.asc(row), F.asc(col)]


def negative_windows(windows: DataFrame, positives: DataFrame, keys: tuple[str, ...] = ("split", "row_off", "col_off")) -> DataFrame:
    """Windows that aren't among the positive ones of their split."""
    return windows.join(positives.select(*keys).distinct(), list(keys), "left_anti")


def selected_regions(rows: DataFrame, split: str, ratio_col: str, label: str, key: str, ratio: float, seed: int) -> DataFrame:
    """All positives (``label`` 1), and of each split ``ratio`` times as many negatives: of those without any positive pixel, or of
    all of them where the split has none such. Negatives are drawn by hash; rows without a split are one."""
    clean = (F.col(label) == 0) & (F.coalesce(F.col(ratio_col), F.lit(0.0)) <= 0)
    sizes = rows.groupBy(split).agg((F.count_if(clean) > 0).alias("__has"), F.bround(F.count_if(F.col(label) == 1) * ratio).cast("bigint").alias("__take"))
    pool = _beside(rows.where(F.col(label) == 0), sizes, [split], sent=True).where(clean | ~F.col("__has"))  # a row for each split
    return rows.where(F.col(label) == 1).unionByName(_ranked(pool, [split], key, seed).where("__n <= __take").select(*rows.columns))


def split_rows_two(row_off: Column, tile: int, height: int, ratio: float) -> Column:
    """``train`` above the dividing line, ``val`` below, ``discard`` across it."""
    line = int(height * ratio)
    return F.when(row_off + tile <= line, "train").when(row_off >= line, "val").otherwise("discard")


def split_rows_three(row_off: Column, tile: int, height: int, train: float, val: float, test: float) -> Column:
    """The split that holds a window whole; NULL where none does. Without a test share the rest is for validation."""
    a, b = int(height * train), int(height * (train + val))
    end = row_off + tile
    out = F.when(end <= a, "train")
    if val > 0:
        out = out.when((row_off >= a) & (end <= b), "val")
    return out.when((row_off >= b) & (end <= height), "test" if test > 0 else "val")


def split_or_fallback(windows: DataFrame, tile: int, height: int, ratio: float, seed: int, key: str = "row_off") -> DataFrame:
    """``split`` by the dividing line, or drawn at random where one side would be empty; ``mode`` tells which."""
    rows = windows.withColumn("__s", split_rows_two(F.col(key), tile, height, ratio))
    facts = rows.agg((F.count_if(F.col("__s") == "train") * F.count_if(F.col("__s") == "val") == 0).alias("__random"), F.floor(F.count(F.lit(1)) * ratio).alias("__take"))  # one row
    rows = _ranked(rows, [], key, seed, tuple(windows.columns)).crossJoin(F.broadcast(facts))
    split = F.when(F.col("__random"), F.when(F.col("__n") <= F.col("__take"), "train").otherwise("val")).otherwise(F.col("__s"))
    return rows.withColumn("split", split).withColumn("mode", F.when(F.col("__random"), "random_fallback").otherwise("spatial")).drop("__s", "__n", "__random", "__take")


def windows_of_box(lo: Column, hi: Column, tile: int, stride: int, limit: int) -> Column:
    """Offsets of windows that can meet lo..hi (inclusive) along an axis."""
    first = F.greatest(F.ceil((lo - tile + 1) / stride), F.lit(0)).cast("int")
    last = F.least(F.floor(hi / stride), F.lit(max(0, (limit - tile) // stride))).cast("int")
    return F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(F.array().cast("array<int>"))


def rotations(step: int) -> Column:
    """Angles of a full turn; to be exploded."""
    return F.sequence(F.lit(0), F.lit(359), F.lit(step))


def sampled_until(rows: DataFrame, key: str, target: int, accept: Callable[[DataFrame], DataFrame], seed: int, spare: float = 1.2) -> DataFrame:
    """The first ``target`` rows that ``accept`` keeps, in the order of drawing; fewer if there aren't as many.

    ``accept`` is dear, so it sees one batch after another: each is a range of draws, wide enough for what is still missing at the
    share accepted so far, and is written before the next is sized.  Batches have no say in what comes out."""
    place = F.conv(F.substring(draw(F.col(key), seed), 1, 8), 16, 10).cast("bigint") / 2.0**32  # uniform in 0..1
    drawn = rows.withColumn("__at", place)
    total = rows.count()
    low, share, found, kept = 0.0, 1.0, None, 0
    while low < 1 and kept < target and total:
        high = min(1.0, low + max((target - kept) * spare / share, 1.0) / total)
        high = 1.0 if high > 0.9 else high
        batch = stored(accept(drawn.where((F.col("__at") >= low) & (F.col("__at") < high))))
        found = batch if found is None else found.unionByName(batch)
        kept += batch.count()
        low = high
        share = max(kept / (total * low), 1 / (4 * spare * math.ceil(total * low)))
    if found is None:
        return rows.limit(0)
    return _ranked(found.drop("__at"), [], key, seed, tuple(c for c in rows.columns if c != key)).where(F.col("__n") <= target).drop("__n")


def block_counts(cells: DataFrame, size: int, positive: Column, valid: Column) -> DataFrame:
    """(raster if there, br, bc, n_positive, n_valid): counts of blocks of ``size`` cells, blocks without valid cells left out; sums before the shuffle."""
    key = [c for c in cells.columns if c == "raster"]
    place = {"br": F.floor(F.col("row") / size).cast("int"), "bc": F.floor(F.col("col") / size).cast("int")}
    one = cells.withColumns(place).groupBy(*key, "br", "bc").agg(F.count_if(valid & positive).alias("n_positive"), F.count_if(valid).alias("n_valid"))
    return one.where("n_valid > 0")


def window_counts(blocks: DataFrame, tile: int, stride: int, height: int, width: int, positive_only: bool = False) -> DataFrame:
    """(row_off, col_off, n_positive, n_valid) of the whole windows that have valid cells, from counts of blocks of gcd(tile, stride) cells.

    A block goes to the few windows that it lies in.  With ``positive_only`` just windows with positive cells are made, from the
    blocks that have any: the windows are found by these, then counted."""
    size = math.gcd(tile, stride)
    key = [c for c in blocks.columns if c == "raster"]

    def offsets(block: str, limit: int) -> Column:
        at = F.col(block) * size
        first = F.greatest(F.ceil((at + size - tile) / stride), F.lit(0)).cast("int")
        last = F.least(F.floor(at / stride), F.lit((limit - tile) // stride)).cast("int")
        return F.explode(F.when(last >= first, F.transform(F.sequence(first, last), lambda k: k * stride)).otherwise(F.array().cast("array<int>")))

    if height < tile or width < tile:
        blocks = blocks.limit(0)
    in_windows = lambda rows: rows.withColumn("row_off", offsets("br", height)).withColumn("col_off", offsets("bc", width))
    rows = in_windows(blocks)
    if positive_only:
        rows = rows.join(in_windows(blocks.where("n_positive > 0")).select(*key, "row_off", "col_off").distinct(), [*key, "row_off", "col_off"], "left_semi")
    return rows.groupBy(*key, "row_off", "col_off").agg(F.sum("n_positive").alias("n_positive"), F.sum("n_valid").alias("n_valid"))


def tile_records(windows: DataFrame, tile: int, least_valid: float, positive_from: float, negative_to: float) -> DataFrame:
    """Windows with enough valid cells: ``positive_ratio`` and ``label``, 1 from ``positive_from`` on, 0 up to ``negative_to``; those between are left out."""
    ratio = F.try_divide("n_positive", "n_valid")
    rows = windows.where(F.col("n_valid") >= least_valid * tile * tile).withColumn("positive_ratio", ratio)
    return rows.withColumn("label", F.when(ratio >= positive_from, 1).when(ratio <= negative_to, 0)).where("label IS NOT NULL")
