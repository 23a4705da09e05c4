"""Derivatives of rasters kept by tile: what has changed is computed again, with the tiles whose rims it lies in, and nothing else.

A store is a folder of three kinds of tables.  ``tiles/<run>`` has the cells that one run computed; ``manifest/<number>`` says for each
tile which run has its cells and of what content they were made.  Spark marks a table complete after its last row, so a manifest that was
not finished is passed over, and readers see the one before.  Runs that nothing refers to may be removed by ``swept``.

The content of a tile is told by two 64-bit sums of hashes of its cells, which don't depend on their order, its cells' number, and the
raster's bounds; a tile depends on all tiles that its rim meets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators import blocks as B
from stratum.sources.shared import dropped, stored

KEY = ["raster", "tr", "tc"]


def contents(cells: DataFrame, tile: int, halo: int, values: list[str], plan: str) -> DataFrame:
    """(raster, tr, tc, digest) of the tiles that have cells: what their cells and their rims' tiles hold, and the plan.  Sums before the shuffle."""
    one = lambda salt: F.sum(F.xxhash64(F.lit(salt), "row", "col", *values).cast("decimal(38,0)"))
    place = {"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")}
    own = stored(cells.withColumns(place).groupBy(*KEY).agg(F.concat_ws(":", one(1), one(2), F.count(F.lit(1))).alias("own")))
    ends = B.bounds(cells).select("raster", F.concat_ws(",", "top", "left", "bottom", "right").alias("ends"))
    reach = -(-halo // tile)
    near = F.sequence(F.lit(-reach), F.lit(reach))
    told = own.withColumn("tr", F.explode(F.transform(near, lambda k: F.col("tr") + k))).withColumn("tc", F.explode(F.transform(near, lambda k: F.col("tc") + k)))
    # each tile's content goes to its neighbours with where it lies, so that a swap is seen
    told = told.join(own.select(*KEY, F.lit(True).alias("there")), KEY)
    around = told.groupBy(*KEY).agg(F.sort_array(F.collect_list("own")).alias("all"))  # (2 reach + 1)^2 at most
    return around.join(ends, "raster").select(*KEY, F.sha2(F.concat_ws("|", F.lit(plan), "ends", F.array_join("all", "|")), 256).alias("digest"))


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete manifests, in order."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    system = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not system.exists(at):
        return []
    found = [f.getPath() for f in system.listStatus(at)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str) -> DataFrame | None:
    """(raster, tr, tc, digest, run) of the last complete manifest."""
    numbers = _numbers(spark, path)
    return spark.read.parquet(f"{path}/manifest/{numbers[-1]}") if numbers else None


def kept(spark: SparkSession, path: str) -> DataFrame:
    """The cells of a store, as its last complete manifest has them."""
    told = manifest(spark, path)
    if told is None:
        raise ValueError(f"no complete derivatives at {path}")
    rows = spark.read.parquet(f"{path}/tiles")
    # a run's number is a folder: runs that the manifest doesn't name are never opened
    runs = [r[0] for r in told.select("run").distinct().collect()]  # one for each run of the store
    return rows.where(F.col("run").isin(runs)).join(told.select(*KEY, "run"), [*KEY, "run"], "left_semi").drop("tr", "tc", "run")


def refreshed(cells: DataFrame, halo: int, chain, into: list[str], path: str, plan: str, values: list[str] | None = None, tile: int = B.TILE) -> tuple[DataFrame, int]:
    """The derivatives (raster, row, col, into) of ``cells``, and how many tiles were computed for that.

    ``plan`` names the chain and its parameters: another plan makes all tiles anew.  Cells without a column ``raster`` are those of raster 0."""
    spark, values = cells.sparkSession, values or ["v"]
    rows = cells if "raster" in cells.columns else cells.withColumn("raster", F.lit(0))
    now = stored(contents(rows, tile, halo, values, plan))
    before = manifest(spark, path)
    same = now.join(before, [*KEY, "digest"], "left_semi").select(*KEY) if before is not None else now.limit(0).select(*KEY)
    stale = stored(now.join(same, KEY, "left_anti").select(*KEY))
    count = stale.count()
    run = uuid.uuid4().hex
    place = {"tr": F.floor(F.col("row") / tile).cast("int"), "tc": F.floor(F.col("col") / tile).cast("int")}
    if count or before is None:
        made = B.stencil(rows, halo, chain, into, values, tile, only=stale).select("raster", "row", "col", *into).withColumns(place)
        made.write.parquet(f"{path}/tiles/run={run}")
    fresh = stale.join(now, KEY).select(*KEY, "digest", F.lit(run).alias("run"))
    told = fresh if before is None else fresh.unionByName(before.join(now, [*KEY, "digest"], "left_semi").select(*KEY, "digest", "run"))
    numbers = _numbers(spark, path)
    told.write.parquet(f"{path}/manifest/{numbers[-1] + 1 if numbers else 0}")
    return kept(spark, path), count


def swept(spark: SparkSession, path: str) -> int:
    """Removes manifests before the last and runs that it doesn't name; how many runs went.  Not while others read the store."""
    numbers = _numbers(spark, path)
    if not numbers:
        return 0
    named = {r[0] for r in manifest(spark, path).select("run").distinct().collect()}
    for n in numbers[:-1]:
        dropped(spark, f"{path}/manifest/{n}")
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/tiles")
    runs = [f.getPath().getName() for f in at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(at)]
    old = [r for r in runs if r.startswith("run=") and r[4:] not in named]
    for r in old:
        dropped(spark, f"{path}/tiles/{r}")
    return len(old)
