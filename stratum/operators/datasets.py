"""Training data sets: tiles as arrays by split and label, their counters, summaries over sources, tables of metrics."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that tiles are filed by.
FILED = ("split", "label")


def tile_arrays(cells: DataFrame, keys: list[str], place: str, value: str, into: str = "values") -> DataFrame:
    """The cells of each tile as one array, in order of their places; missing cells are NULL. A tile's size bounds its array."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(place).alias("p"), F.col(value).alias("v"))))
    return cells.groupBy(*keys).agg(F.transform(pairs, lambda c: c["v"]).alias(into))


def tiles(spark: SparkSession, path: str) -> DataFrame:
    """A data set of tiles; filters on split and label prune folders."""
    return spark.read.parquet(f"{path}/tiles")


def append_tiles(rows: DataFrame, path: str, facts: dict) -> None:
    """Adds tiles to a data set, filed by split and label, or begins one. ``facts`` (bands, sizes, ...) and columns must be those
    that it has already."""
    spark = rows.sparkSession
    told = json.dumps({"facts": facts, "columns": sorted(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in FILED)}, sort_keys=True)
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/facts")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        (had,) = spark.read.text(f"{path}/facts").collect()  # one line
        if had["value"] != told:
            raise ValueError(f"the data set has {had['value']}, not {told}")
    else:
        spark.createDataFrame([(told,)], "value string").coalesce(1).write.text(f"{path}/facts")
    rows.write.mode("append").partitionBy(*FILED).parquet(f"{path}/tiles")


def counters(rows: DataFrame, by: list[str], positive: Column) -> DataFrame:
    """``total`` and ``positives`` of each group."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(positive).alias("positives"))


def reconciled(manifest: DataFrame, counted: DataFrame, key: str, count: str) -> DataFrame:
    """What a manifest tells of each group and what is there; groups that only one of them has don't agree."""
    a, b = manifest.select(key, F.col(count).alias("told")), counted.select(F.col(key).alias("__k"), F.col(count).alias("found"))
    both = a.join(b, a[key].eqNullSafe(b["__k"]), "full")
    return both.select(F.coalesce(key, "__k").alias(key), "told", "found", F.col("told").eqNullSafe(F.col("found")).alias("agree"))


def source_summary(sources: dict[str, DataFrame], sums: list[str]) -> DataFrame:
    """Rows and sums of each source, and of all of them (source NULL)."""
    parts = [df.select(F.lit(name).alias("source"), *sums) for name, df in sources.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.rollup("source").agg(F.count(F.lit(1)).alias("n_rows"), *(F.sum(c).alias(c) for c in sums))


def metric_lines(rows: DataFrame, name: str, metrics: list[str], into: str = "line") -> DataFrame:
    """A line of a markdown table for each row; missing metrics are ``-``."""
    cells = [F.regexp_replace(F.coalesce(F.col(name).cast("string"), F.lit("-")), r"\|", r"\\|"), *(F.coalesce(F.when(F.col(m).isNotNull(), F.format_string("%.4f", F.col(m).cast("double"))), F.lit("-")) for m in metrics)]
    return rows.withColumn(into, F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")))


def markdown(rows: DataFrame, name: str, metrics: list[str]) -> list[str]:
    """A markdown table of models, best first metric on top. One row for each model, so it fits the driver."""
    lines = metric_lines(rows, name, metrics).orderBy(F.desc_nulls_last(metrics[0]), name).select("line").collect()
    return ["| " + " | ".join([name, *metrics]) + " |", "|" + "-|" * (len(metrics) + 1), *(r["line"] for r in lines)]
