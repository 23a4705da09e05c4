"""Deterministic relations over the given tables: rasters, candidates, boxes, scan logs, evaluation pairs.

Each view has a Spark form (a function of the session and the folder of tables) and its definition in
SQL, as a common table expression for the oracle.  Cells are 64-bit floats; missing values are NULL,
never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors of 64 numbers are 8 x 8 tiles, 25 tiles to a row of the mosaic.
TILE, ACROSS = 8, 25
WIDTH = TILE * ACROSS


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean(x: Column) -> Column:
    """NULL for NaN and infinities: the boundary at which numpy's missing values become SQL's."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def mosaic(spark: SparkSession, sf_dir: str, shift: int = 0) -> DataFrame:
    """(row, col, v): the raster; with ``shift`` another one on the same grid, whose tiles are shifted."""
    tiles = table(spark, sf_dir, "embeddings").select((F.col("vec_id") + shift).alias("t"), F.posexplode("embedding").alias("p", "x"))
    row = (F.col("t") / ACROSS).cast("bigint") * TILE + (F.col("p") / TILE).cast("int")
    col = (F.col("t") % ACROSS) * TILE + F.col("p") % TILE
    return tiles.select(row.cast("int").alias("row"), col.cast("int").alias("col"), clean(F.col("x")).alias("v"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile, label, p, v): the same cells by tile and place in the tile."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("p", "x"))
    return rows.select(F.col("vec_id").alias("tile"), "label", "p", clean(F.col("x")).alias("v"))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate rows with missing scores and areas."""
    e = table(spark, sf_dir, "events")
    level = (1 + F.col("user_id") % 3).cast("int")
    return e.select(
        F.col("event_id").alias("candidate_id"), F.col("event_type").alias("source_label"), level.alias("scale_level"), (level * 0.5).alias("scale_factor"),
        F.when(F.col("event_id") % 17 != 0, F.col("value") / 500).alias("score_mean"), F.when(F.col("event_id") % 19 != 0, F.col("value") * 10).alias("area_m2"),
        ((F.col("event_id") * 37) % 1000).cast("double").alias("x"), ((F.col("event_id") * 91) % 1000).cast("double").alias("y"),
        F.when(F.col("user_id") % 2 == 0, "EPSG:3857").otherwise("EPSG:32636").alias("native_crs"),
        F.when(F.col("event_id") % 23 == 0, "fallback_top_score").otherwise("detected").alias("candidate_type"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection boxes by tile, numbered from 1 in their order in it."""
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount")
    x, y = F.col("l_quantity"), (F.col("l_linenumber") % 3 * 10).cast("double")
    return li.select(
        F.col("l_orderkey").alias("tile_id"), F.row_number().over(order).alias("ord"), x.alias("x1"), y.alias("y1"), (x + 10 + F.col("l_partkey") % 9).alias("x2"), (y + 5 + F.col("l_suppkey") % 9).alias("y2"),
        F.round(1 - F.col("l_discount") * 5, 6).alias("conf"),
    )


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two point clouds over sloping ground: (cloud, x, y, z), with plants on a fifth of the points and houses of 6 by 6."""
    li = table(spark, sf_dir, "lineitem")
    x, y = (F.col("l_orderkey") % 300) * 0.7 + F.col("l_linenumber") * 0.31, F.floor(F.col("l_orderkey") / 300) * 0.9 + F.col("l_partkey") % 10 * 0.13
    at = li.select((F.col("l_suppkey") % 2).cast("int").alias("cloud"), x.cast("double").alias("x"), y.cast("double").alias("y"), "l_suppkey", "l_quantity", "l_discount")
    plant = F.when(F.col("l_quantity") > 40, 2 + F.col("l_discount") * 30).otherwise(0.0)
    house = F.when((F.floor(F.col("x") / 6) % 4 == 0) & (F.floor(F.col("y") / 6) % 5 == 0), 6.0).otherwise(0.0)
    return at.select("cloud", "x", "y", (100 + F.col("x") * 0.05 + F.col("y") * 0.02 + F.sin(F.col("x") * 7 + F.col("y") * 13) * 0.02 + F.col("l_suppkey") % 7 * 0.03 + plant + house).alias("z"))


def tile_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan log with several records of one candidate: the last line counts."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").alias("tile_index"), (F.col("turn") % 3).alias("candidate_index"), (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"), "role",
        F.when(F.length("text") % 5 == 0, "error").otherwise("ok").alias("status"), F.length("text").alias("size"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers to a scan's questions, numbered by key: good ones, troubles of several kinds, candidates of all confidences."""
    c = table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    size = F.length("text")
    kinds = F.array(*(F.lit(k) for k in ("api_error", "connection_failed", "invalid_json", "model_not_found", "reasoning_only")))
    at = F.timestamp_seconds(1704067200 + F.col("conv_id") + F.col("n") * 20)
    return c.select(F.col("conv_id").alias("key"), F.col("n").cast("bigint").alias("n"), at.alias("at"), F.get(kinds, ((size * 7 + F.col("conv_id")) % 11).cast("int")).alias("kind"), (size % 5 > 0).alias("candidate"), (size % 101 / 100).alias("confidence"))


def eval_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, truth, prob): labels and a score between 0 and 1."""
    labels, docs = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    return labels.join(docs.select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("truth"), ((F.col("n_chars") % 1009) / 1008.0).alias("prob"))


SQL = {
    "mosaic": f"SELECT ((t // {ACROSS}) * {TILE} + p // {TILE})::INT AS row, ((t % {ACROSS}) * {TILE} + p % {TILE})::INT AS col, x AS v FROM (SELECT vec_id AS t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)",
    "mosaic_b": f"SELECT ((t // {ACROSS}) * {TILE} + p // {TILE})::INT AS row, ((t % {ACROSS}) * {TILE} + p % {TILE})::INT AS col, x AS v FROM (SELECT vec_id + 1 AS t, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings)",
    "tiles": "SELECT vec_id AS tile, label, (generate_subscripts(embedding, 1) - 1)::INT AS p, unnest(embedding)::DOUBLE AS v FROM embeddings",
    "candidates": """SELECT event_id AS candidate_id, event_type AS source_label, (1 + user_id % 3)::INT AS scale_level, (1 + user_id % 3) * 0.5::DOUBLE AS scale_factor,
  CASE WHEN event_id % 17 <> 0 THEN value / 500 END AS score_mean, CASE WHEN event_id % 19 <> 0 THEN value * 10 END AS area_m2, ((event_id * 37) % 1000)::DOUBLE AS x, ((event_id * 91) % 1000)::DOUBLE AS y,
  CASE WHEN user_id % 2 = 0 THEN 'EPSG:3857' ELSE 'EPSG:32636' END AS native_crs, CASE WHEN event_id % 23 = 0 THEN 'fallback_top_score' ELSE 'detected' END AS candidate_type FROM events""",
    "boxes": """SELECT l_orderkey AS tile_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount))::INT AS ord, l_quantity AS x1, (l_linenumber % 3 * 10)::DOUBLE AS y1, l_quantity + 10 + l_partkey % 9 AS x2, (l_linenumber % 3 * 10)::DOUBLE + 5 + l_suppkey % 9 AS y2,
  round(1 - l_discount * 5, 6) AS conf FROM lineitem""",
    "points": """SELECT cloud, x, y, 100 + x * 0.05::DOUBLE + y * 0.02::DOUBLE + sin(x * 7 + y * 13) * 0.02::DOUBLE + l_suppkey % 7 * 0.03::DOUBLE + CASE WHEN l_quantity > 40 THEN 2 + l_discount::DOUBLE * 30 ELSE 0 END
  + CASE WHEN floor(x / 6)::BIGINT % 4 = 0 AND floor(y / 6)::BIGINT % 5 = 0 THEN 6 ELSE 0 END AS z
  FROM (SELECT *, (l_suppkey % 2)::INT AS cloud, (l_orderkey % 300) * 0.7::DOUBLE + l_linenumber * 0.31::DOUBLE AS x, (l_orderkey // 300) * 0.9::DOUBLE + l_partkey % 10 * 0.13::DOUBLE AS y FROM lineitem)""",
    "tile_log": "SELECT conv_id AS tile_index, turn % 3 AS candidate_index, conv_id * 1000 + turn AS line_no, role, CASE WHEN length(text) % 5 = 0 THEN 'error' ELSE 'ok' END AS status, length(text)::INT AS size FROM conversations",
    "answers": """SELECT conv_id AS key, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::BIGINT AS n, (['api_error', 'connection_failed', 'invalid_json', 'model_not_found', 'reasoning_only'])[(length(text) * 7 + conv_id) % 11 + 1] AS kind,
  length(text) % 5 > 0 AS candidate, length(text) % 101 / 100.0::DOUBLE AS confidence FROM conversations""",
    "eval_pairs": "SELECT doc_id, quality AS truth, (n_chars % 1009) / 1008.0::DOUBLE AS prob FROM labels JOIN documents USING (doc_id)",
}


def sql(query: str, *names: str) -> str:
    """A query with the named views in front of it."""
    return "WITH " + ",\n".join(f"{n} AS ({SQL[n]})" for n in names) + "\n" + query.strip()
