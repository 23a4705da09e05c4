"""Scan logs as streams: latest record of each candidate, micro-batch export, dead letters, event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from stratum.operators.scanlog import compact


def source(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int | None = None) -> DataFrame:
    """A folder of Parquet files as a stream; ``files_per_trigger`` bounds what is in flight."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def latest(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last record of each key so far (update or complete mode): the state is one record per key."""
    rest = [c for c in stream.columns if c not in keys]
    return stream.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("r")).select(*keys, *(f"r.{c}" for c in rest))


def once_each(stream: DataFrame, keys: list[str], time: str, late: str) -> DataFrame:
    """The first delivery of each key; keys are forgotten once the watermark has passed them."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, late: str, size: str, slide: str | None, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates by event-time window; rows later than the watermark are dropped."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), *keys).agg(*aggregates)


def sessions(stream: DataFrame, time: str, late: str, gap: str, keys: list[str], *aggregates) -> DataFrame:
    """Aggregates by session: a gap in event time ends one."""
    return stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("session"), *keys).agg(*aggregates)


def export(stream: DataFrame, good: str, bad: str, checkpoint: str, valid: str, fatal: Callable[[DataFrame], bool] | None = None, **trigger) -> StreamingQuery:
    """Writes each micro-batch to two folders: rows for which ``valid`` holds, and all others (dead letters).

    The batch's number is part of the path, so that a batch that is run again replaces what it wrote
    before; ``fatal`` may stop the stream on what it sees."""

    def write(batch: DataFrame, number: int) -> None:
        ok = F.coalesce(F.expr(valid), F.lit(False))
        batch.where(ok).write.mode("overwrite").parquet(f"{good}/batch={number}")
        batch.where(~ok).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        if fatal is not None and fatal(batch.where(~ok)):
            raise RuntimeError(f"batch {number} has a fatal error")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def merged(spark: SparkSession, log: str, keys: list[str], order: str) -> DataFrame:
    """What a log's batches say together: the last record of each key."""
    return compact(spark.read.parquet(log).drop("batch"), keys, order)
