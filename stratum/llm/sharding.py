"""Sharding by a permutation-filled lookup table.

Each shard has an order of preference over all slots of a table whose size is prime; in turns, the
shards claim their first slot that is still free, until the table is full.  Shards hold equal shares
to within one slot, and when a shard comes or goes few other slots change hands.  A row's key picks
a slot, and the slot its shard: constant time.  The table's size is a parameter, so what is broadcast
has a fixed size.

A null key is placed like an empty one.  Equal keys share a shard.  Other columns play no part.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratum.llm.shared import chosen, numbered
from stratum.llm.shared import place as place_of

#: Slots: a prime, over a hundred for each of the shards, so that shares differ by less than 1 %.
SLOTS = 6553
SHARDS = tuple(f"shard-{i:02d}" for i in range(64))


def _number(name: str, seed: str) -> int:
    return int.from_bytes(hashlib.md5(f"{seed}:{name}".encode()).digest()[:8], "big")


def lookup_table(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> list[int]:
    """The number of the shard that holds each slot."""
    if not shards or len({*shards}) < len(shards):
        raise ValueError("shards need different names, and one at least")
    if slots < len(shards) or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime, and no less than that of shards")
    at = [_number(s, "first") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    held = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while held[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        held[at[k]] = k
    return held


def slot(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: the first 32 bits of its MD5 digest, modulo the number of slots."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % slots).cast("int")


def place(rows: DataFrame, key: str, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(key, slot, shard) for each row."""
    table = rows.sparkSession.createDataFrame(list(enumerate(shards[k] for k in lookup_table(shards, slots))), "slot int, shard string")
    found = chosen(rows, key=key).withColumn("slot", slot(F.col("key"), slots))
    # ``slots`` rows, whatever the input
    return found.join(F.broadcast(table), "slot").select(F.col("key").alias(key), "slot", "shard")


def write(rows: DataFrame, key: str, path: str, files: int = 4, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> None:
    """Writes the rows as Parquet, a folder for each shard, at most ``files`` files in each; a row of which the key
    is very common is dealt out over its shard's files by its other columns."""
    table = rows.sparkSession.createDataFrame(list(enumerate(shards[k] for k in lookup_table(shards, slots))), "slot__ int, shard__ string")
    placed = numbered(rows)
    salt = F.pmod(F.xxhash64(*(F.to_json(F.struct(c)) for c in placed.columns)), F.lit(files))
    placed = placed.withColumn("slot__", slot(F.col(f"c{place_of(rows, key)}"), slots)).join(F.broadcast(table), "slot__").drop("slot__")
    placed.repartition(len(shards) * files, "shard__", salt).toDF(*rows.columns, "shard__").write.partitionBy("shard__").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    return place(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id")


def sql(shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> str:
    """The same rows in DuckDB SQL, given the filled table; that is held against a plain filling in the tests."""
    rows = ", ".join(f"({k}, '{s}')" for k, s in enumerate(shards))
    order = ", ".join(f"({i}, {k})" for i, k in enumerate(lookup_table(shards, slots)))
    return f"""
WITH s(k, shard) AS (VALUES {rows}), t(slot, k) AS (VALUES {order}),
d AS (SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % {slots})::INT AS slot FROM documents)
SELECT doc_id, d.slot, shard FROM d JOIN t ON d.slot = t.slot JOIN s USING (k)
"""
