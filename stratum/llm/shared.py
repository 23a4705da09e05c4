"""Passes over Arrow batches, and columns picked by exact name."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.sources.shared import dropped, folder, stored, stored_at

__all__ = ["arrow_pass", "chosen", "dropped", "folder", "numbered", "picked", "pieces", "place", "runs", "stored", "stored_at"]

#: Rows that are handled at a time, so that temporary arrays stay small.
PIECE = 512


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of at most PIECE rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECE):
            yield batch.slice(at, PIECE)


def arrow_pass(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``each`` applied to pieces of the Arrow batches of ``df``; its result's columns in the order of ``schema``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            if (out := each(piece)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def runs(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[list[pa.RecordBatch]]:
    """Neighbouring rows with equal ``keys`` (integers) as slices of the batches, run by run."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([np.asarray(batch[k]) for k in keys], 1)
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            now = tuple(at[a].tolist())
            if held and now != last:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield held


def place(df: DataFrame, name: str) -> int:
    """Where the column ``name`` stands: that of exactly this name, else the only one that differs in case."""
    found = [i for i, c in enumerate(df.columns) if c == name] or [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{len(found)} columns are named {name}")
    return found[0]


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named c0, c1, ...: no name clashes, not even by case."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def chosen(df: DataFrame, **names: str) -> DataFrame:
    """Only the named columns, under new names: other columns, whatever their names, play no part."""
    rows = numbered(df)
    return rows.select(*(rows[f"c{place(df, name)}"].alias(alias) for alias, name in names.items()))


def picked(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The id and the text alone."""
    return chosen(df, id=id_col, text=text_col).withColumn("text", F.col("text").cast("string"))
