"""Vector and point files: GeoPackage layers, LAS headers, NumPy tiles."""

from __future__ import annotations

import io
import json
import sqlite3
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.sources.tiff import opened

#: What marks a GeoPackage file, and the length of a geometry's envelope by its kind (fixed values of the format).
APPLICATION = 0x47504B47
ENVELOPE = {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder).select("path", "content")


def wkb_polygon(ring: list[tuple[float, float]]) -> bytes:
    """A polygon of one ring, closed if it isn't."""
    ring = [*ring, ring[0]] if ring and ring[0] != ring[-1] else ring
    return struct.pack("<BIII", 1, 3, 1, len(ring)) + b"".join(struct.pack("<dd", *p) for p in ring)


def write_gpkg(rows: DataFrame, ring: str, path: str, layer: str, srs: int) -> int:
    """A new polygon layer of a GeoPackage, which is made if it isn't there; for people's desktops: rows come one by one, nested values as JSON. The number of rows written."""
    kinds = {"tinyint": "INTEGER", "smallint": "INTEGER", "int": "INTEGER", "bigint": "INTEGER", "boolean": "BOOLEAN", "float": "REAL", "double": "REAL"}
    names = [c for c in rows.columns if c != ring]
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    con = sqlite3.connect(path)
    con.executescript(
        f"PRAGMA application_id = {APPLICATION}; PRAGMA user_version = 10200;"
        "CREATE TABLE IF NOT EXISTS gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);"
        "CREATE TABLE IF NOT EXISTS gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT UNIQUE, description TEXT DEFAULT '', last_change DATETIME DEFAULT (strftime('%Y-%m-%dT%H:%M:%fZ','now')), min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);"
        "CREATE TABLE IF NOT EXISTS gpkg_geometry_columns (table_name TEXT, column_name TEXT, geometry_type_name TEXT, srs_id INTEGER, z TINYINT, m TINYINT, PRIMARY KEY (table_name, column_name));"
    )
    con.executemany("INSERT OR IGNORE INTO gpkg_spatial_ref_sys VALUES (?, ?, ?, ?, 'undefined', NULL)", [("undefined", -1, "NONE", -1), ("undefined", 0, "NONE", 0), (f"EPSG:{srs}", srs, "EPSG", srs)])
    columns = "".join(f", {quoted(c)} {kinds.get(t, 'TEXT')}" for c, t in rows.dtypes if c != ring)
    con.execute(f"CREATE TABLE {quoted(layer)} (fid INTEGER PRIMARY KEY AUTOINCREMENT, geom POLYGON{columns})")
    head, n, bounds = b"GP\0\x01" + struct.pack("<i", srs), 0, [np.inf, np.inf, -np.inf, -np.inf]
    for row in rows.toLocalIterator():
        points = [(p["x"], p["y"]) for p in row[ring] or []]
        for x, y in points:
            bounds = [min(bounds[0], x), min(bounds[1], y), max(bounds[2], x), max(bounds[3], y)]
        values = [v if v is None or isinstance(v, bool | int | float | str) else json.dumps(v, default=str) for v in (row[c] for c in names)]
        con.execute(f"INSERT INTO {quoted(layer)} (geom{''.join(', ' + quoted(c) for c in names)}) VALUES (?{', ?' * len(names)})", [head + wkb_polygon(points) if points else None, *values])
        n += 1
    box = bounds if n and bounds[0] < np.inf else [None] * 4
    con.execute("INSERT INTO gpkg_contents (table_name, data_type, identifier, min_x, min_y, max_x, max_y, srs_id) VALUES (?, 'features', ?, ?, ?, ?, ?, ?)", [layer, layer, *box, srs])
    con.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'POLYGON', ?, 0, 0)", [layer, srs])
    con.commit()
    con.close()
    return n


def gpkg_layers(content: bytes) -> Iterator[tuple[str, int, int, bytes | None, str]]:
    """(layer, srs, fid, WKB, properties as JSON) of all features of a GeoPackage's bytes."""
    con = sqlite3.connect(":memory:")
    con.deserialize(content)
    con.row_factory = sqlite3.Row
    quoted = lambda c: '"' + c.replace('"', '""') + '"'
    for layer in con.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns ORDER BY table_name").fetchall():
        for row in con.execute(f"SELECT rowid AS __fid, * FROM {quoted(layer['table_name'])}"):
            shape = row[layer["column_name"]]
            wkb = bytes(shape[8 + ENVELOPE[(shape[3] >> 1) & 7] :]) if shape else None
            rest = {k: row[k] for k in row.keys() if k not in ("__fid", layer["column_name"]) and not isinstance(row[k], bytes)}
            yield layer["table_name"], layer["srs_id"], row["__fid"], wkb, json.dumps(rest)
    con.close()


def gpkg(spark: SparkSession, folder: str) -> DataFrame:
    """Features of all GeoPackages under a folder, one task a file."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [(path, *f) for f in gpkg_layers(bytes(content))]
                yield pd.DataFrame(rows, columns=["path", "layer", "srs", "fid", "wkb", "properties"])

    return _files(spark, folder, "*.gpkg").mapInPandas(read, "path string, layer string, srs int, fid bigint, wkb binary, properties string")


def las_header(content: bytes) -> tuple[int, float, float, float, float]:
    """(points, x1, y1, x2, y2) of a LAS or LAZ header."""
    if content[:4] != b"LASF":
        raise ValueError("no LAS file")
    (points,) = struct.unpack_from("<Q", content, 247) if content[24:26] >= b"\x01\x04" else struct.unpack_from("<I", content, 107)
    x2, x1, y2, y1 = struct.unpack_from("<4d", content, 179)
    return points, x1, y1, x2, y2


def las_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Points, extent, and the cell whose area holds one point on average, of all point files under a folder; of each file only the head is read."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                with opened(path) as f:
                    found.append((path, *las_header(f.read_at(400, 0))))
            yield pd.DataFrame(found, columns=["path", "points", "x1", "y1", "x2", "y2"])

    found = _files(spark, folder, "*.la[sz]").select("path").mapInPandas(read, "path string, points bigint, x1 double, y1 double, x2 double, y2 double")
    area = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    return found.withColumn("cell", F.when((F.col("points") > 0) & (area > 0), F.sqrt(area / F.col("points"))))


def numpy_tiles(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, shape, values) of arrays in .npy and .npz files under a folder; files with pickled objects are refused."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                found = np.load(io.BytesIO(bytes(content)), allow_pickle=False)
                arrays = {"": found} if isinstance(found, np.ndarray) else {k: found[k] for k in found.files}
                yield pd.DataFrame([(path, k, list(a.shape), [None if v != v else v for v in a.ravel().astype(float).tolist()]) for k, a in arrays.items()], columns=["path", "name", "shape", "values"])

    return _files(spark, folder, "*.np[yz]").mapInPandas(read, "path string, name string, shape array<int>, values array<double>")
