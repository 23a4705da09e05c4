"""Files in and out: rasters as cell tables, JSON-lines logs, CSV, GeoJSON and sheets."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def cells(spark: SparkSession, path: str, rows: tuple[int, int] | None = None, cols: tuple[int, int] | None = None, bands: list[str] | None = None) -> DataFrame:
    """A window of a raster kept as Parquet cells: bounds and bands reach the scan."""
    df = spark.read.parquet(path)
    for name, bound in (("row", rows), ("col", cols)):
        if bound:
            df = df.where(F.col(name).between(*bound))
    return df.select("row", "col", *bands) if bands else df


def grey_tiff(content: bytes) -> tuple[np.ndarray, float | None]:
    """The first band of an uncompressed, striped TIFF of one sample a pixel, and its nodata value."""
    order = {b"II": "<", b"MM": ">"}[content[:2]]
    count = struct.unpack_from(order + "H", content, at := struct.unpack_from(order + "I", content, 4)[0])[0]
    size = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 11: 4, 12: 8}
    form = {1: "B", 3: "H", 4: "I", 11: "f", 12: "d"}
    tags: dict[int, tuple | bytes] = {}
    for k in range(count):
        tag, kind, n, _ = struct.unpack_from(order + "HHII", content, at + 2 + 12 * k)
        place = at + 10 + 12 * k
        if n * size.get(kind, 1) > 4:
            place = struct.unpack_from(order + "I", content, place)[0]
        tags[tag] = content[place : place + n] if kind == 2 else struct.unpack_from(f"{order}{n}{form[kind]}", content, place) if kind in form else ()
    one = lambda t, d=None: tags.get(t, (d,))[0]
    if one(259, 1) != 1 or one(277, 1) != 1 or 273 not in tags:
        raise ValueError("only uncompressed striped images of one sample are read")
    kind = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}[one(339, 1), one(258)]
    raw = b"".join(content[a : a + n] for a, n in zip(tags[273], tags[279], strict=True))
    nodata = tags.get(42113)
    return np.frombuffer(raw, order + kind).reshape(one(257), one(256)), float(nodata.rstrip(b"\0 ")) if nodata else None


def tiff_cells(spark: SparkSession, folder: str) -> DataFrame:
    """(path, row, col, v) of all TIFF files under a folder, one task a file; nodata and non-finite cells are NULL."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                grid, nodata = grey_tiff(bytes(content))
                for a in range(0, grid.shape[0], 256):  # 256 lines at a time
                    part = grid[a : a + 256].astype(float)
                    r, c = np.indices(part.shape)
                    v = part.ravel()
                    bad = ~np.isfinite(v) | (np.abs(v - nodata) <= 1e-6 if nodata is not None else False)
                    yield pd.DataFrame({"path": path, "row": (r.ravel() + a).astype("int32"), "col": c.ravel().astype("int32"), "v": pd.Series(v).astype("Float64").mask(bad)})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.tif*").load(folder)
    return files.select("path", "content").mapInPandas(read, "path string, row int, col int, v double")


def rasters(spark: SparkSession, folder: str, pattern: str = "*.tif*") -> DataFrame:
    """Files under a folder, newest first."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "modificationTime", "length").orderBy(F.desc("modificationTime"), "path")


def newest(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """The newest file under a folder: one row, or none."""
    return rasters(spark, folder, pattern).limit(1)


def json_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON lines with a given schema; lines that don't parse are kept in ``_bad``."""
    schema = schema if isinstance(schema, str) else ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
    return spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header; nested values as JSON."""
    flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in rows.dtypes]
    rows.select(*flat).write.option("header", True).mode("overwrite").csv(path)


def geojson(rows: DataFrame, ring: str) -> DataFrame:
    """One GeoJSON feature a row, as text; all other columns are properties."""
    at = F.transform(F.col(ring), lambda p: F.array(p["x"], p["y"]))
    rest = [c for c in rows.columns if c != ring]
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(at).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties"))).alias("value"))


def write_geojson(rows: DataFrame, ring: str, path: str) -> None:
    """GeoJSON text sequences: a feature a line."""
    geojson(rows, ring).write.mode("overwrite").text(path)


def annotations(spark: SparkSession, folder: str, ignored: tuple[int, ...] = (0, 11)) -> DataFrame:
    """(image, x, y, w, h, kind) of annotation lines ``x,y,w,h,score,kind,truncation,occlusion``; short, empty and ignored boxes are left out."""
    lines = spark.read.text(folder).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.txt$", 1).alias("image"), F.split(F.trim("value"), ",").alias("p"))
    part = lambda i: F.get(F.col("p"), F.lit(i)).try_cast("int")
    rows = lines.where(F.size("p") >= 8).select("image", part(0).alias("x"), part(1).alias("y"), part(2).alias("w"), part(3).alias("h"), part(5).alias("kind"))
    return rows.where((F.col("w") > 0) & (F.col("h") > 0) & ~F.col("kind").isin(*ignored))


def write_xlsx(rows: DataFrame, path: str, sheet: str = "Sheet1") -> int:
    """A workbook of one sheet for people to read, row by row from the cluster; the number of rows written."""
    import zipfile
    from xml.sax.saxutils import escape

    def cell(v) -> str:
        if v is None:
            return "<c/>"
        if isinstance(v, bool | int | float):
            return f"<c><v>{int(v) if isinstance(v, bool) else v}</v></c>" if v == v else "<c/>"
        return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(re.sub(r"[^\t\n\r\x20-퟿-�]", "", str(v)))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    office = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006"
    n = 0
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="{package}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}/relationships"><Relationship Id="r1" Type="{office}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}"><sheets><sheet name="{escape(sheet)}" sheetId="1" r:id="r1"/></sheets></workbook>')
        with z.open("xl/worksheets/sheet1.xml", "w") as f:
            f.write(f'{head}<worksheet xmlns="{main}"><sheetData><row>{"".join(map(cell, rows.columns))}</row>'.encode())
            for row in rows.toLocalIterator():
                f.write(f"<row>{''.join(map(cell, row))}</row>".encode())
                n += 1
            f.write(b"</sheetData></worksheet>")
    return n
