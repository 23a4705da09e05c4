"""TIFF rasters as a Spark data source: only the blocks that a window meets are read, by seeks.

    spark.dataSource.register(tiff.TiffSource)
    spark.read.format("stratum_tiff").load("folder or file").where("row BETWEEN 100 AND 199 AND band = 2")

Rows are (path, band from 1, row, col, v); nodata and non-finite cells are NULL.  Filters on path, band, row and col choose
files, bands and blocks before anything is read.  Classic and big TIFF of both byte orders, strips and tiles, one or several
bands (chunky or planar), without compression or with LZW or deflate, with predictors 1 to 3.

Options: ``window`` (row, col, height, width) reads just these cells; with ``boundless`` cells of the window outside a
raster are rows without a value.  ``blocks`` is the number of blocks a task reads (16).
Paths are opened by pyarrow's file systems, so each machine must see them.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from stratum.sources.shared import stored

SCHEMA = "path string, band int, row int, col int, v double"
#: Field types of the format: size and struct letter.
FIELDS = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, PACKING, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT, SCALE, TIE, NODATA = (
    256, 257, 258, 259, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339, 33550, 33922, 42113,
)
CELLS = 1 << 16


def opened(path: str) -> pa.NativeFile:
    """A file for reads at any place; Spark writes local paths with one slash."""
    system, place = fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)
    return system.open_input_file(place)


@dataclass(frozen=True)
class Raster:
    """What a file's head says."""

    order: str
    height: int
    width: int
    bands: int
    kind: str
    packing: int
    predictor: int
    planar: bool
    tiled: bool
    block: tuple[int, int]
    offsets: tuple[int, ...]
    sizes: tuple[int, ...]
    nodata: float | None
    scale: tuple[float, ...]
    tie: tuple[float, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def down(self) -> int:
        return -(-self.height // self.block[0])


def head(f: pa.NativeFile) -> Raster:
    """The first image of a file; reads the head and the tables alone."""
    start = f.read_at(16, 0)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(order + "H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(order + ("Q" if big else "I"), start[8:16] if big else start[4:8])[0]
    lead, entry, inline = (8, 20, 8) if big else (2, 12, 4)
    count = struct.unpack(order + ("Q" if big else "H"), f.read_at(lead, at))[0]
    table, tags = f.read_at(count * entry, at + lead), {}
    for k in range(count):
        tag, kind = struct.unpack_from(order + "HH", table, k * entry)
        n = struct.unpack_from(order + ("Q" if big else "I"), table, k * entry + 4)[0]
        if kind not in FIELDS:
            continue
        size, letter = FIELDS[kind]
        value = table[k * entry + entry - inline : (k + 1) * entry]
        if n * size > inline:
            value = f.read_at(n * size, struct.unpack(order + ("Q" if big else "I"), value)[0])
        tags[tag] = value[: n * size] if kind == 2 else struct.unpack_from(f"{order}{n}{letter}", value)
    one = lambda t, d=None: tags.get(t, (d,))[0]
    bands, form, bits = one(SAMPLES, 1), one(FORMAT, 1), one(BITS, 1)
    kinds = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
    if (form, bits) not in kinds or one(PACKING, 1) not in (1, 5, 8, 32946) or one(PREDICTOR, 1) not in (1, 2, 3):
        raise ValueError(f"cells of format {form} and {bits} bits, packing {one(PACKING, 1)}, predictor {one(PREDICTOR, 1)} aren't read")
    tiled = TILES in tags
    block = (one(TILE_HEIGHT), one(TILE_WIDTH)) if tiled else (min(one(STRIP_ROWS, one(HEIGHT)), one(HEIGHT)), one(WIDTH))
    nodata = tags.get(NODATA)
    return Raster(
        order, one(HEIGHT), one(WIDTH), bands, kinds[form, bits], one(PACKING, 1), one(PREDICTOR, 1), one(PLANAR, 1) == 2 and bands > 1, tiled, block, tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES],
        float(nodata.rstrip(b"\0 ")) if nodata and nodata.strip(b"\0 ") else None, tags.get(SCALE, ()), tags.get(TIE, ()),
    )


def unpacked_lzw(data: bytes) -> bytes:
    """LZW as the format has it: codes of 9 to 12 bits, highest bit first, one step early; 256 empties the table, 257 ends."""
    table: list[bytes] = []
    out: list[bytes] = []
    held = bits = 0
    width, last = 9, b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes((k,)) for k in range(256)] + [b"", b""], 9, b""
            continue
        now = table[code] if code < len(table) else last + last[:1]
        out.append(now)
        if last:
            table.append(last + now[:1])
        last = now
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def block_values(raw: bytes, r: Raster, rows: int) -> np.ndarray:
    """(rows, columns, bands of the block) of a block's bytes; a last strip has fewer rows."""
    data = raw if r.packing == 1 else unpacked_lzw(raw) if r.packing == 5 else zlib.decompress(raw)
    depth, size = 1 if r.planar else r.bands, np.dtype(r.kind).itemsize
    shape = rows, r.block[1], depth
    n = rows * r.block[1] * depth
    if r.predictor == 3:  # differences of bytes, the bytes of each line by their weight
        lines = np.cumsum(np.frombuffer(data, np.uint8, n * size).reshape(rows, -1, depth), 1, dtype=np.uint8).reshape(rows, size, -1)
        return np.ascontiguousarray(lines.transpose(0, 2, 1)).view(">" + r.kind).reshape(shape)
    cells = np.frombuffer(data, r.order + r.kind, n).reshape(shape)
    if r.predictor == 2:
        whole = f"u{size}"
        return np.cumsum(cells.astype(cells.dtype.newbyteorder("=")).view(whole), 1, dtype=whole).view(r.kind)
    return cells


class Blocks(InputPartition):
    """Blocks of a file that one task reads; ``None`` as the raster's head: cells outside a raster."""

    def __init__(self, path: str, raster: Raster | None, band: int, places: list[tuple[int, int]], outside: tuple[int, int, int, int] | None = None):
        self.path, self.raster, self.band, self.places, self.outside = path, raster, band, places, outside


class TiffReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options.get("path", "")
        self.chunk = int(options.get("blocks", "16"))
        given = options.get("window")
        self.window = tuple(int(x) for x in given.split(",")) if given else None
        self.boundless = options.get("boundless", "false").lower() == "true"
        low, high = -(10**9), 10**9
        self.ranges = {"row": [low, high], "col": [low, high], "band": [1, high]}
        self.chosen: dict[str, set] = {}
        if self.window:
            top, left, height, width = self.window
            self.ranges |= {"row": [top, top + height - 1], "col": [left, left + width - 1]}

    def pushFilters(self, filters):  # noqa: N802
        """Bounds of row, col and band, and values of path and band; the rest, and all of them once more, is left to Spark."""
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if isinstance(f, EqualTo) and name == "path":
                self.chosen["path"] = self.chosen.get("path", {f.value}) & {f.value}
            elif isinstance(f, In) and name in ("path", "band", "row", "col"):
                values = {v for v in f.value if v is not None}
                self.chosen[name] = self.chosen.get(name, values) & values
            elif name in self.ranges and getattr(f, "value", None) is not None:
                bound = self.ranges[name]
                if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
                    bound[0] = max(bound[0], f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
                    bound[1] = min(bound[1], f.value - isinstance(f, LessThan))
            yield f

    def _files(self) -> list[str]:
        system, place = fs.FileSystem.from_uri(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file://"
        found = [place] if system.get_file_info(place).type == fs.FileType.File else [i.path for i in system.get_file_info(fs.FileSelector(place, recursive=True)) if i.path.lower().endswith((".tif", ".tiff"))]
        names = sorted(scheme + p for p in found)
        return [n for n in names if n in self.chosen["path"]] if "path" in self.chosen else names

    def _meets(self, name: str, low: int, high: int) -> bool:
        """Whether low..high has a row, column or band that is asked for."""
        a, b = self.ranges[name]
        if high < a or low > b:
            return False
        return name not in self.chosen or any(max(a, low) <= v <= min(b, high) for v in self.chosen[name])

    def partitions(self) -> list[Blocks]:
        out = []
        for path in self._files():
            with opened(path) as f:
                r = head(f)
            bands = [b for b in range(1, r.bands + 1) if self._meets("band", b, b)]
            h, w = r.block
            places = [(i, j) for i in range(r.down) if self._meets("row", i * h, min((i + 1) * h, r.height) - 1) for j in range(r.across) if self._meets("col", j * w, min((j + 1) * w, r.width) - 1)]
            for band in bands if r.planar else [0] if bands else []:  # 0: all bands of a chunky block
                out += [Blocks(path, r, band, places[k : k + self.chunk]) for k in range(0, len(places), self.chunk)]
            if self.boundless and self.window:
                top, left, height, width = self.window
                outside = [(top, left, min(height, -top), width)] if top < 0 else []
                a, b = max(top, 0), min(top + height, r.height)
                outside += [(a, left, b - a, min(width, -left))] if left < 0 else []
                outside += [(a, r.width if left < r.width else left, b - a, left + width - max(left, r.width))] if left + width > r.width else []
                outside += [(max(top, r.height), left, top + height - max(top, r.height), width)] if top + height > r.height else []
                out += [Blocks(path, None, band, [], part) for band in bands for part in outside if part[2] > 0 and part[3] > 0]
        return out or [Blocks("", None, 0, [])]

    def read(self, partition: Blocks) -> Iterator[pa.RecordBatch]:
        if partition.outside:
            top, left, height, width = partition.outside
            step = max(1, CELLS // width)
            for a in range(top, top + height, step):
                rows, cols = (x.ravel() for x in np.mgrid[a : min(a + step, top + height), left : left + width])
                yield self._rows(partition.path, partition.band, rows, cols, np.full(len(rows), np.nan))
            return
        if not partition.places:
            return
        r = partition.raster
        with opened(partition.path) as f:
            for i, j in partition.places:
                k = i * r.across + j + (partition.band - 1) * r.across * r.down * r.planar
                if r.sizes[k] == 0:  # a block that was never written
                    values = np.full((*r.block, 1 if r.planar else r.bands), np.nan if r.nodata is None else r.nodata)
                else:
                    rows = r.block[0] if r.tiled else min(r.block[0], r.height - i * r.block[0])  # tiles are whole, a last strip isn't
                    values = block_values(f.read_at(r.sizes[k], r.offsets[k]), r, rows)
                a, b = max(i * r.block[0], self.ranges["row"][0]), min((i + 1) * r.block[0], r.height, self.ranges["row"][1] + 1)
                c, d = max(j * r.block[1], self.ranges["col"][0]), min((j + 1) * r.block[1], r.width, self.ranges["col"][1] + 1)
                part = values[a - i * r.block[0] : b - i * r.block[0], c - j * r.block[1] : d - j * r.block[1]].astype(float)
                rows, cols = (x.ravel() for x in np.mgrid[a:b, c:d])
                for z in range(part.shape[2]):
                    band = partition.band or z + 1
                    if self._meets("band", band, band):
                        v = part[..., z].ravel()
                        yield self._rows(partition.path, band, rows, cols, np.where(np.abs(v - r.nodata) <= 1e-6, np.nan, v) if r.nodata is not None else v)

    @staticmethod
    def _rows(path: str, band: int, rows: np.ndarray, cols: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
        columns = [pa.repeat(pa.scalar(path), len(rows)), pa.repeat(pa.scalar(band, pa.int32()), len(rows)), pa.array(rows.astype(np.int32)), pa.array(cols.astype(np.int32)), pa.array(v, pa.float64(), mask=~np.isfinite(v))]
        return pa.RecordBatch.from_arrays(columns, ["path", "band", "row", "col", "v"])


class TiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stratum_tiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TiffReader:
        return TiffReader(dict(self.options))


def cells(spark: SparkSession, path: str, **options) -> DataFrame:
    """The cells of a file or of all TIFF files under a folder."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("stratum_tiff")
    for k, v in options.items():
        reader = reader.option(k, ",".join(map(str, v)) if isinstance(v, tuple) else str(v))
    return reader.load(path)


# writing


def _packed(values: np.ndarray, packing: int, predictor: int) -> bytes:
    """A block (rows, columns, bands) as bytes, lowest byte first."""
    size = values.dtype.itemsize
    if predictor == 2:
        whole = np.ascontiguousarray(values).view(f"u{size}")
        values = np.diff(whole, axis=1, prepend=np.zeros_like(whole[:, :1]))
    elif predictor == 3:
        lines = np.ascontiguousarray(values.astype(values.dtype.newbyteorder(">"))).view(np.uint8).reshape(values.shape[0], -1, size).transpose(0, 2, 1)
        lines = np.ascontiguousarray(lines).reshape(values.shape[0], -1, values.shape[2])
        values = np.diff(lines, axis=1, prepend=np.zeros_like(lines[:, :1]))
    raw = values.astype(values.dtype.newbyteorder("<")).tobytes()
    return zlib.compress(raw, 6) if packing == 8 else raw


def _head(height: int, width: int, bands: int, sizes: dict[int, int], kind: str, tile: int, packing: int, predictor: int, nodata: float) -> bytes:
    """Everything before the tiles of a big TIFF; tiles follow by number without gaps, absent ones have size 0."""
    n = -(-height // tile) * -(-width // tile)
    text = f"{nodata:g}".encode() + b"\0"
    short = lambda v: struct.pack("<H", v)
    long = [sizes.get(k, 0) for k in range(n)]
    fields = [(WIDTH, 4, 1, struct.pack("<I", width)), (HEIGHT, 4, 1, struct.pack("<I", height)), (BITS, 3, bands, short(np.dtype(kind).itemsize * 8) * bands), (PACKING, 3, 1, short(packing)), (262, 3, 1, short(1)), (SAMPLES, 3, 1, short(bands)), (PLANAR, 3, 1, short(1)),
              (PREDICTOR, 3, 1, short(predictor)), (TILE_WIDTH, 3, 1, short(tile)), (TILE_HEIGHT, 3, 1, short(tile)), (TILES, 16, n, b""), (TILE_SIZES, 16, n, struct.pack(f"<{n}Q", *long)), (FORMAT, 3, bands, short({"u": 1, "i": 2, "f": 3}[kind[0]]) * bands), (NODATA, 2, len(text), text)]
    place = 16 + 8 + 20 * len(fields) + 8
    begin = place + sum(len(v) for *_, v in fields if len(v) > 8) + (8 * n if n > 1 else 0)
    ends = np.cumsum([0, *long])[:-1] + begin
    offsets = struct.pack(f"<{n}Q", *(int(e) if size else 0 for e, size in zip(ends, long, strict=True)))
    table, rest = b"", b""
    for tag, type_, count, value in fields:
        value = offsets if tag == TILES else value
        inline = value if len(value) <= 8 else struct.pack("<Q", place + len(rest))
        rest += value if len(value) > 8 else b""
        table += struct.pack("<HHQ", tag, type_, count) + inline.ljust(8, b"\0")
    return b"II" + struct.pack("<HHHQ", 43, 8, 0, 16) + struct.pack("<Q", len(fields)) + table + struct.pack("<Q", 0) + rest


def write_tiffs(rasters: DataFrame, folder: str, kind: str = "f4", tile: int = 256, packing: int = 8, predictor: int = 1, nodata: float = -9999.0) -> DataFrame:
    """One tiled big TIFF for each raster of cells (raster, band from 1, row, col, v): a table (raster, path, height, width, bands).

    Rows and columns are from 0 on.  Tiles are packed side by side and written to the shared folder; then those of a raster stream
    through one task in order, behind a head made of their sizes.  A task that is run again replaces its files."""
    rows = rasters.select(F.col("raster").cast("string"), "band", "row", "col", F.col("v").cast("double").alias("v"))
    facts = stored(rows.groupBy("raster").agg((F.max("row") + 1).cast("int").alias("height"), (F.max("col") + 1).cast("int").alias("width"), F.max("band").cast("int").alias("bands")))
    across = F.ceil(F.col("width") / tile)
    number = F.floor(F.col("row") / tile) * across + F.floor(F.col("col") / tile)
    tiles = rows.join(facts, "raster").withColumn("k", number.cast("bigint"))

    def pack(t: pa.Table) -> pa.Table:
        k, width, bands = (t[c][0].as_py() for c in ("k", "width", "bands"))
        i, j = divmod(k, -(-width // tile))
        values = np.full((tile, tile, bands), nodata)
        v = t["v"].to_numpy()
        values[np.asarray(t["row"]) - i * tile, np.asarray(t["col"]) - j * tile, np.asarray(t["band"]) - 1] = np.where(np.isfinite(v), v, nodata)
        return pa.table({"raster": t["raster"].slice(0, 1), "k": pa.array([k]), "data": pa.array([_packed(values.astype(kind), packing, predictor)], pa.binary())})

    packed = stored(tiles.groupBy("raster", "k").applyInArrow(pack, "raster string, k bigint, data binary"))
    sizes = packed.groupBy("raster").agg(F.map_from_entries(F.collect_list(F.struct("k", F.octet_length("data").alias("n")))).alias("sizes"))  # a number a tile

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows_ = b.to_pylist()
            made = [_head(r["height"], r["width"], r["bands"], dict(r["sizes"]), kind, tile, packing, predictor, nodata) for r in rows_]
            yield pa.RecordBatch.from_arrays([b["raster"], pa.array([-1] * len(rows_), pa.int64()), pa.array(made, pa.binary())], ["raster", "k", "data"])

    first = facts.join(sizes, "raster").mapInArrow(heads, "raster string, k bigint, data binary")
    dealt = packed.unionByName(first).repartition("raster").sortWithinPartitions("raster", "k")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, now = None, None
        for batch in batches:
            for name, data in zip(batch["raster"], batch["data"], strict=True):
                name = name.as_py()
                if name != now:
                    if sink:
                        sink.close()
                        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{folder}/{now}.tif"])], ["raster", "path"])
                    system, place = fs.FileSystem.from_uri(folder)
                    system.create_dir(place, recursive=True)
                    sink, now = system.open_output_stream(f"{place}/{name}.tif"), name
                sink.write(data.as_py())
        if sink:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{folder}/{now}.tif"])], ["raster", "path"])

    return stored(dealt.mapInArrow(write, "raster string, path string")).join(facts, "raster")
