"""TIFF as a data source: forms of files, blocks that a window meets, padding beyond a raster, files written by Spark."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from stratum.sources import tiff


def packed_lzw(data):
    """The format's LZW, plainly."""
    bits, table, width = [], {bytes((k,)): k for k in range(256)}, 9

    def put(code):
        bits.append(format(code, f"0{width}b"))

    put(256)
    size, last = 258, b""
    for b in data:
        now = last + bytes((b,))
        if now in table:
            last = now
            continue
        put(table[last])
        table[now] = size
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
        if size == 4094:
            put(256)
            table, width, size = {bytes((k,)): k for k in range(256)}, 9, 258
        last = bytes((b,))
    if last:
        put(table[last])
        size += 1
        width = 9 + (size >= 512) + (size >= 1024) + (size >= 2048)
    put(257)
    text = "".join(bits)
    return bytes(int(text[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(text), 8))


def file_of(a, order="<", big=False, tile=None, packing=1, predictor=1, planar=False, nodata=None, rows=5):
    """A TIFF of (rows, columns, bands), written plainly."""
    h, w, n = a.shape
    th, tw = (tile, tile) if tile else (rows, w)
    kind, blocks = a.dtype.newbyteorder(order), []
    for band in range(n) if planar else [None]:
        part = a if band is None else a[..., band : band + 1]
        for i in range(0, h, th):
            for j in range(0, w, tw):
                b = part[i : i + th, j : j + tw]
                if tile:
                    b = np.pad(b, ((0, th - b.shape[0]), (0, tw - b.shape[1]), (0, 0)))
                if predictor == 2:
                    b = np.concatenate([b[:, :1], b[:, 1:] - b[:, :-1]], 1)
                raw = b.astype(kind).tobytes()
                if predictor == 3:
                    x = np.frombuffer(b.astype(a.dtype.newbyteorder(">")).tobytes(), np.uint8).reshape(b.shape[0], -1, a.dtype.itemsize)
                    x = x.transpose(0, 2, 1).reshape(b.shape[0], -1, b.shape[2])
                    raw = np.concatenate([x[:, :1], x[:, 1:] - x[:, :-1]], 1).astype(np.uint8).tobytes()
                blocks.append({1: lambda r: r, 8: zlib.compress, 5: packed_lzw}[packing](raw))
    word, count_word = ("Q", "Q") if big else ("I", "H")
    at, body, offsets = (16 if big else 8), b"", []
    for b in blocks:
        offsets.append(at + len(body))
        body += b
    entries = {256: ("I", [w]), 257: ("I", [h]), 258: ("H", [a.dtype.itemsize * 8] * n), 259: ("H", [packing]), 277: ("H", [n]), 284: ("H", [2 if planar else 1]), 317: ("H", [predictor]), 339: ("H", [{"u": 1, "i": 2, "f": 3}[a.dtype.kind]] * n)}
    entries |= {322: ("I", [tw]), 323: ("I", [th]), 324: (word, offsets), 325: (word, [len(b) for b in blocks])} if tile else {273: (word, offsets), 278: ("I", [th]), 279: (word, [len(b) for b in blocks])}
    if nodata is not None:
        entries[42113] = ("s", f"{nodata}\0".encode())
    extra, table, inline = b"", b"", 8 if big else 4
    for tag, (letter, value) in sorted(entries.items()):
        data = value if letter == "s" else struct.pack(f"{order}{len(value)}{letter}", *value)
        if len(data) > inline:
            place = struct.pack(order + word, at + len(body) + len(extra))
            extra += data
            data = place
        table += struct.pack(order + "HH" + word, tag, {"H": 3, "I": 4, "s": 2, "Q": 16}[letter], len(value)) + data.ljust(inline, b"\0")
    directory = at + len(body) + len(extra)
    start = (b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, directory) if big else struct.pack(order + "HI", 42, directory))
    return start + body + extra + struct.pack(order + count_word, len(entries)) + table + struct.pack(order + word, 0)


FORMS = [
    ("f4", {}), ("u1", {"order": ">", "tile": 16, "packing": 8, "predictor": 2}), ("i2", {"big": True, "planar": True, "packing": 5}), ("f8", {"tile": 16, "packing": 8, "predictor": 3, "planar": True}),
    ("u2", {"order": ">", "big": True, "tile": 16, "packing": 5, "predictor": 2}), ("f4", {"packing": 5, "predictor": 3, "rows": 7}),
]


@pytest.mark.parametrize("kind, how", FORMS)
def test_forms(spark, tmp_path, kind, how):
    rng = np.random.default_rng(1)
    a = (rng.random((37, 41, 3)) * 200).astype(kind)
    a[3, 4, 1] = 77
    (tmp_path / "a.tif").write_bytes(file_of(a, nodata=77, **how))
    got = np.full(a.shape, np.nan)
    for r in tiff.cells(spark, f"file://{tmp_path}/a.tif").collect():
        got[r["row"], r["col"], r["band"] - 1] = np.nan if r["v"] is None else r["v"]
    assert np.array_equal(got, np.where(a == 77, np.nan, a.astype(float)), equal_nan=True)


def test_lzw_of_long_data():
    rng = np.random.default_rng(2)
    for data in (b"", b"a" * 9000, rng.integers(0, 4, 60_000).astype(np.uint8).tobytes(), rng.integers(0, 256, 20_000).astype(np.uint8).tobytes()):
        assert tiff.unpacked_lzw(packed_lzw(data)) == data


def read_blocks(path, window):
    """Blocks that a reader with these filters would read."""
    reader = tiff.TiffReader({"path": path})
    list(reader.pushFilters(window))
    return sum(len(p.places) for p in reader.partitions())


def test_a_window_reads_the_blocks_it_meets(spark, tmp_path):
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual

    a = np.arange(64 * 64 * 2, dtype="f4").reshape(64, 64, 2)
    (tmp_path / "a.tif").write_bytes(file_of(a, tile=16, planar=True))
    (tmp_path / "b.tif").write_bytes(file_of(a, tile=16))
    path = f"file://{tmp_path}"
    assert read_blocks(f"{path}/a.tif", []) == 32 and read_blocks(path, []) == 48
    window = [GreaterThan(("row",), 15), LessThanOrEqual(("row",), 31), LessThanOrEqual(("col",), 16)]
    assert read_blocks(f"{path}/a.tif", window) == 4 and read_blocks(f"{path}/a.tif", [*window, EqualTo(("band",), 2)]) == 2
    assert read_blocks(path, [EqualTo(("path",), f"{path}/b.tif"), In(("col",), (63, 200))]) == 4 and read_blocks(path, [EqualTo(("row",), 64)]) == 0
    df = tiff.cells(spark, path).where((F.col("row") > 15) & (F.col("row") <= 31) & (F.col("col") <= 16) & (F.col("band") == 2) & F.col("path").endswith("a.tif"))
    rows = df.collect()
    assert len(rows) == 16 * 17 and all(r["v"] == a[r["row"], r["col"], 1] for r in rows)
    assert "PushedFilters" in (plan := df._jdf.queryExecution().executedPlan().toString()) or "BatchScan" in plan


def test_windows_beyond_the_raster(spark, tmp_path):
    a = np.random.default_rng(3).random((10, 12, 1)).astype("f8")
    (tmp_path / "a.tif").write_bytes(file_of(a, tile=16))
    for window in ((-2, -3, 20, 30), (8, 9, 5, 5), (20, 20, 2, 2), (2, 2, 3, 3), (-5, 3, 2, 2)):
        top, left, h, w = window
        rows = tiff.cells(spark, f"file://{tmp_path}/a.tif", window=window, boundless="true").collect()
        got = {(r["row"], r["col"]): r["v"] for r in rows}
        assert len(rows) == len(got) == h * w
        assert all(v == (a[r, c, 0] if 0 <= r < 10 and 0 <= c < 12 else None) for (r, c), v in got.items())
        inside = tiff.cells(spark, f"file://{tmp_path}/a.tif", window=window).count()
        assert inside == sum(v is not None for v in got.values())


@pytest.mark.parametrize("kind, packing, predictor", [("f4", 8, 3), ("f8", 1, 1), ("i2", 8, 2)])
def test_written_files_are_read_again(spark, tmp_path, kind, packing, predictor):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for name, shape in (("a", (40, 21, 2)), ("b", (5, 5, 1))):
        a = np.round(rng.random(shape) * 100).astype(kind)
        for (r, c, z), v in np.ndenumerate(a):
            if (r, c) != (1, 1) and not 16 <= r < 32:
                want[name, z + 1, r, c] = float(v)
                rows.append((name, z + 1, r, c, float(v)))
    df = spark.createDataFrame(rows, "raster string, band int, row int, col int, v double")
    files = tiff.write_tiffs(df, f"file://{tmp_path}/out", kind, 16, packing, predictor).collect()
    assert {(r["raster"], r["height"], r["width"], r["bands"]) for r in files} == {("a", 40, 21, 2), ("b", 5, 5, 1)}
    back = tiff.cells(spark, f"file://{tmp_path}/out").where("v IS NOT NULL").select(F.regexp_extract("path", r"(\w+)\.tif", 1).alias("raster"), "band", "row", "col", "v").collect()
    assert {tuple(r)[:4]: r["v"] for r in back} == want


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "a.tif").write_bytes(b"GIF89a" + bytes(40))
    with pytest.raises(Exception, match="not a TIFF"):
        tiff.cells(spark, f"file://{tmp_path}/a.tif").count()
