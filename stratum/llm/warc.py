"""WARC archives of Zstandard frames with a shared dictionary.

An archive is one skippable frame that holds the dictionary, then one frame for each record.  Tasks write
archives as ``.warc.zst`` files into a folder that all executors share, by any file system that ``pyarrow.fs``
knows, under a name of partition and number: a file appears whole or not at all, and a task that runs again
writes the same files again.  They are read by Spark's ``binaryFile`` source.

Records with equal payloads: that of the largest page id is the response, the others revisit it
(rows that share that largest id are all responses).  Null html is an empty payload.  A null page id
counts as the smallest, and is written as an empty id.  Payloads of fewer than ``min_bytes`` bytes are
all responses.  Other columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.llm.shared import chosen, folder, stored

#: Magic number of the frame with the dictionary, and the range of all skippable frames (fixed values of the format).
DICTIONARY_FRAME = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
ZSTD_MAGIC = 0xFD2FB528
#: Bytes of payloads in an archive, before compression, at which it is closed.
ARCHIVE_BYTES = 16 << 20
#: Bytes of the first payloads of an archive that its dictionary is trained on, and of the dictionary.
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
LEVEL = 3
#: Digests of repeated payloads (fixed-size rows) up to this number are sent to the pages.
BROADCAST_DIGESTS = 500_000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = lambda i: f"<urn:page:{'' if i is None else i}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + " ".join((url or "").split()), f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        *([f"WARC-Refers-To: {name(refers_to)}", f"WARC-Profile: {PROFILE}"] if revisit else []), f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few or too uniform samples give their own end as a raw one."""
    try:
        if len(samples) >= 16:
            return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def archive(records: list[bytes]) -> bytes:
    """The bytes of an archive."""
    samples, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        samples.append(r[:65536])
        size += len(samples[-1])
    words = dictionary(samples)
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(words)
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(words), write_checksum=True)
    return b"".join([struct.pack("<II", DICTIONARY_FRAME, len(packed)), packed, *map(pack.compress, records)])


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at ``at`` ends, from its block headers."""
    flags = data[at + 4]
    checksum = bool(flags & 4)
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        if at + 3 > len(data):
            raise ValueError("a block header is cut off")
        at += 3 + (1 if (head >> 1) & 3 == 1 else head >> 3)
        if head & 1:
            break
    at += 4 * checksum
    if at > len(data):
        raise ValueError("a frame is cut off")
    return at


def frames(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, record) of each data frame; the dictionary is that of the leading skippable frame."""
    data, at = memoryview(content), 0
    plain = zstandard.ZstdDecompressor()
    unpack = plain
    while at < len(data):
        magic = int.from_bytes(data[at : at + 4], "little")
        if magic in SKIPPABLE:
            size = int.from_bytes(data[at + 4 : at + 8], "little")
            body = bytes(data[at + 8 : at + 8 + size])
            if len(body) < size:
                raise ValueError("a skippable frame is cut off")
            if magic == DICTIONARY_FRAME and at == 0:
                if body[:4] == ZSTD_MAGIC.to_bytes(4, "little"):
                    body = plain.decompressobj().decompress(body)
                unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(body))
            at += 8 + size
        elif magic == ZSTD_MAGIC:
            end = frame_end(data, at)
            yield at, unpack.decompressobj().decompress(bytes(data[at:end]))
            at = end
        else:
            raise ValueError(f"no frame begins at byte {at}")


def parse(raw: bytes) -> dict:
    """The fields of a record; ``error`` tells what is wrong with its headers, lengths or digests, null if nothing."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    out = {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
           "payload_digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:"), "payload": None, "payload_bytes": None, "error": None}
    size = fields.get("content-length", "")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if not gap or not lines[0].startswith("WARC/1."):
        out["error"] = "no WARC header"
    elif missing:
        out["error"] = f"missing {', '.join(missing)}"
    elif not size.isdigit() or len(rest) != int(size) + 4 or not rest.endswith(b"\r\n\r\n"):
        out["error"] = "wrong Content-Length"
    else:
        block = rest[:-4]
        http, _, payload = block.partition(b"\r\n\r\n")
        length = [v for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length"]
        out["payload_bytes"] = int(length[0]) if length else None
        if fields.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
            out["error"] = "wrong block digest"
        elif out["record_type"] == "response":
            out["payload"] = payload
            if out["payload_bytes"] != len(payload) or out["payload_digest"] != base32_sha1(payload):
                out["error"] = "wrong payload length or digest"
        elif out["record_type"] == "revisit" and not out["refers_to"]:
            out["error"] = "a revisit refers to nothing"
    return out


def _put(path: str, name: str, content: bytes) -> None:
    fs, base = pafs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")
    fs.create_dir(base, recursive=True)
    part = f"{base}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(content)
    fs.move(part, f"{base}/{name}")


def write(pages: DataFrame, into: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0) -> int:
    """Writes archives with a record for each row of ``pages`` into a shared folder; how many archives.

    Only digests are shuffled, to learn which payloads repeat.  Up to ``BROADCAST_DIGESTS`` of these are sent to the pages;
    beyond that pages are joined with them by a shuffle, and sorted so that archives are the same if a task runs again."""
    rows = chosen(pages, id=id_col, url=url_col, html=html_col)
    rows = rows.select(F.col("id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("html"))
    rows = rows.withColumn("key", F.unhex(F.sha1("html")))
    largest = rows.where(F.length("html") >= min_bytes).groupBy("key").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("m")).where("m > 1 AND largest IS NOT NULL")
    largest = stored(largest.select("key", "largest"))
    few = largest.count() <= BROADCAST_DIGESTS
    rows = rows.join(F.broadcast(largest) if few else largest, "key", "left")
    rows = rows.select("id", "url", "html", "largest", (F.col("largest").isNotNull() & ~F.col("id").eqNullSafe(F.col("largest"))).alias("revisit"))
    if not few:
        rows = rows.sortWithinPartitions("id", "url", F.sha1("html"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = n = 0

        def close() -> None:
            _put(into, f"{TaskContext.get().partitionId():06d}-{n:06d}.warc.zst", archive(held))

        for batch in batches:
            for i in range(batch.num_rows):
                page, url, html, largest, revisit = (c[i].as_py() for c in batch.columns)
                held.append(record(page, url, html, largest if revisit else None, revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    close()
                    held, size, n = [], 0, n + 1
        if held:
            close()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.mapInArrow(each, "n bigint").agg(F.sum("n")).first()[0] or 0


def archives_in(spark: SparkSession, path: str) -> DataFrame:
    """The archives (path, content) of a folder."""
    return spark.read.schema("path string, modificationTime timestamp, length bigint, content binary").format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path).select("path", "content")


SCHEMA = "path string, offset bigint, record_type string, record_id string, url string, refers_to string, payload_digest string, payload_bytes bigint, payload binary, error string"


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of archives, with ``error`` where it is invalid; an archive that can't be read on gives one more row that says so."""
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), *[pa.string()] * 5, pa.int64(), pa.binary(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows: list[dict] = []
                try:
                    for at, raw in frames(content.as_py() or b""):
                        rows.append({"path": path.as_py(), "offset": at} | parse(raw))
                        if not payloads:
                            rows[-1]["payload"] = None
                        if len(rows) >= 256:
                            yield out(rows)
                            rows = []
                except (ValueError, zstandard.ZstdError) as e:
                    rows.append({"path": path.as_py(), "error": str(e)})
                if rows:
                    yield out(rows)

    return archives.select("path", "content").mapInArrow(each, SCHEMA)


def query(spark, sf_dir: str) -> DataFrame:
    archives = folder(spark)
    n = write(spark.read.parquet(f"{sf_dir}/pages.parquet"), archives)
    found = read(archives_in(spark, archives) if n else spark.createDataFrame([], "path string, content binary"), payloads=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(.*)>$', 1) AS BIGINT)")
    return found.select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.when(F.col("record_type") == "revisit", number("refers_to")).alias("refers_to"), F.col("error").isNull().alias("valid"),
    )


SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
d AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS hex, count(*) OVER (PARTITION BY sha1(t)) AS m, max(page_id) OVER (PARTITION BY sha1(t)) AS largest FROM p),
r AS (SELECT *, m > 1 AND largest IS NOT NULL AND page_id IS DISTINCT FROM largest AS revisit FROM d)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, i * 5 // 4 + 1, 2))::INT >> (3 - (i * 5) % 4)) & 31), 1)), '') AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN largest END AS refers_to, true AS valid FROM r
"""
