"""Seekable Zstandard bundles of WARC records.

A bundle holds records in independent Zstandard frames of about `frame_bytes` each, then two skippable frames: the
record map (record identifier to frame number and offset in the frame's data) and the seek table of the Zstandard
seekable format (sizes of each frame packed and unpacked). A reader seeks to one frame for one record.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.llm.common import Rows, filesystem, new_folder, text_or_empty

#: Fixed values of the Zstandard formats: skippable frames' magic numbers and the seek table's own.
SKIP_SEEK, SKIP_MAP, SEEKABLE = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
CRLF = b"\r\n"


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """A response record, or a revisit that keeps the HTTP headers and leaves the payload out."""
    digest = payload_digest(payload)
    http = b"HTTP/1.1 200 OK" + CRLF + b"Content-Type: text/html; charset=utf-8" + CRLF + b"Content-Length: %d" % len(payload) + CRLF + CRLF
    block = http if revisit else http + payload
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url or "")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {target}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return CRLF.join(x.encode() for x in head) + CRLF + CRLF + block + CRLF + CRLF


def parse(data: bytes, at: int = 0) -> tuple[dict, int]:
    """(fields of the record at an offset, offset after it)."""
    end = data.index(CRLF + CRLF, at)
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:end].decode().split("\r\n")[1:])
    start, size = end + 4, int(fields["Content-Length"])
    block = data[start : start + size]
    http_end = block.index(CRLF + CRLF)
    http = dict(line.split(": ", 1) for line in block[:http_end].decode().split("\r\n")[1:])
    number = lambda urn: int(urn[10:-1]) if urn and urn != "<urn:page:>" else None
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "payload_digest": fields["WARC-Payload-Digest"][5:],
        "payload_bytes": int(http["Content-Length"]), "refers_to": number(fields.get("WARC-Refers-To")), "payload": block[http_end + 4 :],
    }, start + size + 4


class BundleWriter:
    def __init__(self, sink, frame_bytes: int = 1 << 20, level: int = 3):
        self.sink, self.frame_bytes, self.pack = sink, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.frame, self.sizes, self.map = bytearray(), [], []

    def add(self, page_id: int | None, data: bytes) -> None:
        self.map.append((page_id, len(self.sizes), len(self.frame)))
        self.frame += data
        if len(self.frame) >= self.frame_bytes:
            self._flush()

    def _flush(self) -> None:
        packed = self.pack.compress(bytes(self.frame))
        self.sink.write(packed)
        self.sizes.append((len(packed), len(self.frame)))
        self.frame = bytearray()

    def close(self) -> None:
        if self.frame:
            self._flush()
        records = sorted((-(1 << 63) if k is None else k, n, at) for k, n, at in self.map)
        entries = b"".join(struct.pack("<qIQ", *x) for x in records) + struct.pack("<Q", len(records))
        self.sink.write(struct.pack("<II", SKIP_MAP, len(entries)) + entries)
        table = b"".join(struct.pack("<II", *x) for x in self.sizes)
        # the map counts as a frame of no data, so that sizes add up for any reader of seekable files
        table += struct.pack("<II", len(entries) + 8, 0)
        body = table + struct.pack("<IBI", len(self.sizes) + 1, 0, SEEKABLE)
        self.sink.write(struct.pack("<II", SKIP_SEEK, len(body)) + body)


class BundleReader:
    def __init__(self, source):
        self.source, size = source, source.seek(0, 2) if not hasattr(source, "size") else source.size()
        frames, _, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError("not a seekable bundle")
        table = self._read(size - 9 - 8 * frames, 8 * frames)
        self.frames, at = [], 0
        for packed, unpacked in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, unpacked))
            at += packed
        at_map, n_map, _ = self.frames.pop()
        entries = self._read(at_map + 8, n_map - 8)
        self.records = list(struct.iter_unpack("<qIQ", entries[:-8]))
        self.unpack = zstandard.ZstdDecompressor()

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        return self.source.read(n)

    def frame(self, number: int) -> bytes:
        at, packed, unpacked = self.frames[number]
        return self.unpack.decompress(self._read(at, packed), max_output_size=unpacked)

    def scan(self) -> Iterator[dict]:
        """All records, frame by frame, each found at its mapped offset."""
        by_frame: dict[int, list[int]] = {}
        for _, number, at in self.records:
            by_frame.setdefault(number, []).append(at)
        for number in sorted(by_frame):
            data = self.frame(number)
            for at in sorted(by_frame[number]):
                yield parse(data, at)[0]

    def get(self, page_id: int) -> list[dict]:
        at, found = bisect.bisect_left(self.records, (page_id,)), []
        while at < len(self.records) and self.records[at][0] == page_id:
            found.append(parse(self.frame(self.records[at][1]), self.records[at][2])[0])
            at += 1
        return found


def with_kinds(pages: DataFrame, least_bytes: int = 0, salts: int = 32) -> DataFrame:
    """page_id, url, html and refers_to: of pages with equal payloads the smallest identifier, null for that page itself.

    Payloads are compared by SHA-1 and length. First pages are found by a pre-aggregated minimum; only digests that
    more than one page has are joined back, each repeated for every salt, so a payload that a third of the pages
    share is dealt out over many tasks. Pages with a missing identifier are never referred to; a page whose
    identifier equals the first's (a repeated row) is a response too.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.encode("html", "UTF-8")))).withColumn("bytes", F.octet_length("html").cast("long"))
    shared = rows.where(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    shared = shared.select(F.col("digest").alias("d"), F.col("bytes").alias("b"), "first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("s"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
    joined = rows.join(shared, (F.col("digest") == F.col("d")) & (F.col("bytes") == F.col("b")) & (F.col("salt") == F.col("s")), "left")
    return joined.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_bundles(pages: DataFrame, folder: str, least_bytes: int = 0, frame_bytes: int = 1 << 20) -> list[str]:
    """Writes one bundle per task and returns their paths; a task writes under a name of its own and renames at the end."""

    def write(batches):
        context, writer = TaskContext.get(), None
        for batch in batches:
            for page_id, url, html, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if writer is None:
                    files, base = filesystem(folder)
                    files.create_dir(base, recursive=True)
                    name, draft = f"{base}/part-{context.partitionId():06d}.warc.zst", f"{base}/_draft-{context.partitionId()}-{context.taskAttemptId()}"
                    sink = files.open_output_stream(draft)
                    writer = BundleWriter(sink, frame_bytes)
                writer.add(page_id, record(page_id, url, html.encode("utf-8"), refers_to, refers_to is not None))
        if writer is not None:
            writer.close()
            sink.close()
            files.move(draft, name)
            yield pa.RecordBatch.from_pydict({"path": [name]})

    return sorted(r.path for r in with_kinds(pages, least_bytes).mapInArrow(write, "path string").collect())


RECORDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_bundles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per record of the bundles; a response's payload is checked against its digest and length."""

    def read(batches):
        rows = Rows(RECORDS)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                files, path = filesystem(path)
                with files.open_input_file(path) as source:
                    for x in BundleReader(source).scan():
                        if x["record_type"] == "response" and (payload_digest(x["payload"]), len(x["payload"])) != (x["payload_digest"], x["payload_bytes"]):
                            raise ValueError(f"damaged record {x['page_id']} in {path}")
                        rows.add(*(x[c] for c in RECORDS.names))
                        if rows.full():
                            yield rows.take()
        yield rows.take()

    files = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)))
    return files.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages as WARC bundles in the shared folder and reads the archives back.

    A missing html is an empty payload; missing urls and identifiers stay empty in the record; an empty table gives no
    bundles and no rows; other columns are ignored.
    """
    spark = pages.sparkSession
    return read_bundles(spark, write_bundles(pages, new_folder(spark, "warc"), least_bytes))
