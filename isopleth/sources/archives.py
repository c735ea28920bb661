"""Archives and compressed files: their members written out as files of their own, and loading of any file by its format."""

import gzip
import io
import os
import tarfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.functions.texts import is_html, magic_format
from isopleth.sources import delimited, grib, grid
from isopleth.sources.grid import open_file, write_file

# Fixed value: bytes that one archive or compressed file may unpack to.
MOST_BYTES = 3000 * 1024 * 1024
# Member suffixes that are read, and the format of each.
MEMBERS = {".nc": "netcdf", ".nc4": "netcdf", ".h5": "hdf5", ".tif": "geotiff", ".tiff": "geotiff", ".csv": "csv", ".tsv": "csv", ".txt": "csv", ".grib": "grib", ".grib2": "grib"}
# Formats by a file's own suffix.
SUFFIXES = MEMBERS | {".he5": "hdf5", ".hdf5": "hdf5", ".hdf": "netcdf", ".grb": "grib", ".zip": "zip", ".tar": "tar", ".gz": "gz", ".tgz": "gz"}
PIECE = 16 << 20


def suffix_of(name: str) -> str:
    return os.path.splitext(name.lower())[1]


class TooLarge(ValueError):
    """A file unpacks to more than the bound."""


class _Bound:
    """Hands on pieces of streams, up to a bound on all of them together."""

    def __init__(self, most: int):
        self.most, self.left = most, most

    def __call__(self, source):
        while piece := source.read(PIECE):
            self.left -= len(piece)
            if self.left < 0:
                raise TooLarge(f"unpacks to more than {self.most >> 20} MB")
            yield piece


def members(source, name: str, most: int = MOST_BYTES):
    """(member name, pieces of its bytes) of an archive, or of a compressed file; names with a leading dot and folders are skipped.

    `most` bounds all members together, of those whose pieces are taken.
    Nothing is unpacked under a member's own name, so a name that points outside does no harm.
    """
    kind, bounded = SUFFIXES.get(suffix_of(name)), _Bound(most)
    if kind == "gz":
        inner = name.rsplit("/", 1)[-1][: -len(suffix_of(name))] or "member"
        stream = io.BufferedReader(gzip.GzipFile(fileobj=source), PIECE)
        head = stream.peek(512)
        if len(head) >= 262 and head[257:262] == b"ustar":
            with tarfile.open(fileobj=stream, mode="r|") as tar:
                yield from _tar(tar, bounded)
        else:
            yield inner if suffix_of(inner) else inner + ".nc", bounded(stream)
    elif kind == "tar":
        with tarfile.open(fileobj=source, mode="r|*") as tar:
            yield from _tar(tar, bounded)
    elif kind == "zip":
        with zipfile.ZipFile(source) as archive:
            for info in archive.infolist():
                base = info.filename.rsplit("/", 1)[-1]
                if not info.is_dir() and base and not base.startswith(".") and "__MACOSX" not in info.filename:
                    with archive.open(info) as inner:
                        yield info.filename, bounded(inner)


def _tar(tar: tarfile.TarFile, bounded: _Bound):
    for info in tar:
        base = info.name.rsplit("/", 1)[-1]
        if info.isfile() and base and not base.startswith("."):
            yield info.name, bounded(tar.extractfile(info))


_FOUND = pa.schema([("archive", pa.string()), ("member", pa.string()), ("path", pa.string()), ("format", pa.string()), ("error", pa.string())])


def unpack(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Writes the readable members of archives under a shared folder, one archive per task at a time: archive, member, path, format, error.

    files: path. An archive that fails gives a row with its error, after the members that came before it. A task that
    runs again writes files of its own, and only the rows of the task that counts name them.
    """

    def run(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows = []
                try:
                    with open_file(name) as source:
                        for member, pieces in members(source, name):
                            kind = MEMBERS.get(suffix_of(member))
                            if kind:
                                target = f"{folder}/{uuid.uuid4().hex}{suffix_of(member)}"
                                write_file(target, pieces)
                                rows.append((name, member, target, kind, None))
                    if not rows:
                        rows.append((name, None, None, None, "no readable members"))
                except Exception as failed:  # noqa: BLE001  one bad archive is one row
                    rows.append((name, None, None, None, f"{type(failed).__name__}: {failed}"))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], schema=_FOUND)

    spread = files.select("path").repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, "archive string, member string, path string, format string, error string")


def formats(spark: SparkSession, path: str) -> DataFrame:
    """path, format, html of each file: by its suffix, else by its first bytes; a format of null means that neither tells."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    known = F.create_map(*(F.lit(x) for pair in SUFFIXES.items() for x in pair))
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    by_name = files.select("path", known[suffix].alias("format"), "length")
    # only files whose names tell nothing are opened
    unknown = files.where(known[suffix].isNull()).select("path", F.coalesce(magic_format(F.col("content")), F.when(~is_html(F.col("content")), "csv")).alias("by_bytes"), is_html(F.col("content")).alias("html"))
    return by_name.join(unknown, "path", "left").select("path", F.coalesce("format", "by_bytes").alias("format"), F.coalesce("html", F.lit(False)).alias("html"))


STATS = ["mean", "std", "min", "max", "p10", "median", "p90", "range"]


def load(spark: SparkSession, path: str, scratch: str) -> DataFrame:
    """Chunk statistics of all files below a path, whatever their formats: file, variable, unit, station_col, place, time_start, time_end, the eight statistics, error.

    Archives and compressed files are unpacked under `scratch` first, once; what is inside them is read like any other
    file, but not archives in archives. A file that can't be read, by its format or its content, gives one row with its
    error and no numbers.
    """
    found = formats(spark, path).collect()  # a listing of files, as the reader itself holds
    packed = [r.path for r in found if r.format in ("zip", "tar", "gz", "gzip")]
    opened, errors = [(r.path, r.format) for r in found if r.path not in set(packed)], []
    if packed:
        for r in unpack(spark, spark.createDataFrame([(p,) for p in packed], "path string"), scratch.rstrip("/")).collect():
            opened += [(r.path, r.format)] if r.error is None else []
            errors += [(r.archive, r.error)] if r.error else []
    opened = [(p, "netcdf" if k == "hdf5" else k) for p, k in opened]  # one reader tells them apart by their first bytes
    of = lambda kind: [p for p, k in opened if k == kind]
    errors += [(p, f"{k or 'unknown'} files are not read") for p, k in opened if k not in ("netcdf", "geotiff", "grib", "csv")]
    columns = ["file", "variable", "unit", "station_col", "place", "time_start", "time_end", *STATS, "error"]
    none = "file string, variable string, unit string, station_col string, place string, time_start string, time_end string, " + ", ".join(f"{s} double" for s in STATS) + ", error string"
    parts = [spark.createDataFrame([(p, *[None] * 14, e) for p, e in errors], none)]
    text = lambda c: F.col(c).cast("string")
    for kind, scan in (("netcdf", grid.scan_netcdf), ("geotiff", grid.scan_geotiff)):
        if of(kind):
            stats = grid.slab_stats(scan(spark, of(kind)))
            parts.append(stats.select("file", "variable", "unit", F.lit(None).cast("string").alias("station_col"), F.array_join(F.transform("starts", lambda s: s.cast("string")), ",").alias("place"), F.lit(None).cast("string").alias("time_start"), F.lit(None).cast("string").alias("time_end"), *STATS, "error"))
    if of("grib"):
        slabs = grib.scan_grib(spark, of("grib"))
        tagged = F.concat(F.coalesce(F.concat(F.lit("npts="), text("grid_npts"), F.lit(":")), F.lit("")), F.array_join(F.transform("starts", lambda s: s.cast("string")), ","))
        parts.append(grid.slab_stats(slabs.withColumn("place", tagged), ["place", "time_start", "time_end"]).withColumn("station_col", F.lit(None).cast("string")))
    if of("csv"):
        for rows in delimited.layouts(spark, of("csv")):
            chunks = delimited.chunks(rows)
            if "station" in chunks.columns:
                parts.append(chunks.select(F.col("_file").alias("file"), "variable", F.lit(None).cast("string").alias("unit"), text("station_col"), F.coalesce(text("station"), text("block")).alias("place"), "time_start", "time_end", *STATS, F.lit(None).cast("string").alias("error")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part.select(*columns))
    return out
