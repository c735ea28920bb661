"""Gridded files: NetCDF variables (classic and HDF5) in slabs, GeoTIFF by strips and tiles.

Headers are read first, one small task per file; what they describe becomes one row per slab or strip, which any task can then read
by itself, so a large file is shared out and no task holds more than one slab.
"""

import math
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.sources import hdf5

# Slab lengths along times and along places.
TIME_STEPS, PLACES = 90, 40
# NetCDF classic types.
_TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}


def _place(path: str):
    """The file system and the plain path of a URI or path."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A file opened for reading at any place."""
    system, plain = _place(path)
    return system.open_input_file(plain)


def write_file(path: str, pieces) -> None:
    """Writes a file from pieces of bytes; its folder is made where it is missing."""
    system, plain = _place(path)
    system.create_dir(plain.rsplit("/", 1)[0])
    with system.open_output_stream(plain) as out:
        for piece in pieces:
            out.write(piece)


class _Reader:
    def __init__(self, source, wide: bool = False):
        self.source, self.wide = source, wide

    def int(self) -> int:
        return struct.unpack(">i", self.source.read(4))[0]

    def offset(self) -> int:
        return struct.unpack(">q", self.source.read(8))[0] if self.wide else self.int()

    def name(self) -> str:
        n = self.int()
        return self.source.read(n + -n % 4)[:n].decode()

    def attributes(self) -> dict:
        self.int()
        found = {}
        for _ in range(self.int()):
            name, kind = self.name(), _TYPES[self.int()]
            n = self.int()
            size = n * np.dtype(kind).itemsize
            raw = self.source.read(size + -size % 4)[:size]
            found[name] = raw.decode("utf-8", "replace").strip("\0") if kind == "S1" else np.frombuffer(raw, kind).tolist()
        return found


def netcdf_header(source) -> dict:
    """Dimensions, attributes and variables of a NetCDF classic (or 64-bit offset) file."""
    magic = source.read(4)
    if magic[:3] != b"CDF" or magic[3] not in (1, 2):
        raise ValueError("not a NetCDF classic file")
    r = _Reader(source, magic[3] == 2)
    records = max(0, r.int())
    r.int()
    dims = [(r.name(), r.int()) for _ in range(r.int())]
    attributes = r.attributes()
    r.int()
    variables = []
    for _ in range(r.int()):
        name = r.name()
        ids = [r.int() for _ in range(r.int())]
        own, kind, size, begin = r.attributes(), r.int(), r.int(), r.offset()
        variables.append({"name": name, "dims": ids, "attributes": own, "type": _TYPES[kind], "size": size, "begin": begin, "record": bool(ids) and dims[ids[0]][1] == 0})
    own = [np.dtype(v["type"]).itemsize * math.prod(dims[d][1] for d in v["dims"][1:]) for v in variables if v["record"]]
    # records are padded to four bytes, but for those of a file's only record variable
    stride = own[0] if len(own) == 1 else sum(size + -size % 4 for size in own)
    return {"dims": [(n, size or records) for n, size in dims], "attributes": attributes, "variables": variables, "stride": stride}


def slab_length(dim: str, size: int) -> int:
    """How many steps of a dimension a slab has, by the dimension's name."""
    low = dim.lower()
    if any(part in low for part in ("time", "date", "step")):
        return min(size, TIME_STEPS)
    if low in ("x", "y") or any(part in low for part in ("lat", "lon")):
        return min(size, PLACES)
    return size


def _read_slab(source, header: dict, variable: dict, starts: list[int], counts: list[int]) -> np.ndarray:
    """A slab's values, read one run of its first dimension at a time."""
    kind, shape = np.dtype(variable["type"]), [header["dims"][d][1] for d in variable["dims"]]
    inner = shape[1:] or [1]
    step = header["stride"] if variable["record"] else kind.itemsize * math.prod(inner)
    take = tuple(slice(s, s + c) for s, c in zip(starts[1:], counts[1:])) or (slice(None),)
    out = []
    for i in range(starts[0], starts[0] + counts[0]):
        source.seek(variable["begin"] + i * step)
        out.append(np.frombuffer(source.read(kind.itemsize * math.prod(inner)), kind).reshape(inner)[take])
    return np.stack(out)


def read_values(source, header, variable) -> np.ndarray:
    return _read_slab(source, header, variable, [0] * len(variable["dims"]), [header["dims"][d][1] for d in variable["dims"]])


class Classic:
    """A NetCDF classic file as scan_grids asks for it."""

    def __init__(self, source):
        self.source, self.header = source, netcdf_header(source)
        self.known = {v["name"]: v for v in self.header["variables"]}

    def variables(self) -> list[str]:
        coordinates = {d for d, _ in self.header["dims"]}
        return [n for n, v in self.known.items() if n not in coordinates and v["dims"] and v["type"] != "S1"]

    def dims(self, name: str) -> list[tuple[str, int]]:
        return [self.header["dims"][d] for d in self.known[name]["dims"]]

    def attributes(self, name: str) -> dict:
        return self.known[name]["attributes"]

    def fill(self, name: str):
        own = self.attributes(name)
        return (own.get("_FillValue") or own.get("missing_value") or [None])[0]

    def coordinates(self, name: str, start: int, count: int) -> np.ndarray | None:
        if name not in self.known or self.known[name]["type"] == "S1":
            return None
        return read_values(self.source, self.header, self.known[name])[start : start + count].astype(float)

    def read(self, name: str, starts: list[int], counts: list[int]) -> np.ndarray:
        return _read_slab(self.source, self.header, self.known[name], starts, counts)


def open_grid(source):
    """A gridded file by its first bytes: NetCDF classic, or HDF5 (NetCDF-4)."""
    magic = source.read(8)
    source.seek(0)
    return hdf5.Hdf5(source) if magic == hdf5.MAGIC else Classic(source)


def slab_plan(found) -> list[tuple[str, list[int], list[int]]]:
    """(variable, starts, counts) of all slabs of a gridded file."""
    slabs = []
    for v in found.variables():
        shape = found.dims(v)
        lengths = [slab_length(*d) for d in shape]
        for n in np.ndindex(*(-(-size // length) if length else 0 for (_, size), length in zip(shape, lengths))):
            starts = [i * length for i, length in zip(n, lengths)]
            slabs.append((v, starts, [min(length, size - s) for s, length, (_, size) in zip(starts, lengths, shape)]))
    return slabs


def slab_row(found, name: str, starts: list[int], counts: list[int]) -> dict | None:
    """What a slab's row says: unit, dims, lows and highs of coordinates, values; none without finite cells."""
    cells, own, fill = found.read(name, starts, counts).astype(np.float64), found.attributes(name), found.fill(name)
    if fill is not None:
        cells[cells == fill] = np.nan
    cells = cells * (own.get("scale_factor") or [1])[0] + (own.get("add_offset") or [0])[0]
    if not np.isfinite(cells).any():
        return None
    dims, lows, highs = [d for d, _ in found.dims(name)], [], []
    for dim, start, count in zip(dims, starts, counts):
        there = found.coordinates(dim, start, count)
        lows.append(float(there.min()) if there is not None else np.nan)
        highs.append(float(there.max()) if there is not None else np.nan)
    unit = own.get("units")
    return {"unit": unit if isinstance(unit, str) else None, "dims": dims, "lows": lows, "highs": highs, "values": cells.ravel().tolist()}


def scan_netcdf(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per slab with finite cells: file, variable, unit, slab, dims, starts, lows and highs of coordinates, values (doubles).

    NetCDF classic and NetCDF-4 (HDF5) files. Only numeric variables over at least one dimension that are no coordinates;
    fill values are NaN. A file that can't be read gives one row with its error.
    """

    def headers(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows, error = [], None
                try:
                    with open_file(name) as source:
                        rows = [(name, *slab, None) for slab in slab_plan(open_grid(source))]
                except Exception as failed:  # noqa: BLE001  one bad file is one row
                    error = f"{type(failed).__name__}: {failed}"
                    rows = [(name, None, [], [], error)]
                columns = list(zip(*rows)) if rows else [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.list_(pa.int64())), pa.array(columns[3], pa.list_(pa.int64())), pa.array(columns[4], pa.string())], ["file", "variable", "starts", "counts", "error"])

    def slabs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = {"file": row["file"], "variable": row["variable"], "unit": None, "dims": None, "starts": row["starts"], "lows": None, "highs": None, "values": None, "error": row["error"]}
                if row["error"] is None:
                    try:
                        with open_file(row["file"]) as source:
                            found = slab_row(open_grid(source), row["variable"], row["starts"], row["counts"])
                        out = out | found if found else None
                    except Exception as failed:  # noqa: BLE001  one bad slab is one row
                        out["error"] = f"{type(failed).__name__}: {failed}"
                if out:
                    yield pa.RecordBatch.from_pylist([out], schema=_SLABS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    planned = files.mapInArrow(headers, "file string, variable string, starts array<long>, counts array<long>, error string")
    return planned.repartition(spark.sparkContext.defaultParallelism).mapInArrow(slabs, SLABS)


SLABS = "file string, variable string, unit string, dims array<string>, starts array<long>, lows array<double>, highs array<double>, values array<double>, error string"
_SLABS = pa.schema([("file", pa.string()), ("variable", pa.string()), ("unit", pa.string()), ("dims", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())), ("values", pa.list_(pa.float64())), ("error", pa.string())])


def slab_stats(slabs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """The eight statistics of each slab's finite cells, without a row per cell; keep: further columns to hand on."""
    kept = ["file", "variable", "unit", "starts", "error", *keep]
    names = ["mean", "std", "min", "max", "p10", "median", "p90", "range"]

    def stats(batches):
        for batch in batches:
            rows = []
            for v in batch.column("values").to_pylist():
                cells = np.array(v, np.float64) if v else np.zeros(0)
                cells = cells[np.isfinite(cells)]
                p = np.percentile(cells, [10, 50, 90]) if len(cells) else [None] * 3
                rows.append([float(cells.mean()), float(cells.std()), float(cells.min()), float(cells.max()), *map(float, p), float(np.ptp(cells))] if len(cells) else [None] * 8)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in kept] + [pa.array(c, pa.float64()) for c in zip(*rows)], [*kept, *names])

    return slabs.mapInArrow(stats, ", ".join([*(f"`{c}` {slabs.schema[c].dataType.simpleString()}" for c in kept), *(f"{n} double" for n in names)]))


# TIFF field sizes by type, and the tags that are read.
_FIELD = {1: "B", 2: "c", 3: "H", 4: "I", 11: "f", 12: "d", 16: "Q"}
_TAGS = {
    256: "width", 257: "height", 258: "bits", 259: "compression", 270: "description", 273: "offsets", 277: "bands", 278: "rows_per_strip", 279: "sizes", 284: "planar", 317: "predictor", 322: "tile_width", 323: "tile_height",
    324: "tile_offsets", 325: "tile_sizes", 339: "format", 33550: "scale", 33922: "tie", 42112: "metadata", 42113: "nodata",
}
# What names a variable in a file's metadata.
_NAMING = ("description", "name", "variable", "title", "label")


def tiff_header(source) -> dict:
    """The fields of the first image of a TIFF or BigTIFF file."""
    order = {b"II": "<", b"MM": ">"}[source.read(2)]
    big = struct.unpack(order + "H", source.read(2))[0] == 43
    source.seek(8 if big else 4)
    wide, room = ("Q", 8) if big else ("I", 4)
    source.seek(struct.unpack(order + wide, source.read(room))[0])
    count = struct.unpack(order + ("Q" if big else "H"), source.read(8 if big else 2))[0]
    each = 20 if big else 12
    entries, found = source.read(each * count), {"order": order, "compression": [1], "bands": [1], "format": [1], "planar": [1], "predictor": [1]}
    for i in range(count):
        tag, kind, n = struct.unpack_from(order + "HH" + wide, entries, each * i)
        if tag in _TAGS and kind in _FIELD:
            size = struct.calcsize(_FIELD[kind]) * n
            place = each * i + 4 + room
            if size > room:
                source.seek(struct.unpack_from(order + wide, entries, place)[0])
                raw = source.read(size)
            else:
                raw = entries[place : place + size]
            found[_TAGS[tag]] = raw.rstrip(b"\0").decode("utf-8", "replace") if kind == 2 else list(struct.unpack(f"{order}{n}{_FIELD[kind]}", raw))
    return found


def tiff_name(header: dict) -> str:
    """The variable: the image's description, else the first metadata item that is a name of some kind, else the band."""
    if header.get("description", "").strip():
        return header["description"].strip()
    for name, value in re.findall(r'<Item name="([^"]*)"[^>]*>([^<]*)</Item>', header.get("metadata", "")):
        if any(word in name.lower() for word in _NAMING) and value.strip():
            return value.strip()
    return "band_1"


def _lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes from the highest bit, one bit longer when the table is one short of full."""
    out, table, previous, width = [], [], b"", 9
    held = bits = 0
    start = [bytes([i]) for i in range(256)] + [b"", b""]
    for byte in raw:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, previous, width = start.copy(), b"", 9
            continue
        if code < len(table):
            entry = table[code]
        elif previous:
            entry = previous + previous[:1]
        else:
            raise ValueError("LZW data without a clear code")
        out.append(entry)
        if previous:
            table.append(previous + entry[:1])
        previous = entry
        width = min(12, max(9, (len(table) + 1).bit_length()))
    return b"".join(out)


def _packbits(raw: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(raw):
        n, at = raw[at], at + 1
        if n < 128:
            out += raw[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += raw[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


# Compressions that are read.
_UNPACK = {1: bytes, 5: _lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: _packbits}


def tiff_blocks(header: dict) -> tuple[int, int, int, int]:
    """Rows and columns of a block, and blocks down and across the first band: strips span the width."""
    rows = header["tile_height"][0] if "tile_offsets" in header else min(header.get("rows_per_strip", header["height"])[0], header["height"][0])
    columns = header["tile_width"][0] if "tile_offsets" in header else header["width"][0]
    return rows, columns, -(-header["height"][0] // rows), -(-header["width"][0] // columns)


def read_block(source, header: dict, block: int) -> tuple[np.ndarray, int, int]:
    """The first band's cells of a block, and the row and column where it begins."""
    rows, columns, _, across = tiff_blocks(header)
    row, column = block // across * rows, block % across * columns
    tiled = "tile_offsets" in header
    offset, size = ((header["tile_offsets"], header["tile_sizes"]) if tiled else (header["offsets"], header["sizes"]))
    bits, bands = header["bits"][0], header["bands"][0] if header["planar"][0] == 1 else 1
    kind = np.dtype(header["order"] + {1: "u", 2: "i", 3: "f"}[header["format"][0]] + str(bits // 8))
    high = rows if tiled else min(rows, header["height"][0] - row)
    if size[block] == 0:  # a block of a sparse file that was never written
        return np.zeros((min(high, header["height"][0] - row), min(columns, header["width"][0] - column))), row, column
    source.seek(offset[block])
    raw = _UNPACK[header["compression"][0]](source.read(size[block]))[: high * columns * bands * kind.itemsize]
    if header["predictor"][0] == 3:  # rows of sorted bytes, each the difference to the one a sample before
        planes = np.frombuffer(raw, np.uint8).reshape(high, -1, bands).cumsum(axis=1, dtype=np.uint8).reshape(high, kind.itemsize, columns * bands)
        cells = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(kind.newbyteorder(">")).reshape(high, columns, bands)
    else:
        cells = np.frombuffer(raw, kind).reshape(high, columns, bands)
        if header["predictor"][0] == 2:
            cells = cells.astype(kind.newbyteorder("=")).cumsum(axis=1, dtype=kind.newbyteorder("="))
    cells = cells[: header["height"][0] - row, : header["width"][0] - column, 0].astype(np.float64)
    return cells, row, column


def block_count(header: dict) -> int:
    """How many blocks the first band has, if they can be read."""
    if header["compression"][0] not in _UNPACK or header["predictor"][0] not in (1, 2, 3) or header["bits"][0] % 8:
        raise ValueError(f"compression {header['compression'][0]} with predictor {header['predictor'][0]} and {header['bits'][0]} bits is not read")
    _, _, down, across = tiff_blocks(header)
    return down * across


def block_row(source, header: dict, block: int) -> dict | None:
    """What a block's row says; none without finite cells."""
    cells, top, left = read_block(source, header, block)
    if header.get("nodata"):
        cells[cells == float(header["nodata"])] = np.nan
    if not np.isfinite(cells).any():
        return None
    (sx, sy), (i, j, _, x, y, _) = header.get("scale", [1.0, 1.0])[:2], header.get("tie", [0.0] * 6)[:6]
    north, west = y - (top - j) * sy, x + (left - i) * sx
    return {"variable": tiff_name(header), "starts": [top, left], "lows": [north - cells.shape[0] * sy, west], "highs": [north, west + cells.shape[1] * sx], "values": cells.ravel().tolist()}


def scan_geotiff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per block of a GeoTIFF's first band with finite cells: like scan_netcdf, with row and column bounds as latitudes and longitudes.

    Blocks are strips or tiles, as they are or compressed by LZW, deflate or runs, with differences undone; of a tile that
    crosses the edge only cells inside count.
    """

    def plan(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                n, error = 1, None
                try:
                    with open_file(name) as source:
                        h = tiff_header(source)
                    n = block_count(h)
                except Exception as failed:  # noqa: BLE001  one bad file is one row
                    error = f"{type(failed).__name__}: {failed}"
                yield pa.RecordBatch.from_pydict({"file": [name] * n, "block": list(range(n)), "error": pa.array([error] * n, pa.string())})

    def blocks(batches):
        for batch in batches:
            for row in batch.to_pylist():
                out = {"file": row["file"], "variable": "band_1", "unit": None, "dims": ["lat", "lon"], "starts": [], "error": row["error"]}
                if row["error"] is None:
                    try:
                        with open_file(row["file"]) as source:
                            found = block_row(source, tiff_header(source), row["block"])
                        out = out | found if found else None
                    except Exception as failed:  # noqa: BLE001
                        out["error"] = f"{type(failed).__name__}: {failed}"
                if out:
                    yield pa.RecordBatch.from_pylist([out], schema=_SLABS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    planned = files.mapInArrow(plan, "file string, block long, error string").repartition(spark.sparkContext.defaultParallelism)
    return planned.mapInArrow(blocks, SLABS)
