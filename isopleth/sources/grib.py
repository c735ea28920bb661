"""GRIB files of both editions: regular latitude-longitude grids, simple packing.

A file's sections are scanned by their headers, one small task per file; its fields are then read by blocks of times and
bands of rows, each by the task that needs it. Fields of different grids are sets of their own.
"""

import datetime
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from isopleth.sources.grid import PLACES, TIME_STEPS, open_file

# Short names and units of some parameters, by table (edition 1) or by discipline, category and number.
_FIRST = {34: ("sst", "K"), 129: ("z", "m2 s-2"), 130: ("t", "K"), 131: ("u", "m s-1"), 132: ("v", "m s-1"), 133: ("q", "kg kg-1"), 134: ("sp", "Pa"), 151: ("msl", "Pa"), 165: ("u10", "m s-1"), 166: ("v10", "m s-1"), 167: ("t2m", "K"), 168: ("d2m", "K"), 228: ("tp", "m")}
_SECOND = {(0, 0, 0): ("t", "K"), (0, 0, 6): ("dpt", "K"), (0, 1, 0): ("q", "kg kg-1"), (0, 1, 1): ("r", "%"), (0, 1, 8): ("tp", "kg m-2"), (0, 2, 2): ("u", "m s-1"), (0, 2, 3): ("v", "m s-1"), (0, 3, 0): ("sp", "Pa"), (0, 3, 1): ("prmsl", "Pa"), (0, 3, 5): ("gh", "gpm")}
# Hours of a forecast's time units.
_HOURS = {0: 1 / 60, 1: 1, 2: 24, 10: 3, 11: 6, 12: 12, 13: 1 / 3600}


def _signed(raw: bytes) -> int:
    """An integer with its sign in the first bit."""
    value = int.from_bytes(raw, "big")
    top = 1 << 8 * len(raw) - 1
    return -(value - top) if value & top else value


def _ibm(raw: bytes) -> float:
    value = int.from_bytes(raw, "big")
    return (-1.0 if value >> 31 else 1.0) * (value & 0xFFFFFF) * 2.0**-24 * 16.0 ** ((value >> 24 & 127) - 64)


def _ones(raw: bytes, width: int, skip: int, count: int) -> np.ndarray:
    """`count` unsigned integers of `width` bits each, after `skip` bits."""
    if width == 0:
        return np.zeros(count)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8))[skip : skip + width * count].reshape(count, width)
    return bits.astype(np.float64) @ (2.0 ** np.arange(width - 1, -1, -1))


def _grid(raw: bytes, edition: int) -> dict:
    """Numbers of points and corners of a grid section."""
    if edition == 2:
        if int.from_bytes(raw[12:14], "big") != 0:
            return {"points": int.from_bytes(raw[6:10], "big"), "error": "only regular latitude-longitude grids are read"}
        nx, ny = struct.unpack_from(">II", raw, 30)
        corners = [_signed(raw[a : a + 4]) / 1e6 for a in (46, 50, 55, 59)]
        mode = raw[71]
    else:
        if raw[5] != 0:
            return {"points": 0, "error": "only regular latitude-longitude grids are read"}
        nx, ny = struct.unpack_from(">HH", raw, 6)
        corners = [_signed(raw[a : a + 3]) / 1e3 for a in (10, 13, 17, 20)]
        mode = raw[27]
    error = "rows from east to west or columns first are not read" if mode & 0xA0 else None
    return {"points": nx * ny, "nx": nx, "ny": ny, "corners": corners, "error": error}


def fields(source):
    """Each field's place and meaning; data are not read: variable, unit, level, time, grid, packing, bitmap and data places."""
    source.seek(0, 2)
    end, at = source.tell(), 0
    while at + 16 <= end:
        source.seek(at)
        head = source.read(16)
        if head[:4] != b"GRIB":
            skip = source.read(1 << 16).find(b"GRIB") if b"GRIB" not in head else head.find(b"GRIB") - 16
            if skip < 0 and b"GRIB" not in head:
                break
            at += 16 + skip
            continue
        if head[7] == 2:
            total = int.from_bytes(head[8:16], "big")
            yield from _second(source, at, total, head[6])
        elif head[7] == 1:
            total = int.from_bytes(head[4:7], "big")
            yield _first(source, at)
        else:
            raise ValueError(f"GRIB edition {head[7]} is not read")
        at += max(total, 16)
    if at == 0:
        raise ValueError("not a GRIB file")


def _second(source, at: int, total: int, discipline: int):
    end, own = at + total - 4, {"bitmap": None}
    at += 16
    while at < end:
        source.seek(at)
        head = source.read(5)
        length, number = int.from_bytes(head[:4], "big"), head[4]
        if length < 5:
            raise ValueError("a GRIB section of no length")
        raw = head + source.read(min(length, 256) - 5) if number != 7 else b""
        if number == 1:
            year, *rest = struct.unpack_from(">HBBBBB", raw, 12)
            own["base"] = datetime.datetime(year, *rest)
        elif number == 3:
            own["grid"] = _grid(raw, 2)
        elif number == 4:
            key = (discipline, raw[9], raw[10])
            own["variable"], own["unit"] = _SECOND.get(key, ("param_%d_%d_%d" % key, None))
            hours = _HOURS.get(raw[17], 1) * int.from_bytes(raw[18:22], "big")
            own["time"] = own["base"] + datetime.timedelta(hours=hours)
            own["level"] = _signed(raw[24:28]) / 10.0 ** _signed(raw[23:24]) if raw[23] != 255 else 0.0
        elif number == 5:
            template = int.from_bytes(raw[9:11], "big")
            own["error"] = None if template == 0 else f"GRIB packing {template} is not read"
            own["scale"] = [struct.unpack_from(">f", raw, 11)[0], 2.0 ** _signed(raw[15:17]), 10.0 ** -_signed(raw[17:19])]
            own["width"] = raw[19]
        elif number == 6 and raw[5] != 254:
            own["bitmap"] = at + 6 if raw[5] == 0 else None
        elif number == 7:
            yield own | {"data": at + 5, "size": length - 5, "error": own["error"] or own["grid"]["error"]}
        at += length


def _first(source, at: int) -> dict:
    at += 8
    source.seek(at)
    size = int.from_bytes(source.read(3), "big")
    source.seek(at)
    p = source.read(size)
    variable, unit = _FIRST.get(p[8], (f"var{p[8]}", None))
    hours = _HOURS.get(p[17], 1) * (int.from_bytes(p[18:20], "big") if p[20] == 10 else p[19] if p[20] in (2, 3, 4, 5) else p[18])
    time = datetime.datetime((p[24] - 1) * 100 + p[12], *p[13:17]) + datetime.timedelta(hours=hours)
    at += size
    grid, bitmap = {"points": 0, "error": "a GRIB field without its grid is not read"}, None
    for there, kind in ((p[7] & 0x80, "grid"), (p[7] & 0x40, "bitmap")):
        if there:
            source.seek(at)
            size = int.from_bytes(source.read(3), "big")
            if kind == "grid":
                source.seek(at)
                grid = _grid(source.read(size), 1)
            else:
                bitmap = at + 6
            at += size
    source.seek(at)
    b = source.read(11)
    error = grid["error"] or ("only simple GRIB packing is read" if b[3] & 0xC0 else None)
    scale = [_ibm(b[6:10]), 2.0 ** _signed(b[4:6]), 10.0 ** -_signed(p[26:28])]
    return {"variable": variable, "unit": unit, "level": float(int.from_bytes(p[10:12], "big")), "time": time, "grid": grid, "bitmap": bitmap, "scale": scale, "width": b[10], "data": at + 11, "size": int.from_bytes(b[:3], "big") - 11, "error": error}


def read_rows(source, field: dict, row: int, rows: int) -> np.ndarray:
    """Some rows of a field; what the bitmap leaves out is NaN. Without a bitmap only the rows' own bits are read."""
    nx, width = field["grid"]["nx"], field["width"]
    reference, by, tens = field["scale"]
    first, count = row * nx, rows * nx
    if field["bitmap"] is None:
        begin = first * width
        source.seek(field["data"] + begin // 8)
        raw = source.read(-(-(begin % 8 + count * width) // 8))
        return ((reference + _ones(raw, width, begin % 8, count) * by) * tens).reshape(rows, nx)
    source.seek(field["bitmap"])
    there = np.unpackbits(np.frombuffer(source.read(-(-field["grid"]["points"] // 8)), np.uint8))[: field["grid"]["points"]].astype(bool)
    before, inside = int(there[:first].sum()), there[first : first + count]
    source.seek(field["data"] + before * width // 8)
    raw = source.read(-(-(before * width % 8 + int(inside.sum()) * width) // 8))
    out = np.full(count, np.nan)
    out[inside] = (reference + _ones(raw, width, before * width % 8, int(inside.sum())) * by) * tens
    return out.reshape(rows, nx)


_PLAN = "file string, variable string, unit string, npts long, grids int, numbers array<int>, levels int, time long, row int, rows int, error string"
_PLANNED = pa.schema([("file", pa.string()), ("variable", pa.string()), ("unit", pa.string()), ("npts", pa.int64()), ("grids", pa.int32()), ("numbers", pa.list_(pa.int32())), ("levels", pa.int32()), ("time", pa.int64()), ("row", pa.int32()), ("rows", pa.int32()), ("error", pa.string())])
SLABS = "file string, variable string, unit string, dims array<string>, starts array<long>, lows array<double>, highs array<double>, time_start string, time_end string, grid_npts long, values array<double>, error string"
_SLABS = pa.schema([("file", pa.string()), ("variable", pa.string()), ("unit", pa.string()), ("dims", pa.list_(pa.string())), ("starts", pa.list_(pa.int64())), ("lows", pa.list_(pa.float64())), ("highs", pa.list_(pa.float64())), ("time_start", pa.string()), ("time_end", pa.string()), ("grid_npts", pa.int64()), ("values", pa.list_(pa.float64())), ("error", pa.string())])


def plan_fields(found: list[dict]) -> list[tuple]:
    """(variable, unit, points, grids, field numbers by time and level, levels, first time's place, first row, rows) of each block, the larger grids first.

    Fields of a variable and grid are one set: times by levels where each time has each level, else a set per level. The
    last field counts of several for one time and level.
    """
    sets: dict[tuple, dict] = {}
    for number, f in enumerate(found):
        sets.setdefault((f["grid"]["points"], f["variable"], f["unit"]), {})[f["time"], f["level"]] = number
    grids, out = len({points for points, *_ in sets}), []
    for (points, variable, unit), places in sorted(sets.items(), key=lambda s: (-s[0][0], s[0][1])):
        times, levels = sorted({t for t, _ in places}), sorted({v for _, v in places})
        whole = len(places) == len(times) * len(levels)
        for group in [levels] if whole else [[v] for v in levels]:
            own = [t for t in times if (t, group[0]) in places]
            for at in range(0, len(own), TIME_STEPS):
                numbers = [places[t, v] for t in own[at : at + TIME_STEPS] for v in group]
                ny = found[numbers[0]]["grid"]["ny"]
                out += [(variable, unit, points, grids, numbers, len(group), at, row, min(PLACES, ny - row)) for row in range(0, ny, PLACES)]
    return out


def block_rows(source, found: list[dict], row: dict):
    """The rows of a block of times and grid rows: one for each run of columns with finite cells."""
    own = [found[i] for i in row["numbers"]]
    cells = np.stack([read_rows(source, f, row["row"], row["rows"]) for f in own])
    grid, levels = own[0]["grid"], row["levels"]
    cells = cells.reshape(-1, levels, *cells.shape[1:])
    lat0, lon0, lat1, lon1 = grid["corners"]
    if lon1 < lon0:
        lon1 += 360
    lats = np.linspace(lat0, lat1, grid["ny"])[row["row"] : row["row"] + row["rows"]]
    lons = np.linspace(lon0, lon1, grid["nx"])
    level = [f["level"] for f in own[:levels]]
    for x in range(0, grid["nx"], PLACES):
        part = cells[..., x : x + PLACES]
        if np.isfinite(part).any():
            east = lons[x : x + PLACES]
            dims, starts = ["time", "level", "lat", "lon"], [row["time"], 0, row["row"], x]
            lows, highs = [np.nan, min(level), lats.min(), east.min()], [np.nan, max(level), lats.max(), east.max()]
            keep = [0, 1, 2, 3] if levels > 1 else [0, 2, 3]
            yield {
                "variable": row["variable"], "unit": row["unit"], "dims": [dims[i] for i in keep], "starts": [starts[i] for i in keep], "lows": [float(lows[i]) for i in keep], "highs": [float(highs[i]) for i in keep],
                "time_start": str(own[0]["time"]), "time_end": str(own[-1]["time"]), "grid_npts": row["npts"] if row["grids"] > 1 else None, "values": part.ravel().tolist(), "error": None,
            }


def scan_grib(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per slab with finite cells, as scan_netcdf gives them, over time, level where there are several, latitude and longitude.

    grid_npts tells the grids of a file with several apart, by their numbers of points; it is missing where there is one.
    A field that can't be read gives one row with its error, as a whole file does.
    """

    def plan(batches):
        for batch in batches:
            for name in batch.column("path").to_pylist():
                try:
                    with open_file(name) as source:
                        found = list(fields(source))
                    bad = sorted({(f["variable"], f["error"]) for f in found if f["error"]})
                    numbers = [i for i, f in enumerate(found) if not f["error"]]
                    good = plan_fields([found[i] for i in numbers])
                    rows = [(name, v, u, n, g, [numbers[i] for i in own], levels, t, row, rows, None) for v, u, n, g, own, levels, t, row, rows in good]
                    rows += [(name, v, None, None, None, None, None, None, None, None, error) for v, error in bad]
                except Exception as failed:  # noqa: BLE001  one bad file is one row
                    rows = [(name, *[None] * 9, f"{type(failed).__name__}: {failed}")]
                columns = list(zip(*rows)) if rows else [()] * len(_PLANNED)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PLANNED)], schema=_PLANNED)

    def slabs(batches):
        for batch in batches:
            for row in batch.to_pylist():
                error = row["error"]
                if error is None:
                    try:
                        with open_file(row["file"]) as source:
                            for out in block_rows(source, list(fields(source)), row):
                                yield pa.RecordBatch.from_pylist([{"file": row["file"]} | out], schema=_SLABS)
                    except Exception as failed:  # noqa: BLE001  one bad block is one row
                        error = f"{type(failed).__name__}: {failed}"
                if error is not None:
                    yield pa.RecordBatch.from_pylist([{"file": row["file"], "variable": row["variable"], "error": error}], schema=_SLABS)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return files.mapInArrow(plan, _PLAN).repartition(spark.sparkContext.defaultParallelism).mapInArrow(slabs, SLABS)
