"""What files hold, without reading their data: variables, time range, extent, attributes, a description."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isopleth.sources import delimited
from isopleth.sources.grid import netcdf_header, open_file, read_values

# Column names that tell times and places; rows of a table that are looked at; bytes beyond which a file is not scanned.
TIME_NAMES, LAT_NAMES, LON_NAMES = ["time", "date", "datetime", "year", "month", "timestamp"], ["lat", "latitude", "y"], ["lon", "long", "longitude", "x"]
ROWS, MOST_BYTES = 5000, 200 * 1024 * 1024
# Attributes of a gridded file that are kept.
ATTRIBUTES = ["title", "institution", "source", "history", "references", "Conventions"]


def description(names: list[str], start: str | None, end: str | None, opening: list[str]) -> str | None:
    parts = opening + ([f"Variables: {', '.join(names[:10])}"] if names else []) + ([f"Period: {start} to {end or 'present'}"] if start else [])
    return ". ".join(parts) or None


def scan_table(rows: DataFrame, most: int = ROWS) -> DataFrame:
    """One row about a delimited table's first rows: columns, rows_sampled, time_start, time_end, lat_min, lat_max, lon_min, lon_max.

    The first column with a known name, in the order of those names, is the time, the latitude, the longitude.
    """
    names = [c for c in rows.columns if not c.startswith("_")]
    low = {c.strip().lower(): c for c in names}
    pick = lambda known: next((low[k] for k in known if k in low), None)
    time, lat, lon = pick(TIME_NAMES), pick(LAT_NAMES), pick(LON_NAMES)
    sample = rows.orderBy("_row").limit(most)
    at = F.date_format(delimited.as_time(F.col(f"`{time}`")), "yyyy-MM-dd") if time else F.lit(None).cast("string")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)") if c else F.lit(None).cast("double")
    return sample.agg(
        F.count("*").alias("rows_sampled"), F.min(at).alias("time_start"), F.max(at).alias("time_end"), F.min(number(lat)).alias("lat_min"), F.max(number(lat)).alias("lat_max"), F.min(number(lon)).alias("lon_min"), F.max(number(lon)).alias("lon_max"),
    ).withColumn("columns", F.array(*map(F.lit, names)))


FOUND = pa.schema([("file", pa.string()), ("variables", pa.list_(pa.string())), ("units", pa.list_(pa.string())), ("time_start", pa.string()), ("time_end", pa.string()), *((f"{c}_{e}", pa.float64()) for c in ("lat", "lon") for e in ("min", "max")), ("attributes", pa.map_(pa.string(), pa.string())), ("description", pa.string()), ("error", pa.string())])
DDL = "file string, variables array<string>, units array<string>, time_start string, time_end string, lat_min double, lat_max double, lon_min double, lon_max double, attributes map<string,string>, description string, error string"


def _dates(values: np.ndarray, units: str) -> tuple[str | None, str | None]:
    """First and last date of times counted from a date, as in days since 1900-01-01."""
    unit, _, since = units.partition(" since ")
    step = {"d": "D", "h": "h", "m": "m", "s": "s"}.get(unit.strip().lower()[:1])
    if not since or step is None or not len(values):
        return None, None
    origin = pd.Timestamp(since.strip().split(".")[0])
    return tuple(str(origin + pd.Timedelta(float(v), step))[:10] for v in (values[0], values[-1]))


def _scan(name: str, size: int) -> dict:
    if size > MOST_BYTES:
        return {"file": name, "error": f"larger than {MOST_BYTES >> 20} MB"}
    with open_file(name) as source:
        h = netcdf_header(source)
        known = {v["name"]: v for v in h["variables"]}
        dims = {d for d, _ in h["dims"]}
        data = [v for v in h["variables"] if v["name"] not in dims]
        coordinate = lambda names: next((read_values(source, h, known[n]).astype(float) for n in names if n in known and n in dims), np.zeros(0))
        lat, lon = coordinate(LAT_NAMES), coordinate(LON_NAMES)
        start, end = _dates(coordinate(["time"]), str(known["time"]["attributes"].get("units", ""))) if "time" in known else (None, None)
    kept = {k: str(h["attributes"][k])[:500] for k in ATTRIBUTES if k in h["attributes"]}
    opening = ([kept["title"]] if kept.get("title") else []) + ([f"by {kept['institution']}"] if kept.get("institution") else [])
    names = [v["name"] for v in data]
    ends = {f"{c}_{e}": float(f(v)) if len(v) else None for c, v in (("lat", lat), ("lon", lon)) for e, f in (("min", np.min), ("max", np.max))}
    return {"file": name, "variables": names, "units": [str(v["attributes"].get("units", "")) for v in data], "time_start": start, "time_end": end, **ends, "attributes": list(kept.items()), "description": description(names, start, end, opening), "error": None}


def scan_grids(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per NetCDF classic file, from its header and coordinates alone; a file that fails, or is too large to look at, gives its error."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    rows.append(_scan(name, size))
                except Exception as failed:  # noqa: BLE001  one bad file is one row
                    rows.append({"file": name, "error": f"{type(failed).__name__}: {failed}"})
            yield pa.RecordBatch.from_pylist(rows, schema=FOUND)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.mapInArrow(run, DDL)
