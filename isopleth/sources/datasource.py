"""Gridded files as a Spark data source: spark.read.format("grids").load(folder)."""

from __future__ import annotations

import os
import zlib

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringContains, StringEndsWith, StringStartsWith

from isopleth.sources import grib, grid

SCHEMA = "file string, variable string, unit string, dims array<string>, starts array<long>, lows array<double>, highs array<double>, time_start string, time_end string, grid_npts long, values array<double>, error string"
_KINDS = {".nc": "grid", ".nc4": "grid", ".h5": "grid", ".he5": "grid", ".hdf5": "grid", ".hdf": "grid", ".tif": "tiff", ".tiff": "tiff", ".grib": "grib", ".grib2": "grib", ".grb": "grib"}


class GridSource(DataSource):
    """Slabs of the gridded files below a folder, a row each: NetCDF, HDF5, GRIB and GeoTIFF, by their suffixes.

    Options: `partitions` (64), `large` (bytes from which a file's slabs are shared out, 128 MB), and `values`: with
    `false` rows describe slabs without their cells being kept. Conditions on `file` and `variable` are pushed down:
    files and variables that they leave out aren't opened or read.
    """

    @classmethod
    def name(cls) -> str:
        return "grids"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> GridReader:
        return GridReader(dict(self.options))


class _Share(InputPartition):
    """One of `of` shares."""

    def __init__(self, number: int, of: int):
        self.number, self.of = number, of

    def __repr__(self) -> str:
        return f"share {self.number} of {self.of}"


class GridReader(DataSourceReader):
    """Deals out shares by number alone. A task lists the folder itself, and takes the small files whose names hash to its
    share, and of each large file the slabs whose places do; so the driver lists and opens nothing."""

    def __init__(self, options: dict):
        self.folder, self.shares = options["path"], int(options.get("partitions", 64))
        self.large, self.values = int(options.get("large", 128 << 20)), str(options.get("values", "true")).lower() != "false"
        self.variables: set | None = None
        self.files: list = []

    def pushFilters(self, filters):  # noqa: N802  Spark's name
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "variable" and isinstance(f, (EqualTo, In)):
                wanted = set(f.value) if isinstance(f, In) else {f.value}
                self.variables = wanted if self.variables is None else self.variables & wanted
            elif column == "file" and isinstance(f, (EqualTo, In, StringContains, StringStartsWith, StringEndsWith)):
                self.files.append(f)
            elif not (column == "file" and isinstance(f, IsNotNull)):
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Share(i, self.shares) for i in range(self.shares)]

    def _wanted(self, name: str) -> bool:
        tests = {EqualTo: lambda v: name == v, In: lambda v: name in v, StringContains: lambda v: v in name, StringStartsWith: name.startswith, StringEndsWith: name.endswith}
        return all(tests[type(f)](f.value) for f in self.files)

    def _listed(self):
        """(path, bytes) of the readable files that the conditions leave."""
        from pyarrow import fs

        system, plain = grid._place(self.folder)
        scheme = self.folder[: self.folder.index(":") + 1] if ":" in self.folder else "file:"
        prefix = self.folder[: -len(plain)] if self.folder.endswith(plain) and "://" in self.folder else scheme
        for info in system.get_file_info(fs.FileSelector(plain, recursive=True)):
            name = prefix + info.path
            base = os.path.basename(info.path)
            if info.type == fs.FileType.File and os.path.splitext(base.lower())[1] in _KINDS and not base.startswith((".", "_")) and self._wanted(name):
                yield name, info.size

    def read(self, share: _Share):
        schema = grib._SLABS
        empty = dict.fromkeys(schema.names)

        def batch(row: dict):
            row = empty | row
            if not self.values:
                row["values"] = None
            return pa.RecordBatch.from_pylist([{k: row[k] for k in schema.names}], schema=schema)

        def mine(*place) -> bool:
            return zlib.crc32(repr(place).encode()) % share.of == share.number

        for name, size in self._listed():
            split = size >= self.large
            if not split and not mine(name):
                continue
            try:
                with grid.open_file(name) as source:
                    for at, (variable, rows) in enumerate(self._units(source, _KINDS[os.path.splitext(name.lower())[1]])):
                        if (self.variables is None or variable in self.variables) and (not split or mine(name, at)):
                            for row in rows():
                                yield batch({"file": name, "variable": variable} | row)
            except Exception as failed:  # noqa: BLE001  one bad file is one row
                if self.variables is None and (not split or mine(name)):
                    yield batch({"file": name, "error": f"{type(failed).__name__}: {failed}"})

    @staticmethod
    def _units(source, kind: str):
        """(variable, a function that reads its rows) of each unit of a file."""
        some = lambda row: [row] if row else []
        if kind == "tiff":
            header = grid.tiff_header(source)
            for block in range(grid.block_count(header)):
                yield grid.tiff_name(header), lambda block=block: some((row := grid.block_row(source, header, block)) and {"dims": ["lat", "lon"]} | row)
        elif kind == "grib":
            found = [f for f in grib.fields(source) if not f["error"]]
            for variable, unit, npts, grids, numbers, levels, time, row, rows in grib.plan_fields(found):
                plan = {"variable": variable, "unit": unit, "npts": npts, "grids": grids, "numbers": numbers, "levels": levels, "time": time, "row": row, "rows": rows}
                yield variable, lambda plan=plan: grib.block_rows(source, found, plan)
        else:
            found = grid.open_grid(source)
            for variable, starts, counts in grid.slab_plan(found):
                yield variable, lambda v=variable, s=starts, c=counts: some((row := grid.slab_row(found, v, s, c)) and {"starts": s} | row)


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it take conditions."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GridSource)
