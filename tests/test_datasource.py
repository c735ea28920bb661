"""The data source of gridded files against the scans."""

import numpy as np
import pytest

from isopleth.sources import datasource, grib, grid
from tests.test_geotiff import tiff
from tests.test_grib import DAY, second
from tests.test_hdf5 import build
from tests.test_sources import netcdf


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("grids")
    rng = np.random.default_rng(0)
    (at / "deep" / "er").mkdir(parents=True)
    netcdf(at / "a.nc", rng.random((100, 3, 50)))
    (at / "deep" / "b.h5").write_bytes(build(True, False, None, rng.random((95, 5, 45))))
    (at / "deep" / "er" / "c.grib2").write_bytes(second(rng.random((45, 50)), DAY) + second(rng.random((4, 6)), DAY, category=(1, 8)))
    (at / "d.tif").write_bytes(tiff(rng.random((20, 30)).astype("<f4"), tile=(16, 16), compression=8))
    (at / "e.nc").write_bytes(b"nothing")
    (at / "note.txt").write_text("no grid")
    datasource.register(spark)
    return at


def plain(rows):
    return sorted((r.file.rsplit("/", 1)[1], r.variable, tuple(r.starts), tuple(r["values"])) for r in rows if not r.error)


@pytest.mark.parametrize("large", [1 << 30, 0])
def test_equals_the_scans(spark, folder, large):
    found = spark.read.format("grids").option("partitions", 5).option("large", large).load(str(folder)).collect()
    scans = grid.scan_netcdf(spark, [str(folder / "a.nc"), str(folder / "deep" / "b.h5")]).collect() + grib.scan_grib(spark, str(folder / "deep" / "er")).collect() + grid.scan_geotiff(spark, str(folder / "d.tif")).collect()
    assert plain(found) == plain(scans)
    assert [(r.file.rsplit("/", 1)[1], r.error) for r in found if r.error] == [("e.nc", "ValueError: not a NetCDF classic file")]
    assert {r.grid_npts for r in found if r.file.endswith("grib2")} == {2250, 24}


def test_variables_and_files_are_pruned(spark, folder):
    rows = spark.read.format("grids").option("partitions", 3).load(str(folder))
    asked = rows.where("variable = 'tp'").select("file", "starts")
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan grids" in plan and "= tp" not in plan, plan  # Spark is left with no comparison of its own
    assert [r.file.rsplit("/", 1)[1] for r in asked.collect()] == ["c.grib2"]
    assert {r.file.rsplit("/", 1)[1] for r in rows.where("variable in ('air', 'tp') and file like '%h5'").collect()} == {"b.h5"}
    assert rows.where("variable = 'none'").count() == 0
    light = spark.read.format("grids").option("values", "false").load(str(folder)).where("variable = 'air'").collect()
    assert light and all(r["values"] is None and r.dims for r in light)


def test_what_is_left_out_is_not_read(folder):
    reader = datasource.GridReader({"path": str(folder), "partitions": 1})
    left = list(reader.pushFilters([datasource.EqualTo(("variable",), "tp"), datasource.StringEndsWith(("file",), ".grib2"), datasource.EqualTo(("unit",), "K")]))
    assert [f.attribute for f in left] == [("unit",)] and reader.variables == {"tp"}
    assert [p.rsplit("/", 1)[1] for p, _ in reader._listed()] == ["c.grib2"]
    assert len(reader.partitions()) == 1
