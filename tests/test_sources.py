"""Sources and sinks on small files written here."""

import struct
import zipfile

import numpy as np
import pytest

from isopleth.sources import delimited, grid, sinks, workbook


def netcdf(path, values):
    """A NetCDF classic file: air(time unlimited, lat, lon), lat, lon."""
    pad = lambda b: b + b"\0" * (-len(b) % 4)
    name = lambda s: struct.pack(">i", len(s)) + pad(s.encode())
    t, y, x = values.shape
    dims = struct.pack(">ii", 10, 3) + name("time") + struct.pack(">i", 0) + name("lat") + struct.pack(">i", y) + name("lon") + struct.pack(">i", x)
    none = struct.pack(">ii", 0, 0)
    own = struct.pack(">ii", 12, 2) + name("units") + struct.pack(">ii", 2, 1) + pad(b"K") + name("_FillValue") + struct.pack(">ii", 5, 1) + struct.pack(">f", -999)

    def build(begins):
        parts = [name("lat") + struct.pack(">ii", 1, 1) + none + struct.pack(">iii", 6, 8 * y, begins[0]), name("lon") + struct.pack(">ii", 1, 2) + none + struct.pack(">iii", 6, 8 * x, begins[1]), name("air") + struct.pack(">iiii", 3, 0, 1, 2) + own + struct.pack(">iii", 5, 4 * y * x, begins[2])]
        return b"CDF\1" + struct.pack(">i", t) + dims + none + struct.pack(">ii", 11, 3) + b"".join(parts)

    size = len(build([0, 0, 0]))
    begins = [size, size + 8 * y, size + 8 * y + 8 * x]
    path.write_bytes(build(begins) + np.linspace(48, 49, y).astype(">f8").tobytes() + np.linspace(17, 18, x).astype(">f8").tobytes() + values.astype(">f4").tobytes())


def test_netcdf(spark, tmp_path):
    values = np.random.default_rng(0).random((100, 3, 50)).astype(np.float32)
    values[0, 0, 0] = -999
    values[90:, :, 40:] = -999
    netcdf(tmp_path / "a.nc", values)
    (tmp_path / "b.nc").write_bytes(b"nothing")
    slabs = grid.scan_netcdf(spark, str(tmp_path))
    rows = {tuple(r.starts): r for r in slabs.collect() if not r.error}
    assert set(rows) == {(0, 0, 0), (0, 0, 40), (90, 0, 0)}  # the last slab has no finite cell
    first = rows[0, 0, 0]
    assert first.unit == "K" and first.dims == ["time", "lat", "lon"] and first.lows[1:] == [48.0, 17.0] and np.isnan(first.values[0])
    assert np.allclose(first.values[1:], values[:90, :, :40].ravel()[1:])
    assert [r.error for r in slabs.collect() if r.error] == ["ValueError: not a NetCDF classic file"]
    stats = {tuple(r.starts): r for r in grid.slab_stats(slabs).collect()}
    cells = values[:90, :, 40:].astype(float).ravel()
    assert stats[0, 0, 40].mean == pytest.approx(cells.mean()) and stats[0, 0, 40].p90 == pytest.approx(np.percentile(cells, 90))


def test_geotiff(spark, tmp_path):
    cells = np.arange(1, 17, dtype="<f4").reshape(4, 4)
    cells[2:] = -1
    tags = [(256, 4, [4]), (257, 4, [4]), (258, 3, [32]), (259, 3, [1]), (273, 4, [8, 40]), (277, 3, [1]), (278, 4, [2]), (279, 4, [32, 32]), (339, 3, [3]), (33550, 12, [0.25, 0.25, 0.0]), (33922, 12, [0.0, 0, 0, 17.0, 49.0, 0]), (42113, 2, b"-1\0")]
    at, extra, entries = 8 + 64 + 2 + 12 * len(tags) + 4, b"", b""
    for tag, kind, v in tags:
        raw = v if kind == 2 else struct.pack(f"<{len(v)}{grid._FIELD[kind]}", *v)
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, len(v), at + len(extra))
            extra += raw
        else:
            entries += struct.pack("<HHI", tag, kind, len(v)) + raw.ljust(4, b"\0")
    (tmp_path / "r.tif").write_bytes(b"II*\0" + struct.pack("<I", 72) + cells.tobytes() + struct.pack("<H", len(tags)) + entries + b"\0" * 4 + extra)
    (row,) = grid.scan_geotiff(spark, str(tmp_path)).collect()
    assert row["values"] == cells[:2].ravel().tolist() and row.lows == [48.5, 17.0] and row.highs == [49.0, 18.0]


def test_sniff():
    assert delimited.sniff(["# c", "a;b;c"]) == (";", "#")
    assert delimited.sniff(["a  b  c"]) == (r"\s+", None)
    assert delimited.sniff(["a\tb\tc"]) == ("\t", None)
    assert delimited.sniff(["a"], tab_file=True) == ("\t", None)
    assert delimited.sniff(["// x", "a|b|c"])[1] == "//"


def test_station_series(spark, tmp_path):
    (tmp_path / "s.csv").write_text("station_id,timestamp,value,lat\nA,2020-01-01,10.5,48\nA,2020-01-02,11.0,48\nB,2020-01-01,mq,49\nB,2020-01-03,10.2,49\n")
    rows = delimited.read(spark, str(tmp_path / "s.csv"))
    assert delimited.classify(rows) == {"station_id": "metadata", "timestamp": "time", "value": "numeric", "lat": "spatial"}
    found = {r.station: r for r in delimited.chunks(rows).collect()}
    assert (found["A"].mean, found["A"].n_cells, found["A"].time_end) == (10.75, 2, "2020-01-02")
    assert (found["B"].mean, found["B"].time_start) == (10.2, "2020-01-03")


def test_series_say_what_their_texts_are(spark, tmp_path):
    (tmp_path / "one.csv").write_text("time,v,unit,empty\n2020-01-01,1,K,\n2020-01-02,2,K,\n")
    rows = delimited.read(spark, str(tmp_path / "one.csv"))
    (found,) = delimited.chunks(rows).collect()
    assert found.metadata == {"unit": "K", "empty_all": "[]", "empty_count": "0"} and found.time_end == "2020-01-02"
    several = spark.createDataFrame([("f", i, "b" if i % 2 else "a", str(i), "x" if i == 3 else None) for i in range(40)] + [("g", i, "c", str(i % 11), None) for i in range(22)], "_file string, _row long, few string, many string, once string")
    found = {r._file: r.metadata for r in delimited.series_metadata(several, ["few", "many", "once"]).collect()}
    assert found == {"f": {"few_all": '["a","b"]', "few_count": "2", "once": "x"}, "g": {"few": "c", "once_all": "[]", "once_count": "0"}}


def test_blocks_and_blanks(spark, tmp_path):
    (tmp_path / "b.txt").write_text("# note\nx  y\n1  2\n3  ---\n5  6\n")
    rows = delimited.read(spark, str(tmp_path / "b.txt"))
    found = {r.variable: (r.mean, r.n_cells, r.block) for r in delimited.chunks(rows).collect()}
    assert found == {"x": (3.0, 3, 0), "y": (4.0, 2, 0)}


def test_workbook(spark, tmp_path):
    cell = lambda ref, text: f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>'
    rows = ["".join(cell(f"{c}{i}", t) for c, t in zip("ABC", r) if t) for i, r in enumerate([("H", "D", "L"), ("flood", " ERA5 ", ""), ("", "CAMS", "x"), ("", "", "y"), ("heat", "E-OBS", "")], 1)]
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + "".join(f"<row>{r}</row>" for r in rows) + "</sheetData></worksheet>"
    with zipfile.ZipFile(tmp_path / "c.xlsx", "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    found = workbook.read_catalog(spark, str(tmp_path / "c.xlsx"), ["hazard", "dataset", "link"], "dataset").orderBy("row_index").collect()
    assert [tuple(r)[1:] for r in found] == [(0, "flood", "ERA5", None), (1, "flood", "CAMS", "x"), (3, "heat", "E-OBS", None)]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("z", 1, [1, 2], None), ("y", 2, None, 'q"')], "zeta string, rank int, tags array<int>, alpha string")
    sinks.export_csv(rows.coalesce(1), str(tmp_path / "out"))
    (part,) = (tmp_path / "out").glob("part-*.csv")
    lines = part.read_text(encoding="utf-8-sig").splitlines()
    assert lines[0] == "rank,alpha,tags,zeta" and part.read_bytes()[:3] == bytes((0xEF, 0xBB, 0xBF)) and lines[1].startswith("1,,") and len(lines) == 3
    found, more = sinks.export_json(rows, 1)
    assert len(found) == 1 and more
