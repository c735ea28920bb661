"""GRIB messages written here by the published format, both editions, against their values."""

import datetime
import io
import struct

import numpy as np
import pytest

from isopleth.sources import archives, grib


def signed(value, size):
    value = int(value)
    return ((1 << 8 * size - 1) - value if value < 0 else value).to_bytes(size, "big")


def packed(values, width):
    """Reference, binary scale and bits of simple packing."""
    low, span = float(np.float32(values.min())), float(np.ptp(values)) or 1.0
    if low > values.min():
        low = float(np.nextafter(np.float32(low), np.float32(-np.inf)))
    power = int(np.ceil(np.log2(span / (2**width - 1))))
    numbers = np.round((values - low) / 2.0**power).astype(np.int64)
    bits = (numbers[:, None] >> np.arange(width - 1, -1, -1)) & 1
    return low, power, np.packbits(bits.astype(np.uint8).ravel()).tobytes()


def second(values, time, hours=0, category=(0, 0), level=2.0, missing=None, width=12, fields=1, template=0):
    """A message of edition 2; fields: how often its last sections are repeated."""
    ny, nx = values.shape
    section = lambda number, body: struct.pack(">IB", len(body) + 5, number) + body
    s1 = section(1, struct.pack(">HHBBBHBBBBBBB", 98, 0, 2, 1, 1, time.year, time.month, time.day, time.hour, 0, 0, 0, 1))
    grid = struct.pack(">BIBBH", 0, nx * ny, 0, 0, 0) + b"\6" + b"\0" * 15 + struct.pack(">IIII", nx, ny, 0, 0) + signed(49e6, 4) + signed(-17e6, 4) + b"\x30" + signed(48e6, 4) + signed(18e6, 4) + struct.pack(">IIB", 1, 1, 0)
    s3 = section(3, grid)
    s4 = section(4, struct.pack(">HHBBBBBHBBI", 0, template, *category, 2, 0, 0, 0, 0, 1, hours) + bytes([103, 1]) + signed(level * 10, 4) + b"\xff" * 6)
    there = np.ones(values.size, bool) if missing is None else ~missing.ravel()
    low, power, raw = packed(values.ravel()[there], width)
    s5 = section(5, struct.pack(">IHf", int(there.sum()), 0, low) + signed(power, 2) + signed(0, 2) + bytes([width, 0]))
    s6 = section(6, b"\xff" if missing is None else b"\0" + np.packbits(there).tobytes())
    body = s1 + s3 + (s4 + s5 + s6 + section(7, raw)) * fields + b"7777"
    return b"GRIB\0\0\0\2" + struct.pack(">Q", 16 + len(body)) + body


def first(values, time, parameter=167, level=0, missing=None, width=16, ten=1):
    ny, nx = values.shape
    long = lambda n: n.to_bytes(3, "big")
    there = np.ones(values.size, bool) if missing is None else ~missing.ravel()
    power, numbers = -3, None
    scaled = values.ravel()[there] * 10**ten
    low = float(np.floor(scaled.min()))
    numbers = np.round((scaled - low) * 2.0**-power).astype(np.int64)
    assert numbers.max() < 2**width
    bits = (numbers[:, None] >> np.arange(width - 1, -1, -1)) & 1
    raw = np.packbits(bits.astype(np.uint8).ravel()).tobytes()
    mantissa, exponent = abs(low), 64
    while mantissa >= 1:
        mantissa, exponent = mantissa / 16, exponent + 1
    ibm = (0x80000000 if low < 0 else 0) | exponent << 24 | int(mantissa * 2**24)
    pds = long(28) + bytes([128, 98, 1, 255, 0x80 | (0x40 if missing is not None else 0), parameter, 100]) + struct.pack(">H", level) + bytes([time.year % 100, time.month, time.day, time.hour, 0, 1, 0, 0, 0, 0, 0, 0, time.year // 100 + 1, 0]) + signed(ten, 2)
    gds = long(32) + bytes([0, 255, 0]) + struct.pack(">HH", nx, ny) + signed(49e3, 3) + signed(-17e3, 3) + b"\x80" + signed(48e3, 3) + signed(18e3, 3) + struct.pack(">HHB", 1, 1, 0) + b"\0" * 4
    bms = b"" if missing is None else (lambda m: long(6 + len(m)) + bytes([0, 0, 0]) + m)(np.packbits(there).tobytes())
    bds = long(11 + len(raw)) + b"\0" + signed(power, 2) + struct.pack(">IB", ibm, width) + raw
    body = pds + gds + bms + bds + b"7777"
    return b"GRIB" + long(8 + len(body)) + b"\1" + body


DAY = datetime.datetime(2020, 1, 1)


def test_two_grids_are_two_tagged_sets(spark, tmp_path):
    rng = np.random.default_rng(0)
    large, small = rng.normal(280, 5, (3, 50, 45)), rng.normal(280, 5, (95, 4, 6))
    hole = np.zeros((4, 6), bool)
    hole[1, 2:4] = True
    messages = [second(v, DAY + datetime.timedelta(days=i)) for i, v in enumerate(large)]
    messages += [second(v, DAY, hours=6 * i, missing=hole if i == 0 else None, width=16) for i, v in enumerate(small)]
    order = rng.permutation(len(messages))
    (tmp_path / "m.grib2").write_bytes(b"\0" * 7 + b"".join(messages[i] for i in order))
    rows = grib.scan_grib(spark, str(tmp_path)).collect()
    assert {r.grid_npts for r in rows} == {2250, 24} and not [r.error for r in rows if r.error]
    found = {(r.grid_npts, *r.starts): r for r in rows}
    assert set(found) == {(2250, 0, y, x) for y in (0, 40) for x in (0, 40)} | {(24, 0, 0, 0), (24, 90, 0, 0)}
    band = found[2250, 0, 40, 0]
    assert np.allclose(np.array(band["values"]).reshape(3, 10, 40), large[:, 40:, :40], atol=0.02) and band.highs[1] == pytest.approx(49 - 40 / 49) and band.lows[2] == -17.0
    first_block = np.array(found[24, 0, 0, 0]["values"]).reshape(90, 4, 6)
    assert np.isnan(first_block[0][hole]).all() and np.allclose(first_block[0][~hole], small[0][~hole], atol=0.01) and np.allclose(first_block[1:], small[1:90], atol=0.01)
    assert (found[24, 90, 0, 0].time_start, found[24, 90, 0, 0].time_end) == (str(DAY + datetime.timedelta(hours=540)), str(DAY + datetime.timedelta(hours=564)))


def test_first_edition_and_levels(spark, tmp_path):
    rng = np.random.default_rng(1)
    cells = rng.normal(0, 20, (2, 2, 3, 5))
    hole = rng.random((3, 5)) < 0.3
    hole[0, 0] = False
    raw = b"".join(first(cells[t, v], DAY + datetime.timedelta(days=t), 130, (500, 850)[v], missing=hole if (t, v) == (1, 0) else None) for t in range(2) for v in range(2))
    (tmp_path / "a.grib").write_bytes(raw + first(cells[0, 0], DAY, 167) + first(cells[0, 0], DAY, 167))
    rows = {r.variable: r for r in grib.scan_grib(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t", "t2m"} and rows["t"].grid_npts is None and rows["t"].dims == ["time", "level", "lat", "lon"] and (rows["t"].lows[1], rows["t"].highs[1], rows["t"].unit) == (500.0, 850.0, "K")
    values = np.array(rows["t"]["values"]).reshape(2, 2, 3, 5)
    expected = cells.copy()
    expected[1, 0][hole] = np.nan
    assert np.allclose(values, expected, atol=0.01, equal_nan=True)
    assert rows["t2m"].dims == ["time", "lat", "lon"] and np.allclose(rows["t2m"]["values"], cells[0, 0].ravel(), atol=0.01)


def test_rows_are_read_alone():
    values = np.random.default_rng(2).normal(size=(30, 7))
    source = io.BytesIO(second(values, DAY, width=11))
    (field,) = grib.fields(source)
    assert np.allclose(grib.read_rows(source, field, 13, 4), values[13:17], atol=0.01)
    assert len(list(grib.fields(io.BytesIO(second(values, DAY, fields=3))))) == 3
    constant = io.BytesIO(second(np.full((2, 2), 7.0), DAY))
    assert np.allclose(grib.read_rows(constant, next(grib.fields(constant)), 0, 2), 7)


def test_loading(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.grib2").write_bytes(second(np.ones((2, 3)), DAY) + second(np.ones((4, 4)), DAY, category=(1, 8)))
    (tmp_path / "in" / "b.grib").write_bytes(b"nothing here at all, nothing")
    found = archives.load(spark, str(tmp_path / "in"), str(tmp_path / "scratch")).collect()
    assert {(r.variable, r.place, r["mean"], r.unit, r.time_start) for r in found if not r.error} == {("t", "npts=6:0,0,0", 1.0, "K", "2020-01-01 00:00:00"), ("tp", "npts=16:0,0,0", 1.0, "kg m-2", "2020-01-01 00:00:00")}
    assert [r.error for r in found if r.error] == ["ValueError: not a GRIB file"]
