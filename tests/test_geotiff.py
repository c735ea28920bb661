"""Tiled and compressed GeoTIFF files written here, against the uncompressed cells."""

import io
import struct
import zlib

import numpy as np
import pytest

from isopleth.sources import grid


def lzw(raw):
    """TIFF's LZW with a clear code at the start and whenever the table is nearly full."""
    out, bits, width = 0, 0, 9

    def put(code):
        nonlocal out, bits
        out, bits = out << width | code, bits + width

    table = {bytes([i]): i for i in range(256)}
    put(256)
    count, held = 258, b""
    for i in range(len(raw)):
        more = held + raw[i : i + 1]
        if more in table:
            held = more
            continue
        put(table[held])
        table[more] = count
        count += 1
        width = max(9, count.bit_length())
        held = raw[i : i + 1]
        if count == 4093:
            put(table[held])
            held, width_now = b"", width
            put(256)
            table, count, width = {bytes([i]): i for i in range(256)}, 258, 9
            del width_now
    if held:
        put(table[held])
        count += 1
        width = max(9, count.bit_length()) if count < 4094 else 12
    put(257)
    out, bits = out << -bits % 8, bits + -bits % 8
    return out.to_bytes(bits // 8, "big")


def packbits(raw):
    return b"".join(bytes([len(raw[i : i + 100]) - 1]) + raw[i : i + 100] for i in range(0, len(raw), 100)) + b"\x80"


PACK = {1: bytes, 5: lzw, 8: zlib.compress, 32773: packbits}


def tiff(values, tile=None, strip=None, compression=1, predictor=1, order="<", big=False, bands=1, planar=1, extra=()):
    height, width = values.shape
    rows, columns = tile or (strip or height, width)
    kind, blocks = values.dtype.newbyteorder(order), []
    layers = [np.full_like(values, 7) for _ in range(bands)]
    layers[0] = values
    for layer in [None] if planar == 1 else range(bands):
        for y in range(0, height, rows):
            for x in range(0, width, columns):
                part = np.zeros((rows if tile else min(rows, height - y), columns, bands if planar == 1 else 1), kind)
                for b, source in enumerate(layers if layer is None else [layers[layer]]):
                    some = source[y : y + rows, x : x + columns]
                    part[: some.shape[0], : some.shape[1], b] = some
                if predictor == 2:
                    part[:, 1:] = part[:, 1:] - part[:, :-1]
                raw = part.tobytes()
                if predictor == 3:
                    n, c, k = part.shape
                    planes = np.frombuffer(part.astype(kind.newbyteorder(">")).tobytes(), np.uint8).reshape(n, c * k, kind.itemsize).transpose(0, 2, 1).reshape(n, -1, k)
                    planes = np.concatenate([planes[:, :1], planes[:, 1:] - planes[:, :-1]], axis=1)
                    raw = planes.tobytes()
                blocks.append(PACK[compression](raw))
    out = io.BytesIO(b"\0" * 16)
    out.seek(16)
    offsets = []
    for block in blocks:
        offsets.append(out.tell())
        out.write(block)
    where, sizes = ((324, 325) if tile else (273, 279))
    tags = [(256, 3, [width]), (257, 3, [height]), (258, 3, [8 * kind.itemsize] * bands), (259, 3, [compression]), (where, 4, offsets), (277, 3, [bands]), (sizes, 4, [len(b) for b in blocks]), (284, 3, [planar]), (317, 3, [predictor])]
    tags += [(322, 3, [columns]), (323, 3, [rows])] if tile else [(278, 4, [rows])]
    tags += [(339, 3, [{"f": 3, "i": 2, "u": 1}[kind.kind]] * bands), (33550, 12, [0.25, 0.5, 0.0]), (33922, 12, [0.0, 0, 0, 17.0, 49.0, 0]), *extra]
    room, letter = (8, "Q") if big else (4, "I")
    entries = b""
    for tag, code, v in sorted(tags):
        raw = v if code == 2 else struct.pack(f"{order}{len(v)}{grid._FIELD[code]}", *v)
        entries += struct.pack(order + "HH" + letter, tag, code, len(v))
        if len(raw) > room:
            entries += struct.pack(order + letter, out.tell())
            out.write(raw)
        else:
            entries += raw.ljust(room, b"\0")
    at = out.tell()
    out.write(struct.pack(order + ("Q" if big else "H"), len(tags)) + entries + b"\0" * 8)
    raw = bytearray(out.getvalue())
    raw[: 16 if big else 8] = ({"<": b"II", ">": b"MM"}[order] + (struct.pack(order + "HHHQ", 43, 8, 0, at) if big else struct.pack(order + "HI", 42, at)))
    return bytes(raw)


def cells(spark, path, shape):
    """All rows of a file laid out again, and the rows."""
    out, rows = np.full(shape, np.nan), grid.scan_geotiff(spark, str(path)).collect()
    assert not [r.error for r in rows if r.error]
    for r in rows:
        y, x = r.starts
        high, wide = round((r.highs[0] - r.lows[0]) / 0.5), round((r.highs[1] - r.lows[1]) / 0.25)
        out[y : y + high, x : x + wide] = np.array(r["values"]).reshape(high, wide)
        assert r.highs[0] == 49 - 0.5 * y and r.lows[1] == 17 + 0.25 * x
    return out, rows


CASES = [
    ("<f4", {"tile": (16, 32)}), ("<f4", {"tile": (16, 32), "compression": 5}), (">i2", {"tile": (16, 16), "compression": 5, "predictor": 2, "order": ">"}), ("<f4", {"strip": 7, "compression": 8}), ("<u1", {"strip": 50, "compression": 8, "predictor": 2}),
    ("<f4", {"tile": (32, 16), "compression": 8, "predictor": 3}), (">f8", {"strip": 9, "compression": 5, "predictor": 3, "order": ">"}), ("<i4", {"tile": (16, 16), "compression": 32773, "big": True}), ("<i2", {"tile": (16, 32), "compression": 5, "predictor": 2, "bands": 3}),
    ("<f4", {"tile": (16, 32), "compression": 8, "bands": 2, "planar": 2}),
]


@pytest.mark.parametrize("kind, options", CASES)
def test_equals_the_uncompressed_cells(spark, tmp_path, kind, options):
    rng = np.random.default_rng(3)
    values = (rng.integers(0, 200, (41, 53)) if kind[1] != "f" else rng.normal(280, 9, (41, 53))).astype(kind)
    values[:20, :20] = values[0, 0]
    (tmp_path / "a.tif").write_bytes(tiff(values, **options))
    found, rows = cells(spark, tmp_path / "a.tif", values.shape)
    assert np.array_equal(found, values.astype(float))
    rows_per, columns_per = options.get("tile") or (options["strip"], 53)
    assert len(rows) == -(-41 // rows_per) * -(-53 // columns_per)


def test_lzw_of_long_data():
    raw = np.random.default_rng(4).integers(0, 4, 60_000).astype(np.uint8).tobytes() + b"ab" * 9000
    assert grid._lzw(lzw(raw)) == raw and grid._lzw(lzw(b"")) == b"" and grid._lzw(lzw(b"x" * 5000)) == b"x" * 5000


def test_names_nodata_and_errors(spark, tmp_path):
    values = np.full((8, 8), -1, "<f4")
    values[4:, 4:] = 3
    xml = b'<GDALMetadata><Item name="STATS">1</Item><Item name="long_name" sample="0">rain depth</Item></GDALMetadata>\0'
    (tmp_path / "a.tif").write_bytes(tiff(values, tile=(4, 4), compression=8, extra=[(42112, 2, xml), (42113, 2, b"-1\0")]))
    (row,) = grid.scan_geotiff(spark, str(tmp_path / "a.tif")).collect()
    assert (row.variable, row.starts, row["values"]) == ("rain depth", [4, 4], [3.0] * 16)
    (tmp_path / "b.tif").write_bytes(tiff(values, strip=3, extra=[(270, 2, b"snow \0"), (42112, 2, xml)]))
    assert {r.variable for r in grid.scan_geotiff(spark, str(tmp_path / "b.tif")).collect()} == {"snow"}
    PACK[7] = bytes
    (tmp_path / "c.tif").write_bytes(tiff(values, compression=7))
    (tmp_path / "d.tif").write_bytes(tiff(values, tile=(4, 4), compression=8)[:60])
    errors = [r.error for r in grid.scan_geotiff(spark, [str(tmp_path / "c.tif"), str(tmp_path / "d.tif")]).collect()]
    assert len(errors) == 2 and "compression 7" in "".join(errors)
