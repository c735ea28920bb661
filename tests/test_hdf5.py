"""HDF5 files written here by the published format, old and new style, read back as grids."""

import io
import struct
import zlib

import numpy as np
import pytest

from isopleth.sources import archives, grid, hdf5

NOWHERE = 0xFFFFFFFFFFFFFFFF


class Writer:
    """Lays out objects one after another; their addresses are known once they are written."""

    def __init__(self, new: bool):
        self.out, self.new = io.BytesIO(), new
        self.out.write(b"\0" * 128)

    def put(self, raw: bytes) -> int:
        self.out.seek(0, 2)
        self.out.write(b"\0" * (-self.out.tell() % 8))
        at = self.out.tell()
        self.out.write(raw)
        return at

    def header(self, messages: list[tuple[int, bytes]], split: bool = False) -> int:
        """An object header; split: its last message lies in a continuation block."""
        if self.new:
            pack = lambda found: b"".join(struct.pack("<BHB", k, len(d), 0) + d for k, d in found)
            if split:
                block = b"OCHK" + pack(messages[-1:]) + b"\0" * 4
                messages = [*messages[:-1], (0x10, struct.pack("<QQ", self.put(block), len(block)))]
            body = pack(messages)
            return self.put(b"OHDR" + struct.pack("<BBI", 2, 2, len(body)) + body + b"\0" * 4)
        padded = [(k, d + b"\0" * (-len(d) % 8)) for k, d in messages]
        pack = lambda found: b"".join(struct.pack("<HHB3x", k, len(d), 0) + d for k, d in found)
        if split:
            block = pack(padded[-1:])
            padded = [*padded[:-1], (0x10, struct.pack("<QQ", self.put(block), len(block)))]
        body = pack(padded)
        return self.put(struct.pack("<BBHII4x", 1, 0, len(padded) + split, 1, len(body)) + body)

    @staticmethod
    def space(shape):
        return struct.pack("<BB6x", 1, len(shape)) + struct.pack(f"<{len(shape)}Q", *shape)

    @staticmethod
    def type(kind):
        kind = np.dtype(kind)
        big = kind.byteorder == ">"
        if kind.kind == "f":
            return struct.pack("<B3BI", 0x11, 0x20 | big, 31, 0, kind.itemsize) + b"\0" * 12
        return struct.pack("<B3BI", 0x10, big | (8 if kind.kind == "i" else 0), 0, 0, kind.itemsize) + struct.pack("<HH", 0, 8 * kind.itemsize)

    def attribute(self, name, kind, shape, raw):
        name, space = name.encode() + b"\0", self.space(shape)
        if self.new:
            return 0x0C, struct.pack("<BBHHHB", 3, 0, len(name), len(kind), len(space), 1) + name + kind + space + raw
        pad = lambda b: b + b"\0" * (-len(b) % 8)
        return 0x0C, struct.pack("<BxHHH", 1, len(name), len(kind), len(space)) + pad(name) + pad(kind) + pad(space) + raw

    def text(self, name, value):
        raw = value.encode() + b"\0"
        return self.attribute(name, struct.pack("<B3BI", 0x13, 0, 0, 0, len(raw)), [], raw)

    def heap(self, objects):
        """References into a global heap of the objects."""
        body = b"".join(struct.pack("<HH4xQ", i, 1, len(o)) + o + b"\0" * (-len(o) % 8) for i, o in enumerate(objects, 1)) + b"\0" * 16
        at = self.put(b"GCOL" + struct.pack("<B3xQ", 1, 16 + len(body)) + body)
        return [(at, i) for i in range(1, len(objects) + 1)]

    def vlen_text(self, name, value):
        ((at, i),) = self.heap([value.encode()])
        return self.attribute(name, struct.pack("<B3BI", 0x19, 1, 0, 0, 16) + self.type("u1"), [], struct.pack("<IQI", len(value), at, i))

    def scales(self, addresses):
        found = self.heap([struct.pack("<Q", a) for a in addresses])
        reference = struct.pack("<B3BI", 0x17, 0, 0, 0, 8)
        return self.attribute("DIMENSION_LIST", struct.pack("<B3BI", 0x19, 0, 0, 0, 16) + reference, [len(addresses)], b"".join(struct.pack("<IQI", 1, a, i) for a, i in found))

    def contiguous(self, values, attributes):
        at = self.put(values.tobytes())
        return self.header([(1, self.space(values.shape)), (3, self.type(values.dtype)), (8, struct.pack("<BBQQ", 3, 1, at, values.nbytes)), *attributes], split=True)

    def chunked(self, values, chunk, attributes, checksum=False, fill=None, leave=()):
        """Deflated, shuffled chunks under a tree of two levels; chunks in `leave` are not written."""
        width, entries = values.dtype.itemsize, []
        for n in np.ndindex(*(-(-s // c) for s, c in zip(values.shape, chunk))):
            if n in leave:
                continue
            offsets = [i * c for i, c in zip(n, chunk)]
            cells = np.zeros(chunk, values.dtype)
            some = values[tuple(slice(o, o + c) for o, c in zip(offsets, chunk))]
            cells[tuple(slice(0, s) for s in some.shape)] = some
            mask = 2 if n == (0,) * len(n) else 0  # of the first chunk deflating is skipped
            raw = np.frombuffer(cells.tobytes(), np.uint8).reshape(-1, width).T.tobytes()
            raw = (raw if mask else zlib.compress(raw)) + (b"\0" * 4 if checksum else b"")
            entries.append((len(raw), mask, offsets, self.put(raw)))
        end = (0, 0, [-(-s // c) * c for s, c in zip(values.shape, chunk)])
        key = lambda size, mask, offsets: struct.pack(f"<II{len(chunk) + 1}Q", size, mask, *offsets, 0)

        def node(level, found, last):
            return self.put(b"TREE" + struct.pack("<BBHQQ", 1, level, len(found), NOWHERE, NOWHERE) + b"".join(key(*e[:3]) + struct.pack("<Q", e[3]) for e in found) + key(*last))

        groups = [entries[i : i + 3] for i in range(0, len(entries), 3)]
        leaves = [(*g[0][:3], node(0, g, groups[i + 1][0][:3] if i + 1 < len(groups) else end)) for i, g in enumerate(groups)]
        filters = [(2, [width]), (1, [4])] + ([(3, [])] if checksum else [])
        if self.new:
            pipeline = struct.pack("<BB", 2, len(filters)) + b"".join(struct.pack("<HHH", k, 0, len(v)) + struct.pack(f"<{len(v)}I", *v) for k, v in filters)
        else:
            pipeline = struct.pack("<BB6x", 1, len(filters)) + b"".join(struct.pack("<HHHH", k, 8, 0, len(v)) + b"filter\0\0" + struct.pack(f"<{len(v)}I", *v) + b"\0" * (4 * (len(v) % 2)) for k, v in filters)
        layout = struct.pack(f"<BBBQ{len(chunk) + 1}I", 3, 2, len(chunk) + 1, node(1, leaves, end), *chunk, width)
        raw = np.array(fill, values.dtype).tobytes() if fill is not None else b""
        filled = [(5, struct.pack("<BBI", 3, 0x2A, len(raw)) + raw)] if fill is not None else []
        return self.header([(1, self.space(values.shape)), (3, self.type(values.dtype)), *filled, (8, layout), (0x0B, pipeline), *attributes])

    def group(self, members: dict[str, int], dense=False):
        link = lambda name, at: struct.pack("<BBB", 1, 0, len(name.encode())) + name.encode() + struct.pack("<Q", at)
        if self.new and not dense:
            return self.header([(2, struct.pack("<BBQQ", 0, 0, NOWHERE, NOWHERE)), *((6, link(*m)) for m in members.items())])
        if self.new:
            links, ids, block = [link(*m) for m in members.items()], [], b"FHDB" + struct.pack("<BQI", 0, 0, 0)
            for raw in links:
                ids.append(struct.pack("<BIH", 0, len(block), len(raw)))
                block += raw
            root = self.put(block.ljust(512, b"\0"))
            heap = self.put(b"FRHP" + struct.pack("<BHHBI", 0, 7, 0, 0, 4096) + b"\0" * 96 + struct.pack("<HQQHHQH", 4, 512, 65536, 32, 1, root, 0) + b"\0" * 4)
            leaf = self.put(b"BTLF" + struct.pack("<BB", 0, 5) + b"".join(struct.pack("<I", i) + x for i, x in enumerate(ids)) + b"\0" * 4)
            tree = self.put(b"BTHD" + struct.pack("<BBIHHBBQHQ", 0, 5, 512, 11, 0, 100, 40, leaf, len(ids), len(ids)) + b"\0" * 4)
            return self.header([(2, struct.pack("<BBQQ", 0, 0, heap, tree))])
        names, at = b"\0" * 8, {}
        for name in members:
            at[name] = len(names)
            names += name.encode() + b"\0" * (8 - len(name.encode()) % 8)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), NOWHERE, self.put(names)))
        ordered = sorted(members)
        nodes = []
        for part in (ordered[:2], ordered[2:]):
            nodes.append(self.put(b"SNOD" + struct.pack("<BxH", 1, len(part)) + b"".join(struct.pack("<QQI4x16x", at[n], members[n], 0) for n in part)))
        tree = self.put(b"TREE" + struct.pack("<BBHQQ", 0, 0, 2, NOWHERE, NOWHERE) + struct.pack("<QQQQQ", 0, nodes[0], 0, nodes[1], 0))
        return self.header([(0x11, struct.pack("<QQ", tree, heap))])

    def file(self, root: int) -> bytes:
        raw = bytearray(self.out.getbuffer())
        if self.new:
            head = hdf5.MAGIC + struct.pack("<BBBBQQQQ", 2, 8, 8, 0, 0, NOWHERE, len(raw), root)
        else:
            head = hdf5.MAGIC + struct.pack("<BBBBBBBBHHI", 0, 0, 0, 0, 0, 8, 8, 0, 4, 16, 0) + struct.pack("<QQQQ", 0, NOWHERE, len(raw), NOWHERE) + struct.pack("<QQI4x16x", 0, root, 0)
        raw[: len(head)] = head
        return bytes(raw)


def build(new, dense=False, group=None, values=None, **options):
    """air(time, y, x) in chunks with its scales, and a bare dimension, as NetCDF-4 lays them out."""
    w = Writer(new)
    scale = w.text("CLASS", "DIMENSION_SCALE")
    members = {name: w.contiguous(v, [scale, w.text("NAME", name)]) for name, v in (("time", np.arange(values.shape[0], dtype=">i4")), ("y", np.linspace(48, 49, values.shape[1])), ("x", np.linspace(17, 18, values.shape[2]).astype("<f4")))}
    members["bare"] = w.contiguous(np.zeros(5, "<f4"), [scale, w.text("NAME", f"{hdf5._BARE}         5")])
    unit = w.vlen_text("units", "K") if new else w.text("units", "K")
    own = [unit, w.attribute("_FillValue", w.type(values.dtype), [1], np.array([-999], values.dtype).tobytes()), w.scales([members["time"], members["y"], members["x"]])]
    members["air"] = w.chunked(values, (4, 2, 3), own, **options)
    members["names"] = w.header([(1, w.space([3])), (3, struct.pack("<B3BI", 0x13, 0, 0, 0, 4)), (8, struct.pack("<BBH", 3, 0, 12) + b"abc\0" * 3)])
    root = w.group(members, dense)
    for name in reversed(group.split("/") if group else []):
        root = w.group({name: root, "other": w.group({"x": members["x"]})} if new else {name: root, "zz": members["names"], "zy": members["names"]})
    return w.file(root)


@pytest.mark.parametrize("new, dense, group, kind", [(False, False, None, "<f4"), (True, False, None, ">f8"), (True, True, None, "<i2"), (False, False, "Grid", "<f8"), (True, False, "HDFEOS/GRIDS", "<f4")])
def test_netcdf4_equals_its_values(spark, tmp_path, new, dense, group, kind):
    values = np.random.default_rng(1).integers(-300, 300, (100, 5, 50)).astype(kind)
    values[0, 0, 0] = -999
    (tmp_path / "a.nc").write_bytes(build(new, dense, group, values, checksum=new))
    slabs = {tuple(r.starts): r for r in grid.scan_netcdf(spark, str(tmp_path)).collect()}
    assert not [r.error for r in slabs.values() if r.error] and set(slabs) == {(t, 0, x) for t in (0, 90) for x in (0, 40)}
    for (t, _, x), r in slabs.items():
        expected = values[t : t + 90, :, x : x + 40].astype(float)
        expected[expected == -999] = np.nan
        assert np.array_equal(np.array(r["values"]), expected.ravel(), equal_nan=True)
        assert (r.variable, r.unit, r.dims) == ("air", "K", ["time", "y", "x"]) and r.lows[:2] == [float(t), 48.0] and r.highs[1] == 49.0
        assert r.lows[2] == pytest.approx(17 + x / 49, abs=1e-5)


def test_chunks_that_are_missing_and_what_is_read():
    values = np.arange(40 * 4 * 6, dtype="<i4").reshape(40, 4, 6)
    raw = build(True, False, None, values, fill=-7, leave={(3, 1, 1)})

    class Counting(io.BytesIO):
        taken = 0

        def read(self, size=-1):
            Counting.taken += size
            return super().read(size)

    file = hdf5.Hdf5(Counting(raw))
    whole = file.read("air", [0, 0, 0], [40, 4, 6])
    expected = values.copy()
    expected[12:16, 2:, 3:] = -7
    assert np.array_equal(whole, expected)
    all_bytes, Counting.taken = Counting.taken, 0
    assert np.array_equal(file.read("air", [5, 1, 2], [2, 2, 2]), expected[5:7, 1:3, 2:4]) and Counting.taken < all_bytes / 4
    assert file.coordinates("bare", 0, 2) is None and file.coordinates("none", 0, 1) is None and file.variables() == ["air"]


def test_errors_and_archives(spark, tmp_path):
    (tmp_path / "in").mkdir()
    raw = build(False, False, None, np.ones((3, 4, 6), "<f4"))
    (tmp_path / "in" / "a.h5").write_bytes(raw)
    (tmp_path / "in" / "b.h5").write_bytes(raw[:200])
    found = {r.file.rsplit("/", 1)[-1]: r for r in archives.load(spark, str(tmp_path / "in"), str(tmp_path / "scratch")).collect()}
    assert (found["a.h5"].variable, found["a.h5"]["mean"], found["a.h5"].unit) == ("air", 1.0, "K") and found["b.h5"].error
    with pytest.raises(ValueError):
        hdf5.Hdf5(io.BytesIO(hdf5.MAGIC + b"\x09" * 90))
