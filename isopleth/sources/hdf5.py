"""HDF5 files, as NetCDF-4 writes them: groups, attributes, dimension scales, contiguous and chunked numbers.

A file is read in place: metadata by small reads, and of a chunked dataset only the chunks that a slab needs.
"""

import math
import struct
import zlib

import numpy as np

MAGIC = b"\x89HDF\r\n\x1a\n"
# Groups that are tried where the root has no grids.
GROUPS = ("Grid", "HDFEOS/GRIDS", "data", "Data")
_NOWHERE = 0xFFFFFFFFFFFFFFFF
# Fixed value: the name of a dimension that is no variable begins so.
_BARE = "This is a netCDF dimension but not a netCDF variable"


class _Bytes:
    """Reads fields one after another."""

    def __init__(self, raw: bytes, at: int = 0):
        self.raw, self.at = raw, at

    def int(self, size: int) -> int:
        self.at += size
        return int.from_bytes(self.raw[self.at - size : self.at], "little")

    def take(self, size: int) -> bytes:
        self.at += size
        return self.raw[self.at - size : self.at]

    def align(self, begin: int) -> None:
        self.at += -(self.at - begin) % 8


class Hdf5:
    """The numeric datasets of a group as variables: the root's, or of the first group in GROUPS that has any."""

    def __init__(self, source):
        self.source = source
        head = self._at(0, 96)
        if head[:8] != MAGIC:
            raise ValueError("not an HDF5 file")
        if head[8] > 3:
            raise ValueError(f"HDF5 superblock {head[8]} is not read")
        old = head[8] < 2
        self.o, self.l = (head[13], head[14]) if old else (head[9], head[10])
        if (self.o, self.l) != (8, 8):
            raise ValueError("only HDF5 files with addresses of eight bytes are read")
        root = _Bytes(head, (24 if head[8] == 0 else 28) + 4 * 8 + 8).int(8) if old else _Bytes(head, 12 + 3 * 8).int(8)
        self.names: dict[int, str] = {}
        self.objects = self._grids(root)
        for path in GROUPS if not self._numeric() else ():
            at = root
            for part in path.split("/"):
                at = self._links(at).get(part) if at is not None else None
            if at is not None:
                self.objects = self._grids(at)
                if self._numeric():
                    break

    def _at(self, address: int, size: int) -> bytes:
        self.source.seek(address)
        return self.source.read(size)

    def messages(self, address: int) -> list[tuple[int, bytes]]:
        """(type, data) of an object's header messages."""
        head = self._at(address, 64)
        found = []
        if len(head) < 16:
            raise ValueError("the file ends before its metadata")
        if head[:4] == b"OHDR":
            r, flags = _Bytes(head, 6), head[5]
            r.at += (16 if flags & 0x20 else 0) + (4 if flags & 0x10 else 0)
            size = r.int(1 << (flags & 3))
            blocks, new, extra = [(address + r.at, size)], True, 2 if flags & 4 else 0
        else:
            blocks, new, extra = [(address + 16, _Bytes(head, 8).int(4))], False, 0
        for begin, size in blocks:  # grows by continuations
            raw = self._at(begin, size)
            if len(raw) < size:
                raise ValueError("the file ends before its metadata")
            r = _Bytes(raw)
            while r.at + (4 + extra if new else 8) <= len(raw):
                kind, length = (r.int(1), r.int(2)) if new else (r.int(2), r.int(2))
                flags = r.int(1)
                r.at += extra if new else 3
                data = r.take(length)
                if kind == 0x10:
                    c = _Bytes(data)
                    at, size = c.int(8), c.int(8)
                    blocks.append((at + 4, size - 8) if new else (at, size))
                elif flags & 2:
                    raise ValueError("shared header messages are not read")
                elif kind:
                    found.append((kind, data))
        return found

    def _links(self, address: int) -> dict[str, int]:
        """Names and addresses of what a group holds."""
        found = {}
        for kind, data in self.messages(address):
            if kind == 0x11:
                tree, heap = struct.unpack_from("<QQ", data)
                heap = _Bytes(self._at(heap, 32), 8)
                size, _, names = heap.int(8), heap.int(8), heap.int(8)
                names = self._at(names, size)
                for node in self._leaves(tree):
                    raw = self._at(node, 8)
                    count = _Bytes(raw, 6).int(2)
                    raw = self._at(node + 8, 40 * count)
                    for i in range(count):
                        name, at = struct.unpack_from("<QQ", raw, 40 * i)
                        found[names[name : names.index(b"\0", name)].decode()] = at
            elif kind == 0x06:
                found |= self._link(data)
            elif kind == 0x02:
                r = _Bytes(data, 2 + (8 if data[1] & 1 else 0))
                for link in self._dense(r.int(8), r.int(8), 4):
                    found |= self._link(link)
        return found

    def _link(self, data: bytes) -> dict[str, int]:
        r, flags = _Bytes(data, 2), data[1]
        kind = r.int(1) if flags & 8 else 0
        r.at += (8 if flags & 4 else 0) + (1 if flags & 0x10 else 0)
        name = r.take(r.int(1 << (flags & 3))).decode()
        return {name: r.int(8)} if kind == 0 else {}  # soft and external links lead to no other data

    def _leaves(self, tree: int) -> list[int]:
        """Symbol nodes below a group's B-tree."""
        if tree == _NOWHERE:
            return []
        raw = self._at(tree, 24)
        level, used = raw[5], _Bytes(raw, 6).int(2)
        raw = self._at(tree + 24, 16 * used + 8)
        below = [_Bytes(raw, 16 * i + 8).int(8) for i in range(used)]
        return below if level == 0 else [leaf for child in below for leaf in self._leaves(child)]

    def _dense(self, heap: int, tree: int, skip: int):
        """Objects of a fractal heap that a B-tree of the second version lists; skip: bytes of a record before the id."""
        if heap == _NOWHERE:
            return
        h = _Bytes(self._at(heap, 160), 5)
        h.at += 2 + 2  # id and filter sizes
        h.at += 1
        managed = h.int(4)
        h.at += 8 * 12
        width, first, largest, bits, _, root, rows = h.int(2), h.int(8), h.int(8), h.int(2), h.int(2), h.int(8), h.int(2)
        t = _Bytes(self._at(tree, 48), 6)
        t.at += 4
        size, depth = t.int(2), t.int(2)
        t.at += 2
        leaf, count = t.int(8), t.int(2)
        if depth:
            raise ValueError("groups of many links are not read")
        raw = self._at(leaf + 6, size * count) if count else b""
        wide, long = -(-bits // 8), (min(largest, managed).bit_length() - 1) // 8 + 1
        for i in range(count):
            r = _Bytes(raw, size * i + skip)
            if r.int(1) & 0x30:
                raise ValueError("huge and tiny heap objects are not read")
            offset, length = r.int(wide), r.int(long)
            at = root
            if rows:  # the root lists blocks: two rows of the first size, then each row twice as large
                table, row = self._at(root + 5 + 8 + wide, 8 * width * rows), 0
                while offset >= width * (block := first << max(0, row - 1)):
                    offset, row = offset - width * block, row + 1
                if block > largest:
                    raise ValueError("heaps of several levels are not read")
                at = _Bytes(table, 8 * (row * width + offset // block)).int(8)
                offset %= block
            yield self._at(at + offset, length)

    def _grids(self, group: int) -> dict[str, dict]:
        found = {}
        for name, address in self._links(group).items():
            kinds = dict(self.messages(address))
            if 0x08 in kinds:
                found[name] = self._dataset(name, address)
        self.names = {d["address"]: n for n, d in found.items()}
        return found

    def _dataset(self, name: str, address: int) -> dict:
        out = {"name": name, "address": address, "type": None, "shape": [], "layout": None, "filters": [], "attributes": {}, "fill": None, "error": None}
        for kind, data in self.messages(address):
            if kind == 0x01:
                out["shape"] = self._shape(data)
            elif kind == 0x03:
                out["type"] = self._type(data)
            elif kind == 0x05:
                out["fill"] = self._fill(data)
            elif kind == 0x08:
                out["layout"], out["error"] = self._layout(data)
            elif kind == 0x0B:
                out["filters"] = self._filters(data)
            elif kind == 0x0C:
                out["attributes"] |= self._attribute(data)
            elif kind == 0x15:
                r = _Bytes(data, 2 + (2 if data[1] & 1 else 0))
                for one in self._dense(r.int(8), r.int(8), 0):
                    out["attributes"] |= self._attribute(one)
        return out

    @staticmethod
    def _shape(data: bytes) -> list[int]:
        rank, begin = data[1], 8 if data[0] == 1 else 4
        return [int.from_bytes(data[begin + 8 * i : begin + 8 * i + 8], "little") for i in range(rank)]

    @staticmethod
    def _type(data: bytes) -> np.dtype | None:
        """The type of integers and floats of whole bytes; none for others."""
        kind, size = data[0] & 15, int.from_bytes(data[4:8], "little")
        order = ">" if data[1] & 1 else "<"
        if kind == 0 and size in (1, 2, 4, 8):
            return np.dtype(f"{order}{'i' if data[1] & 8 else 'u'}{size}")
        return np.dtype(f"{order}f{size}") if kind == 1 and size in (2, 4, 8) else None

    @staticmethod
    def _fill(data: bytes) -> bytes | None:
        r = _Bytes(data)
        if r.int(1) == 3:
            return r.take(r.int(4)) if r.int(1) & 0x20 else None
        r.at += 2
        return r.take(r.int(4)) or None if r.int(1) and len(data) >= 8 else None

    @staticmethod
    def _layout(data: bytes) -> tuple:
        if data[0] != 3:
            return None, f"HDF5 layout {data[0]} is not read"
        if data[1] == 0:
            return ("compact", data[4 : 4 + int.from_bytes(data[2:4], "little")]), None
        if data[1] == 1:
            return ("contiguous", *struct.unpack_from("<QQ", data, 2)), None
        rank = data[2]
        return ("chunked", int.from_bytes(data[3:11], "little"), list(struct.unpack_from(f"<{rank}I", data, 11))[:-1]), None

    @staticmethod
    def _filters(data: bytes) -> list[tuple[int, list[int]]]:
        r, old, found = _Bytes(data, 8 if data[0] == 1 else 2), data[0] == 1, []
        for _ in range(data[1]):
            kind = r.int(2)
            name = r.int(2) if old or kind >= 256 else 0
            r.at += 2
            n = r.int(2)
            r.at += name + (-name % 8 if old else 0)
            found.append((kind, [r.int(4) for _ in range(n)]))
            r.at += 4 if old and n % 2 else 0
        return found

    def _attribute(self, data: bytes) -> dict:
        """A name and its numbers, text, or lists of object addresses."""
        r, version = _Bytes(data, 2), data[0]
        sizes = [r.int(2) for _ in range(3)]
        r.at += 1 if version == 3 else 0
        parts = []
        for size in sizes:
            parts.append(r.take(size))
            r.at += -size % 8 if version == 1 else 0
        name, kind, raw = parts[0].rstrip(b"\0").decode(), parts[1], data[r.at :]
        n = math.prod(self._shape(parts[2]))
        size, group = int.from_bytes(kind[4:8], "little"), kind[0] & 15
        if group == 3:
            return {name: raw[: size * n].split(b"\0")[0].decode("utf-8", "replace")}
        if group == 9:
            objects = [self._global(raw[16 * i : 16 * i + 16]) for i in range(n)]
            if kind[1] & 15 == 1:
                return {name: objects[0].rstrip(b"\0").decode("utf-8", "replace") if objects else ""}
            return {name: [list(struct.unpack(f"<{len(x) // 8}Q", x[: len(x) // 8 * 8])) for x in objects]}
        number = self._type(kind)
        return {name: np.frombuffer(raw[: number.itemsize * n], number).tolist()} if number is not None else {}

    def _global(self, reference: bytes) -> bytes:
        """An object of a global heap, by its length, address and number."""
        length, address, number = struct.unpack("<IQI", reference)
        if address in (0, _NOWHERE):
            return b""
        size = _Bytes(self._at(address, 16), 8).int(8)
        r = _Bytes(self._at(address, size), 16)
        while r.at + 16 <= size:
            index = r.int(2)
            r.at += 6
            n = r.int(8)
            if index == number:
                return r.take(n)
            if index == 0:
                break
            r.at += n + -n % 8
        return b""

    # what scan_grids asks of a file

    def _numeric(self) -> list[str]:
        return [n for n, d in self.objects.items() if d["type"] is not None and d["shape"] and d["attributes"].get("CLASS") != "DIMENSION_SCALE"]

    def variables(self) -> list[str]:
        return self._numeric()

    def attributes(self, name: str) -> dict:
        return self.objects[name]["attributes"]

    def dims(self, name: str) -> list[tuple[str, int]]:
        """Dimensions by the scales that the variable names, else by its place."""
        d = self.objects[name]
        scales = d["attributes"].get("DIMENSION_LIST") or []
        names = [self.names.get(s[0]) if s else None for s in scales] if isinstance(scales, list) else []
        return [(names[i] if i < len(names) and names[i] else f"dim_{i}", size) for i, size in enumerate(d["shape"])]

    def coordinates(self, name: str, start: int, count: int) -> np.ndarray | None:
        d = self.objects.get(name)
        if d is None or d["type"] is None or len(d["shape"]) != 1 or str(d["attributes"].get("NAME", "")).startswith(_BARE):
            return None
        return self.read(name, [start], [count]).astype(float)

    def fill(self, name: str) -> float | None:
        d = self.objects[name]
        own = d["attributes"].get("_FillValue") or d["attributes"].get("missing_value")
        return own[0] if isinstance(own, list) and own else None

    def read(self, name: str, starts: list[int], counts: list[int]) -> np.ndarray:
        """A slab of a dataset."""
        d = self.objects[name]
        kind, shape = d["type"], d["shape"]
        if d["error"]:
            raise ValueError(d["error"])
        out = np.full(counts, np.frombuffer(d["fill"], kind)[0] if d["fill"] and len(d["fill"]) == kind.itemsize else 0, kind)
        if d["layout"][0] == "compact":
            return np.frombuffer(d["layout"][1], kind, math.prod(shape)).reshape(shape)[tuple(slice(s, s + c) for s, c in zip(starts, counts))]
        if d["layout"][0] == "contiguous":
            if d["layout"][1] == _NOWHERE:
                return out
            inner = shape[1:]
            take = tuple(slice(s, s + c) for s, c in zip(starts[1:], counts[1:]))
            step = kind.itemsize * math.prod(inner)
            for i in range(counts[0]):
                raw = self._at(d["layout"][1] + (starts[0] + i) * step, step)
                out[i] = np.frombuffer(raw, kind).reshape(inner)[take] if inner else np.frombuffer(raw, kind)[0]
            return out
        _, tree, chunk = d["layout"]
        for address, size, mask, offsets in self._chunks(tree, chunk, starts, counts):
            cells = np.frombuffer(self._unfiltered(self._at(address, size), d["filters"], mask, kind.itemsize), kind, math.prod(chunk)).reshape(chunk)
            low = [max(s, o) for s, o in zip(starts, offsets)]
            high = [min(s + c, o + k) for s, c, o, k in zip(starts, counts, offsets, chunk)]
            out[tuple(slice(a - s, b - s) for a, b, s in zip(low, high, starts))] = cells[tuple(slice(a - o, b - o) for a, b, o in zip(low, high, offsets))]
        return out

    def _chunks(self, tree: int, chunk: list[int], starts: list[int], counts: list[int]):
        """(address, size, filter mask, offsets) of the chunks that meet a slab; of the tree only nodes that may have some are read."""
        if tree == _NOWHERE:
            return
        raw = self._at(tree, 24)
        if raw[:4] != b"TREE" or raw[4] != 1:
            raise ValueError("no chunk index where there should be one")
        level, used, wide = raw[5], _Bytes(raw, 6).int(2), 8 * (len(chunk) + 1) + 8
        raw = self._at(tree + 24, used * (wide + 8) + wide)
        keys = [struct.unpack_from(f"<II{len(chunk)}Q", raw, i * (wide + 8)) for i in range(used + 1)]
        for i in range(used):
            address = _Bytes(raw, i * (wide + 8) + wide).int(8)
            size, mask, *offsets = keys[i]
            if level:
                # keys rise in row order, so the first dimension bounds what is below
                if offsets[0] < starts[0] + counts[0] and keys[i + 1][2] + chunk[0] > starts[0]:
                    yield from self._chunks(address, chunk, starts, counts)
            elif all(o < s + c and o + k > s for o, k, s, c in zip(offsets, chunk, starts, counts)):
                yield address, size, mask, offsets

    @staticmethod
    def _unfiltered(raw: bytes, filters: list, mask: int, width: int) -> bytes:
        for i, (kind, values) in reversed(list(enumerate(filters))):
            if mask >> i & 1:
                continue
            if kind == 1:
                raw = zlib.decompress(raw)
            elif kind == 2:
                width = values[0] if values else width
                whole = len(raw) // width * width
                raw = np.frombuffer(raw[:whole], np.uint8).reshape(width, -1).T.tobytes() + raw[whole:]
            elif kind == 3:
                raw = raw[:-4]
            else:
                raise ValueError(f"HDF5 filter {kind} is not read")
        return raw
