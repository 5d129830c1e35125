"""FlatGeobuf polygons: header, spatial index and features, read straight from the flat buffers; and a writer.

A bounding box is answered from the packed R-tree, so features outside it are never decoded; files without an index
are filtered by the box of each feature's own vertices.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format.
MAGIC = b"fgb\x03fgb\x00"
NODE = np.dtype([("box", "<f8", 4), ("offset", "<u8")])
POLYGON, MULTI, COLLECTION, SURFACE, TIN, TRIANGLE = 3, 6, 7, 15, 16, 17
SCALARS = {0: "b", 1: "B", 2: "?", 3: "h", 4: "H", 5: "i", 6: "I", 7: "q", 8: "Q", 9: "f", 10: "d"}
TEXTS = (11, 12, 13, 14)


class FormatError(ValueError):
    pass


class Table:
    """A flat-buffer table: fields by number through its offset table."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at
        self.fields = at - struct.unpack_from("<i", data, at)[0]
        self.size = struct.unpack_from("<H", data, self.fields)[0]

    @classmethod
    def root(cls, data: bytes) -> Table:
        return cls(data, struct.unpack_from("<I", data, 0)[0])

    def _place(self, n: int) -> int:
        slot = 4 + 2 * n
        offset = struct.unpack_from("<H", self.data, self.fields + slot)[0] if slot < self.size else 0
        return self.at + offset if offset else 0

    def scalar(self, n: int, kind: str, default=0):
        p = self._place(n)
        return struct.unpack_from(f"<{kind}", self.data, p)[0] if p else default

    def _target(self, n: int) -> int:
        p = self._place(n)
        return p + struct.unpack_from("<I", self.data, p)[0] if p else 0

    def vector(self, n: int, dtype: str) -> np.ndarray:
        t = self._target(n)
        return np.frombuffer(self.data, dtype, struct.unpack_from("<I", self.data, t)[0], t + 4) if t else np.zeros(0, dtype)

    def table(self, n: int) -> Table | None:
        t = self._target(n)
        return Table(self.data, t) if t else None

    def tables(self, n: int) -> list[Table]:
        t = self._target(n)
        count = struct.unpack_from("<I", self.data, t)[0] if t else 0
        places = [t + 4 + 4 * i for i in range(count)]
        return [Table(self.data, p + struct.unpack_from("<I", self.data, p)[0]) for p in places]

    def text(self, n: int) -> str:
        return self.vector(n, "u1").tobytes().decode("utf-8", "replace")


def tree_levels(features: int, width: int) -> list[tuple[int, int]]:
    """(first, last) node of each level, leaves first; the root is node 0."""
    counts = [features]
    while counts[-1] > 1 or len(counts) == 1:
        counts.append(-(-counts[-1] // width))
        if counts[-1] == 1:
            break
    end, out = sum(counts), []
    for n in counts:
        out.append((end - n, end))
        end -= n
    return out


def selected(nodes: np.ndarray, features: int, width: int, box) -> list[int]:
    """Offsets of the features whose boxes meet (west, south, east, north), in file order."""
    levels = tree_levels(features, width)
    open_, out = [(0, len(levels) - 1)], []
    while open_:
        first, level = open_.pop()
        part = nodes[first : min(first + width, levels[level][1])]
        b = part["box"]
        hit = (b[:, 0] <= box[2]) & (b[:, 2] >= box[0]) & (b[:, 1] <= box[3]) & (b[:, 3] >= box[1])
        for offset in part["offset"][hit].tolist():
            out.append(offset) if level == 0 else open_.append((offset, level - 1))
    return sorted(out)


def _polygons(g: Table, kind: int):
    """(exterior, holes, top) of each polygon in a geometry; top is its highest Z, null without any."""
    kind = g.scalar(6, "B") or kind
    parts = g.tables(7)
    if kind in (MULTI, COLLECTION, SURFACE, TIN) and parts:
        for p in parts:
            yield from _polygons(p, TRIANGLE if kind == TIN else POLYGON)
        return
    if kind not in (POLYGON, TRIANGLE):
        return
    xy, z, ends = g.vector(1, "<f8").reshape(-1, 2), g.vector(2, "<f8"), g.vector(0, "<u4").tolist() or None
    rings, at = [], 0
    for end in ends or [len(xy)]:
        ring = [tuple(p) for p in xy[at:end].tolist()]
        rings.append(ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)
        at = end
    if rings and len(rings[0]) >= 3:
        yield rings[0], rings[1:], float(z.max()) if len(z) else None


def _properties(raw: bytes, columns: list[tuple[str, int]]) -> dict:
    at, out = 0, {}
    while at + 2 <= len(raw):
        name, kind = columns[struct.unpack_from("<H", raw, at)[0]]
        at += 2
        if kind in SCALARS:
            out.setdefault(name, struct.unpack_from(f"<{SCALARS[kind]}", raw, at)[0])
            at += struct.calcsize(SCALARS[kind])
        elif kind in TEXTS:
            n = struct.unpack_from("<I", raw, at)[0]
            out.setdefault(name, raw[at + 4 : at + 4 + n].decode("utf-8", "replace"))
            at += 4 + n
        else:
            raise FormatError(f"column type {kind}")
    return out


def read(data: bytes, box=None) -> list[tuple[dict, list, list, float | None]]:
    """(properties, exterior, holes, top) of the polygons of a file, of those that meet box only if one is given."""
    if data[:3] != MAGIC[:3] or data[3:4] != MAGIC[3:4]:
        raise FormatError("not a FlatGeobuf file")
    n = struct.unpack_from("<I", data, 8)[0]
    head = Table.root(data[12 : 12 + n])
    whole, kind, count, width = head.vector(1, "<f8"), head.scalar(2, "B"), head.scalar(8, "Q"), head.scalar(9, "H", 16)
    columns = [(c.text(0), c.scalar(1, "B")) for c in head.tables(7)]
    if box is not None and len(whole) >= 4 and not (whole[0] <= box[2] and whole[2] >= box[0] and whole[1] <= box[3] and whole[3] >= box[1]):
        return []
    at, wanted = 12 + n, None
    if width and count:
        nodes = sum(b - a for a, b in tree_levels(count, width))
        if box is not None:
            wanted = selected(np.frombuffer(data, NODE, nodes, at), count, width, box)
        at += nodes * NODE.itemsize
    out, base = [], at
    places = iter(base + w for w in wanted) if wanted is not None else None
    while True:
        at = next(places, len(data)) if places is not None else at
        if at >= len(data):
            return out
        size = struct.unpack_from("<I", data, at)[0]
        if at + 4 + size > len(data):
            raise FormatError("truncated feature")
        f = Table.root(data[at + 4 : at + 4 + size])
        at += 4 + size
        g = f.table(0)
        if g is None:
            continue
        tags = _properties(f.vector(1, "u1").tobytes(), columns)
        for ring, holes, top in _polygons(g, kind):
            xs, ys = zip(*ring, strict=True)
            if box is None or (min(xs) <= box[2] and max(xs) >= box[0] and min(ys) <= box[3] and max(ys) >= box[1]):
                out.append((tags, ring, holes, top))


def _table(fields: dict) -> bytes:
    """A table in its own buffer, root offset first. fields: {number: ('scalar kind', value) | ('raw', vector bytes) | ('tables', [buffers])}."""
    last = max(fields, default=-1)
    body, slots, later = bytearray(4), [0] * (last + 1), []
    for n, (kind, value) in sorted(fields.items()):
        width = struct.calcsize(kind) if kind in "BHQd?" else 4
        body += b"\0" * (-len(body) % width)
        slots[n] = len(body)
        if kind in "BHQd?":
            body += struct.pack(f"<{kind}", value)
        else:
            later.append((len(body), kind, value))
            body += b"\0\0\0\0"
    vtable = struct.pack(f"<{2 + len(slots)}H", 4 + 2 * len(slots), len(body), *slots)
    vtable += b"\0" * (-(4 + len(vtable)) % 8)
    out = bytearray(struct.pack("<I", 4 + len(vtable)) + vtable + body)
    start = 4 + len(vtable)
    struct.pack_into("<i", out, start, start - 4)
    for place, kind, value in later:
        out += b"\0" * (-(len(out) + 4) % 8)
        target = len(out)
        if kind == "raw":
            out += struct.pack("<I", value[0]) + value[1]
        else:
            out += struct.pack("<I", len(value)) + b"\0" * (4 * len(value))
            for i, buffer in enumerate(value):
                out += b"\0" * (-len(out) % 8)
                struct.pack_into("<I", out, target + 4 + 4 * i, len(out) + struct.unpack_from("<I", buffer)[0] - (target + 4 + 4 * i))
                out += buffer
        if kind == "one":
            struct.pack_into("<I", out, start + place, target + 4 + struct.unpack_from("<I", out, target + 4)[0] - (start + place))
        else:
            struct.pack_into("<I", out, start + place, target - (start + place))
    return bytes(out)


def write(polygons: list[tuple[dict, list, list, float | None]], width: int = 16) -> bytes:
    """A file of polygons with text properties and a packed index in the given order (width 0: no index)."""
    doubles = lambda v: ("raw", (len(v), np.asarray(v, "<f8").tobytes()))
    names = sorted({k for p in polygons for k in p[0]})
    text = lambda s: ("raw", (len(s.encode()), s.encode()))
    boxes, features, offset = [], b"", 0
    nodes = []
    for tags, ring, holes, top in polygons:
        rings = [[*r, r[0]] for r in (ring, *holes)]
        flat = [c for r in rings for p in r for c in p]
        g = {0: ("raw", (len(rings), np.cumsum([len(r) for r in rings]).astype("<u4").tobytes())), 1: doubles(flat)}
        if top is not None:
            g[2] = doubles([top] * (len(flat) // 2))
        raw = b"".join(struct.pack("<HI", names.index(k), len(str(v).encode())) + str(v).encode() for k, v in tags.items())
        buffer = _table({0: ("one", [_table(g)]), 1: ("raw", (len(raw), raw))})
        box = [min(flat[::2]), min(flat[1::2]), max(flat[::2]), max(flat[1::2])]
        boxes.append(box)
        nodes.append((box, offset))
        features += struct.pack("<I", len(buffer)) + buffer
        offset = len(features)
    whole = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)]
    columns = [_table({0: text(n), 1: ("B", 11)}) for n in names]
    head = _table({1: doubles(whole), 2: ("B", POLYGON), 7: ("tables", columns), 8: ("Q", len(polygons)), 9: ("H", width)})
    index = b""
    if width:
        levels, rows = tree_levels(len(polygons), width), [nodes]
        for first, _ in levels[:-1]:
            below = rows[-1]
            rows.append([([min(b[0][0] for b in c), min(b[0][1] for b in c), max(b[0][2] for b in c), max(b[0][3] for b in c)], first + k) for k in range(0, len(below), width) for c in [below[k : k + width]]])
        index = np.array([tuple(r) for level in reversed(rows) for r in level], NODE).tobytes()
    return MAGIC + struct.pack("<I", len(head)) + head + index + features
