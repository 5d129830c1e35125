"""Vector tiles: protobuf fields, geometry commands, building and forest layers; and an encoder for tests and interchange."""

from __future__ import annotations

import gzip
import math
import struct

# Fixed values of the format and of the layers that are read.
POLYGON = 3
FOREST_PARKS = ("national_forest", "state_forest", "forest")


def gunzipped(data: bytes) -> bytes:
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes):
    """(number, value) of each field of a message: integers, or bytes."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                n, at = _varint(data, at)
            elif kind in (1, 5):
                n = 8 if kind == 1 else 4
            else:
                raise ValueError(f"wire type {kind}")
            if at + n > len(data):
                raise ValueError("truncated message")
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def raw_counts(data: bytes) -> tuple[int, list[str]]:
    """(features of layer `building`, name:count of every layer) from the wire format alone, as far as it can be followed."""
    total, said = 0, []
    for n, body in fields(gunzipped(data)):
        if n != 3 or isinstance(body, int):
            continue
        name, count = "", 0
        for k, v in fields(body):
            if k == 1 and not isinstance(v, int):
                name = v.decode("utf-8", "replace")
            count += k == 2 and not isinstance(v, int)
        said.append(f"{name}:{count}")
        total += count if name == "building" else 0
    return total, said


def _packed(data: bytes) -> list[int]:
    at, out = 0, []
    while at < len(data):
        v, at = _varint(data, at)
        out.append(v)
    return out


def _value(data: bytes):
    for n, v in fields(data):
        if n == 1:
            return v.decode("utf-8", "replace")
        if n in (2, 3):
            return struct.unpack("<f" if n == 2 else "<d", v)[0]
        if n == 4:
            return v - (1 << 64) if v >> 63 else v
        if n == 5:
            return v
        if n == 6:
            return (v >> 1) ^ -(v & 1)
        if n == 7:
            return bool(v)
    return None


def layers(data: bytes):
    """(name, extent, features) of each layer; a feature is (type, tags, commands)."""
    for n, body in fields(gunzipped(data)):
        if n != 3:
            continue
        name, extent, keys, values, raw = "", 4096, [], [], []
        for k, v in fields(body):
            if k == 1:
                name = v.decode("utf-8", "replace")
            elif k == 2:
                raw.append(v)
            elif k == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif k == 4:
                values.append(_value(v))
            elif k == 5:
                extent = v
        features = []
        for f in raw:
            kind, tags, commands = 0, {}, []
            for k, v in fields(f):
                if k == 2:
                    ids = _packed(v)
                    for a, b in zip(ids[::2], ids[1::2], strict=False):
                        if a < len(keys) and b < len(values):
                            tags.setdefault(keys[a], []).append(values[b])
                elif k == 3:
                    kind = v
                elif k == 4:
                    commands = _packed(v)
            features.append((kind, tags, commands))
        yield name, extent, features


def rings(commands: list[int]) -> list[tuple[list[tuple[int, int]], int]]:
    """(vertices in tile units, twice the signed area) of each ring of three vertices or more."""
    out, ring, x, y, i = [], [], 0, 0, 0

    def close():
        if len(ring) >= 3:
            area2 = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True))
            out.append((list(ring), area2))
        ring.clear()

    while i < len(commands):
        what, count = commands[i] & 7, commands[i] >> 3
        i += 1
        if what in (1, 2):
            if what == 1:
                close()
            for _ in range(count):
                if i + 1 >= len(commands):
                    break
                x += (commands[i] >> 1) ^ -(commands[i] & 1)
                y += (commands[i + 1] >> 1) ^ -(commands[i + 1] & 1)
                ring.append((x, y))
                i += 2
        elif what == 7:
            close()
        else:
            i += count * 2
    close()
    return out


def to_degrees(points, extent: int, z: int, x: int, y: int) -> list[tuple[float, float]]:
    """(lon, lat) of tile units, straight between the tile's edges."""
    lon = lambda v: v / 2**z * 360 - 180
    lat = lambda v: math.degrees(math.atan(0.5 * (math.exp(n := math.pi - 2 * math.pi * v / 2**z) - math.exp(-n))))
    west, wide, north, tall = lon(x), lon(x + 1) - lon(x), lat(y), lat(y + 1) - lat(y)
    return [(west + px / extent * wide, north + py / extent * tall) for px, py in points]


def buildings(data: bytes, z: int, x: int, y: int) -> list[tuple[dict, list, list]]:
    """(tags, exterior, holes) of the polygons of layer `building`; the first ring's winding is the exterior one."""
    out = []
    for name, extent, features in layers(data):
        if name != "building":
            continue
        for kind, tags, commands in features:
            if kind != POLYGON:
                continue
            outer, first = None, len(out)
            for points, area2 in rings(commands):
                if not area2:
                    continue
                outer = area2 > 0 if outer is None else outer
                line = to_degrees(points, extent, z, x, y)
                if (area2 > 0) == outer:
                    out.append((tags, line, []))
                elif len(out) > first:
                    out[-1][2].append(line)
    return out


def forests(data: bytes, z: int, x: int, y: int) -> list[tuple[str, list]]:
    """(kind, rings) of woods in layer `landcover` and of managed forests in layer `park`."""
    out = []
    for name, extent, features in layers(data):
        for kind, tags, commands in features if name in ("landcover", "park") else ():
            cls = next((v for v in tags.get("class", ()) if isinstance(v, str)), None)
            what = "wood" if name == "landcover" and cls == "wood" else "managed" if name == "park" and cls in FOREST_PARKS else None
            if kind == POLYGON and what:
                found = [to_degrees(p, extent, z, x, y) for p, _ in rings(commands)]
                if found:
                    out.append((what, found))
    return out


def _put_varint(v: int) -> bytes:
    out = bytearray()
    while v > 127:
        out.append(v & 127 | 128)
        v >>= 7
    return bytes([*out, v])


def _put(n: int, body) -> bytes:
    return _put_varint(n << 3) + _put_varint(body) if isinstance(body, int) else _put_varint(n << 3 | 2) + _put_varint(len(body)) + body


def encode_layer(name: str, features: list[tuple[dict, list]], extent: int = 4096) -> bytes:
    """A tile of one layer of polygons: (tags, rings of tile-unit vertices) each."""
    keys, values, out = [], [], b""
    for tags, lines in features:
        ids = []
        for k, v in tags.items():
            if k not in keys:
                keys.append(k)
            values.append(v)
            ids += [keys.index(k), len(values) - 1]
        cmds, x, y = [], 0, 0
        for line in lines:
            for i, (px, py) in enumerate(line):
                if i < 2:
                    cmds.append(1 | 1 << 3 if i == 0 else 2 | (len(line) - 1) << 3)
                cmds += [(d << 1) ^ (d >> 31) for d in (px - x, py - y)]
                x, y = px, py
            cmds.append(7 | 1 << 3)
        pack = lambda vs: b"".join(_put_varint(v & 0xFFFFFFFF) for v in vs)
        out += _put(2, _put(2, pack(ids)) + _put(3, POLYGON) + _put(4, pack(cmds)))
    vals = b"".join(_put(4, _put(1, v.encode()) if isinstance(v, str) else _put_varint(3 << 3 | 1) + struct.pack("<d", v)) for v in values)
    return _put(3, _put(1, name.encode()) + out + b"".join(_put(3, k.encode()) for k in keys) + vals + _put(5, extent) + _put(15, 2))
