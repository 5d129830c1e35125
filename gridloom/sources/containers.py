"""Coverage containers, elevation tiles and visibility indexes: byte layouts in numpy."""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass

import numpy as np

# Fixed values of the formats.
COVERAGE_MAGIC = b"ATIL"
ELEVATION_MAGIC = b"AETH"
INDEX_MAGIC = b"VIX!"
ELEVATION_HEADER = struct.Struct("<4sHHddddhH")
COVERAGE_ENTRY = np.dtype([("tx", "<u4"), ("ty", "<u4"), ("offset", "<u8"), ("size", "<u4")])


class FormatError(ValueError):
    """Bytes that do not follow their format; the message says where."""


@dataclass
class Coverage:
    """A tiled coverage container with what its sidecar says. bits: 1, 8 or 16 a cell."""

    data: bytes
    width: int
    height: int
    tile: int
    bits: int
    geotransform: list[float]
    index: dict

    def cells(self, tx: int, ty: int) -> np.ndarray:
        """One tile as tile x tile cells; an absent tile is all zeros (void for 16 bits)."""
        t = self.tile
        if (tx, ty) not in self.index:
            return np.full((t, t), 0xFFFF if self.bits == 16 else 0, np.uint16 if self.bits == 16 else np.uint8)
        offset, size = self.index[tx, ty]
        return unpack_tile(self.data[offset : offset + size], t, self.bits)

    def window(self, x: int, y: int, width: int, height: int) -> np.ndarray:
        """A window; only the tiles under it are touched, and what lies outside the raster is zero."""
        out = np.zeros((height, width), np.uint16 if self.bits == 16 else np.uint8)
        t, right, low = self.tile, min(x + width, self.width), min(y + height, self.height)
        for ty in range(y // t, -(-low // t)):
            for tx in range(x // t, -(-right // t)):
                x0, x1, y0, y1 = max(x, tx * t), min(right, (tx + 1) * t), max(y, ty * t), min(low, (ty + 1) * t)
                if x0 < x1 and y0 < y1:
                    out[y0 - y : y1 - y, x0 - x : x1 - x] = self.cells(tx, ty)[y0 - ty * t : y1 - ty * t, x0 - tx * t : x1 - tx * t]
        return out


def unpack_tile(raw: bytes, tile: int, bits: int) -> np.ndarray:
    """Cells of a tile's bytes; missing bytes are zeros. One-bit rows are byte-aligned, first cell in the highest bit."""
    if bits == 16:
        return np.frombuffer(raw.ljust(tile * tile * 2, b"\0")[: tile * tile * 2], "<u2").reshape(tile, tile)
    if bits == 8:
        return np.frombuffer(raw.ljust(tile * tile, b"\0")[: tile * tile], np.uint8).reshape(tile, tile)
    row = -(-tile // 8)
    packed = np.frombuffer(raw.ljust(tile * row, b"\0")[: tile * row], np.uint8).reshape(tile, row)
    return np.unpackbits(packed, axis=1)[:, :tile]


def pack_tile(cells: np.ndarray, bits: int) -> bytes:
    if bits == 1:
        return np.packbits(cells != 0, axis=1).tobytes()
    return cells.astype("<u2" if bits == 16 else np.uint8).tobytes()


def read_coverage(data, sidecar: str | bytes) -> Coverage:
    """A container by its trailing index and JSON sidecar. data: bytes, or a file read in ranges, of which only the index is fetched."""
    side = json.loads(sidecar)
    kind = side.get("output_format", "1BIT_LOS")
    bits = 1 if kind == "1BIT_LOS" else 16 if kind.startswith("16BIT") else 8
    if len(data) < 24 or data[-8:-4] != COVERAGE_MAGIC:
        raise FormatError("no index at the end of the container")
    at, count = struct.unpack("<QQ", data[len(data) - 24 : len(data) - 8])
    count = max(0, min(count, (len(data) - 24 - at) // COVERAGE_ENTRY.itemsize))
    entries = np.frombuffer(data[at : at + count * COVERAGE_ENTRY.itemsize], COVERAGE_ENTRY, count) if count else np.zeros(0, COVERAGE_ENTRY)
    index = {(int(e["tx"]), int(e["ty"])): (int(e["offset"]), int(e["size"])) for e in entries if e["offset"] + e["size"] <= len(data)}
    size = side["dimensions"]
    return Coverage(data, size["width"], size["height"], side.get("tile_size") or 512, bits, side["geotransform"], index)


def write_coverage(cells: np.ndarray, tile: int, bits: int) -> bytes:
    """A container of a whole raster; tiles without coverage are left out."""
    out, entries = bytearray(), []
    h, w = cells.shape
    for ty in range(-(-h // tile)):
        for tx in range(-(-w // tile)):
            full = np.zeros((tile, tile), cells.dtype)
            part = cells[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            full[: part.shape[0], : part.shape[1]] = part
            if full.any():
                raw = pack_tile(full, bits)
                entries.append((tx, ty, len(out), len(raw)))
                out += raw
    at = len(out)
    return bytes(out) + np.array(entries, COVERAGE_ENTRY).tobytes() + struct.pack("<QQ4s4x", at, len(entries), COVERAGE_MAGIC)


def flat_rows(data: bytes, width: int, height: int, bits: int) -> np.ndarray:
    """Cells of a flat buffer; one-bit rows are padded to 32 bits."""
    if bits == 1:
        stride = (width + 31) // 32 * 4
        packed = np.frombuffer(data, np.uint8, stride * height).reshape(height, stride)
        return np.unpackbits(packed, axis=1)[:, :width]
    return np.frombuffer(data, np.uint8, width * height).reshape(height, width)


@dataclass
class ElevationTile:
    size: int
    ul_lat: float
    ul_lon: float
    pixel_deg: float
    base: int
    cells: np.ndarray


def read_elevation(data: bytes) -> ElevationTile:
    """A version-1 elevation tile. A scale of 0.005 degrees or more is the span of the whole tile."""
    if len(data) < ELEVATION_HEADER.size or data[:4] != ELEVATION_MAGIC:
        raise FormatError("shorter than its header" if data[:4] == ELEVATION_MAGIC else "not an elevation tile")
    _, version, size, lat, lon, _, scale, base, stride = ELEVATION_HEADER.unpack_from(data)
    if version != 1:
        raise FormatError(f"version {version} cannot be read")
    if not size or stride < 2 * size:
        raise FormatError(f"size {size} with row stride {stride}")
    pixel = scale if scale < 0.005 else scale / size
    if not pixel > 0 or not np.isfinite(pixel):
        raise FormatError(f"scale {scale}")
    if len(data) < ELEVATION_HEADER.size + stride * (size - 1) + 2 * size:
        raise FormatError("truncated rows")
    rows = np.frombuffer(data[ELEVATION_HEADER.size :].ljust(stride * size, b"\0"), np.uint8, stride * size).reshape(size, stride)
    return ElevationTile(size, lat, lon, pixel, base, np.ascontiguousarray(rows[:, : 2 * size]).view("<i2"))


def lenient_header(data: bytes) -> tuple[int, float, float, float, float, int] | None:
    """(size, ul_lat, ul_lon, step_y, step_x, row stride) of a buffer that is edited in place, whatever its magic and version say; None where it is too short."""
    if len(data) < ELEVATION_HEADER.size:
        return None
    _, _, size, lat, lon, dy, dx, _, stride = ELEVATION_HEADER.unpack_from(data)
    return size, lat, lon, dy, dx, stride


def edited(data: bytes, cells: dict[tuple[int, int], int]) -> bytes:
    """A tile's bytes with some samples (x, y) replaced; those outside the grid or the buffer are left out."""
    head = lenient_header(data)
    if head is None:
        return data
    out, (size, *_, stride) = bytearray(data), head
    for (x, y), v in cells.items():
        at = ELEVATION_HEADER.size + y * stride + 2 * x
        if 0 <= x < size and 0 <= y < size and at + 2 <= len(out):
            struct.pack_into("<h", out, at, v)
    return bytes(out)


def is_output_of(data: bytes, size: int, ul_lat: float, ul_lon: float, resolution_m: float) -> bool:
    """Whether a file is exactly what a full run writes for a tile: the same header and length."""
    stride, step = (2 * size + 255) // 256 * 256, resolution_m / 111111.0
    head = ELEVATION_HEADER.pack(ELEVATION_MAGIC, 1, size, ul_lat, ul_lon, step, step, 0, stride & 0xFFFF)
    return len(data) == len(head) + stride * size and data[: len(head)] == head


def write_elevation(cells: np.ndarray, ul_lat: float, ul_lon: float, pixel_deg: float) -> bytes:
    """A version-1 tile: rows padded to 256 bytes; the base is the lowest valid sample, 0 without any."""
    size = len(cells)
    stride = (2 * size + 255) // 256 * 256
    valid = cells[cells > -5000]
    rows = np.zeros((size, stride), np.uint8)
    rows[:, : 2 * size] = np.ascontiguousarray(cells.astype("<i2")).view(np.uint8).reshape(size, 2 * size)
    head = ELEVATION_HEADER.pack(ELEVATION_MAGIC, 1, size, ul_lat, ul_lon, pixel_deg, pixel_deg, int(valid.min()) if len(valid) else 0, stride & 0xFFFF)
    return head + rows.tobytes()


def write_visibility(tiles: dict, tile: int, width: int, height: int, geotransform: list[float]) -> bytes:
    """A visibility index: per tile zlib chunks of cell offsets and source ids, then a JSON directory and a trailer.

    tiles: {(tx, ty): (offsets of tile * tile + 1, ids)}.
    """
    out, where = bytearray(), {}
    for (tx, ty), (offsets, ids) in sorted(tiles.items()):
        raw = zlib.compress(np.asarray(offsets, "<u4").tobytes() + np.asarray(ids, "<u2").tobytes())
        where[f"{tx},{ty}"] = {"offset": len(out), "size": len(raw)}
        out += raw
    meta = {"tile_size": tile, "master_width": width, "master_height": height, "geotransform": geotransform, "projection": "EPSG:4326"}
    at = len(out)
    return bytes(out) + json.dumps({"meta": meta, "tiles": where}).encode() + struct.pack("<Q4s", at, INDEX_MAGIC)


def read_visibility(data: bytes) -> tuple[dict, dict]:
    """(meta, tiles) as write_visibility() takes them."""
    if len(data) < 12 or data[-4:] != INDEX_MAGIC:
        raise FormatError("no visibility index")
    toc = json.loads(data[struct.unpack_from("<Q", data, len(data) - 12)[0] : -12])
    cells, tiles = toc["meta"]["tile_size"] ** 2, {}
    for name, w in toc["tiles"].items():
        raw = zlib.decompress(data[w["offset"] : w["offset"] + w["size"]])
        tiles[tuple(map(int, name.split(",")))] = np.frombuffer(raw, "<u4", cells + 1), np.frombuffer(raw, "<u2", offset=4 * (cells + 1))
    return toc["meta"], tiles
