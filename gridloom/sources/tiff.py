"""TIFF and BigTIFF: header facts, chunk decoding, and a tiled writer, in numpy and the standard library.

Supported codecs: none, LZW, Deflate, PackBits; predictors 1, 2 and 3; any byte order;
strips and tiles; one band. Other codecs are refused by name.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np

# Fixed values of the format: bytes and struct letter of each field type.
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
MAX_IFDS = 256
NAMES = {1: "none", 5: "lzw", 7: "jpeg", 8: "deflate", 32773: "packbits", 32946: "deflate", 50000: "zstd", 50001: "webp"}


class TiffError(ValueError):
    """A file that is not what a raster source may be; the message says why."""


@dataclass
class Header:
    """What a file's directories say; `tags` of the main image, `overviews` of its reduced ones."""

    order: str
    big: bool
    tags: dict
    overviews: int
    ifd_offset: int
    chunks: list = field(default_factory=list)

    def one(self, tag: int, default=None):
        v = self.tags.get(tag)
        return default if not v else v[0]

    @property
    def size(self) -> tuple[int, int]:
        return self.one(256), self.one(257)

    @property
    def chunk_size(self) -> tuple[int, int]:
        if 322 in self.tags:
            return self.one(322), self.one(323)
        return self.one(256), self.one(278, self.one(257))

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.one(258, 1), self.one(339, 1)
        if bits == 1:
            return np.dtype(np.uint8)
        letter = {1: "u", 2: "i", 3: "f"}.get(kind)
        if letter is None or bits not in (8, 16, 32, 64):
            raise TiffError(f"sample type {kind} with {bits} bits is not supported")
        return np.dtype(f"{self.order}{letter}{bits // 8}")

    @property
    def geotransform(self) -> list[float] | None:
        """Six-term affine of the raster's corner, from scale and tiepoint or a matrix; null without georeference."""
        if 34264 in self.tags:
            m = self.tags[34264]
            return [m[3], m[0], m[1], m[7], m[4], m[5]]
        scale, tie = self.tags.get(33550), self.tags.get(33922)
        if not scale or not tie:
            return None
        return [tie[3] - tie[0] * scale[0], scale[0], 0.0, tie[4] + tie[1] * scale[1], 0.0, -scale[1]]

    def text(self, tag: int) -> str | None:
        v = self.tags.get(tag)
        return v[0].split(b"\0")[0].decode("latin-1") if v else None


def _unpacked(data, form: str, at: int) -> tuple:
    """Values at a place of bytes, or of anything that gives bytes for a slice."""
    return struct.unpack(form, data[at : at + struct.calcsize(form)])


def read_header(data) -> Header:
    """Walks the directory chain. Raises TiffError for files that are no TIFF, truncated or looped.

    data: bytes, or a file read in ranges, of which only the directories are fetched.
    """
    if len(data) < 8 or data[:2] not in (b"II", b"MM"):
        raise TiffError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    version = _unpacked(data, f"{order}H", 2)[0]
    if version not in (42, 43):
        raise TiffError(f"TIFF version {version}")
    big = version == 43
    try:
        at = _unpacked(data, f"{order}Q", 8)[0] if big else _unpacked(data, f"{order}I", 4)[0]
        found, seen = [], set()
        while at:
            if at in seen or len(found) >= MAX_IFDS:
                raise TiffError("directories loop")
            seen.add(at)
            tags, following = _directory(data, at, order, big)
            found.append((at, tags))
            at = following
    except struct.error as e:
        raise TiffError("truncated directory") from e
    if not found:
        raise TiffError("no image")
    main = next((f for f in found if not (f[1].get(254, [0])[0] & 1)), found[0])
    return Header(order, big, main[1], sum(1 for f in found if f[1].get(254, [0])[0] & 1), main[0])


def _directory(data, at: int, order: str, big: bool) -> tuple[dict, int]:
    count = _unpacked(data, f"{order}{'Q' if big else 'H'}", at)[0]
    at += 8 if big else 2
    entry, inline, tags = (20, 8, {}) if big else (12, 4, {})
    if at + count * entry > len(data):
        raise TiffError("truncated directory")
    for _ in range(count):
        tag, kind = _unpacked(data, f"{order}HH", at)
        n = _unpacked(data, f"{order}{'Q' if big else 'I'}", at + 4)[0]
        letters = TYPES.get(kind)
        if letters:
            size = struct.calcsize(f"{order}{letters}") * n
            place = at + (12 if big else 8)
            if size > inline:
                place = _unpacked(data, f"{order}{'Q' if big else 'I'}", place)[0]
            if place + size > len(data):
                raise TiffError(f"tag {tag} lies outside the file")
            if kind == 2:
                tags[tag] = [data[place : place + n]]
            elif kind == 5:
                v = _unpacked(data, f"{order}{2 * n}I", place)
                tags[tag] = [a / b if b else 0.0 for a, b in zip(v[::2], v[1::2], strict=True)]
            else:
                tags[tag] = list(_unpacked(data, f"{order}{n}{letters}", place))
        at += entry
    return tags, _unpacked(data, f"{order}{'Q' if big else 'I'}", at)[0]


def lzw_decode(data: bytes) -> bytes:
    """TIFF LZW: codes of 9 to 12 bits, most significant bit first, widening one code early."""
    out, table = bytearray(), []
    width, bits, held, last = 9, 0, 0, b""
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == 257:
            break
        if code < len(table):
            entry = table[code]
        elif last and code == len(table):
            entry = last + last[:1]
        else:
            raise TiffError("bad LZW code")
        out += entry
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) > 510) + (len(table) > 1022) + (len(table) > 2046)
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i] - 256 if data[i] > 127 else data[i]
        if n >= 0:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            out += data[i + 1 : i + 2] * (1 - n if n != -128 else 0)
            i += 2
    return bytes(out)


def inflate(raw: bytes, code: int) -> bytes:
    if code == 1:
        return raw
    if code in (8, 32946):
        return zlib.decompress(raw)
    if code == 5:
        return lzw_decode(raw)
    if code == 32773:
        return packbits_decode(raw)
    raise TiffError(f"compression {NAMES.get(code, code)} is not supported")


def undo_predictor(rows: np.ndarray, predictor: int) -> np.ndarray:
    """Rows of samples, native order, after horizontal differencing (2) is undone with wrap-around."""
    if predictor == 2:
        unsigned = rows.view(f"u{rows.dtype.itemsize}")
        return np.cumsum(unsigned, axis=1, dtype=unsigned.dtype).view(rows.dtype)
    return rows


def undo_float_predictor(raw: bytes, width: int, height: int, size: int) -> np.ndarray:
    """The floating-point predictor: byte differences over byte planes, most significant plane first."""
    planes = np.cumsum(np.frombuffer(raw, np.uint8).reshape(height, width * size), axis=1, dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(height, size, width).transpose(0, 2, 1)).view(f">f{size}").reshape(height, width)


def coverage_bytes(cells: np.ndarray, scale: float = 1.0, offset: float = 0.0) -> np.ndarray:
    """Samples as coverage bytes: bytes as they are, 16-bit ones clamped to 0..255 as signed, floats unscaled and clamped, ground at or below -5000 and NaN as 0."""
    if cells.dtype.kind == "f":
        code = (cells.astype(np.float32) - np.float32(offset)) / np.float32(scale)
        return np.where(cells <= -5000, 0, np.clip(np.nan_to_num(code, nan=0.0), 0, 255)).astype(np.uint8)
    if cells.dtype.itemsize == 2:
        return np.clip(cells.view(np.int16), 0, 255).astype(np.uint8)
    return cells.astype(np.uint8) if cells.dtype.itemsize == 1 else np.zeros(cells.shape, np.uint8)


def decode_chunk(raw: bytes, width: int, height: int, dtype: np.dtype, code: int, predictor: int, bits: int = 0) -> np.ndarray:
    """One strip or tile as a height x width array in native byte order; bits: 1 for packed cells, first in the highest bit, rows on whole bytes."""
    data = inflate(raw, code)
    if bits == 1:
        row = -(-width // 8)
        if len(data) < row * height:
            raise TiffError(f"chunk has {len(data)} of {row * height} bytes")
        return np.unpackbits(np.frombuffer(data, np.uint8, row * height).reshape(height, row), axis=1)[:, :width]
    need = width * height * dtype.itemsize
    if len(data) < need:
        raise TiffError(f"chunk has {len(data)} of {need} bytes")
    if predictor == 3:
        return undo_float_predictor(data[:need], width, height, dtype.itemsize).astype(dtype.newbyteorder("="))
    rows = np.frombuffer(data[:need], dtype).reshape(height, width).astype(dtype.newbyteorder("="))
    return undo_predictor(rows, predictor)


def chunk_table(h: Header) -> list[tuple[int, int, int, int, int, int]]:
    """(x, y, width, height, offset, bytes) of every chunk; edge tiles keep their full size, the last strip is short."""
    w, height = h.size
    cw, ch = h.chunk_size
    tiled = 322 in h.tags
    offsets, sizes = (h.tags.get(324), h.tags.get(325)) if tiled else (h.tags.get(273), h.tags.get(279))
    if not offsets or not sizes:
        raise TiffError("no chunk offsets")
    across = -(-w // cw)
    out = []
    for i, (o, n) in enumerate(zip(offsets, sizes, strict=False)):
        y = i // across * ch
        out.append((i % across * cw, y, cw, ch if tiled else min(ch, height - y), o, n))
    return out


def georeference(h: Header) -> tuple[float, float, float, float, int | None]:
    """(west, north, step_x, step_y, EPSG code) of a terrain raster's corner; refuses what cannot be one."""
    if h.one(277, 1) != 1 or h.one(262, 1) not in (0, 1):
        raise TiffError("an image, not an elevation raster: elevation has one band")
    if h.one(259, 1) not in (1, 5, 8, 32773, 32946):
        raise TiffError(f"unsupported compression {h.one(259)} ({NAMES.get(h.one(259), 'unknown')})")
    matrix = h.tags.get(34264, [])
    gt = h.geotransform
    if len(matrix) == 16 and (matrix[1] or matrix[4]):
        raise TiffError(f"rotated or sheared grid: {matrix[1]:g} and {matrix[4]:g}; warp it to a north-up one")
    if gt is None or (len(matrix) != 16 and len(h.tags.get(33922, [])) < 6):
        raise TiffError("no geotransform; one is never made up from a file name")
    keys = h.tags.get(34735, [])
    said = {k: v for k, place, v in ((keys[i], keys[i + 1], keys[i + 3]) for i in range(4, len(keys) - 3, 4)) if place == 0}
    west, north, dx, dy = gt[0], gt[3], abs(gt[1]), abs(gt[5])
    if said.get(1025) == 2:  # the origin names the middle of the first pixel
        west, north = west - 0.5 * dx, north + 0.5 * dy
    code = said.get(3072, said.get(2048))
    return west, north, dx, dy, code if code not in (0, 32767) else None


def sample_rules(h: Header) -> tuple[float | None, float | None, float | None]:
    """(nodata, scale, offset) that a file's own texts give, null where they say nothing that is a number."""
    try:
        nodata = float((h.text(42113) or "").strip("\0 \t\r\n"))
    except ValueError:
        nodata = None
    xml, found = h.text(42112) or "", []
    for name in ("SCALE", "OFFSET"):
        said = re.search(rf'<Item name="{name}"(?![^>]*sample="[1-9])[^>]*>([^<]*)<', xml)
        found.append(float(said[1]) if said else None)
    return nodata, *found


def read_window(data, h: Header, x: int, y: int, width: int, height: int) -> np.ndarray:
    """A window of samples; only the chunks under it are decoded. Absent chunks (no bytes) are zeros."""
    if h.one(277, 1) != 1:
        raise TiffError(f"{h.one(277)} bands")
    out = np.zeros((height, width), h.dtype.newbyteorder("="))
    for cx, cy, cw, ch, offset, size in chunk_table(h):
        x0, x1, y0, y1 = max(x, cx), min(x + width, cx + cw, h.size[0]), max(y, cy), min(y + height, cy + ch, h.size[1])
        if x0 >= x1 or y0 >= y1 or not size:
            continue
        if offset + size > len(data):
            raise TiffError("truncated chunk")
        chunk = decode_chunk(data[offset : offset + size], cw, ch, h.dtype, h.one(259, 1), h.one(317, 1), h.one(258, 1))
        out[y0 - y : y1 - y, x0 - x : x1 - x] = chunk[y0 - cy : y1 - cy, x0 - cx : x1 - cx]
    return out


class TiledWriter:
    """Writes a tiled, Deflate-compressed TIFF to a seekable file, image by image: the first is the raster, the others its overviews."""

    def __init__(self, out, tile: int, geotransform: list[float], nodata: str, epsg: int = 4326, big: bool = True, predictor: int = 2, scale: tuple | None = None):
        self.out, self.tile, self.big, self.predictor, self.images = out, tile, big, predictor, 0
        self.at = self.link = 0
        self._put(b"II" + (struct.pack("<HHHQ", 43, 8, 0, 0) if big else struct.pack("<HI", 42, 0)))
        self.link = 8 if big else 4
        model, key = (2, 2048) if 4000 <= epsg <= 4999 else (1, 3072)
        self.first = {
            33550: (12, [geotransform[1], -geotransform[5], 0.0]), 33922: (12, [0.0, 0.0, 0.0, geotransform[0], geotransform[3], 0.0]),
            34735: (3, [1, 1, 0, 3, 1024, 0, 1, model, 1025, 0, 1, 1, key, 0, 1, epsg]), 42113: (2, nodata.encode() + b"\0"),
        }
        if scale:
            items = "".join(f'<Item name="{n}" sample="0" role="{n.lower()}">{v:g}</Item>' for n, v in zip(("SCALE", "OFFSET"), scale, strict=True))
            self.first[42112] = (2, f"<GDALMetadata>{items}</GDALMetadata>".encode() + b"\0")

    def _put(self, raw: bytes) -> int:
        """Appends bytes and says where they are."""
        place = self.at
        self.out.write(raw)
        self.at += len(raw)
        return place

    def image(self, width: int, height: int, dtype: np.dtype, tiles) -> None:
        """tiles: (tx, ty, compressed bytes) of the tiles that are not empty, in any order."""
        across, down = -(-width // self.tile), -(-height // self.tile)
        offsets, sizes = [0] * (across * down), [0] * (across * down)
        for tx, ty, raw in tiles:
            offsets[ty * across + tx], sizes[ty * across + tx] = self._put(raw), len(raw)
        t, far = self.tile, 16 if self.big else 4
        tags = {
            254: (4, [1 if self.images else 0]), 256: (4, [width]), 257: (4, [height]), 258: (3, [dtype.itemsize * 8]), 259: (3, [8]), 262: (3, [1]), 277: (3, [1]),
            317: (3, [self.predictor]), 322: (4, [t]), 323: (4, [t]), 324: (far, offsets), 325: (far, sizes), 339: (3, [{"u": 1, "i": 2, "f": 3}[dtype.kind]]),
        }
        tags |= {} if self.images else self.first
        at = self.at
        raw, ifd = _directory_bytes(tags, self.big, at)
        self._put(raw)
        self.out.seek(self.link)
        self.out.write(struct.pack("<Q" if self.big else "<I", ifd))
        self.out.seek(self.at)
        self.link = self.at - (8 if self.big else 4)
        self.images += 1


def _tiles_of(image: np.ndarray, tile: int, level: int, predictor: int):
    for ty in range(-(-image.shape[0] // tile)):
        for tx in range(-(-image.shape[1] // tile)):
            full = np.zeros((tile, tile), image.dtype)
            part = image[ty * tile : (ty + 1) * tile, tx * tile : (tx + 1) * tile]
            full[: part.shape[0], : part.shape[1]] = part
            if full.any():
                full = np.diff(full, axis=1, prepend=full.dtype.type(0)) if predictor == 2 else full
                yield tx, ty, zlib.compress(full.astype(full.dtype.newbyteorder("<")).tobytes(), level)


def write_tiled(array: np.ndarray, tile: int, geotransform: list[float], nodata: str, overviews: tuple = (), epsg: int = 4326, big: bool = True, level: int = 6, predictor: int = 2, scale: tuple | None = None) -> bytes:
    """A tiled, Deflate-compressed TIFF with an overview chain; tiles of zeros only are absent."""
    out = io.BytesIO()
    w = TiledWriter(out, tile, geotransform, nodata, epsg, big, predictor, scale)
    for image in (array, *overviews):
        w.image(image.shape[1], image.shape[0], image.dtype, _tiles_of(image, tile, level, predictor))
    return out.getvalue()


def _directory_bytes(tags: dict, big: bool, at: int) -> tuple[bytes, int]:
    """(bytes, place of the directory in the file) of values that do not fit, then the directory with its tags in order, from place `at` on."""
    out, entries = bytearray(), []
    for tag in sorted(tags):
        kind, values = tags[tag]
        raw = values if kind == 2 else struct.pack(f"<{len(values)}{TYPES[kind]}", *values)
        count, room = len(values), 8 if big else 4
        if len(raw) > room:
            place = at + len(out)
            out += raw
            raw = struct.pack("<Q" if big else "<I", place)
        entries.append(struct.pack(f"<HH{'Q' if big else 'I'}", tag, kind, count) + raw.ljust(room, b"\0"))
    ifd = at + len(out)
    out += struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + struct.pack("<Q" if big else "<I", 0)
    return bytes(out), ifd
