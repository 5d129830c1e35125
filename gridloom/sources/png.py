"""8-bit PNG images of elevation: decode to RGB, encode RGB."""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


class PngError(ValueError):
    pass


def decode(data: bytes) -> np.ndarray:
    """A height x width x channels array; only 8-bit, non-interlaced images without a palette."""
    if data[:4] == b"RIFF":
        raise PngError("WebP is not supported")
    if data[:8] != MAGIC:
        raise PngError("not a PNG image")
    at, body, head = 8, bytearray(), None
    while at + 8 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        chunk = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
        at += 12 + n
    if head is None:
        raise PngError("no header")
    width, height, depth, colour, _, _, interlace = head
    if depth != 8 or colour not in CHANNELS or interlace:
        raise PngError("only 8-bit, non-interlaced images without a palette")
    bpp = CHANNELS[colour]
    rows = np.frombuffer(zlib.decompress(bytes(body)), np.uint8).reshape(height, 1 + width * bpp)
    out = np.zeros((height, width * bpp), np.uint8)
    above = np.zeros(width * bpp, np.uint8)
    for y in range(height):
        above = out[y] = _unfilter(rows[y, 0], rows[y, 1:], above, bpp)
    return out.reshape(height, width, bpp)


def _unfilter(kind: int, row: np.ndarray, above: np.ndarray, bpp: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
    if kind == 2:
        return row + above
    out = np.zeros(len(row), np.int64)
    src, up = row.astype(np.int64), above.astype(np.int64)
    for i in range(len(row)):
        left, corner = (out[i - bpp], up[i - bpp]) if i >= bpp else (0, 0)
        if kind == 3:
            guess = (left + up[i]) // 2
        else:
            p = left + up[i] - corner
            guess = min(((abs(p - left), 0, left), (abs(p - up[i]), 1, up[i]), (abs(p - corner), 2, corner)))[2]
        out[i] = (src[i] + guess) & 255
    return out.astype(np.uint8)


def encode(rgb: np.ndarray) -> bytes:
    """An RGB image with unfiltered rows."""
    height, width, _ = rgb.shape
    raw = np.concatenate([np.zeros((height, 1), np.uint8), rgb.reshape(height, width * 3).astype(np.uint8)], axis=1).tobytes()

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def metres(rgb: np.ndarray, code: str) -> np.ndarray:
    """Single-precision metres of a decoded image by the `terrarium` or `mapbox` code, in the codes' own order of operations."""
    r, g, b = (rgb[..., i].astype(np.float32) for i in range(3))
    f = np.float32
    if code == "terrarium":
        return (r * f(256) + g + b / f(256)) - f(32768)
    if code == "mapbox":
        return f(-10000) + (r * f(6553.6) + g * f(25.6) + b * f(0.1))
    raise PngError(f"unknown code {code}")
