"""Files read in ranges, on any file system that Arrow knows, so that a header or a window does not cost the whole file."""

from __future__ import annotations

import os

from pyarrow import fs

BLOCK = 1 << 16  #: bytes that are fetched at once for small reads
KEPT = 64  #: such blocks that are kept


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, place in it) of a path or URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))


def listed(path: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """(path, bytes) of the files of these endings under a folder, in byte order of their paths, or of the one file that the path names."""
    system, place = opened(path)
    info = system.get_file_info(place)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    every = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True))
    stem = path[: len(path) - len(place)] if path.endswith(place) else ""
    return sorted((stem + i.path, i.size) for i in every if i.type == fs.FileType.File and i.path.endswith(endings))


class Ranged:
    """The bytes of a file as slices; what is asked for is fetched, small pieces a block at a time."""

    def __init__(self, path: str):
        system, place = opened(path)
        self._file = system.open_input_file(place)
        self._size = self._file.size()
        self._blocks: dict[int, bytes] = {}
        self.fetched = 0

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self._file.close()

    def __len__(self) -> int:
        return self._size

    def _read(self, at: int, n: int) -> bytes:
        self._file.seek(at)
        raw = self._file.read(n)
        self.fetched += len(raw)
        return raw

    def _block(self, k: int) -> bytes:
        if k not in self._blocks:
            if len(self._blocks) >= KEPT:
                self._blocks.pop(next(iter(self._blocks)))
            self._blocks[k] = self._read(k * BLOCK, BLOCK)
        return self._blocks[k]

    def __getitem__(self, where: slice) -> bytes:
        start, stop, step = where.indices(self._size)
        if step != 1:
            raise ValueError("slices only")
        if stop - start > BLOCK:
            return self._read(start, stop - start)
        out = b"".join(self._block(k) for k in range(start // BLOCK, -(-stop // BLOCK))) if stop > start else b""
        return out[start - start // BLOCK * BLOCK :][: max(0, stop - start)]
