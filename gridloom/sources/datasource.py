"""Rasters as a Spark data source whose filters on x and y reach the file: only chunks under the window are fetched and decoded.

    datasource.register(spark)
    spark.read.format("gridloom_raster").load(folder).where("x >= 512 and x < 768 and y < 256")

A folder's TIFF files (.tif) and coverage containers (.bit, with a .json sidecar) are read in
ranges; a large file is shared by several tasks, each with bands of rows of its own. Spark
applies the filters again, so they only ever save work. Filters are handed to the source
where spark.sql.python.filterPushdown.enabled is set, which register() does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from gridloom.runtime import ship_package

from . import containers, ranged, tiff

SHARE = 64 << 20  #: bytes of a file that one task reads, about
STEP = 1 << 20  #: cells that are decoded at once, about
SCHEMA = "path string, x int, y int, v int"
FAR = 2**31 - 1


@dataclass
class Band(InputPartition):
    """The part-th of `parts` bands of rows of a file."""

    path: str
    part: int
    parts: int


def _raster(path: str, data):
    """(width, height, rows of a chunk, window reader) of a file by its extension."""
    if path.endswith(".bit"):
        with ranged.Ranged(path[: -len(".bit")] + ".json") as side:
            c = containers.read_coverage(data, side[: len(side)])
        return c.width, c.height, c.tile, c.window
    h = tiff.read_header(data)
    return *h.size, h.chunk_size[1], lambda x, y, w, n: tiff.read_window(data, h, x, y, w, n)


class RasterReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path
        self.low, self.high = {"x": 0, "y": 0}, {"x": FAR, "y": FAR}

    def pushFilters(self, filters):  # noqa: N802  named by Spark
        """Notes what the filters say of x and y; Spark applies all of them again."""
        for f in filters:
            name = f.attribute[0] if getattr(f, "attribute", None) else None
            if name in self.low and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                    self.low[name] = max(self.low[name], f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThanOrEqual, LessThan)):
                    self.high[name] = min(self.high[name], f.value + (not isinstance(f, LessThan)))
            yield f

    def partitions(self):
        out = []
        for path, size in ranged.listed(self.path, (".tif", ".bit")):
            parts = max(1, -(-size // SHARE))
            out += [Band(path, k, parts) for k in range(parts)]
        return out

    def read(self, band: Band):
        with ranged.Ranged(band.path) as data:
            width, height, chunk, window = _raster(band.path, data)
            # bands begin where chunks do, so no chunk is decoded twice
            chunks = -(-height // chunk)
            y0, y1 = chunks * band.part // band.parts * chunk, min(height, chunks * (band.part + 1) // band.parts * chunk)
            y0, y1 = max(y0, self.low["y"]), min(y1, self.high["y"])
            x0, x1 = max(0, self.low["x"]), min(width, self.high["x"])
            while y0 < y1 and x0 < x1:
                # whole chunks at a time, as many as give about STEP cells
                rows = max(1, STEP // max(1, (x1 - x0) * chunk)) * chunk
                top = min(y1, (y0 // chunk) * chunk + rows)
                cells = window(x0, y0, x1 - x0, top - y0)
                cells = np.nan_to_num(cells, nan=0, posinf=0, neginf=0) if cells.dtype.kind == "f" else cells
                y, x = np.nonzero(cells)
                if len(x):
                    columns = [pa.array([band.path] * len(x)), pa.array((x + x0).astype(np.int32)), pa.array((y + y0).astype(np.int32)), pa.array(cells[y, x].astype(np.int32))]
                    yield pa.RecordBatch.from_arrays(columns, names=["path", "x", "y", "v"])
                y0 = top


class RasterSource(DataSource):
    """Non-zero cells (path, x, y, v) of rasters, samples cut to integers."""

    @classmethod
    def name(cls):
        return "gridloom_raster"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RasterReader(self.options["path"])


def register(spark: SparkSession) -> None:
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
