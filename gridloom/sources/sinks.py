"""Files from DataFrames: elevation tiles, mosaics as TIFF, visibility indexes, GeoJSON."""

from __future__ import annotations

import io
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import mosaic
from gridloom.runtime import ship_package

from . import containers, ranged, tiff


def elevation_tiles(cells: DataFrame, size: int, pixel_deg: float) -> DataFrame:
    """(tile, ul_lat, ul_lon, payload): one elevation tile file per tile; cells without a row are void.

    cells: tile, ul_lat, ul_lon, x, y, v. A tile is a bounded group of size * size cells.
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.full((size, size), -9999, np.int16)
        grid[pdf["y"], pdf["x"]] = pdf["v"]
        head = pdf.iloc[0]
        raw = containers.write_elevation(grid, float(head["ul_lat"]), float(head["ul_lon"]), pixel_deg)
        return pd.DataFrame({"tile": [head["tile"]], "ul_lat": [head["ul_lat"]], "ul_lon": [head["ul_lon"]], "payload": [raw]})

    ship_package(cells.sparkSession)
    kind = dict(cells.dtypes)["tile"]
    return cells.groupBy("tile").applyInPandas(build, f"tile {kind}, ul_lat double, ul_lon double, payload binary")


def compressed_tiles(cells: DataFrame, tile: int, bits: int) -> DataFrame:
    """(tx, ty, payload): Deflate tiles with horizontal differences; tiles of zeros only have no row."""
    dtype = np.uint16 if bits == 16 else np.uint8

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        import zlib

        grid = np.zeros((tile, tile), dtype)
        grid[pdf["y"] % tile, pdf["x"] % tile] = pdf["v"]
        raw = zlib.compress(np.diff(grid, axis=1, prepend=dtype(0)).tobytes())
        return pd.DataFrame({"tx": [pdf["x"].iloc[0] // tile], "ty": [pdf["y"].iloc[0] // tile], "payload": [raw]})

    at = lambda c: F.floor(F.col(c) / tile)
    keyed = cells.where("v <> 0").withColumns({"_tx": at("x"), "_ty": at("y")})
    return keyed.groupBy("_tx", "_ty").applyInPandas(build, "tx bigint, ty bigint, payload binary")


def mosaic_tiff(cells: DataFrame, width: int, height: int, tile: int, geotransform: list[float], factors: list[int], bits: int = 8) -> bytes:
    """A whole mosaic as the bytes of one TIFF file with overviews: only meant for files that fit the driver; write_mosaic() is for others."""
    out = io.BytesIO()
    write_mosaic(cells, out, width, height, tile, geotransform, factors, bits)
    return out.getvalue()


def write_mosaic(cells: DataFrame, out, width: int, height: int, tile: int, geotransform: list[float], factors: list[int], bits: int = 8) -> None:
    """A whole mosaic as one TIFF file with overviews, written to a seekable binary file.

    cells: x, y, v. Executors compress the tiles; the driver copies them to the file one
    partition at a time and keeps their places only.
    """
    w = tiff.TiledWriter(out, tile, geotransform, "0", scale=(1.0, -150.0))
    for f in (1, *factors):
        level = cells if f == 1 else mosaic.decimated(cells, f)
        tiles = compressed_tiles(level.select("x", "y", "v"), tile, bits)
        w.image(-(-width // f), -(-height // f), np.dtype(np.uint16 if bits == 16 else np.uint8), ((r["tx"], r["ty"], bytes(r["payload"])) for r in tiles.toLocalIterator()))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes (name, payload) rows as files of a folder, on the executors, and returns (name, bytes) once they are there.

    A file appears under its name when it is whole, so a task that is run again only
    writes it anew. The folder is made if it is not there.
    """
    spark = files.sparkSession
    ship_package(spark)

    def run(batches):
        system, place = ranged.opened(folder)
        system.create_dir(place, recursive=True)
        for pdf in batches:
            rows = []
            for name, payload in zip(pdf["name"], pdf["payload"], strict=True):
                if "/" in name or name in ("", ".", ".."):
                    raise ValueError(f"{name!r} is no file name")
                part = f"{place}/.{name}.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as f:
                    f.write(bytes(payload))
                system.move(part, f"{place}/{name}")
                rows.append((name, len(payload)))
            yield pd.DataFrame(rows, columns=["name", "bytes"])

    written = files.select("name", "payload").mapInPandas(run, "name string, bytes long")
    return spark.createDataFrame(written.collect(), "name string, bytes long")  # names and sizes only


def visibility_tiles(cells: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, offsets, ids): per tile the running offsets of its cells and the flat list of contributor ids.

    cells: x, y and ids (array, in input order).
    """

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        cell = (pdf["y"] % tile * tile + pdf["x"] % tile).to_numpy()
        order = np.argsort(cell)
        n = np.zeros(tile * tile, np.int64)
        n[cell] = pdf["ids"].map(len)
        flat = np.concatenate([np.asarray(v, np.int64) for v in pdf["ids"].iloc[order]]) if len(pdf) else []
        return pd.DataFrame({"tx": [pdf["x"].iloc[0] // tile], "ty": [pdf["y"].iloc[0] // tile], "offsets": [np.concatenate([[0], np.cumsum(n)])], "ids": [flat]})

    at = lambda c: F.floor(F.col(c) / tile)
    return cells.withColumns({"_tx": at("x"), "_ty": at("y")}).groupBy("_tx", "_ty").applyInPandas(build, "tx bigint, ty bigint, offsets array<bigint>, ids array<bigint>")


def geojson_feature(ext: Column, metres: Column) -> Column:
    """A closed polygon feature as text: coordinates with seven decimals, the height with one."""
    point = lambda p: F.format_string("[%.7f,%.7f]", p["lon"], p["lat"])
    ring = F.transform(F.concat(ext, F.array(F.element_at(ext, 1))), point)
    return F.concat(
        F.lit('{"type":"Feature","properties":{"height":'), F.format_string("%.1f", metres), F.lit('},"geometry":{"type":"Polygon","coordinates":[['), F.array_join(ring, ","), F.lit("]]}}")
    )
