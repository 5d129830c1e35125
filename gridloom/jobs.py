"""Whole jobs: mosaics of raster files, exports, tile plans, header probes and terrain tiles."""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.operators import mosaic, runs, terrain
from gridloom.runtime import ship_package
from gridloom.sources import containers, readers, sinks, tiff

META = "path string, error string, left double, top double, step_x double, step_y double, width bigint, height bigint"
MAX_TILES = 2_000_000  #: tiles of a plan; a box that needs more is a typing error


def _opened(path: str, content: bytes, sidecar: bytes | None):
    """(geotransform, size, band reader) of a coverage raster by its extension."""
    if path.endswith(".bit"):
        if sidecar is None:
            raise containers.FormatError("no sidecar")
        c = containers.read_coverage(content, sidecar)
        if c.bits == 16:
            raise containers.FormatError("16-bit coverage cannot be aggregated")
        return c.geotransform, (c.width, c.height), lambda y, n: c.window(0, y, c.width, n)
    h = tiff.read_header(content)
    if h.geotransform is None:
        raise tiff.TiffError("no georeference")
    _, scale, offset = tiff.sample_rules(h)
    return h.geotransform, h.size, lambda y, n: tiff.coverage_bytes(tiff.read_window(content, h, 0, y, h.size[0], n), scale or 1.0, offset or 0.0)


def qualified(spark: SparkSession, path: str) -> str:
    """A path as Spark's file sources name it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString()


def _inputs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, pos, content, sidecar) of the listed files that are there; a file that is listed twice counts where it stands first."""
    ship_package(spark)
    whole = [qualified(spark, p) for p in paths]
    order = spark.createDataFrame([(p, whole.index(p)) for p in dict.fromkeys(whole)], "path string, pos bigint")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(whole).select("path", "content")
    bits = [p[:-4] + ".json" for p in paths if p.endswith(".bit")]
    found = files.join(F.broadcast(order), "path")  # one row for each path that the caller listed
    if not bits:
        return found.withColumn("sidecar", F.lit(None).cast("binary"))
    stem = lambda c: F.regexp_replace(c, r"\.[^./]*$", "")
    side = spark.read.format("binaryFile").load(bits).select(stem("path").alias("stem"), F.col("content").alias("sidecar"))
    return found.withColumn("stem", stem("path")).join(side, "stem", "left").drop("stem")


def aggregate(spark: SparkSession, paths: list[str], tile: int = 512) -> dict[str, DataFrame]:
    """Mosaic of coverage rasters: `grid`, `cells` (x, y, max_raw, n_src), `sources` (x, y, ids), `skipped` (path, error).

    Ids are the waypoint numbers in the paths, by path, so a file that cannot be read shifts no other's id.
    """
    inputs = _inputs(spark, paths).withColumn("src", text.waypoint_id(F.col("path")))

    def meta(batches):
        for pdf in batches:
            rows = []
            for path, content, side in zip(pdf["path"], pdf["content"], pdf["sidecar"], strict=True):
                try:
                    gt, (w, h), _ = _opened(path, content, side)
                    rows.append((path, None, gt[0], gt[3], gt[1], gt[5], w, h))
                except Exception as e:  # noqa: BLE001  a bad file is skipped and named
                    rows.append((path, f"{type(e).__name__}: {e}", *[None] * 6))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in META.split(", ")]).astype({"width": "Int64", "height": "Int64"})

    def cells(batches):
        for pdf in batches:
            for path, pos, content, side in zip(pdf["path"], pdf["pos"], pdf["content"], pdf["sidecar"], strict=True):
                try:
                    _, (w, h), band = _opened(path, content, side)
                except Exception:  # noqa: BLE001, S112  named by meta()
                    continue
                rows = max(1, readers.STEP // max(1, w))
                for y0 in range(0, h, rows):
                    part = band(y0, min(rows, h - y0))
                    y, x = np.nonzero(part)
                    yield pd.DataFrame({"pos": pos, "x": x.astype(np.int64), "y": (y + y0).astype(np.int64), "raw": part[y, x].astype(np.int32)})

    slim = inputs.select("path", "pos", "content", "sidecar")
    headers = slim.mapInPandas(meta, META).join(inputs.select("path", "pos", "src"), "path").cache()
    good = headers.where("error is null")
    grid = mosaic.master_grid(good)
    placed = mosaic.on_master_grid(slim.mapInPandas(cells, "pos bigint, x bigint, y bigint, raw int"), good, grid)
    return {"grid": grid, "cells": mosaic.max_and_count(placed), "sources": mosaic.contributors(placed), "skipped": headers.where("error is not null").select("path", "error")}


def mosaic_files(result: dict[str, DataFrame], tile: int = 512) -> dict[str, bytes]:
    """The mosaic as files: maximum and count as TIFF with overviews, and the visibility index."""
    g = result["grid"].first()
    gt = [g["left"], g["step_x"], 0.0, g["top"], 0.0, g["step_y"]]
    factors = mosaic.overview_levels(g["width"], g["height"])
    file = lambda c, bits: sinks.mosaic_tiff(result["cells"].withColumn("v", F.col(c)), g["width"], g["height"], tile, gt, factors, bits)
    tiles = {(r["tx"], r["ty"]): (r["offsets"], r["ids"]) for r in sinks.visibility_tiles(result["sources"], tile).collect()}
    return {"max.tif": file("max_raw", 8), "count.tif": file("n_src", 16), "index.vix": containers.write_visibility(tiles, tile, g["width"], g["height"], gt)}


def write_mosaic_files(result: dict[str, DataFrame], folder: str, tile: int = 512) -> None:
    """max.tif and count.tif of the mosaic in a local folder. Executors compress the tiles, and the driver holds a partition of them at a time."""
    g = result["grid"].first()
    gt = [g["left"], g["step_x"], 0.0, g["top"], 0.0, g["step_y"]]
    for name, column, bits in (("max.tif", "max_raw", 8), ("count.tif", "n_src", 16)):
        with open(os.path.join(folder, name), "wb") as f:
            sinks.write_mosaic(result["cells"].withColumn("v", F.col(column)), f, g["width"], g["height"], tile, gt, mosaic.overview_levels(g["width"], g["height"]), bits)


def in_memory(files: DataFrame) -> dict[str, bytes]:
    """(name, payload) rows as a mapping, for callers that want no files."""
    return {r["name"]: bytes(r["payload"]) for r in files.select("name", "payload").collect()}


def burn_when_ready(cells: DataFrame, marker: str, wait_s: float, shapes, size: int) -> DataFrame:
    """cells with `burned`, of a batch whose buildings are still being written.

    The terrain is computed and kept while the marker is awaited; shapes() is called when
    it is there. An error if it does not come in time.
    """
    from gridloom.operators import vector
    from gridloom.streaming import gates

    held = cells.persist(StorageLevel.MEMORY_AND_DISK)
    held.count()
    gates.await_marker(cells.sparkSession, marker, wait_s)
    return vector.burn(held, shapes(), size)


def export(content: bytes, sidecar: bytes, tile: int = 512) -> bytes:
    """One coverage container as a TIFF with decimated overviews."""
    if tile % 16:
        raise ValueError("the tile size must be a multiple of 16")
    c = containers.read_coverage(content, sidecar)
    return _exported(c.window(0, 0, c.width, c.height), c.bits, c.geotransform, json.loads(sidecar), tile)


def export_flat(content: bytes, sidecar: bytes, tile: int = 512) -> bytes:
    """One flat buffer of 1 or 8 bits a cell as a TIFF with decimated overviews."""
    side = json.loads(sidecar)
    size, bits = side["dimensions"], 1 if side.get("output_format", "1BIT_LOS") == "1BIT_LOS" else 8
    return _exported(containers.flat_rows(content, size["width"], size["height"], bits), bits, side["geotransform"], side, tile)


def _exported(grid: np.ndarray, bits: int, geotransform: list[float], side: dict, tile: int) -> bytes:
    if tile % 16:
        raise ValueError("the tile size must be a multiple of 16")
    factors, f, width = [], 4, grid.shape[1]
    if width > 2048:
        while width // f > 256:
            factors.append(f)
            f *= 4
        factors.append(f)
    epsg = int(str(side.get("projection", "EPSG:4326")).rpartition(":")[2])
    nodata, scale = {1: ("0", None), 8: ("0", (1.0, -150.0)), 16: ("65535", (0.5, 0.0))}[bits]
    return tiff.write_tiled(grid, tile, geotransform, nodata, tuple(grid[::k, ::k] for k in factors), epsg=epsg, predictor=1, scale=scale)


def plan(spark: SparkSession, south: float, north: float, west: float, east: float, resolutions: list[int]) -> dict:
    """The tile plan of a box as a document; an error names what is wrong with the box."""
    if not all(map(np.isfinite, (south, north, west, east))):
        raise ValueError("coordinates must be finite")
    if south >= north or west >= east:
        raise ValueError("south must be below north and west before east; a box over the antimeridian must be split")
    if west < -180 or east > 180 or south < -90 or north > 90:
        raise ValueError("the box leaves the map")
    if not resolutions or min(resolutions) <= 0:
        raise ValueError("resolutions must be positive")
    box = spark.createDataFrame([(0, south, north, west, east)], "id int, south double, north double, west double, east double")
    tiles = runs.plan_tiles(box, resolutions).drop("id")
    if tiles.count() > MAX_TILES:
        raise ValueError(f"the box needs more than {MAX_TILES} tiles; shrink it or use coarser resolutions")
    listed = [r.asDict() for r in tiles.orderBy("resolution_m", "ul_lat", "ul_lon").collect()]
    return {"tile_count": len(listed), "total_bytes": sum(t["est_bytes"] for t in listed), "tiles": listed}


def probe(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Header facts of the listed TIFF files in list order; files that are not there have a row, too."""
    ship_package(spark)
    order = spark.createDataFrame([(p, i) for i, p in enumerate(paths)], "path string, pos bigint")
    files = spark.read.format("binaryFile").option("ignoreMissingFiles", "true").load(paths)
    facts = readers.probe(files.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), "content"))
    gone = F.when(F.col("ok").isNull(), "not found").otherwise(F.col("reason"))
    return order.join(facts, "path", "left").withColumn("reason", gone).withColumn("ok", F.coalesce("ok", F.lit(False))).orderBy("pos").drop("pos")


def ingest(samples: DataFrame, size: int, pixel_deg: float) -> DataFrame:
    """Elevation tile files from prioritised samples: first valid source of each cell, void elsewhere.

    samples: tile, ul_lat, ul_lon, x, y, priority, v (half metres, one per source and cell).
    """
    best = terrain.overlay(samples, "tile", "ul_lat", "ul_lon", "x", "y")
    return sinks.elevation_tiles(best, size, pixel_deg)
