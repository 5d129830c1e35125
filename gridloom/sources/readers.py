"""Raster and vector files as DataFrames.

Files are found and read by Spark's binaryFile source, so any file system it knows will
do; decoding runs in Arrow batches, file by file. A file that cannot be decoded becomes
a row with `error` set rather than a failed job.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import text
from gridloom.runtime import ship_package

from . import containers, flatgeobuf, mvt, png, ranged, tiff

CELLS = "path string, error string, x int, y int, v int"
FACTS = (
    "path string, ok boolean, reason string, width bigint, height bigint, bands bigint, dtype string, compression string, predictor bigint, tiled boolean, "
    "tile_w bigint, tile_h bigint, epsg bigint, geotransform array<double>, rotated boolean, nodata string, overviews bigint, ifd_offset bigint, last_chunk_end bigint"
)
STEP = 1 << 20  #: cells a batch of output holds at most, about


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    ship_package(spark)
    reader = spark.read.format("binaryFile")
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def _cell_frames(path: str, cells: np.ndarray, x0: int = 0, y0: int = 0):
    """Non-zero cells of an array, in frames of bounded size."""
    rows = max(1, STEP // max(1, cells.shape[1]))
    for top in range(0, len(cells), rows):
        y, x = np.nonzero(cells[top : top + rows])
        yield pd.DataFrame({"path": path, "error": None, "x": (x + x0).astype(np.int32), "y": (y + top + y0).astype(np.int32), "v": cells[top : top + rows][y, x].astype(np.int32)})


def _failed(path: str, e: Exception) -> pd.DataFrame:
    return pd.DataFrame({"path": [path], "error": [f"{type(e).__name__}: {e}"], "x": [None], "y": [None], "v": [None]}).astype({"x": "Int32", "y": "Int32", "v": "Int32"})


def coverage_cells(spark: SparkSession, path: str) -> DataFrame:
    """Covered cells of all coverage containers (*.bit) under a path, with the JSON sidecar of the same stem."""
    stem = F.regexp_replace("path", r"\.[^./]*$", "")
    data = files(spark, path, "*.bit").select("path", "content", stem.alias("stem"))
    side = files(spark, path, "*.json").select(F.col("content").alias("sidecar"), stem.alias("stem"))

    def run(batches):
        for pdf in batches:
            for p, content, sidecar in zip(pdf["path"], pdf["content"], pdf["sidecar"], strict=True):
                try:
                    if sidecar is None:
                        raise containers.FormatError("no sidecar")
                    c = containers.read_coverage(content, sidecar)
                    for tx, ty in sorted(c.index):
                        w, h = min(c.tile, c.width - tx * c.tile), min(c.tile, c.height - ty * c.tile)
                        yield from _cell_frames(p, c.cells(tx, ty)[:h, :w], tx * c.tile, ty * c.tile)
                except Exception as e:  # noqa: BLE001  a bad file is a row
                    yield _failed(p, e)

    return data.join(side, "stem", "left").select("path", "content", "sidecar").mapInPandas(run, CELLS)


def tiff_cells(spark: SparkSession, path: str) -> DataFrame:
    """Non-zero samples, cut to integers, of all TIFF files under a path, a band of rows at a time."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    h = tiff.read_header(content)
                    w, height = h.size
                    rows = max(1, STEP // max(1, w))
                    for y in range(0, height, rows):
                        band = tiff.read_window(content, h, 0, y, w, min(rows, height - y))
                        band = np.nan_to_num(band, nan=0, posinf=0, neginf=0) if band.dtype.kind == "f" else band
                        yield from _cell_frames(p, band, 0, y)
                except Exception as e:  # noqa: BLE001
                    yield _failed(p, e)

    return files(spark, path, "*.tif").select("path", "content").mapInPandas(run, CELLS)


def raster_cells(spark: SparkSession, path: str) -> DataFrame:
    """Non-zero cells of all rasters under a path, opened by what their names end in: .tif, else .bit with its sidecar."""
    return tiff_cells(spark, path).unionByName(coverage_cells(spark, path))


def elevation_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every half-metre sample of all elevation tiles (*.abt) under a path."""

    def run(batches):
        for pdf in batches:
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    t = containers.read_elevation(content)
                    y, x = np.divmod(np.arange(t.size * t.size, dtype=np.int32), t.size)
                    for lo in range(0, len(x), STEP):
                        s = slice(lo, lo + STEP)
                        yield pd.DataFrame({"path": p, "error": None, "x": x[s], "y": y[s], "v": t.cells.ravel()[s].astype(np.int32)})
                except Exception as e:  # noqa: BLE001
                    yield _failed(p, e)

    return files(spark, path, "*.abt").select("path", "content").mapInPandas(run, CELLS)


def rgb_tiles(images: DataFrame, code: str) -> DataFrame:
    """(z, x, y, edge, data, error): metres of each RGB elevation image. images: z, x, y, content."""

    def run(batches):
        for pdf in batches:
            rows = []
            for z, x, y, content in zip(pdf["z"], pdf["x"], pdf["y"], pdf["content"], strict=True):
                try:
                    rgb = png.decode(content)
                    if rgb.shape[0] != rgb.shape[1] or rgb.shape[2] < 3:
                        raise png.PngError("XYZ tile geometry")
                    rows.append((z, x, y, len(rgb), png.metres(rgb, code).ravel(), None))
                except Exception as e:  # noqa: BLE001
                    rows.append((z, x, y, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["z", "x", "y", "edge", "data", "error"]).astype({"edge": "Int32"})

    ship_package(images.sparkSession)
    return images.select("z", "x", "y", "content").mapInPandas(run, "z int, x int, y int, edge int, data array<float>, error string")


def building_rows(tiles: DataFrame, *also: str) -> DataFrame:
    """(z, x, y, pos, ext, holes, tags, error) of the buildings of vector tiles, after the text columns named in also. tiles: z, x, y, content."""
    point = "array<struct<lon:double,lat:double>>"

    def run(batches):
        for pdf in batches:
            rows = []
            own = [pdf[c] for c in (*also, "z", "x", "y")]
            for *key, content in zip(*own, pdf["content"], strict=True):
                try:
                    for pos, (tags, line, holes) in enumerate(mvt.buildings(content, *key[-3:])):
                        pts = lambda ps: [{"lon": a, "lat": b} for a, b in ps]
                        said = {k: str(v[0]) for k, v in tags.items()}
                        rows.append((*key, pos, pts(line), [pts(h) for h in holes], said, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((*key, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[*also, "z", "x", "y", "pos", "ext", "holes", "tags", "error"]).astype({"pos": "Int64"})

    ship_package(tiles.sparkSession)
    kind = "".join(f"{c} string, " for c in also) + f"z int, x int, y int, pos bigint, ext {point}, holes array<{point}>, tags map<string,string>, error string"
    return tiles.select(*also, "z", "x", "y", "content").mapInPandas(run, kind)


def flatgeobuf_rows(spark: SparkSession, path: str, box: tuple | None = None) -> DataFrame:
    """(path, pos, ext, holes, top, tags, error) of the polygons of all FlatGeobuf files under a path, in file order.

    box (west, south, east, north) goes down to each file's spatial index.
    """
    point = "array<struct<lon:double,lat:double>>"

    def run(batches):
        pts = lambda ps: [{"lon": a, "lat": b} for a, b in ps]
        for pdf in batches:
            rows = []
            for p, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    for pos, (tags, ring, holes, top) in enumerate(flatgeobuf.read(content, box)):
                        rows.append((p, pos, pts(ring), [pts(h) for h in holes], top, {k: str(v) for k, v in tags.items()}, None))
                except Exception as e:  # noqa: BLE001
                    rows.append((p, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "pos", "ext", "holes", "top", "tags", "error"]).astype({"pos": "Int64", "top": "Float64"})

    found = files(spark, path, "*.fgb").select("path", "content")
    return found.mapInPandas(run, f"path string, pos bigint, ext {point}, holes array<{point}>, top double, tags map<string,string>, error string")


def header_facts(data: bytes) -> dict:
    """Facts of one TIFF header, or the reason there are none; samples are not read."""
    try:
        h = tiff.read_header(data)
        w, height = h.size
        gt = h.geotransform
        keys = h.tags.get(34735, [])
        codes = {k: v for k, place, v in ((keys[i], keys[i + 1], keys[i + 3]) for i in range(4, len(keys) - 3, 4)) if place == 0}
        epsg = codes.get(3072, codes.get(2048))
        bits, kind = h.one(258, 1), h.one(339, 1)
        ends = [o + n for *_, o, n in tiff.chunk_table(h)]
        return {
            "ok": True, "reason": None, "width": w, "height": height, "bands": h.one(277, 1), "dtype": f"{ {1: 'uint', 2: 'int', 3: 'float'}.get(kind, 'unknown')}{bits}",
            "compression": tiff.NAMES.get(h.one(259, 1), f"unknown-{h.one(259, 1)}"), "predictor": h.one(317, 1), "tiled": 322 in h.tags, "tile_w": h.chunk_size[0],
            "tile_h": h.chunk_size[1], "epsg": epsg if epsg not in (0, 32767) else None, "geotransform": gt, "rotated": bool(gt and (gt[2] or gt[4])),
            "nodata": (h.text(42113) or "").strip() or None, "overviews": h.overviews, "ifd_offset": h.ifd_offset, "last_chunk_end": max(ends, default=0),
        }
    except (tiff.TiffError, TypeError) as e:
        return {"ok": False, "reason": str(e)}


def probe(rasters: DataFrame) -> DataFrame:
    """Header facts of each raster, one row a file whatever it holds. rasters: path, content."""
    names = [f.split()[0] for f in FACTS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = [{"path": p, **header_facts(bytes(c))} for p, c in zip(pdf["path"], pdf["content"], strict=True)]
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
            whole = [n for n, t in (f.split() for f in FACTS.split(", ")) if t == "bigint"]
            yield out.astype({n: "Int64" for n in whole})

    ship_package(rasters.sparkSession)
    return rasters.select("path", "content").mapInPandas(run, FACTS)


def path_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, entry): the lines of a text list in order, repeats and all; only a byte-order mark, line ends and blank lines go."""
    line = F.explode(F.zip_with(lines := F.split(F.regexp_replace("value", "^\ufeff", ""), "\r?\n"), F.sequence(F.lit(0), F.size(lines) - 1), lambda t, i: F.struct(i.cast("bigint").alias("pos"), t.alias("entry"))))
    found = spark.read.text(path, wholetext=True).select(line.alias("l")).select("l.*")
    return found.where("trim(entry) <> ''").orderBy("pos")


def tile_list(spark: SparkSession, path: str) -> DataFrame:
    """(name, z, x, y): the distinct tile names of a list, in byte order; blank lines and # comments go.

    A name with a directory part, or one that is no {z}_{x}_{y}.pbf or .mvt, is an error that names the line.
    """
    named = path_list(spark, path).select((F.col("pos") + 1).alias("line"), F.trim(F.regexp_replace("entry", "[\\s]+$", "")).alias("name")).where("name <> '' and not startswith(name, '#')")
    key = text.tile_key_of_name(F.col("name"))
    checked = named.select("line", "name", key.alias("k"))
    bad = checked.where(F.col("k.z").isNull() | F.col("name").rlike(r"[/\\]")).orderBy("line").first()
    if bad is not None:
        raise ValueError(f"{path}: line {bad['line']}: {bad['name']!r} is not the name of a tile in the folder, {{z}}_{{x}}_{{y}}.pbf")
    return checked.select("name", "k.*").distinct().orderBy("name")


def _building_files(files_there: DataFrame, where: str) -> DataFrame:
    zooms = sorted(r["z"] for r in files_there.select("z").distinct().limit(2).collect())
    if len(zooms) > 1:
        raise ValueError(f"{where} mixes zooms ({zooms[0]} and {zooms[1]}); exactly one is expected")
    return building_rows(files_there, "name")


def building_folder(spark: SparkSession, path: str) -> DataFrame:
    """Buildings (see building_rows) of all {z}_{x}_{y}.pbf and .mvt files of a folder, with their file's `name`; other files are not read.

    Two zooms would measure roofs against roofs, so they are an error, told from the names
    alone. A file that does not decode is a row with its error. In the order of (name, pos),
    names by bytes, the rows are the folder's buildings.
    """
    name = F.regexp_extract("path", "[^/]*$", 0)
    found = files(spark, path).select("content", name.alias("name"), text.tile_key_of_name(name).alias("k")).where("k.z is not null")
    return _building_files(found.select("name", "k.*", "content"), path)


def building_list(spark: SparkSession, path: str, listed: str) -> DataFrame:
    """As building_folder, of exactly the tiles that a list names; one that is not there is an error. Other files are not opened."""
    wanted = tile_list(spark, listed)
    there = files(spark, path).select("content", F.regexp_extract("path", "[^/]*$", 0).alias("name"))
    gone = wanted.join(there.select("name"), "name", "left_anti").orderBy("name").first()
    if gone is not None:
        raise ValueError(f"Building tile {gone['name']} listed in {listed} is not in {path}")
    return _building_files(wanted.join(there, "name"), listed)


def first_error(rows: DataFrame, *order: str) -> None:
    """Raises the error of the first row, in that order, that has one."""
    bad = rows.where("error is not null").select(*order, "error").orderBy(*order).first()
    if bad is not None:
        raise ValueError(f"{bad[0]}: {bad['error']}")


def raw_features(tiles: DataFrame) -> DataFrame:
    """(z, x, y, buildings, layers): features of layer `building`, and of every layer as name:count, counted from the wire format alone."""

    def run(batches):
        for pdf in batches:
            rows = [(z, x, y, *mvt.raw_counts(bytes(c))) for z, x, y, c in zip(pdf["z"], pdf["x"], pdf["y"], pdf["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["z", "x", "y", "buildings", "layers"])

    ship_package(tiles.sparkSession)
    return tiles.select("z", "x", "y", "content").mapInPandas(run, "z int, x int, y int, buildings bigint, layers array<string>")


def source_kind(head: Column, nodata: Column) -> Column:
    """'elevation' or 'tiff' by a file's first bytes; a nodata value given for an elevation tile, which needs none, is an error."""
    tile = F.substring(head, 1, 4) == F.lit(containers.ELEVATION_MAGIC)
    clash = F.raise_error(F.lit("elevation tiles describe themselves: no nodata may be given for them"))
    return F.when(tile & nodata.isNotNull(), clash.cast("string")).when(tile, "elevation").otherwise("tiff")


GEOMETRY = "path string, error string, width bigint, height bigint, west double, north double, step_x double, step_y double, epsg int, nodata double, scale double, offset double"


def source_headers(rasters: DataFrame) -> DataFrame:
    """Geometry, CRS, nodata and scale of each terrain raster, or why it cannot be one: several bands, a codec that is not
    decoded, a rotated grid, no georeference. rasters: path, content (the head of a file will do)."""

    def run(batches):
        for pdf in batches:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    h = tiff.read_header(bytes(c))
                    rows.append((p, None, *h.size, *tiff.georeference(h), *tiff.sample_rules(h)))
                except (tiff.TiffError, TypeError, ValueError) as e:
                    rows.append((p, str(e), *[None] * 10))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in GEOMETRY.split(", ")]).astype({"width": "Int64", "height": "Int64", "epsg": "Int32"})

    ship_package(rasters.sparkSession)
    return rasters.select("path", "content").mapInPandas(run, GEOMETRY)


def probe_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Header facts of the listed files, read in ranges: a file costs its directories, not its samples."""
    names = [f.split()[0] for f in FACTS.split(", ")]

    def run(batches):
        for pdf in batches:
            rows = []
            for p in pdf["path"]:
                try:
                    with ranged.Ranged(p) as data:
                        rows.append({"path": p, **header_facts(data)})
                except OSError as e:
                    rows.append({"path": p, "ok": False, "reason": "not found" if isinstance(e, FileNotFoundError) else str(e)})
            out = pd.DataFrame([[r.get(n) for n in names] for r in rows], columns=names, dtype=object)
            yield out.astype({n: "Int64" for n, t in (f.split() for f in FACTS.split(", ")) if t == "bigint"})

    ship_package(spark)
    parts = max(1, min(len(paths), spark.sparkContext.defaultParallelism))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(parts).mapInPandas(run, FACTS)
