"""Ranged reads, the raster data source, lists and folders of tiles, header rules, sinks, fetching and the tile store."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import jobs
from gridloom.operators import mosaic, pruning, resample, vector
from gridloom.sources import containers, datasource, mvt, ranged, readers, sinks, tiff
from gridloom.sources.fetch import fetched
from gridloom.sources.tile_store import TileStore

GT = [8.0, 0.25, 0.0, 50.0, 0.0, -0.25]


@pytest.fixture(scope="module")
def rasters(tmp_path_factory):
    """A folder of one TIFF and one coverage container, and what they hold."""
    at, rng = tmp_path_factory.mktemp("rasters"), np.random.default_rng(4)
    grid = (rng.integers(0, 255, (600, 900)) * (rng.random((600, 900)) < 0.5)).astype(np.uint8)
    (at / "a.tif").write_bytes(tiff.write_tiled(grid, 64, GT, "0"))
    cover = grid[:200, :300]
    (at / "b.bit").write_bytes(containers.write_coverage(cover, 32, 8))
    (at / "b.json").write_text(json.dumps({"output_format": "8BIT", "dimensions": {"width": 300, "height": 200}, "tile_size": 32, "geotransform": GT}))
    return at, {"a.tif": grid, "b.bit": cover}


def test_ranges_give_the_bytes_of_the_file(rasters):
    at, _ = rasters
    raw = (at / "a.tif").read_bytes()
    with ranged.Ranged(f"file:{at}/a.tif") as data:
        for a, b in ((0, 8), (100, 100_000), (len(raw) - 24, len(raw)), (-8, -4), (65530, 65540), (7, 7)):
            assert data[slice(a, b)] == raw[a:b]
    assert [p.rsplit("/", 1)[1] for p, _ in ranged.listed(str(at), (".tif", ".bit"))] == ["a.tif", "b.bit"]


def test_a_header_costs_its_directories(rasters):
    at, _ = rasters
    with ranged.Ranged(f"{at}/a.tif") as data:
        h = tiff.read_header(data)
        assert h.size == (900, 600) and data.fetched < len(data) / 2


@pytest.mark.parametrize("asked", ["x >= 130 and x < 200 and y > 300 and y <= 350", "y = 17", "x < 5", "v > 200"])
def test_windows_reach_the_source(spark, rasters, asked):
    at, grids = rasters
    datasource.register(spark)
    df = spark.read.format("gridloom_raster").load(str(at)).where(asked)
    got = {(r["path"].rsplit("/", 1)[1], r["x"], r["y"], r["v"]) for r in df.collect()}
    want = set()
    for name, grid in grids.items():
        y, x = np.nonzero(grid)
        every = spark.createDataFrame([(int(a), int(b), int(grid[b, a])) for a, b in zip(x, y)], "x int, y int, v int").where(asked)
        want |= {(name, *r) for r in every.collect()}
    assert got == want


def test_filters_narrow_what_a_task_reads(rasters):
    from pyspark.sql.datasource import GreaterThanOrEqual, LessThan

    at, grids = rasters
    reader = datasource.RasterReader(str(at))
    asked = [GreaterThanOrEqual(("y",), 512), LessThan(("x",), 64)]
    assert list(reader.pushFilters(asked)) == asked
    parts = reader.partitions()
    assert [p.part for p in parts] == [0, 0]
    rows = [b.num_rows for p in parts for b in reader.read(p)]
    assert sum(rows) == np.count_nonzero(grids["a.tif"][512:, :64])


def test_large_files_are_shared_by_bands(rasters, monkeypatch):
    at, grids = rasters
    monkeypatch.setattr(datasource, "SHARE", 20_000)
    reader = datasource.RasterReader(f"{at}/a.tif")
    parts = reader.partitions()
    assert len(parts) > 3
    assert sum(b.num_rows for p in parts for b in reader.read(p)) == np.count_nonzero(grids["a.tif"])


def test_probe_by_ranges_equals_probe_of_whole_files(spark, rasters, tmp_path):
    at, _ = rasters
    (tmp_path / "short.tif").write_bytes((at / "a.tif").read_bytes()[:30])
    paths = [f"{at}/a.tif", f"{tmp_path}/short.tif", f"{tmp_path}/none.tif"]
    got = {r["path"]: r for r in readers.probe_files(spark, paths).collect()}
    assert got[paths[0]]["width"] == 900 and got[paths[0]]["ok"] and not got[paths[1]]["ok"]
    assert got[paths[2]]["reason"] == "not found"


# lists and folders of vector tiles


def tile(k):
    return mvt.encode_layer("building", [({"height": f"{k} m"}, [[(0, 0), (90, 0), (90, 90), (0, 90)], [(20, 20), (20, 40), (40, 40), (40, 20)]])])


def test_a_folder_of_one_zoom(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"14_{8500 + k}_5700.pbf").write_bytes(tile(k + 1))
    (tmp_path / "14_1_2.mvt").write_bytes(b"\x1a\x7f")
    (tmp_path / "notes.txt").write_text("no tile")
    got = readers.building_folder(spark, str(tmp_path)).collect()
    assert sorted(r["name"] for r in got if r["error"] is None) == [f"14_{8500 + k}_5700.pbf" for k in range(3)]
    assert [r["name"] for r in got if r["error"]] == ["14_1_2.mvt"]
    with pytest.raises(ValueError, match="14_1_2.mvt"):
        readers.first_error(readers.building_folder(spark, str(tmp_path)), "name")
    (tmp_path / "13_1_2.pbf").write_bytes(tile(1))
    with pytest.raises(ValueError, match="mixes zooms"):
        readers.building_folder(spark, str(tmp_path))


def test_a_list_names_its_tiles(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"14_{k}_5.pbf").write_bytes(tile(k + 1))
    (tmp_path / "13_9_9.pbf").write_bytes(tile(9))
    listed = tmp_path / "list.txt"
    listed.write_text("﻿14_2_5.pbf\r\n# no\n\n  14_0_5.pbf \n14_2_5.pbf\n", encoding="utf-8")
    assert [r["name"] for r in readers.tile_list(spark, str(listed)).collect()] == ["14_0_5.pbf", "14_2_5.pbf"]
    got = readers.building_list(spark, str(tmp_path), str(listed)).collect()
    assert {(r["name"], r["tags"]["height"], len(r["holes"])) for r in got} == {("14_0_5.pbf", "1 m", 1), ("14_2_5.pbf", "3 m", 1)}
    listed.write_text("14_0_5.pbf\n14_7_5.pbf\n")
    with pytest.raises(ValueError, match="14_7_5.pbf listed in"):
        readers.building_list(spark, str(tmp_path), str(listed))
    listed.write_text("14_0_5.pbf\nsub/14_0_5.pbf\n")
    with pytest.raises(ValueError, match="line 2"):
        readers.tile_list(spark, str(listed))


def test_raw_counts(spark):
    df = spark.createDataFrame([(14, 1, 2, bytearray(tile(1) + mvt.encode_layer("park", [({}, [[(0, 0), (5, 0), (5, 5)]])] * 3)))], "z int, x int, y int, content binary")
    assert readers.raw_features(df).first()[3:] == (1, ["building:1", "park:3"])


# headers


def test_what_cannot_be_terrain_is_refused(spark):
    good = tiff.write_tiled(np.ones((20, 30), np.int16), 16, GT, "-9999", scale=(0.5, 10.0))
    h = tiff.read_header(good)
    assert tiff.georeference(h) == (8.0, 50.0, 0.25, 0.25, 4326) and tiff.sample_rules(h) == (-9999.0, 0.5, 10.0)
    for tag, value, why in ((277, [3], "one band"), (259, [50000], "compression 50000"), (33922, None, "no geotransform"), (34264, [1.0, 0.2] + [0.0] * 14, "rotated")):
        bad = tiff.read_header(good)
        bad.tags[tag] = value
        if value is None:
            del bad.tags[tag]
        with pytest.raises(tiff.TiffError, match=why):
            tiff.georeference(bad)
    point = tiff.read_header(good)
    point.tags[34735] = [1, 1, 0, 2, 1025, 0, 1, 2, 2048, 0, 1, 4326]
    assert tiff.georeference(point)[:2] == (7.875, 50.125)
    rows = readers.source_headers(spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"no"))], "path string, content binary")).collect()
    assert rows[0]["error"] is None and rows[0]["epsg"] == 4326 and rows[1]["error"] == "not a TIFF file"


def test_source_kinds(spark):
    df = spark.createDataFrame([(bytearray(b"AETH1"), None), (bytearray(b"II*\0"), 5.0)], "head binary, nodata double")
    assert [r[0] for r in df.select(readers.source_kind(F.col("head"), F.col("nodata"))).collect()] == ["elevation", "tiff"]
    with pytest.raises(Exception, match="describe themselves"):
        df.withColumn("nodata", F.lit(1.0)).select(readers.source_kind(F.col("head"), F.col("nodata"))).collect()


def test_tiles_edited_in_place():
    raw = containers.write_elevation(np.zeros((4, 4), np.int16), 47.0, 8.0, 30 / 111111.0)
    assert containers.lenient_header(raw)[:3] == (4, 47.0, 8.0) and containers.lenient_header(raw[:40]) is None
    new = containers.read_elevation(containers.edited(raw, {(1, 2): 77, (9, 9): 5})).cells
    assert new[2, 1] == 77 and np.count_nonzero(new) == 1
    assert containers.is_output_of(raw, 4, 47.0, 8.0, 30) and not containers.is_output_of(raw, 4, 47.0, 8.5, 30) and not containers.is_output_of(raw + b"\0", 4, 47.0, 8.0, 30)


# sinks


def test_files_are_written_by_tasks(spark, tmp_path):
    files = spark.createDataFrame([(f"t{k}.abt", bytearray([k]) * (k + 1)) for k in range(5)], "name string, payload binary").repartition(3)
    done = {r["name"]: r["bytes"] for r in sinks.write_files(files, f"{tmp_path}/out").collect()}
    assert done == {f"t{k}.abt": k + 1 for k in range(5)}
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == sorted(done) and (tmp_path / "out/t3.abt").read_bytes() == b"\3\3\3\3"
    assert jobs.in_memory(files)["t2.abt"] == b"\2\2\2"
    with pytest.raises(Exception, match="no file name"):
        sinks.write_files(files.withColumn("name", F.lit("../x")), f"{tmp_path}/out")


def test_a_mosaic_is_written_from_tiles(spark, tmp_path):
    grid = (np.arange(3000 * 40) % 251).astype(np.uint8).reshape(40, 3000)
    y, x = np.nonzero(grid)
    cells = spark.createDataFrame([(int(a), int(b), int(grid[b, a])) for a, b in zip(x[::7], y[::7])], "x long, y long, v int")
    with open(tmp_path / "m.tif", "wb") as f:
        sinks.write_mosaic(cells, f, 3000, 40, 64, GT, [4, 16])
    raw = (tmp_path / "m.tif").read_bytes()
    h = tiff.read_header(raw)
    want = np.zeros_like(grid)
    want[y[::7], x[::7]] = grid[y[::7], x[::7]]
    assert h.overviews == 2 and (tiff.read_window(raw, h, 0, 0, 3000, 40) == want).all()


def test_flat_buffers_are_exported():
    grid = np.random.default_rng(2).integers(0, 2, (30, 70)).astype(np.uint8)
    rows = np.zeros((30, 12), np.uint8)
    rows[:, :9] = np.packbits(grid, axis=1)
    side = json.dumps({"output_format": "1BIT_LOS", "dimensions": {"width": 70, "height": 30}, "geotransform": GT}).encode()
    raw = jobs.export_flat(rows.tobytes(), side, 32)
    assert (tiff.read_window(raw, tiff.read_header(raw), 0, 0, 70, 30) == grid).all()


# lookups, fetching, cache


def test_pixels_by_place(spark):
    tiles = spark.createDataFrame([(0, 0, list(range(16))), (1, 0, list(range(100, 116)))], "tx long, ty long, cells array<int>")
    points = spark.createDataFrame([(0, 0), (5, 3), (6, 3), (2, 5), (-1, 0), (1, 1)], "x long, y long")
    got = {(r["x"], r["y"]): r["value"] for r in mosaic.pixel_values(tiles, points, 4, 6, 8).collect()}
    assert got == {(0, 0): 0, (5, 3): 113, (6, 3): 0, (2, 5): 0, (-1, 0): 0, (1, 1): 5}
    assert mosaic.pixel_values(tiles, points, 4, 6, 8, 16).where("x = 2").first()["value"] == 65535


def test_browser_overviews(spark):
    got = spark.createDataFrame([(2048,), (2049,), (5000,), (70000,)], "w long").select(mosaic.browser_factors(F.col("w"))).collect()
    assert [r[0] for r in got] == [[], [4], [4, 16], [4, 16, 64, 256]]


def test_fetches_are_tried_again(spark):
    def fetch(url):
        import pathlib

        seen = pathlib.Path(url.split("|")[1])
        seen.write_text(seen.read_text() + "x" if seen.exists() else "x")
        if "busy" in url and len(seen.read_text()) < 3:
            raise OSError("tile: HTTP 503 Service Unavailable")
        if "gone" in url:
            raise OSError("tile: HTTP 404 Not Found")
        return b"" if "empty" in url else b"body"

    import tempfile

    at = tempfile.mkdtemp()
    urls = spark.createDataFrame([(k, f"{n}|{at}/{n}") for k, n in enumerate(["fine", "busy", "gone", "empty"])], "id int, url string").coalesce(1)
    got = {r["id"]: (r["body"], r["kind"], r["tries"]) for r in fetched(urls, fetch, pause_s=0.01).collect()}
    assert got == {0: (b"body", None, 1), 1: (b"body", None, 3), 2: (None, "http_404", 1), 3: (None, "decode", 1)}


def test_the_store_answers_with_the_best_entry(spark, tmp_path):
    store = TileStore(spark, f"{tmp_path}/tiles")
    wanted = spark.createDataFrame([(14, 1, 1), (14, 2, 1), (14, 3, 1)], "z int, x int, y int")
    assert store.lookup(wanted).where("status is not null").count() == 0
    rows = lambda *r: spark.createDataFrame(list(r), "z int, x int, y int, status int, body binary")
    store.store(rows((14, 1, 1, pruning.PRESENT, bytearray(b"old")), (14, 2, 1, pruning.NO_TILE, None)))
    store.store(rows((14, 1, 1, pruning.PRESENT, bytearray(b"new"))))
    store.store(rows((14, 1, 1, pruning.DERIVED, bytearray(b"made")), (14, 3, 1, pruning.DERIVED, bytearray(b"made"))))
    got = {r["x"]: (r["status"], r["body"]) for r in store.lookup(wanted).collect()}
    assert got == {1: (pruning.PRESENT, b"new"), 2: (pruning.NO_TILE, None), 3: (pruning.DERIVED, b"made")}


# rules that the tables' queries do not reach


def test_runs_stay_below_their_size(spark):
    ranges = [("f", k * 100, k * 100 + 100) for k in range(10)] + [("f", 5000, 5010)]
    got = resample.read_runs(spark.createDataFrame(ranges, "file string, start long, stop long"), 50, 300).orderBy("run").collect()
    assert [(r["start"], r["stop"], r["n"]) for r in got] == [(0, 300, 3), (300, 600, 3), (600, 900, 3), (900, 1000, 1), (5000, 5010, 1)]


def test_first_rows_of_wide_columns(spark):
    df = spark.createDataFrame([("a", 1, 5, "late"), ("a", 1, 2, "first"), (None, 1, 9, "alone")], "k string, q int, pos int, said string")
    got = sorted(((r["k"] or "", r["said"]) for r in vector.first_of_duplicates(df, ["k", "q"], "pos").collect()))
    assert got == [("", "alone"), ("a", "first")]


def test_height_statistics(spark):
    df = spark.createDataFrame([("default", 6.0), ("height", 10.0), ("levels", 9.0)], "source string, metres double")
    assert vector.height_statistics(df).first()[:] == (3, 2, 6.0, 10.0, 25.0)


def test_paths_meet_by_their_whole_name(spark, tmp_path):
    for name, v in (("ba.tif", 7), ("a.tif", 9)):
        (tmp_path / name).write_bytes(tiff.write_tiled(np.full((16, 16), v, np.uint8), 16, GT, "0"))
    got = jobs.aggregate(spark, [f"{tmp_path}/a.tif", f"{tmp_path}/ba.tif"], 16)
    assert got["cells"].agg(F.max("max_raw"), F.max("n_src")).first()[:] == (9, 2)
    jobs.write_mosaic_files(got, str(tmp_path), 16)
    raw = (tmp_path / "max.tif").read_bytes()
    assert (tiff.read_window(raw, tiff.read_header(raw), 0, 0, 16, 16) == 9).all()


def test_samples_become_coverage_bytes():
    short = np.array([[-5, 0, 7, 300]], np.int16)
    assert tiff.coverage_bytes(short).tolist() == [[0, 0, 7, 255]] and tiff.coverage_bytes(short.view(np.uint16)).tolist() == [[0, 0, 7, 255]]
    real = np.array([[np.nan, -6000.0, -150.0, -100.25, 1e9]], np.float32)
    assert tiff.coverage_bytes(real, 0.5, -150.0).tolist() == [[0, 0, 0, 99, 255]]


def test_one_bit_tiles():
    cells = np.random.default_rng(5).integers(0, 2, (9, 13)).astype(np.uint8)
    assert (tiff.decode_chunk(np.packbits(cells, axis=1).tobytes(), 13, 9, np.dtype(np.uint8), 1, 1, 1) == cells).all()


@pytest.mark.parametrize(("epsg", "west", "north"), [(32632, 8.0, 47.5), (2056, 8.2, 47.0), (3857, 10.0, 50.0), (32733, 15.5, -20.0)])
def test_bounds_of_projected_sources(epsg, west, north):
    from gridloom.functions.projections import forward
    from gridloom.operators import projected

    e, n = (float(v[0]) for v in forward(epsg)(np.array([west]), np.array([north])))
    w, s, east, top = projected.bounds_in_degrees(e, n, 100.0, 300, 200, epsg)
    x, y = forward(epsg)(np.array([w, east]), np.array([s, top]))
    assert w <= west + 1e-6 and top >= north - 1e-6 and w > west - 0.1 and top < north + 0.1
    assert abs((x[1] - x[0]) - 30_000) < 3_000 and abs((y[1] - y[0]) - 20_000) < 3_000


def test_rasters_by_their_endings(spark, rasters):
    at, grids = rasters
    got = readers.raster_cells(spark, str(at)).where("error is null").groupBy(F.regexp_extract("path", "[^/]*$", 0).alias("name")).count().collect()
    assert {r["name"]: r["count"] for r in got} == {k: np.count_nonzero(g) for k, g in grids.items()}
