"""Whole jobs over real files."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom import jobs
from gridloom.functions.projections import forward
from gridloom.operators import mosaic
from gridloom.operators.projected import row_edges, sample_tile
from gridloom.sources import containers, tiff

SIDE = {"dimensions": {"width": 20, "height": 10}, "geotransform": [8.0, 0.5, 0, 50.0, 0, -0.5], "tile_size": 16, "output_format": "8BIT", "projection": "EPSG:4326"}


@pytest.fixture
def rasters(tmp_path):
    a, b = np.zeros((10, 20), np.uint8), np.zeros((8, 8), np.uint8)
    a[2, 3], a[9, 19], b[0, 0], b[1, 1] = 50, 7, 90, 20
    for name in ("wp_7", "wp_9", "wp_4"):
        (tmp_path / name).mkdir()
    (tmp_path / "wp_7/a.bit").write_bytes(containers.write_coverage(a, 16, 8))
    (tmp_path / "wp_7/a.json").write_text(json.dumps(SIDE))
    (tmp_path / "wp_4/bad.tif").write_bytes(b"no raster")
    (tmp_path / "wp_9/b.tif").write_bytes(tiff.write_tiled(b, 16, [9.5, 0.5, 0, 49.0, 0, -0.5], "0"))
    return [str(tmp_path / p) for p in ("wp_7/a.bit", "wp_4/bad.tif", "wp_9/b.tif")]


def test_mosaic_of_files(spark, rasters):
    got = jobs.aggregate(spark, rasters)
    g = got["grid"].first()
    assert (g["left"], g["top"], g["width"], g["height"]) == (8.0, 50.0, 20, 10)
    cells = {(r["x"], r["y"]): (r["max_raw"], r["n_src"]) for r in got["cells"].collect()}
    assert cells == {(3, 2): (90, 2), (19, 9): (7, 1), (4, 3): (20, 1)}
    assert {(r["x"], r["y"]): r["ids"] for r in got["sources"].collect()}[3, 2] == [7, 9]
    assert [r["path"].rsplit("/", 1)[1] for r in got["skipped"].collect()] == ["bad.tif"]
    files = jobs.mosaic_files(got, 16)
    h = tiff.read_header(files["max.tif"])
    assert tiff.read_window(files["max.tif"], h, 0, 0, 20, 10)[2, 3] == 90
    assert list(containers.read_visibility(files["index.vix"])[1][0, 0][1]) == [7, 9, 9]


def test_nearest_cells_of_another_resolution(spark):
    a = np.random.default_rng(1).integers(1, 200, (6, 7))
    cells = spark.createDataFrame([(0, x, y, int(a[y, x])) for y in range(6) for x in range(7)], "pos long, x long, y long, raw int")
    rasters = spark.createDataFrame([(0, 5, 0.1, 0.0, 0.9, -1.1, 7, 6)], "pos long, src long, left double, top double, step_x double, step_y double, width long, height long")
    grid = spark.createDataFrame([(0.0, 0.0, 0.4, -0.5, 16, 13)], "left double, top double, step_x double, step_y double, width long, height long")
    got = {(r["x"], r["y"]): r["raw"] for r in mosaic.on_master_grid(cells, rasters, grid).collect()}
    away = lambda v: int(np.sign(v) * np.floor(abs(v) + 0.5))
    want = {}
    for y in range(13):
        for x in range(16):
            sx, sy = away((0 - 0.1) / 0.9 + x * (0.4 / 0.9)), away(0 / -1.1 + y * (-0.5 / -1.1))
            if 0 <= sx < 7 and 0 <= sy < 6:
                want[x, y] = a[sy, sx]
    assert got == want


def test_export(spark):
    a = np.random.default_rng(2).integers(0, 255, (10, 20)).astype(np.uint8)
    raw = jobs.export(containers.write_coverage(a, 16, 8), json.dumps(SIDE).encode(), 16)
    h = tiff.read_header(raw)
    np.testing.assert_array_equal(tiff.read_window(raw, h, 0, 0, 20, 10), a)
    with pytest.raises(ValueError, match="16"):
        jobs.export(b"", b"", 24)


def test_plan_and_its_refusals(spark):
    assert jobs.plan(spark, 47.2, 47.6, 8.1, 8.4, [30])["total_bytes"] == 14223448
    for box in ((1, 0, 0, 1), (0, 1, 1, 0), (0, 1, 170, 181), (0, float("nan"), 0, 1)):
        with pytest.raises(ValueError):
            jobs.plan(spark, *box, [30])
    with pytest.raises(ValueError):
        jobs.plan(spark, 0, 1, 0, 1, [])


def test_probe_keeps_list_order(spark, rasters):
    got = jobs.probe(spark, [rasters[2], rasters[1]]).collect()
    assert [r["ok"] for r in got] == [True, False] and got[0]["width"] == 8


def test_ingest_takes_the_first_valid_source(spark):
    rows = [("t", 1.0, 2.0, 0, 0, 0, -9999), ("t", 1.0, 2.0, 0, 0, 1, 44), ("t", 1.0, 2.0, 1, 0, 0, 10), ("t", 1.0, 2.0, 1, 0, 1, 20)]
    s = spark.createDataFrame(rows, "tile string, ul_lat double, ul_lon double, x int, y int, priority int, v int")
    t = containers.read_elevation(bytes(jobs.ingest(s, 4, 0.001).select(F.col("payload")).first()[0]))
    assert t.cells[0].tolist() == [44, 10, -9999, -9999]


def test_projected_rows_stay_near_the_projection():
    fn = forward(32632)
    e, n = row_edges(fn, 47.0, 7.0, 0.01, 400, 10.0)
    lon = 7.0 + np.arange(401) * 0.01
    te, tn = fn(lon, np.full(401, 47.0))
    assert np.hypot(e - te, n - tn).max() < 60 and e[64] == pytest.approx(te[64])


def test_projected_means():
    src = np.full((400, 400), 100, np.int16)
    src[:, 200:] = 300
    src[100, 100] = -9999
    e0, n0 = forward(32632)(np.array([9.0]), np.array([47.0]))
    out = sample_tile(src, e0[0] - 2000, n0[0] + 2000, 10.0, 32632, 47.005, 8.985, 0.001, 30)
    assert set(np.unique(out[:10])) <= set(range(100, 301)) and out[5, 2] == 100 and out[5, 27] == 300
    far = sample_tile(src, 0.0, 0.0, 10.0, 32632, 47.005, 8.985, 0.001, 3)
    assert (far == -9999).all()
