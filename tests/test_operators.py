"""Operators against hand-made answers and against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.functions import elevation, grids, projections
from gridloom.operators import mosaic, quadtree, runs, terrain, vector


def one(spark, expr):
    return spark.range(1).select(expr.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("box", "resolutions", "count", "total"),
    [((47.2, 47.6, 8.1, 8.4), [30], 2, 14223448), ((46.99, 47.51, 7.49, 8.01), [30, 90], 13, 76662332)],
)
def test_known_plans(spark, box, resolutions, count, total):
    boxes = spark.createDataFrame([(1, *box)], "id int, south double, north double, west double, east double")
    got = runs.plan_tiles(boxes, resolutions).toPandas()
    assert len(got) == count and got["est_bytes"].sum() == total


def test_first_tile_of_a_known_plan(spark):
    boxes = spark.createDataFrame([(1, 47.2, 47.6, 8.1, 8.4)], "id int, south double, north double, west double, east double")
    t = runs.plan_tiles(boxes, [30]).orderBy("ul_lat").first()
    assert (t["filename"], t["size_px"], t["est_bytes"]) == ("tile_N47.50E8.00_30m.abt", 1852, 7111724)
    assert t["exact_res_m"] == pytest.approx(29.99757019438445, abs=0)


def test_half_metres_keep_their_rounding(spark):
    v = lambda fn, x: one(spark, fn(F.lit(x)))
    assert v(elevation.half_metres_truncated, 1.9) == 3 and v(elevation.half_metres_truncated, -1.9) == -3
    assert v(elevation.half_metres_truncated, float("nan")) == -9999 and v(elevation.half_metres_truncated, float("inf")) == -9999
    assert v(elevation.half_metres_truncated, 1e9) == 32767 and v(elevation.half_metres_truncated, -1e9) == -32768
    assert v(elevation.half_metres_half_away, 0.25) == 1 and v(elevation.half_metres_half_away, -0.25) == -1
    assert v(elevation.half_metres_of_int, -2**40) == -9999 and v(elevation.half_metres_of_int, 2**62) == 32767


def test_rgb_codes_round_trip(spark):
    metres = spark.range(0, 4000).select((F.col("id") * 2.3 - 400).alias("m"))
    n = elevation.rgb_tenths_of_metres(F.col("m"))
    worst = metres.select(F.max(F.abs(elevation.metres_of_rgb_tenths(n).cast("double") - F.col("m")))).first()[0]
    assert worst <= 0.06
    n = elevation.rgb_of_metres(F.col("m"))
    worst = metres.select(F.max(F.abs(elevation.metres_of_rgb(*elevation.channels(n)) - F.col("m")))).first()[0]
    assert worst <= 1 / 512


def test_mean_rounds_away_from_zero(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (2, -1), (2, -2), (3, -9999), (4, 7), (4, -9999)], "cell int, v int")
    assert {r["cell"]: (r["mean"], r["n"]) for r in terrain.area_mean(s, "cell").collect()} == {1: (2, 2), 2: (-2, 2), 3: (-9999, 0), 4: (7, 1)}


def numpy_seam(g, depth=2200, reach=2):
    e, g = len(g), g.copy()
    for _ in range(reach):
        hits = []
        for y in range(e):
            for x in range(e):
                if np.isnan(g[y, x]):
                    continue
                near = lambda dx, dy: next((g[y + k * dy, x + k * dx] for k in range(1, reach + 1) if 0 <= x + k * dx < e and 0 <= y + k * dy < e and not np.isnan(g[y + k * dy, x + k * dx])), None)  # noqa: B023, E731
                for a, b in ((near(-1, 0), near(1, 0)), (near(0, -1), near(0, 1))):
                    if a is not None and b is not None and min(a, b) - g[y, x] > depth:
                        hits.append((y, x))
        if not hits:
            break
        for h in hits:
            g[h] = np.nan
    return g


def test_seam_filter_equals_numpy(spark):
    rng = np.random.default_rng(4)
    g = rng.integers(0, 50, (16, 16)).astype(float)
    g[rng.random((16, 16)) < 0.08] = -4000
    g[5, 3:5] = -4000
    g[rng.random((16, 16)) < 0.1] = np.nan
    rows = [(0, x, y, None if np.isnan(g[y, x]) else float(g[y, x])) for y in range(16) for x in range(16)]
    df = spark.createDataFrame(rows, "tile int, x int, y int, v double")
    got = np.full((16, 16), np.nan)
    for r in terrain.seam_filter(df, 11).collect():
        got[r["y"], r["x"]] = np.nan if r["v"] is None else r["v"]
    np.testing.assert_array_equal(got, numpy_seam(g))
    assert terrain.seam_filter(df, 10).where("seam").count() == 0


def test_overview_is_decimation(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.col("id").alias("v"))
    assert {(r["x"], r["y"]): r["v"] for r in mosaic.decimated(cells, 4).collect()} == {(0, 0): 0, (1, 0): 4, (0, 1): 32, (1, 1): 36}
    assert mosaic.overview_levels(5000, 300) == [4, 16, 64] or mosaic.overview_levels(5000, 300)[0] == 4


def test_counts_saturate_and_ids_wrap(spark):
    cells = spark.createDataFrame([(70000, 0, 0, 5, 0), (1, 0, 0, 9, 2), (3, 0, 0, 0, 1)], "src long, x long, y long, raw int, pos long")
    # in input order, which is not that of the ids
    assert mosaic.contributors(cells).first()["ids"] == [70000 - 65536, 1]
    assert mosaic.max_and_count(cells).first()[2:] == (9, 2)


def test_missing_child_is_not_derivable_and_404_is_void(spark):
    tiles = [(9, 0, 0, "ok", 4.0), (9, 1, 0, "404", None), (9, 0, 1, "ok", 8.0), (9, 1, 1, "ok", 6.0), (9, 2, 0, "ok", 1.0), (9, 3, 0, "missing", None), (9, 2, 1, "ok", 1.0), (9, 3, 1, "ok", 1.0)]
    got = quadtree.derive_parents(spark.createDataFrame(tiles, "z int, x int, y int, status string, v double")).collect()
    assert [(r["z"], r["x"], r["y"], r["v"]) for r in got] == [(8, 0, 0, 6.0)]


def test_finest_ancestor_fills_and_zoom_six_is_last(spark):
    tiles = spark.createDataFrame([(7, 2, 2, 1.0), (6, 1, 1, 2.0), (5, 0, 0, 3.0)], "z int, x int, y int, v double")
    want = spark.createDataFrame([(8, 4, 5), (8, 6, 6), (8, 0, 0)], "z int, x int, y int")
    got = {(r["x"], r["y"]): (r["v"], r["filled_zoom"]) for r in quadtree.fill_from_ancestors(want, tiles, 4).collect()}
    assert got == {(4, 5): (1.0, 7), (6, 6): (2.0, 6), (0, 0): (None, None)}


def test_roofs_stand_on_frozen_ground_and_burning_again_changes_nothing(spark):
    cells = spark.range(64).select((F.col("id") % 8).alias("x"), F.floor(F.col("id") / 8).alias("y"), F.lit(200).alias("v"))
    box = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    kind = "id int, ring array<struct<px:double,py:double>>, rise int"
    shapes = spark.createDataFrame([(1, box(0.0, 4.0), 10), (2, box(2.0, 6.0), 30), (3, box(0.0, 1.0), 0)], kind)
    got = {(r["x"], r["y"]): r["burned"] for r in vector.burn(cells, shapes, 8).collect()}
    assert got[0, 0] == 210 and got[2, 2] == 230 and got[5, 5] == 230 and got[7, 7] == 200


def test_same_rows_with_any_number_of_partitions(spark):
    cells = spark.range(4000).select((F.col("id") % 17).alias("src"), (F.col("id") * 7 % 40).alias("x"), (F.col("id") * 11 % 40).alias("y"), (F.col("id") % 251).cast("int").alias("raw"))
    seen = set()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        seen.add(tuple(sorted(map(tuple, mosaic.csr_offsets(cells.groupBy("src", "x", "y").agg(F.max("raw").alias("raw")), 16).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(seen) == 1


def test_shares_add_up(spark):
    got = runs.row_shares(spark.createDataFrame([(i, 3 + i) for i in range(7)], "row int, n int"), 1001).toPandas()
    assert got["share"].sum() == 1001


def test_projections():
    east, north = projections.lv95(np.array([7.438632]), np.array([46.951083]))
    assert abs(east[0] - 2600000) < 2 and abs(north[0] - 1200000) < 2
    east, north = projections.utm(np.array([9.0]), np.array([0.0]), 32)
    assert east[0] == pytest.approx(500000, abs=1e-6) and north[0] == pytest.approx(0, abs=1e-6)
    assert projections.utm(np.array([9.0]), np.array([45.0]), 32)[1][0] == pytest.approx(4982950.400, abs=0.01)
    with pytest.raises(ValueError, match="EPSG:1234"):
        projections.forward(1234)


def test_tile_numbers_go_back_to_their_edges(spark):
    df = spark.range(100).select(((F.col("id") * 3.6) - 179.9).alias("lon"), ((F.col("id") * 1.6) - 80).alias("lat"))
    z = F.lit(9)
    x, y = grids.lon_to_tile(F.col("lon"), z), grids.lat_to_tile(F.col("lat"), z)
    off = df.where((grids.tile_to_lon(x, z) > F.col("lon")) | (grids.tile_to_lat(y, z) < F.col("lat")))
    assert off.count() == 0
    assert isinstance(df.limit(1).toPandas(), pd.DataFrame)
