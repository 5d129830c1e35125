"""Queries of area sampling and grid placement, and more round trips through file formats, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import elevation as E
from gridloom.functions import grids as G
from gridloom.functions import text
from gridloom.operators import mosaic, projected, resample, terrain, vector
from gridloom.runtime import ship_package
from gridloom.sources import containers, flatgeobuf, mvt, readers, sinks, tiff
from gridloom.streaming import gates

from . import views as V
from .more_queries import _cells_of, _rasters_of, _spans

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_MEAN = "CAST(trunc((2 * s + CASE WHEN s >= 0 THEN 1 ELSE -1 END * n) / CAST(2 * n AS DOUBLE)) AS INT)"


@query(f"""WITH {V.ELEV}, c AS (SELECT gx AS x, gy AS y, min(v) AS v FROM elev GROUP BY 1, 2), cs AS ({_spans("-1.25", "2.5", 28, 64)}),
rr AS (SELECT j AS oy, 47.0::DOUBLE - (j + 0.5::DOUBLE) * 0.013::DOUBLE AS lat FROM (SELECT unnest(range(30)) AS j)), rf AS (SELECT *, (47.05::DOUBLE - lat) / 0.01::DOUBLE AS row FROM rr),
rs AS (SELECT oy, CASE WHEN a < b THEN a ELSE mid END AS first, CASE WHEN a < b THEN b ELSE mid + 1 END AS last FROM (SELECT oy, lat, row,
  CAST(greatest(floor(row - 0.013::DOUBLE * 0.5::DOUBLE / 0.01::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE), 0) AS BIGINT) AS a, least(CAST(greatest(floor(row + 0.013::DOUBLE * 0.5::DOUBLE / 0.01::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE), 0) AS BIGINT), 32) AS b,
  least(CAST(greatest(floor(row), 0) AS BIGINT), 31) AS mid FROM rf) WHERE lat <= 47.05::DOUBLE AND lat >= 46.73::DOUBLE AND row >= 0 AND floor(row) < 32),
j AS (SELECT cs.x AS ox, rs.oy, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM c JOIN cs ON c.x >= cs.first AND c.x < cs.last JOIN rs ON c.y >= rs.first AND c.y < rs.last WHERE v > -5000 GROUP BY 1, 2)
SELECT cs.x AS ox, rr.oy, coalesce({_MEAN}, -9999) AS mean FROM cs CROSS JOIN rr LEFT JOIN j ON j.ox = cs.x AND j.oy = rr.oy""")
def area_grid(spark, sf):
    """A geographic source of 64 x 32 samples on an output grid that reaches beyond it."""
    cells = V.elev(spark, sf).groupBy(F.col("gx").alias("x"), F.col("gy").alias("y")).agg(F.min("v").alias("v"))
    columns = resample.column_spans(28, -1.25, 2.5, 0.0, 1.0, 64, spark).withColumnRenamed("x", "ox")
    lat = F.lit(47.0) - (F.col("oy") + 0.5) * F.lit(0.013)
    span = G.geo_row_span(lat, F.lit(47.05), F.lit(46.73), F.lit(0.01), F.lit(32), F.lit(0.013))
    rows = spark.range(30).select(F.col("id").alias("oy")).select("oy", span.alias("s")).select("oy", "s.first", "s.last")
    return resample.area_average(cells, columns, rows)


@query(f"""WITH {V.PROFILE}, c AS (SELECT x, y, CAST(v AS FLOAT) AS v FROM profile WHERE v IS NOT NULL), cs AS (SELECT i AS ox, i * 1.7::DOUBLE - 2.2::DOUBLE AS place FROM (SELECT unnest(range(45)) AS i)), rs AS (SELECT i AS oy, i * 1.3::DOUBLE - 0.9::DOUBLE AS place FROM (SELECT unnest(range(30)) AS i))
SELECT ox, oy, CASE WHEN c.v IS NULL THEN 0 ELSE CAST(greatest(least(round(CAST(c.v AS DOUBLE) * 2), 32767), -32768) AS INT) END AS half FROM (SELECT ox, CAST(round(place) AS BIGINT) AS x FROM cs) cs CROSS JOIN (SELECT oy, CAST(least(greatest(round(place), 0), 255) AS BIGINT) AS y FROM rs) rs LEFT JOIN c USING (x, y)""")
def nearest_assembly(spark, sf):
    line = lambda n, name, a, b: spark.range(n).select(F.col("id").alias(name), (F.col("id") * F.lit(a) - F.lit(b)).alias("at"))
    cells = V.profile(spark, sf).where("v is not null")
    return resample.nearest_assembly(cells, line(45, "ox", 1.7, 2.2), line(30, "oy", 1.3, 0.9))


_GX, _GY = "(6378137.0::DOUBLE * radians({}) - 890000.0::DOUBLE) / 300.0::DOUBLE", "(5945000.0::DOUBLE - 6378137.0::DOUBLE * ln(tan(pi() / 4 + radians({}) / 2))) / 300.0::DOUBLE"


def _edges(name, edge, at, n):
    start = "CAST(greatest(floor({} + 0.5::DOUBLE + 1e-9::DOUBLE), 0) AS BIGINT)"
    lo, hi = at.format(edge.format(k="k")), at.format(edge.format(k="(k + 1)"))
    return f"""{name} AS (SELECT tile, k, CASE WHEN a < b THEN a ELSE mid END AS first, CASE WHEN a < b THEN b ELSE mid + 1 END AS last FROM (SELECT tile, k, {start.format('lo')} AS a, least({start.format('hi')}, {n}) AS b, least(CAST(greatest(floor((lo + hi) / 2), 0) AS BIGINT), {n} - 1) AS mid
  FROM (SELECT tile, k, {lo} AS lo, {hi} AS hi FROM t, (SELECT unnest(range(24)) AS k)) WHERE hi > 0 AND lo < {n}))"""


@query(f"""WITH {V.ELEV}, c AS (SELECT gx AS x, gy AS y, min(v) AS v FROM elev GROUP BY 1, 2), t AS (SELECT n_nationkey AS tile, 8.0::DOUBLE + n_nationkey % 5 * 0.03::DOUBLE AS ul_lon, 47.0::DOUBLE - n_nationkey % 4 * 0.02::DOUBLE AS ul_lat FROM nation),
{_edges("cs", "ul_lon + {k} * 0.004::DOUBLE", _GX, 64)}, {_edges("rs", "ul_lat - {k} * 0.004::DOUBLE", _GY, 64)},
j AS (SELECT cs.tile, cs.k AS x, rs.k AS y, CAST(sum(v) AS BIGINT) AS s, count(*) AS n FROM cs JOIN rs USING (tile) JOIN c ON c.x >= cs.first AND c.x < cs.last AND c.y >= rs.first AND c.y < rs.last WHERE v > -5000 GROUP BY 1, 2, 3)
SELECT tile, x, y, {_MEAN} AS v FROM j""")
def projected_tiles(spark, sf):
    """Output tiles of 24 x 24 pixels from a web-mercator source of 64 x 64 samples; what cannot be reached is left to the overlay."""
    cells = V.elev(spark, sf).groupBy("gx", "gy").agg(F.min("v").alias("v"))

    def grid(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.full((64, 64), -9999, np.int16)
        out[pdf["gy"], pdf["gx"]] = pdf["v"]
        return pd.DataFrame({"samples": [out.astype("<i2").tobytes()]})

    ship_package(spark)
    source = cells.withColumn("k", F.lit(0)).groupBy("k").applyInPandas(grid, "samples binary")
    k = F.col("n_nationkey")
    tiles = V.table(spark, sf, "nation").select(k.alias("tile"), (F.lit(47.0) - k % 4 * F.lit(0.02)).alias("ul_lat"), (F.lit(8.0) + k % 5 * F.lit(0.03)).alias("ul_lon"))
    facts = {"priority": 0, "pixel_deg": 0.004, "size": 24, "east": 890000.0, "north": 5945000.0, "step": 300.0, "epsg": 3857, "width": 64, "height": 64}
    pairs = tiles.join(F.broadcast(source)).withColumns({n: F.lit(v) for n, v in facts.items()})  # one source by construction
    return terrain.overlay(projected.sampled_tiles(pairs), "tile", "x", "y").select("tile", "x", "y", "v")


@query(f"""WITH {V.CELLS}, {V.RASTERS}, g AS (SELECT min("left") AS gl, max(top) AS gt, arg_min(step_x, pos) AS gsx, arg_min(step_y, pos) AS gsy,
  CAST(round((max("left" + width * step_x) - min("left")) / arg_min(step_x, pos)) AS BIGINT) AS gw, CAST(round((max(top) - min(top + height * step_y)) / abs(arg_min(step_y, pos))) AS BIGINT) AS gh FROM rasters),
m AS (SELECT pos, gw, gh, (gl - "left") / step_x AS bx, gsx / step_x AS rx, (gt - top) / step_y AS byy, gsy / step_y AS ry FROM rasters, g),
e AS (SELECT *, abs(rx - 1) < 1e-5 AND abs(ry - 1) < 1e-5 AND abs(bx - round(bx)) < 1e-3 AND abs(byy - round(byy)) < 1e-3 AS exact FROM m),
p AS (SELECT c.src, c.x, c.y, c.raw, e.* FROM cells c JOIN e ON e.pos = c.src WHERE raw <> 0),
px AS (SELECT *, unnest(CASE WHEN exact THEN [CAST(x - round(bx) AS BIGINT)] ELSE list_filter(range(CAST(floor((x - 0.5 - bx) / rx) AS BIGINT) - 1, CAST(ceil((x + 0.5 - bx) / rx) AS BIGINT) + 2), lambda k: round(bx + k * rx) = x) END) AS mx FROM p),
py AS (SELECT *, unnest(CASE WHEN exact THEN [CAST(y - round(byy) AS BIGINT)] ELSE list_filter(range(CAST(floor((y - 0.5 - byy) / ry) AS BIGINT) - 1, CAST(ceil((y + 0.5 - byy) / ry) AS BIGINT) + 2), lambda k: round(byy + k * ry) = y) END) AS my FROM px)
SELECT src, mx AS x, my AS y, raw FROM py WHERE mx BETWEEN 0 AND gw - 1 AND my BETWEEN 0 AND gh - 1""")
def master_cells(spark, sf):
    r = V.rasters(spark, sf)
    cells = V.cells(spark, sf).select(F.col("src").alias("pos"), "x", "y", "raw")
    return mosaic.on_master_grid(cells, r.withColumn("src", F.col("pos")), mosaic.master_grid(r)).select("src", "x", "y", "raw")


@query(f"""WITH {V.CELLS}, best AS (SELECT x, y, max(raw) AS raw FROM cells GROUP BY 1, 2), p AS (SELECT o_orderkey AS id, o_orderkey % 70 AS x, o_custkey % 36 AS y FROM orders)
SELECT id, CAST(CASE WHEN p.x < 64 AND p.y < 32 THEN coalesce(raw, 0) ELSE 0 END AS INT) AS value FROM p LEFT JOIN best b ON b.x = p.x AND b.y = p.y""")
def pixel_lookup(spark, sf):
    best = V.cells(spark, sf).groupBy("x", "y").agg(F.max("raw").alias("raw"))
    at = lambda c: F.floor(F.col(c) / 16)
    cell = F.struct(((F.col("y") % 16) * 16 + F.col("x") % 16).alias("i"), "raw")
    held = best.groupBy(at("x").alias("tx"), at("y").alias("ty")).agg(F.map_from_entries(F.collect_list(cell)).alias("m"))
    tiles = held.select("tx", "ty", F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(255).cast("bigint")), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0))).alias("cells"))
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    points = V.table(spark, sf, "orders").select(k.alias("id"), (k % 70).alias("x"), (c % 36).alias("y"))
    return mosaic.pixel_values(tiles, points, 16, 64, 32).select("id", "value")


@query("""SELECT p_partkey AS id, CASE WHEN p_size * 300 > 2048 THEN array_to_string(list_filter([4, 16, 64, 256, 1024, 4096], lambda f: f = 4 OR (p_size * 300) // f > 256), ',') ELSE '' END AS factors FROM part""")
def browser_levels(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(mosaic.browser_factors((F.col("p_size") * 300).cast("bigint")), ",").alias("factors"))


@query("""WITH b AS (SELECT p_size % 5 AS zone, CASE WHEN p_partkey % 4 = 0 THEN 'default' ELSE 'height' END AS source, CASE WHEN p_partkey % 4 = 0 THEN 6.0::DOUBLE ELSE p_size / 2.0::DOUBLE END AS metres FROM part)
SELECT zone, count(*) AS n, count(*) FILTER (source <> 'default') AS explicit, min(metres) AS low, max(metres) AS high, sum(metres) AS total FROM b GROUP BY zone""")
def building_heights(spark, sf):
    k = F.col("p_partkey")
    p = V.table(spark, sf, "part")
    b = p.select((F.col("p_size") % 5).alias("zone"), F.when(k % 4 == 0, "default").otherwise("height").alias("source"), F.when(k % 4 == 0, 6.0).otherwise(F.col("p_size") / 2.0).alias("metres"))
    return vector.height_statistics(b, "zone")


@query("""WITH a AS (SELECT user_id % 50 AS run, CASE event_id % 3 WHEN 0 THEN 'http_429' WHEN 1 THEN 'http_503' ELSE 'timeout' END AS kind, date_trunc('second', ts) AS second FROM events)
SELECT run, epoch_ms(second) // 1000 AS second, count(*) FILTER (kind <> 'timeout') AS throttled FROM a GROUP BY 1, 2""")
def throttle_seconds(spark, sf):
    k = F.col("event_id") % 3
    e = V.table(spark, sf, "events").select((F.col("user_id") % 50).alias("run"), F.col("ts").cast("timestamp").alias("ts"), F.when(k == 0, "http_429").when(k == 1, "http_503").otherwise("timeout").alias("kind"))
    return gates.throttles_per_second(e).withColumn("second", F.unix_timestamp("second"))


# round trips


@query(f"WITH {V.CELLS} SELECT src, x, y, 1 AS raw FROM cells WHERE raw <> 0")
def flat_roundtrip(spark, sf):
    def build(grid):
        rows = np.zeros((32, 8), np.uint8)  # 64 cells are two words of 32 bits
        rows[:] = np.packbits(grid != 0, axis=1)
        return rows.tobytes()

    return _cells_of(_rasters_of(V.cells(spark, sf), build), lambda raw: containers.flat_rows(raw, 64, 32, 1))


def _strips(grid, big_endian: bool, packed: bool, rows: int = 5) -> bytes:
    """A classic TIFF of strips, in one of the byte orders, plain or in literal PackBits runs."""
    import struct

    o = ">" if big_endian else "<"
    h, w = grid.shape
    out, places, sizes = bytearray(b"MM\0*" if big_endian else b"II*\0") + b"\0\0\0\0", [], []
    for y in range(0, h, rows):
        raw = grid[y : y + rows].astype(f"{o}u2").tobytes()
        if packed:
            raw = b"".join(bytes([len(raw[i : i + 128]) - 1]) + raw[i : i + 128] for i in range(0, len(raw), 128))
        places.append(len(out))
        sizes.append(len(raw))
        out += raw
    tags = {256: (4, [w]), 257: (4, [h]), 258: (3, [16]), 259: (3, [32773 if packed else 1]), 262: (3, [1]), 273: (4, places), 277: (3, [1]), 278: (4, [rows]), 279: (4, sizes), 339: (3, [1])}
    entries = b""
    for tag, (kind, values) in sorted(tags.items()):
        raw = struct.pack(f"{o}{len(values)}{'H' if kind == 3 else 'I'}", *values)
        if len(raw) > 4:
            raw, value = struct.pack(f"{o}I", len(out)), raw
            out += value
        entries += struct.pack(f"{o}HHI", tag, kind, len(values)) + raw.ljust(4, b"\0")
    struct.pack_into(f"{o}I", out, 4, len(out))
    return bytes(out) + struct.pack(f"{o}H", len(tags)) + entries + struct.pack(f"{o}I", 0)


@query(f"WITH {V.CELLS} SELECT src, x, y, raw FROM cells WHERE raw <> 0 AND x >= 7 AND x < 50 AND y >= 3 AND y < 30")
def strip_window(spark, sf):
    """Every raster as strips; odd sources big-endian, every third in PackBits runs."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((32, 64), np.uint16)
        grid[pdf["y"], pdf["x"]] = pdf["raw"]
        k = int(pdf["src"].iloc[0])
        return pd.DataFrame({"src": [k], "content": [_strips(grid, k % 2 == 1, k % 3 == 0)]})

    def parse(raw):
        out = np.zeros((32, 64), np.uint16)
        out[3:30, 7:50] = tiff.read_window(raw, tiff.read_header(raw), 7, 3, 43, 27)
        return out

    ship_package(spark)
    return _cells_of(V.cells(spark, sf).groupBy("src").applyInPandas(build, "src bigint, content binary"), parse)


@query(f"WITH {V.CELLS} SELECT src, x, y, raw FROM cells WHERE raw <> 0")
def float_predictor(spark, sf):
    """Single-precision tiles through the floating-point predictor's byte planes."""

    def build(grid):
        planes = grid.astype(">f4").view(np.uint8).reshape(32, 64, 4).transpose(0, 2, 1).reshape(32, 256)
        return np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes()

    return _cells_of(_rasters_of(V.cells(spark, sf), build), lambda raw: tiff.undo_float_predictor(raw, 64, 32, 4).astype(np.int32))


@query(f"WITH {V.CELLS}, m AS (SELECT x, y, max(raw) AS raw FROM cells GROUP BY 1, 2) SELECT x // 16 AS src, x % 16 AS x, y, raw FROM m WHERE raw <> 0 AND y < 16")
def mosaic_tiles(spark, sf):
    """Compressed tiles of the mosaic, its first row of them, decoded again."""
    best = V.cells(spark, sf).groupBy("x", "y").agg(F.max("raw").alias("v"))
    made = sinks.compressed_tiles(best.where("y < 16"), 16, 8)
    return _cells_of(made.select(F.col("tx").alias("src"), F.col("payload").alias("content")), lambda raw: tiff.decode_chunk(raw, 16, 16, np.dtype(np.uint8), 8, 2))


_BOX = (20.0, 20.0, 40.0, 40.0)


@query(f"""WITH {V.SHAPES}, b AS (SELECT id, rise, min(px) AS x0, max(px) AS x1, min(py) AS y0, max(py) AS y1, count(*) AS n FROM edges GROUP BY id, rise)
SELECT id % 25 AS file, id, n, CAST(rise AS VARCHAR) AS height, x1 - x0 AS wide FROM b WHERE x0 <= 40 AND x1 >= 20 AND y0 <= 40 AND y1 >= 20""")
def flatgeobuf_box(spark, sf):
    """Polygons written to indexed files, one of 25 each, and asked for by a box."""
    s = V.shapes(spark, sf).withColumn("file", F.col("id") % 25)

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        polygons = [({"id": str(i), "height": str(r)}, [(p["px"], p["py"]) for p in ring], [], None) for i, r, ring in sorted(zip(pdf["id"], pdf["rise"], pdf["ring"], strict=True), key=lambda t: t[0])]
        return pd.DataFrame({"file": [pdf["file"].iloc[0]], "content": [flatgeobuf.write(polygons, 4)]})

    def run(batches):
        for pdf in batches:
            for file, content in zip(pdf["file"], pdf["content"], strict=True):
                found = flatgeobuf.read(bytes(content), _BOX)
                rows = [(file, int(t["id"]), len(ring), t["height"], max(x for x, _ in ring) - min(x for x, _ in ring)) for t, ring, _, _ in found]
                yield pd.DataFrame(rows, columns=["file", "id", "n", "height", "wide"])

    ship_package(spark)
    return s.groupBy("file").applyInPandas(build, "file bigint, content binary").mapInPandas(run, "file bigint, id bigint, n bigint, height string, wide double")


@query("""WITH t AS (SELECT s_suppkey AS id, s_suppkey % 5 AS k, s_suppkey % 3 + 1 AS n FROM supplier)
SELECT id, CASE WHEN k IN (0, 1) THEN 'wood' ELSE 'managed' END AS kind, n AS rings, n * 4 AS vertices FROM t WHERE k <> 4""")
def forest_tiles(spark, sf):
    """Woods of land cover, managed forests of parks, and what is neither."""
    ship_package(spark)
    layer = {0: ("landcover", "wood"), 1: ("landcover", "wood"), 2: ("park", "state_forest"), 3: ("park", "forest"), 4: ("landcover", "grass")}

    def run(batches):
        for pdf in batches:
            rows = []
            for k in pdf["id"]:
                name, cls = layer[k % 5]
                rings = [[(j * 100, 0), (j * 100 + 90, 0), (j * 100 + 90, 90), (j * 100, 90)] for j in range(k % 3 + 1)]
                for kind, found in mvt.forests(mvt.encode_layer(name, [({"class": cls}, rings)]), 12, 2100 + k % 7, 1400):
                    rows.append((k, kind, len(found), sum(map(len, found))))
            yield pd.DataFrame(rows, columns=["id", "kind", "rings", "vertices"])

    return V.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id")).mapInPandas(run, "id bigint, kind string, rings bigint, vertices bigint")


@query("""SELECT s_suppkey AS id, CAST(s_suppkey % 4 + 1 AS BIGINT) AS buildings, 'building:' || (s_suppkey % 4 + 1) || ',park:' || (s_suppkey % 3) AS layers FROM supplier""")
def raw_counts(spark, sf):
    ship_package(spark)

    @F.pandas_udf("binary")
    def tile(key: pd.Series) -> pd.Series:
        square = [[(0, 0), (9, 0), (9, 9), (0, 9)]]
        return key.map(lambda k: mvt.encode_layer("building", [({}, square)] * (k % 4 + 1)) + mvt.encode_layer("park", [({}, square)] * (k % 3)))

    made = V.table(spark, sf, "supplier").select(F.lit(14).alias("z"), F.col("s_suppkey").cast("int").alias("x"), F.lit(0).alias("y"), tile("s_suppkey").alias("content"))
    return readers.raw_features(made).select(F.col("x").cast("bigint").alias("id"), "buildings", F.array_join("layers", ",").alias("layers"))


@query(f"""WITH {V.SHAPES}, p AS (SELECT id, i, printf('[%.7f,%.7f]', px / 7, py / 9) AS t FROM verts), r AS (SELECT id, string_agg(t, ',' ORDER BY i) AS ring, arg_min(t, i) AS head FROM p GROUP BY id)
SELECT id, '{{"type":"Feature","properties":{{"height":' || printf('%.1f', CAST(rise / 2.0 AS DOUBLE)) || '}},"geometry":{{"type":"Polygon","coordinates":[[' || ring || ',' || head || ']]}}}}' AS feature FROM r JOIN base USING (id)""")
def geojson_features(spark, sf):
    s = V.shapes(spark, sf)
    ext = F.transform("ring", lambda p: F.struct((p["px"] / 7).alias("lon"), (p["py"] / 9).alias("lat")))
    return s.select("id", sinks.geojson_feature(ext, F.col("rise") / 2.0).alias("feature"))


@query("""WITH s AS (SELECT s_suppkey AS k, format('raster_{}.tif', s_suppkey) AS path FROM supplier)
SELECT path, k % 5 <> 0 AS ok, CASE WHEN k % 5 = 0 THEN 'truncated directory' END AS reason, CASE WHEN k % 5 <> 0 THEN CAST(48 AS BIGINT) END AS width, CASE WHEN k % 5 <> 0 THEN CAST(40 AS BIGINT) END AS height,
CASE WHEN k % 5 <> 0 THEN 'uint8' END AS dtype, CASE WHEN k % 5 <> 0 THEN 'deflate' END AS compression, CASE WHEN k % 5 <> 0 THEN CAST(4326 AS BIGINT) END AS epsg, CASE WHEN k % 5 <> 0 THEN CAST(1 AS BIGINT) END AS overviews, CASE WHEN k % 5 <> 0 THEN CAST(k AS DOUBLE) END AS west FROM s""")
def probe_headers(spark, sf):
    """Some facts of the headers that probe_facts() gives in full."""
    from .vector_queries import probe_facts

    return probe_facts(spark, sf).select("path", "ok", "reason", "width", "height", "dtype", "compression", "epsg", "overviews", F.element_at("geotransform", 1).alias("west"))


@query("""WITH s AS (SELECT s_suppkey AS k, format('raster_{}.tif', s_suppkey) AS path FROM supplier)
SELECT path, CASE k % 4 WHEN 1 THEN 'an image, not an elevation raster: elevation has one band' WHEN 2 THEN 'no geotransform; one is never made up from a file name' END AS error, CASE WHEN k % 4 IN (0, 3) THEN CAST(30 AS BIGINT) END AS width,
CASE WHEN k % 4 IN (0, 3) THEN k - CASE WHEN k % 4 = 3 THEN 0.125::DOUBLE ELSE 0.0::DOUBLE END END AS west, CASE WHEN k % 4 IN (0, 3) THEN -9999.0::DOUBLE END AS nodata, CASE WHEN k % 4 IN (0, 3) THEN 0.5::DOUBLE END AS scale FROM s""")
def terrain_headers(spark, sf):
    """Rasters of which some have three bands, some no georeference, and some name the middle of their first pixel."""
    ship_package(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            raw = bytearray(tiff.write_tiled(np.ones((20, 30), np.int16), 16, [k, 0.25, 0, 50, 0, -0.25], "-9999", scale=(0.5, 10.0)))
            at = int.from_bytes(raw[8:16], "little")
            for i in range(int.from_bytes(raw[at : at + 8], "little")):
                e = at + 8 + 20 * i
                tag = int.from_bytes(raw[e : e + 2], "little")
                if k % 4 == 1 and tag == 277:
                    raw[e + 12 : e + 14] = (3).to_bytes(2, "little")
                if k % 4 == 2 and tag == 33922:
                    raw[e : e + 2] = (33923).to_bytes(2, "little")
                if k % 4 == 3 and tag == 34735:
                    place = int.from_bytes(raw[e + 12 : e + 20], "little")
                    raw[place + 22 : place + 24] = (2).to_bytes(2, "little")
            return bytes(raw)

        return key.map(one)

    s = V.table(spark, sf, "supplier").select(F.format_string("raster_%d.tif", "s_suppkey").alias("path"), made("s_suppkey").alias("content"))
    return readers.source_headers(s).select("path", "error", "width", "west", "nodata", "scale")


@query("""WITH t AS (SELECT s_suppkey AS id, CASE s_suppkey % 6 WHEN 0 THEN '<M><Item name="SCALE" sample="0" role="scale">0.5</Item><Item name="OFFSET" sample="0" role="offset">' || s_suppkey || '</Item></M>' WHEN 1 THEN '<M><Item name="scale" sample="0">0.25</Item></M>'
 WHEN 2 THEN '<M><Item name="SCALE" sample="1" role="scale">9</Item><Item name="SCALE">7</Item></M>' WHEN 3 THEN '<M><Item name="SCALE" sample="0" role="scale">1</Item></M>' WHEN 4 THEN '<M><Item name="X" sample="0" role="Offset"> 4 </Item><Item name="Y" sample="0" role="offset">6</Item></M>' ELSE '' END AS xml FROM supplier),
i AS (SELECT id, unnest(regexp_extract_all(xml, '<Item([^>]*[^>/])>([^<]*)</Item>', 1)) AS head, unnest(regexp_extract_all(xml, '<Item([^>]*[^>/])>([^<]*)</Item>', 2)) AS value, unnest(range(len(regexp_extract_all(xml, '<Item([^>]*[^>/])>([^<]*)</Item>', 1)))) AS k FROM t),
r AS (SELECT id, k, lower(coalesce(nullif(regexp_extract(head, 'role="([^"]*)"', 1), ''), regexp_extract(head, 'name="([^"]*)"', 1))) AS role, CAST(trim(value) AS DOUBLE) AS v FROM i WHERE contains(head, 'sample="0"')),
p AS (SELECT id, coalesce(arg_max(v, k) FILTER (role = 'scale'), 1.0::DOUBLE) AS scale, coalesce(arg_max(v, k) FILTER (role = 'offset'), 0.0::DOUBLE) AS "offset" FROM r GROUP BY id)
SELECT t.id, CASE WHEN scale <> 1 OR "offset" <> 0 THEN scale END AS scale, CASE WHEN scale <> 1 OR "offset" <> 0 THEN "offset" END AS "offset" FROM t LEFT JOIN p USING (id)""")
def scale_items(spark, sf):
    k = F.col("s_suppkey")
    item = lambda name, rest, value: F.concat(F.lit(f'<Item name="{name}"{rest}>'), value if not isinstance(value, str) else F.lit(value), F.lit("</Item>"))
    whole = lambda *items: F.concat(F.lit("<M>"), *items, F.lit("</M>"))
    xml = (
        F.when(k % 6 == 0, whole(item("SCALE", ' sample="0" role="scale"', "0.5"), item("OFFSET", ' sample="0" role="offset"', k.cast("string"))))
        .when(k % 6 == 1, whole(item("scale", ' sample="0"', "0.25")))
        .when(k % 6 == 2, whole(item("SCALE", ' sample="1" role="scale"', "9"), item("SCALE", "", "7")))
        .when(k % 6 == 3, whole(item("SCALE", ' sample="0" role="scale"', "1")))
        .when(k % 6 == 4, whole(item("X", ' sample="0" role="Offset"', " 4 "), item("Y", ' sample="0" role="offset"', "6")))
        .otherwise("")
    )
    return V.table(spark, sf, "supplier").select(k.alias("id"), text.scale_and_offset(xml).alias("s")).select("id", "s.*")


@query(f"""WITH {V.ELEV} SELECT event_id, CASE WHEN v = 0 THEN 0 ELSE 1 END AS of_bit, greatest(least(v, 255), 0) AS of_short,
CASE WHEN CAST(metres AS FLOAT) <= -5000 THEN 0 ELSE CAST(trunc(greatest(least(CAST((CAST(metres AS FLOAT) - (-150.0)::FLOAT) / 0.5::FLOAT AS FLOAT), 255.0::FLOAT), 0.0::FLOAT)) AS INT) END AS of_float FROM elev""")
def coverage_bytes(spark, sf):
    of = E.coverage_byte_of
    return V.elev(spark, sf).select("event_id", of(F.col("v"), 1).alias("of_bit"), of(F.col("v"), 16).alias("of_short"), of(F.col("metres"), 32, 0.5, -150.0).alias("of_float"))
