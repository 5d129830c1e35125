"""Queries of resampling, fetch planning and bookkeeping, and round trips through the file formats, with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import elevation as E
from gridloom.functions import grids as G
from gridloom.functions import text
from gridloom.operators import mosaic, pruning, quadtree, resample, runs
from gridloom.runtime import ship_package
from gridloom.sources import containers, mvt, png, readers, sinks, tiff

from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}
STALL_LINES = 5  #: stalled tiles that a run lists, a fixed value
STALL_S = 5.0  #: seconds without a byte from which a tile counts as stalled
DEGRADED_LIST_CAP = 20_000  #: lines that a run lists before it only counts the rest, a fixed value


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query("""WITH l AS (SELECT l_suppkey AS id, list(CAST(l_quantity * 3.7::DOUBLE - 60 AS FLOAT) ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS vs FROM lineitem GROUP BY 1),
m AS (SELECT id, CAST(list_reduce(list_prepend(0::FLOAT, vs), lambda a, b: CAST(a + b AS FLOAT)) * CAST(1::FLOAT / CAST(len(vs) AS FLOAT) AS FLOAT) AS FLOAT) AS m FROM l)
SELECT id, CAST(trunc(greatest(least(CAST(m * 2::FLOAT + CASE WHEN m * 2::FLOAT >= 0 THEN 0.5::FLOAT ELSE -0.5::FLOAT END AS DOUBLE), 32767.0::DOUBLE), -32768.0::DOUBLE)) AS INT) AS half FROM m""")
def float_mean(spark, sf):
    v = (F.col("l_quantity") * F.lit(3.7) - 60).cast("float")
    key = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", v.alias("v"))
    li = V.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.array_sort(F.collect_list(key)).alias("s"))
    return li.select("id", resample.float_mean(F.transform("s", lambda s: s["v"])).cast("int").alias("half"))


_SPAN = """(SELECT x, lo, hi, greatest(CAST(floor(lo + 0.5::DOUBLE + 1e-9::DOUBLE) AS BIGINT), 0) AS a, least(greatest(CAST(floor(hi + 0.5::DOUBLE + 1e-9::DOUBLE) AS BIGINT), 0), {n}) AS b, (lo + hi) * 0.5::DOUBLE AS c
FROM (SELECT x, ({left}::DOUBLE + x * {step}::DOUBLE - 0.0::DOUBLE) / 1.0::DOUBLE AS lo, ({left}::DOUBLE + (x + 1) * {step}::DOUBLE - 0.0::DOUBLE) / 1.0::DOUBLE AS hi FROM (SELECT unnest(range({size})) AS x)))"""
_PICK = "SELECT x, CAST(CASE WHEN a < b THEN a WHEN c >= 0 AND floor(c) < {n} THEN floor(c) ELSE 0 END AS BIGINT) AS first, CAST(CASE WHEN a < b THEN b WHEN c >= 0 AND floor(c) < {n} THEN floor(c) + 1 ELSE 0 END AS BIGINT) AS last FROM "


def _spans(left, step, size, n):
    return _PICK.format(n=n) + _SPAN.format(left=left, step=step, size=size, n=n)


@query(_spans("-1.25", "0.7", 100, 64))
def x_span_table(spark, sf):
    return resample.column_spans(100, -1.25, 0.7, 0.0, 1.0, 64, spark)


@query(f"""WITH {V.PROFILE}, cs AS ({_spans("-1.25", "2.5", 28, 64)}), rs AS ({_spans("0.0", "1.75", 20, 32)}),
j AS (SELECT cs.x AS ox, rs.x AS oy, list(CAST(v * 1.7::DOUBLE AS FLOAT) ORDER BY p.y, p.x) AS vs FROM profile p JOIN cs ON p.x >= cs.first AND p.x < cs.last JOIN rs ON p.y >= rs.first AND p.y < rs.last WHERE v > -11000 GROUP BY 1, 2),
m AS (SELECT ox, oy, CASE WHEN len(vs) = 1 THEN vs[1] ELSE CAST(list_reduce(list_prepend(0::FLOAT, vs), lambda a, b: CAST(a + b AS FLOAT)) * CAST(1::FLOAT / CAST(len(vs) AS FLOAT) AS FLOAT) AS FLOAT) END AS m FROM j)
SELECT cs.x AS ox, rs.x AS oy, CASE WHEN m.m IS NULL THEN -9999 ELSE CAST(trunc(greatest(least(CAST(m.m * 2::FLOAT + CASE WHEN m.m * 2::FLOAT >= 0 THEN 0.5::FLOAT ELSE -0.5::FLOAT END AS DOUBLE), 32767.0::DOUBLE), -32768.0::DOUBLE)) AS INT) END AS half FROM cs CROSS JOIN rs LEFT JOIN m ON m.ox = cs.x AND m.oy = rs.x""")
def xyz_assembly(spark, sf):
    cols = resample.column_spans(28, -1.25, 2.5, 0.0, 1.0, 64, spark).withColumnRenamed("x", "ox")
    rows = resample.column_spans(20, 0.0, 1.75, 0.0, 1.0, 32, spark).withColumnRenamed("x", "oy")
    p = V.profile(spark, sf)
    metres = p.withColumn("v", F.when(F.col("v") > -11000, F.col("v") * 1.7).otherwise(F.col("v")))
    return resample.assembled(metres, cols, rows).withColumn("half", F.col("half").cast("int"))


@query("""WITH a AS (SELECT l_suppkey % 7 AS child, l_orderkey % 16 AS x, l_partkey % 16 AS y, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT unnest(range(16)) AS px), q AS (SELECT unnest(range(16)) AS py), t AS (SELECT child, px, py FROM (SELECT DISTINCT child FROM a), p, q)
SELECT t.child, t.px, t.py, a.v FROM t JOIN a ON a.child = t.child AND a.x = (t.child * 16 + t.px) // 4 - t.child // 4 * 16 AND a.y = ((t.child + 1) * 16 + t.py) // 4 - (t.child + 1) // 4 * 16""")
def upsample_child(spark, sf):
    li = V.table(spark, sf, "lineitem")
    a = li.groupBy((F.col("l_suppkey") % 7).alias("child"), (F.col("l_orderkey") % 16).alias("x"), (F.col("l_partkey") % 16).alias("y")).agg(F.max("l_quantity").alias("v"))
    return resample.upsampled(a, 16, 2, F.col("child"), F.col("child") + 1)


@query("""WITH w AS (SELECT o_orderkey AS id, o_orderkey % 900 AS x0, o_orderkey % 900 + o_custkey % 200 AS x1, o_custkey % 700 AS y0, o_custkey % 700 + o_orderkey % 90 AS y1 FROM orders),
c AS (SELECT id, unnest(range(x0 // 64, (x1 - 1) // 64 + 1)) AS cx, y0, y1 FROM w WHERE x0 < x1 AND y0 < y1), d AS (SELECT id, cx, unnest(range(y0 // 64, (y1 - 1) // 64 + 1)) AS cy FROM c)
SELECT id, cy * 20 + cx AS chunk FROM d""")
def window_chunks(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = V.table(spark, sf, "orders")
    w = o.select(k.alias("id"), (k % 900).alias("x0"), (k % 900 + c % 200).alias("x1"), (c % 700).alias("y0"), (c % 700 + k % 90).alias("y1"))
    return resample.window_chunks(w, 64, 20)


@query("""WITH r AS (SELECT o_custkey % 17 AS file, o_orderkey * 40 AS start, o_orderkey * 40 + o_custkey % 100 AS stop FROM orders),
n AS (SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY file ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 256 THEN 0 ELSE 1 END AS new FROM r),
g AS (SELECT *, sum(new) OVER (PARTITION BY file ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS run FROM n)
SELECT file, CAST(run AS BIGINT) AS run, min(start) AS start, max(stop) AS stop, count(*) AS n FROM g GROUP BY file, run""")
def read_runs(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    r = V.table(spark, sf, "orders").select((c % 17).alias("file"), (k * 40).alias("start"), (k * 40 + c % 100).alias("stop"))
    return resample.read_runs(r, 256)


_ROWS = "r AS (SELECT l_orderkey AS k, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS i, l_partkey % 256 AS d, l_suppkey % 50 AS e FROM lineitem)"


def _rows(spark, sf):
    li = V.table(spark, sf, "lineitem")
    i = F.col("l_linenumber").cast("bigint") * 10**9 + F.col("l_partkey") * 1000 + F.col("l_suppkey")
    return li.select(F.col("l_orderkey").alias("k"), i.alias("i"), (F.col("l_partkey") % 256).alias("d"), (F.col("l_suppkey") % 50).alias("e"))


@query(f"WITH {_ROWS} SELECT k, i, CAST(sum(d) OVER (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING) % 256 AS BIGINT) AS v FROM r")
def predictor_undo(spark, sf):
    return resample.undo_differences(_rows(spark, sf), "k", 8).select("k", "i", "v")


@query(f"""WITH {_ROWS}, z AS (SELECT k, i, CASE WHEN d % 2 = 0 THEN d // 2 ELSE -((d + 1) // 2) END AS dx, CASE WHEN e % 2 = 0 THEN e // 2 ELSE -((e + 1) // 2) END AS dy FROM r)
SELECT k, i, CAST(sum(dx) OVER o AS BIGINT) AS px, CAST(sum(dy) OVER o AS BIGINT) AS py FROM z WINDOW o AS (PARTITION BY k ORDER BY i ROWS UNBOUNDED PRECEDING)""")
def delta_vertices(spark, sf):
    steps = _rows(spark, sf).withColumnsRenamed({"d": "dx", "e": "dy"})
    return resample.moved_vertices(steps, "k").select("k", "i", "px", "py")


_BOX = "b AS (SELECT c_nationkey AS job, min(c_custkey % 40 * 0.25::DOUBLE) AS w, max(c_custkey % 40 * 0.25::DOUBLE + 0.5::DOUBLE) AS e, min(40 + c_custkey % 20 * 0.25::DOUBLE) AS s, max(40 + c_custkey % 20 * 0.25::DOUBLE + 0.5::DOUBLE) AS n FROM customer GROUP BY 1)"
_TX, _TY = "CAST(greatest(floor(({} + 180.0::DOUBLE) / 360.0::DOUBLE * 1024), 0) AS BIGINT)", "CAST(greatest(floor((1.0::DOUBLE - asinh(tan(radians({}))) / pi()) / 2.0::DOUBLE * 1024), 0) AS BIGINT)"


@query(f"""WITH {_BOX}, r AS (SELECT job, greatest({_TX.format('w')}, {_TX.format('2.0::DOUBLE')}) AS x0, least({_TX.format('e')}, {_TX.format('8.0::DOUBLE')}) AS x1, greatest({_TY.format('n')}, {_TY.format('44.0::DOUBLE')}) AS y0, least({_TY.format('s')}, {_TY.format('41.0::DOUBLE')}) AS y1 FROM b)
SELECT job, x0, x1, y0, y1 FROM r WHERE x0 <= x1 AND y0 <= y1""")
def fetch_rect(spark, sf):
    k, z = F.col("c_custkey"), F.lit(10)
    west, south = k % 40 * F.lit(0.25), 40 + k % 20 * F.lit(0.25)
    b = V.table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("job")).agg(F.min(west).alias("w"), F.max(west + 0.5).alias("e"), F.min(south).alias("s"), F.max(south + 0.5).alias("n"))
    roi = G.tile_rectangle(F.lit(41.0), F.lit(44.0), F.lit(2.0), F.lit(8.0), z)
    own = G.tile_rectangle(F.col("s"), F.col("n"), F.col("w"), F.col("e"), z)
    r = b.select("job", own.alias("own"), roi.alias("roi")).select("job", G.common_rectangle(F.col("own"), F.col("roi")).alias("r"))
    return r.where("r is not null").select("job", "r.*")


@query("""WITH f AS (SELECT o_orderkey % 13 AS job, o_orderstatus AS status, CASE WHEN o_custkey % 3 = 0 THEN 10 - o_orderkey % 4 END AS filled_zoom, o_custkey % 200 AS cells, 256 + o_orderkey % 13 // 12 * o_custkey % 2 AS edge FROM orders)
SELECT job, count(*) AS tiles, count(*) FILTER (status = 'F') AS failed, count(filled_zoom) AS filled, min(filled_zoom) AS coarsest, CAST(sum(cells) AS BIGINT) AS cells, count(DISTINCT edge) = 1 AS one_edge FROM f GROUP BY job""")
def batch_tally(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    f = V.table(spark, sf, "orders").select((k % 13).alias("job"), (F.col("o_orderstatus") == "F").alias("failed"), F.when(c % 3 == 0, 10 - k % 4).alias("filled_zoom"), (c % 200).alias("cells"), (256 + F.floor(k % 13 / 12) * c % 2).alias("edge"))
    return runs.batch_tally(f, "job")


@query("""WITH t AS (SELECT o_orderkey AS id, format('[Degraded] z=12 x={} y={} reason={} filled_from=z{}', o_orderkey % 64, o_custkey % 64, CASE o_orderkey % 3 WHEN 0 THEN 'timeout' WHEN 1 THEN 'http_503' ELSE 'decode' END, 12 - o_custkey % 5) AS line FROM orders)
(SELECT id, line FROM t ORDER BY id LIMIT 20000) UNION ALL SELECT NULL, format('[Degraded] … {} more not listed', count(*) - 20000) FROM t HAVING count(*) > 20000""")
def degraded_lines(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    why = F.when(k % 3 == 0, "timeout").when(k % 3 == 1, "http_503").otherwise("decode")
    lines = V.table(spark, sf, "orders").select(k.alias("id"), text.degraded_line(F.lit(12), k % 64, c % 64, why, 12 - c % 5).alias("line"))
    return runs.capped_lines(lines, DEGRADED_LIST_CAP, "[Degraded] … %d more not listed")


@query("""WITH t AS (SELECT o_orderkey AS id, format('[Download] STALL tile z=12/x={}/y={}: first byte after {:.1f}s, longest body gap {:.1f}s', o_orderkey % 64, o_custkey % 64, o_orderkey % 300 / 8.0::DOUBLE, o_custkey % 50 / 4.0::DOUBLE) AS line FROM orders WHERE o_orderkey % 300 > 40)
(SELECT id, line FROM t ORDER BY id LIMIT 5) UNION ALL SELECT NULL, '[Download] (suppressing further stall warnings; [Stats] STALL counts them all)' FROM t HAVING count(*) > 5""")
def stall_lines(spark, sf):
    """The first five stalled tiles and the note that stands for the rest."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = V.table(spark, sf, "orders").where(k % 300 / F.lit(8.0) > STALL_S)
    lines = t.select(k.alias("id"), text.stall_line(F.lit(12), k % 64, c % 64, k % 300 / F.lit(8.0), c % 50 / F.lit(4.0)).alias("line"))
    return runs.capped_lines(lines, STALL_LINES, "[Download] (suppressing further stall warnings; [Stats] STALL counts them all)")


_FILLS = "t AS (SELECT o_orderkey AS id, o_custkey % 7 AS job, o_orderkey % 300 AS void, o_orderkey % 300 * (o_custkey % 3) // 4 AS left_, o_orderkey % 300 // 3 AS seam, o_orderkey % 300 * (o_custkey % 3) // 4 // 3 AS seam_left, o_orderkey % 64 AS x, o_custkey % 64 AS y FROM orders)"


def _fills(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    void = k % 300
    left = F.floor(void * (c % 3) / 4)
    return V.table(spark, sf, "orders").select(k.alias("id"), (c % 7).alias("job"), void.alias("void"), left.alias("left"), F.floor(void / 3).alias("seam"), F.floor(left / 3).alias("seam_left"), (k % 64).alias("x"), (c % 64).alias("y"))


@query(f"""WITH {_FILLS} SELECT id, format('[Backfill] z=15 x={{}} y={{}}: {{}} void px ({{}} seam), {{}} filled{{}}, {{}} left void', x, y, void, seam, void - left_, CASE WHEN void > left_ THEN format(' (z13 {{}}, z12 {{}})', (void - left_) - (void - left_) // 3, (void - left_) // 3) ELSE '' END, left_) AS line
FROM t WHERE void > 0 ORDER BY id LIMIT 20000""")
def backfill_lines(spark, sf):
    t = _fills(spark, sf).where("void > 0")
    n = F.col("void") - F.col("left")
    part = lambda z, v: F.struct(F.lit(z).alias("zoom"), v.alias("n"))
    filled = F.when(n > 0, F.array(part(13, n - F.floor(n / 3)), part(12, F.floor(n / 3)))).otherwise(F.array().cast("array<struct<zoom:int,n:bigint>>"))
    line = text.backfill_line(F.lit(15), F.col("x"), F.col("y"), F.col("void"), F.col("seam"), F.col("left"), filled)
    # what goes beyond the cap is only counted, by backfill_stats
    return runs.capped_lines(t.select("id", line.alias("line")), DEGRADED_LIST_CAP, "%d").where("id is not null")


@query(f"""WITH {_FILLS} SELECT job, count(*) FILTER (void > left_) AS tiles, CAST(coalesce(sum(void - left_) FILTER (void > left_), 0) AS BIGINT) AS px, CAST(coalesce(sum(greatest(seam - seam_left, 0)) FILTER (void > left_), 0) AS BIGINT) AS seam_px,
count(*) FILTER (left_ > 0) AS left_tiles, CAST(sum(left_) AS BIGINT) AS left_px, CAST(coalesce(sum(seam_left) FILTER (left_ > 0), 0) AS BIGINT) AS left_seam_px FROM t GROUP BY job""")
def backfill_stats(spark, sf):
    return runs.backfill_tally(_fills(spark, sf), "job")


@query("""WITH j AS (SELECT c_custkey AS job, CASE WHEN c_custkey % 3 = 1 THEN ['own_' || c_custkey] END AS own, CASE WHEN c_custkey % 3 <> 1 THEN 'base_' || c_custkey END AS base, CASE WHEN c_custkey % 3 = 0 THEN ['swiss_a', 'swiss_b'] END AS extra FROM customer),
s AS (SELECT job, CASE WHEN own IS NOT NULL THEN own ELSE list_concat(CASE WHEN base IS NULL THEN [] ELSE [base] END, coalesce(extra, [])) END AS src FROM j) SELECT job, len(src) AS n, array_to_string(src, ',') AS paths FROM s""")
def job_sources(spark, sf):
    k = F.col("c_custkey")
    own = F.when(k % 3 == 1, F.array(F.concat(F.lit("own_"), k)))
    base = F.when(k % 3 != 1, F.concat(F.lit("base_"), k))
    extra = F.when(k % 3 == 0, F.array(F.lit("swiss_a"), F.lit("swiss_b")))
    src = runs.effective_sources(own, base, extra)
    j = V.table(spark, sf, "customer").select(k.alias("job"), src.alias("src"))
    return j.select("job", F.size("src").cast("bigint").alias("n"), F.array_join("src", ",").alias("paths"))


@query("""WITH c AS (SELECT o_custkey % 40 AS poly, o_orderkey % 32 AS sub, CAST(o_orderkey % 61 AS DOUBLE) + 0.25 AS cx FROM orders GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY poly, sub ORDER BY cx) AS k, lead(cx) OVER (PARTITION BY poly, sub ORDER BY cx) AS nx FROM c),
s AS (SELECT poly, sub, unnest(range(CAST(ceil(cx - 0.5) AS BIGINT), CAST(ceil(nx - 0.5) AS BIGINT))) AS x FROM w WHERE k % 2 = 1 AND nx IS NOT NULL)
SELECT poly, x, sub // 4 AS y, count(*) / 4.0::DOUBLE AS alpha FROM s GROUP BY 1, 2, 3""")
def canopy_alpha(spark, sf):
    from gridloom.operators import vector

    o = V.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("poly"), (F.col("o_orderkey") % 32).alias("y"), ((F.col("o_orderkey") % 61).cast("double") + 0.25).alias("cx")).distinct()
    s = vector.scanline_cells(o)
    return s.groupBy("poly", "x", F.floor(F.col("y") / 4).alias("y")).agg((F.count(F.lit(1)) / F.lit(4.0)).alias("alpha"))


# round trips through the formats: what is written per raster or tile is read back as cells


def _rasters_of(cells, build):
    """One file per source from its cells on the 64 x 32 grid."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        grid = np.zeros((32, 64), np.uint8)
        grid[pdf["y"], pdf["x"]] = pdf["raw"]
        return pd.DataFrame({"src": [pdf["src"].iloc[0]], "content": [build(grid)]})

    ship_package(cells.sparkSession)
    return cells.groupBy("src").applyInPandas(run, "src bigint, content binary")


def _cells_of(files, parse):
    def run(batches):
        for pdf in batches:
            for src, content in zip(pdf["src"], pdf["content"], strict=True):
                grid = parse(content)
                y, x = np.nonzero(grid)
                yield pd.DataFrame({"src": src, "x": x, "y": y, "raw": grid[y, x].astype(np.int32)})

    return files.mapInPandas(run, "src bigint, x bigint, y bigint, raw int")


_SIDE = '{"dimensions": {"width": 64, "height": 32}, "geotransform": [0, 1, 0, 0, 0, -1], "tile_size": 16, "output_format": "%s"}'


@query(f"WITH {V.CELLS} SELECT src, x, y, raw FROM cells WHERE raw <> 0")
def coverage_roundtrip(spark, sf):
    made = _rasters_of(V.cells(spark, sf), lambda g: containers.write_coverage(g, 16, 8))
    return _cells_of(made, lambda raw: containers.read_coverage(raw, _SIDE % "8BIT").window(0, 0, 64, 32))


@query(f"WITH {V.CELLS} SELECT src, x, y, 1 AS raw FROM cells WHERE raw <> 0")
def one_bit_roundtrip(spark, sf):
    made = _rasters_of(V.cells(spark, sf), lambda g: containers.write_coverage(g, 16, 1))
    return _cells_of(made, lambda raw: containers.read_coverage(raw, _SIDE % "1BIT_LOS").window(0, 0, 64, 32))


@query(f"WITH {V.CELLS} SELECT src, x, y, raw FROM cells WHERE raw <> 0 AND x >= 7 AND x < 50 AND y >= 3 AND y < 30")
def tiff_window(spark, sf):
    made = _rasters_of(V.cells(spark, sf), lambda g: tiff.write_tiled(g, 16, [0, 1, 0, 0, 0, -1], "0"))

    def parse(raw):
        out = np.zeros((32, 64), np.uint8)
        out[3:30, 7:50] = tiff.read_window(raw, tiff.read_header(raw), 7, 3, 43, 27)
        return out

    return _cells_of(made, parse)


@query(f"""WITH {V.ELEV}, t AS (SELECT gx // 16 AS tile, gx % 16 AS x, gy % 16 AS y, min(v) AS v FROM elev GROUP BY 1, 2, 3), a AS (SELECT tile, x, y FROM (SELECT DISTINCT tile FROM t), (SELECT unnest(range(16)) AS x), (SELECT unnest(range(16)) AS y))
SELECT a.tile, a.x, a.y, CAST(coalesce(v, -9999) AS INT) AS v FROM a LEFT JOIN t USING (tile, x, y)""")
def elevation_roundtrip(spark, sf):
    e = V.elev(spark, sf).groupBy(F.floor(F.col("gx") / 16).alias("tile"), (F.col("gx") % 16).alias("x"), (F.col("gy") % 16).alias("y")).agg(F.min("v").alias("v"))
    made = sinks.elevation_tiles(e.withColumns({"ul_lat": F.lit(47.5), "ul_lon": F.lit(8.0)}), 16, 0.001)

    def run(batches):
        for pdf in batches:
            for tile, raw in zip(pdf["tile"], pdf["payload"], strict=True):
                t = containers.read_elevation(raw)
                y, x = np.divmod(np.arange(256), 16)
                yield pd.DataFrame({"tile": tile, "x": x, "y": y, "v": t.cells.ravel().astype(np.int32)})

    return made.mapInPandas(run, "tile bigint, x bigint, y bigint, v int")


@query("SELECT s_suppkey AS id, 8 AS edge, CAST(s_suppkey % 200 * 256 - 32768 AS DOUBLE) AS first, CAST(s_suppkey % 200 * 256 + 63 - 32768 AS DOUBLE) AS last FROM supplier")
def rgb_image_tiles(spark, sf):
    ship_package(spark)

    @F.pandas_udf("binary")
    def image(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            rgb = np.zeros((8, 8, 3), np.uint8)
            rgb[..., 0], rgb[..., 1] = k % 200, np.arange(64).reshape(8, 8)
            return png.encode(rgb)

        return key.map(one)

    s = V.table(spark, sf, "supplier")
    made = s.select(F.col("s_suppkey").cast("int").alias("x"), F.lit(0).alias("y"), F.lit(12).alias("z"), image("s_suppkey").alias("content"))
    got = readers.rgb_tiles(made, "terrarium")
    return got.select(F.col("x").cast("bigint").alias("id"), "edge", F.element_at("data", 1).cast("double").alias("first"), F.element_at("data", -1).cast("double").alias("last"))


@query("SELECT s_suppkey AS id, CAST(0 AS BIGINT) AS pos, CAST(4 AS BIGINT) AS corners, CAST(s_suppkey % 2 AS BIGINT) AS holes, CAST(s_suppkey % 30 + 1 AS VARCHAR) || ' m' AS height FROM supplier")
def vector_tile_buildings(spark, sf):
    ship_package(spark)

    @F.pandas_udf("binary")
    def tile(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            outer, hole = [(0, 0), (90, 0), (90, 90), (0, 90)], [(20, 20), (20, 40), (40, 40), (40, 20)]
            return mvt.encode_layer("building", [({"height": f"{k % 30 + 1} m"}, [outer, hole][: 1 + k % 2])])

        return key.map(one)

    s = V.table(spark, sf, "supplier")
    made = s.select(F.lit(14).alias("z"), F.col("s_suppkey").cast("int").alias("x"), F.lit(5700).alias("y"), tile("s_suppkey").alias("content"))
    got = readers.building_rows(made)
    return got.select(F.col("x").cast("bigint").alias("id"), "pos", F.size("ext").cast("bigint").alias("corners"), F.size("holes").cast("bigint").alias("holes"), F.col("tags")["height"].alias("height"))


@query(f"""WITH {V.CELLS}, n AS (SELECT x // 16 AS tx, y // 16 AS ty, (y % 16) * 16 + x % 16 AS cell, src FROM cells WHERE raw <> 0)
SELECT tx, ty, count(*) AS n_ids, string_agg(CAST(src % 65536 AS VARCHAR), ',' ORDER BY cell, {V.PLACE}) AS ids FROM n GROUP BY 1, 2""")
def visibility_index(spark, sf):
    ship_package(spark)
    listed = mosaic.contributors(V.placed_cells(spark, sf))
    v = sinks.visibility_tiles(listed, 16)
    return v.select("tx", "ty", F.size("ids").cast("bigint").alias("n_ids"), F.array_join("ids", ",").alias("ids"))


# cells of tiles of a pyramid


_Z9 = """z9 AS (SELECT x // 4 AS tx, y // 4 AS ty, x % 4 AS px, y % 4 AS py, CASE WHEN (5 * x + 3 * y) % 7 = 0 THEN NULL ELSE max(raw) - 100 END AS v FROM cells GROUP BY x, y)"""


def _z9(spark, sf):
    c = V.cells(spark, sf).groupBy("x", "y").agg((F.max("raw") - 100).cast("double").alias("v"))
    x, y = F.col("x"), F.col("y")
    at = lambda c: F.floor(c / 4)
    return c.select(F.lit(9).alias("z"), at(x).alias("x"), at(y).alias("y"), F.lit(4).alias("edge"), (x % 4).alias("px"), (y % 4).alias("py"), F.when((5 * x + 3 * y) % 7 != 0, F.col("v")).alias("v"))


@query(f"""WITH {V.CELLS}, {_Z9}, o AS (SELECT o_orderkey % 32 AS x, o_custkey % 16 AS y, CASE WHEN (o_orderkey % 32 + o_custkey % 16) % 5 <> 0 THEN max(o_orderkey % 500) END AS v FROM orders GROUP BY 1, 2),
c AS (SELECT c_custkey % 16 AS x, c_custkey * 3 % 8 AS y, max(c_custkey % 300) AS v FROM customer GROUP BY 1, 2)
SELECT z9.tx AS x, z9.ty AS y, z9.px, z9.py, CAST(coalesce(z9.v, o.v, c.v) AS DOUBLE) AS v, CASE WHEN z9.v IS NOT NULL THEN NULL WHEN o.v IS NOT NULL THEN 8 WHEN c.v IS NOT NULL THEN 7 END AS filled_zoom FROM z9
LEFT JOIN o ON o.x = (tx * 4 + px) // 2 AND o.y = (ty * 4 + py) // 2 AND (o.x // 4 + o.y // 4) % 4 <> 0 LEFT JOIN c ON c.x = (tx * 4 + px) // 4 AND c.y = (ty * 4 + py) // 4""")
def fill_cells(spark, sf):
    def level(z, rows, x, y, v):
        c = rows.groupBy(x.alias("cx"), y.alias("cy")).agg(F.max(v).cast("double").alias("v"))
        tx, ty = F.floor(F.col("cx") / 4), F.floor(F.col("cy") / 4)
        edge = F.when((tx + ty) % 4 == 0, 2).otherwise(4) if z == 8 else F.lit(4)
        return c.select(F.lit(z).alias("z"), tx.alias("x"), ty.alias("y"), edge.alias("edge"), (F.col("cx") % 4).alias("px"), (F.col("cy") % 4).alias("py"), "v")

    k, u, c = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_custkey")
    o = level(8, V.table(spark, sf, "orders"), k % 32, u % 16, F.when((k % 32 + u % 16) % 5 != 0, k % 500))
    far = level(7, V.table(spark, sf, "customer"), c % 16, c * 3 % 8, c % 300)
    return quadtree.fill_cells(_z9(spark, sf), o.unionByName(far), 3).select("x", "y", "px", "py", "v", "filled_zoom")


@query(f"""WITH {V.CELLS}, {_Z9}, t AS (SELECT tx, ty, CASE WHEN (7 * tx + 3 * ty) % 11 = 0 THEN 'missing' WHEN (tx + ty) % 13 = 0 THEN '404' ELSE 'ok' END AS status FROM z9 GROUP BY 1, 2),
g AS (SELECT tx // 2 AS x, ty // 2 AS y FROM t WHERE status <> 'missing' GROUP BY 1, 2 HAVING count(*) = 4 AND count(*) FILTER (status = 'ok') > 0),
m AS (SELECT tx // 2 AS x, ty // 2 AS y, tx % 2 * 2 + px // 2 AS px, ty % 2 * 2 + py // 2 AS py, avg(v) AS v FROM z9 JOIN t USING (tx, ty) WHERE status = 'ok' GROUP BY 1, 2, 3, 4)
SELECT g.x, g.y, p.px, q.py, round((m.v + 32768.0::DOUBLE) * 256.0::DOUBLE) / 256.0::DOUBLE - 32768.0::DOUBLE AS v FROM g CROSS JOIN (SELECT unnest(range(4)) AS px) p CROSS JOIN (SELECT unnest(range(4)) AS py) q
LEFT JOIN m ON m.x = g.x AND m.y = g.y AND m.px = p.px AND m.py = q.py""")
def derive_parent_cells(spark, sf):
    c = _z9(spark, sf)
    x, y = F.col("x"), F.col("y")
    status = F.when((7 * x + 3 * y) % 11 == 0, "missing").when((x + y) % 13 == 0, "404").otherwise("ok")
    tiles = c.select("z", "x", "y", "edge").distinct().withColumn("status", status)
    coded = lambda v: E.metres_of_rgb(*E.channels(E.rgb_of_metres(v)))
    return quadtree.derive_parent_cells(tiles, c, coded).select("x", "y", "px", "py", "v")


@query(f"""WITH {V.XYZ}, f AS (SELECT o_orderkey % 500 AS cell, CAST(o_orderkey % 32 AS INT) AS x, CAST(o_custkey % 16 AS INT) AS y FROM orders WHERE o_custkey % 16 < 4),
l AS (SELECT DISTINCT x, y, true AS yes FROM xyz WHERE z = 15 AND status = 'ok'), m AS (SELECT cell, bool_and(coalesce(yes, false)) AS rewrite FROM f LEFT JOIN l USING (x, y) GROUP BY cell),
e AS (SELECT o_orderkey % 500 AS cell, CAST(max(o_custkey) AS BIGINT) AS v FROM orders GROUP BY 1), n AS (SELECT o_custkey % 500 AS cell, CAST(min(o_orderkey) AS BIGINT) AS v FROM orders GROUP BY 1)
SELECT e.cell, CASE WHEN m.rewrite THEN coalesce(n.v, e.v) ELSE e.v END AS v, coalesce(m.rewrite AND n.v IS NOT NULL, false) AS rewritten FROM e LEFT JOIN m USING (cell) LEFT JOIN n USING (cell)""")
def repair_rewrite(spark, sf):
    o = V.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    # a footprint is four rows of tiles high
    feet = o.where(c % 16 < 4).select((k % 500).alias("cell"), (k % 32).cast("int").alias("x"), (c % 16).cast("int").alias("y"))
    old = o.groupBy((k % 500).alias("cell")).agg(F.max(c).cast("bigint").alias("v"))
    new = o.groupBy((c % 500).alias("cell")).agg(F.min(k).cast("bigint").alias("v"))
    return quadtree.repaired(old, new, feet, V.xyz(spark, sf).where("z = 15 and status = 'ok'"))


@query("""WITH i AS (SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS BIGINT) % 60000 - 30000 AS m, o_totalprice / 7 - 20000 AS d FROM orders)
SELECT id, CASE WHEN m = -7 THEN -9999 ELSE CAST(greatest(least(m * 2, 32767), -32768) AS INT) END AS of_int16, CASE WHEN m = -7 OR m * 2 < -9999 THEN -9999 ELSE CAST(least(m * 2, 32767) AS INT) END AS of_int32,
CAST(trunc(greatest(least(CAST(CAST(d AS FLOAT) * 2::FLOAT AS DOUBLE), 32767.0::DOUBLE), -32768.0::DOUBLE)) AS INT) AS of_float32, CAST(trunc(greatest(least(d * 2, 32767.0::DOUBLE), -32768.0::DOUBLE)) AS INT) AS of_float64,
CASE WHEN m % 256 = 100 THEN -9999 ELSE CAST(trunc(greatest(least((m % 256 * 0.5::DOUBLE + 10) * 2, 32767.0::DOUBLE), -32768.0::DOUBLE)) AS INT) END AS of_uint8 FROM i""")
def sample_types(spark, sf):
    m, d = F.col("m"), F.col("d")
    i = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("bigint") % 60000 - 30000).alias("m"), (F.col("o_totalprice") / 7 - 20000).alias("d"))
    of = E.half_metres_of_sample
    got = {"of_int16": of(m.cast("smallint"), "int16", -7), "of_int32": of(m, "int32", -7), "of_float32": of(d, "float32"), "of_float64": of(d, "float64"), "of_uint8": of(m % 256, "uint8", 100, (0.5, 10.0))}
    return i.select("id", *(v.cast("int").alias(k) for k, v in got.items()))


@query("""WITH r AS (SELECT s_suppkey AS pos, s_suppkey % 9 * 1.0::DOUBLE AS w, s_suppkey % 7 * 1.0::DOUBLE AS s, s_suppkey % 9 + s_suppkey % 4 + 1.0::DOUBLE AS e, s_suppkey % 7 + s_suppkey % 3 + 1.0::DOUBLE AS n FROM supplier),
b AS (SELECT n_nationkey AS band, n_nationkey % 8 * 1.0::DOUBLE AS w, n_nationkey % 5 * 1.0::DOUBLE AS s, n_nationkey % 8 + 2.0::DOUBLE AS e, n_nationkey % 5 + 1.0::DOUBLE AS n FROM nation),
c AS (SELECT band, pos, greatest(r.w, b.w) AS w, greatest(r.s, b.s) AS s, least(r.e, b.e) AS e, least(r.n, b.n) AS n FROM r, b)
SELECT band, pos, CASE WHEN pos % 5 = 0 THEN false ELSE NOT (c.w < c.e AND c.s < c.n) OR EXISTS (SELECT 1 FROM r WHERE r.pos < c.pos AND r.pos % 5 <> 0 AND r.w <= c.w AND r.s <= c.s AND r.e >= c.e AND r.n >= c.n) END AS shadowed FROM c""")
def shadowed_sources(spark, sf):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    d = lambda c, name: c.cast("double").alias(name)
    box = F.struct(d(k % 9, "west"), d(k % 7, "south"), d(k % 9 + k % 4 + 1, "east"), d(k % 7 + k % 3 + 1, "north"))
    r = V.table(spark, sf, "supplier").select(k.alias("pos"), F.when(k % 5 != 0, box).alias("box"))
    b = V.table(spark, sf, "nation").select(n.alias("band"), d(n % 8, "west"), d(n % 5, "south"), d(n % 8 + 2, "east"), d(n % 5 + 1, "north"))
    return pruning.shadowed(r, b)


_TILE = "(CAST({x} AS DOUBLE) / 1024 * 360.0::DOUBLE - 180.0::DOUBLE)"
_LAT = "degrees(atan(sinh(pi() * (1.0::DOUBLE - 2.0::DOUBLE * ({y}) / 1024))))"


@query(f"""WITH t AS (SELECT c_custkey AS id, 512 + c_custkey % 64 AS x, 300 + c_custkey % 96 AS y, 40 + c_custkey % 20 * 0.77::DOUBLE AS lat, c_custkey % 40 * 0.53::DOUBLE AS lon FROM customer)
SELECT id, {_TILE.format(x='x')} < lon + 0.5::DOUBLE AND {_TILE.format(x='x + 1')} > lon AND {_LAT.format(y='y + 1')} < lat AND {_LAT.format(y='y')} > lat - 0.5::DOUBLE AS touches,
NOT (lat + 0.2::DOUBLE < 42.0::DOUBLE OR lat > 50.0::DOUBLE OR lon + 0.3::DOUBLE < 5.0::DOUBLE OR lon >= 12.0::DOUBLE) AS holds, 50.0::DOUBLE >= lat AND 42.0::DOUBLE <= lat + 0.2::DOUBLE AND 12.0::DOUBLE >= lon AND 5.0::DOUBLE <= lon + 0.3::DOUBLE AS candidate FROM t""")
def touched_tiles(spark, sf):
    k = F.col("c_custkey")
    t = V.table(spark, sf, "customer").select(k.alias("id"), (512 + k % 64).alias("x"), (300 + k % 96).alias("y"), (40 + k % 20 * F.lit(0.77)).alias("lat"), (k % 40 * F.lit(0.53)).alias("lon"))
    source = F.struct(F.lit(5.0).alias("west"), F.lit(12.0).alias("east"), F.lit(50.0).alias("north"), F.lit(42.0).alias("south"))
    box = F.struct(F.col("lon").alias("min_e"), (F.col("lon") + 0.3).alias("max_e"), F.col("lat").alias("min_n"), (F.col("lat") + 0.2).alias("max_n"))
    touches = pruning.tile_touches(F.col("x"), F.col("y"), F.lit(10), F.col("lat"), F.col("lon"), F.lit(0.5))
    return t.withColumns({"_s": source, "_b": box}).select("id", touches.alias("touches"), pruning.may_hold(F.col("_s"), F.col("_b")).alias("holds"), pruning.row_candidate(F.col("_s"), F.col("_b")).alias("candidate"))


@query("""WITH e AS (SELECT o_orderkey AS id, CAST(o_orderkey % 5 AS INT) AS status, 5000 + o_custkey % 400 AS off, o_orderkey % 300 AS len, o_orderkey % 3 AS crc FROM orders)
SELECT id, (status IN (1, 3) AND len > 0 AND off >= 5138 AND off + len <= 5500) OR (status = 2 AND len = 0 AND crc = 0) AS usable FROM e""")
def usable_entries(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return V.table(spark, sf, "orders").select(k.alias("id"), pruning.usable_entry((k % 5).cast("int"), 5000 + c % 400, k % 300, k % 3, F.lit(5500)).alias("usable"))


@query("""WITH w AS (SELECT p_partkey AS x, p_name AS name FROM part) SELECT x, CAST(CASE WHEN x % 7 = 0 THEN 2 WHEN x % 5 = 0 THEN NULL ELSE 1 END AS INT) AS status, CASE WHEN x % 7 <> 0 AND x % 5 <> 0 THEN name END AS body FROM w""")
def cache_lookup(spark, sf):
    """Bodies with the CRC they were stored with; every fifth has lost a byte, every seventh tile is known to be absent."""
    k, name = F.col("p_partkey"), F.col("p_name").cast("binary")
    gone, torn = k % 7 == 0, k % 5 == 0
    zero = F.lit(0).cast("bigint")
    p = V.table(spark, sf, "part")
    entries = p.select(F.lit(14).alias("z"), k.alias("x"), F.lit(1).alias("y"), F.when(gone, 2).otherwise(1).alias("status"), F.lit(6000).alias("offset"), F.when(gone, zero).otherwise(F.octet_length(name).cast("bigint")).alias("length"), F.when(gone, zero).otherwise(F.crc32(name)).alias("crc"), F.lit(10**6).alias("file_length"), F.when(gone, None).when(torn, F.substring(name, F.lit(2), F.lit(10**6))).otherwise(name).alias("body"))
    wanted = p.select(F.lit(14).alias("z"), k.alias("x"), F.lit(1).alias("y"))
    return pruning.cached_bodies(wanted, entries).select("x", "status", F.col("body").cast("string").alias("body"))


@query("""WITH r AS (SELECT o_orderkey AS id, 40 + o_orderkey % 100 * 0.1::DOUBLE AS lat FROM orders), f AS (SELECT *, (47.0::DOUBLE - lat) / 0.05::DOUBLE AS row FROM r),
s AS (SELECT id, lat, row, CAST(greatest(floor(row - 0.02::DOUBLE * 0.5::DOUBLE / 0.05::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE), 0) AS BIGINT) AS a, least(CAST(greatest(floor(row + 0.02::DOUBLE * 0.5::DOUBLE / 0.05::DOUBLE + 0.5::DOUBLE + 1e-9::DOUBLE), 0) AS BIGINT), 100) AS b,
least(CAST(greatest(floor(((row - 0.02::DOUBLE * 0.5::DOUBLE / 0.05::DOUBLE) + (row + 0.02::DOUBLE * 0.5::DOUBLE / 0.05::DOUBLE)) * 0.5::DOUBLE), 0) AS BIGINT), 99) AS mid FROM f)
SELECT id, CASE WHEN lat <= 47.0::DOUBLE AND lat >= 42.0::DOUBLE AND row >= 0 AND floor(row) < 100 THEN CASE WHEN a < b THEN a ELSE mid END END AS r0, CASE WHEN lat <= 47.0::DOUBLE AND lat >= 42.0::DOUBLE AND row >= 0 AND floor(row) < 100 THEN CASE WHEN a < b THEN b ELSE mid + 1 END END AS r1,
CAST(round(lat * 1000000.0::DOUBLE) AS BIGINT) AS micro FROM s""")
def row_spans(spark, sf):
    k = F.col("o_orderkey")
    r = V.table(spark, sf, "orders").select(k.alias("id"), (40 + k % 100 * F.lit(0.1)).alias("lat"))
    s = G.geo_row_span(F.col("lat"), F.lit(47.0), F.lit(42.0), F.lit(0.05), F.lit(100), F.lit(0.02))
    return r.select("id", s["first"].alias("r0"), s["last"].alias("r1"), G.quantised_degrees(F.col("lat")).alias("micro"))


@query("""WITH r AS (SELECT c_custkey AS id, 500 + c_custkey % 9 AS x0, 500 + c_custkey % 9 + c_custkey % 3 AS x1, 300 + c_custkey % 5 AS y0, 300 + c_custkey % 5 + c_custkey % 2 AS y1 FROM customer),
c AS (SELECT id, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM r), t AS (SELECT id, x, unnest(range(y0, y1 + 1)) AS y FROM c)
SELECT id, x, y, format('https://tiles.example.org/10/{}/{}.png', x, y) AS url FROM t""")
def rectangle_urls(spark, sf):
    k = F.col("c_custkey")
    box = F.struct((500 + k % 9).alias("x0"), (500 + k % 9 + k % 3).alias("x1"), (300 + k % 5).alias("y0"), (300 + k % 5 + k % 2).alias("y1"))
    u = V.table(spark, sf, "customer").select(k.alias("id"), F.explode(text.rectangle_urls(F.lit("https://tiles.example.org/{z}/{x}/{y}.png"), F.lit(10), box)).alias("u"))
    return u.select("id", "u.*")
