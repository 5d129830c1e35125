"""Queries of the mosaic, terrain and quadtree operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import mosaic, quadtree, terrain

from . import views as V

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {V.CELLS} SELECT x, y, max(raw) AS max_raw, CAST(least(count(*), 65535) AS INT) AS n_src FROM cells WHERE raw <> 0 GROUP BY x, y")
def mosaic_max_count(spark, sf):
    return mosaic.max_and_count(V.cells(spark, sf))


@query(f"WITH {V.CELLS} SELECT x, y, string_agg(CAST(src % 65536 AS VARCHAR), ',' ORDER BY {V.PLACE}) AS ids FROM cells WHERE raw <> 0 GROUP BY x, y")
def mosaic_sources(spark, sf):
    got = mosaic.contributors(V.placed_cells(spark, sf))
    return got.select("x", "y", F.array_join("ids", ",").alias("ids"))


@query(f"""WITH {V.CELLS}, n AS (SELECT x, y, count(*) AS n FROM cells WHERE raw <> 0 GROUP BY x, y),
t AS (SELECT x // 16 AS tx, y // 16 AS ty, (y % 16) * 16 + x % 16 AS cell, n FROM n)
SELECT tx, ty, cell, n, CAST(sum(n) OVER (PARTITION BY tx, ty ORDER BY cell ROWS UNBOUNDED PRECEDING) - n AS BIGINT) AS first FROM t""")
def csr_offsets(spark, sf):
    return mosaic.csr_offsets(V.cells(spark, sf), 16)


@query(f"""WITH {V.CELLS}, m AS (SELECT x, y, max(raw) AS v, CAST(least(count(*), 65535) AS INT) AS n FROM cells WHERE raw <> 0 GROUP BY x, y)
SELECT x // 16 AS tx, y // 16 AS ty, min(v) AS low, max(v) AS high, max(n) AS most FROM m GROUP BY 1, 2""")
def mosaic_stats(spark, sf):
    return mosaic.tile_statistics(V.cells(spark, sf), 16)


_GRID = f"""WITH {V.RASTERS}, g AS (SELECT min("left") AS "left", max(top) AS top, arg_min(step_x, pos) AS step_x, arg_min(step_y, pos) AS step_y,
  CAST(round((max("left" + width * step_x) - min("left")) / arg_min(step_x, pos)) AS BIGINT) AS width,
  CAST(round((max(top) - min(top + height * step_y)) / abs(arg_min(step_y, pos))) AS BIGINT) AS height,
  (SELECT count(*) FROM rasters r, (SELECT arg_min(step_x, pos) AS sx, arg_min(step_y, pos) AS sy FROM rasters) f WHERE abs(r.step_x - sx) / abs(sx) > 0.01 OR abs(r.step_y - sy) / abs(sy) > 0.01) AS n_odd FROM rasters)"""


@query(_GRID + " SELECT * FROM g")
def master_grid(spark, sf):
    return mosaic.master_grid(V.rasters(spark, sf))


@query(_GRID + """, r AS (SELECT r.pos,
  CAST(floor(greatest(floor((r."left" - g."left") / g.step_x), 0) / 128) AS BIGINT) AS x0, CAST(floor(greatest(floor((r.top - g.top) / g.step_y), 0) / 128) AS BIGINT) AS y0,
  CAST(least(ceil(greatest(ceil((r."left" + r.width * r.step_x - g."left") / g.step_x), 0) / 128), ceil(g.width / 128)) AS BIGINT) AS x1,
  CAST(least(ceil(greatest(ceil((r.top + r.height * r.step_y - g.top) / g.step_y), 0) / 128), ceil(g.height / 128)) AS BIGINT) AS y1 FROM rasters r, g),
e AS (SELECT pos, y0, y1, unnest(range(x0, x1)) AS tx FROM r), f AS (SELECT pos, tx, unnest(range(y0, y1)) AS ty FROM e)
SELECT tx, ty, count(*) AS n, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS ids FROM f GROUP BY tx, ty""")
def tile_file_map(spark, sf):
    r = V.rasters(spark, sf)
    hits = mosaic.tile_sources(r, mosaic.master_grid(r), 128)
    return hits.groupBy("tx", "ty").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("pos")), ",").alias("ids"))


@query(f"""WITH {V.CELLS}, m AS (SELECT x, y, max(raw) AS v FROM cells WHERE raw <> 0 GROUP BY x, y), l AS (SELECT unnest([4, 16]) AS level)
SELECT level, x // level AS x, y // level AS y, v FROM m, l WHERE x % level = 0 AND y % level = 0""")
def overview_4x(spark, sf):
    best = mosaic.max_and_count(V.cells(spark, sf)).select("x", "y", F.col("max_raw").alias("v"))
    return mosaic.pyramid(best, mosaic.overview_levels(64, 32, 8)).select("level", "x", "y", "v")


@query("""SELECT p_partkey AS id, CASE WHEN p_size * 300 > 2048 THEN array_to_string(list_transform(list_filter([1, 4, 16, 64, 256, 1024, 4096], lambda f: f = 1 OR (p_size * 300) // f > 256), lambda f: f * 4), ',') ELSE '' END AS factors FROM part""")
def export_levels(spark, sf):
    p = V.table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("id"), F.array_join(mosaic.export_factors((F.col("p_size") * 300).cast("bigint")), ",").alias("factors"))


@query(f"""WITH {V.CELLS}, z AS (SELECT x, y, CASE WHEN y % 8 < 4 AND x // 8 % 3 = 0 THEN 0 ELSE max(raw) END AS raw FROM cells GROUP BY x, y)
SELECT x // 4 AS tx, y // 4 AS ty, count(*) FILTER (raw <> 0) AS n, CAST(sum(raw) AS BIGINT) AS total FROM z GROUP BY 1, 2 HAVING max(raw) > 0""")
def retile_sparse(spark, sf):
    c = V.cells(spark, sf).groupBy("x", "y").agg(F.max("raw").alias("raw"))
    blank = (F.col("y") % 8 < 4) & (F.floor(F.col("x") / 8) % 3 == 0)
    return mosaic.retiled(c.withColumn("raw", F.when(blank, 0).otherwise(F.col("raw"))), 4)


_MEAN = "CASE WHEN count(*) FILTER (v > -5000) = 0 THEN -9999 ELSE CAST(trunc((2 * coalesce(sum(v) FILTER (v > -5000), 0) + CASE WHEN coalesce(sum(v) FILTER (v > -5000), 0) >= 0 THEN 1 ELSE -1 END * count(*) FILTER (v > -5000)) / CAST(2 * count(*) FILTER (v > -5000) AS DOUBLE)) AS INT) END"


@query(f"WITH {V.ELEV} SELECT gx // 4 AS cx, gy // 4 AS cy, {_MEAN} AS mean, count(*) FILTER (v > -5000) AS n FROM elev GROUP BY 1, 2")
def area_mean(spark, sf):
    e = V.elev(spark, sf).withColumns({"cx": F.floor(F.col("gx") / 4), "cy": F.floor(F.col("gy") / 4)})
    return terrain.area_mean(e, "cx", "cy")


@query(f"""WITH {V.ELEV}, s AS (SELECT gx, gy, priority, min(v) AS v FROM elev WHERE v > -5000 GROUP BY gx, gy, priority)
SELECT gx, gy, arg_min(v, priority) AS v, min(priority) AS priority FROM s GROUP BY gx, gy""")
def overlay_priority(spark, sf):
    one = V.elev(spark, sf).where("v > -5000").groupBy("gx", "gy", "priority").agg(F.min("v").alias("v"))
    return terrain.overlay(one, "gx", "gy")


@query(f"""WITH {V.ELEV} SELECT gx // 16 AS tx, gy // 16 AS ty, count(*) FILTER (v > -5000) AS covered_px, count(*) FILTER (v <= -5000) AS void_px,
coalesce(min(v) FILTER (v > -5000), 0) AS base FROM elev GROUP BY 1, 2""")
def void_stats(spark, sf):
    e = V.elev(spark, sf).withColumns({"tx": F.floor(F.col("gx") / 16), "ty": F.floor(F.col("gy") / 16)})
    return terrain.void_statistics(e, "tx", "ty")


@query(f"""WITH {V.ELEV}, l AS (SELECT gx, list_sort(list(v)) AS s FROM elev WHERE v > -5000 GROUP BY gx)
SELECT gx, s[least(len(s) // 10, len(s) - 1) + 1] AS ground FROM l""")
def ground_p10(spark, sf):
    return terrain.ground_level(V.elev(spark, sf).where("v > -5000"), "gx", "p10")


@query(f"""WITH {V.ELEV}, l AS (SELECT gx, list_sort(list(metres)) AS s, count(*) FILTER (metres < 1 OR metres > 300) AS odd, count(*) AS n FROM elev GROUP BY gx)
SELECT gx, round(s[n // 2 + 1], 6) AS median_rise, odd * 2 > n AS suspect FROM l""")
def datum_suspect(spark, sf):
    got = terrain.datum_suspect(V.elev(spark, sf).withColumn("rise", F.col("metres")), "gx")
    return got.withColumn("median_rise", F.round("median_rise", 6))


_PASS = """(SELECT *, coalesce(v > -11000 AND (coalesce(l IS NOT NULL AND r IS NOT NULL AND least(l, r) - v > 2200, false)
  OR coalesce(a IS NOT NULL AND b IS NOT NULL AND least(a, b) - v > 2200, false)), false) AS hit FROM (SELECT *,
  coalesce(lag(ok, 1) OVER rw, lag(ok, 2) OVER rw) AS l, coalesce(lead(ok, 1) OVER rw, lead(ok, 2) OVER rw) AS r,
  coalesce(lag(ok, 1) OVER cl, lag(ok, 2) OVER cl) AS a, coalesce(lead(ok, 1) OVER cl, lead(ok, 2) OVER cl) AS b
  FROM (SELECT *, CASE WHEN v > -11000 THEN v END AS ok FROM {}) WINDOW rw AS (PARTITION BY y ORDER BY x), cl AS (PARTITION BY x ORDER BY y)))"""


@query(f"""WITH {V.PROFILE}, p1 AS {_PASS.format('profile')}, q AS (SELECT x, y, CASE WHEN hit THEN NULL ELSE v END AS v, hit AS h1 FROM p1), p2 AS {_PASS.format('q')}
SELECT x, y, CASE WHEN hit THEN NULL ELSE v END AS v, h1 OR hit AS seam FROM p2""")
def seam_notch(spark, sf):
    return terrain.seam_filter(V.profile(spark, sf), 12).select("x", "y", "v", "seam")


@query(f"""WITH {V.XYZ}, w AS (SELECT DISTINCT z, x, y FROM xyz WHERE z = 15), up AS (SELECT w.z, w.x, w.y, 15 - k AS az, x >> k AS ax, y >> k AS ay FROM w, (SELECT unnest([0, 1, 2]) AS k))
SELECT w.z, w.x, w.y, b.v, b.filled_zoom FROM w LEFT JOIN (SELECT up.z, up.x, up.y, arg_max(t.v, t.z) AS v, max(t.z) AS filled_zoom FROM up JOIN xyz t ON t.z = az AND t.x = ax AND t.y = ay
WHERE t.v IS NOT NULL GROUP BY 1, 2, 3) b ON b.z = w.z AND b.x = w.x AND b.y = w.y""")
def parent_fill(spark, sf):
    t = V.xyz(spark, sf)
    return quadtree.fill_from_ancestors(t.where("z = 15").select("z", "x", "y"), t, 2)


@query(f"""WITH {V.XYZ} SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y, avg(v) FILTER (status = 'ok') AS v FROM xyz WHERE status <> 'missing' GROUP BY 1, 2, 3 HAVING count(*) = 4""")
def derive_parent(spark, sf):
    return quadtree.derive_parents(V.xyz(spark, sf))


@query(f"""WITH {V.XYZ}, k0 AS (SELECT DISTINCT z, x, y FROM xyz WHERE z = 15 AND status <> 'missing'), k1 AS (SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y FROM k0 GROUP BY 1, 2, 3 HAVING count(*) = 4),
k2 AS (SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y FROM k1 GROUP BY 1, 2, 3 HAVING count(*) = 4), k3 AS (SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y FROM k2 GROUP BY 1, 2, 3 HAVING count(*) = 4),
k4 AS (SELECT z - 1 AS z, x >> 1 AS x, y >> 1 AS y FROM k3 GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT *, 1 AS depth FROM k1 UNION ALL SELECT *, 2 FROM k2 UNION ALL SELECT *, 3 FROM k3 UNION ALL SELECT *, 4 FROM k4""")
def derivable(spark, sf):
    return quadtree.derivable(V.xyz(spark, sf).where("z = 15 and status <> 'missing'"), 4)


_SPECS = "specs AS (SELECT c_custkey % 29 AS x0, c_custkey % 29 + c_custkey % 3 AS x1, c_custkey % 13 AS y0, c_custkey % 13 + c_custkey % 2 AS y1 FROM customer)"


def _specs(spark, sf):
    k = F.col("c_custkey")
    return V.table(spark, sf, "customer").select((k % 29).alias("x0"), (k % 29 + k % 3).alias("x1"), (k % 13).alias("y0"), (k % 13 + k % 2).alias("y1"))


@query(f"WITH {_SPECS}, e AS (SELECT y0, y1, unnest(range(x0, x1 + 1)) AS x FROM specs) SELECT DISTINCT 15 AS z, x, unnest(range(y0, y1 + 1)) AS y FROM e")
def fetch_set(spark, sf):
    return quadtree.fetch_set(_specs(spark, sf), 15)


@query(f"""WITH {V.XYZ}, {_SPECS}, e AS (SELECT y0, y1, unnest(range(x0, x1 + 1)) AS x FROM specs), w AS (SELECT DISTINCT 15 AS z, x, unnest(range(y0, y1 + 1)) AS y FROM e),
hit AS (SELECT DISTINCT z, x, y FROM xyz WHERE status = 'ok'), bld AS (SELECT DISTINCT z, x, y FROM xyz WHERE status = '404')
SELECT w.z, w.x, w.y, CASE WHEN h.z IS NOT NULL THEN 'hit' WHEN b.z IS NOT NULL THEN 'derivable' ELSE 'miss' END AS plan FROM w
LEFT JOIN hit h ON h.z = w.z AND h.x = w.x AND h.y = w.y LEFT JOIN bld b ON b.z = w.z AND b.x = w.x AND b.y = w.y""")
def cache_diff(spark, sf):
    t = V.xyz(spark, sf)
    return quadtree.cache_index(quadtree.fetch_set(_specs(spark, sf), 15), t.where("status = 'ok'"), t.where("status = '404'"))


@query(f"""WITH {V.XYZ}, f AS (SELECT o_orderkey % 500 AS cell, CAST(o_orderkey % 32 AS INT) AS x, CAST(o_custkey % 16 AS INT) AS y FROM orders),
l AS (SELECT DISTINCT x, y, true AS yes FROM xyz WHERE z = 15 AND status = 'ok') SELECT cell, bool_and(coalesce(yes, false)) AS rewrite FROM f LEFT JOIN l USING (x, y) GROUP BY cell""")
def repair_mask(spark, sf):
    o = V.table(spark, sf, "orders")
    feet = o.select((F.col("o_orderkey") % 500).alias("cell"), (F.col("o_orderkey") % 32).cast("int").alias("x"), (F.col("o_custkey") % 16).cast("int").alias("y"))
    return quadtree.repair_mask(feet, V.xyz(spark, sf).where("z = 15 and status = 'ok'"))


@query("""WITH e AS (SELECT o_custkey AS key, o_orderstatus <> 'F' AS derived, o_orderkey AS seq, CAST(o_orderkey * 31 % 9973 AS BIGINT) AS crc FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY derived, seq DESC) AS k FROM e) SELECT key, derived, seq, crc FROM r WHERE k = 1""")
def merge_packs(spark, sf):
    o = V.table(spark, sf, "orders")
    e = o.select(F.col("o_custkey").alias("key"), (F.col("o_orderstatus") != "F").alias("derived"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") * 31 % 9973).alias("crc"))
    return quadtree.merge_packs(e)
