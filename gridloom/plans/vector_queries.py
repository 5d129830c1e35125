"""Queries of the vector and run operators with their SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from gridloom.functions import text as T
from gridloom.operators import runs, vector

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


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY l_partkey, l_quantity ORDER BY l_orderkey * 10 + l_linenumber) AS k FROM lineitem)
SELECT l_partkey, l_quantity, l_orderkey * 10 + l_linenumber AS pos, l_suppkey FROM r WHERE k = 1""")
def dedup_first(spark, sf):
    li = V.table(spark, sf, "lineitem").select("l_partkey", "l_quantity", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), "l_suppkey")
    return vector.first_of_duplicates(li, ["l_partkey", "l_quantity"], "pos")


@query(f"WITH {V.SHAPES} SELECT id, sum(px * qy - qx * py) AS area2 FROM edges GROUP BY id")
def ring_area(spark, sf):
    s = V.shapes(spark, sf).select("id", F.posexplode("ring").alias("i", "p")).select("id", "i", "p.px", "p.py")
    return vector.ring_area2(s, "id")


@query("""WITH r AS (SELECT l_orderkey AS feature, l_linenumber::BIGINT * 1000000000 + l_partkey * 1000 + l_suppkey AS i, CASE WHEN l_linenumber = 1 OR l_partkey % 3 = 0 THEN l_quantity ELSE -l_quantity END AS area2 FROM lineitem),
s AS (SELECT *, sign(first_value(area2) OVER (PARTITION BY feature ORDER BY i)) AS first_sign FROM r)
SELECT feature, i, area2, last_value(CASE WHEN sign(area2) = first_sign AND area2 <> 0 THEN i END IGNORE NULLS) OVER (PARTITION BY feature ORDER BY i ROWS UNBOUNDED PRECEDING) AS owner FROM s""")
def ring_owner(spark, sf):
    outer = (F.col("l_linenumber") == 1) | (F.col("l_partkey") % 3 == 0)
    r = V.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("feature"), (F.col("l_linenumber").cast("bigint") * 10**9 + F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("i"), F.when(outer, F.col("l_quantity")).otherwise(-F.col("l_quantity")).alias("area2"))
    return vector.ring_owner(r, "feature")


_INSIDE = """cand AS (SELECT e.id, e.rise, c.x, c.y, e.px, e.py, e.qx, e.qy FROM edges e JOIN (SELECT id, greatest(floor(min(px)), 0) AS x0, least(ceil(max(px)), 64) AS x1, greatest(floor(min(py)), 0) AS y0, least(ceil(max(py)), 64) AS y1 FROM edges GROUP BY id) b USING (id)
JOIN (SELECT a.i AS x, d.i AS y FROM (SELECT unnest(range(64)) AS i) a, (SELECT unnest(range(64)) AS i) d) c ON c.x >= b.x0 AND c.x < b.x1 AND c.y >= b.y0 AND c.y < b.y1),
ins AS (SELECT id, rise, x, y FROM cand GROUP BY id, rise, x, y
HAVING sum(CASE WHEN (py > y + 0.5) <> (qy > y + 0.5) AND x + 0.5 < (px - qx) * (y + 0.5 - qy) / (py - qy) + qx THEN 1 ELSE 0 END) % 2 = 1)"""


@query(f"WITH {V.SHAPES}, {_INSIDE} SELECT id, count(*) AS n, CAST(min(y * 64 + x) AS BIGINT) AS first, CAST(max(y * 64 + x) AS BIGINT) AS last FROM ins GROUP BY id")
def point_in_poly(spark, sf):
    c = vector.footprint_cells(V.shapes(spark, sf), 64)
    at = F.col("y") * 64 + F.col("x")
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("first"), F.max(at).alias("last"))


_GROUND = "ground AS (SELECT CAST(l_orderkey % 64 AS BIGINT) AS x, CAST(l_partkey % 64 AS BIGINT) AS y, CAST(min(l_suppkey * 7 % 300) AS INT) AS v FROM lineitem GROUP BY 1, 2)"


def _ground(spark, sf):
    li = V.table(spark, sf, "lineitem")
    return li.groupBy((F.col("l_orderkey") % 64).alias("x"), (F.col("l_partkey") % 64).alias("y")).agg(F.min(F.col("l_suppkey") * 7 % 300).cast("int").alias("v"))


# cells of buildings: inside the ring and not in the courtyard
_BUILT = f"""{V.HOLES}, feet AS (SELECT i.id, b.rise, b.absolute, i.x, i.y FROM ins i JOIN built b USING (id)
  WHERE NOT (court AND x + 0.5 >= ox + 0.25 AND x + 0.5 < ox + 1.25 AND y + 0.5 >= oy + 0.25 AND y + 0.5 < oy + 1.25))"""
_ROOFS = """u AS (SELECT id, v FROM feet JOIN ground USING (x, y)), l AS (SELECT id, list_sort(list(v)) AS s FROM u GROUP BY id),
roofs AS (SELECT b.id, s[len(s) // 10 + 1] AS ground, CASE WHEN absolute THEN rise ELSE least(s[len(s) // 10 + 1] + rise, 32767) END AS roof FROM built b LEFT JOIN l USING (id) WHERE absolute OR (rise > 0 AND s IS NOT NULL)),
top AS (SELECT x, y, max(roof) AS roof FROM feet JOIN roofs USING (id) GROUP BY x, y)"""


@query(f"WITH {V.SHAPES}, {_INSIDE}, {_BUILT} SELECT id, count(*) AS n, CAST(sum(y * 64 + x) AS BIGINT) AS places FROM feet GROUP BY id")
def courtyard_cells(spark, sf):
    c = vector.footprint_cells(V.built(spark, sf), 64)
    return c.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("y") * 64 + F.col("x")).cast("bigint").alias("places"))


@query(f"""WITH {V.SHAPES}, {_INSIDE}, {_BUILT}, {_GROUND}, {_ROOFS}
SELECT x, y, v, CAST(greatest(v, coalesce(roof, v)) AS INT) AS burned FROM ground LEFT JOIN top USING (x, y)""")
def burn_buildings(spark, sf):
    return vector.burn(_ground(spark, sf), V.built(spark, sf), 64).select("x", "y", "v", F.col("burned").cast("int").alias("burned"))


@query(f"WITH {V.SHAPES}, {_INSIDE}, {_BUILT}, {_GROUND}, {_ROOFS} SELECT id, CAST(ground AS INT) AS ground, CAST(roof AS INT) AS roof FROM roofs")
def roof_heights(spark, sf):
    return vector.roofs(_ground(spark, sf), V.built(spark, sf), 64).select("id", F.col("ground").cast("int").alias("ground"), F.col("roof").cast("int").alias("roof"))


# forests: rectangles with a clearing, on quarter cells, so that all overlaps are exact
_WOODS = """woods AS (SELECT s_suppkey AS id, CAST(s_suppkey * 13 % 50 + 0.25 AS DOUBLE) AS ax, CAST(s_suppkey * 29 % 50 + 0.5 AS DOUBLE) AS ay, CAST(s_suppkey * 13 % 50 + s_suppkey % 6 + 5.75 AS DOUBLE) AS bx, CAST(s_suppkey * 29 % 50 + s_suppkey % 4 + 5.25 AS DOUBLE) AS b_y FROM supplier),
lines AS (SELECT *, CAST(floor(ay) AS BIGINT) + j AS y, k FROM woods, (SELECT unnest(range(16)) AS j), (SELECT unnest(range(4)) AS k) WHERE floor(ay) + j < least(ceil(b_y), 64)),
hit AS (SELECT *, ax + 1.25 AS ix, ax + 3.5 AS jx, y + (k + 0.5) / 4 >= ay + 1.5 AND y + (k + 0.5) / 4 < ay + 3.25 AS inner_ FROM lines WHERE y + (k + 0.5) / 4 >= ay AND y + (k + 0.5) / 4 < b_y),
part AS (SELECT id, y, CAST(floor(ax) AS BIGINT) + i AS x, greatest(least(floor(ax) + i + 1, bx) - greatest(floor(ax) + i, ax), 0) - CASE WHEN inner_ THEN greatest(least(floor(ax) + i + 1, jx) - greatest(floor(ax) + i, ix), 0) ELSE 0 END AS w FROM hit, (SELECT unnest(range(16)) AS i)),
cover AS (SELECT x, y, max(alpha) AS alpha FROM (SELECT id, x, y, least(sum(w) / 4, 1.0::DOUBLE) AS alpha FROM part WHERE x < 64 GROUP BY 1, 2, 3) WHERE alpha > 0 GROUP BY 1, 2)"""


def _woods(spark, sf):
    k = F.col("s_suppkey")
    ax, ay = k * 13 % 50 + 0.25, k * 29 % 50 + 0.5
    bx, by = k * 13 % 50 + k % 6 + 5.75, k * 29 % 50 + k % 4 + 5.25
    p = lambda a, b: F.struct(a.cast("double").alias("px"), b.cast("double").alias("py"))
    ring = lambda x0, y0, x1, y1: F.array(p(x0, y0), p(x1, y0), p(x1, y1), p(x0, y1))
    clearing = ring(ax + 1.25, ay + 1.5, ax + 3.5, ay + 3.25)
    return V.table(spark, sf, "supplier").select(k.alias("id"), F.array(ring(ax, ay, bx, by), clearing).alias("rings"))


@query(f"WITH {_WOODS} SELECT x, y, alpha FROM cover")
def forest_cover(spark, sf):
    return vector.forest_cover(_woods(spark, sf), 64)


@query(f"""WITH {_WOODS}, b AS (SELECT DISTINCT id, y, x FROM (SELECT id, y, CAST(floor(ax) AS BIGINT) + i AS x, ax, bx, ix, jx, inner_ FROM (SELECT *, ax + 1.25 AS ix, ax + 3.5 AS jx, y + 0.5 >= ay + 1.5 AND y + 0.5 < ay + 3.25 AS inner_ FROM lines WHERE k = 0 AND y + 0.5 >= ay AND y + 0.5 < b_y), (SELECT unnest(range(16)) AS i))
WHERE x < 64 AND x + 0.5 >= ax AND x + 0.5 < bx AND NOT (inner_ AND x + 0.5 >= ix AND x + 0.5 < jx)) SELECT x, y, 1.0::DOUBLE AS alpha FROM b GROUP BY 1, 2""")
def forest_mask(spark, sf):
    return vector.forest_cover(_woods(spark, sf), 64, 1).withColumn("alpha", F.col("alpha").cast("double"))


@query(f"""WITH {V.SHAPES}, {_INSIDE}, {_BUILT}, {_GROUND}, {_ROOFS}, {_WOODS}, obs AS (SELECT n_nationkey * 5 % 64 AS ox, n_nationkey * 3 % 64 AS oy FROM nation),
free AS (SELECT * FROM cover c WHERE NOT EXISTS (SELECT 1 FROM obs WHERE greatest(abs(c.x - ox), abs(c.y - oy)) <= 1))
SELECT g.x, g.y, g.v, CAST(greatest(g.v, coalesce(t.roof, g.v), CASE WHEN g.v > -5000 AND f.alpha IS NOT NULL THEN g.v + CAST(round(30 * f.alpha) AS INT) ELSE g.v END) AS INT) AS burned
FROM ground g LEFT JOIN top t ON t.x = g.x AND t.y = g.y LEFT JOIN free f ON f.x = g.x AND f.y = g.y""")
def surface(spark, sf):
    k = F.col("n_nationkey")
    obs = V.table(spark, sf, "nation").select((k * 5 % 64).alias("ox"), (k * 3 % 64).alias("oy"))
    got = vector.surface(_ground(spark, sf), V.built(spark, sf), _woods(spark, sf), 64, 30, obs, 1)
    return got.select("x", "y", "v", F.col("burned").cast("int").alias("burned"))


@query("""WITH c AS (SELECT o_custkey AS poly, o_orderkey % 8 AS y, CAST(o_orderkey % 61 AS DOUBLE) + 0.25 AS cx FROM orders GROUP BY ALL),
w AS (SELECT *, row_number() OVER (PARTITION BY poly, y ORDER BY cx) AS k, lead(cx) OVER (PARTITION BY poly, y ORDER BY cx) AS nx FROM c)
SELECT poly, y, unnest(range(CAST(ceil(cx - 0.5) AS BIGINT), CAST(ceil(nx - 0.5) AS BIGINT))) AS x FROM w WHERE k % 2 = 1 AND nx IS NOT NULL""")
def scanline_pairs(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_custkey").alias("poly"), (F.col("o_orderkey") % 8).alias("y"), ((F.col("o_orderkey") % 61).cast("double") + 0.25).alias("cx")).distinct()
    return vector.scanline_cells(o)


@query(f"""WITH {_GROUND}, cov AS (SELECT o_orderkey % 64 AS x, o_custkey % 64 AS y, max(CAST(o_orderkey % 5 AS DOUBLE) / 4) AS alpha FROM orders GROUP BY 1, 2),
obs AS (SELECT s_suppkey * 5 % 64 AS ox, s_suppkey * 3 % 64 AS oy FROM supplier),
free AS (SELECT * FROM cov c WHERE NOT EXISTS (SELECT 1 FROM obs WHERE greatest(abs(c.x - ox), abs(c.y - oy)) <= 1))
SELECT g.x, g.y, v, CAST(CASE WHEN v > -5000 AND alpha IS NOT NULL THEN greatest(v, v + CAST(round(30 * alpha) AS INT)) ELSE v END AS INT) AS burned FROM ground g LEFT JOIN free f ON f.x = g.x AND f.y = g.y""")
def burn_canopy(spark, sf):
    o = V.table(spark, sf, "orders")
    cover = o.select((F.col("o_orderkey") % 64).alias("x"), (F.col("o_custkey") % 64).alias("y"), ((F.col("o_orderkey") % 5).cast("double") / 4).alias("alpha"))
    obs = V.table(spark, sf, "supplier").select((F.col("s_suppkey") * 5 % 64).alias("ox"), (F.col("s_suppkey") * 3 % 64).alias("oy"))
    return vector.burn_forest(_ground(spark, sf), cover, 30, obs, 1).select("x", "y", "v", F.col("burned").cast("int").alias("burned"))


_ATTEMPTS = """said AS (SELECT user_id AS run, CASE event_id % 9 WHEN 0 THEN 'tile: HTTP 404 Not Found' WHEN 1 THEN 'tile: HTTP 503' WHEN 2 THEN 'operation timed out' WHEN 3 THEN 'dns error' WHEN 4 THEN 'bad PNG' WHEN 5 THEN 'odd' END AS s, event_id % 4 = 0 AS filled FROM events),
att AS (SELECT run, filled, CASE WHEN s IS NULL THEN NULL WHEN contains(s, 'HTTP ') THEN 'http_' || regexp_extract(s, 'HTTP ([0-9]+)', 1) WHEN contains(s, 'timed out') THEN 'timeout' WHEN regexp_matches(s, 'onnect|dns|resolve') THEN 'connect' WHEN regexp_matches(s, 'decode|png|PNG|nvalid|XYZ tile geometry') THEN 'decode' ELSE 'other' END AS kind FROM said)"""


def _attempts(spark, sf):
    k = F.col("event_id") % 9
    said = F.when(k == 0, "tile: HTTP 404 Not Found").when(k == 1, "tile: HTTP 503").when(k == 2, "operation timed out").when(k == 3, "dns error").when(k == 4, "bad PNG").when(k == 5, "odd")
    e = V.table(spark, sf, "events").select(F.col("user_id").alias("run"), said.alias("said"), (F.col("event_id") % 4 == 0).alias("filled"))
    return e.select("run", F.when(F.col("said").isNotNull(), T.failure_class(F.col("said"))).alias("kind"), "filled")


@query(f"""WITH {_ATTEMPTS} SELECT run, count(*) AS attempted, count(kind) AS failed, count(*) FILTER (kind = 'http_404') AS no_data, count(*) FILTER (kind <> 'http_404' AND NOT filled) AS hard,
count(*) FILTER (kind <> 'http_404' AND NOT filled) * 2 > count(*) AS fatal FROM att GROUP BY run""")
def failure_classes(spark, sf):
    return runs.failure_tally(_attempts(spark, sf), "run")


@query(f"WITH {_ATTEMPTS} SELECT kind, count(*) AS n, kind IN ('timeout', 'connect') OR coalesce(TRY_CAST(replace(kind, 'http_', '') AS INT) = 429 OR TRY_CAST(replace(kind, 'http_', '') AS INT) BETWEEN 500 AND 599, false) AS again FROM att WHERE kind IS NOT NULL GROUP BY kind")
def failure_kinds(spark, sf):
    a = _attempts(spark, sf).where("kind is not null")
    return a.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).withColumn("again", T.retryable(F.col("kind")))


@query("""WITH RECURSIVE s AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id % 5 AS n FROM events),
t AS (SELECT run, CAST(0 AS BIGINT) AS k, CAST(64 AS INT) AS w FROM (SELECT DISTINCT run FROM s) UNION ALL SELECT t.run, t.k + 1,
CAST(CASE WHEN s.n >= 3 THEN greatest(w - w // 4, 16) WHEN s.n = 0 THEN least(w + greatest(w // 10, 1), 256) ELSE w END AS INT) FROM t JOIN s ON s.run = t.run AND s.k = t.k + 1)
SELECT run, arg_max(w, k) AS "window" FROM t GROUP BY run""")
def fold_throttle(spark, sf):
    e = V.table(spark, sf, "events").groupBy(F.col("user_id").alias("run")).agg(F.array_sort(F.collect_list(F.struct("event_id", (F.col("event_id") % 5).alias("n")))).alias("s"))
    return e.select("run", runs.throttled_window(F.transform("s", lambda x: x["n"]), 64, 16, 256).alias("window"))


@query("""WITH r AS (SELECT l_orderkey % 13 AS row, count(*) AS n FROM lineitem GROUP BY 1), s AS (SELECT *, CAST(floor(1000003 * n / CAST(sum(n) OVER () AS DOUBLE)) AS BIGINT) AS share FROM r)
SELECT row, n, CAST(CASE WHEN row = max(row) OVER () THEN share + 1000003 - sum(share) OVER () ELSE share END AS BIGINT) AS share FROM s""")
def row_shares(spark, sf):
    r = V.table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 13).alias("row")).agg(F.count(F.lit(1)).alias("n"))
    return runs.row_shares(r, 1000003)


@query("""WITH RECURSIVE b AS (SELECT n_nationkey AS id, n_nationkey * 0.5::DOUBLE + 0.25 AS south, n_nationkey * 0.5::DOUBLE + 1.0 AS north, n_nationkey * 0.75::DOUBLE + 7.1 AS west, n_nationkey * 0.75::DOUBLE + 8.0 AS east FROM nation),
e AS (SELECT *, round(floor(south / 0.5::DOUBLE + 1e-9::DOUBLE) * 0.5::DOUBLE * 1e9::DOUBLE) / 1e9::DOUBLE AS s, round(ceil(north / 0.5::DOUBLE - 1e-9::DOUBLE) * 0.5::DOUBLE * 1e9::DOUBLE) / 1e9::DOUBLE AS n,
round(floor(west / 0.5::DOUBLE + 1e-9::DOUBLE) * 0.5::DOUBLE * 1e9::DOUBLE) / 1e9::DOUBLE AS w, round(ceil(east / 0.5::DOUBLE - 1e-9::DOUBLE) * 0.5::DOUBLE * 1e9::DOUBLE) / 1e9::DOUBLE AS e FROM b),
g AS (SELECT id, s, n, w, e, res, sub FROM e, (VALUES (30, 0.5::DOUBLE), (90, 1.0::DOUBLE)) v(res, sub)),
la AS (SELECT id, res, sub, n, w, e, floor(s / sub + 1e-9::DOUBLE) * sub AS lat FROM g UNION ALL SELECT id, res, sub, n, w, e, round((lat + sub) * 1e6::DOUBLE) / 1e6::DOUBLE FROM la WHERE round((lat + sub) * 1e6::DOUBLE) / 1e6::DOUBLE < n),
lo AS (SELECT id, res, sub, n, e, lat, floor(w / sub + 1e-9::DOUBLE) * sub AS lon FROM la WHERE lat < n UNION ALL SELECT id, res, sub, n, e, lat, round((lon + sub) * 1e6::DOUBLE) / 1e6::DOUBLE FROM lo WHERE round((lon + sub) * 1e6::DOUBLE) / 1e6::DOUBLE < e),
p AS (SELECT *, CAST(ceil(round_even(sub / (res / 111111.0::DOUBLE), 0) / 4) * 4 AS BIGINT) AS px FROM lo)
SELECT id, CAST(res AS INT) AS resolution_m, format('tile_N{:.2f}E{:.2f}_{:d}m.abt', lat + sub, lon, res) AS filename, round((lat + sub) * 1e6::DOUBLE) / 1e6::DOUBLE AS ul_lat, round(lon * 1e6::DOUBLE) / 1e6::DOUBLE AS ul_lon, px AS size_px,
sub / px * 111111.0::DOUBLE AS exact_res_m, CAST(44 + CAST(ceil(px * 2 / 256.0::DOUBLE) AS BIGINT) * 256 * px AS BIGINT) AS est_bytes FROM p""")
def plan_tiles(spark, sf):
    k = F.col("n_nationkey")
    boxes = V.table(spark, sf, "nation").select(
        k.alias("id"), (k * F.lit(0.5) + 0.25).alias("south"), (k * F.lit(0.5) + 1.0).alias("north"), (k * F.lit(0.75) + 7.1).alias("west"), (k * F.lit(0.75) + 8.0).alias("east")
    )
    return runs.plan_tiles(boxes, [90, 30, 30])


@query("SELECT s_suppkey, c_custkey FROM supplier, customer")
def cross_links(spark, sf):
    # every source meets every target by definition of this job; a file of few splits would leave most cores idle
    far = V.table(spark, sf, "customer").select("c_custkey")
    return runs.every_link(V.table(spark, sf, "supplier").select("s_suppkey"), far, 4 * spark.sparkContext.defaultParallelism)


@query("""WITH j AS (SELECT c_custkey AS job, c_nationkey AS input, c_custkey % 2 AS gate FROM customer) SELECT input, count(DISTINCT gate) = 1 AS agreed, count(*) AS jobs FROM j GROUP BY input""")
def gate_agreement(spark, sf):
    j = V.table(spark, sf, "customer").select(F.col("c_nationkey").alias("input"), (F.col("c_custkey") % 2).alias("gate"))
    return runs.agreement(j, "input", "gate")


@query()
def probe_facts(spark, sf):
    """Header facts of small TIFF files made from suppliers; every fifth is cut short."""
    from gridloom.runtime import ship_package
    from gridloom.sources import readers, tiff

    ship_package(spark)

    @F.pandas_udf("binary")
    def made(key: pd.Series) -> pd.Series:
        def one(k: int) -> bytes:
            grid = ((np.arange(48 * 40) * (k + 3)) % 251).astype(np.uint8).reshape(40, 48)
            raw = tiff.write_tiled(grid, 16, [k, 0.25, 0, 50, 0, -0.25], "0", (grid[::4, ::4],))
            return raw[:20] if k % 5 == 0 else raw

        return key.map(one)

    s = V.table(spark, sf, "supplier")
    return readers.probe(s.select(F.format_string("raster_%d.tif", "s_suppkey").alias("path"), made("s_suppkey").alias("content")))


@query("WITH g AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 - 180 + 0.125 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 160 - 80 + 0.25 AS DOUBLE) AS lat FROM customer) SELECT id, round(6378137.0::DOUBLE * radians(lon), 3) AS east, round(6378137.0::DOUBLE * ln(tan(pi() / 4 + radians(lat) / 2)), 3) AS north FROM g")
def projected_mercator(spark, sf):
    from gridloom.functions.projections import projected
    from gridloom.runtime import ship_package

    ship_package(spark)
    k = F.col("c_custkey")
    c = V.table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 360 - 180 + 0.125).cast("double").alias("lon"), (k * 17 % 160 - 80 + 0.25).cast("double").alias("lat"))
    p = c.select("id", projected(F.col("lon"), F.col("lat"), 3857).alias("p"))
    return p.select("id", F.round("p.east", 3).alias("east"), F.round("p.north", 3).alias("north"))
