"""Queries of the scalar functions with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import elevation as E
from gridloom.functions import grids as G
from gridloom.functions import text as T

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


def _clamped(x: str) -> str:
    return f"CAST(trunc(greatest(least({x}, 32767.0::DOUBLE), -32768.0::DOUBLE)) AS INT)"


@query(f"""WITH {V.ELEV} SELECT event_id, {_clamped("CAST(CAST(metres * 100 AS FLOAT) AS DOUBLE) * 2")} AS of_float, {_clamped("metres * 100 * 2")} AS of_double,
CASE WHEN event_type = 'click' THEN -9999 ELSE {_clamped("metres * 2")} END AS gaps FROM elev""")
def half_metres_float(spark, sf):
    e, m = V.elev(spark, sf), F.col("metres")
    gap = F.when(F.col("event_type") == "click", F.lit(float("nan"))).otherwise(m)
    cols = {"of_float": (m * 100).cast("float").cast("double"), "of_double": m * 100, "gaps": gap}
    return e.select("event_id", *[E.half_metres_truncated(c).cast("int").alias(k) for k, c in cols.items()])


@query("""WITH i AS (SELECT o_orderkey AS id, CAST(trunc(o_totalprice) AS BIGINT) - 100000 AS m FROM orders)
SELECT id, CASE WHEN m * 2 < -9999 THEN -9999 WHEN m * 2 > 32767 THEN 32767 ELSE CAST(m * 2 AS INT) END AS half,
CASE WHEN m % 100 = 0 THEN NULL ELSE m END AS kept, CASE WHEN m <> 7 THEN m * 0.5::DOUBLE + 10 END AS scaled FROM i""")
def half_metres_int(spark, sf):
    o = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_totalprice").cast("bigint") - 100000).alias("m"))
    kept = F.when(E.nodata_to_null(F.col("m") % 100, 0).isNotNull(), F.col("m"))
    return o.select("id", E.half_metres_of_int(F.col("m")).cast("int").alias("half"), kept.alias("kept"), E.scaled(F.col("m"), 7, 0.5, 10.0).alias("scaled"))


@query(f"""WITH {V.ELEV} SELECT event_id, {_clamped("CAST(CAST(metres AS FLOAT) * 2::FLOAT + CASE WHEN CAST(metres AS FLOAT) * 2::FLOAT >= 0 THEN 0.5::FLOAT ELSE -0.5::FLOAT END AS DOUBLE)")} AS half_away,
{_clamped("round(metres * 2)")} AS nearest, {_clamped("metres * 2")} AS cut,
CASE WHEN metres <= -5000 THEN 0 ELSE CAST(trunc(greatest(least((metres + 150) / 0.5::DOUBLE, 255.0::DOUBLE), 0.0::DOUBLE)) AS INT) END AS byte FROM elev""")
def half_metres_round(spark, sf):
    e, m = V.elev(spark, sf), F.col("metres")
    cols = {"half_away": E.half_metres_half_away(m), "nearest": E.half_metres_nearest(m), "cut": E.half_metres_cut(m), "byte": E.coverage_byte(m, 0.5, -150.0)}
    return e.select("event_id", *[c.cast("int").alias(k) for k, c in cols.items()])


@query(f"""WITH {V.ELEV}, n AS (SELECT event_id, CAST(greatest(least(round((metres + 32768.0::DOUBLE) * 256.0::DOUBLE), 16777215.0::DOUBLE), 0.0::DOUBLE) AS INT) AS n FROM elev)
SELECT event_id, n >> 16 AS r, (n >> 8) & 255 AS g, n & 255 AS b, ((n >> 16) * 256.0::DOUBLE + ((n >> 8) & 255) + (n & 255) / 256.0::DOUBLE) - 32768.0::DOUBLE AS back FROM n""")
def rgb_roundtrip(spark, sf):
    e = V.elev(spark, sf).withColumn("n", E.rgb_of_metres(F.col("metres")))
    r, g, b = E.channels(F.col("n"))
    return e.select("event_id", r.alias("r"), g.alias("g"), b.alias("b"), E.metres_of_rgb(r, g, b).alias("back"))


_TENTHS = "(-10000.0::FLOAT + (CAST(n >> 16 AS FLOAT) * 6553.6::FLOAT + CAST((n >> 8) & 255 AS FLOAT) * 25.6::FLOAT + CAST(n & 255 AS FLOAT) * 0.1::FLOAT))"


@query(f"""WITH {V.ELEV}, c AS (SELECT event_id, metres, CAST(greatest(least(round((metres + 10000.0::DOUBLE) * 10.0::DOUBLE), 16777215.0::DOUBLE), 0.0::DOUBLE) AS INT) AS n0 FROM elev),
t AS (SELECT event_id, metres, unnest(range(greatest(n0 - 4, 0), least(n0 + 4, 16777215) + 1)) AS n FROM c),
e AS (SELECT event_id, n, abs(CAST({_TENTHS} AS DOUBLE) - metres) AS err FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY err, n) AS k FROM e)
SELECT event_id, CAST(n AS INT) AS n FROM r WHERE k = 1""")
def rgb2_encode(spark, sf):
    return V.elev(spark, sf).select("event_id", E.rgb_tenths_of_metres(F.col("metres")).alias("n"))


@query(f"""WITH {V.GEO}, t AS (SELECT id, CAST(greatest(floor((lon + 180.0::DOUBLE) / 360.0::DOUBLE * 4096), 0) AS BIGINT) AS tx,
CAST(greatest(floor((1.0::DOUBLE - asinh(tan(radians(lat))) / pi()) / 2.0::DOUBLE * 4096), 0) AS BIGINT) AS ty FROM geo)
SELECT id, tx, ty, tx / 4096.0::DOUBLE * 360.0::DOUBLE - 180.0::DOUBLE AS lon, round(degrees(atan(sinh(pi() * (1.0::DOUBLE - 2.0::DOUBLE * ty / 4096)))), 9) AS lat,
round(degrees(atan(0.5::DOUBLE * (exp(pi() - 2.0::DOUBLE * pi() * ty / 4096) - exp(-(pi() - 2.0::DOUBLE * pi() * ty / 4096))))), 9) AS lat_by_exp FROM t""")
def lonlat_tile(spark, sf):
    z = F.lit(12)
    g = V.geo(spark, sf).select("id", G.lon_to_tile(F.col("lon"), z).alias("tx"), G.lat_to_tile(F.col("lat"), z).alias("ty"))
    x, y = F.col("tx"), F.col("ty")
    return g.select("id", "tx", "ty", G.tile_to_lon(x, z).alias("lon"), F.round(G.tile_to_lat(y, z), 9).alias("lat"), F.round(G.tile_to_lat_by_exp(y, z), 9).alias("lat_by_exp"))


@query(f"WITH {V.GEO} SELECT id, CAST(greatest(least(ceil(log2((40075000.0::DOUBLE * cos(radians(lat))) / ((id % 90 + 1) * 256.0::DOUBLE))), 15), 0) AS INT) AS zoom FROM geo")
def zoom_for_res(spark, sf):
    return V.geo(spark, sf).select("id", G.zoom_for_resolution((F.col("id") % 90 + 1).cast("double"), F.col("lat")).alias("zoom"))


_SPANS = "s AS (SELECT o_orderkey AS id, CAST(o_orderkey % 97 AS DOUBLE) / 4 - 3 AS lo, CAST(o_orderkey % 97 AS DOUBLE) / 4 - 3 + CAST(o_custkey % 7 AS DOUBLE) / 5 AS hi, 20 AS n FROM orders)"
_CUT = "CAST(greatest(floor({}), 0) AS BIGINT)"


@query(f"""WITH {_SPANS}, f AS (SELECT *, {_CUT.format('lo + 0.5::DOUBLE + 1e-9::DOUBLE')} AS a, least({_CUT.format('hi + 0.5::DOUBLE + 1e-9::DOUBLE')}, n) AS b, (lo + hi) * 0.5::DOUBLE AS c FROM s)
SELECT id, CAST(CASE WHEN a < b THEN a ELSE least({_CUT.format('c')}, n - 1) END AS BIGINT) AS s0, CAST(CASE WHEN a < b THEN b ELSE least({_CUT.format('c')}, n - 1) + 1 END AS BIGINT) AS s1,
CAST(CASE WHEN a < b THEN a WHEN c >= 0 AND floor(c) < n THEN floor(c) ELSE 0 END AS BIGINT) AS g0, CAST(CASE WHEN a < b THEN b WHEN c >= 0 AND floor(c) < n THEN floor(c) + 1 ELSE 0 END AS BIGINT) AS g1 FROM f""")
def sample_span(spark, sf):
    k = F.col("o_orderkey")
    o = V.table(spark, sf, "orders").select(k.alias("id"), ((k % 97).cast("double") / 4 - 3).alias("lo"), F.col("o_custkey"))
    o = o.withColumn("hi", F.col("lo") + (F.col("o_custkey") % 7).cast("double") / 5)
    s, g = G.sample_span(F.col("lo"), F.col("hi"), F.lit(20)), G.grid_span(F.col("lo"), F.col("hi"), F.lit(20))
    return o.select("id", s["first"].cast("bigint").alias("s0"), s["last"].cast("bigint").alias("s1"), g["first"].cast("bigint").alias("g0"), g["last"].cast("bigint").alias("g1"))


@query(r"""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, CASE l_linenumber % 5 WHEN 0 THEN ' ' || CAST(l_quantity AS VARCHAR) || ' m' WHEN 1 THEN '+.5m' WHEN 2 THEN 'about 3'
WHEN 3 THEN CAST(l_linenumber AS VARCHAR) || '..5' ELSE '-7e3' END AS s FROM lineitem)
SELECT id, TRY_CAST(nullif(regexp_extract(trim(s), '^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)', 0), '') AS DOUBLE) AS n FROM t""")
def leading_number(spark, sf):
    k = F.col("l_linenumber")
    s = (
        F.when(k % 5 == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit(" m")))
        .when(k % 5 == 1, "+.5m")
        .when(k % 5 == 2, "about 3")
        .when(k % 5 == 3, F.concat(k.cast("string"), F.lit("..5")))
        .otherwise("-7e3")
    )
    return V.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + k).alias("id"), T.leading_number(s).alias("n"))


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 7 = 0 THEN CAST(p_size AS DOUBLE) END AS z, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size - 20 AS DOUBLE) END AS h, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size % 6 AS DOUBLE) END AS l FROM part)
SELECT id, CASE WHEN z IS NOT NULL THEN 0 ELSE 1 END AS datum, coalesce(z, CASE WHEN h > 0 THEN h END, CASE WHEN l > 0 THEN l * 3 END, 6.0::DOUBLE) AS metres,
CASE WHEN z IS NOT NULL THEN 'absolute' WHEN h > 0 THEN 'height' WHEN l > 0 THEN 'levels' ELSE 'default' END AS source FROM t""")
def height_ladder(spark, sf):
    k, size = F.col("p_partkey"), F.col("p_size")
    height = F.when(k % 2 == 0, F.create_map(F.when(k % 4 == 0, "height").otherwise("render_height"), F.concat((size - 20).cast("string"), F.lit(" m"))))
    levels = F.when(k % 3 == 0, F.create_map(F.lit("building:levels"), (size % 6).cast("string")))
    none = F.create_map().cast("map<string,string>")
    tags = F.map_concat(F.coalesce(height, none), F.coalesce(levels, none))
    got = T.building_height(F.when(k % 7 == 0, size.cast("double")), tags)
    return V.table(spark, sf, "part").select(k.alias("id"), got.alias("h")).select("id", "h.datum", "h.metres", "h.source")


@query(r"""SELECT page_id, left(sha256(split_part(url, '?', 1) || chr(10) || 'terrarium'), 16) AS key, split_part(url, '?', 1) AS template FROM pages""")
def service_key(spark, sf):
    p = V.table(spark, sf, "pages")
    return p.select("page_id", T.service_key(F.col("url"), F.lit("Terrarium")).alias("key"), F.substring_index("url", "?", 1).alias("template"))


@query("""WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey % 3 AS kind, l_partkey % 64 AS x, l_suppkey % 64 AS y FROM lineitem),
m AS (SELECT *, CASE WHEN kind = 2 THEN ['https://tiles.example.org/{z}/{x}/{y}.png'] ELSE ['https://s3.amazonaws.com/b/p/{z}/{x}/{y}.png', 'https://b.s3.amazonaws.com/p/{z}/{x}/{y}.png', 'https://s3.us-east-1.amazonaws.com/b/p/{z}/{x}/{y}.png',
'https://b.s3.us-east-1.amazonaws.com/p/{z}/{x}/{y}.png', 'https://s3.dualstack.us-east-1.amazonaws.com/b/p/{z}/{x}/{y}.png', 'https://b.s3.dualstack.us-east-1.amazonaws.com/p/{z}/{x}/{y}.png'] END AS ts FROM t)
SELECT id, replace(replace(replace(ts[(x + y) % len(ts) + 1], '{z}', '12'), '{x}', CAST(x AS VARCHAR)), '{y}', CAST(y AS VARCHAR)) AS url FROM m""")
def url_shards(spark, sf):
    li, kind = V.table(spark, sf, "lineitem"), F.col("l_orderkey") % 3
    path = "/p/{z}/{x}/{y}.png"
    t = F.when(kind == 0, "https://s3.amazonaws.com/b" + path).when(kind == 1, "https://b.s3.amazonaws.com" + path).otherwise("https://tiles.example.org/{z}/{x}/{y}.png")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), T.tile_url(t, F.lit(12), F.col("l_partkey") % 64, F.col("l_suppkey") % 64).alias("url"))


@query(r"""WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '/data/wp_' || o_custkey || '/a.bit' WHEN 1 THEN '/data/wp_x9/a.bit' WHEN 2 THEN '/data/a.tif' ELSE '/wp_5/wp_6/a.bit' END AS path FROM orders)
SELECT id, coalesce(TRY_CAST(regexp_extract(path, 'wp_([^/\\]*)', 1) AS BIGINT), 0) AS waypoint FROM p""")
def wp_id(spark, sf):
    k = F.col("o_orderkey")
    own = F.concat(F.lit("/data/wp_"), F.col("o_custkey").cast("string"), F.lit("/a.bit"))
    path = F.when(k % 4 == 0, own).when(k % 4 == 1, "/data/wp_x9/a.bit").when(k % 4 == 2, "/data/a.tif").otherwise("/wp_5/wp_6/a.bit")
    return V.table(spark, sf, "orders").select(k.alias("id"), T.waypoint_id(path).alias("waypoint"))


@query(r"""WITH d AS (SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN [1, 1, 0, 2, 2048, 0, 1, 4150, 3072, 0, 1, 2056] WHEN 1 THEN [1, 1, 0, 1, 2048, 0, 1, 4326] WHEN 2 THEN [1, 1, 0, 2, 2048, 0, 1, 4326, 3072, 0, 1, 32767] WHEN 3 THEN [1, 1, 0, 1, 3072, 34737, 1, 2056] ELSE [1, 1] END AS d,
  CASE c_custkey % 3 WHEN 0 THEN 'EPSG:4326' WHEN 1 THEN 'epsg:2056' ELSE 'EPSG:99999' END AS crs FROM customer),
e AS (SELECT id, crs, len(d) AS n, list_transform(range(0, greatest(least(coalesce(d[4], 0), (len(d) - 4) // 4), 0)), lambda i: {'key': d[4 * i + 5], 'place': d[4 * i + 6], 'v': d[4 * i + 8]}) AS keys FROM d),
f AS (SELECT id, crs, n, list_filter(keys, lambda k: k.key = 3072 AND k.place = 0)[-1].v AS projected, list_filter(keys, lambda k: k.key = 2048 AND k.place = 0)[-1].v AS geographic FROM e)
SELECT id, CAST(CASE WHEN n >= 4 THEN nullif(nullif(coalesce(projected, geographic), 0), 32767) END AS INT) AS epsg, CASE TRY_CAST(regexp_extract(upper(crs), '^EPSG:([0-9]+)$', 1) AS INT) WHEN 4326 THEN '+proj=longlat +datum=WGS84' WHEN 2056 THEN '+proj=somerc (LV95)' WHEN 3857 THEN '+proj=webmerc' WHEN 21781 THEN '+proj=somerc (LV03)' END AS definition FROM f""")
def geokey_epsg(spark, sf):
    k = F.col("c_custkey")
    keys = lambda *v: F.array(*[F.lit(x) for x in v])
    d = (
        F.when(k % 5 == 0, keys(1, 1, 0, 2, 2048, 0, 1, 4150, 3072, 0, 1, 2056))
        .when(k % 5 == 1, keys(1, 1, 0, 1, 2048, 0, 1, 4326))
        .when(k % 5 == 2, keys(1, 1, 0, 2, 2048, 0, 1, 4326, 3072, 0, 1, 32767))
        .when(k % 5 == 3, keys(1, 1, 0, 1, 3072, 34737, 1, 2056))
        .otherwise(keys(1, 1))
    )
    crs = F.when(k % 3 == 0, "EPSG:4326").when(k % 3 == 1, "epsg:2056").otherwise("EPSG:99999")
    return V.table(spark, sf, "customer").select(k.alias("id"), T.epsg_of_geokeys(d).alias("epsg"), T.crs_definition(crs).alias("definition"))


@query(r"""WITH t AS (SELECT s_suppkey AS id, lower(trim(CASE s_suppkey % 4 WHEN 0 THEN 'NaN' WHEN 1 THEN ' -inf ' WHEN 2 THEN '-9999' ELSE 'none' END)) AS low, CASE WHEN s_suppkey % 2 = 0 THEN '<M><Item name="SCALE" sample="0" role="scale">0.5</Item></M>' ELSE '<M></M>' END AS xml,
  s_suppkey % 3 + 1 AS kind, [8, 16, 32][s_suppkey % 3 + 1] AS bits, [1, 5, 8, 99][s_suppkey % 4 + 1] AS code FROM supplier)
SELECT id, CASE WHEN low IN ('nan', '-nan') THEN 'nan' WHEN low IN ('inf', '+inf', 'infinity') THEN 'inf' WHEN low IN ('-inf', '-infinity') THEN '-inf' ELSE CAST(TRY_CAST(low AS DOUBLE) AS VARCHAR) END AS nodata, TRY_CAST(nullif(regexp_extract(xml, 'name="SCALE"[^>]*>([^<]*)<', 1), '') AS DOUBLE) AS scale,
['uint', 'int', 'float'][kind] || bits AS dtype, CASE code WHEN 1 THEN 'none' WHEN 5 THEN 'lzw' WHEN 7 THEN 'jpeg' WHEN 8 THEN 'deflate' WHEN 32773 THEN 'packbits' ELSE 'unknown-' || code END AS compression, code IN (1, 5, 8, 32773, 32946) AS decodable FROM t""")
def header_texts(spark, sf):
    k = F.col("s_suppkey")
    nodata = F.when(k % 4 == 0, "NaN").when(k % 4 == 1, " -inf ").when(k % 4 == 2, "-9999").otherwise("none")
    xml = F.when(k % 2 == 0, '<M><Item name="SCALE" sample="0" role="scale">0.5</Item></M>').otherwise("<M></M>")
    kind, bits = F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).otherwise(3), F.when(k % 3 == 0, 8).when(k % 3 == 1, 16).otherwise(32)
    code = F.when(k % 4 == 0, 1).when(k % 4 == 1, 5).when(k % 4 == 2, 8).otherwise(99)
    s = V.table(spark, sf, "supplier")
    return s.select(k.alias("id"), T.nodata_text(nodata).alias("nodata"), T.metadata_item(xml, "SCALE").alias("scale"), T.dtype_name(kind, bits).alias("dtype"), T.compression_name(code).alias("compression"), code.isin(*T.DECODABLE).alias("decodable"))


@query(r"""WITH t AS (SELECT s_suppkey AS id, trim(CASE WHEN s_suppkey % 3 = 0 THEN ' ' || s_suppkey ELSE 'soon' END) AS said, CASE WHEN s_suppkey % 2 = 0 THEN '12_' || s_suppkey || '_7.pbf' ELSE '12_7.pbf' END AS name FROM supplier)
SELECT id, least(CASE WHEN regexp_full_match(said, '[0-9]+') THEN CAST(said AS BIGINT) END, CASE WHEN regexp_full_match(said, '[0-9]+') THEN 120 END) AS wait, TRY_CAST(nullif(regexp_extract(name, '^([0-9]+)_([0-9]+)_([0-9]+)\.(pbf|mvt)$', 1), '') AS INT) AS z,
TRY_CAST(nullif(regexp_extract(name, '^([0-9]+)_([0-9]+)_([0-9]+)\.(pbf|mvt)$', 2), '') AS INT) AS x, CAST(xor(id >> 1, -(id & 1)) AS BIGINT) AS zig FROM t""")
def codes_and_names(spark, sf):
    k = F.col("s_suppkey")
    wait = F.when(k % 3 == 0, F.concat(F.lit(" "), k.cast("string"))).otherwise("soon")
    name = F.when(k % 2 == 0, F.concat(F.lit("12_"), k.cast("string"), F.lit("_7.pbf"))).otherwise("12_7.pbf")
    key = T.tile_key_of_name(name)
    return V.table(spark, sf, "supplier").select(k.alias("id"), T.retry_after(wait).alias("wait"), key["z"].alias("z"), key["x"].alias("x"), G.zigzag(k).alias("zig"))
