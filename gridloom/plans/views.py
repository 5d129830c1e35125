"""Raster-shaped views of the star-schema tables, in DataFrame form and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    key = [F.col("l_suppkey").alias("src"), (F.col("l_orderkey") % 64).alias("x"), (F.col("l_partkey") % 32).alias("y")]
    return line.groupBy(*key).agg(F.max((F.col("l_quantity") * 5).cast("int")).alias("raw"))


def placed_cells(spark: SparkSession, sf: str) -> DataFrame:
    """The cells with their source's place in the input, which follows no order of the ids."""
    return cells(spark, sf).withColumn("pos", F.col("src") * 7919 % 1000003)


PLACE = "src * 7919 % 1000003"

CELLS = """cells AS (SELECT l_suppkey AS src, l_orderkey % 64 AS x, l_partkey % 32 AS y,
  max(CAST(trunc(l_quantity * 5) AS INT)) AS raw FROM lineitem GROUP BY 1, 2, 3)"""


def rasters(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("pos"),
        (F.col("s_suppkey") * 37 % 1000 / 4.0).alias("left"),
        (F.col("s_suppkey") * 53 % 800 / 4.0).alias("top"),
        (0.25 + F.when(F.col("s_suppkey") % 6 == 0, 0.01).otherwise(0.0)).alias("step_x"),
        (-0.25 - F.when(F.col("s_suppkey") % 10 == 0, 0.001).otherwise(0.0)).alias("step_y"),
        (F.col("s_suppkey") % 7 * 64 + 256).alias("width"),
        (F.col("s_suppkey") % 5 * 64 + 128).alias("height"),
    )


RASTERS = """rasters AS (SELECT s_suppkey AS pos, s_suppkey * 37 % 1000 / 4.0::DOUBLE AS "left", s_suppkey * 53 % 800 / 4.0::DOUBLE AS top,
  0.25::DOUBLE + CASE WHEN s_suppkey % 6 = 0 THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END AS step_x, -0.25::DOUBLE - CASE WHEN s_suppkey % 10 = 0 THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END AS step_y, s_suppkey % 7 * 64 + 256 AS width, s_suppkey % 5 * 64 + 128 AS height FROM supplier)"""


def elev(spark: SparkSession, sf: str) -> DataFrame:
    """Half-metre samples of three prioritised sources; errors are void."""
    e = table(spark, sf, "events")
    half = F.when(F.col("event_type") == "error", F.lit(-9999)).otherwise(F.greatest(F.least(((F.col("value") * 10 - 200) * 2), F.lit(32767.0)), F.lit(-9000.0)).cast("int"))
    return e.select("event_id", (F.col("user_id") % 64).alias("gx"), (F.col("event_id") % 64).alias("gy"), (F.col("event_id") % 3).alias("priority"), half.alias("v"), (F.col("value") * 10 - 200).alias("metres"), "event_type")


ELEV = """elev AS (SELECT event_id, user_id % 64 AS gx, event_id % 64 AS gy, event_id % 3 AS priority,
  CASE WHEN event_type = 'error' THEN -9999 ELSE CAST(trunc(greatest(least((value * 10 - 200) * 2, 32767.0::DOUBLE), -9000.0::DOUBLE)) AS INT) END AS v,
  value * 10 - 200 AS metres, event_type FROM events)"""


def xyz(spark: SparkSession, sf: str) -> DataFrame:
    """Held tiles of zoom 15, from line items, and of zooms 14 and 13, from orders."""
    fine = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 32).cast("int").alias("x"), (F.col("l_partkey") % 16).cast("int").alias("y")).distinct()
    status = F.when((7 * F.col("x") + 3 * F.col("y")) % 11 == 0, "missing").when((F.col("x") + F.col("y")) % 13 == 0, "404").otherwise("ok")
    fine = fine.select(F.lit(15).alias("z"), "x", "y", status.alias("status"))
    order = table(spark, sf, "orders").select((F.col("o_orderkey") % 2).alias("up"), (F.col("o_orderkey") % 16).cast("int").alias("a"), (F.col("o_custkey") % 8).cast("int").alias("b")).distinct()
    coarse = order.select((14 - F.col("up")).cast("int").alias("z"), F.when(F.col("up") == 1, F.floor(F.col("a") / 2)).otherwise(F.col("a")).cast("int").alias("x"), F.when(F.col("up") == 1, F.floor(F.col("b") / 2)).otherwise(F.col("b")).cast("int").alias("y")).distinct()
    return fine.unionByName(coarse.withColumn("status", F.lit("ok"))).withColumn("v", F.when(F.col("status") == "ok", (F.col("z") * 1000 + F.col("x") * 17 + F.col("y") * 5).cast("double")))


XYZ = """fine AS (SELECT DISTINCT CAST(l_orderkey % 32 AS INT) AS x, CAST(l_partkey % 16 AS INT) AS y FROM lineitem),
ord AS (SELECT DISTINCT CAST(o_orderkey % 2 AS INT) AS up, CAST(o_orderkey % 16 AS INT) AS a, CAST(o_custkey % 8 AS INT) AS b FROM orders),
keys AS (SELECT 15 AS z, x, y, CASE WHEN (7 * x + 3 * y) % 11 = 0 THEN 'missing' WHEN (x + y) % 13 = 0 THEN '404' ELSE 'ok' END AS status FROM fine
  UNION ALL SELECT DISTINCT 14 - up, CASE WHEN up = 1 THEN a // 2 ELSE a END, CASE WHEN up = 1 THEN b // 2 ELSE b END, 'ok' FROM ord),
xyz AS (SELECT *, CASE WHEN status = 'ok' THEN CAST(z * 1000 + x * 17 + y * 5 AS DOUBLE) END AS v FROM keys)"""


def profile(spark: SparkSession, sf: str) -> DataFrame:
    """One tile of metres with planted notches and voids on the cells that occur."""
    c = cells(spark, sf).select("x", "y").distinct()
    v = F.when((5 * F.col("x") + 3 * F.col("y")) % 19 == 0, None).when((31 * F.col("x") + 17 * F.col("y")) % 23 == 0, -4000.0).otherwise(1000.0 + F.col("x") + F.col("y"))
    return c.select(F.lit(0).alias("tile"), "x", "y", v.cast("double").alias("v"))


PROFILE = CELLS + """,
profile AS (SELECT DISTINCT x, y, CASE WHEN (5 * x + 3 * y) % 19 = 0 THEN NULL WHEN (31 * x + 17 * y) % 23 = 0 THEN -4000.0::DOUBLE ELSE 1000.0::DOUBLE + x + y END AS v FROM cells)"""


def geo(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(k.alias("id"), (k * 37 % 360 - 180 + 0.125).cast("double").alias("lon"), (k * 17 % 170 - 85 + 0.25).cast("double").alias("lat"))


GEO = "geo AS (SELECT c_custkey AS id, CAST(c_custkey * 37 % 360 - 180 + 0.125 AS DOUBLE) AS lon, CAST(c_custkey * 17 % 170 - 85 + 0.25 AS DOUBLE) AS lat FROM customer)"


def shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Rectangles and triangles on a 64 x 64 grid."""
    k = F.col("p_partkey")
    x, y, w, h = k * 7 % 60 + 0.25, k * 11 % 60 + 0.25, k % 5 + 1.5, k % 3 + 1.5
    p = lambda a, b: F.struct(a.cast("double").alias("px"), b.cast("double").alias("py"))
    ring = F.when(k % 2 == 0, F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))).otherwise(F.array(p(x, y), p(x + w, y), p(x, y + h)))
    return table(spark, sf, "part").select(k.alias("id"), (F.col("p_size") % 13).alias("rise"), ring.alias("ring"))


def built(spark: SparkSession, sf: str) -> DataFrame:
    """The shapes with a courtyard in every third and an absolute roof on every fifth."""
    k = F.col("id")
    x, y = k * 7 % 60 + 0.25, k * 11 % 60 + 0.25
    p = lambda a, b: F.struct(a.cast("double").alias("px"), b.cast("double").alias("py"))
    hole = F.array(p(x + 0.25, y + 0.25), p(x + 0.25, y + 1.25), p(x + 1.25, y + 1.25), p(x + 1.25, y + 0.25))
    none = F.array().cast("array<array<struct<px:double,py:double>>>")
    s = shapes(spark, sf).withColumns({"holes": F.when(k % 3 == 0, F.array(hole)).otherwise(none), "absolute": k % 5 == 0})
    return s.withColumn("rise", F.when(F.col("absolute"), (k % 400).cast("int")).otherwise(F.col("rise").cast("int")))


SHAPES = """base AS (SELECT p_partkey AS id, p_size % 13 AS rise, CAST(p_partkey * 7 % 60 + 0.25 AS DOUBLE) AS ox, CAST(p_partkey * 11 % 60 + 0.25 AS DOUBLE) AS oy,
  CAST(p_partkey % 5 + 1.5 AS DOUBLE) AS w, CAST(p_partkey % 3 + 1.5 AS DOUBLE) AS h FROM part),
verts AS (SELECT id, rise, 0 AS i, ox AS px, oy AS py FROM base UNION ALL SELECT id, rise, 1, ox + w, oy FROM base
  UNION ALL SELECT id, rise, 2, CASE WHEN id % 2 = 0 THEN ox + w ELSE ox END, oy + h FROM base UNION ALL SELECT id, rise, 3, ox, oy + h FROM base WHERE id % 2 = 0),
edges AS (SELECT id, rise, i, px, py, coalesce(lead(px) OVER o, first_value(px) OVER o) AS qx, coalesce(lead(py) OVER o, first_value(py) OVER o) AS qy
  FROM verts WINDOW o AS (PARTITION BY id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))"""

HOLES = """built AS (SELECT DISTINCT id, CASE WHEN id % 5 = 0 THEN CAST(id % 400 AS INT) ELSE CAST(rise AS INT) END AS rise, id % 5 = 0 AS absolute, id % 3 = 0 AS court,
  CAST(id * 7 % 60 + 0.25 AS DOUBLE) AS ox, CAST(id * 11 % 60 + 0.25 AS DOUBLE) AS oy FROM edges)"""
