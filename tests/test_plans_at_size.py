"""Plans of larger tables: what is not bounded is not broadcast."""

import re

from pyspark.sql import functions as F

from gridloom.operators import runs, vector
from gridloom.plans import catalog


def burnt(spark):
    point = "struct<px:double,py:double>"
    shapes = spark.createDataFrame([(k, [(0.0, 0.0), (3.0, 0.0), (3.0, 2.0)], k % 3) for k in range(20)], f"id long, ring array<{point}>, rise int")
    cells = spark.range(64).selectExpr("id % 8 AS x", "id div 8 AS y", "int(id) AS v")
    return cells, shapes


def test_footprints_and_shapes_are_not_broadcast(spark):
    cells, shapes = burnt(spark)
    df = vector.burn(cells, shapes, 8)
    assert len(df.collect()) == 64
    plan = df._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin) \[(\w+)#", plan)
    assert joins and not [j for j in joins if j[1] == "id" and j[0] != "SortMergeJoin"]
    # the footprint meets the ground in a merge, too: neither side's estimate sees the listed cells
    assert ("SortMergeJoin", "x") in joins


def test_surface_broadcasts_no_footprint_either(spark):
    cells, shapes = burnt(spark)
    point = "struct<px:double,py:double>"
    woods = spark.createDataFrame([(1, [[(1.0, 1.0), (5.0, 1.0), (5.0, 6.0), (1.0, 6.0)]])], f"id long, rings array<array<{point}>>")
    df = vector.surface(cells, shapes, woods, 8, 30, spark.createDataFrame([(2, 2)], "ox long, oy long"), 1)
    got = {(r["x"], r["y"]): r["burned"] for r in df.collect()}
    assert len(got) == 64 and got[4, 5] == 5 * 8 + 4 + 30 and got[7, 7] == 63
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [id#" not in plan and "SortMergeJoin [id#" in plan


def test_covered_cells_are_not_broadcast(spark, tmp_path):
    """A feature of a few bytes lists any number of cells, which the planner does not see."""
    point = "struct<px:double,py:double>"
    woods = spark.createDataFrame([(1, [[(0.0, 0.0), (60.0, 0.0), (60.0, 60.0), (0.0, 60.0)]])], f"id long, rings array<array<{point}>>")
    woods.write.parquet(f"{tmp_path}/woods.parquet")
    woods = spark.read.parquet(f"{tmp_path}/woods.parquet")
    cells = spark.range(4096).selectExpr("id % 64 AS x", "id div 64 AS y", "1 AS v")
    none = spark.createDataFrame([], f"id long, ring array<{point}>, rise int")
    df = vector.surface(cells, none, woods, 64, 30, spark.createDataFrame([(2, 2)], "ox long, oy long"), 1)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    left = re.findall(r"(BroadcastHashJoin|ShuffledHashJoin|SortMergeJoin) \[x#.*LeftOuter", plan)
    assert left and set(left) == {"SortMergeJoin"}
    assert sum(r["burned"] == 31 for r in df.collect()) == 60 * 60 - 9


def test_every_source_with_every_target_takes_little_disk(spark, tmp_path):
    spark.range(2000).selectExpr("id AS s_suppkey").write.parquet(f"{tmp_path}/supplier.parquet")
    far = spark.range(2100).selectExpr("IF(id % 1000 = 7, NULL, id - id % 2) AS c_custkey")
    far.write.parquet(f"{tmp_path}/customer.parquet")
    catalog.QUERIES["cross_links"](spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    size = sum(p.stat().st_size for p in (tmp_path / "out").glob("*.parquet"))
    got = spark.read.parquet(f"{tmp_path}/out")
    assert got.columns == ["s_suppkey", "c_custkey"] and dict(got.dtypes) == {"s_suppkey": "bigint", "c_custkey": "bigint"}
    # every key as often as it should be, nulls and repeated keys too, with sources that are all different
    met = {r["c_custkey"]: (r["n"], r["s"]) for r in got.groupBy("c_custkey").agg(F.count("*").alias("n"), F.count_distinct("s_suppkey").alias("s")).collect()}
    assert met == {r["c_custkey"]: (r["count"] * 2000, 2000) for r in far.groupBy("c_custkey").count().collect()}
    assert size < 0.25 * 2000 * 2100


def test_pairs_of_a_share_are_not_kept_by_a_loop_over_a_broadcast(spark):
    df = runs.every_link(spark.range(5).toDF("s"), spark.range(9).toDF("t"), 4)
    assert "CartesianProduct" in df._jdf.queryExecution().executedPlan().toString() and df.rdd.getNumPartitions() >= 4 and df.distinct().count() == 45
    assert runs.every_link(spark.range(5).toDF("s"), spark.range(0).toDF("t"), 4).count() == 0


def test_all_cores_take_part_in_every_source_meeting_every_target(spark, tmp_path):
    spark.range(3).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(500).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = catalog.QUERIES["cross_links"](spark, str(tmp_path))
    sizes = got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == 1500 and sum(n > 0 for n in sizes) >= spark.sparkContext.defaultParallelism
