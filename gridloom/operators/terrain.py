"""Terrain: area means, prioritised overlay, seam filter, ground statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions.elevation import FLOOR, VOID, XYZ_VOID_M, exact_mean

# Fixed values of the seam filter.
NOTCH_M = 2200.0
REACH = 2
LEAST_ZOOM = 11


def area_mean(samples: DataFrame, *cell: str) -> DataFrame:
    """(cell..., mean, n): exact integer mean of the valid half-metre samples under each cell; void without any.

    samples: the cell columns and v. Halves round away from zero; one sample passes unchanged.
    """
    ok = F.when(F.col("v") > FLOOR, F.col("v").cast("bigint"))
    total, n = F.sum(ok), F.count(ok)
    return samples.groupBy(*cell).agg(F.coalesce(exact_mean(F.coalesce(total, F.lit(0)), n), F.lit(VOID)).cast("int").alias("mean"), n.alias("n"))


def overlay(samples: DataFrame, *cell: str) -> DataFrame:
    """(cell..., v, priority): of each cell the value of the first source, by priority, that is valid there."""
    found = samples.where(F.col("v") > FLOOR).groupBy(*cell).agg(F.min_by("v", "priority").alias("v"), F.min("priority").alias("priority"))
    return found


def void_statistics(cells: DataFrame, *group: str) -> DataFrame:
    """(group..., covered_px, void_px, base): counts and the lowest valid sample, 0 without any."""
    ok = F.col("v") > FLOOR
    return cells.groupBy(*group).agg(F.count_if(ok).alias("covered_px"), F.count_if(~ok).alias("void_px"), F.coalesce(F.min(F.when(ok, F.col("v"))), F.lit(0)).alias("base"))


def nearest_rank(samples: DataFrame, key: str, value: str, how: str) -> DataFrame:
    """(key, value): the nearest-rank minimum, tenth (p10) or middle (median) of each key's values.

    Equal values are counted before they meet, so a key costs its distinct values, not
    its samples, and no task holds an array of them.
    """
    n = samples.groupBy(key, value).agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(key)
    n = n.withColumns({"_to": F.sum("_n").over(w.orderBy(value).rowsBetween(W.unboundedPreceding, W.currentRow)), "_all": F.sum("_n").over(w)})
    at = {"min": F.lit(0), "p10": F.floor(F.col("_all") / 10), "median": F.floor(F.col("_all") / 2)}[how]
    return n.where((F.col("_to") > at) & (F.col("_to") - F.col("_n") <= at)).select(key, value)


def ground_level(samples: DataFrame, key: str, how: str = "p10") -> DataFrame:
    """(key, ground): nearest-rank statistic of a footprint's samples: min, p10 or median."""
    return nearest_rank(samples, key, "v", how).withColumnRenamed("v", "ground")


def datum_suspect(roofs: DataFrame, key: str, low: float = 1.0, high: float = 300.0) -> DataFrame:
    """(key, median_rise, suspect): whether over half of a set's roofs lie implausibly above their ground.

    roofs: key and rise (metres of the roof over the ground).
    """
    odd = F.count_if((F.col("rise") < low) | (F.col("rise") > high))
    said = roofs.groupBy(key).agg((odd * 2 > F.count("rise")).alias("suspect"))
    return nearest_rank(roofs, key, "rise", "median").withColumnRenamed("rise", "median_rise").join(said, key)


def _notches(grid: DataFrame, depth: float, reach: int) -> DataFrame:
    """Adds `notch`: a sample deeper than `depth` below both its nearest valid neighbours of an axis, within reach."""
    ok = F.when(F.col("v") > XYZ_VOID_M, F.col("v"))
    row, col = W.partitionBy("tile", "y").orderBy("x"), W.partitionBy("tile", "x").orderBy("y")
    near = lambda w, sign: F.coalesce(*[F.lag(ok, sign * k).over(w) for k in range(1, reach + 1)])
    g = grid.withColumns({"_l": near(row, 1), "_r": near(row, -1), "_a": near(col, 1), "_b": near(col, -1)})
    axis = lambda a, b: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.least(a, b) - F.col("v"))
    deep = lambda d: F.coalesce(d > depth, F.lit(False))
    notch = ok.isNotNull() & (deep(axis("_l", "_r")) | deep(axis("_a", "_b")))
    return g.withColumn("notch", F.coalesce(notch, F.lit(False))).drop("_l", "_r", "_a", "_b")


def seam_filter(grid: DataFrame, zoom: int, depth: float = NOTCH_M, reach: int = REACH) -> DataFrame:
    """grid with `seam`: samples voided as notches along tile seams, in up to `reach` passes.

    grid: tile, x, y and v for every sample of each tile (null or at most the void limit:
    void). A pass sees the voids of the pass before. Coarser zooms than 11 stay as they are.
    """
    g = grid.withColumn("seam", F.lit(False))
    if zoom < LEAST_ZOOM:
        return g
    for _ in range(max(1, reach)):
        g = _notches(g, depth, reach)
        g = g.withColumns({"seam": F.col("seam") | F.col("notch"), "v": F.when(~F.col("notch"), F.col("v"))}).drop("notch")
    return g
