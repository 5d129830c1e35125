"""Resampling between grids: spans, single-precision means, XYZ assembly, chunk planning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridloom.functions import elevation, grids


def float_mean(values: Column) -> Column:
    """Half metres of an ordered array of single-precision metres: the sum in single precision, in order, times the reciprocal of its length.

    Null for an empty array; a single sample is not divided.
    """
    f = lambda x: F.lit(x).cast("float")
    total = F.aggregate(values, f(0.0), lambda a, v: a + v)
    mean = total * (f(1.0) / F.size(values).cast("float")).cast("float")
    return F.when(F.size(values) == 0, None).when(F.size(values) == 1, elevation.half_metres_half_away(F.element_at(values, 1))).otherwise(elevation.half_metres_half_away(mean.cast("float")))


def column_spans(size: int, left: float, step: float, grid_left: float, grid_step: float, width: int, spark) -> DataFrame:
    """(x, first, last): source columns under every output column."""
    x = F.col("x")
    lo, hi = ((F.lit(left) + e * F.lit(step) - F.lit(grid_left)) / F.lit(grid_step) for e in (x, x + 1))
    return spark.range(size).select(F.col("id").alias("x")).select("x", grids.grid_span(lo, hi, F.lit(width)).alias("s")).select("x", "s.first", "s.last")


def assembled(cells: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(ox, oy, half): half metres of the single-precision mean (float_mean) of the valid source cells under each output cell, void without any.

    cells: x, y and v (metres). columns (ox, first, last) and rows (oy, first, last) are
    the spans of one output tile; each lists its source columns or rows, so both joins are
    equi-joins. The mean adds row by row, each from the left; an output cell holds the
    cells of its own footprint and no more.
    """
    listed = lambda s, o, k: s.where("first < last").select(o, F.explode(F.sequence("first", F.col("last") - 1)).alias(k))
    ok = cells.where(F.col("v") > elevation.XYZ_VOID_M).select("x", "y", F.col("v").cast("float").alias("v"))
    under = ok.join(listed(columns, "ox", "x"), "x").join(listed(rows, "oy", "y"), "y")
    both = under.groupBy("ox", "oy").agg(F.array_sort(F.collect_list(F.struct("y", "x", "v"))).alias("s"))
    half = both.select("ox", "oy", float_mean(F.transform("s", lambda s: s["v"])).alias("half"))
    grid = columns.select("ox").crossJoin(rows.select("oy"))  # all cells of the output grid, by definition
    return grid.join(half, ["ox", "oy"], "left").withColumn("half", F.coalesce("half", F.lit(elevation.VOID).cast("smallint")))


def area_average(cells: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(ox, oy, mean): exact integer mean of the valid half-metre samples of a source under each output cell, void without any.

    cells: x, y and v of one source; columns (ox, first, last) and rows (oy, first, last)
    are the spans of the output grid, null or empty where the source has nothing. Sums are
    whole numbers, so they are added up by column before they meet the rows.
    """
    listed = lambda s, o, k: s.where("first < last").select(o, F.explode(F.sequence("first", F.col("last") - 1)).alias(k))
    ok = cells.where(F.col("v") > elevation.FLOOR).select("x", "y", F.col("v").cast("bigint").alias("v"))
    by_column = ok.join(listed(columns, "ox", "x"), "x").groupBy("ox", "y").agg(F.sum("v").alias("s"), F.count(F.lit(1)).alias("n"))
    both = by_column.join(listed(rows, "oy", "y"), "y").groupBy("ox", "oy").agg(elevation.exact_mean(F.sum("s"), F.sum("n")).cast("int").alias("mean"))
    grid = columns.select("ox").crossJoin(rows.select("oy"))  # all cells of the output grid, by definition
    return grid.join(both, ["ox", "oy"], "left").withColumn("mean", F.coalesce("mean", F.lit(elevation.VOID)))


def nearest_assembly(cells: DataFrame, columns: DataFrame, rows: DataFrame) -> DataFrame:
    """(ox, oy, half): the older browser rule: half metres of the one cell nearest to each output cell's middle, 0 where there is none.

    cells: x, y and v (metres); columns (ox, at) and rows (oy, at) give the fractional
    source place of each middle. It rounds half away from zero; rows beyond the last one
    take that, columns beyond the grid have no cell.
    """
    c = columns.select("ox", F.round("at").cast("bigint").alias("x"))
    r = rows.select("oy", F.least(F.greatest(F.round("at"), F.lit(0)), F.lit(255)).cast("bigint").alias("y"))
    half = elevation.half_metres_nearest(F.col("v").cast("float").cast("double")).cast("int")
    return c.crossJoin(r).join(cells.select("x", "y", half.alias("half")), ["x", "y"], "left").select("ox", "oy", F.coalesce("half", F.lit(0)).alias("half"))


def upsampled(cells: DataFrame, edge: int, level: int, child_x: Column, child_y: Column) -> DataFrame:
    """(child, px, py, v): a child tile cut from its ancestor by repeating samples.

    cells: the ancestor's x, y, v and `child` with the child's tile number in child_x and child_y.
    """
    f = 2**level
    ox, oy = child_x * edge - F.floor(child_x / f) * edge * f, child_y * edge - F.floor(child_y / f) * edge * f
    grow = cells.withColumn("px", F.explode(F.sequence(F.col("x") * f - ox, F.col("x") * f - ox + (f - 1))))
    grow = grow.withColumn("py", F.explode(F.sequence(F.col("y") * f - oy, F.col("y") * f - oy + (f - 1))))
    return grow.where(F.col("px").between(0, edge - 1) & F.col("py").between(0, edge - 1)).select("child", "px", "py", "v")


def window_chunks(windows: DataFrame, chunk: int, across: int) -> DataFrame:
    """(id, chunk): chunk numbers under each window. windows: id, x0, x1, y0, y1, half-open."""
    last = lambda c: F.floor((F.col(c) - 1) / chunk)
    cols = windows.where("x0 < x1 and y0 < y1").withColumn("cx", F.explode(F.sequence(F.floor(F.col("x0") / chunk), last("x1"))))
    return cols.select("id", "cx", F.explode(F.sequence(F.floor(F.col("y0") / chunk), last("y1"))).alias("cy")).select("id", (F.col("cy") * across + F.col("cx")).alias("chunk"))


def read_runs(ranges: DataFrame, gap: int, most: int = 8 << 20) -> DataFrame:
    """(file, run, start, stop, n): byte ranges, by their start, merged while at most `gap` bytes lie between and the run stays within `most` bytes.

    ranges: file, start, stop. Whether a range opens a run depends on where the run before
    began, so each file's ranges, which are its chunks, are gone through in order.
    """
    kind = dict(ranges.dtypes)["file"]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        runs: list[list] = []
        for start, stop in sorted(zip(pdf["start"], pdf["stop"], strict=True)):
            if runs and start <= runs[-1][1] + gap and max(stop, runs[-1][1]) - runs[-1][0] <= most:
                runs[-1][1], runs[-1][2] = max(stop, runs[-1][1]), runs[-1][2] + 1
            else:
                runs.append([start, stop, 1])
        out = pd.DataFrame(runs, columns=["start", "stop", "n"])
        out.insert(0, "run", range(1, len(runs) + 1))
        out.insert(0, "file", pdf["file"].iloc[0])
        return out

    return ranges.select("file", "start", "stop").groupBy("file").applyInPandas(fold, f"file {kind}, run long, start long, stop long, n long")


def undo_differences(samples: DataFrame, key: str, bits: int) -> DataFrame:
    """samples with `v`: the running sum of `d` along `i` within a row, modulo 2^bits."""
    w = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return samples.withColumn("v", F.pmod(F.sum("d").over(w), F.lit(2**bits)))


def moved_vertices(steps: DataFrame, key: str) -> DataFrame:
    """steps with the vertices px, py that zig-zag coded moves dx, dy lead to, in order of i."""
    w = W.partitionBy(key).orderBy("i").rowsBetween(W.unboundedPreceding, W.currentRow)
    return steps.withColumns({"px": F.sum(grids.zigzag(F.col("dx"))).over(w), "py": F.sum(grids.zigzag(F.col("dy"))).over(w)})
