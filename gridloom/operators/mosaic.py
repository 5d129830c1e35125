"""Mosaics of coverage rasters: per-cell maximum, count and contributors, grids and pyramids.

A raster is a relation (src, x, y, raw) of its non-empty cells; tiling partitions it. All
aggregates here combine on the map side and shuffle once, on the cell or the tile.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

COUNT_TOP = 65535  #: counts saturate there
ID_RANGE = 65536  #: ids wrap there
ODD_STEP = 0.01  #: share by which a raster's steps may differ from the first one's


def valid_cells(cells: DataFrame) -> DataFrame:
    """Zero is no coverage, whatever a file's nodata says."""
    return cells.where("raw <> 0")


def max_and_count(cells: DataFrame) -> DataFrame:
    """(x, y, max_raw, n_src): highest value and saturating number of sources of each covered cell."""
    return valid_cells(cells).groupBy("x", "y").agg(F.max("raw").alias("max_raw"), F.least(F.count(F.lit(1)), F.lit(COUNT_TOP)).cast("int").alias("n_src"))


def contributors(cells: DataFrame) -> DataFrame:
    """(x, y, ids): ids of the sources of each covered cell in input order, wrapped to 16 bits.

    cells: src, x, y, raw and `pos`, the place of the source in the input. A source is in a
    cell once, so lists are bounded by the sources.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "src")))
    return valid_cells(cells).groupBy("x", "y").agg(F.transform(listed, lambda s: s["src"] % ID_RANGE).alias("ids"))


def csr_offsets(cells: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, cell, n, first): place of each cell's id list in its tile's flat list, cells in row order."""
    n = valid_cells(cells).groupBy("x", "y").agg(F.count(F.lit(1)).alias("n"))
    n = n.select(F.floor(F.col("x") / tile).alias("tx"), F.floor(F.col("y") / tile).alias("ty"), ((F.col("y") % tile) * tile + F.col("x") % tile).alias("cell"), "n")
    upto = W.partitionBy("tx", "ty").orderBy("cell").rowsBetween(W.unboundedPreceding, W.currentRow)
    return n.withColumn("first", F.sum("n").over(upto) - F.col("n"))


def tile_statistics(cells: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, low, high, most): least and greatest maximum and greatest count of each tile; global ones combine these."""
    at = lambda c: F.floor(F.col(c) / tile)
    return (
        max_and_count(cells)
        .groupBy(at("x").alias("tx"), at("y").alias("ty"))
        .agg(F.min("max_raw").alias("low"), F.max("max_raw").alias("high"), F.max("n_src").alias("most"))
    )


def master_grid(rasters: DataFrame) -> DataFrame:
    """One row: the union of all extents at the first raster's steps, and n_odd: how many rasters' steps differ from those by over 1 %.

    rasters: pos, left, top, step_x, step_y (negative), width, height.
    """
    # fixed-width values, so the aggregate stays a hash aggregate
    first = rasters.agg(F.min_by("step_x", "pos").alias("step_x"), F.min_by("step_y", "pos").alias("step_y"))
    off = lambda c: F.abs(F.col(c) - F.col(f"s.{c}")) / F.abs(F.col(f"s.{c}")) > ODD_STEP
    box = rasters.alias("r").join(F.broadcast(first).alias("s")).select("r.*", F.struct("s.step_x", "s.step_y").alias("s")).agg(
        F.min("left").alias("left"),
        F.max("top").alias("top"),
        F.max(F.col("left") + F.col("width") * F.col("step_x")).alias("right"),
        F.min(F.col("top") + F.col("height") * F.col("step_y")).alias("bottom"),
        F.any_value("s").alias("s"),
        F.count_if(off("step_x") | off("step_y")).alias("n_odd"),
    )
    return box.select(
        "left",
        "top",
        F.col("s.step_x").alias("step_x"),
        F.col("s.step_y").alias("step_y"),
        F.round((F.col("right") - F.col("left")) / F.col("s.step_x")).cast("bigint").alias("width"),
        F.round((F.col("top") - F.col("bottom")) / F.abs(F.col("s.step_y"))).cast("bigint").alias("height"),
        "n_odd",
    )


def tile_sources(rasters: DataFrame, grid: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, pos): which rasters touch which tile of the grid.

    A range join made an equi-join: every raster lists its own tiles. The grid is one
    row by construction, so it is broadcast.
    """
    g = F.broadcast(grid.select(*[F.col(c).alias(f"g_{c}") for c in ("left", "top", "step_x", "step_y", "width", "height")]))
    r = rasters.join(g)
    low = lambda edge, origin, step: F.floor(F.greatest(F.floor((F.col(edge) - F.col(origin)) / F.col(step)), F.lit(0)) / tile)

    def high(edge, origin, step, size):
        px = F.greatest(F.ceil((edge - F.col(origin)) / F.col(step)), F.lit(0))
        return F.least(F.ceil(px / tile), F.ceil(F.col(size) / tile)) - 1

    right, bottom = F.col("left") + F.col("width") * F.col("step_x"), F.col("top") + F.col("height") * F.col("step_y")
    r = r.withColumns(
        {
            "x0": low("left", "g_left", "g_step_x"),
            "y0": low("top", "g_top", "g_step_y"),
            "x1": high(right, "g_left", "g_step_x", "g_width"),
            "y1": high(bottom, "g_top", "g_step_y", "g_height"),
        }
    ).where("x0 <= x1 and y0 <= y1")
    return r.withColumn("tx", F.explode(F.sequence("x0", "x1"))).withColumn("ty", F.explode(F.sequence("y0", "y1"))).select("tx", "ty", "pos")


def decimated(cells: DataFrame, factor: int) -> DataFrame:
    """An overview by decimation: the cell at (factor x, factor y), not a maximum of the block."""
    return cells.where((F.col("x") % factor == 0) & (F.col("y") % factor == 0)).withColumns({"x": F.floor(F.col("x") / factor), "y": F.floor(F.col("y") / factor)})


def overview_levels(width: int, height: int, least: int = 256) -> list[int]:
    """Factors 4, 16, ... until both sides are at most `least`."""
    out, f = [], 4
    while max(width, height) * 4 // f > least:
        out.append(f)
        f *= 4
    return out


def pyramid(cells: DataFrame, factors: list[int]) -> DataFrame:
    """(level, x, y, ...) of every overview, from one scan: a cell goes to each level whose factor divides it."""
    level = F.explode(F.array(*[F.lit(f) for f in factors]))
    c = cells.withColumn("level", level).where("x % level = 0 and y % level = 0")
    return c.withColumns({"x": F.floor(F.col("x") / F.col("level")), "y": F.floor(F.col("y") / F.col("level"))})


def export_factors(width):
    """Overview factors of an export: none up to 2048 pixels; else 4, 16, ... while width / factor > 256, and one more."""
    powers = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda k: F.pow(F.lit(4.0), k).cast("bigint"))
    tall = F.filter(powers, lambda f: (f == 1) | (F.floor(width / f) > 256))
    return F.when(width > 2048, F.transform(tall, lambda f: f * 4)).otherwise(F.array().cast("array<bigint>"))


def retiled(cells: DataFrame, tile: int) -> DataFrame:
    """(tx, ty, n, total): cells regrouped into other tiles; tiles of zeros only go."""
    at = lambda c: F.floor(F.col(c) / tile)
    grouped = cells.groupBy(at("x").alias("tx"), at("y").alias("ty")).agg(F.count_if(F.col("raw") != 0).alias("n"), F.sum("raw").cast("bigint").alias("total"), F.max("raw").alias("high"))
    return grouped.where("high > 0").drop("high")


def on_master_grid(cells: DataFrame, rasters: DataFrame, grid: DataFrame) -> DataFrame:
    """(src, x, y, raw): source cells on the master grid, equal cells by an exact offset, others by the nearest centre.

    cells: pos, x, y, raw; rasters: pos, src, left, top, step_x, step_y, width, height; grid: one row. Steps within 1e-5
    and offsets within 1e-3 of a whole cell are taken as exact. Otherwise an output cell k reads the source cell
    round(base + k * step); each source cell lists the few k that may do so and keeps those that do.
    """
    g = F.broadcast(grid.select(*[F.col(c).alias(f"g_{c}") for c in ("left", "top", "step_x", "step_y", "width", "height")]))
    meta = rasters.join(g)
    for a, o in (("x", "left"), ("y", "top")):
        meta = meta.withColumn(f"base_{a}", (F.col(f"g_{o}") - F.col(o)) / F.col(f"step_{a}")).withColumn(f"rate_{a}", F.col(f"g_step_{a}") / F.col(f"step_{a}"))
    near = lambda c, d: F.abs(c) < d
    whole = lambda a: near(F.col(f"rate_{a}") - 1, 1e-5) & near(F.col(f"base_{a}") - F.round(f"base_{a}"), 1e-3)
    meta = meta.withColumn("exact", whole("x") & whole("y"))
    c = cells.where("raw <> 0").join(meta.select("pos", "src", "exact", "base_x", "base_y", "rate_x", "rate_y", "g_width", "g_height"), "pos")
    for a in ("x", "y"):
        base, rate, at = F.col(f"base_{a}"), F.col(f"rate_{a}"), F.col(a)
        low = F.floor((at - 0.5 - base) / rate) - 1
        tries = F.sequence(low, F.ceil((at + 0.5 - base) / rate) + 1)
        c = c.withColumn(f"m{a}", F.explode(F.when(F.col("exact"), F.array((at - F.round(base)).cast("bigint"))).otherwise(F.filter(tries, lambda k: F.round(base + k * rate) == at))))
    return c.where("mx between 0 and g_width - 1 and my between 0 and g_height - 1").select("src", F.col("mx").alias("x"), F.col("my").alias("y"), "raw", "pos")


def pixel_values(tiles: DataFrame, points: DataFrame, tile: int, width: int, height: int, bits: int = 8) -> DataFrame:
    """points (x, y and more) with `value`: the cell of a tiled raster there; outside it, or where a tile is absent, 0 (65535 for 16 bits).

    tiles: tx, ty and cells (an array, row by row).
    """
    blank = ID_RANGE - 1 if bits == 16 else 0
    at = lambda c: F.when(F.col(c) >= 0, F.floor(F.col(c) / tile))
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, height - 1)
    held = points.withColumns({"_tx": at("x"), "_ty": at("y")}).join(tiles.select(F.col("tx").alias("_tx"), F.col("ty").alias("_ty"), "cells"), ["_tx", "_ty"], "left")
    cell = F.try_element_at("cells", (F.pmod("y", F.lit(tile)) * tile + F.pmod("x", F.lit(tile)) + 1).cast("int"))
    return held.withColumn("value", F.when(inside, F.coalesce(cell, F.lit(blank))).otherwise(blank)).drop("_tx", "_ty", "cells")


def browser_factors(width):
    """Overview factors of the browser's export: none up to 2048 pixels; else 4, and 16, 64, ... while width / factor > 256."""
    powers = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda k: F.pow(F.lit(4.0), k).cast("bigint"))
    return F.when(width > 2048, F.filter(powers, lambda f: (f == 4) | (F.floor(width / f) > 256))).otherwise(F.array().cast("array<bigint>"))
