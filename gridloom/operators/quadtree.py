"""Tile pyramids keyed by (z, x, y): filling from ancestors, deriving parents, fetch sets and repair."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST_FILL_ZOOM = 6
REAL = 10**19  #: lifts the rank of real data over that of any derived entry


def fill_from_ancestors(wanted: DataFrame, tiles: DataFrame, levels: int) -> DataFrame:
    """wanted (z, x, y) with `v` and `filled_zoom` of the finest tile with data at or above it, down to zoom 6.

    Each wanted tile lists its ancestors, so one equi-join finds all levels; no level costs a join of its own.
    """
    steps = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("k")
    asked = wanted.select("z", "x", "y", steps).where(F.col("z") - F.col("k") >= LEAST_FILL_ZOOM)
    up = asked.select("z", "x", "y", (F.col("z") - F.col("k")).alias("az"), F.expr("shiftright(x, k)").alias("ax"), F.expr("shiftright(y, k)").alias("ay"))
    have = tiles.where("v is not null").select(F.col("z").alias("az"), F.col("x").alias("ax"), F.col("y").alias("ay"), "v")
    best = up.join(have, ["az", "ax", "ay"]).groupBy("z", "x", "y").agg(F.max_by("v", "az").alias("v"), F.max("az").alias("filled_zoom"))
    return wanted.join(best, ["z", "x", "y"], "left")


def fill_cells(cells: DataFrame, coarser: DataFrame, levels: int) -> DataFrame:
    """cells (z, x, y, edge, px, py, v) with voids (null) filled, and `filled_zoom`: where from.

    A void takes the value of the same ground in the finest coarser tile that has one, at
    most `levels` zooms up and not above zoom 6. coarser: cells of such tiles, in the same
    columns; tiles of another edge are no parents. Each void lists its ancestors' cells,
    so one equi-join finds all levels.
    """
    steps = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("k")
    void = cells.where("v is null").select("z", "x", "y", "edge", "px", "py", steps).where(F.col("z") - F.col("k") >= LEAST_FILL_ZOOM)
    up = void.select(
        "z", "x", "y", "edge", "px", "py", (F.col("z") - F.col("k")).alias("az"), F.expr("shiftright(x, k)").alias("ax"), F.expr("shiftright(y, k)").alias("ay"),
        F.expr("shiftright(x * edge + px, k) - shiftright(x, k) * edge").alias("apx"), F.expr("shiftright(y * edge + py, k) - shiftright(y, k) * edge").alias("apy"),
    )
    names = {"z": "az", "x": "ax", "y": "ay", "px": "apx", "py": "apy", "v": "av"}
    have = coarser.where("v is not null").select("edge", *(F.col(a).alias(b) for a, b in names.items()))
    found = up.join(have, ["az", "ax", "ay", "edge", "apx", "apy"]).groupBy("z", "x", "y", "px", "py").agg(F.max_by("av", "az").alias("_v"), F.max("az").alias("filled_zoom"))
    return cells.join(found, ["z", "x", "y", "px", "py"], "left").withColumn("v", F.coalesce("v", "_v")).drop("_v")


def derive_parent_cells(tiles: DataFrame, cells: DataFrame, encode=None) -> DataFrame:
    """(z, x, y, edge, px, py, v): cells of the parents whose four children are all known.

    tiles: z, x, y, status ('ok', '404', 'missing') and edge; cells: z, x, y, px, py and v
    (null: void) of the ok ones. A parent's cell is the double-precision mean of the valid
    ones of its 2 x 2 cells, run through `encode` (metres to the metres that the code
    keeps); a 404 child's quadrant is void. Four 404 children make no tile, children whose
    edges differ or do not halve none either.
    """
    up = lambda c: F.expr(f"shiftright({c}, 1)").alias(c)
    ok = F.when(F.col("status") == "ok", F.col("edge"))
    key = [(F.col("z") - 1).alias("z"), up("x"), up("y")]
    good = tiles.where("status <> 'missing'").groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), F.min(ok).alias("edge"), F.max(ok).alias("_e"))
    good = good.where("_n = 4 and edge = _e and edge >= 2 and edge % 2 = 0").select("z", "x", "y", "edge")
    held = cells.join(tiles.where("status = 'ok'").select("z", "x", "y"), ["z", "x", "y"], "left_semi")
    c = held.select(*key, (F.col("x") % 2).alias("_dx"), (F.col("y") % 2).alias("_dy"), "px", "py", "v").join(good, ["z", "x", "y"])
    half = F.floor(F.col("edge") / 2)
    at = lambda d, p: (F.col(d) * half + F.floor(F.col(p) / 2)).alias(p)
    mean = c.select("z", "x", "y", at("_dx", "px"), at("_dy", "py"), "v").groupBy("z", "x", "y", "px", "py").agg(F.avg("v").alias("v"))
    mean = mean if encode is None else mean.withColumn("v", F.when(F.col("v").isNotNull(), encode(F.col("v"))))
    line = F.sequence(F.lit(0).cast("bigint"), F.col("edge").cast("bigint") - 1)
    grid = good.withColumn("px", F.explode(line)).withColumn("py", F.explode(line))
    return grid.join(mean, ["z", "x", "y", "px", "py"], "left").select("z", "x", "y", "edge", "px", "py", "v")


def derive_parents(tiles: DataFrame) -> DataFrame:
    """(z, x, y, v) of the parents whose four children are all there; `404` children count as void.

    tiles: z, x, y, status ('ok', '404', 'missing') and v. v is the mean of the children with data.
    """
    there = tiles.where("status <> 'missing'")
    up = there.groupBy((F.col("z") - 1).alias("z"), F.expr("shiftright(x, 1)").alias("x"), F.expr("shiftright(y, 1)").alias("y"))
    return up.agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("status") == "ok", F.col("v"))).alias("v")).where("n = 4").drop("n")


def derivable(tiles: DataFrame, levels: int = 4) -> DataFrame:
    """(z, x, y, depth): keys that can be built from held tiles alone, and over how many levels at most; keys only, no payload."""
    now = tiles.select("z", "x", "y").distinct()
    out = None
    for depth in range(1, levels + 1):
        up = now.groupBy((F.col("z") - 1).alias("z"), F.expr("shiftright(x, 1)").alias("x"), F.expr("shiftright(y, 1)").alias("y"))
        now = up.agg(F.count(F.lit(1)).alias("n")).where("n = 4").select("z", "x", "y")
        one = now.withColumn("depth", F.lit(depth))
        out = one if out is None else out.unionByName(one)
    return out


def fetch_set(specs: DataFrame, zoom: int) -> DataFrame:
    """(z, x, y): the distinct source tiles under any output rectangle. specs: x0, x1, y0, y1."""
    keys = specs.withColumn("x", F.explode(F.sequence("x0", "x1"))).withColumn("y", F.explode(F.sequence("y0", "y1")))
    return keys.select(F.lit(zoom).alias("z"), "x", "y").distinct()


def cache_index(wanted: DataFrame, cached: DataFrame, buildable: DataFrame) -> DataFrame:
    """wanted with `plan`: hit, derivable or miss."""
    k = ["z", "x", "y"]
    w = wanted.join(cached.select(*k).distinct().withColumn("_hit", F.lit(1)), k, "left")
    w = w.join(buildable.select(*k).distinct().withColumn("_build", F.lit(1)), k, "left")
    return w.select(*k, F.when(F.col("_hit") == 1, "hit").when(F.col("_build") == 1, "derivable").otherwise("miss").alias("plan"))


def repair_mask(footprints: DataFrame, listed: DataFrame) -> DataFrame:
    """(cell, rewrite): a cell is rewritten only if every source tile under it is listed with data.

    footprints: cell and the keys x, y under it.
    """
    hit = footprints.join(listed.select("x", "y").distinct().withColumn("_in", F.lit(True)), ["x", "y"], "left")
    return hit.groupBy("cell").agg(F.every(F.coalesce("_in", F.lit(False))).alias("rewrite"))


def repaired(existing: DataFrame, fresh: DataFrame, footprints: DataFrame, listed: DataFrame) -> DataFrame:
    """existing (cell, v) with the values of fresh (cell, v) wherever every source tile under the cell is listed with data.

    Cells that have no footprint, or no fresh value, stay as they are.
    """
    mask = repair_mask(footprints, listed).where("rewrite").select("cell")
    new = fresh.join(mask, "cell").select("cell", F.col("v").alias("_v"), F.lit(True).alias("rewritten"))
    out = existing.join(new, "cell", "left")
    return out.select("cell", F.coalesce("_v", "v").alias("v"), F.coalesce("rewritten", F.lit(False)).alias("rewritten"))


def merge_packs(entries: DataFrame) -> DataFrame:
    """One entry per key: real data before derived, then the latest. entries: key, derived, seq (of one key all different) and more.

    The winner's rank is a hash aggregate of a number; its row comes by a join on (key, rank).
    """
    rank = F.col("seq").cast("decimal(20,0)") + F.when(F.col("derived"), F.lit(0).cast("decimal(20,0)")).otherwise(F.lit(str(REAL)).cast("decimal(20,0)"))
    e = entries.withColumn("_rank", rank)
    best = e.groupBy("key").agg(F.max("_rank").alias("_rank"))
    return e.join(best, ["key", "_rank"]).drop("_rank")
