"""Which tiles, sources and files a job has to touch at all, as predicates that go into filters and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import grids

# Fixed values of the tile cache: status codes, and the bytes of a pack before its first body.
PRESENT, NO_TILE, DERIVED = 1, 2, 3
DATA_START = 18 + 256 * 20


def tile_touches(x: Column, y: Column, zoom: Column, ul_lat: Column, ul_lon: Column, span: Column) -> Column:
    """Whether an XYZ tile overlaps the ground of an output tile of `span` degrees, edges not counting."""
    west, east = grids.tile_to_lon(x, zoom), grids.tile_to_lon(x + 1, zoom)
    north, south = grids.tile_to_lat(y, zoom), grids.tile_to_lat(y + 1, zoom)
    return (west < ul_lon + span) & (east > ul_lon) & (south < ul_lat) & (north > ul_lat - span)


def may_hold(source: Column, bounds: Column) -> Column:
    """Whether a projected source can hold a cell centre of a block.

    source: west, east, north, south; bounds: min_e, max_e, min_n, max_n of the centres. A
    bound that is not finite keeps the source.
    """
    finite = F.lit(True)
    for k in ("min_e", "max_e", "min_n", "max_n"):
        finite = finite & ~F.isnan(bounds[k]) & (F.abs(bounds[k]) < F.lit(float("inf")))
    out = (bounds["max_n"] < source["south"]) | (bounds["min_n"] > source["north"]) | (bounds["max_e"] < source["west"]) | (bounds["min_e"] >= source["east"])
    return ~finite | ~out


def row_candidate(source: Column, row: Column) -> Column:
    """Whether a projected source overlaps the box (min_e, max_e, min_n, max_n) of an output row, edges counting."""
    return (source["north"] >= row["min_n"]) & (source["south"] <= row["max_n"]) & (source["east"] >= row["min_e"]) & (source["west"] <= row["max_e"])


def shadowed(sources: DataFrame, bands: DataFrame) -> DataFrame:
    """(band, pos, shadowed): sources that cannot show in a band.

    sources: pos (priority) and box (west, south, east, north), null where unknown; bands:
    band and the same four columns. A source is shadowed if its box misses the band, or if
    what it shares with the band lies in the box of an earlier source; sources without a
    box are never shadowed and shadow none. Each band compares its own candidates, so the
    work is bands times pairs of sources, which are few.
    """
    s = sources.select("pos", F.col("box").alias("b"))
    clip = F.struct(
        F.greatest("b.west", "w").alias("west"), F.greatest("b.south", "s").alias("south"), F.least("b.east", "e").alias("east"), F.least("b.north", "n").alias("north")
    )
    each = bands.select("band", F.col("west").alias("w"), F.col("south").alias("s"), F.col("east").alias("e"), F.col("north").alias("n")).join(F.broadcast(s))
    each = each.withColumn("c", clip)
    listed = each.where("b is not null").groupBy("band").agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("all"))
    held = lambda a: (a["pos"] < F.col("pos")) & (a["b"]["west"] <= F.col("c.west")) & (a["b"]["south"] <= F.col("c.south")) & (a["b"]["east"] >= F.col("c.east")) & (a["b"]["north"] >= F.col("c.north"))
    missed = ~((F.col("c.west") < F.col("c.east")) & (F.col("c.south") < F.col("c.north")))
    out = F.when(F.col("b").isNull(), False).otherwise(missed | F.coalesce(F.exists("all", held), F.lit(False)))
    return each.join(listed, "band", "left").select("band", "pos", out.alias("shadowed"))


def usable_entry(status: Column, offset: Column, length: Column, crc: Column, file_length: Column) -> Column:
    """Whether an entry of a tile pack can be a hit; a body's CRC is looked at when it is read."""
    body = status.isin(PRESENT, DERIVED) & (length > 0) & (offset >= DATA_START) & (offset + length <= file_length)
    return body | ((status == NO_TILE) & (length == 0) & (crc == 0))


def cached_bodies(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """wanted (z, x, y) with `status` and `body` of the cached entries that hold: usable ones whose body has the CRC it was stored with.

    entries: z, x, y, status, offset, length, crc, file_length and body. An absent tile has
    the status NO_TILE and no body; all else is null.
    """
    c = F.col
    good = usable_entry(c("status"), c("offset"), c("length"), c("crc"), c("file_length"))
    whole = (c("status") == NO_TILE) | ((F.octet_length("body") == c("length")) & (F.crc32("body") == c("crc")))
    held = entries.where(good & whole).select("z", "x", "y", "status", F.when(c("status") != NO_TILE, c("body")).alias("body"))
    return wanted.join(held, ["z", "x", "y"], "left")
