"""Web-mercator and degree-grid arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the tile formats.
DEGREE_M = 111111.0
EXTENT_LADDER = ((2, 0.1), (5, 0.25), (10, 0.25), (30, 0.5), (90, 1.0), (250, 2.0))
LARGEST_TILE_PX = 32000.0
SNAP = 1e-9


def lon_to_tile(lon: Column, zoom: Column) -> Column:
    return F.greatest(F.floor((lon + 180.0) / 360.0 * F.pow(F.lit(2.0), zoom)), F.lit(0)).cast("bigint")


def lat_to_tile(lat: Column, zoom: Column) -> Column:
    y = (1.0 - F.asinh(F.tan(F.radians(lat))) / F.pi()) / 2.0 * F.pow(F.lit(2.0), zoom)
    return F.greatest(F.floor(y), F.lit(0)).cast("bigint")


def tile_to_lon(x: Column, zoom: Column) -> Column:
    return x / F.pow(F.lit(2.0), zoom) * 360.0 - 180.0


def tile_to_lat(y: Column, zoom: Column) -> Column:
    return F.degrees(F.atan(F.sinh(F.pi() * (1.0 - 2.0 * y / F.pow(F.lit(2.0), zoom)))))


def tile_to_lat_by_exp(y: Column, zoom: Column) -> Column:
    """The form that vector tiles use; it may differ from tile_to_lat in the last bit."""
    n = F.pi() - 2.0 * F.pi() * y / F.pow(F.lit(2.0), zoom)
    return F.degrees(F.atan(0.5 * (F.exp(n) - F.exp(-n))))


def zoom_for_resolution(res: Column, lat: Column) -> Column:
    z = F.ceil(F.log2((40075000.0 * F.cos(F.radians(lat))) / (res * 256.0)))
    return F.greatest(F.least(z, F.lit(15)), F.lit(0)).cast("int")


def round_at(x: Column, scale: float) -> Column:
    """Rounds half away from zero in binary arithmetic, which differs from a decimal round."""
    return F.round(x * scale) / scale


def extent_degrees(res: Column) -> Column:
    """Edge of a tile by resolution, halved until it fits the largest tile."""
    out = F.lit(EXTENT_LADDER[-1][1])
    for key, extent in reversed(EXTENT_LADDER):
        out = F.when(res <= key, F.lit(extent)).otherwise(out)
    halved = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(12)), lambda k: out / F.pow(F.lit(2.0), k)),
        lambda s: ~((s > 0.05) & (s * DEGREE_M / res > LARGEST_TILE_PX)),
    )
    return F.array_max(halved)


def tile_pixels(extent: Column, res: Column) -> Column:
    """Pixels of a tile's edge: half-even rounding, then up to a multiple of 4."""
    return (F.ceil(F.bround(extent / (res / DEGREE_M)) / 4) * 4).cast("bigint")


def tile_bytes(pixels: Column) -> Column:
    """Bytes of an elevation tile: a 44-byte header and rows padded to 256 bytes."""
    return 44 + F.ceil(pixels * 2 / 256).cast("bigint") * 256 * pixels


def sample_span(lo: Column, hi: Column, dim: Column) -> Column:
    """Half-open range of sample centres under [lo, hi), at least the sample that holds the middle."""
    floor0 = lambda x: F.greatest(F.floor(x), F.lit(0)).cast("bigint")
    start, end = floor0(lo + 0.5 + SNAP), F.least(floor0(hi + 0.5 + SNAP), dim)
    mid = F.least(floor0((lo + hi) * 0.5), dim - 1)
    first = F.when(dim == 0, 0).when(start < end, start).otherwise(mid)
    last = F.when(dim == 0, 0).when(start < end, end).otherwise(mid + 1)
    return F.struct(first.alias("first"), last.alias("last"))


def grid_span(lo: Column, hi: Column, n: Column) -> Column:
    """As sample_span, but empty (0, 0) where the middle lies off the grid."""
    floor0 = lambda x: F.greatest(F.floor(x), F.lit(0)).cast("bigint")
    start, end = floor0(lo + 0.5 + SNAP), F.least(floor0(hi + 0.5 + SNAP), n)
    c = (lo + hi) * 0.5
    mid = F.floor(c).cast("bigint")
    on = (c >= 0) & (mid < n)
    first = F.when(start < end, start).when(on, mid).otherwise(F.lit(0))
    last = F.when(start < end, end).when(on, mid + 1).otherwise(F.lit(0))
    return F.struct(first.alias("first"), last.alias("last"))


def tile_row_span(lo: Column, hi: Column, n: Column) -> Column:
    """As grid_span, but an empty span is the row that holds the middle, clamped to the tile."""
    floor0 = lambda x: F.greatest(F.floor(x), F.lit(0)).cast("bigint")
    start, end = floor0(lo + 0.5 + SNAP), F.least(floor0(hi + 0.5 + SNAP), n)
    mid = F.least(floor0((lo + hi) * 0.5), F.greatest(n - 1, F.lit(0)))
    return F.struct(F.when(start < end, start).otherwise(mid).alias("first"), F.when(start < end, end).otherwise(mid + 1).alias("last"))


def geo_row_span(lat: Column, north: Column, south: Column, step: Column, height: Column, pixel: Column) -> Column:
    """Rows of a geographic source under an output row: half an output pixel to both sides of its latitude; null where the source has none."""
    row = (north - lat) / step
    half = pixel * 0.5 / step
    on = (lat <= north) & (lat >= south) & (row >= 0) & (F.floor(row) < height)
    return F.when(on, sample_span(row - half, row + half, height))


def quantised_degrees(v: Column) -> Column:
    """Degrees in whole millionths, halves away from zero."""
    return F.round(v * 1_000_000.0).cast("bigint")


def tile_rectangle(south: Column, north: Column, west: Column, east: Column, zoom: Column) -> Column:
    """(x0, x1, y0, y1), both ends included, of the tiles under a box."""
    return F.struct(lon_to_tile(west, zoom).alias("x0"), lon_to_tile(east, zoom).alias("x1"), lat_to_tile(north, zoom).alias("y0"), lat_to_tile(south, zoom).alias("y1"))


def common_rectangle(a: Column, b: Column) -> Column:
    """What two rectangles (x0, x1, y0, y1) share; null if they share no tile, the first one where the second is null."""
    top = {k: (F.greatest if k[1] == "0" else F.least)(a[k], b[k]) for k in ("x0", "x1", "y0", "y1")}
    both = F.when((top["x0"] <= top["x1"]) & (top["y0"] <= top["y1"]), F.struct(*(v.alias(k) for k, v in top.items())))
    return F.when(b.isNull(), a).otherwise(both)


def zigzag(n: Column) -> Column:
    """Signed value of a zig-zag coded integer."""
    return F.shiftright(n, 1).bitwiseXOR(-n.bitwiseAND(1))
