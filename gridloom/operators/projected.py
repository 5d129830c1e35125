"""Area means of projected sources on a degree grid, in numpy, one output tile at a time.

Edges of output rows are projected exactly at the ends of each piece and straight between: one piece if its middle
strays less than a quarter of a source pixel, else pieces of 64 pixels.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from gridloom.functions.elevation import FLOOR, VOID
from gridloom.functions.projections import forward
from gridloom.runtime import ship_package

TOLERANCE_PX = 0.25
PIECE = 64
NUDGE = 1e-9


def row_edges(fn, lat: float, ul_lon: float, pixel_deg: float, size: int, source_px: float) -> tuple[np.ndarray, np.ndarray]:
    """East and north of the size + 1 pixel edges along a parallel."""
    at = lambda x: fn(ul_lon + np.asarray(x, float) * pixel_deg, np.full(np.shape(x), lat, float))
    ends = np.array([0, size])
    e, n = at(ends)
    em, nm = at(np.array([size / 2]))
    if np.hypot(em[0] - e.mean(), nm[0] - n.mean()) >= TOLERANCE_PX * source_px:
        ends = np.unique(np.append(np.arange(0, size, PIECE), size))
        e, n = at(ends)
    x = np.arange(size + 1)
    return np.interp(x, ends, e), np.interp(x, ends, n)


def _span(lo: np.ndarray, hi: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    cut = lambda v: np.maximum(np.floor(v), 0).astype(np.int64)
    start, end = cut(lo + 0.5 + NUDGE), np.minimum(cut(hi + 0.5 + NUDGE), dim)
    mid = np.minimum(cut((lo + hi) / 2), dim - 1)
    return np.where(start < end, start, mid), np.where(start < end, end, mid + 1)


def sample_tile(source: np.ndarray, east: float, north: float, step: float, epsg: int, ul_lat: float, ul_lon: float, pixel_deg: float, size: int) -> np.ndarray:
    """A size x size tile of half metres: exact means of the valid source samples under each pixel, void outside and without any.

    source: rows from the north; (east, north) is its upper left corner and step its pixel.
    """
    fn, (h, w) = forward(epsg), source.shape
    ok = source > FLOOR
    sums = np.pad(np.where(ok, source, 0).astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    counts = np.pad(ok.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    out = np.full((size, size), VOID, np.int32)
    for y in range(size):
        e, n0 = row_edges(fn, ul_lat - y * pixel_deg, ul_lon, pixel_deg, size, step)
        _, n1 = row_edges(fn, ul_lat - (y + 1) * pixel_deg, ul_lon, pixel_deg, size, step)
        x_lo, x_hi, y_lo, y_hi = (e[:-1] - east) / step, (e[1:] - east) / step, (north - n0[:-1]) / step, (north - n1[:-1]) / step
        on = (x_hi > 0) & (x_lo < w) & (y_hi > 0) & (y_lo < h)
        (a, b), (c, d) = _span(x_lo, x_hi, w), _span(y_lo, y_hi, h)
        area = lambda t: t[d, b] - t[c, b] - t[d, a] + t[c, a]  # noqa: B023, E731
        s, k = area(sums), area(counts)
        sign = np.where(s >= 0, 1, -1)
        mean = sign * ((2 * np.abs(s) + k) // np.maximum(2 * k, 1))
        out[y] = np.where(on & (k > 0), mean, VOID)
    return out


def bounds_in_degrees(east: float, north: float, step: float, width: int, height: int, epsg: int) -> tuple[float, float, float, float]:
    """(west, south, east, north) of a projected source, from nine of its points, each found by Newton steps on the projection."""
    fn = forward(epsg)
    e = np.repeat(east + step * width * np.array([0, 0.5, 1]), 3)
    n = np.tile(north - step * height * np.array([0, 0.5, 1]), 3)
    middle = {2056: (8.0, 47.0), 3857: (0.0, 0.0), 4326: (0.0, 0.0)}.get(epsg, ((epsg % 100) * 6 - 183, -45.0 if epsg >= 32700 else 45.0))
    lon, lat = np.full(9, middle[0], float), np.full(9, middle[1], float)
    for _ in range(50):
        x, y = fn(lon, lat)
        d = 1e-6
        (xl, yl), (xp, yp) = fn(lon + d, lat), fn(lon, lat + d)
        a, b, c, f = (xl - x) / d, (xp - x) / d, (yl - y) / d, (yp - y) / d
        det = a * f - b * c
        dx, dy = e - x, n - y
        lon, lat = lon + (f * dx - b * dy) / det, np.clip(lat + (a * dy - c * dx) / det, -89.0, 89.0)
        if max(np.abs(dx).max(), np.abs(dy).max()) < 1e-6 * step:
            break
    return float(lon.min()), float(lat.min()), float(lon.max()), float(lat.max())


def sampled_tiles(pairs: DataFrame) -> DataFrame:
    """(tile, priority, x, y, v): half metres of output tiles sampled from projected sources; voids have no row.

    pairs: tile, priority, ul_lat, ul_lon, pixel_deg, size, and of the source that may
    show there east, north, step, epsg, width, height and samples (16-bit half metres, row
    by row, little-endian). Each pair is worked on by itself, so tiles spread over all
    tasks; terrain.overlay() puts the sources over one another.
    """

    def run(batches):
        for pdf in batches:
            for p in pdf.itertuples(index=False):
                source = np.frombuffer(p.samples, "<i2").reshape(p.height, p.width)
                got = sample_tile(source, p.east, p.north, p.step, int(p.epsg), p.ul_lat, p.ul_lon, p.pixel_deg, int(p.size))
                y, x = np.nonzero(got > FLOOR)
                yield pd.DataFrame({"tile": p.tile, "priority": p.priority, "x": x, "y": y, "v": got[y, x]})

    ship_package(pairs.sparkSession)
    kinds = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"tile {kinds['tile']}, priority {kinds['priority']}, x bigint, y bigint, v int")
