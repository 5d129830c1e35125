"""WGS 84 to projected coordinates, in numpy: UTM, Swiss LV95 (by its published approximation) and web mercator."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The WGS 84 ellipsoid, the UTM grid, the LV95 origin.
AXIS, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EAST, UTM_NORTH = 0.9996, 500000.0, 10000000.0
LV95_LAT_S, LV95_LON_S = 169028.66, 26782.5


def utm(lon: np.ndarray, lat: np.ndarray, zone: int, south: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Transverse Mercator by the sixth-order series in the third flattening."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
        13 * n**2 / 48 - 3 * n**3 / 5,
        61 * n**3 / 240,
    )
    e = np.sqrt(FLATTENING * (2 - FLATTENING))
    phi, dl = np.radians(lat), np.radians(lon - (zone * 6 - 183))
    t = np.sinh(np.arctanh(np.sin(phi)) - e * np.arctanh(e * np.sin(phi)))
    xi, eta = np.arctan2(t, np.cos(dl)), np.arcsinh(np.sin(dl) / np.hypot(t, np.cos(dl)))
    east = eta + sum(a * np.cos(2 * k * xi) * np.sinh(2 * k * eta) for k, a in enumerate(series, 1))
    north = xi + sum(a * np.sin(2 * k * xi) * np.cosh(2 * k * eta) for k, a in enumerate(series, 1))
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north + (UTM_NORTH if south else 0.0)


def lv95(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Swiss coordinates by the survey office's published polynomial, good to about a metre."""
    p, q = (lat * 3600 - LV95_LAT_S) / 10000, (lon * 3600 - LV95_LON_S) / 10000
    east = 2600072.37 + 211455.93 * q - 10938.51 * q * p - 0.36 * q * p**2 - 44.54 * q**3
    north = 1200147.07 + 308807.95 * p + 3745.25 * q**2 + 76.63 * p**2 - 194.56 * q**2 * p + 119.79 * p**3
    return east, north


def web_mercator(lon: np.ndarray, lat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return AXIS * np.radians(lon), AXIS * np.log(np.tan(np.pi / 4 + np.radians(lat) / 2))


def forward(epsg: int):
    """The projection of an EPSG code as a function of lon and lat; an error names codes that are not supported."""
    if epsg == 4326:
        return lambda lon, lat: (lon, lat)
    if epsg == 2056:
        return lv95
    if epsg == 3857:
        return web_mercator
    if 32601 <= epsg <= 32660 or 32701 <= epsg <= 32760:
        return lambda lon, lat: utm(lon, lat, epsg % 100, epsg >= 32700)
    raise ValueError(f"EPSG:{epsg} is not supported")


def projected(lon: Column, lat: Column, epsg: int) -> Column:
    """struct(east, north) of a coordinate pair."""
    fn = forward(epsg)

    @F.pandas_udf("east double, north double")
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        east, north = fn(a.to_numpy(float), b.to_numpy(float))
        return pd.DataFrame({"east": east, "north": north})

    return run(lon, lat)
