"""Elevation samples: half-metre codes, RGB codes and nodata handling as Column expressions.

Heights are stored as 16-bit half metres. VOID marks missing ground; anything at or
below FLOOR is invalid on read. Each function names its rounding.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the formats.
VOID = -9999
FLOOR = -5000
SHORT_MIN, SHORT_MAX = -32768, 32767
XYZ_VOID_M = -11000.0
ALTITUDE_VOID = 65535


def _saturated(x: Column) -> Column:
    """A double as a short: clamped first, so that the cast cannot overflow; the cast truncates."""
    return F.greatest(F.least(x, F.lit(float(SHORT_MAX))), F.lit(float(SHORT_MIN))).cast("smallint")


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def half_metres_truncated(x: Column) -> Column:
    """Metres to half metres, towards zero; NaN, infinities and nulls are void."""
    return F.when(_finite(x), _saturated(x * 2)).otherwise(F.lit(VOID).cast("smallint"))


def half_metres_of_int(x: Column) -> Column:
    """Whole metres to half metres: below the void code is void, above the range is its end."""
    wide = x.cast("decimal(38,0)") * 2
    return F.when(wide < VOID, F.lit(VOID)).when(wide > SHORT_MAX, F.lit(SHORT_MAX)).otherwise(wide.cast("int")).cast("smallint")


def half_metres_half_away(x: Column) -> Column:
    """Float metres to half metres in single precision, halves away from zero."""
    t = x.cast("float") * F.lit(2).cast("float")
    half = F.when(t >= 0, F.lit(0.5)).otherwise(F.lit(-0.5)).cast("float")
    return _saturated((t + half).cast("double"))


def half_metres_nearest(x: Column) -> Column:
    """Double metres to the nearest half metre, halves away from zero, clamped."""
    return _saturated(F.round(x * 2))


def half_metres_cut(x: Column) -> Column:
    """Double metres to half metres, towards zero, clamped."""
    return _saturated(x * 2)


def nodata_to_null(x: Column, nodata: float) -> Column:
    """The raw sample, null where it equals the file's nodata value."""
    return F.nullif(x, F.lit(nodata))


def scaled(x: Column, nodata: float, scale: float, offset: float) -> Column:
    """value * scale + offset, after the nodata test on the raw value."""
    return F.when(x != F.lit(nodata), x * F.lit(scale) + F.lit(offset))


def half_metres_of_sample(x: Column, kind: str, nodata: float | None = None, scale: tuple[float, float] | None = None) -> Column:
    """Half metres of a raw sample of a raster whose sample type is `kind` (int8 .. uint64, float16 .. float64).

    nodata is compared with the raw sample in its own type: a single-precision sample with
    the value rounded to single precision. A scale (factor, offset) makes metres in double
    precision first. Without one, 16-bit integers double and saturate, other integers
    become void below the void code, and floats are cut.
    """
    single = kind in ("float16", "float32")
    raw = x.cast("float") if single else x
    gap = F.lit(False) if nodata is None else raw == (F.lit(nodata).cast("float") if single else F.lit(nodata))
    if scale is not None:
        half = half_metres_truncated(raw.cast("double") * F.lit(scale[0]) + F.lit(scale[1]))
    elif kind == "int16":
        half = F.greatest(F.least(x.cast("int") * 2, F.lit(SHORT_MAX)), F.lit(SHORT_MIN)).cast("smallint")
    elif kind.startswith("float"):
        half = half_metres_truncated(raw)
    else:
        half = half_metres_of_int(x)
    return F.when(F.coalesce(gap, F.lit(False)), F.lit(VOID).cast("smallint")).otherwise(half)


def coverage_byte(v: Column, scale: float, offset: float) -> Column:
    """A float sample as a coverage byte: invalid heights are 0, others unscaled and clamped to 0..255."""
    code = (v - F.lit(offset)) / F.lit(scale)
    return F.when(v <= FLOOR, 0).otherwise(F.greatest(F.least(code, F.lit(255.0)), F.lit(0.0)).cast("int"))


def coverage_byte_of(x: Column, bits: int, scale: float = 1.0, offset: float = 0.0) -> Column:
    """A raw sample of 1, 8, 16 (signed) or 32 (float) bits as a coverage byte; see coverage_byte for the last."""
    if bits == 32:
        f = x.cast("float")
        code = ((f - F.lit(offset).cast("float")) / F.lit(scale).cast("float")).cast("float")
        return F.when((f <= FLOOR) | F.isnan(f), 0).otherwise(F.greatest(F.least(code, F.lit(255.0).cast("float")), F.lit(0.0).cast("float")).cast("int"))
    if bits == 16:
        return F.greatest(F.least(x.cast("int"), F.lit(255)), F.lit(0))
    return F.when(x == 0, 0).otherwise(1) if bits == 1 else x.cast("int")


def metres_of_rgb(r: Column, g: Column, b: Column) -> Column:
    """First RGB code: r * 256 + g + b / 256 - 32768."""
    return (r * 256.0 + g + b / 256.0) - 32768.0


def rgb_of_metres(v: Column) -> Column:
    """24-bit number of the first RGB code; NaN is 0."""
    k = F.greatest(F.least(F.round((v + 32768.0) * 256.0), F.lit(16777215.0)), F.lit(0.0))
    return F.when(F.isnan(v), F.lit(0)).otherwise(k.cast("int"))


def channels(n: Column) -> list[Column]:
    """Red, green and blue of a 24-bit number."""
    return [F.shiftright(n, 16), F.shiftright(n, 8).bitwiseAND(255), n.bitwiseAND(255)]


def metres_of_rgb_tenths(n: Column) -> Column:
    """Second RGB code, in single precision and in this order: -10000 + (r * 6553.6 + g * 25.6 + b * 0.1)."""
    f = lambda x: F.lit(x).cast("float")
    r, g, b = (c.cast("float") for c in channels(n))
    return f(-10000.0) + (r * f(6553.6) + g * f(25.6) + b * f(0.1))


def rgb_tenths_of_metres(v: Column) -> Column:
    """24-bit number of the second RGB code: of the nine around the rounded one, the one that decodes nearest; the lowest of equals."""
    top = F.lit(16777215)
    near = F.greatest(F.least(F.round((v + 10000.0) * 10.0), top.cast("double")), F.lit(0.0)).cast("int")
    tries = F.sequence(F.greatest(near - 4, F.lit(0)), F.least(near + 4, top))
    errors = F.transform(tries, lambda n: F.struct(F.abs(metres_of_rgb_tenths(n).cast("double") - v).alias("e"), n.alias("n")))
    return F.when(F.isnan(v), F.lit(0)).otherwise(F.array_min(errors)["n"])


def exact_mean(total: Column, count: Column) -> Column:
    """Integer mean of `count` samples adding up to `total`, halves away from zero; null without samples."""
    sign = F.when(total >= 0, F.lit(1)).otherwise(F.lit(-1))
    return F.when(count > 0, F.call_function("div", 2 * total + sign * count, 2 * count))
