"""Text rules of jobs, tags, headers and fetch logs as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tag names in the order they are tried, metres of a storey, default height.
HEIGHT_KEYS = ("height", "render_height", "building:height")
LEVEL_KEYS = ("levels", "building:levels", "building_levels")
LEVEL_M = 3.0
DEFAULT_M = 6.0
# Fixed values of the TIFF format.
COMPRESSIONS = {1: "none", 5: "lzw", 8: "deflate", 32773: "packbits", 32946: "deflate", 7: "jpeg", 50000: "zstd", 50001: "webp"}
DECODABLE = (1, 5, 8, 32773, 32946)
SAMPLE_KINDS = {1: "uint", 2: "int", 3: "float"}
CRS_NAMES = {4326: "+proj=longlat +datum=WGS84", 2056: "+proj=somerc (LV95)", 3857: "+proj=webmerc", 21781: "+proj=somerc (LV03)"}


def leading_number(s: Column) -> Column:
    """The decimal number that a text starts with, without exponent; null if there is none."""
    return F.regexp_extract(F.trim(s), r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


def building_height(absolute: Column, tags: Column) -> Column:
    """(datum, metres, source) by the ladder: absolute, height tags, storeys, default."""
    use = lambda k: F.when(leading_number(F.try_element_at(tags, F.lit(k))) > 0, leading_number(F.try_element_at(tags, F.lit(k))))
    tagged, storeys = F.coalesce(*map(use, HEIGHT_KEYS)), F.coalesce(*map(use, LEVEL_KEYS))
    source = F.when(absolute.isNotNull(), "absolute").when(tagged.isNotNull(), "height").when(storeys.isNotNull(), "levels").otherwise("default")
    metres = F.coalesce(absolute, tagged, storeys * LEVEL_M, F.lit(DEFAULT_M))
    return F.struct(F.when(absolute.isNotNull(), 0).otherwise(1).alias("datum"), metres.alias("metres"), source.alias("source"))


def waypoint_id(path: Column) -> Column:
    """Number after the first wp_ in a path, else 0."""
    return F.coalesce(F.regexp_extract(path, r"wp_([^/\\]*)", 1).try_cast("bigint"), F.lit(0))


def epsg_code(crs: Column) -> Column:
    return F.regexp_extract(crs, "(?i)^EPSG:([0-9]+)$", 1).try_cast("int")


def crs_definition(crs: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in CRS_NAMES.items() for x in (k, v)])
    return F.try_element_at(names, epsg_code(crs))


def _short_key(keys: Column, wanted: int) -> Column:
    """Values of one short key (location 0) in a GeoKey directory, in order; incomplete entries are left out."""
    entries = F.sequence(F.lit(0), F.greatest(F.least(F.element_at(keys, 4), ((F.size(keys) - 4) / 4).cast("int")) - 1, F.lit(0)))
    at = lambda i, k: F.try_element_at(keys, 4 + i * 4 + k)
    hits = F.filter(entries, lambda i: (at(i, 1) == wanted) & (at(i, 2) == 0))
    return F.transform(hits, lambda i: at(i, 4))


def epsg_of_geokeys(keys: Column) -> Column:
    """EPSG of a GeoKey directory: the projected code rules; 0 and 32767 are unusable."""
    projected = F.try_element_at(_short_key(keys, 3072), F.lit(-1))
    geographic = F.try_element_at(_short_key(keys, 2048), F.lit(-1))
    usable = lambda v: F.when((v != 0) & (v != 32767), v)
    return F.when(F.size(keys) >= 4, F.when(projected.isNotNull(), usable(projected)).otherwise(usable(geographic)))


def metadata_item(xml: Column, name: str) -> Column:
    """A number in a metadata item of that name."""
    return F.regexp_extract(xml, f'name="{name}"[^>]*>([^<]*)<', 1).try_cast("double")


def scale_and_offset(xml: Column) -> Column:
    """struct(scale, offset) that the items of the first band say; null where that changes nothing.

    An item counts if its sample is 0 and its role, or without one its name, is scale or
    offset; the last one wins. A value that is no finite number is an error.
    """
    part = lambda i: F.regexp_extract_all(xml, F.lit(r"<Item([^>]*[^>/])>([^<]*)</Item>"), F.lit(i))
    said = lambda head, name: F.when(head.rlike(rf'\b{name}="'), F.regexp_extract(head, rf'\b{name}="([^"]*)"', 1))
    items = F.zip_with(part(1), part(2), lambda head, value: F.struct(said(head, "sample").alias("sample"), F.lower(F.coalesce(said(head, "role"), said(head, "name"))).alias("role"), F.trim(value).alias("value")))

    def value(role: str, default: float) -> Column:
        text = F.try_element_at(F.filter(items, lambda x: (x["sample"] == "0") & (x["role"] == role)), F.lit(-1))["value"]
        number = text.try_cast("double")
        bad = number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))
        return F.when(text.isNull(), F.lit(default)).when(bad, F.raise_error(F.concat(F.lit(f"{role} "), text, F.lit(" is not a finite number"))).cast("double")).otherwise(number)

    scale, offset = value("scale", 1.0), value("offset", 0.0)
    return F.when((scale != 1.0) | (offset != 0.0), F.struct(scale.alias("scale"), offset.alias("offset")))


def nodata_text(s: Column) -> Column:
    """A nodata text as number or special name; null if it is neither."""
    low = F.lower(F.trim(s))
    special = F.when(low.isin("nan", "-nan"), "nan").when(low.isin("inf", "+inf", "infinity"), "inf").when(low.isin("-inf", "-infinity"), "-inf")
    return F.coalesce(special, low.try_cast("double").cast("string"))


def dtype_name(kind: Column, bits: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in SAMPLE_KINDS.items() for x in (k, v)])
    return F.concat(F.try_element_at(names, kind), bits.cast("string"))


def compression_name(code: Column) -> Column:
    names = F.create_map(*[F.lit(x) for k, v in COMPRESSIONS.items() for x in (k, v)])
    return F.coalesce(F.try_element_at(names, code), F.concat(F.lit("unknown-"), code.cast("string")))


def service_key(template: Column, encoding: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the template without query, a line feed and the lower-cased encoding."""
    return F.left(F.sha2(F.concat(F.substring_index(template, "?", 1), F.lit("\n"), F.lower(encoding)), 256), F.lit(16))


def mirror_templates(template: Column) -> Column:
    """Templates of the mirrors of an object-store URL; other URLs have themselves only."""
    path_style = r"^https://s3\.amazonaws\.com/([^/]+)/(.*)$"
    host_style = r"^https://([^/]*)\.s3\.amazonaws\.com/(.*)$"
    hit = F.when(template.rlike(path_style), F.lit(path_style)).when(template.rlike(host_style), F.lit(host_style))
    bucket, path = (F.regexp_extract(template, path_style, i) for i in (1, 2)), None
    b1, p1 = bucket
    b2, p2 = (F.regexp_extract(template, host_style, i) for i in (1, 2))
    b, path = F.when(template.rlike(path_style), b1).otherwise(b2), F.when(template.rlike(path_style), p1).otherwise(p2)
    hosts = ("s3", "s3.us-east-1", "s3.dualstack.us-east-1")
    mirrors = [m for h in hosts for m in (F.concat(F.lit(f"https://{h}.amazonaws.com/"), b, F.lit("/"), path), F.concat(F.lit("https://"), b, F.lit(f".{h}.amazonaws.com/"), path))]
    return F.when(hit.isNotNull(), F.array(*mirrors)).otherwise(F.array(template))


def tile_url(template: Column, z: Column, x: Column, y: Column) -> Column:
    """URL of a tile, mirrors taking turns by x + y."""
    all_ = mirror_templates(template)
    one = F.element_at(all_, ((x + y) % F.size(all_) + 1).cast("int"))
    for name, v in (("{z}", z), ("{x}", x), ("{y}", y)):
        one = F.replace(one, F.lit(name), v.cast("string"))
    return one


def rectangle_urls(template: Column, z: Column, rectangle: Column) -> Column:
    """(x, y, url) of every tile of a rectangle (x0, x1, y0, y1), row by row."""
    xs, ys = F.sequence(rectangle["x0"], rectangle["x1"]), F.sequence(rectangle["y0"], rectangle["y1"])
    one = lambda x, y: F.struct(x.alias("x"), y.alias("y"), tile_url(template, z, x, y).alias("url"))
    return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: one(x, y))))


def degraded_line(z: Column, x: Column, y: Column, reason: Column, filled_zoom: Column) -> Column:
    return F.format_string("[Degraded] z=%d x=%d y=%d reason=%s filled_from=z%d", z, x, y, reason, filled_zoom)


def stall_line(z: Column, x: Column, y: Column, first_byte_s: Column, gap_s: Column) -> Column:
    tenths = lambda v: F.bround(v, 1)  # noqa: E731  halves go to the even tenth
    return F.format_string("[Download] STALL tile z=%d/x=%d/y=%d: first byte after %.1fs, longest body gap %.1fs", z, x, y, tenths(first_byte_s), tenths(gap_s))


def backfill_line(z: Column, x: Column, y: Column, void: Column, seam: Column, left: Column, filled: Column) -> Column:
    """The line of a tile with void samples; filled: array of (zoom, n), what each coarser zoom filled."""
    each = F.array_join(F.transform(filled, lambda f: F.format_string("z%d %d", f["zoom"], f["n"])), ", ")
    came = F.when(F.size(filled) > 0, F.concat(F.lit(" ("), each, F.lit(")"))).otherwise("")
    return F.format_string("[Backfill] z=%d x=%d y=%d: %d void px (%d seam), %d filled%s, %d left void", z, x, y, void, seam, void - left, came, left)


def failure_class(message: Column) -> Column:
    """Class of a fetch failure by its message."""
    code = F.regexp_extract(message, r"HTTP ([0-9]+)(?:\s|$)", 1).try_cast("int")
    has = lambda *words: F.greatest(*[F.contains(message, F.lit(w)).cast("int") for w in words], F.lit(0)) == 1
    http = F.when(F.coalesce(code, F.lit(0)) > 0, F.concat(F.lit("http_"), code.cast("string"))).otherwise("other")
    return (
        F.when(has("HTTP "), http)
        .when(has("timed out"), "timeout")
        .when(has("onnect", "dns", "resolve"), "connect")
        .when(has("decode", "png", "PNG", "nvalid", "XYZ tile geometry"), "decode")
        .otherwise("other")
    )


def retryable(kind: Column) -> Column:
    code = F.regexp_extract(kind, "^http_([0-9]+)$", 1).try_cast("int")
    return F.coalesce((code == 429) | code.between(500, 599), kind.isin("timeout", "connect"))


def retry_after(value: Column) -> Column:
    """Seconds of a Retry-After header, at most 120."""
    seconds = F.when(F.trim(value).rlike("^[0-9]+$"), F.trim(value).try_cast("bigint"))
    return F.when(seconds.isNotNull(), F.least(seconds, F.lit(120)))


def tile_key_of_name(name: Column) -> Column:
    """(z, x, y) of {z}_{x}_{y}.pbf or .mvt."""
    part = lambda i: F.regexp_extract(name, r"^([0-9]+)_([0-9]+)_([0-9]+)\.(?:pbf|mvt)$", i).try_cast("int")
    return F.struct(part(1).alias("z"), part(2).alias("x"), part(3).alias("y"))
