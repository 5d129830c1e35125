"""Vector data on rasters: rings, point in polygon, duplicates, burning heights into cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.elevation import FLOOR

from . import terrain

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)  #: types that a hash aggregate's buffer can hold


def ring_area2(edges: DataFrame, *ring: str) -> DataFrame:
    """(ring..., area2): twice the signed area. edges: ring columns, i and the vertex (px, py); the last joins the first."""
    w = W.partitionBy(*ring).orderBy("i")
    first = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(first)) for c in ("px", "py"))
    return edges.withColumns({"nx": nx, "ny": ny}).groupBy(*ring).agg(F.sum(F.col("px") * F.col("ny") - F.col("nx") * F.col("py")).alias("area2"))


def ring_owner(rings: DataFrame, feature: str) -> DataFrame:
    """rings with `owner`: the exterior ring that a ring belongs to, the last one at or before it in its feature.

    rings: feature, i, area2. The first ring's winding is the exterior one; rings before any exterior have none.
    """
    w = W.partitionBy(feature).orderBy("i")
    r = rings.withColumn("sign", F.first(F.signum("area2")).over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    outer = F.when((F.signum("area2") == F.col("sign")) & (F.col("area2") != 0), F.col("i"))
    return r.withColumn("owner", F.last(outer, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, W.currentRow))).drop("sign")


def point_in_polygon(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd ray cast of a point against an array of (px, py) vertices; the last joins the first."""
    n = F.size(ring)

    def crosses(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        straddles = (a["py"] > y) != (b["py"] > y)
        at = (b["px"] - a["px"]) * (y - a["py"]) / F.when(b["py"] != a["py"], b["py"] - a["py"]) + a["px"]
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + crosses(i)) % 2 == 1


def crossings(ring: Column, y: Column) -> Column:
    """Where a horizontal line meets the edges of an array of (px, py) vertices, from the left; the last vertex joins the first."""
    n = F.size(ring)

    def at(i):
        a, b = F.element_at(ring, i), F.element_at(ring, F.when(i == 1, n).otherwise(i - 1))
        x = (b["px"] - a["px"]) * (y - a["py"]) / F.when(b["py"] != a["py"], b["py"] - a["py"]) + a["px"]
        return F.when((a["py"] > y) != (b["py"] > y), x)

    found = F.transform(F.sequence(F.lit(1), n), at)
    return F.when(n >= 3, F.array_sort(F.array_compact(found))).otherwise(F.array().cast("array<double>"))


def paired(xs: Column, size: int) -> Column:
    """Ranges (x0, x1) of the cells, of `size` in a row, whose centres lie between crossings taken in pairs from the left."""
    k = F.when(F.size(xs) >= 2, F.sequence(F.lit(1), F.floor(F.size(xs) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    edge = lambda i: F.ceil(F.element_at(xs, i) - 0.5)
    each = F.transform(k, lambda i: F.struct(F.greatest(edge(2 * i - 1), F.lit(0)).alias("x0"), F.least(edge(2 * i) - 1, F.lit(size - 1)).alias("x1")))
    return F.filter(each, lambda r: r["x0"] <= r["x1"])


def footprint_cells(shapes: DataFrame, size: int) -> DataFrame:
    """(shape columns, x, y): cells of a size x size grid whose centre a ring holds and no hole does.

    shapes: ring and, where they have some, holes (an array of rings; fewer than three
    vertices hold nothing). Each shape lists its own rows, clipped to the grid; a row's
    crossings give ranges of cells, so a shape costs its edges times its rows and nothing
    for cells outside it.
    """
    lo = F.greatest(F.floor(F.array_min(F.transform("ring", lambda p: p["py"]))), F.lit(0))
    hi = F.least(F.ceil(F.array_max(F.transform("ring", lambda p: p["py"]))), F.lit(size)) - 1
    s = shapes.where("size(ring) >= 3").withColumns({"_y0": lo, "_y1": hi}).where("_y0 <= _y1")
    s = s.withColumn("y", F.explode(F.sequence("_y0", "_y1")))
    centre = F.col("y") + 0.5
    s = s.withColumn("_r", paired(crossings(F.col("ring"), centre), size)).where("size(_r) > 0")
    x = F.flatten(F.transform("_r", lambda r: F.sequence(r["x0"], r["x1"])))
    if "holes" in shapes.columns:
        none = F.array().cast("array<struct<x0:bigint,x1:bigint>>")
        s = s.withColumn("_h", F.coalesce(F.flatten(F.transform("holes", lambda h: paired(crossings(h, centre), size))), none))
        x = F.filter(x, lambda c: ~F.exists("_h", lambda r: c.between(r["x0"], r["x1"])))
    return s.withColumn("x", F.explode(x)).select(*shapes.columns, "x", "y")


def roofs(cells: DataFrame, shapes: DataFrame, size: int, ground: str = "p10") -> DataFrame:
    """(id, ground, roof) in half metres of the shapes that stand on the grid.

    shapes: id, ring, rise and, where they have them, holes and `absolute`. An absolute
    roof is the rise itself; any other stands on the chosen ground statistic of the
    untouched samples under the footprint and is left out where it rises by nothing or
    no sample is there. Roofs stay within 16 bits. Joins of shapes and footprints are
    merges: estimates do not see the cells that a shape lists, and would broadcast them.
    """
    absolute = F.coalesce(F.col("absolute"), F.lit(False)) if "absolute" in shapes.columns else F.lit(False)
    seen = shapes.withColumn("absolute", absolute).where("absolute or rise > 0")
    feet = footprint_cells(seen.drop("rise", "absolute"), size).select("id", "x", "y")
    level = terrain.ground_level(feet.hint("merge").join(cells.select("x", "y", "v"), ["x", "y"]), "id", ground)
    on = seen.select("id", "rise", "absolute").hint("merge").join(level, "id", "left").where("absolute or ground is not null")
    roof = F.when(F.col("absolute"), F.col("rise")).otherwise(F.greatest(F.least(F.col("ground") + F.col("rise"), F.lit(32767)), F.lit(-32768)))
    return on.select("id", "ground", roof.alias("roof"))


def burn(cells: DataFrame, shapes: DataFrame, size: int, ground: str = "p10") -> DataFrame:
    """cells (x, y, v) with `burned`: the roofs of all shapes on frozen ground, the highest of each cell; see roofs()."""
    feet = footprint_cells(shapes, size).select("id", "x", "y").hint("merge")
    top = feet.join(roofs(cells, shapes, size, ground), "id").groupBy("x", "y").agg(F.max("roof").alias("roof"))
    return cells.join(top, ["x", "y"], "left").withColumn("burned", F.greatest("v", "roof")).drop("roof")


def first_of_duplicates(rows: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """The first row, by position, of each key. Positions of one key are all different.

    A hash aggregate with partial sums on the map side, so a hot key costs no window and
    nothing is sorted: of columns of fixed width it holds the values of the first row so
    far. Where others are wider, only positions are aggregated, and the winners' rows
    come by a join on (keys, position).
    """
    rest = [f for f in rows.schema if f.name not in (*keys, pos)]
    if all(isinstance(f.dataType, FIXED) for f in rest):
        return rows.groupBy(*keys).agg(F.min(pos).alias(pos), *(F.min_by(f.name, pos).alias(f.name) for f in rest)).select(*rows.columns)
    first = rows.groupBy(*keys).agg(F.min(pos).alias(pos))
    same = F.lit(True)
    for c in (*keys, pos):
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"f.{c}"))
    return rows.alias("r").join(first.alias("f"), same, "left_semi")


def scanline_cells(crossings: DataFrame) -> DataFrame:
    """(poly, y, x): cells between the crossings of each scanline, taken in pairs from the left.

    crossings: poly, y and cx. A cell counts if its centre lies in a pair's half-open range.
    """
    w = W.partitionBy("poly", "y").orderBy("cx")
    c = crossings.withColumns({"k": F.row_number().over(w), "to": F.lead("cx").over(w)}).where("k % 2 = 1 and to is not null")
    x0, x1 = F.ceil(F.col("cx") - 0.5), F.ceil(F.col("to") - 0.5) - 1
    c = c.withColumns({"x0": x0, "x1": x1}).where("x0 <= x1")
    return c.select("poly", "y", F.explode(F.sequence("x0", "x1")).alias("x"))


def forest_cover(features: DataFrame, size: int, parts: int = 4) -> DataFrame:
    """(x, y, alpha): the share of each cell that the fullest feature covers, even-odd over all rings of a feature together.

    features: id and rings (arrays of px, py; those of fewer than three vertices hold
    nothing). A cell's rows are sampled by `parts` scanlines whose spans count with their
    exact overlap; with one part a cell counts whole if its centre is inside.
    """
    ys = F.transform(F.flatten("rings"), lambda p: p["py"])
    lo, hi = F.greatest(F.floor(F.array_min(ys)), F.lit(0)), F.least(F.ceil(F.array_max(ys)), F.lit(size)) - 1
    f = features.withColumn("rings", F.filter("rings", lambda r: F.size(r) >= 3)).withColumns({"_y0": lo, "_y1": hi}).where("_y0 <= _y1")
    f = f.withColumn("y", F.explode(F.sequence("_y0", "_y1"))).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    line = F.col("y") + (F.col("_k") + 0.5) / parts
    f = f.select("id", "y", "_k", F.array_sort(F.flatten(F.transform("rings", lambda r: crossings(r, line)))).alias("xs")).where("size(xs) >= 2")
    if parts == 1:
        x = F.flatten(F.transform(paired(F.col("xs"), size), lambda r: F.sequence(r["x0"], r["x1"])))
        return f.select(F.explode(x).alias("x"), "y").distinct().withColumn("alpha", F.lit(1.0))
    pairs = F.transform(F.sequence(F.lit(1), F.floor(F.size("xs") / 2).cast("int")), lambda i: F.struct(F.greatest(F.element_at("xs", 2 * i - 1), F.lit(0.0)).alias("a"), F.least(F.element_at("xs", 2 * i), F.lit(float(size))).alias("b")))
    s = f.withColumn("_p", F.explode(F.filter(pairs, lambda p: p["a"] < p["b"])))
    s = s.withColumn("x", F.explode(F.sequence(F.floor("_p.a"), F.ceil("_p.b") - 1)))
    part = (F.least(F.col("x") + 1.0, F.col("_p.b")) - F.greatest(F.col("x").cast("double"), F.col("_p.a"))).cast("float") / parts
    share = s.groupBy("id", "x", "y").agg(F.least(F.sum(part), F.lit(1.0)).alias("alpha"))
    return share.groupBy("x", "y").agg(F.max("alpha").alias("alpha"))


def surface(cells: DataFrame, shapes: DataFrame, features: DataFrame, size: int, height: int, observers: DataFrame, radius: int, parts: int = 4) -> DataFrame:
    """cells (x, y, v) with `burned`: buildings and forest on one snapshot of the ground.

    Both read the untouched v, so neither stands on the other; the higher one shows.
    """
    built = burn(cells, shapes, size).withColumnRenamed("burned", "_built")
    wooded = burn_forest(cells, forest_cover(features, size, parts), height, observers, radius).select("x", "y", F.col("burned").alias("_wooded"))
    return built.join(wooded, ["x", "y"]).withColumn("burned", F.greatest("_built", "_wooded")).drop("_built", "_wooded")


def burn_forest(cells: DataFrame, cover: DataFrame, height: int, observers: DataFrame, radius: int) -> DataFrame:
    """cells with `burned`: tree tops on covered, valid ground away from observers.

    cover: x, y and alpha (0..1). Cells within `radius` (larger of dx, dy) of an observer
    stay free; observers list their neighbourhoods, so this is an anti-join. Covered cells
    meet the ground in a merge: estimates see the features only, and would broadcast them.
    """
    around = F.sequence(F.lit(-radius), F.lit(radius))
    near = observers.select(F.explode(F.transform(around, lambda d: F.col("ox") + d)).alias("x"), "oy").select("x", F.explode(F.transform(around, lambda d: F.col("oy") + d)).alias("y")).distinct()
    best = cover.groupBy("x", "y").agg(F.max("alpha").alias("alpha")).join(near, ["x", "y"], "left_anti")
    top = F.col("v") + F.round(F.lit(height) * F.col("alpha")).cast("int")
    lifted = F.when((F.col("v") > FLOOR) & F.col("alpha").isNotNull(), F.greatest(F.col("v"), top)).otherwise(F.col("v"))
    return cells.join(best.hint("merge"), ["x", "y"], "left").withColumn("burned", lifted).drop("alpha")


def height_statistics(buildings: DataFrame, *group: str) -> DataFrame:
    """(group..., n, explicit, low, high, total): buildings, those whose height is said and not assumed, and their metres.

    buildings: group columns, metres and source ('default' where it is assumed).
    """
    return buildings.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("source") != "default").alias("explicit"), F.min("metres").alias("low"), F.max("metres").alias("high"), F.sum("metres").alias("total")
    )
