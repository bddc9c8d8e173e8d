"""Grids, points, polygons and road networks. Distances are metres in a plane; a grid is a table of cells ``row, col, z`` from north to south."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators import polygons as poly
from orewright.plans.shared import materialize

EARTH_A, EARTH_F = 6378137.0, 1 / 298.257223563


def _line(along: str, across: str):
    return Window.partitionBy(across).orderBy(along)


def _steps(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Adds ``_x`` and ``_y``: the rise for each metre along columns and rows, by central differences, one-sided at the borders; null where a cell it needs is null."""
    def step(along: str, across: str, size: float) -> Column:
        w = _line(along, across)
        before, after = F.lag(F.struct("z")).over(w), F.lead(F.struct("z")).over(w)
        both = (after["z"] - before["z"]) / (2 * size)
        return F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after["z"] - F.col("z")) / size).when(after.isNull(), (F.col("z") - before["z"]) / size).otherwise(both)

    return cells.withColumn("_x", step("col", "row", dx)).withColumn("_y", step("row", "col", dy))


def slope_pct(cells: DataFrame, dx: float, dy: float) -> DataFrame:
    """Adds ``slope``: the gradient in per cent; null where a cell it needs is null."""
    return _steps(cells, dx, dy).withColumn("slope", 100 * F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))).drop("_x", "_y")


def focal(cells: DataFrame, stat: str, radius: int, out: str = "focal") -> DataFrame:
    """Adds the ``min``, ``max`` or ``mean`` of the square window around each cell, nulls left out: first along rows, then along columns."""
    def along(a: str, b: str):
        return Window.partitionBy(b).orderBy(a).rangeBetween(-radius, radius)

    if stat in ("min", "max"):
        f = F.min if stat == "min" else F.max
        return cells.withColumn("_h", f("z").over(along("col", "row"))).withColumn(out, f("_h").over(along("row", "col"))).drop("_h")
    rows = cells.withColumn("_s", F.sum("z").over(along("col", "row"))).withColumn("_n", F.count("z").over(along("col", "row")))
    return rows.withColumn(out, F.sum("_s").over(along("row", "col")) / F.nullif(F.sum("_n").over(along("row", "col")), F.lit(0))).drop("_s", "_n")


def height_above_ground(cells: DataFrame, radius: int) -> DataFrame:
    """Adds ``ground`` (the mean of the window's minima) and ``height``."""
    low = focal(cells, "min", radius, "_low")
    ground = focal(low.select("row", "col", F.col("_low").alias("z")), "mean", radius, "ground").select("row", "col", "ground")
    return cells.join(ground, ["row", "col"]).withColumn("height", F.col("z") - F.col("ground"))


def local_peaks(cells: DataFrame, radius: int, least: float) -> DataFrame:
    """Cells that are their window's maximum and at least ``least`` high."""
    return focal(cells, "max", radius, "_top").where((F.col("z") == F.col("_top")) & (F.col("z") >= least)).select("row", "col", "z")


def suppress_peaks(peaks: DataFrame, radius: int, most_rounds: int = 1000) -> DataFrame:
    """Highest first (ties by row, column), a peak within the box radius of a kept one goes. Each round keeps those with no higher neighbour left and drops their neighbours; rounds are written to the shared folder."""
    size = radius + 1
    cell = lambda c: F.floor(F.col(c) / size)
    ranked = peaks.select("row", "col", "z", cell("row").alias("i"), cell("col").alias("j"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    left, kept = materialize(ranked, "peaks"), None
    for _ in range(most_rounds):
        other = left.select(F.col("row").alias("r2"), F.col("col").alias("c2"), F.col("z").alias("z2"), "i", "j", around.alias("d")).select("r2", "c2", "z2", (F.col("i") + F.col("d.a")).alias("i"), (F.col("j") + F.col("d.b")).alias("j")).hint("merge")  # nine rows a peak
        near = (F.abs(F.col("row") - F.col("r2")) <= radius) & (F.abs(F.col("col") - F.col("c2")) <= radius)
        higher = F.struct(-F.col("z2"), F.col("r2"), F.col("c2")) < F.struct(-F.col("z"), F.col("row"), F.col("col"))
        tops = materialize(left.join(other.withColumnRenamed("i", "i2").withColumnRenamed("j", "j2"), (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & near & higher, "left_anti"), "tops")
        kept = tops if kept is None else kept.unionAll(tops)
        gone = tops.select(F.col("row").alias("r2"), F.col("col").alias("c2"), "i", "j", around.alias("d")).select("r2", "c2", (F.col("i") + F.col("d.a")).alias("i2"), (F.col("j") + F.col("d.b")).alias("j2")).hint("merge")
        left = materialize(left.join(gone, (F.col("i") == F.col("i2")) & (F.col("j") == F.col("j2")) & near, "left_anti"), "peaks")
        if left.limit(1).count() == 0:
            return kept.select("row", "col", "z")
    raise RuntimeError("peaks are still left")


def terrain_mask(cells: DataFrame, dx: float, dy: float, line: float, steep: float = 60.0) -> DataFrame:
    """Adds ``band``: ``rock`` where steep, ``snow`` above the line, ``mixed`` up to a tenth below it, else ``low``; null without a slope."""
    rows = slope_pct(cells, dx, dy)
    return rows.withColumn("band", F.when(F.col("slope").isNull() | F.col("z").isNull(), None).when(F.col("slope") > steep, "rock").when(F.col("z") >= line, "snow").when(F.col("z") >= 0.9 * line, "mixed").otherwise("low"))


def snow_mask(cells: DataFrame, size: float, lat: float, line: float | None = None, steep_deg: float = 40.0) -> DataFrame:
    """Adds ``snow``: above the snow line where the slope holds it, and in a band below it on the shaded side, which falls towards the pole, where it's less steep; null without a slope.

    Without a ``line`` it's the top fifth of the relief, not under 1800 m, of grids that reach 2000 m. A grid that doesn't reach its line has no snow.
    """
    rows = _steps(cells, size, size)
    ends = cells.agg(F.max("z").alias("hi"), F.min("z").alias("lo"))  # one row
    auto = F.when(F.col("hi") >= 2000, F.greatest(F.lit(1800.0), F.col("hi") - 0.2 * (F.col("hi") - F.col("lo"))))
    ends = ends.withColumn("line", auto if line is None else F.when(F.col("hi") > line, F.lit(float(line)))).withColumn("wide", F.greatest(F.lit(60.0), 0.35 * (F.col("hi") - F.col("line"))))
    rows = rows.join(F.broadcast(ends))
    fall = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    slope, to_pole = F.degrees(F.atan(fall)), F.col("_y") * (1 if lat >= 0 else -1)  # rows run from north to south, so what rises to the south falls to the north
    above = (F.col("z") >= F.col("line")) & (slope < steep_deg)
    below = (F.col("z") >= F.col("line") - F.col("wide")) & (F.col("z") < F.col("line")) & (to_pole > 0.15 * fall + 0.02) & (slope < steep_deg - 5)
    return rows.withColumn("snow", F.when(fall.isNull() | F.col("z").isNull(), None).otherwise(F.coalesce(above | below, F.lit(False)))).drop("_x", "_y", "hi", "lo", "line", "wide")


def class_area(cells: DataFrame, step_deg: float, north: float) -> DataFrame:
    """Square metres of each class of cells of ``step_deg`` degrees, whose first row's centre lies at ``north``: a cell narrows with its latitude."""
    lat = F.radians(F.lit(north) - F.col("row") * step_deg)
    side = step_deg * 111320.0
    return cells.groupBy("class").agg(F.count("*").alias("cells"), F.sum(F.lit(side * side) * F.cos(lat)).alias("m2"))


def mosaic(cells: DataFrame, mode: str = "max") -> DataFrame:
    """One value for each cell of overlapping grids (``priority``): the highest, or with ``priority`` the last good one."""
    value = F.max("z") if mode == "max" else F.max_by("z", F.when(F.col("z").isNotNull(), F.col("priority")))
    return cells.groupBy("row", "col").agg(value.alias("z"))


def sample_grid(points: DataFrame, cells: DataFrame, size: float, fallback: float | DataFrame = 0.0) -> DataFrame:
    """Adds ``z`` by the four cells around each point (``x`` by column, ``y`` by row, cell centres at multiples of ``size``); where one is missing, by the fallback, another grid of the same cells or a number (0 where the other grid has none either)."""
    if isinstance(fallback, DataFrame):
        own, other = (sample_grid(points, c, size, float("nan")).select("id", "z") for c in (cells, fallback))
        z = F.when(~F.isnan("z"), F.col("z")).when(~F.isnan("z2"), F.col("z2")).otherwise(0.0)
        return points.join(own.join(other.withColumnRenamed("z", "z2"), "id").select("id", z.alias("z")), "id")
    i, j = F.floor(F.col("y") / size), F.floor(F.col("x") / size)
    fy, fx = F.col("y") / size - i, F.col("x") / size - j
    four = F.explode(F.array(*[F.struct((i + a).alias("row"), (j + b).alias("col"), ((fy if a else 1 - fy) * (fx if b else 1 - fx)).alias("w")) for a in (0, 1) for b in (0, 1)]))
    near = points.select("id", four.alias("c")).select("id", "c.*").where("w > 0")
    found = near.join(cells.select("row", "col", "z"), ["row", "col"], "left").groupBy("id").agg(F.sum(F.col("w") * F.col("z")).alias("z"), F.count_if(F.col("z").isNull()).alias("missing"))
    return points.join(found, "id").withColumn("z", F.when(F.col("missing") > 0, F.lit(fallback)).otherwise(F.col("z"))).drop("missing")


def zonal_stats(areas: DataFrame, cells: DataFrame, size: float) -> DataFrame:
    """``id, n, high, mean, p90`` of the cells whose centre lies in each area: a rectangle (``x0, y0, x1, y1``, its border too) or a polygon (``ring``); without one, of the cell nearest a point in it; ``reason`` where that has no data.

    Areas are dealt to the cells that their bounds cover, so the join is an equality.
    """
    shaped = "ring" in areas.columns
    areas = poly.with_rings(areas)
    lo, hi = lambda c: F.ceil(F.col(c) / size), lambda c: F.floor(F.col(c) / size)
    good = cells.where("z is not null")
    grid = good.agg(*[f(c).cast("long").alias(f"_{c}{e}") for c in ("row", "col") for e, f in ((0, F.min), (1, F.max))])  # one row: beyond it there's nothing to meet
    spans = areas.crossJoin(F.broadcast(grid)).select("id", "ring", F.greatest(lo("y0"), "_row0").alias("r0"), F.least(hi("y1"), "_row1").alias("r1"), F.greatest(lo("x0"), "_col0").alias("c0"), F.least(hi("x1"), "_col1").alias("c1"))
    covers = spans.where("r0 <= r1 AND c0 <= c1").select("id", "ring", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row")).select("id", "ring", "row", F.explode(F.sequence("c0", "c1")).alias("col"))
    covers = covers.where(poly.inside(F.col("ring"), F.col("col") * size, F.col("row") * size)) if shaped else covers
    # Spark takes rows that are dealt to cells for as few as there were areas, and would send them all to the driver
    inside = covers.drop("ring").hint("merge").join(good, ["row", "col"]).groupBy("id").agg(F.count("*").alias("n"), F.max("z").alias("high"), F.avg("z").alias("mean"), F.percentile("z", F.lit(0.9)).alias("p90"))
    point = poly.middle_point(F.col("ring")) if shaped else F.struct(((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"))
    middle = areas.select("id", point.alias("m")).select("id", F.round(F.col("m.y") / size).cast("long").alias("row"), F.round(F.col("m.x") / size).cast("long").alias("col"))
    near = middle.join(good, ["row", "col"]).select("id", F.col("z").alias("own"))
    out = areas.select("id").join(inside, "id", "left").join(near, "id", "left")
    one = lambda c: F.coalesce(c, "own").alias(c)
    return out.select("id", F.coalesce("n", F.when(F.col("own").isNotNull(), 1).otherwise(0)).cast("long").alias("n"), one("high"), one("mean"), one("p90"), F.when(F.col("n").isNull() & F.col("own").isNull(), "no data").alias("reason"))


def _cells_near(x: str, y: str, size: float) -> Column:
    return F.explode(F.array(*[F.struct((F.floor(F.col(x) / size) + a).alias("i"), (F.floor(F.col(y) / size) + b).alias("j")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))


def within_distance(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """``a, b, distance`` of points (``id, x, y``) at most ``radius`` apart: a bucket as wide as the radius joins its eight neighbours."""
    left = a.select(F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), _cells_near("x", "y", radius).alias("k"))
    right = b.select(F.col("id").alias("b"), F.col("x").alias("xb"), F.col("y").alias("yb"), F.struct(F.floor(F.col("x") / radius).alias("i"), F.floor(F.col("y") / radius).alias("j")).alias("k"))
    d = F.sqrt((F.col("xa") - F.col("xb")) ** 2 + (F.col("ya") - F.col("yb")) ** 2)
    return left.join(right, "k").withColumn("distance", d).where(F.col("distance") <= radius).select("a", "b", "distance")


def snap_points(points: DataFrame, nodes: DataFrame, most: float) -> DataFrame:
    """Each point's nearest node within ``most`` metres (ties to the lower node) and the distance; null beyond."""
    near = within_distance(points, nodes.select(F.col("node").alias("id"), "x", "y"), most).groupBy("a").agg(F.min(F.struct(F.round("distance", 9).alias("distance"), F.col("b").alias("node"))).alias("m"))
    return points.join(near.select(F.col("a").alias("id"), "m.node", F.col("m.distance").alias("access")), "id", "left")


def nearest_segment(things: DataFrame, segments: DataFrame, most: float) -> DataFrame:
    """Each thing's nearest segment (``id, x0, y0, x1, y1``) within ``most`` metres, ties to the lower id. Things are points (``id, x, y``) or polygons (``id, ring``), which are 0 from what meets them.

    A segment is dealt to the buckets that its box touches, and a polygon to those of its own.
    """
    bucket = lambda c: F.floor(F.col(c) / most)
    spread = segments.select("*", F.explode(F.sequence(F.least(bucket("x0"), bucket("x1")) - 1, F.greatest(bucket("x0"), bucket("x1")) + 1)).alias("i"))
    spread = spread.select("*", F.explode(F.sequence(F.least(bucket("y0"), bucket("y1")) - 1, F.greatest(bucket("y0"), bucket("y1")) + 1)).alias("j")).withColumnRenamed("id", "segment")
    if "ring" in things.columns:
        own = poly.with_rings(things).select("id", "ring", F.explode(F.sequence(bucket("x0"), bucket("x1"))).alias("i"), "y0", "y1").select("id", "ring", "i", F.explode(F.sequence(bucket("y0"), bucket("y1"))).alias("j"))
        near = own.join(spread, ["i", "j"]).dropDuplicates(["id", "segment"])
        d = poly.segment_distance(F.col("ring"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")])
    else:
        near = things.select(F.col("id"), "x", "y", bucket("x").alias("i"), bucket("y").alias("j")).join(spread, ["i", "j"])
        d = poly.side_distance(*[F.col(c) for c in ("x", "y", "x0", "y0", "x1", "y1")])
    best = near.withColumn("distance", F.round(d, 6)).where(F.col("distance") <= most).groupBy("id").agg(F.min(F.struct("distance", "segment")).alias("m"))
    return things.select("id").join(best.select("id", "m.segment", "m.distance"), "id", "left")


def points_in_polygons(points: DataFrame, rings: DataFrame) -> DataFrame:
    """``point, polygon`` pairs by the crossing number. ``rings`` has ``id`` and ``ring``, an array of points ``x, y`` whose last joins the first; a point is only tested in the polygons whose box holds it."""
    polygons = poly.with_rings(rings.select("id", "ring")).withColumnRenamed("id", "polygon")
    size = 500.0
    bucket = lambda c: F.floor(F.col(c) / size)
    spread = polygons.select("*", F.explode(F.sequence(bucket("x0"), bucket("x1"))).alias("i")).select("*", F.explode(F.sequence(bucket("y0"), bucket("y1"))).alias("j"))
    near = points.select(F.col("id").alias("point"), "x", "y", bucket("x").alias("i"), bucket("y").alias("j")).join(spread, ["i", "j"]).where("x between x0 and x1 and y between y0 and y1")
    return near.where(poly.inside(F.col("ring"), F.col("x"), F.col("y"))).select("point", "polygon")


def overlap_pairs(a: DataFrame, b: DataFrame, size: float = 500.0) -> DataFrame:
    """``a, b, area`` of areas that overlap, rectangles (``id, x0, y0, x1, y1``) or polygons (``id, ring``); each pair is found in one bucket only, that of the lower left corner of the bounds that both share."""
    bucket = lambda c: F.floor(F.col(c) / size)
    shaped = "ring" in a.columns or "ring" in b.columns

    def spread(df: DataFrame, name: str) -> DataFrame:
        df = poly.with_rings(df)
        df = df.select(F.col("id").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in ("x0", "y0", "x1", "y1", *["ring"] * shaped)], F.explode(F.sequence(bucket("x0"), bucket("x1"))).alias("i"), "y0", "y1")
        return df.select("*", F.explode(F.sequence(bucket("y0"), bucket("y1"))).alias("j")).drop("y0", "y1")

    both = spread(a, "a").join(spread(b, "b"), ["i", "j"])
    x0, y0 = F.greatest("a_x0", "b_x0"), F.greatest("a_y0", "b_y0")
    w, h = F.least("a_x1", "b_x1") - x0, F.least("a_y1", "b_y1") - y0
    met = both.where((w > 0) & (h > 0) & (F.floor(x0 / size) == F.col("i")) & (F.floor(y0 / size) == F.col("j")))
    if not shaped:
        return met.select("a", "b", (w * h).alias("area"))
    return met.select("a", "b", poly.shared_area(F.col("a_ring"), F.col("b_ring")).alias("area")).where("area > 1e-9")


def overlap_share(areas: DataFrame, restricted: DataFrame, size: float = 500.0) -> DataFrame:
    """Share of each area (rectangle or polygon) under the union of the restricted ones, each spot once. ``names`` are those that overlap.

    The union is found in squares of ``size``, each for itself: a square holds the restricted rings that reach into it, equal ones once, so an area with very many of them is many small tasks.
    """
    pairs = overlap_pairs(areas, restricted, size)
    names = pairs.groupBy(F.col("a").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("b")), ",").alias("names"))
    areas, restricted = poly.with_rings(areas), poly.with_rings(restricted)
    bucket = lambda c: F.floor(F.col(c) / size)

    def spread(df: DataFrame, name: str) -> DataFrame:
        df = df.select(*[F.col(c).alias(f"{name}_{c}") for c in (["id"] if name == "a" else []) + ["x0", "y0", "x1", "y1", "ring"]], F.explode(F.sequence(bucket("x0"), bucket("x1"))).alias("i"), "y0", "y1")
        return df.select("*", F.explode(F.sequence(bucket("y0"), bucket("y1"))).alias("j")).drop("y0", "y1")

    met = spread(areas, "a").join(spread(restricted, "b"), ["i", "j"])
    apart = (F.col("a_x1") <= F.col("b_x0")) | (F.col("b_x1") <= F.col("a_x0")) | (F.col("a_y1") <= F.col("b_y0")) | (F.col("b_y1") <= F.col("a_y0"))
    squares = met.where(~apart).groupBy("a_id", "i", "j").agg(F.first("a_ring").alias("ring"), F.collect_set("b_ring").alias("rings"))
    box = [(F.col(c) + k) * F.lit(float(size)) for k in (0, 1) for c in "ij"]
    covered = squares.select(F.col("a_id").alias("id"), poly.area_under(F.col("ring"), F.col("rings"), box).alias("part")).groupBy("id").agg(F.sum("part").alias("covered"))
    out = areas.join(covered, "id", "left").join(names, "id", "left")
    return out.select("id", F.round(F.coalesce("covered", F.lit(0.0)) / poly.ring_area(F.col("ring")), 6).alias("share"), F.coalesce("names", F.lit("")).alias("names"))


def overlay_stat(areas: DataFrame, valued: DataFrame) -> DataFrame:
    """Area-weighted mean and maximum of the ``value`` of the areas that overlap each one (rectangles or polygons), and the share of it that they cover (parts that overlap count each)."""
    pairs = overlap_pairs(areas, valued).join(valued.select(F.col("id").alias("b"), "value"), "b")
    stats = pairs.groupBy(F.col("a").alias("id")).agg((F.sum(F.col("area") * F.col("value")) / F.sum("area")).alias("mean"), F.max("value").alias("high"), F.sum("area").alias("area"))
    whole = poly.with_rings(areas).select("id", poly.ring_area(F.col("ring")).alias("whole"))
    out = whole.join(stats, "id", "left").withColumn("cover", F.coalesce(F.col("area"), F.lit(0.0)) / F.col("whole"))
    return out.select("id", F.round("mean", 6).alias("mean"), "high", F.round("cover", 6).alias("cover"), F.when(F.col("cover") < 0.99, "partly covered").alias("note"))


def conflate_fill(base: DataFrame, extra: DataFrame, most: float = 1 / 3) -> DataFrame:
    """Base footprints (rectangles or polygons) and those extra ones of which less than a third lies under the base; base heights that are estimates take the height of the extra one that overlaps most."""
    pairs = overlap_pairs(extra, base)
    size = poly.with_rings(extra).select(F.col("id").alias("a"), poly.ring_area(F.col("ring")).alias("whole"), F.col("height").alias("h"))
    under = pairs.groupBy("a").agg(F.sum("area").alias("area")).join(size, "a").where(F.col("area") >= most * F.col("whole")).select(F.col("a").alias("id"))
    better = pairs.join(size, "a").where("h is not null").groupBy("b").agg(F.max(F.struct("area", (-F.col("a")).alias("i"), "h")).alias("m")).select(F.col("b").alias("id"), F.col("m.h").alias("h"))
    kept = base.join(better, "id", "left")
    taken = F.col("estimated") & F.col("h").isNotNull()
    kept = kept.select("id", F.when(taken, F.col("h")).otherwise(F.col("height")).alias("height"), (F.col("estimated") & ~taken).alias("estimated"), F.lit("base").alias("origin"))
    return kept.unionByName(extra.join(under, "id", "left_anti").select("id", "height", "estimated", F.lit("extra").alias("origin")))


def project_local(points: DataFrame, lon0: float, lat0: float) -> DataFrame:
    """Adds ``x, y``: metres east and north of a point, by the ellipsoid's radii there."""
    import math

    e2 = EARTH_F * (2 - EARTH_F)
    s = math.sin(math.radians(lat0))
    prime = EARTH_A / math.sqrt(1 - e2 * s * s)
    meridian = EARTH_A * (1 - e2) / (1 - e2 * s * s) ** 1.5
    return points.withColumn("x", F.radians(F.col("lon") - lon0) * prime * math.cos(math.radians(lat0))).withColumn("y", F.radians(F.col("lat") - lat0) * meridian)


def to_mercator(points: DataFrame) -> DataFrame:
    """Adds ``mx, my``: Web Mercator metres; latitudes beyond its square are drawn to its edge."""
    lat = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), F.col("lat"))))
    return points.withColumn("mx", F.radians("lon") * EARTH_A).withColumn("my", EARTH_A * F.log(F.tan(F.pi() / 4 + lat / 2)))


def from_mercator(points: DataFrame) -> DataFrame:
    """Adds ``lon, lat`` of Web Mercator metres ``mx, my``."""
    return points.withColumn("lon", F.degrees(F.col("mx") / EARTH_A)).withColumn("lat", F.degrees(2 * F.atan(F.exp(F.col("my") / EARTH_A)) - F.pi() / 2))


def utm_code(lon: Column, lat: Column) -> Column:
    """The EPSG code of the UTM zone of a point, north or south."""
    zone = F.greatest(F.lit(1), F.least(F.lit(60), F.floor((lon + 180) / 6) + 1))
    return F.concat(F.lit("EPSG:"), (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("string"))


def frame_tracks(points: DataFrame, margin: float = 0.15, least_m: float = 500.0) -> DataFrame:
    """``path, lon, lat, width_m, height_m``: the centre of each track's points (``path, lon, lat``) and the ground size that frames it with a margin on each side, ``least_m`` at least."""
    box = points.groupBy("path").agg(F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    degree = EARTH_A * 3.141592653589793 / 180
    size = lambda m: F.greatest(F.lit(float(least_m)), m * (1 + 2 * margin))
    lat = (F.col("y0") + F.col("y1")) / 2
    return box.select("path", ((F.col("x0") + F.col("x1")) / 2).alias("lon"), lat.alias("lat"), size((F.col("x1") - F.col("x0")) * degree * F.cos(F.radians(lat))).alias("width_m"), size((F.col("y1") - F.col("y0")) * degree).alias("height_m"))


def tile_keys(points: DataFrame, zoom: int) -> DataFrame:
    """Adds the map tile ``tx, ty`` of a zoom level and its ``quadkey``."""
    n = 2**zoom
    lat = F.radians(F.greatest(F.lit(-85.05112878), F.least(F.lit(85.05112878), F.col("lat"))))
    tx = F.floor((F.col("lon") + 180) / 360 * n)
    ty = F.floor((1 - F.log(F.tan(lat) + 1 / F.cos(lat)) / F.pi()) / 2 * n)
    rows = points.withColumn("tx", F.greatest(F.lit(0), F.least(F.lit(n - 1), tx))).withColumn("ty", F.greatest(F.lit(0), F.least(F.lit(n - 1), ty)))
    digits = [(F.shiftright("tx", i).bitwiseAND(F.lit(1).cast("long")) + 2 * F.shiftright("ty", i).bitwiseAND(F.lit(1).cast("long"))).cast("string") for i in reversed(range(zoom))]
    return rows.withColumn("quadkey", F.concat(*digits))


def within_area(points: DataFrame, lon0: float, lat0: float, lon1: float, lat1: float, pad: float = 0.0) -> DataFrame:
    """Points in a box padded by a share of its sides; literals, so that they reach the scan."""
    px, py = (lon1 - lon0) * pad, (lat1 - lat0) * pad
    return points.where(F.col("lon").between(lon0 - px, lon1 + px) & F.col("lat").between(lat0 - py, lat1 + py))


def conflate_prefer(base: DataFrame, other: DataFrame) -> DataFrame:
    """Base features with ``special`` and those of the other source of which a point inside doesn't lie in one of them; rectangles or polygons."""
    special = poly.with_rings(base.where("special")).select("id", "x0", "y0", "x1", "y1", "ring", F.lit("base").alias("origin"))
    other = poly.with_rings(other)
    middle = other.select("id", poly.middle_point(F.col("ring")).alias("m")).select("id", "m.x", "m.y")
    inside = points_in_polygons(middle, special.select("id", "ring")).select(F.col("point").alias("id"))
    return special.unionByName(other.join(inside, "id", "left_anti").select("id", "x0", "y0", "x1", "y1", "ring", F.lit("other").alias("origin")))


def drop_covered_outlines(buildings: DataFrame, share: float = 0.6) -> DataFrame:
    """Buildings (rectangles or polygons) without the outlines (not ``part``) of which their parts cover ``share`` or more."""
    parts, outlines = buildings.where("part"), buildings.where("not part")
    whole = poly.with_rings(outlines).select("id", poly.ring_area(F.col("ring")).alias("whole"))
    covered = overlap_pairs(outlines, parts).groupBy(F.col("a").alias("id")).agg(F.sum("area").alias("area")).join(whole, "id")
    return buildings.join(covered.where(F.col("area") >= share * F.col("whole")).select("id"), "id", "left_anti")


def layer_summary(features: DataFrame) -> DataFrame:
    """Counts of features (``height, estimated, bridge, tunnel, area``) and their area by ``kind``."""
    return features.groupBy("kind").agg(F.count("*").alias("n"), F.count("height").alias("with_height"), F.count_if(F.col("estimated")).alias("estimated"), F.count_if(F.col("bridge")).alias("bridges"), F.count_if(F.col("tunnel")).alias("tunnels"), F.round(F.sum("area"), 3).alias("area"))


#: Rules of a screening: name, measure, side of the limit and unit.
RULES = (("min_area_m2", "area", "least", "m²"), ("max_area_m2", "area", "most", "m²"), ("max_slope_pct", "slope", "most", "%"), ("max_access_distance_m", "access", "most", "m"), ("exclusion_max_overlap_pct", "share", "most", "%"))
REASON = "array<struct<rule: string, measured: string, threshold: string, unit: string, detail: string>>"


def screen_parcels(parcels: DataFrame, limits: dict[str, float], attributes: tuple[tuple[str, str, list], ...] = (), unknown: str = "reject") -> DataFrame:
    """``id, accepted, reasons, flags`` of parcels with their measures ``area, slope, access, share`` (per cent) and attributes.

    ``limits`` names :data:`RULES`; ``attributes`` are ``(column, "in" or "not in", values)``. Each rule that isn't met is a reason with rule, measured value, threshold, unit and
    detail. What is missing is a flag, and under ``reject`` also a reason without a measured value.
    """
    text = lambda v: F.lit(None).cast("string") if v is None else F.lit(f"{v:g}" if isinstance(v, int | float) else str(v))
    reason = lambda rule, measured, threshold, unit, detail: F.struct(F.lit(rule).alias("rule"), measured.cast("string").alias("measured"), text(threshold).alias("threshold"), F.lit(unit).alias("unit"), detail.cast("string").alias("detail"))
    reasons, flags = [], []

    def rule(name: str, value: Column, ok: Column, threshold, unit: str, detail: Column) -> None:
        flags.append(F.when(value.isNull(), F.lit(f"{name} is unknown")))
        missing = F.when(F.lit(unknown == "reject") & value.isNull(), reason(name, F.lit(None), threshold, unit, F.lit("can't be checked")))
        reasons.append(F.when(~ok, reason(name, value, threshold, unit, detail)).otherwise(missing))

    for name, measure, side, unit in RULES:
        if name in limits:
            ok = F.col(measure) >= limits[name] if side == "least" else F.col(measure) <= limits[name] + 1e-9
            detail = F.concat(F.lit("overlaps: "), F.col("names")) if measure == "share" and "names" in parcels.columns else F.lit(None)
            rule(name, F.round(F.col(measure), 2), ok, limits[name], unit, detail)
    for column, op, values in attributes:
        hit = F.col(column).isin(values)
        rule(f"attribute:{column} {op}", F.col(column), hit if op == "in" else ~hit, ", ".join(map(str, values)), "", F.lit(None))
    out = parcels.select("id", F.array_compact(F.array(*reasons)).cast(REASON).alias("reasons"), F.array_compact(F.array(*flags)).alias("flags"))
    return out.withColumn("accepted", F.size("reasons") == 0)


def screening_summary(screened: DataFrame) -> DataFrame:
    """``rule, n``: rejections by rule."""
    return screened.select(F.explode("reasons").alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(F.count("*").alias("n"))


def cluster_mesh(faces: DataFrame, cell: float, lock: bool = False) -> DataFrame:
    """Faces (``model_id, ax .. cz``) after the vertices of each cell of a grid, laid from the model's least corner, become their mean: those with two equal corners go, and of equal ones one stays.

    With ``lock``, vertices at the border, those of a side that one face alone has, stay where they are.
    """
    corner = lambda p: F.struct(*[F.col(f"{p}{c}").alias(c) for c in "xyz"])
    vertices = faces.select("model_id", F.explode(F.array(*[corner(p) for p in "abc"])).alias("v")).distinct()
    low = vertices.groupBy("model_id").agg(F.struct(*[F.min(F.col(f"v.{c}")).alias(c) for c in "xyz"]).alias("low"))
    key = F.concat_ws(",", *[F.floor((F.col(f"v.{c}") - F.col(f"low.{c}")) / cell).cast("string") for c in "xyz"])
    named = vertices.join(low, "model_id").withColumn("k", key).drop("low")
    if lock:
        side = lambda p, q: F.array_sort(F.array(corner(p), corner(q)))
        sides = faces.select("model_id", F.explode(F.array(side("a", "b"), side("b", "c"), side("c", "a"))).alias("s")).groupBy("model_id", "s").count().where("count = 1")
        border = sides.select("model_id", F.explode("s").alias("v")).distinct().withColumn("own", F.lit(True))
        named = named.join(border, ["model_id", "v"], "left").withColumn("k", F.when(F.col("own"), F.concat(F.lit("at "), F.to_json("v"))).otherwise(F.col("k"))).drop("own")
    means = named.groupBy("model_id", "k").agg(F.struct(*[F.round(F.avg(F.col(f"v.{c}")), 6).alias(c) for c in "xyz"]).alias("m"))
    rows = faces.select("model_id", *[corner(p).alias(f"v{p}") for p in "abc"])
    for p in "abc":
        rows = rows.join(named.select("model_id", F.col("v").alias(f"v{p}"), F.col("k").alias(p)), ["model_id", f"v{p}"])
    rows = rows.where("a <> b AND b <> c AND a <> c").withColumn("_s", F.array_sort(F.array("a", "b", "c"))).groupBy("model_id", "_s").agg(F.min(F.struct("a", "b", "c")).alias("f")).select("model_id", "f.*")
    for p in "abc":
        rows = rows.join(means.select("model_id", F.col("k").alias(p), F.col("m").alias(f"m{p}")), ["model_id", p])
    return rows.select("model_id", *[F.col(f"m{p}.{c}").alias(f"{p}{c}") for p in "abc" for c in "xyz"])


def footprint_heights(boxes: DataFrame, cells: DataFrame, size: float, inner: float, outer: float, least: int = 8) -> DataFrame:
    """``id, ground, eaves, roof, top`` of footprints, rectangles or polygons (``ring``): the 20th percentile of the ring of cells from ``inner`` to ``outer`` metres outside a footprint that lie in no footprint, and above it the
    25th, 90th and 99.5th of the cells inside, 0 at least. A ring of under ``least`` cells is drawn again two and a half times as wide; a footprint whose ring is
    too small then too has no row."""
    good = cells.where("z is not null").select("row", "col", "z", (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y"))
    shaped = "ring" in boxes.columns
    boxes = poly.with_rings(boxes)
    to_box = F.sqrt(F.greatest(F.col("x0") - F.col("x"), F.lit(0.0), F.col("x") - F.col("x1")) ** 2 + F.greatest(F.col("y0") - F.col("y"), F.lit(0.0), F.col("y") - F.col("y1")) ** 2)
    away = poly.ring_distance(F.col("ring"), F.col("x"), F.col("y")) if shaped else to_box
    grow = 2.5 * outer
    lo, hi = lambda c: F.ceil((F.col(c) - grow) / size), lambda c: F.floor((F.col(c) + grow) / size)
    own = ["id", "x0", "y0", "x1", "y1", "ring"]
    wide = boxes.where((lo("y0") <= hi("y1")) & (lo("x0") <= hi("x1"))).select(*own, F.explode(F.sequence(lo("y0"), hi("y1"))).alias("row"), lo("x0").alias("p"), hi("x1").alias("q"))
    # rows that are dealt to cells are many more than Spark takes them for, so none of the sides goes through the driver
    around = wide.select(*own, "row", F.explode(F.sequence("p", "q")).alias("col")).hint("merge").join(good, ["row", "col"]).withColumn("away", away).where(F.col("away") <= grow).select("id", "row", "col", "z", "away")
    inside = around.where("away = 0")
    used = inside.select("row", "col").distinct().hint("merge")
    ring = around.where(F.col("away") > inner).join(used, ["row", "col"], "left_anti")
    near = F.when(F.col("away") <= outer, F.col("z"))
    ground = ring.groupBy("id").agg(F.percentile(near, F.lit(0.2)).alias("first"), F.count(near).alias("m"), F.percentile("z", F.lit(0.2)).alias("second"), F.count("*").alias("n"))
    ground = ground.where(F.col("n") >= least).select("id", F.when(F.col("m") >= least, F.col("first")).otherwise(F.col("second")).alias("ground"))
    roof = inside.groupBy("id").agg(*[F.percentile("z", F.lit(p)).alias(n) for p, n in ((0.25, "eaves"), (0.9, "roof"), (0.995, "top"))])
    return ground.hint("merge").join(roof, "id").select("id", F.round("ground", 6).alias("ground"), *[F.round(F.greatest(F.col(c) - F.col("ground"), F.lit(0.0)), 6).alias(c) for c in ("eaves", "roof", "top")])
