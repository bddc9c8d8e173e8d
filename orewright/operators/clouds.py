"""Nearest points between clouds of any shape and distance, exactly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.plans.ranks import percentile
from orewright.plans.shared import Scratch, materialize, scratch

#: Points in a cell that isn't split further, and how often a cell may be split.
FEW, LEVELS = 64, 16
#: Levels that are counted at once, and parts of a cell at the last level.
STEP, PARTS = 5, 1024
_BOX = [f"{c}{e}" for c in "xyz" for e in (0, 1)]


def _points(cloud: DataFrame) -> DataFrame:
    """Distinct places with the least id there; points without three finite coordinates are left out."""
    whole = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in "xyz"]
    plain = cloud.select("id", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(whole[0] & whole[1] & whole[2])
    return plain.groupBy("x", "y", "z").agg(F.min("id").alias("id"))


def _cells(level: int, low: list[float], side: float) -> Column:
    """The number of a point's cell at a level."""
    at = [F.least(F.floor((F.col(c) - low[k]) / side * (1 << level)), F.lit((1 << level) - 1)).cast("long") for k, c in enumerate("xyz")]
    return F.lit(level << 54).bitwiseOR(F.shiftleft(at[0], 36)).bitwiseOR(F.shiftleft(at[1], 18)).bitwiseOR(at[2])


def _tree(points: DataFrame, low: list[float], side: float, own: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """``kids`` (``parent, cell, leaf`` and the box of its points; a leaf is its own child) and the points with their leaf.

    Cells halve as long as they hold more than :data:`FEW` points, so dense regions have small cells. A round counts the cells of :data:`STEP` levels and
    places the points whose cell is small enough; the others go on.
    """
    left, kids, placed = points, [], []
    boxes = [f(c).alias(f"{c}{e}") for c in "xyz" for e, f in ((0, F.min), (1, F.max))]
    for base in range(0, LEVELS + 1, STEP):
        levels = range(base, min(base + STEP, LEVELS + 1))
        struct = [F.struct(_cells(k, low, side).alias("cell"), (_cells(k - 1, low, side) if k else F.lit(-1).cast("long")).alias("parent")) for k in levels]
        rows = left.select("id", "x", "y", "z", F.explode(F.array(*struct)).alias("c")).select("id", "x", "y", "z", "c.*")
        counted = own.keep(rows.groupBy("cell", "parent").agg(F.count("*").alias("n"), *boxes), f"{name}-counted-{base}")
        top = F.shiftright("cell", 54)
        split = counted.where((F.col("n") > FEW) & (top < LEVELS)).select(F.col("cell").alias("parent"))
        real = counted.where(top > base).join(split, "parent", "left_semi").unionByName(counted.where(top == base))  # parts of cells that are small enough aren't cells
        cells = own.keep(real.withColumn("leaf", (F.col("n") <= FEW) | (top == LEVELS)), f"{name}-cells-{base}")
        kids += [cells.select("parent", "cell", "leaf", *_BOX), cells.where("leaf").select(F.col("cell").alias("parent"), "cell", "leaf", *_BOX)]
        placed.append(rows.join(cells.where("leaf").select("cell"), "cell").select("id", "x", "y", "z", "cell"))
        last = cells.where((top == levels[-1]) & ~F.col("leaf")).select("cell")
        if levels[-1] == LEVELS or not last.head():
            break
        left = own.keep(left.withColumn("cell", _cells(levels[-1], low, side)).join(last, "cell", "left_semi").drop("cell"), f"{name}-left-{base}")
    union = lambda parts: parts[0] if len(parts) == 1 else parts[0].unionByName(union(parts[1:]))
    return own.keep(union(kids), f"{name}-kids"), own.keep(union(placed), f"{name}-placed")


def _both_trees(a: DataFrame, b: DataFrame, own: Scratch) -> tuple | None:
    """The trees of both clouds over one cube; None where one has no point."""
    p, q = own.keep(_points(a), "a"), own.keep(_points(b), "b")
    if not p.head() or not q.head():
        return None
    ends = p.select("x", "y", "z").unionAll(q.select("x", "y", "z")).agg(*[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    low, side = [ends[0], ends[2], ends[4]], max(ends[1] - ends[0], ends[3] - ends[2], ends[5] - ends[4]) or 1.0
    return _tree(p, low, side, own, "a"), _tree(q, low, side, own, "b")


def _descend(a: tuple, b: tuple, own: Scratch) -> DataFrame:
    """The nearest point of tree ``b`` for each of tree ``a``."""
    (kids_a, points_a), (kids_b, points_b) = a, b
    named = lambda kids, s: kids.select(*[F.col(c).alias(f"{s}_{c}") for c in ("parent", "cell", "leaf", *_BOX)])
    left, right = named(kids_a, "a"), named(kids_b, "b")
    square = lambda part: sum((part(c) * part(c) for c in "yz"), part("x") * part("x"))
    gap = square(lambda c: F.greatest(F.col(f"a_{c}0") - F.col(f"b_{c}1"), F.col(f"b_{c}0") - F.col(f"a_{c}1"), F.lit(0.0)))
    most = square(lambda c: F.greatest(F.col(f"a_{c}1") - F.col(f"b_{c}0"), F.col(f"b_{c}1") - F.col(f"a_{c}0")))
    pairs = own.spark.createDataFrame([(-1, -1)], "a long, b long")
    for _ in range(LEVELS + 2):
        met = pairs.join(left, F.col("a") == F.col("a_parent")).join(right, F.col("b") == F.col("b_parent"))
        bounds = met.select(F.col("a_cell").alias("a"), F.col("b_cell").alias("b"), (F.col("a_leaf") & F.col("b_leaf")).alias("done"), gap.alias("gap"), most.alias("most"))
        # the boxes that a cell may still need are around it, so they are few; squares are rounded, so what is equal but for that stays
        near = F.col("gap") <= F.min("most").over(Window.partitionBy("a")) * (1 + 1e-12)
        pairs = own.keep(bounds.withColumn("near", near).where("near").select("a", "b", "done", "gap", "most"), "pairs")
        if not pairs.where("not done").head():
            break
    # points of a cell first meet those of its best cell, then only cells that are no farther than what they found there; a last cell is a row of its points,
    # and one at the deepest level, which may have any number, is dealt to parts
    slack, point = 1 + 1e-12, ["id", "x", "y", "z"]
    part = F.when(F.shiftright("cell", 54) == LEVELS, F.pmod(F.xxhash64("id"), F.lit(PARTS))).otherwise(0)
    others = own.keep(points_b.groupBy(F.col("cell").alias("b"), part.alias("part")).agg(F.collect_list(F.struct(*point)).alias("p")).drop("part"), "others")
    apart = lambda q: (F.col("x") - q["x"]) ** 2 + (F.col("y") - q["y"]) ** 2 + (F.col("z") - q["z"]) ** 2
    nearest = F.array_min(F.transform("p", lambda q: F.struct(F.sqrt(apart(q)).alias("d"), q["id"].alias("nearest"), apart(q).alias("s"))))
    met = lambda rows: rows.join(others.hint("merge"), "b").select(*point, "a", nearest.alias("m"))
    best = lambda rows: rows.groupBy(*point, "a").agg(F.min("m").alias("m"))
    first = pairs.groupBy("a").agg(F.min("most").alias("most")).join(pairs, ["a", "most"]).groupBy("a").agg(F.min("b").alias("b"))
    known = own.keep(best(met(points_a.withColumnRenamed("cell", "a").join(first, "a"))), "known")
    far = known.groupBy("a").agg(F.max("m.s").alias("far"))
    left = pairs.join(first, ["a", "b"], "left_anti").join(far, "a").where(F.col("gap") <= F.col("far") * slack).select("a", "b")
    left = left.join(kids_b.where("parent = cell").select(F.col("cell").alias("b"), *_BOX), "b")
    away = lambda c: F.greatest(F.col(f"{c}0") - F.col(c), F.col(c) - F.col(f"{c}1"), F.lit(0.0))
    asked = known.join(left, "a").where(away("x") ** 2 + away("y") ** 2 + away("z") ** 2 <= F.col("m.s") * slack).select(*point, "a", "b")
    found = best(known.select(*point, "a", "m").unionByName(met(asked)))
    return materialize(found.select(*point, "m.nearest", "m.d"), "nearest")


def _none(spark) -> DataFrame:
    return spark.createDataFrame([], "id long, x double, y double, z double, nearest long, d double")


def nearest_points(a: DataFrame, b: DataFrame) -> DataFrame:
    """``id, x, y, z, nearest, d``: each distinct place of ``a`` (``id, x, y, z``; the least id stands for it) and the nearest point of ``b``, equal distances by the lesser id.

    Both clouds are cut into cells that halve where points are dense. Pairs of cells go down together: a cell of ``a`` keeps those of ``b`` whose boxes may be
    nearer than the farthest that its best one can be. No distance is too far, and only pairs of last cells compare points. Without a point in ``b`` there is no row.
    """
    with scratch(a.sparkSession, "nearest") as own:
        trees = _both_trees(a, b, own)
        return _descend(*trees, own) if trees else _none(a.sparkSession)


def _ways(a: DataFrame, b: DataFrame, own: Scratch) -> list[tuple[str, DataFrame]]:
    """Both ways: the distance of each point, points of one place with that of the place."""
    trees, out = _both_trees(a, b, own), []
    for name, p, order in (("a to b", a, (0, 1)), ("b to a", b, (1, 0))):
        found = _descend(trees[order[0]], trees[order[1]], own) if trees else _none(a.sparkSession)
        found = found.select(*[F.col(c).alias(f"_{c}") for c in "xyz"], "nearest", "d")
        same = [F.col(c).cast("double") == F.col(f"_{c}") for c in "xyz"]
        out.append((name, materialize(p.select("id", "x", "y", "z").join(found, same[0] & same[1] & same[2]).select("id", "nearest", "d"), "distances")))
    return out


def cloud_deviation(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """For each way between two clouds (``id, x, y, z``), of the nearest points' distances: ``n``, ``high``, ``mean``, ``rms``, ``p95``, how many are ``over`` the tolerance, and their ``share``.

    Points, not surfaces. A cloud without points gives ``n`` of 0 and nulls.
    """
    rows = []
    with scratch(a.sparkSession, "deviation") as own:
        for name, found in _ways(a, b, own):
            r = lambda c: F.round(c, 6)
            stats = found.agg(F.count("*").alias("n"), r(F.max("d")).alias("high"), r(F.avg("d")).alias("mean"), r(F.sqrt(F.avg(F.col("d") * F.col("d")))).alias("rms"), F.count_if(F.col("d") > tolerance).alias("over")).first()
            p95 = percentile(found, "d", 0.95, own)
            rows.append((name, stats["n"], stats["high"], stats["mean"], stats["rms"], None if p95 is None else round(p95, 6), stats["over"], stats["over"] / stats["n"] if stats["n"] else None))
    return a.sparkSession.createDataFrame(rows, "way string, n long, high double, mean double, rms double, p95 double, over long, share double")


def worst_points(a: DataFrame, b: DataFrame, tolerance: float, k: int = 8) -> DataFrame:
    """``way, rank, id, nearest, d``: for each way the ``k`` points farthest from the other cloud, those over the tolerance; equal distances by id."""
    parts = []
    with scratch(a.sparkSession, "worst") as own:
        for name, found in _ways(a, b, own):
            top = found.where(F.col("d") > tolerance).orderBy(F.desc("d"), "id").limit(k)
            parts.append(top.select(F.lit(name).alias("way"), F.row_number().over(Window.orderBy(F.desc("d"), "id")).alias("rank"), "id", "nearest", F.round("d", 6).alias("d")))  # k rows
    return parts[0].unionAll(parts[1])
