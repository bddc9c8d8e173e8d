"""Polygons as rings: arrays of points ``x, y`` whose last joins the first. Rings don't cross themselves; they may be concave and turn either way."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = "struct<x: double, y: double>"


def _moved(ring: Column) -> Column:
    return F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))


def ring_edges(ring: Column) -> Column:
    """Each side as a struct of its ends ``a`` and ``b``."""
    return F.zip_with(ring, _moved(ring), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def ring_area(ring: Column) -> Column:
    turns = F.zip_with(ring, _moved(ring), lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.abs(F.aggregate(turns, F.lit(0.0), lambda s, x: s + x)) / 2


def box_ring(x0: str = "x0", y0: str = "y0", x1: str = "x1", y1: str = "y1") -> Column:
    """The ring of a rectangle."""
    return F.array(*[F.struct(F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def with_rings(df: DataFrame) -> DataFrame:
    """Rows with both ``ring`` and the bounds ``x0, y0, x1, y1``: of the two, the one that isn't there is made from the other."""
    if "ring" not in df.columns:
        return df.withColumn("ring", box_ring())
    bound = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    return df.withColumns({"x0": bound(F.array_min, "x"), "y0": bound(F.array_min, "y"), "x1": bound(F.array_max, "x"), "y1": bound(F.array_max, "y")})


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies in a ring, by the number of sides that a line to its right crosses."""
    crosses = F.filter(ring_edges(ring), lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    return F.size(crosses) % 2 == 1


def side_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """The distance from a point to the straight line between two others."""
    ux, uy = bx - ax, by - ay
    length = ux * ux + uy * uy
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * ux + (y - ay) * uy) / length)))
    return F.sqrt((x - ax - t * ux) ** 2 + (y - ay - t * uy) ** 2)


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """The distance from a point to a polygon, 0 inside."""
    near = F.array_min(F.transform(ring_edges(ring), lambda e: side_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    return F.when(inside(ring, x, y), 0.0).otherwise(near)


def segment_distance(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """The distance from a polygon to the straight line between two points, 0 where they meet."""
    turn = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        one = turn(a["x"], a["y"], b["x"], b["y"], x0, y0) * turn(a["x"], a["y"], b["x"], b["y"], x1, y1) < 0
        return one & (turn(x0, y0, x1, y1, a["x"], a["y"]) * turn(x0, y0, x1, y1, b["x"], b["y"]) < 0)

    corners = F.array_min(F.transform(ring, lambda p: side_distance(p["x"], p["y"], x0, y0, x1, y1)))
    ends = F.least(ring_distance(ring, x0, y0), ring_distance(ring, x1, y1))
    return F.when(F.exists(ring_edges(ring), crosses), 0.0).otherwise(F.least(corners, ends))


def crosses_inside(ring: Column, x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Whether the straight line between two points passes through the inside of a polygon; touching its border alone doesn't count.

    The line is cut where it meets sides; it passes through where the middle of a piece is inside.
    """
    ux, uy = x1 - x0, y1 - y0

    def meets(e: Column) -> Column:
        vx, vy = e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]
        across = ux * vy - uy * vx
        t = ((e["a"]["x"] - x0) * vy - (e["a"]["y"] - y0) * vx) / F.nullif(across, F.lit(0.0))
        s = ((e["a"]["x"] - x0) * uy - (e["a"]["y"] - y0) * ux) / F.nullif(across, F.lit(0.0))
        return F.when((t > 0) & (t < 1) & (s >= 0) & (s <= 1), t)

    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.array_compact(F.transform(ring_edges(ring), meets))))

    def within(i: Column) -> Column:
        t = (F.get(cuts, i) + F.get(cuts, i - 1)) / 2
        x, y = x0 + ux * t, y0 + uy * t
        off = F.array_min(F.transform(ring_edges(ring), lambda e: side_distance(x, y, e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
        return ((F.get(cuts, i) - F.get(cuts, i - 1)) > 1e-12) & inside(ring, x, y) & (off > 1e-9)

    return F.exists(F.sequence(F.lit(1), F.size(cuts) - 1), within)


def middle_point(ring: Column) -> Column:
    """A point in the polygon, as struct ``x, y``: the middle of the widest stretch at half of its height."""
    ys = F.transform(ring, lambda p: p["y"])
    y = (F.array_min(ys) + F.array_max(ys)) / 2
    met = F.filter(ring_edges(ring), lambda e: (e["a"]["y"] > y) != (e["b"]["y"] > y))
    xs = F.array_sort(F.transform(met, lambda e: (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]))
    spans = F.transform(F.sequence(F.lit(1), F.greatest(F.size(xs), F.lit(2)), F.lit(2)), lambda i: F.struct((F.get(xs, i) - F.get(xs, i - 1)).alias("w"), ((F.get(xs, i) + F.get(xs, i - 1)) / 2).alias("x")))
    return F.struct(F.array_max(spans)["x"].alias("x"), y.alias("y"))


def common_area(p: np.ndarray, q: np.ndarray) -> float:
    """The area that two rings (n, 2) share: between any two heights at which a corner lies or sides cross, it is a width that changes evenly times a height."""
    low, high = max(p[:, 1].min(), q[:, 1].min()), min(p[:, 1].max(), q[:, 1].max())
    if low >= high:
        return 0.0
    a, b = (np.concatenate([r, np.roll(r, -1, 0)], 1) for r in (p, q))
    u, v = a[:, None, 2:] - a[:, None, :2], b[None, :, 2:] - b[None, :, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((b[None, :, 0] - a[:, None, 0]) * v[..., 1] - (b[None, :, 1] - a[:, None, 1]) * v[..., 0]) / (u[..., 0] * v[..., 1] - u[..., 1] * v[..., 0])
        crossing = (a[:, None, 1] + t * u[..., 1])[(t > 0) & (t < 1)]
    heights = np.unique(np.concatenate([p[:, 1], q[:, 1], crossing, [low, high]]))
    heights = heights[(heights >= low) & (heights <= high)]

    def cuts(e: np.ndarray, y: float) -> np.ndarray:
        met = e[(e[:, 1] > y) != (e[:, 3] > y)]
        return np.sort((met[:, 2] - met[:, 0]) * (y - met[:, 1]) / (met[:, 3] - met[:, 1]) + met[:, 0])

    total = 0.0
    for y0, y1 in zip(heights[:-1], heights[1:], strict=True):
        x, z = cuts(a, (y0 + y1) / 2), cuts(b, (y0 + y1) / 2)
        wide = np.minimum(x[1::2, None], z[None, 1::2]) - np.maximum(x[::2, None], z[None, ::2])
        total += float(np.maximum(wide, 0).sum()) * (y1 - y0)
    return total


def _sides(ring: np.ndarray) -> np.ndarray:
    return np.concatenate([ring, np.roll(ring, -1, 0)], 1)


def _crossings(e: np.ndarray) -> np.ndarray:
    """Heights at which two of the sides (x, y, x, y) cross."""
    u = e[:, 2:] - e[:, :2]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((e[None, :, 0] - e[:, None, 0]) * u[None, :, 1] - (e[None, :, 1] - e[:, None, 1]) * u[None, :, 0]) / (u[:, None, 0] * u[None, :, 1] - u[:, None, 1] * u[None, :, 0])
        return (e[:, None, 1] + t * u[:, None, 1])[(t > 0) & (t < 1)]


def _stretches(e: np.ndarray, y: float) -> np.ndarray:
    """Where a level line is inside a ring: from and to, in order."""
    met = e[(e[:, 1] > y) != (e[:, 3] > y)]
    return np.sort((met[:, 2] - met[:, 0]) * (y - met[:, 1]) / (met[:, 3] - met[:, 1]) + met[:, 0]).reshape(-1, 2)


def union_area(p: np.ndarray, rings: list[np.ndarray], box: tuple[float, float, float, float], most: int = 120, depth: int = 8) -> float:
    """The area of a ring (n, 2) under the union of others, inside a box (x0, y0, x1, y1).

    Slabs lie between any two heights with a corner or a crossing; in a slab the union's width changes evenly, so its middle says all. A box into which more than ``most`` sides reach is quartered, ``depth`` times at most.
    """
    x0, y0, x1, y1 = box
    meets = lambda r: r[:, 0].max() > x0 and r[:, 0].min() < x1 and r[:, 1].max() > y0 and r[:, 1].min() < y1
    rings = [r for r in rings if meets(r)]
    if not rings or not meets(p):
        return 0.0
    own, others = _sides(p), [_sides(r) for r in rings]
    every = np.concatenate([own, *others])
    near = (every[:, [0, 2]].max(1) >= x0) & (every[:, [0, 2]].min(1) <= x1) & (every[:, [1, 3]].max(1) >= y0) & (every[:, [1, 3]].min(1) <= y1)
    if near.sum() > most and depth:
        x, y = (x0 + x1) / 2, (y0 + y1) / 2
        return sum(union_area(p, rings, part, most, depth - 1) for part in ((x0, y0, x, y), (x, y0, x1, y), (x0, y, x, y1), (x, y, x1, y1)))
    every = np.concatenate([every[near], _sides(np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1)]))])
    heights = np.unique(np.concatenate([every[:, 1], every[:, 3], _crossings(every)]))
    heights = heights[(heights >= y0) & (heights <= y1)]
    total = 0.0
    for low, high in zip(heights[:-1], heights[1:], strict=True):
        y = (low + high) / 2
        inside = np.clip(_stretches(own, y), x0, x1)
        parts = np.concatenate([_stretches(e, y) for e in others])
        if not len(inside) or not len(parts):
            continue
        parts = parts[np.argsort(parts[:, 0])]
        reached = np.maximum.accumulate(parts[:, 1])
        starts = np.flatnonzero(np.append(True, parts[1:, 0] > reached[:-1]))  # stretches that touch are one
        joined = np.column_stack([parts[starts, 0], reached[np.append(starts[1:] - 1, len(parts) - 1)]])
        wide = np.minimum(inside[:, None, 1], joined[None, :, 1]) - np.maximum(inside[:, None, 0], joined[None, :, 0])
        total += float(np.maximum(wide, 0).sum()) * (high - low)
    return total


@F.pandas_udf(T.DoubleType())
def _under(px: pd.Series, py: pd.Series, rx: pd.Series, ry: pd.Series, x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    rows = zip(px, py, rx, ry, zip(x0, y0, x1, y1, strict=True), strict=True)
    return pd.Series([union_area(np.column_stack([a, b]), [np.column_stack([u, v]) for u, v in zip(us, vs, strict=True)], box) for a, b, us, vs, box in rows], dtype=float)


def area_under(ring: Column, rings: Column, box: list[Column]) -> Column:
    """The area of a ring under the union of ``rings``, inside a box."""
    part = lambda r, c: F.transform(r, lambda v: v[c])
    return _under(part(ring, "x"), part(ring, "y"), F.transform(rings, lambda r: part(r, "x")), F.transform(rings, lambda r: part(r, "y")), *box)


@F.pandas_udf(T.DoubleType())
def _common(px: pd.Series, py: pd.Series, qx: pd.Series, qy: pd.Series) -> pd.Series:
    return pd.Series([common_area(np.column_stack([a, b]), np.column_stack([c, d])) for a, b, c, d in zip(px, py, qx, qy, strict=True)], dtype=float)


def shared_area(p: Column, q: Column) -> Column:
    """The area that two rings share."""
    part = lambda ring, c: F.transform(ring, lambda v: v[c])
    return _common(part(p, "x"), part(p, "y"), part(q, "x"), part(q, "y"))
