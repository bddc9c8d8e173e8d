"""Bodies and open loops of meshes, and likeness of voxel shapes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.plans.components import connected_components
from orewright.plans.shared import materialize, scratch


def _corner(p: str) -> Column:
    return F.xxhash64("model_id", *[F.round(f"{p}{c}", 6) for c in "xyz"])


def _edges(faces: DataFrame) -> DataFrame:
    """The three edges of each face, with their ends in order."""
    point = lambda p: F.struct(*[F.round(f"{p}{c}", 6).alias(c) for c in "xyz"])
    edge = lambda p, q: F.struct(F.least(point(p), point(q)).alias("p"), F.greatest(point(p), point(q)).alias("q"))
    return faces.select("*", F.explode(F.array(edge("a", "b"), edge("b", "c"), edge("c", "a"))).alias("e"))


def _extent(points: DataFrame, *by: str) -> DataFrame:
    """The box and the middle (the mean of the distinct points) of the points (``x, y, z``) of each group."""
    boxes = [f(c).alias(f"{c}{e}") for c in "xyz" for e, f in ((0, F.min), (1, F.max))]
    return points.select(*by, "x", "y", "z").distinct().groupBy(*by).agg(*boxes, *[F.round(F.avg(c), 4).alias(f"c{c}") for c in "xyz"])


def mesh_bodies(faces: DataFrame) -> DataFrame:
    """``model_id, body, triangles, closed, volume, inverted``, the box ``x0 .. z1`` and the middle ``cx, cy, cz`` of each body of faces (``model_id, ax .. cz``): corners that faces share tie them to one body.

    A body is closed if exactly two faces have each of its edges; only then it has a volume, and is inverted if that is under 0. ``body`` numbers a model's bodies by triangles.
    """
    ids = faces.select("*", *[_corner(p).alias(f"_{p}") for p in "abc"])
    labels = connected_components(ids.select(F.explode(F.array(F.struct(F.col("_a").alias("a"), F.col("_b").alias("b")), F.struct(F.col("_a").alias("a"), F.col("_c").alias("b")))).alias("e")).select("e.*"))
    cross = lambda u, v, w: F.col(f"a{u}") * (F.col(f"b{v}") * F.col(f"c{w}") - F.col(f"b{w}") * F.col(f"c{v}"))
    signed = (cross("x", "y", "z") + cross("y", "z", "x") + cross("z", "x", "y")) / 6
    rows = ids.join(labels, F.col("_a") == F.col("node"))
    bodies = rows.groupBy("model_id", "label").agg(F.count("*").alias("triangles"), F.sum(signed).alias("v"))
    odd = _edges(rows).groupBy("model_id", "label", "e").agg(F.count("*").alias("k")).where("k <> 2").select("model_id", "label").distinct().withColumn("open", F.lit(True))
    corners = rows.select("model_id", "label", F.explode(F.array(*[F.struct(*[F.round(f"{p}{c}", 6).alias(c) for c in "xyz"]) for p in "abc"])).alias("p")).select("model_id", "label", "p.*")
    bodies = bodies.join(odd, ["model_id", "label"], "left").join(_extent(corners, "model_id", "label"), ["model_id", "label"]).withColumn("closed", F.col("open").isNull())
    order = Window.partitionBy("model_id").orderBy(F.desc("triangles"), F.desc(F.round(F.abs("v"), 6)), "label")
    return bodies.select(
        "model_id", F.row_number().over(order).alias("body"), "triangles", "closed", F.when(F.col("closed"), F.round(F.abs("v"), 6)).alias("volume"), (F.col("closed") & (F.col("v") < 0)).alias("inverted"), "x0", "x1", "y0", "y1", "z0", "z1", "cx", "cy", "cz"
    )


def list_open_loops(faces: DataFrame) -> DataFrame:
    """``model_id, loop, edges, length``, the box ``x0 .. z1`` and the middle ``cx, cy, cz`` of each connected loop of edges that only one face has; ``loop`` numbers a model's loops by edges, then length."""
    single = _edges(faces).groupBy("model_id", "e").agg(F.count("*").alias("k")).where("k = 1")
    name = lambda c: F.xxhash64("model_id", f"e.{c}")
    single = single.select("model_id", "e", name("p").alias("a"), name("q").alias("b"), F.sqrt(sum((F.col(f"e.p.{c}") - F.col(f"e.q.{c}")) ** 2 for c in "xyz")).alias("length"))
    rows = single.join(connected_components(single.select("a", "b")), F.col("a") == F.col("node"))
    loops = rows.groupBy("model_id", "label").agg(F.count("*").alias("edges"), F.round(F.sum("length"), 4).alias("length"))
    ends = rows.select("model_id", "label", F.explode(F.array("e.p", "e.q")).alias("p")).select("model_id", "label", "p.*")
    order = Window.partitionBy("model_id").orderBy(F.desc("edges"), F.desc("length"), "label")
    return loops.join(_extent(ends, "model_id", "label"), ["model_id", "label"]).select("model_id", F.row_number().over(order).alias("loop"), "edges", "length", "x0", "x1", "y0", "y1", "z0", "z1", "cx", "cy", "cz")


def open_loops(faces: DataFrame) -> DataFrame:
    """``model_id, loops, edges, length``: how many loops of :func:`list_open_loops` a model has, and their edges and length together."""
    return list_open_loops(faces).groupBy("model_id").agg(F.count("*").alias("loops"), F.sum("edges").alias("edges"), F.round(F.sum("length"), 4).alias("length"))


def rotations() -> list[tuple[tuple[int, int], ...]]:
    """The 24 right-angle rotations: for each new axis, the old axis and its sign."""
    out = []
    for axes in permutations(range(3)):
        parity = sum(axes[i] > axes[j] for i in range(3) for j in range(i + 1, 3)) % 2
        for signs in product((1, -1), repeat=3):
            if (signs[0] * signs[1] * signs[2] == 1) == (parity == 0):
                out.append(tuple(zip(axes, signs, strict=True)))
    return out


#: Bits of a coordinate in a voxel's code, and the most voxels of a model whose turned codes are held in one table.
BITS, TABLE = 20, 4096


def _turns(codes: np.ndarray) -> Iterator[np.ndarray]:
    """The codes of a model's voxels after each rotation, moved to the origin, in order."""
    at = np.stack([codes >> 2 * BITS, codes >> BITS & (1 << BITS) - 1, codes & (1 << BITS) - 1])
    for turn in rotations():
        x, y, z = (at[a] * s - (at[a] * s).min() for a, s in turn)
        yield np.sort(x << 2 * BITS | y << BITS | z)


def _overlap(codes: np.ndarray):
    """A function from the codes of another model to the most pairs of equal voxels under a rotation."""
    if not len(codes):
        return lambda other: 0
    if len(codes) > TABLE:  # one rotation at a time, so a large model takes no more than a few times itself
        return lambda other: int(max((np.searchsorted(t, other, "right") - np.searchsorted(t, other, "left")).sum() for t in _turns(codes)))
    turned = np.stack(list(_turns(codes)))
    known, place = np.unique(turned, return_inverse=True)
    counts = np.zeros((len(known), len(turned)), np.int64)
    np.add.at(counts, (place.ravel(), np.repeat(np.arange(len(turned)), len(codes))), 1)

    def best(other: np.ndarray) -> int:
        at = np.minimum(np.searchsorted(known, other), len(known) - 1)
        return int(counts[at[known[at] == other]].sum(0).max())

    return best


def _best_overlaps(batches):
    """``sa, sb, k`` of pairs with the codes of both; neighbours in order share the table of their first model."""
    last, best = None, None
    for batch in batches:
        own, k = [batch.column(c) for c in ("ca", "cb")], []
        ends, values = [c.offsets.to_numpy() for c in own], [c.values.to_numpy(zero_copy_only=False) for c in own]
        for i, name in enumerate(batch.column("sa").to_pylist()):
            if last != (name,):
                last, best = (name,), _overlap(values[0][ends[0][i] : ends[0][i + 1]])
            k.append(best(values[1][ends[1][i] : ends[1][i + 1]]))
        yield pa.RecordBatch.from_arrays([batch.column("sa"), batch.column("sb"), pa.array(k, pa.int64())], names=["sa", "sb", "k"])


def shape_similarity(voxels: DataFrame, pairs: DataFrame, least: float = 0.75) -> DataFrame:
    """``a, b, score``: of ``pairs`` of models (``model_id, vx, vy, vz``, whole numbers), the best overlap of their voxels over their union, under the 24 rotations of ``a``, each moved to the origin; those of ``least`` or more.

    A model is one row, an array of numbers that code its voxels. Models of one shape are compared once for all of them, and only pairs of different shapes
    carry arrays, which are turned where they are compared.
    """
    axes, spark = ["vx", "vy", "vz"], voxels.sparkSession
    whole = F.col("vx").isNotNull() & F.col("vy").isNotNull() & F.col("vz").isNotNull()
    low, high = [[f(F.when(whole, F.col(c).cast("long"))).alias(f"{e}{c}") for c in axes] for e, f in (("l", F.min), ("h", F.max))]
    lists = voxels.groupBy("model_id").agg(F.count("*").alias("n"), *low, *high, F.collect_list(F.when(whole, F.struct(*[F.col(c).cast("long").alias(c) for c in axes]))).alias("p"))
    fits = F.coalesce(F.greatest(*[F.col(f"h{c}") - F.col(f"l{c}") for c in axes]), F.lit(0)) < 1 << BITS
    code = lambda p: sum(((p[c] - F.col(f"l{c}")) * (1 << BITS * (2 - i)) for i, c in enumerate(axes)), F.lit(0).cast("long"))
    codes = F.when(fits, F.array_sort(F.transform("p", code))).otherwise(F.raise_error(F.lit(f"a model is over {(1 << BITS) - 1} voxels long")).cast("array<bigint>"))
    with scratch(spark, "shapes") as own:
        models = own.keep(lists.select("model_id", "n", codes.alias("codes")).withColumn("digest", F.sha2(F.concat_ws(",", F.col("n").cast("string"), F.col("codes").cast("array<string>")), 256)), "models")
        first = models.groupBy("digest").agg(F.min("model_id").alias("shape"))
        named = own.keep(models.select("model_id", "digest", "n").join(first, "digest").select("model_id", "shape", "n"), "named")
        side = lambda x: named.select(F.col("model_id").alias(x), F.col("shape").alias(f"s{x}"), F.col("n").alias(f"n{x}"))
        asked = own.keep(pairs.select("a", "b").distinct().join(side("a"), "a").join(side("b"), "b"), "asked")
        form = lambda x: models.join(first, F.col("model_id") == F.col("shape"), "left_semi").select(F.col("model_id").alias(f"s{x}"), F.col("codes").alias(f"c{x}")).hint("merge")
        todo = asked.select("sa", "sb").distinct().join(form("b"), "sb").join(form("a"), "sa").select("sa", "sb", "ca", "cb")
        kinds = {f.name: f.dataType for f in todo.schema}
        found = todo.mapInArrow(_best_overlaps, T.StructType([T.StructField("sa", kinds["sa"]), T.StructField("sb", kinds["sb"]), T.StructField("k", T.LongType())]))
        score = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
        return materialize(asked.join(found.where("k > 0"), ["sa", "sb"]).where(score >= least).select("a", "b", F.round(score, 6).alias("score")), "likeness")
