"""The nearest vectors by cosine, exactly, from cells that bounds don't rule out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orewright.plans.shared import materialize

#: Vectors that centres are chosen from, and the most centres: what is held in every task is bounded by these.
SAMPLE, CENTRES = 4096, 256


def _unit(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows; a zero vector stays zero."""
    v = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    v = np.asarray(v.flatten(), float).reshape(len(v), -1 if len(v) else 0)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _angles(v: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(v @ centres.T, -1, 1))


def choose_centres(vectors: DataFrame, rows: int) -> np.ndarray:
    """Up to :data:`CENTRES` unit vectors, about the root of the number of rows, far from each other: each is the vector of a sample that is farthest from those before it. The sample is those of the least hashes of the id."""
    few = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()
    v = _unit(few.column("v"))
    v = v[np.linalg.norm(v, axis=1) > 0]
    if not len(v):
        return np.zeros((0, 0))
    chosen, away = [0], _angles(v, v[:1])[:, 0]
    while len(chosen) < min(CENTRES, int(rows**0.5) + 1, len(v)) and away.max() > 1e-9:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, _angles(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


def _cells(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Adds ``cell``, the nearest centre (-1 for a zero vector), and ``angle`` to it."""

    def run(batches):
        for batch in batches:
            v = _unit(batch.column("v"))
            angles = _angles(v, centres)
            zero = np.linalg.norm(v, axis=1) == 0
            cell = np.where(zero, -1, angles.argmin(1))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(cell, pa.int32()), pa.array(np.where(zero, 0.0, angles.min(1)), pa.float64())], names=["id", "v", "cell", "angle"])

    return vectors.mapInArrow(run, "id long, v array<double>, cell int, angle double")


class _Bounds:
    """For each cell: how many vectors it has, and the widest angle to its centre."""

    def __init__(self, centres: np.ndarray, rows: list):
        self.cells = np.array([r["cell"] for r in rows], np.int64)
        self.counts = np.array([r["n"] for r in rows], np.int64)
        self.wide = np.array([r["wide"] for r in rows])
        self.centres = np.array([centres[c] if c >= 0 else np.zeros(centres.shape[1]) for c in self.cells]).reshape(len(rows), centres.shape[1])

    def highest(self, v: np.ndarray) -> np.ndarray:
        """The highest cosine that a vector of each cell can have with each of ``v``; 0 for zero vectors on either side."""
        high = np.cos(np.maximum(_angles(v, self.centres) - self.wide, 0)) + 1e-8  # scores are rounded to nine digits
        return np.where((self.cells < 0)[None] | (np.linalg.norm(v, axis=1) == 0)[:, None], 0.0, high)


def _visits(queries: DataFrame, bounds: _Bounds, k: int, first: bool) -> DataFrame:
    """``id, v, cell``: the cells that a query must see. ``first``: the most promising ones, until they have more than ``k`` vectors; else all others that may hold as good a one as ``low``."""

    def run(batches):
        for batch in batches:
            v = _unit(batch.column("v"))
            high = bounds.highest(v)
            order = np.argsort(-high, axis=1, kind="stable")
            before = np.cumsum(bounds.counts[order], 1) - bounds.counts[order]
            early = np.zeros(high.shape, bool)
            np.put_along_axis(early, order, before <= k, 1)
            sees = early if first else ~early & (high >= batch.column("low").to_numpy(zero_copy_only=False)[:, None])
            row, cell = np.nonzero(sees)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), batch.column("v").take(pa.array(row)), pa.array(bounds.cells[cell], pa.int32())], names=["id", "v", "cell"])

    return queries.mapInArrow(run, "id long, v array<double>, cell int")


def _best(visits: DataFrame, corpus: DataFrame, parts: DataFrame, m: int, k: int, least: float) -> DataFrame:
    """``query, id, score``: the best ``k`` in each part of each cell that a query visits. A group is one part of a cell with one part of the queries."""
    deal = F.pmod(F.xxhash64("id"), F.lit(m)).cast("int")
    asks = visits.join(parts, "cell").select(F.lit(True).alias("asks"), "id", "v", "cell", deal.alias("i"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
    held = corpus.join(parts, "cell").select(F.lit(False).alias("asks"), "id", "v", "cell", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("i"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("j"))

    def nearest(table: pa.Table) -> pa.Table:
        asks = table.column("asks").to_numpy(zero_copy_only=False)
        ids, found = table.column("id").to_numpy(), [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if asks.any() and not asks.all():
            v = _unit(table.column("v"))
            own, q, there, asked = ids[~asks], ids[asks], v[~asks], v[asks]
            for at in range(0, len(q), 256):
                score = np.round(asked[at : at + 256] @ there.T, 9) + 0.0
                for row, query in zip(score, q[at : at + 256], strict=True):
                    fit = np.flatnonzero((row >= least) & (own != query))
                    if len(fit) > k:  # all as good as the k-th
                        fit = fit[row[fit] >= np.partition(row[fit], len(fit) - k)[len(fit) - k]]
                    fit = fit[np.lexsort((own[fit], -row[fit]))][:k]
                    found.append((np.full(len(fit), query), own[fit], row[fit]))
        return pa.table(dict(zip(("query", "id", "score"), (np.concatenate(c) for c in zip(*found, strict=True)), strict=True)))

    return asks.unionByName(held).groupBy("cell", "i", "j").applyInArrow(nearest, "query long, id long, score double")


def _top(near: DataFrame, k: int) -> DataFrame:
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _plan(corpus: DataFrame, queries: DataFrame, k: int, least: float, query_block: int, corpus_block: int) -> tuple[DataFrame, list[DataFrame]]:
    corpus, queries = (df.where("v is not null and id is not null").select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")) for df in (corpus, queries))
    n = corpus.count()
    centres = choose_centres(corpus, n)
    placed = materialize(_cells(corpus, centres) if len(centres) else corpus.withColumns({"cell": F.lit(-1), "angle": F.lit(0.0)}), "cells")
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("wide"))
    rows = sizes.orderBy("cell").collect()  # a row for each cell
    parts = placed.sparkSession.createDataFrame([(r["cell"], -(-r["n"] // corpus_block)) for r in rows], "cell int, parts int")
    width = centres.shape[1] if len(centres) else len(((queries if n == 0 else corpus).head() or {"v": [0.0]})["v"])
    bounds = _Bounds(centres if len(centres) else np.zeros((1, width)), rows)
    m = -(-max(queries.count(), 1) // query_block)
    first = _visits(queries, bounds, k, True)
    near = materialize(_top(_best(first, placed, parts, m, k, least), k).drop("rank"), "near")
    low = near.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("low")).select(F.col("query").alias("id"), F.when(F.col("n") == k, F.col("low")).alias("low"))
    rest = _visits(queries.join(low, "id", "left").withColumn("low", F.greatest(F.coalesce("low", F.lit(-2.0)), F.lit(least))).select("id", "v", "low"), bounds, k, False)
    return _top(near.unionByName(_best(rest, placed, parts, m, k, least)), k), [first, rest, sizes, queries]


def vector_topk(corpus: DataFrame, queries: DataFrame, k: int, least: float = -1.0, query_block: int = 4096, corpus_block: int = 65_536) -> DataFrame:
    """``query, id, score, rank`` of the ``k`` nearest vectors (``id, v``, all of one length) by cosine (a zero vector scores 0), the query itself left out, ties to the lower id. Null vectors and ids are left out.

    Every vector belongs to the cell of its nearest centre (:func:`choose_centres`). A query sees its most promising cells first; of the others only those whose widest angle lets them hold one as
    good as its ``k``-th so far. What is skipped can't be in the result. Cells and queries are dealt to parts of ``corpus_block`` and ``query_block``, so a cell with most of all vectors is many tasks.
    """
    return _plan(corpus, queries, k, least, query_block, corpus_block)[0]


def pairs_seen(corpus: DataFrame, queries: DataFrame, k: int) -> float:
    """The share of all pairs of a query and a vector that :func:`vector_topk` scores."""
    _, (first, rest, sizes, asked) = _plan(corpus, queries, k, -1.0, 4096, 65_536)
    seen = first.select("cell").unionAll(rest.select("cell")).join(sizes, "cell").agg(F.sum("n")).first()[0] or 0
    return seen / max(1, asked.count() * (sizes.agg(F.sum("n")).first()[0] or 1))
