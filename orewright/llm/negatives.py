"""Hard negatives by exact search in cover trees.

Rows of one label that lie alike (by the signs of a few projections) are neighbours in a range partitioning and are cut into trees of up to :data:`TREE`
rows. Each vector gets one component more, so that all of a tree are equally long; then the angle between two of them bounds inner products. A
node has a row as its centre and covers its rows within a radius; radii shrink by :data:`BASE` from level to level. Anchors go through a tree in blocks:
the node with the highest bound comes first, anchors whose threshold or window lies outside a node's bounds skip it, and rows of leaves are scored exactly.
Whole trees are skipped in the same way, by their roots: the best tree of each anchor gives it a threshold before the others are planned.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of a tree and of a leaf, anchors of a block, trees whose roots are looked at together.
TREE, LEAF, BLOCK, HEADS = 4096, 64, 512, 2048
BASE = 1.3
_SIGNS = 16
_TREES = "tree string, label long, norm double, dim long, kind string, ids binary, vectors binary, middles binary, angles binary, firsts binary, counts binary, starts binary, stops binary, root array<long>, root_angle double"


def comparable(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id, label, v``: components times ``scale``, rounded down. Rows with a null id, label or vector, or a null or non-finite component, take no part;
    of rows of one id the one with the least label, then vector, stays. Vectors may differ in length: what one lacks counts as 0."""
    x = F.col("embedding")
    odd = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~odd)
    scaled = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.struct(F.col("label").cast("long").alias("label"), F.transform(x, lambda c: F.floor(c.cast("double") * scale)).alias("v")).alias("row"))
    return scaled.groupBy("vec_id").agg(F.min("row").alias("row")).select("vec_id", "row.label", "row.v")


def matrix(lists: pa.Array) -> np.ndarray:
    """Lists of numbers as the rows of a matrix, short ones filled with 0."""
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat[ends[0] : ends[-1]]
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers in doubles: exact, as all are below 2^53."""
    d = min(a.shape[1], b.shape[1])
    return a[:, :d].astype(np.float64) @ b[:, :d].T.astype(np.float64)


def lengths(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return np.sqrt((x * x).sum(1))


def build_tree(ids: np.ndarray, x: np.ndarray) -> dict:
    """A cover tree as arrays: points leaf by leaf (by id within a leaf), and per node its centre, the angle that covers its points, and its children or points."""
    norms = lengths(x)
    norm = float(norms.max())
    long = np.column_stack([x, np.sqrt(np.maximum(norm * norm - norms * norms, 0))])

    def far(points: np.ndarray, c: int) -> np.ndarray:
        off = long[points] - long[c]
        return np.sqrt((off * off).sum(1))

    def cover(points: np.ndarray, c: int, away: np.ndarray, reach: float) -> list | None:
        """Centres and the points that each takes within ``reach``; None where centres take hardly more than themselves."""
        groups, left = [], points
        while True:
            near = away <= reach
            groups.append((left[near], c))
            left = left[~near]
            if not len(left):
                return groups
            if len(groups) >= 32 and len(points) - len(left) < 3 * len(groups):
                return None
            c = int(left[0])
            away = far(left, c)

    everything = np.arange(len(x))
    off = long - long.mean(0)
    todo = [(everything, int((off * off).sum(1).argmin()))]
    middles, radii, firsts, counts, starts, stops, leaves, at, top = [], [], [], [], [], [], [], 0, 0.0
    for points, c in todo:  # grows: children of a node stand together
        away = far(points, c)
        radius = float(away.max())
        top = top or radius
        reach = top
        while reach >= radius > 0:
            reach /= BASE
        groups = cover(points, c, away, reach) if len(points) > LEAF and radius > 0 else None
        middles.append(c)
        radii.append(radius)
        firsts.append(len(todo))
        counts.append(len(groups) if groups else 0)
        starts.append(at)
        if groups:
            todo += groups
        else:
            leaves.append(points[np.argsort(ids[points], kind="stable")])
            at += len(points)
        stops.append(at)
    order = np.concatenate(leaves)
    place = np.empty(len(order), np.int64)
    place[order] = everything
    angles = 2 * np.arcsin(np.minimum(1.0, np.array(radii) / (2 * norm))) if norm else np.zeros(len(radii))
    tree = {"norm": norm, "ids": ids[order], "x": x[order], "middles": place[middles], "angles": angles}
    return tree | {k: np.array(v, np.int64) for k, v in (("firsts", firsts), ("counts", counts), ("starts", starts), ("stops", stops))}


def _bounds(q: np.ndarray, q_norm: np.ndarray, centres: np.ndarray, norm, angles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The highest and the least inner product of each query with what each node covers, a little wide for the sake of rounding."""
    size = q_norm[:, None] * np.broadcast_to(norm, (len(centres),))[None]
    angle = np.arccos(np.clip(np.divide(inner(q, centres), size, out=np.zeros_like(size), where=size > 0), -1, 1))
    slack = 0.5 + 1e-7 * size
    return size * np.cos(np.maximum(angle - angles, 0)) + slack, size * np.cos(np.minimum(angle + angles, np.pi)) - slack


def search(tree: dict, q: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, but: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each request (a row of ``q`` and a window of scores) its best ``k`` rows, equal scores by id: request, id, score. ``but`` are ids that a request leaves out.

    Nodes are taken in the order of the highest bound that any request has; requests drop out of a node as soon as its bounds leave their window or fall under their own k-th best.
    """
    norms, best = lengths(q), low.astype(np.float64).copy()
    if norms.max(initial=0) * tree["norm"] >= 2**53:
        raise ArithmeticError("inner products reach 2^53, where they aren't exact")
    found: list[tuple] = []
    held = 0

    def fold() -> None:
        nonlocal found, held
        r, i, s = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((i, -s, r))
        r, i, s = r[order], i[order], s[order]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        last = rank == k - 1
        best[r[last]] = np.maximum(best[r[last]], s[last])
        found = [tuple(x[rank < k] for x in (r, i, s))]
        held = len(found[0][0])

    everyone = np.arange(len(owner))
    heap: list[tuple] = [(0.0, 0, everyone, np.full(len(owner), np.inf))]
    while heap:
        _, node, alive, most = heapq.heappop(heap)
        alive = alive[most >= best[alive]]
        if not len(alive):
            continue
        who, back = np.unique(owner[alive], return_inverse=True)
        if n := tree["counts"][node]:
            children = np.arange(tree["firsts"][node], tree["firsts"][node] + n)
            upper, lower = (b[back] for b in _bounds(q[who], norms[who], tree["x"][tree["middles"][children]], tree["norm"], tree["angles"][children]))
            stays = (upper >= best[alive][:, None]) & (lower <= high[alive][:, None])
            for c in np.flatnonzero(stays.any(0)):
                own = stays[:, c]
                bounds = upper[own, c]
                heapq.heappush(heap, (-float(np.minimum(bounds, high[alive[own]]).max()), int(children[c]), alive[own], bounds))
            continue
        a, b = tree["starts"][node], tree["stops"][node]
        ids = tree["ids"][a:b]
        scores = inner(q[who], tree["x"][a:b])[back]
        scores[(scores < best[alive][:, None]) | (scores > high[alive][:, None]) | (ids[None] == but[alive][:, None])] = -np.inf
        if len(ids) > k:
            kth = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k, None]
            equal = scores == kth
            scores[(scores < kth) | (equal & (np.cumsum(equal, 1) > k - (scores > kth).sum(1, keepdims=True)))] = -np.inf
            best[alive] = np.maximum(best[alive], kth[:, 0])
        r, c = np.nonzero(scores > -np.inf)
        if len(r):
            found.append((alive[r], ids[c], scores[r, c]))
            held += len(r)
            if held > 8 * k * max(len(owner), 64):
                fold()
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    fold()
    return found[0]


def plant_trees(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows of :func:`comparable` in trees, one a row; a hot label or vector is many trees."""

    def run(batches):
        held, label, made = [], None, 0

        def plant():
            nonlocal held, made
            ids, x = np.concatenate([h[0] for h in held]), [h[1] for h in held]
            width = max(p.shape[1] for p in x)
            x = np.concatenate([np.pad(p, ((0, 0), (0, width - p.shape[1]))) for p in x])
            held, made = [], made + 1
            tree = build_tree(ids, x)
            kind = np.min_scalar_type(-int(np.abs(x).max(initial=1)) - 1)
            values = {"tree": f"{label}-{ids[0]}-{made}", "label": label, "norm": tree["norm"], "dim": width, "kind": kind.str, "vectors": tree["x"].astype(kind).tobytes(), "root": tree["x"][tree["middles"][0]].tolist(), "root_angle": float(tree["angles"][0])}
            values |= {k: tree[k].tobytes() for k in ("ids", "middles", "angles", "firsts", "counts", "starts", "stops")}
            return pa.RecordBatch.from_pylist([values], schema=schema)

        for batch in batches:
            ids, labels, x = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"))
            cuts = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                while a < b:
                    size = sum(len(h[0]) for h in held)
                    if held and (labels[a] != label or size >= TREE):
                        yield plant()
                        size = 0
                    label = int(labels[a])
                    c = min(b, a + TREE - size)
                    held.append((ids[a:c], x[a:c]))
                    a = c
        if held:
            yield plant()

    binary = ("ids", "vectors", "middles", "angles", "firsts", "counts", "starts", "stops")
    kinds = {"tree": pa.string(), "label": pa.int64(), "norm": pa.float64(), "dim": pa.int64(), "kind": pa.string()} | dict.fromkeys(binary, pa.binary()) | {"root": pa.list_(pa.int64()), "root_angle": pa.float64()}
    schema = pa.schema(list(kinds.items()))
    return _alike(rows, partitions).mapInArrow(run, _TREES)


def _alike(rows: DataFrame, partitions: int) -> DataFrame:
    """Rows by label, then by the signs of projections, in ranges."""

    def signs(batches):
        for batch in batches:
            x = matrix(batch.column("v"))
            plane = np.random.default_rng(7).standard_normal((x.shape[1], _SIGNS))
            code = (x @ plane > 0) @ (1 << np.arange(_SIGNS - 1, -1, -1))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array(code, pa.int64())], names=["vec_id", "label", "v", "code"])

    coded = rows.select("vec_id", "label", "v").mapInArrow(signs, "vec_id long, label long, v array<long>, code long")
    return coded.repartitionByRange(partitions, "label", "code", "vec_id").sortWithinPartitions("label", "code", "vec_id").drop("code")


def block_anchors(anchors: DataFrame, partitions: int) -> DataFrame:
    """``vec_id, label, v, block``: anchors that lie alike in blocks of up to :data:`BLOCK`."""

    def run(batches):
        start, n = None, 0
        for batch in batches:
            if start is None:
                start = batch.column("vec_id")[0].as_py()
            blocks = [f"{start}-{(n + i) // BLOCK}" for i in range(batch.num_rows)]
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("v"), pa.array(blocks, pa.string())], names=["vec_id", "label", "v", "block"])

    return _alike(anchors, partitions).mapInArrow(run, "vec_id long, label long, v array<long>, block string")


def _packed(requests: DataFrame) -> DataFrame:
    """``block`` and ``asks``, the requests of its anchors: at most :data:`BLOCK` rows, each with the windows of one anchor."""
    return requests.groupBy("block").agg(F.collect_list(F.struct("vec_id", "label", "v", "windows")).alias("asks"))


def _asks(asks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, dict]:
    """Anchors' ids, labels and vectors, and of each window its anchor's place, key and limits."""
    rows = asks.flatten()
    windows = rows.field("windows")
    flat = windows.flatten()
    owner = np.repeat(np.arange(len(rows)), np.diff(windows.offsets.to_numpy()))
    limits = {k: flat.field(k).to_numpy(zero_copy_only=False) for k in ("key", "low", "high")}
    return rows.field("vec_id").to_numpy(), rows.field("label").to_numpy(), matrix(rows.field("v")), limits | {"owner": owner}


def plan_visits(packed: DataFrame, heads: DataFrame, same: bool, best_only: bool) -> DataFrame:
    """``block, tree`` of the trees that a block must see: those of its anchors' labels (``same``) or of others whose root's bounds meet a window. ``best_only``: for each anchor the tree with the highest bound.

    Roots are looked at in groups of about :data:`HEADS`, so neither side meets in one task.
    """
    groups = max(1, -(-heads.count() // HEADS))
    grouped = heads.withColumn("part", F.pmod(F.xxhash64("tree"), F.lit(groups)).cast("int")).groupBy("part").agg(F.collect_list(F.struct("tree", "label", "root", "norm", "root_angle")).alias("heads"))
    dealt = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def run(batches):
        for batch in batches:
            blocks, trees = [], []
            for i in range(batch.num_rows):
                ids, labels, q, w = _asks(batch.column("asks").slice(i, 1))
                heads = batch.column("heads").slice(i, 1).flatten()
                upper, lower = _bounds(q, lengths(q), matrix(heads.field("root")), heads.field("norm").to_numpy(), heads.field("root_angle").to_numpy())
                fits = (labels[:, None] == heads.field("label").to_numpy()[None]) == same
                owner = w["owner"]
                meets = (upper[owner] >= w["low"][:, None]) & (lower[owner] <= w["high"][:, None]) & fits[owner]
                if best_only:
                    score = np.where(meets, upper[owner], -np.inf)
                    meets &= (score == score.max(1, keepdims=True, initial=-np.inf)) & np.isfinite(score)
                for c in np.flatnonzero(meets.any(0)):
                    blocks.append(batch.column("block")[i].as_py())
                    trees.append(heads.field("tree")[int(c)].as_py())
            if blocks:
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(trees, pa.string())], names=["block", "tree"])

    return dealt.join(grouped, "part").select("block", "asks", "heads").mapInArrow(run, "block string, tree string")


def visit(packed: DataFrame, visits: DataFrame, trees: DataFrame, k: int, same: bool) -> DataFrame:
    """``anchor_id, key, id, score``: the best ``k`` of each window in each tree of its own label (``same``) or of another that its block visits."""
    own = trees.drop("root", "root_angle")
    pairs = visits.join(packed, "block").join(own, "tree").drop("block", "tree")

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for i in range(batch.num_rows):
                value = lambda c, i=i: batch.column(c)[i].as_py()
                ids, labels, q, w = _asks(batch.column("asks").slice(i, 1))
                mine = (labels[w["owner"]] == value("label")) == same
                w = {c: x[mine] for c, x in w.items()}
                tree = {c: np.frombuffer(value(c), np.float64 if c == "angles" else np.int64) for c in ("ids", "middles", "angles", "firsts", "counts", "starts", "stops")}
                tree |= {"norm": value("norm"), "x": np.frombuffer(value("vectors"), np.dtype(value("kind"))).reshape(len(tree["ids"]), value("dim"))}
                r, found, score = search(tree, q, w["owner"], w["low"], w["high"], k, ids[w["owner"]])
                out.append((ids[w["owner"][r]], w["key"][r], found, score.astype(np.int64)))
            columns = [pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "key", "id", "score"])

    return pairs.mapInArrow(run, "anchor_id long, key long, id long, score long")


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "key").orderBy(F.col("score").desc(), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine_hard_negatives(rows: DataFrame, is_anchor, keep, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """For rows of :func:`comparable` and each anchor with each of its best ``positives`` other rows of its label: the best ``negatives`` rows of other labels
    whose score is between ``least`` and ``most`` per cent of the positive's: ``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    Higher scores come first, then smaller ids; fewer where there are fewer. Exact: bounds skip only what can't be in the result. Inner products of 2^53 and more
    raise. ``keep(df, name)`` writes a table in the shared folder and reads it back. An empty table gives an empty table.
    """
    rows = keep(rows, "vectors")
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = rows.count()
    trees = keep(plant_trees(rows, max(1, min(width, n // 256 + 1), n // TREE + 1)), "trees")
    heads = trees.select("tree", "label", "root", "norm", "root_angle")
    chosen = rows.where(is_anchor)
    anchors = keep(block_anchors(chosen, chosen.count() // BLOCK + 1), "anchors")

    def windows(low, high):
        return F.struct(F.lit(0).cast("long").alias("key"), low.cast("double").alias("low"), F.lit(high).cast("double").alias("high"))

    # positives: a first threshold from each anchor's most promising tree, then whatever may hold better ones
    asks = _packed(anchors.withColumn("windows", F.array(windows(F.lit("-Infinity"), float("inf")))))
    seeds = keep(plan_visits(asks, heads, same=True, best_only=True).distinct(), "seeds")
    seeded = keep(_best(visit(asks, seeds, trees, positives, True), positives).drop("rank"), "seeded")
    floors = seeded.groupBy("anchor_id").agg(F.count("*").alias("n"), F.min("score").alias("low")).where(F.col("n") == positives).select(F.col("anchor_id").alias("vec_id"), "low")
    asks = keep(_packed(anchors.join(floors, "vec_id", "left").withColumn("windows", F.array(windows(F.coalesce(F.col("low").cast("double"), F.lit(float("-inf"))), float("inf"))))), "asks")
    rest = plan_visits(asks, heads, same=True, best_only=False).join(seeds, ["block", "tree"], "left_anti")
    own = keep(_best(seeded.unionByName(visit(asks, rest, trees, positives, True)), positives).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    # negatives: one window for each positive
    limits = F.struct(F.col("positive_id").alias("key"), F.ceil(F.col("positive_score") * least / F.lit(100)).cast("double").alias("low"), F.floor(F.col("positive_score") * most / F.lit(100)).cast("double").alias("high"))
    asked = own.where(F.col("positive_score") * least <= F.col("positive_score") * most).groupBy(F.col("anchor_id").alias("vec_id")).agg(F.collect_list(limits).alias("windows"))
    asks = keep(_packed(anchors.join(asked, "vec_id")), "windows")
    hits = _best(visit(asks, plan_visits(asks, heads, same=False, best_only=False), trees, negatives, False), negatives)
    hits = hits.select("anchor_id", F.col("key").alias("positive_id"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return hits.join(own, ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL for the digest of ``embeddings``.
NEGATIVES_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::double)) AS v
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND label IS NOT NULL AND vec_id IS NOT NULL
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS id, a.label = r.label AS same, list_inner_product(a.v, r.v)::bigint AS score FROM rows a JOIN rows r ON a.vec_id % 50 = 0 AND r.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id)::int AS rank, id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3"""
