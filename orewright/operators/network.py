"""Road networks and the choice of service sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators import polygons as poly
from orewright.plans.shared import materialize


def build_network(lines: DataFrame, default_kmh: float = 50.0) -> DataFrame:
    """``src, dst, seconds``: both directions of lines ``a, b, length_m, speed_kmh, oneway``, the fastest of parallel edges."""
    seconds = F.col("length_m") / (F.coalesce(F.nullif("speed_kmh", F.lit(0)), F.lit(default_kmh)) / 3.6)
    forth = lines.select(F.col("a").alias("src"), F.col("b").alias("dst"), seconds.alias("seconds"))
    back = lines.where(~F.coalesce("oneway", F.lit(False))).select(F.col("b").alias("src"), F.col("a").alias("dst"), seconds.alias("seconds"))
    return forth.unionAll(back).where("src <> dst").groupBy("src", "dst").agg(F.min("seconds").alias("seconds"))


def network_of_lines(lines: DataFrame, obstacles: DataFrame | None = None, snap_m: float = 0.5, default_kmh: float = 50.0, reach_m: float = 2000.0) -> tuple[DataFrame, DataFrame]:
    """``src, dst, seconds`` and nodes ``node, x, y`` of straight lines (``id, x0, y0, x1, y1, travel_time_s, speed_kmh, oneway, bridge``).

    Ends that round to one cell of ``snap_m`` are one node, which lies at the least of them. ``oneway`` is ``yes``, ``reverse`` or no (null too). A line that crosses an obstacle (``ring``) is
    left out, but for bridges and tunnels. Lines up to ``reach_m`` long meet obstacles by buckets. Lines without length, or whose ends are one node, are left out.
    """
    cell = lambda c: F.floor(F.col(c) / snap_m + 0.5).cast("long")
    length = F.sqrt((F.col("x1") - F.col("x0")) ** 2 + (F.col("y1") - F.col("y0")) ** 2)
    rows = lines.withColumn("length_m", length).where("length_m > 0")
    if obstacles is not None:
        near = poly.with_rings(obstacles).select(F.col("ring"), F.col("x0").alias("ox0"), F.col("y0").alias("oy0"), F.col("x1").alias("ox1"), F.col("y1").alias("oy1"))
        bucket = lambda c: F.floor(F.col(c) / reach_m)
        near = near.withColumn("i", F.explode(F.sequence(bucket("ox0"), bucket("ox1")))).withColumn("j", F.explode(F.sequence(bucket("oy0"), bucket("oy1"))))
        low = lambda f, c: F.floor(f(f"{c}0", f"{c}1") / reach_m)
        own = rows.where(~F.coalesce("bridge", F.lit(False))).withColumn("i", F.explode(F.sequence(low(F.least, "x"), low(F.greatest, "x")))).withColumn("j", F.explode(F.sequence(low(F.least, "y"), low(F.greatest, "y"))))
        met = own.join(near, ["i", "j"]).where(poly.crosses_inside(F.col("ring"), *[F.col(c) for c in ("x0", "y0", "x1", "y1")]))
        rows = rows.join(met.select("id").distinct(), "id", "left_anti")
    seconds = F.when(F.col("travel_time_s") > 0, F.col("travel_time_s")).otherwise(F.col("length_m") / (F.when(F.col("speed_kmh") > 0, F.col("speed_kmh")).otherwise(default_kmh) / 3.6))
    end = lambda k: F.struct(cell(f"x{k}").alias("i"), cell(f"y{k}").alias("j"))
    rows = rows.select(end(0).alias("a"), end(1).alias("b"), F.lower(F.coalesce(F.col("oneway").cast("string"), F.lit("no"))).alias("oneway"), seconds.alias("seconds"), *[f"{c}{k}" for c in "xy" for k in (0, 1)])
    nodes = rows.select(F.col("a").alias("k"), F.col("x0").alias("x"), F.col("y0").alias("y")).unionAll(rows.select("b", "x1", "y1")).groupBy("k").agg(F.min(F.struct("x", "y")).alias("p"))
    name = lambda c: F.concat_ws(",", F.col(f"{c}.i"), F.col(f"{c}.j"))
    rows = rows.where("a <> b")
    forth = rows.where("oneway NOT IN ('reverse', '-1')").select(name("a").alias("src"), name("b").alias("dst"), "seconds")
    back = rows.where("oneway NOT IN ('yes', 'true', '1')").select(name("b").alias("src"), name("a").alias("dst"), "seconds")
    return forth.unionAll(back).groupBy("src", "dst").agg(F.min("seconds").alias("seconds")), nodes.select(name("k").alias("node"), "p.x", "p.y")


def reach_nodes(edges: DataFrame, starts: DataFrame, most_s: float, most_rounds: int = 10_000) -> DataFrame:
    """``site, node, seconds`` and ``prior`` (the node before it on a shortest path): every node within ``most_s`` of each start (``site, node, seconds``).

    The frontier, the nodes whose time fell in the last round, is relaxed by one join a round; what is over the limit is cut at once. Rounds are
    written to the shared folder.
    """
    known = materialize(starts.where(F.col("seconds") <= most_s).groupBy("site", "node").agg(F.min("seconds").alias("seconds")).withColumn("prior", F.lit(None).cast("long")), "reach")
    frontier = known
    for _ in range(most_rounds):
        step = frontier.select("site", F.col("node").alias("src"), F.col("seconds").alias("s0")).join(edges, "src").withColumn("seconds", F.col("s0") + F.col("seconds")).where(F.col("seconds") <= most_s)
        best = step.groupBy("site", F.col("dst").alias("node")).agg(F.min(F.struct("seconds", F.col("src").cast("long").alias("prior"))).alias("m")).select("site", "node", "m.seconds", "m.prior")
        both = known.withColumn("old", F.lit(True)).unionByName(best.withColumn("old", F.lit(False)))
        merged = both.groupBy("site", "node").agg(F.min(F.struct("seconds", (~F.col("old")).alias("fresh"), "prior")).alias("m"))
        merged = materialize(merged.select("site", "node", "m.seconds", "m.prior", "m.fresh"), "reach")
        known, frontier = merged.drop("fresh"), merged.where("fresh").drop("fresh")
        if frontier.limit(1).count() == 0:
            return known
    raise RuntimeError("times still fall")


def reach_network(edges: DataFrame, sites: DataFrame, demand: DataFrame, most_s: float) -> DataFrame:
    """``site, demand, cost``: access of the site, shortest path and access of the demand within ``most_s``. Both have ``id, node, access_s``."""
    nodes = reach_nodes(edges, sites.where("node is not null").select(F.col("id").alias("site"), "node", F.col("access_s").alias("seconds")), most_s)
    found = demand.where("node is not null").select(F.col("id").alias("demand"), "node", "access_s").join(nodes, "node").withColumn("cost", F.col("seconds") + F.col("access_s"))
    return found.where(F.col("cost") <= most_s).select("site", "demand", "cost")


def assign(reach: DataFrame, chosen: DataFrame) -> DataFrame:
    """Each demand to its cheapest chosen site (``site, order``), ties to the first listed."""
    return reach.join(chosen, "site").groupBy("demand").agg(F.min(F.struct(F.round("cost", 9).alias("cost"), "order", "site")).alias("m")).select("demand", "m.site", "m.cost")


def _greedy(reach: DataFrame, weights: DataFrame, costs: DataFrame | None, stop, most: int) -> DataFrame:
    spark = reach.sparkSession
    left = materialize(reach.select("site", "demand").distinct().join(weights, "demand"), "left")
    chosen, served = [], 0.0
    while len(chosen) < most and not stop(served):
        gain = left.groupBy("site").agg(F.round(F.sum("weight"), 6).alias("gain"))
        if costs is not None:
            gain = gain.join(costs, "site").withColumn("score", F.round(F.col("gain") / F.col("cost"), 9))
        best = gain.orderBy(F.desc("score" if costs is not None else "gain"), "site").first()
        if best is None or best["gain"] <= 0:
            break
        served += best["gain"]
        chosen.append((len(chosen) + 1, best["site"], best["gain"], served))
        left = materialize(left.join(left.where(F.col("site") == best["site"]).select("demand"), "demand", "left_anti"), "left")
    return spark.createDataFrame(chosen, "step int, site long, gain double, served double")


def max_coverage(reach: DataFrame, weights: DataFrame, k: int) -> DataFrame:
    """Greedy choice of ``k`` sites: each round takes the site with most weight not yet served (ties to the lower id) and stops at no gain. A heuristic; the coverable weight bounds it. One row a chosen site reaches the driver."""
    return _greedy(reach, weights, None, lambda served: False, k)


def min_sites(reach: DataFrame, weights: DataFrame, costs: DataFrame, share: float) -> DataFrame:
    """Greedy choice of sites by gain over cost (``site, cost``; at least a thousand-millionth) until ``share`` of all weight is served; a share that all sites together don't reach is refused with the one that they do."""
    total = weights.agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    within = weights.join(reach.join(costs, "site").select("demand").distinct(), "demand", "left_semi").agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
    if share * total > within + 1e-9:
        raise ValueError(f"all sites together serve {100 * within / total:.3f} % of the weight; {100 * share:.3f} % were asked for")
    least = costs.withColumn("cost", F.greatest(F.col("cost").cast("double"), F.lit(1e-9)))
    return _greedy(reach, weights, least, lambda served: served >= share * total - 1e-9, 1_000_000)


def unserved_reasons(demand: DataFrame, reach: DataFrame, chosen: DataFrame, wide: DataFrame | None = None) -> DataFrame:
    """Why a demand (``id, node``) isn't served by the chosen sites (``site``), and the ``minutes`` to the nearest of them, where ``wide``, a reach of a larger limit, knows it.

    No node near it, a chosen site that is too far, another site that would reach it, or none that does.
    """
    served = reach.join(chosen.select("site"), "site", "left_semi").select(F.col("demand").alias("id")).distinct()
    possible = reach.select(F.col("demand").alias("id")).distinct().withColumn("possible", F.lit(True))
    far = (reach if wide is None else wide).join(chosen.select("site"), "site", "left_semi").groupBy(F.col("demand").alias("id")).agg((F.min("cost") / 60).alias("minutes"))
    out = demand.join(served, "id", "left_anti").join(possible, "id", "left").join(far, "id", "left")
    reason = F.when(F.col("node").isNull(), "no node near").when(F.col("minutes").isNotNull(), "too far").when(F.col("possible"), "another site would reach it").otherwise("no site reaches it")
    return out.select("id", reason.alias("reason"), "minutes")


def cross_check(reach: DataFrame, straight: DataFrame) -> DataFrame:
    """``site, straight, network``: how many demands each site (``a``) serves by straight lines (``a, b``), and how many of them or others it does over the network."""
    by_road = reach.groupBy("site").agg(F.count("*").alias("network"))
    by_air = straight.groupBy(F.col("a").alias("site")).agg(F.count("*").alias("straight"))
    return by_air.join(by_road, "site", "left").select("site", "straight", F.coalesce("network", F.lit(0)).alias("network"))


def shortest_paths(reach: DataFrame, targets: DataFrame, most_steps: int = 1000) -> DataFrame:
    """``site, target, step, node`` back from each target (``site, node``) to its site, along the nodes before each in ``reach_nodes``."""
    at = targets.select("site", F.col("node").alias("target"), F.lit(0).alias("step"), F.col("node").cast("long").alias("node"))
    out = at = materialize(at, "path")
    for step in range(1, most_steps + 1):
        at = materialize(at.join(reach.select("site", F.col("node").cast("long").alias("node"), "prior"), ["site", "node"]).where("prior is not null").select("site", "target", F.lit(step).alias("step"), F.col("prior").alias("node")), "path")
        if at.limit(1).count() == 0:
            return out
        out = out.unionByName(at)
    raise RuntimeError("a path is longer than allowed")
