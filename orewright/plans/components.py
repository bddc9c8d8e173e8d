"""Connected components of a graph of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orewright.plans.shared import materialize, scratch

#: The links of a node are dealt to so many parts.
PARTS = 128


def _with_least(links: DataFrame) -> DataFrame:
    """``links`` with ``m``, the least ``v`` of each ``u``. Each part of a node's links finds its own least and gets that of all parts back, so no task has more than a part of a node."""
    dealt = links.withColumn("part", F.pmod(F.xxhash64("v", "u"), F.lit(PARTS)))
    parts = dealt.groupBy("u", "part").agg(F.min("v").alias("m"))
    least = parts.select("u", "part").join(parts.groupBy("u").agg(F.min("m").alias("m")), "u")
    return dealt.join(least, ["u", "part"]).select("u", "v", "m")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``node`` and ``label`` (the least node of its component) for each node of a link; loops and nulls name nodes but link nothing.

    Each round ties every neighbour of a node to the least of them, once for the larger neighbours and once for the smaller
    ones, so long chains shorten by a constant factor and stars settle at once. The links of a node with very many are dealt to :data:`PARTS` parts.
    Rounds are written to the shared folder, where only the last one and the result stay; the loop ends when one changes no link.
    """
    named = links.select(F.col(a).alias("u"), F.col(b).alias("v"))
    nodes = named.select("u").unionAll(named.select("v")).where("u is not null").distinct()
    with scratch(links.sparkSession, "components") as own:
        edges = own.keep(named.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
        before = None
        for _ in range(most_rounds):
            both = _with_least(edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))).withColumn("m", F.least("m", "u"))
            large = own.keep(both.where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
            small = _with_least(large)
            # u goes to its least neighbour, and so do its other neighbours
            edges = own.keep(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "links")
            now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
            if now == before:
                labels = edges.groupBy("u").agg(F.min("v").alias("label"))
                return materialize(nodes.join(labels, "u", "left").select(F.col("u").alias("node"), F.coalesce("label", "u").alias("label")), "labels")
            before = now
    raise RuntimeError(f"links still change after {most_rounds} rounds")
