"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Each document of source ``s`` gets the rate ``min(most, exp(lambda_s * size / mean size))``: of all rates from 0 to ``most`` that
give the source its target of words, these are closest to 1 in relative entropy. ``lambda_s`` solves the convex dual, one
equation for each source. A rate depends on a document's source and size alone, so the counts of documents by source and
size say all that Newton's iterations need: every iteration is one join and one sum over that table, for all sources at once.
Sums are exact (fixed point), so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.plans.shared import Scratch, materialize, scratch

WORDS = r"[^\x20\x09-\x0D]+"
_FIXED = 1024.0  # sums hold 1/1024 words


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("long")


def _source_key(source: Column) -> Column:
    """Sorts as the source does by code point, null last, and is never null."""
    return F.concat(F.when(source.isNull(), "1").otherwise("0"), F.coalesce(source.cast("string"), F.lit("")))


def source_targets(counts: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """For each source key ``_key`` of the table of sizes and how many documents have them: ``source_size``, ``target``, ``mean`` and ``least`` (size over 0). The windows hold a row for each source.

    A target stops at ``most`` times the source's size. With sources in order of size over weight, those that stop come first,
    so the level of the others follows from running sums.
    """
    by = counts.groupBy("_key").agg(F.sum(F.col("_size") * F.col("_n")).alias("source_size"), (F.sum(F.col("_size") * F.col("_n")) / F.sum("_n")).alias("mean"), F.min(F.when(F.col("_size") > 0, F.col("_size"))).alias("least"))
    order = Window.orderBy("_key")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))).cast("int") + 1)
    by = by.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    rising = Window.orderBy(F.col("cap") / F.col("weight"), "_key")
    before, whole = rising.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", left / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    by = by.withColumn("stops", F.min((F.col("cap") / F.col("weight") <= F.col("level")).cast("int")).over(rising.rowsBetween(Window.unboundedPreceding, 0)) == 1)
    level = F.max(F.struct((~F.col("stops")).alias("free"), (-F.row_number().over(rising)).alias("at"), "level")).over(whole)["level"]
    by = by.withColumn("rest", level).withColumn("target", F.when(F.col("stops"), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("rest"), F.col("cap"))))
    return by.select("_key", "source_size", "target", "mean", "least")


def _solve(counts: DataFrame, targets: DataFrame, most: float, rounds: int, own: Scratch) -> DataFrame:
    """``lam`` for each source: Newton's iteration, kept inside a bracket that each step narrows, until every source is within a word or a ten thousandth of its target.

    A source whose target is all that it can give starts, and ends, at the upper end of its bracket. Raises RuntimeError if ``rounds`` don't suffice.
    """
    wide = F.col("mean") / F.col("least")
    top = F.log(F.lit(most)) * wide
    start = F.when(F.col("target") >= most * F.col("source_size"), top).otherwise(F.lit(0.0))
    state = targets.where("source_size > 0").select("_key", "target", "mean", start.alias("lam"), (-60 * wide).alias("lo"), top.alias("hi"))
    z, e = F.col("_size") / F.col("mean"), F.exp(F.least(F.col("lam") * F.col("_size") / F.col("mean"), F.lit(50.0)))
    fixed = lambda x: F.sum(F.round(x * _FIXED).cast("decimal(28,0)")).cast("double") / _FIXED
    for k in range(rounds):
        words = F.col("_n") * F.col("_size")
        sums = counts.join(state, "_key").groupBy("_key", "target", "mean", "lam", "lo", "hi").agg(
            (fixed(words * F.least(e, F.lit(most))) - F.col("target")).alias("over"), fixed(F.when(e < most, words * z * e).otherwise(0.0)).alias("slope")
        )
        near = F.abs("over") <= F.greatest(F.lit(1.0), F.col("target") * 1e-4)
        lo, hi = F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo")), F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi"))
        step = F.when(F.col("slope") > 0, F.col("lam") - F.col("over") / F.col("slope"))
        state = sums.select("_key", "target", "mean", lo.alias("lo"), hi.alias("hi"), near.alias("near"), F.when(near, F.col("lam")).when((step > lo) & (step < hi), step).otherwise((lo + hi) / 2).alias("lam"))
        if k % 3 == 2 or k + 1 == rounds:
            state = own.keep(state, "state")
            if state.where("not near").limit(1).count() == 0:
                return state.select("_key", "lam")
    raise RuntimeError(f"rates of some sources still miss their targets after {rounds} rounds")


def _running(cells: DataFrame, value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all larger sizes of the cell's source. Ranges of 256 sizes are summed first, so a task has the sizes of a range, or the ranges of a source."""
    cells = cells.withColumn("_range", F.floor(F.col("_size") / 256)).withColumn(name, value)
    inner = Window.partitionBy("_key", "_range").orderBy(F.col("_size").desc()).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy("_key").orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    ranges = cells.groupBy("_key", "_range").agg(F.sum(name).alias("_all")).select("_key", "_range", F.coalesce(F.sum("_all").over(outer), F.lit(0)).alias("_larger"))
    within = cells.withColumn(name, F.coalesce(F.sum(name).over(inner), F.lit(0)))
    return within.join(ranges, ["_key", "_range"]).withColumn(name, F.col(name) + F.col("_larger")).drop("_range", "_larger")


def _copies(cells: DataFrame, most: float, own: Scratch) -> DataFrame:
    """``_copies`` for each cell, all documents of a source and a size. Rates are summed up from the largest size down, and a cell gets the whole copies that fall to it, which
    leaves a source off by less than a document. Cells that are no larger than what it is off make up for that, three times."""
    want = F.col("_n") * F.col("rate")
    cells = _running(cells, F.round(want * _FIXED**2).cast("decimal(38,0)"), "_up_to").withColumn("_up_to", F.col("_up_to").cast("double") / _FIXED**2)
    copies = F.floor(F.col("_up_to") + want + 0.5) - F.floor(F.col("_up_to") + 0.5)
    cells = own.keep(cells.withColumn("_copies", F.greatest(F.lit(0), F.least(copies, F.col("_n") * int(most)))).drop("_up_to"), "copies")
    for _ in range(3):
        off = cells.groupBy("_key", "target").agg(F.sum(F.col("_copies") * F.col("_size")).alias("_given")).select("_key", F.floor(F.col("target") - F.col("_given") + 0.5).alias("_off"))
        room = F.when((F.col("_size") == 0) | (F.col("_size") > F.abs("_off")), 0).when(F.col("_off") > 0, F.col("_n") * int(most) - F.col("_copies")).otherwise(F.col("_copies"))
        cells = _running(cells.join(off, "_key").withColumn("_room", room), F.col("_room") * F.col("_size"), "_before")
        take = F.greatest(F.lit(0), F.least(F.col("_room"), F.floor((F.abs("_off") - F.col("_before")) / F.greatest(F.col("_size"), F.lit(1)))))
        cells = own.keep(cells.withColumn("_copies", F.col("_copies") + F.signum("_off").cast("long") * take).drop("_off", "_room", "_before"), "copies")
    return cells


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: int = 3, doc_id: str = "doc_id", source: str = "source", text: str = "text", slim: bool = False, rounds: int = 60, spread: int = 64) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken`` (words, repeats counted) to each document.

    Sources by code point, null last, weigh ``weights`` in turn and share all words; a target stops at ``most`` times its source.
    Each source's taken words come within a document of its target, no document is taken more than ``most`` times, and reruns
    agree. Null and empty texts have size 0 and follow their rate. Equal rows are told apart by nothing, so which of them is
    taken once more is open, but the result has the same rows. ``slim`` keeps only doc_id and source of the input. Input columns
    with an added name are replaced. ``spread`` parts the documents of one source and size, so none of their tasks gets them all.
    """
    added = ["size", "source_size", "target", "rate", "copies", "taken"]
    named = [F.col(f"`{c}`") for c in ([doc_id, source] if slim else docs.columns) if c.lower() not in added]
    salt = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(spread))
    rows = docs.select(*named, word_count(F.col(text)).alias("_size"), _source_key(F.col(source)).alias("_key"), salt.alias("_salt"))
    sizes = materialize(rows.select(*([doc_id, source] if slim else []), "_size", "_key", "_salt"), "sizes")
    rows = sizes if slim else rows
    with scratch(docs.sparkSession, "mix") as own:
        parts = own.keep(sizes.groupBy("_key", "_size", "_salt").agg(F.count("*").alias("_n")), "parts")
        counts = own.keep(parts.groupBy("_key", "_size").agg(F.sum("_n").alias("_n")), "counts")
        targets = own.keep(source_targets(counts, weights, float(most)), "targets")
        lam = _solve(counts, targets, float(most), rounds, own)
        rate = F.coalesce(F.least(F.exp(F.least(F.col("lam") * F.col("_size") / F.col("mean"), F.lit(50.0))), F.lit(float(most))), F.lit(1.0))
        cells = _copies(counts.join(targets.join(lam, "_key", "left"), "_key").withColumn("rate", rate), float(most), own)
        # the copies of a cell, dealt to its parts: what all documents get, and one more for the first ones
        first = Window.partitionBy("_key", "_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
        before = parts.withColumn("_first", F.coalesce(F.sum("_n").over(first), F.lit(0))).drop("_n")
        cells = cells.select("_key", "_size", "rate", "source_size", "target", F.floor(F.col("_copies") / F.col("_n")).alias("_each"), (F.col("_copies") % F.col("_n")).alias("_more"))
        cells = materialize(before.join(cells, ["_key", "_size"]), "cells")
    order = Window.partitionBy("_key", "_size", "_salt").orderBy(F.xxhash64(F.col(doc_id)), F.col(doc_id))
    out = rows.join(cells, ["_key", "_size", "_salt"]).withColumn("_rank", F.row_number().over(order))
    copies = (F.col("_each") + (F.col("_first") + F.col("_rank") <= F.col("_more")).cast("long")).cast("int")
    return out.select(*named, F.col("_size").alias("size"), "source_size", "target", "rate", copies.alias("copies"), (copies * F.col("_size")).cast("long").alias("taken"))
