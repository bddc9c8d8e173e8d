"""Journals, messages, jobs and money."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def visible_messages(messages: DataFrame, viewer: str | None, everything: bool = False, since: int = 0, limit: int | None = None) -> DataFrame:
    """Messages that ``viewer`` may read, after ``since``, in order. ``audience`` is an array.

    With ``everything`` (owner, audit) all; else the author's own, those visible to the room, and narrower ones whose audience names the viewer or
    the room. Without a viewer only those of the room.
    """
    room = F.col("visibility") == "room"
    if everything:
        may = F.lit(True)
    elif not viewer:
        may = room
    else:
        may = room | (F.col("author_id") == viewer) | F.array_contains("audience", viewer) | F.array_contains("audience", "room")
    out = messages.where((F.col("seq") > since) & may).orderBy("seq")
    return out if limit is None else out.limit(limit)


def undone_ids(journal: DataFrame) -> DataFrame:
    """``id`` and ``undone_at`` of what a later successful undo names."""
    undo = journal.where("kind = 'undo' AND ok AND undoes IS NOT NULL").groupBy(F.col("undoes").alias("id")).agg(F.max("seq").alias("undone_at"))
    return journal.select("id", "seq").join(undo, "id").where("undone_at > seq").select("id", "undone_at")


def journal_view(journal: DataFrame, session: int | None = None, kind: str | None = None, since=None, limit: int = 100) -> DataFrame:
    """The last ``limit`` lines that match, with ``undone`` for writes that were undone."""
    rows = journal.join(undone_ids(journal), "id", "left").withColumn("undone", (F.col("kind") == "write") & F.col("undone_at").isNotNull()).drop("undone_at")
    for name, value in (("session", session), ("kind", kind)):
        rows = rows if value is None else rows.where(F.col(name) == value)
    rows = rows if since is None else rows.where(F.col("ts") >= F.lit(since))
    return rows.orderBy(F.desc("seq")).limit(limit)


def undo_plan(journal: DataFrame, session: int) -> DataFrame:
    """Successful writes of a session that aren't undone, newest first (``step``); ``conflict`` where a later live write of another session is on the same object."""
    live = journal.where("kind = 'write' AND ok").join(undone_ids(journal), "id", "left_anti")
    own = live.where(F.col("session") == session)
    others = live.where(F.col("session") != session).groupBy("object").agg(F.max("seq").alias("latest"))
    out = own.join(others, "object", "left").withColumn("conflict", F.coalesce(F.col("latest") > F.col("seq"), F.lit(False)))
    return out.withColumn("step", F.row_number().over(Window.orderBy(F.desc("seq")))).select("step", "seq", "id", "object", "conflict")  # rows of one session


def latest_revisions(rows: DataFrame, key: str, order: list[Column], n: int = 1) -> DataFrame:
    """The last ``n`` rows of each key, with ``revision`` (1: the latest)."""
    return rows.withColumn("revision", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("revision") <= n)


def ledger_stats(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """``name, state, n`` for each table and the values of its state column."""
    out = None
    for name, (rows, state) in tables.items():
        part = rows.groupBy(F.col(state).cast("string").alias("state")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "state", "n")
        out = part if out is None else out.unionAll(part)
    return out


def scan_progress(events: DataFrame) -> DataFrame:
    """For each root: files, those done, seconds from the first to the last event, done a second, and the seconds that are left (null until a rate can be measured)."""
    per = events.groupBy("root_id").agg(F.count("*").alias("total"), F.count_if(F.col("done")).alias("done"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("us"))
    rate = F.when((F.col("us") > 0) & (F.col("done") > 0), F.col("done") * 1e6 / F.col("us"))
    return per.select("root_id", "total", "done", F.round(rate, 9).alias("rate"), F.round((F.col("total") - F.col("done")) / rate, 3).alias("eta"))


def compare_runs(metrics: DataFrame) -> DataFrame:
    """Each run beside the one before it of the same build: ``metrics`` has ``build, run`` (an order) and metric columns; adds ``d_<metric>``, null for the first."""
    order = Window.partitionBy("build").orderBy("run")
    for c in [c for c in metrics.columns if c not in ("build", "run")]:
        metrics = metrics.withColumn(f"d_{c}", F.col(c) - F.lag(c).over(order))
    return metrics


def net_balances(tx: DataFrame) -> DataFrame:
    """Cents that each member of a group is owed (over 0) or owes."""
    paid = tx.select("grp", F.col("payer").alias("member"), F.col("cents").alias("c"))
    got = tx.select("grp", F.col("payee").alias("member"), (-F.col("cents")).alias("c"))
    return paid.unionAll(got).groupBy("grp", "member").agg(F.sum("c").alias("net"))


def balanced_parts(cents: list[int]) -> list[int]:
    """A number for each balance: as many parts as can be, each of which adds up to nothing. For few balances, as all their subsets are weighed."""
    n = len(cents)
    masks = np.arange(1 << n)
    bits = masks[:, None] >> np.arange(n) & 1
    level, free = bits.sum(1), bits @ np.array(cents, np.int64) == 0
    parts, last = np.zeros(1 << n, np.int64), np.zeros(1 << n, np.int64)
    for size in range(1, n + 1):  # of a subset's orders of joining, one that passes through most balanced subsets
        own = masks[level == size]
        before = np.where(bits[own] == 1, parts[own[:, None] ^ (1 << np.arange(n))], -1)
        last[own] = before.argmax(1)
        parts[own] = before.max(1) + free[own]
    out, mask = [0] * n, (1 << n) - 1
    while mask:
        out[last[mask]] = int(parts[mask] - free[mask])
        mask ^= 1 << int(last[mask])
    return out


def settle_groups(net: DataFrame, few: int = 16) -> DataFrame:
    """Transfers that settle each group. Groups of up to ``few`` members with a balance are parted into as many balanced parts as can be, so they need the fewest transfers: one less
    than members, for each part. In a part, or a larger group, debts and claims in order of size (ties by member) are laid end to end; where two stretches overlap, that much changes hands.

    Running sums and a join on what overlaps, so no group has to fit in a task's memory; a group of n members needs fewer than n transfers.
    """
    open_ = net.where("net <> 0").select("grp", "member", "net")
    small = open_.join(open_.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") <= few), "grp").groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("member", "net"))).alias("own"))

    def part(batches):
        for batch in batches:
            members, cents = (batch.column("own").flatten().field(c) for c in ("member", "net"))
            sizes = pc.list_value_length(batch.column("own")).to_pylist()
            at, found = 0, []
            values = cents.to_pylist()
            for n in sizes:
                found += balanced_parts(values[at : at + n])
                at += n
            yield pa.RecordBatch.from_arrays([batch.column("grp").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), members, pa.array(found, pa.int64())], names=["grp", "member", "part"])

    parts = small.mapInArrow(part, T.StructType([open_.schema["grp"], open_.schema["member"], T.StructField("part", T.LongType())]))
    own = Window.partitionBy("grp", "part", "side").orderBy(F.desc("size"), "member").rowsBetween(Window.unboundedPreceding, 0)
    rows = open_.join(parts, ["grp", "member"], "left").select("grp", F.coalesce("part", F.lit(0)).alias("part"), "member", (F.col("net") > 0).alias("side"), F.abs("net").alias("size")).withColumn("to", F.sum("size").over(own)).withColumn("from", F.col("to") - F.col("size"))
    debt = rows.where("not side").select("grp", "part", F.col("member").alias("debtor"), F.col("from").alias("a"), F.col("to").alias("b"))
    claim = rows.where("side").select("grp", "part", F.col("member").alias("creditor"), F.col("from").alias("c"), F.col("to").alias("d"))
    both = debt.join(claim, ["grp", "part"]).where("a < d AND c < b")
    return both.select("grp", "debtor", "creditor", (F.least("b", "d") - F.greatest("a", "c")).alias("cents"))


def allocate_cents(rows: DataFrame, group: str, total: str, weight: str, order: list[str]) -> DataFrame:
    """Adds ``share``: whole cents of the group's total by weight, the rest to the largest remainders (ties by ``order``), so shares sum to the total.

    Exact: weights are decimals of up to six places. A weight of zero, or under, gets nothing, a negative total is split like its size; where no weight is over zero, shares are null.
    """
    own = Window.partitionBy(group)
    cents = F.abs(F.col(total)).cast("decimal(18,0)")
    w = F.greatest(F.col(weight).cast("decimal(18,6)"), F.lit(0).cast("decimal(18,6)"))
    rows = rows.withColumn("_w", w).withColumn("_all", F.nullif(F.sum("_w").over(own), F.lit(0))).withColumn("_parts", cents * F.col("_w"))
    rows = rows.withColumn("_whole", F.expr("_parts div _all")).withColumn("_rest", F.col("_parts") % F.col("_all"))
    rows = rows.withColumn("_left", cents - F.sum("_whole").over(own)).withColumn("_rank", F.row_number().over(own.orderBy((F.col("_w") > 0).desc(), F.desc("_rest"), *order)))
    share = F.signum(F.col(total)).cast("long") * (F.col("_whole") + ((F.col("_rank") <= F.col("_left")) & (F.col("_w") > 0)).cast("long"))
    return rows.withColumn("share", share).drop("_w", "_all", "_parts", "_whole", "_rest", "_left", "_rank")
