"""Streams of files, pages, feeds and journals, each with the batch form that gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orewright.operators.amounts import quoted
from orewright.operators.entities import block_verdict
from orewright.operators.ledger import undone_ids
from orewright.operators.text import LINE_ENDS, page_quality, steady_sql


def watch_changes(events: DataFrame, gap: str = "2 seconds", late: str = "10 minutes") -> DataFrame:
    """``root, start, end, n``: events (``root, ts``) of a root less than ``gap`` apart are one trigger. Works on a stream (with a watermark of ``late``) and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy("root", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("root", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


_FINDING = "url string, version long, added long, removed long"


def _lines(text: str) -> set[str]:
    return {" ".join(x.split()) for x in (text or "").split("\n")} - {""}


def page_changes(checks: DataFrame) -> DataFrame:
    """``url, version, added, removed`` (numbers of lines) for each check (``url, version, ok, text``) that differs from the last good one of its page.

    The first good check is the baseline; failed ones keep the state; lines in another order are no change. State: one page's lines.
    """
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        known = set(state.get[0].split("\n")) if state.exists else None
        out = []
        for check in pd.concat(list(frames)).sort_values("version").itertuples():
            if not check.ok:
                continue
            now = _lines(check.text)
            if known is not None and now != known:
                out.append((key[0], check.version, len(now - known), len(known - now)))
            known = now
        if known is not None:
            state.update(("\n".join(sorted(known)),))
        yield pd.DataFrame(out, columns=["url", "version", "added", "removed"])

    return checks.groupBy("url").applyInPandasWithState(step, _FINDING, "lines string", "append", GroupStateTimeout.NoTimeout)


def page_changes_batch(checks: DataFrame) -> DataFrame:
    """The same on a table: each good check against the good one before it."""
    lines = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != ""))
    rows = checks.where("ok").select("url", "version", lines.alias("now")).withColumn("before", F.lag("now").over(Window.partitionBy("url").orderBy("version")))
    rows = rows.select("url", "version", F.size(F.array_except("now", "before")).cast("long").alias("added"), F.size(F.array_except("before", "now")).cast("long").alias("removed"), F.col("before").isNotNull().alias("known"))
    return rows.where("known and (added > 0 or removed > 0)").select("url", "version", "added", "removed")


_PAGE = "url string, version long, outcome string, added array<string>, removed array<string>"


def _read_checks(checks: DataFrame) -> DataFrame:
    """``url, version, why, lines``: why a check says nothing of its page, or null, and the page's lines as ``key, line`` without what passes by itself."""
    given = lambda c, kind: F.col(c) if c in checks.columns else F.lit(None).cast(kind)
    text = F.coalesce("text", F.lit(""))
    verdict = block_verdict(F.col("status"), F.coalesce(given("html", "string"), text), F.split(F.col("url"), " ")[0], F.coalesce(given("headers", "map<string,string>"), F.create_map().cast("map<string,string>")))
    rows = page_quality(checks.select("url", F.col("version").cast("long").alias("version"), text.alias("text"), "status", F.coalesce("ok", F.lit(False)).alias("ok"), verdict.alias("verdict")))
    why = (
        F.when(F.col("status") == 304, "not modified").when(~F.col("verdict").isin("ok", "http_5xx") & (F.col("text") != ""), F.concat(F.lit("blocked: "), "verdict")).when(~F.col("ok"), "failed")
        .when(F.col("quality") != "ok", F.concat(F.lit("low quality: "), "quality"))
    )
    lines = F.expr(f"filter(transform(split(text, {quoted(LINE_ENDS)}), l -> struct({steady_sql('l')} AS key, trim(l) AS line)), x -> x.key <> '')")
    return rows.select("url", "version", why.alias("why"), F.when(why.isNull(), lines).alias("lines"))


def page_findings(checks: DataFrame, most: int = 50) -> DataFrame:
    """``url, version, outcome, added, removed`` of each check (``url, version, status, ok, text``; ``html`` and ``headers`` if there are any): ``baseline`` for the first good one, ``changed`` with the first
    ``most`` lines that are new or gone since the last good one, ``same``, or why it says nothing: ``not modified``, ``blocked: ..``, ``failed``, ``low quality: ..``. Such checks keep what is known.

    Lines count by :func:`orewright.operators.text.steady_sql`, so times that pass and another order are no change. On a stream the state is one page's lines; on a table a window over a page's checks.
    """
    rows = _read_checks(checks)
    if rows.isStreaming:
        def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
            known = dict(zip(*state.get, strict=True)) if state.exists else None
            out = []
            for check in pd.concat(list(frames)).sort_values("version").itertuples():
                if check.why is not None:
                    out.append((key[0], check.version, check.why, [], []))
                    continue
                now = {}
                for k, line in zip(check.keys, check.texts, strict=True):
                    now.setdefault(k, line)
                added, removed = ([line for k, line in a.items() if k not in b][:most] for a, b in ((now, known or {}), (known or {}, now)))
                outcome = "baseline" if known is None else "changed" if added or removed else "same"
                out.append((key[0], check.version, outcome, added if known is not None else [], removed))
                known = now
            if known is not None:
                state.update((list(known), list(known.values())))
            yield pd.DataFrame(out, columns=["url", "version", "outcome", "added", "removed"])

        flat = rows.select("url", "version", "why", F.col("lines.key").alias("keys"), F.col("lines.line").alias("texts"))
        return flat.groupBy("url").applyInPandasWithState(step, _PAGE, "keys array<string>, texts array<string>", "append", GroupStateTimeout.NoTimeout)
    before = F.last("lines", ignorenulls=True).over(Window.partitionBy("url").orderBy("version").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)

    def new_in(a: str, b: str) -> str:
        return f"transform(slice(array_except({a}.key, {b}.key), 1, {most}), k -> filter({a}, x -> x.key = k)[0].line)"

    both = "why IS NULL AND before IS NOT NULL"
    rows = rows.withColumns({"added": F.expr(f"CASE WHEN {both} THEN {new_in('lines', 'before')} ELSE CAST(array() AS ARRAY<STRING>) END"), "removed": F.expr(f"CASE WHEN {both} THEN {new_in('before', 'lines')} ELSE CAST(array() AS ARRAY<STRING>) END")})
    outcome = F.coalesce("why", F.when(F.col("before").isNull(), "baseline").when((F.size("added") > 0) | (F.size("removed") > 0), "changed").otherwise("same"))
    return rows.select("url", "version", outcome.alias("outcome"), "added", "removed")


def new_feed_items(items: DataFrame, most_new: int = 20, most_seen: int = 400) -> DataFrame:
    """``feed, id``: of each check (a batch of ``feed, id, at``), ids that the feed hasn't shown; its first check only remembers. At most ``most_new`` for a check, and the newest ``most_seen`` are remembered, as feeds are read that way."""
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = list(state.get[0]) if state.exists else None
        ids = pd.concat(list(frames)).sort_values(["at", "id"], ascending=[False, True])["id"].drop_duplicates().tolist()
        fresh = [] if seen is None else [i for i in ids if i not in set(seen)][:most_new]
        state.update((list(dict.fromkeys([*ids, *(seen or [])]))[:most_seen],))
        yield pd.DataFrame({"feed": [key[0]] * len(fresh), "id": fresh})

    return items.groupBy("feed").applyInPandasWithState(step, "feed string, id string", "seen array<string>", "append", GroupStateTimeout.NoTimeout)


def live_state(observations: DataFrame, polls: DataFrame, ttl: float, most: float) -> DataFrame:
    """``key, at, value, state`` of polls (``key, at`` in seconds) by the last observation (``key, at, value``) at or before: ``fresh`` within ``ttl`` seconds, ``stale`` up to ``most``, else ``error``."""
    both = observations.select("key", "at", "value", F.col("at").alias("seen"), F.lit(0).alias("poll")).unionByName(polls.select("key", "at", F.lit(None).cast("double").alias("value"), F.lit(None).cast("double").alias("seen"), F.lit(1).alias("poll")))
    w = Window.partitionBy("key").orderBy("at", "poll").rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("last", F.last(F.when(F.col("poll") == 0, F.struct("seen", "value")), ignorenulls=True).over(w)).where("poll = 1")
    age = F.col("at") - F.col("last.seen")
    state = F.when(age <= ttl, "fresh").when(age <= most, "stale").otherwise("error")
    return rows.select("key", "at", F.when(age <= most, F.col("last.value")).alias("value"), state.alias("state"))


def _answer(hit: tuple | None, poll, ttl: float, most: float | None) -> tuple:
    """What is remembered after a poll (microseconds of the fetch, value), and the poll's answer."""
    at = poll["us"]
    if hit is not None and not poll["force"] and at - hit[0] < ttl * 1e6:
        state = "cached"
    elif poll["ok"]:
        hit, state = (at, poll["value"]), "fresh"
    else:
        state = "stale" if hit is not None and (most is None or at - hit[0] <= most * 1e6) else "error"
    return hit, {"seq": poll["seq"], "us": at, "state": state, "value": None if state == "error" else hit[1], "age": None if state == "error" else (at - hit[0]) / 1e6}


class _Answers(StatefulProcessor):
    """One key: when its value was fetched, and the value, until it's too old to be of use."""

    def __init__(self, ttl: float, most: float | None):
        self.ttl, self.most = ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hit = handle.getValueState("hit", T.StructType([T.StructField("us", T.LongType()), T.StructField("value", T.DoubleType())]))

    def _last_use(self, hit: tuple) -> int:
        """The first millisecond at which a value is of no more use."""
        return int(hit[0] / 1000 + max(self.most, self.ttl) * 1000) + 1

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        hit = tuple(self.hit.get()) if self.hit.exists() else None
        for poll in sorted(rows, key=lambda r: (r["us"], r["seq"])):
            before, (hit, answer) = hit, _answer(hit, poll, self.ttl, self.most)
            if hit != before:
                self.hit.update(hit)
                if self.most is not None:
                    self.handle.registerTimer(self._last_use(hit))
            yield Row(key=key[0], **answer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # a later fetch has a timer of its own
        if self.hit.exists() and self._last_use(tuple(self.hit.get())) <= expiredTimerInfo.getExpiryTimeInMs():
            self.hit.clear()
        return iter(())

    def close(self) -> None:
        pass


_ANSWER = "key string, seq long, us long, state string, value double, age double"
_ANSWER_ARROW = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("us", pa.int64()), ("state", pa.string()), ("value", pa.float64()), ("age", pa.float64())])


def live_answers(polls: DataFrame, ttl: float, most: float | None, late: str = "1 hour") -> DataFrame:
    """``key, seq, at, state, value, age`` of each poll (``key, seq, at, ok, value, force``: what asking the source would give then, by ``at``, then ``seq``).

    ``cached``: a value was fetched less than ``ttl`` seconds ago and the poll isn't forced, so the source isn't asked. Else ``fresh`` if it answers; if not, ``stale``
    with the last value if that is at most ``most`` seconds old (None: of any age), else ``error`` without a value. On a stream this is keyed state that a timer
    clears once the watermark (``late`` behind) passes the value's last use; it needs the RocksDB state store. On a table, rows of a key stream in order past one
    remembered value, so a key with most of all rows costs time, not memory. Null keys are one key; rows without ``at`` are left out.
    """
    at = F.col("at").cast("timestamp")
    rows = polls.where("at is not null").select(
        F.col("key").cast("string").alias("key"), F.col("seq").cast("long").alias("seq"), at.alias("at"), F.unix_micros(at).alias("us"), F.coalesce("ok", F.lit(False)).alias("ok"), F.col("value").cast("double").alias("value"), F.coalesce("force", F.lit(False)).alias("force")
    )
    if rows.isStreaming:
        answers = rows.withWatermark("at", late).groupBy("key").transformWithState(_Answers(ttl, most), _ANSWER, "Append", "EventTime")
    else:
        first = F.col("key").asc_nulls_first()

        def run(batches):
            key, hit = (), None
            for batch in batches:
                out = []
                for poll in batch.to_pylist():
                    if key != (poll["key"],):
                        key, hit = (poll["key"],), None
                    hit, answer = _answer(hit, poll, ttl, most)
                    out.append({"key": key[0], **answer})
                yield pa.RecordBatch.from_pylist(out, schema=_ANSWER_ARROW)

        answers = rows.drop("at").repartitionByRange(first).sortWithinPartitions(first, "us", "seq").mapInArrow(run, _ANSWER)
    return answers.select("key", "seq", F.timestamp_micros("us").alias("at"), "state", "value", "age")


def _earlier(spark, table: str, n: int) -> DataFrame | None:
    """Rows that batches before ``n`` have left in ``table``."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(table).where(F.col("batch") < n)


def journal_stream(lines: DataFrame, table: str):
    """A query that keeps ``table`` (a path) at the journal's lines so far, each once by ``id``, the first time that it comes, and all lines without one; :func:`journal_now` reads it."""
    def add(batch: DataFrame, n: int) -> None:
        known = _earlier(batch.sparkSession, table, n)
        fresh = batch.where("id is not null").dropDuplicates(["id"]).unionAll(batch.where("id is null"))
        fresh = fresh if known is None else fresh.join(known.select("id"), "id", "left_anti").select(batch.columns)
        fresh.write.mode("overwrite").parquet(f"{table}/batch={n}")  # a batch that runs again replaces its own rows

    return lines.writeStream.foreachBatch(add)


def journal_now(spark, table: str) -> DataFrame:
    """The journal's lines so far, with ``undone`` for writes that a later successful undo names, whichever batch brought it."""
    rows = spark.read.parquet(table).drop("batch")
    return rows.join(undone_ids(rows).select("id", "undone_at"), "id", "left").withColumn("undone", (F.col("kind") == "write") & F.col("undone_at").isNotNull()).drop("undone_at")
