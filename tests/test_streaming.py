import datetime as dt
import random

from orewright.operators import catalogue
from orewright.streaming import jobs, upkeep


def play(spark, tmp_path, batches, schema, build, mode="append"):
    """Rows that a stream of one file a trigger gives."""
    source, sink = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{i}"))
        for k, p in enumerate(sorted((tmp_path / f"b{i}").glob("part-*.json"))):
            p.rename(source / f"{i:03d}-{k}.json")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = build(stream).writeStream.outputMode(mode).format("parquet").option("path", sink).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.read.parquet(sink).collect()


def test_page_changes_equal_the_batch(spark, tmp_path):
    schema = "url string, version long, ok boolean, text string"
    batches = [[("u", 1, True, "a\nb"), ("v", 1, False, "blocked")], [("u", 2, True, "b\na"), ("v", 2, True, "x")], [("u", 3, True, "a\nb\nc"), ("v", 3, True, "x")], [("u", 4, False, "z"), ("v", 4, True, "y\nz")]]
    got = play(spark, tmp_path, batches, schema, jobs.page_changes)
    want = jobs.page_changes_batch(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) == [("u", 3, 1, 0), ("v", 4, 2, 1)]


def test_new_feed_items(spark, tmp_path):
    batches = [[("f", "a", 1), ("f", "b", 2)], [("f", "b", 2), ("f", "c", 3), ("g", "q", 1)], [("f", "a", 1), ("f", "d", 4), ("g", "r", 2)]]
    got = play(spark, tmp_path, batches, "feed string, id string, at long", jobs.new_feed_items)
    assert sorted(map(tuple, got)) == [("f", "c"), ("f", "d"), ("g", "r")]


def test_watch_changes_equal_the_batch(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    batches = [[("r", t(0)), ("r", t(1)), ("q", t(0))], [("r", t(10)), ("r", t(11.5))], [("r", t(5000))], [("r", t(9000))]]
    got = play(spark, tmp_path, batches, "root string, ts timestamp", lambda s: jobs.watch_changes(s, late="1 second"))
    want = jobs.watch_changes(spark.createDataFrame([r for b in batches for r in b], "root string, ts timestamp")).collect()
    assert set(map(tuple, got)) <= set(map(tuple, want)) and len(got) >= 3


def test_journal_batches(spark, tmp_path):
    schema = "rel_path string, sha256 string, id string"
    source = tmp_path / "in"
    source.mkdir()
    for i, rows in enumerate([[("a", "h1", "1"), ("b", "h2", "2"), ("n", "h", None)], [("a", "h3", "3"), ("b", "h2", "2"), ("n", "h", None)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / f"b{i}"))
        next((tmp_path / f"b{i}").glob("part-*.json")).rename(source / f"{i}.json")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    jobs.journal_stream(stream, str(tmp_path / "journal")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(str(r["id"]) for r in spark.read.parquet(str(tmp_path / "journal")).collect()) == ["1", "2", "3", "None", "None"]  # every line without an id stays


def twin(spark, batches):
    """Files after the batches, one row each."""
    files = {}
    for batch in batches:
        for r in sorted((r for r in batch if r[1] is not None), key=lambda r: (r[12], bool(r[11]), r[2])):
            files.pop(r[:2], None)
            if not r[11]:
                files[r[:2]] = r[:11]
    return spark.createDataFrame(list(files.values()), upkeep.FILE)


def test_catalogue_kept_by_batches_equals_the_whole_each_time(spark, tmp_path):
    r = random.Random(1)

    def file(n, at, removed=False):
        sha = r.choice(["h1", "h2", "h3", None, "", f"own{n}"])
        return (r.choice([0, 1, None]) if n % 3 else 0, None if n == 17 else f"p{n}", n, r.choice([1, 5, None]), r.choice([12, None]), r.choice(["ok", "error", "skipped"]), r.choice([True, False, None]), sha, r.choice(["stl", "obj", None]), r.choice(["c", "", None]), r.choice([["a", "b"], ["b"], [], None]), removed, at)

    def flip(row, at):
        return (*row[:2], *file(row[2], at)[2:])

    first = [file(n, 1) for n in range(60)]
    known = {(x[0], x[1]): x for x in first}
    batches = [first, [flip(x, 2) for x in first[::4]], [(*x[:11], True, 3) for x in first[::5]] + [file(99, 3, True), file(98, 3, None)], [(*x[:11], None, 4) for x in first[::10]] + [(*first[1][:11], True, 5), (*first[1][:11], False, 4)], [(*x[:11], True, 6) for x in first if x[7] == "h1"]]
    assert len(known) > 50
    schema, table = f"{upkeep.FILE}, removed boolean, at long", str(tmp_path / "kept")
    plain = lambda df, *c: sorted((tuple(map(str, x)) for x in df.select(*c).collect()))
    for n, batch in enumerate(batches):
        rows = spark.createDataFrame(batch, schema)
        if n in (1, 4):  # a batch that ran in part, then again
            upkeep.apply_changes(spark.createDataFrame(batch[: len(batch) // 2], schema), n, table, buckets=5)
        upkeep.apply_changes(rows, n, table, buckets=5)
        whole = twin(spark, batches[: n + 1])
        assert plain(upkeep.catalog_table(spark, table, "files"), *whole.columns) == plain(whole, *whole.columns)
        totals = catalogue.library_totals(whole)
        assert plain(upkeep.catalog_totals(spark, table), *totals.columns) == plain(totals, *totals.columns)
        assert plain(upkeep.catalog_facets(spark, table), "facet", "value", "n") == plain(catalogue.facets(whole), "facet", "value", "n")
        assert plain(upkeep.catalog_copies(spark, table), "sha256", "lowest", "n") == plain(catalogue.exact_dupes(whole), "sha256", "lowest", "n")
    # only versions that this manifest or the one before it names are left
    assert {p.name for p in (tmp_path / "kept" / "manifest").iterdir()} == {"batch=3", "batch=4"}
    upkeep.apply_changes(spark.createDataFrame([], schema), 5, table, buckets=5)
    assert upkeep.catalog_table(spark, str(tmp_path / "nothing"), "files").count() == 0


def test_live_answers_of_a_stream_equal_the_table(spark, tmp_path):
    t = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    polls = [
        [("a", 1, t(0), True, 1.0, False), ("b", 2, t(1), False, 2.0, False), ("a", 3, t(5), True, 9.0, False)],
        [("a", 4, t(9), False, 9.0, True), ("a", 5, t(11), True, 3.0, False), ("b", 6, t(12), True, 4.0, None), (None, 7, t(12), True, 5.0, False)],
        [("a", 8, t(30), False, 0.0, False), ("b", 9, t(12.5), True, 8.0, True), (None, 10, t(13), None, 5.0, False)],
        [("a", 11, t(41), False, 0.0, False), ("a", 12, t(42), False, 0.0, False), ("b", 13, t(500), False, None, False)],
        [("b", 14, t(900), True, None, False), ("b", 15, t(901), False, 1.0, False)],
    ]
    schema = "key string, seq long, at timestamp, ok boolean, value double, force boolean"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        got = play(spark, tmp_path, polls, schema, lambda s: jobs.live_answers(s, 10, 30, late="1 second"))
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    want = jobs.live_answers(spark.createDataFrame([p for b in polls for p in b], schema), 10, 30).collect()
    assert sorted(map(tuple, got), key=lambda r: r[1]) == sorted(map(tuple, want), key=lambda r: r[1])
    states = {r["seq"]: (r["state"], r["value"], r["age"]) for r in want}
    assert states == {
        1: ("fresh", 1.0, 0.0), 2: ("error", None, None), 3: ("cached", 1.0, 5.0), 4: ("stale", 1.0, 9.0), 5: ("fresh", 3.0, 0.0), 6: ("fresh", 4.0, 0.0), 7: ("fresh", 5.0, 0.0), 8: ("stale", 3.0, 19.0), 9: ("fresh", 8.0, 0.0),
        10: ("cached", 5.0, 1.0), 11: ("stale", 3.0, 30.0), 12: ("error", None, None), 13: ("error", None, None), 14: ("fresh", None, 0.0), 15: ("cached", None, 1.0),
    }
    state = spark.read.format("statestore").option("stateVarName", "hit").load(str(tmp_path / "check"))
    assert state.selectExpr("key.key").collect() == [("b",)]  # timers have cleared what is of no more use
    assert jobs.live_answers(spark.createDataFrame([], schema), 10, None).count() == 0


def test_page_findings_of_a_stream_equal_the_table(spark, tmp_path):
    prose = "plain words of prose go on here " * 10
    schema = "url string, version long, status int, ok boolean, text string"
    batches = [
        [("u", 1, 200, True, prose + "\nPrice 10\nUpdated 3 mins ago"), ("v", 1, 403, False, "no"), ("w", 1, 200, True, "thin")],
        [("u", 2, 200, True, "Price 10\n" + prose + "\nUpdated 9 mins ago"), ("v", 2, 200, True, prose), ("w", 2, None, None, None)],
        [("u", 3, 304, True, ""), ("u", 4, 500, False, prose), ("v", 3, 200, True, prose + "\nCAPTCHA\nnew\nNEW"), ("w", 3, 200, True, prose + "\na\na")],
        [("u", 5, 200, True, prose + "\nPrice 11"), ("v", 4, 200, True, "new\n" + prose), ("w", 4, 200, True, prose + "\nb\na")],
    ]
    got = play(spark, tmp_path, batches, schema, jobs.page_findings)
    want = jobs.page_findings(spark.createDataFrame([r for b in batches for r in b], schema)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert {(r["url"], r["version"]): (r["outcome"], r["added"], r["removed"]) for r in want} == {
        ("u", 1): ("baseline", [], []), ("u", 2): ("same", [], []), ("u", 3): ("not modified", [], []), ("u", 4): ("failed", [], []), ("u", 5): ("changed", ["Price 11"], ["Price 10"]),
        ("v", 1): ("blocked: http_403", [], []), ("v", 2): ("baseline", [], []), ("v", 3): ("low quality: blocked page", [], []), ("v", 4): ("changed", ["new"], []),
        ("w", 1): ("low quality: too short", [], []), ("w", 2): ("failed", [], []), ("w", 3): ("baseline", [], []), ("w", 4): ("changed", ["b"], []),
    }
