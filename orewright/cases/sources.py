from pyspark.sql import functions as F

from orewright.cases import case
from orewright.cases.entities import boxes
from orewright.cases.text import MESSY, CLEAN, FOLD
from orewright.functions import register_functions, register_table_functions
from orewright.operators import spatial as s
from orewright.plans.shared import fresh_path
from orewright.sources import files as f
from orewright.streaming import jobs as j
from orewright.streaming import upkeep

case("s01_select_paths", lambda v: f.select_paths(v.asset_paths, ["f1/**", "**/*.OBJ", "**/blue*.glb"], [".git/**", "node_modules/**", "**/*_1?.stl"], 3000).select("id", "rel_path"),
     r"SELECT id, rel_path FROM asset_paths WHERE size_bytes >= 3000 AND (rel_path ILIKE 'f1/%' OR rel_path ILIKE '%.obj' OR regexp_matches(rel_path, '(?i)(^|/)blue[^/]*\.glb$')) AND NOT rel_path LIKE '.git/%' AND NOT rel_path LIKE 'node_modules/%' AND NOT regexp_matches(rel_path, '(?i)_1[^/]\.stl$')")


def journal(v):
    path = fresh_path(v.spark, "journal")
    rows = v.journal.select("seq", "id", "session", "kind", "ok", "object")
    rows.select(F.when(F.col("seq") % 50 == 0, F.lit("{broken")).otherwise(F.to_json(F.struct("seq", "id", "session", "kind", "ok", "object"))).alias("value")).write.text(path)
    return f.read_journal(v.spark, path, "seq long, id string, session long, kind string, ok boolean, object string").select("seq", "id", "kind", F.col("broken").isNotNull().alias("bad"))


case("s10_read_journal", journal, "SELECT CASE WHEN seq % 50 <> 0 THEN seq END AS seq, CASE WHEN seq % 50 <> 0 THEN id END AS id, CASE WHEN seq % 50 <> 0 THEN kind END AS kind, seq % 50 = 0 AS bad FROM journal")
PRINTS = "SELECT id, -4.7e0 + x0 / 50000 AS x0, 41.6e0 + y0 / 50000 AS y0, -4.7e0 + x1 / 50000 AS x1, 41.6e0 + y1 / 50000 AS y1, CASE WHEN id % 3 = 0 THEN -1.0e0 ELSE 4.0e0 + id % 5 END AS height FROM parcels"


def footprints(v):
    path = fresh_path(v.spark, "footprints")
    rows = s.tile_keys(v.sql(PRINTS).withColumn("lon", F.col("x0")).withColumn("lat", F.col("y0")), 14).drop("lon", "lat", "tx", "ty")
    f.write_footprints(rows, path)
    keys = [r["quadkey"] for r in s.tile_keys(v.spark.range(20).select((F.lit(-4.69) + F.col("id") * 0.001).alias("lon"), F.lit(41.61).alias("lat")).unionAll(v.spark.range(20).select((F.lit(-4.69) + F.col("id") * 0.001).alias("lon"), F.lit(41.63).alias("lat"))), 14).select("quadkey").distinct().collect()]
    return f.read_footprints(v.spark, path, keys, (-4.69, 41.611, -4.671, 41.629)).select("id", "height")


case("s15_read_footprints", footprints, f"SELECT id, CASE WHEN height >= 0 THEN height END AS height FROM ({PRINTS}) WHERE x0 BETWEEN -4.69e0 AND -4.671e0 AND y0 BETWEEN 41.611e0 AND 41.629e0")
case("s13_export_cover_instance", lambda v: f.export_cover_instance(s.within_distance(v.geo_candidates, v.geo_demand, 150.0).select(F.col("a").alias("site"), F.col("b").alias("demand"))),
     """SELECT a.id AS site, concat('{"site":', a.id, ',"covers":[', string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id), ']}') AS line FROM geo_candidates a JOIN geo_demand b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 150 GROUP BY a.id""")
case("s13_export_cover_decision", lambda v: f.export_cover_decision(s.within_distance(v.geo_candidates, v.geo_demand, 150.0).select(F.col("a").alias("site"), F.col("b").alias("demand")), v.geo_demand.select("id", F.col("weight").cast("long").alias("weight")), v.geo_candidates.select("id", "cost"), v.sql("SELECT CAST(1 AS INT) AS step, CAST(0 AS BIGINT) AS site, 0 AS gain, 0 AS served")).where("part <> 'solution'"),
     """WITH c AS (SELECT a.id AS site, string_agg(CAST(b.id AS VARCHAR), ',' ORDER BY b.id) AS covers FROM geo_candidates a JOIN geo_demand b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 150 GROUP BY a.id)
     SELECT 'demand' AS part, id, concat('{"id":', id, ',"weight":', CAST(weight AS BIGINT), '}') AS line FROM geo_demand UNION ALL SELECT 'candidate', id, concat('{"id":', id, ',"cost":', cost, ',"covers":[', coalesce(covers, ''), ']}') FROM geo_candidates LEFT JOIN c ON site = id""")
case("s11_sniff_census", lambda v: f.sniff_census(v.pages.select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.when(F.col("page_id") % 2 == 0, ".html").otherwise(".PDF")).alias("path"), F.when(F.col("page_id") % 5 == 0, F.unhex(F.lit("255044462D312E37"))).otherwise(F.encode("html", "UTF-8")).alias("content"))),
     "SELECT CASE WHEN page_id % 2 = 0 THEN 'html' ELSE 'pdf' END AS ending, CASE WHEN page_id % 5 = 0 THEN 'pdf' ELSE 'markup' END AS kind, count(*) AS n FROM pages GROUP BY 1, 2")
case("r01_watch_changes", lambda v: j.watch_changes(v.events.select((F.col("user_id") % 10).alias("root"), F.col("ts").cast("timestamp").alias("ts")), "600 seconds").groupBy("root").agg(F.count("*").alias("triggers"), F.sum("n").alias("n"), F.max("n").alias("most")),
     """WITH e AS (SELECT user_id % 10 AS root, ts, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id % 10 ORDER BY ts)) >= 600000000, true) AS new FROM events), s AS (SELECT *, sum(CAST(new AS INT)) OVER (PARTITION BY root ORDER BY ts) AS k FROM e), g AS (SELECT root, k, count(*) AS n FROM s GROUP BY root, k)
     SELECT root, count(*) AS triggers, CAST(sum(n) AS BIGINT) AS n, max(n) AS most FROM g GROUP BY root""")
VERSIONS = "SELECT concat(url, ' ', CAST(page_id AS VARCHAR(9))) AS url, 1 AS version, true AS ok, html AS text FROM pages UNION ALL SELECT concat(url, ' ', CAST(page_id AS VARCHAR(9))), 2, page_id % 4 <> 0, CASE WHEN page_id % 3 = 0 THEN concat(html, chr(10), 'new line', chr(10), 'another') ELSE html END FROM pages UNION ALL SELECT concat(url, ' ', CAST(page_id AS VARCHAR(9))), 3, true, CASE WHEN page_id % 5 = 0 THEN 'gone' ELSE html END FROM pages"
case("r02_page_changes", lambda v: j.page_changes_batch(v.sql(VERSIONS)),
     rf"""WITH v AS ({VERSIONS}), n AS (SELECT url, version, list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda l: trim(regexp_replace(l, '\s+', ' ', 'g'))), lambda l: l <> '')) AS now FROM v WHERE ok), p AS (SELECT *, lag(now) OVER (PARTITION BY url ORDER BY version) AS old FROM n),
     d AS (SELECT url, version, CAST(len(list_filter(now, lambda x: NOT list_contains(old, x))) AS BIGINT) AS added, CAST(len(list_filter(old, lambda x: NOT list_contains(now, x))) AS BIGINT) AS removed FROM p WHERE old IS NOT NULL) SELECT * FROM d WHERE added > 0 OR removed > 0""")
#: Checks of pages with prose of their own: a baseline, one that is blocked, failed, not modified, too thin or changed, and one after it.
PROSE = "concat(repeat('plain words of prose go on here ', 10), chr(10), 'Page ', url, chr(10), 'Price 10 EUR', chr(10), 'Updated 3 mins ago')"
CHECKS = f"""SELECT concat(url, ' ', CAST(page_id AS VARCHAR(9))) AS url, 1 AS version, 200 AS status, true AS ok, {PROSE} AS text FROM pages UNION ALL
 SELECT concat(url, ' ', CAST(page_id AS VARCHAR(9))), 2, CASE page_id % 8 WHEN 0 THEN 304 WHEN 1 THEN 403 WHEN 2 THEN 500 ELSE 200 END, page_id % 8 > 2, CASE page_id % 8 WHEN 3 THEN 'thin' WHEN 4 THEN replace({PROSE}, 'Price 10', 'Price 11') WHEN 5 THEN replace({PROSE}, '3 mins', '7 mins') WHEN 6 THEN concat('Price 10 EUR', chr(10), replace({PROSE}, concat(chr(10), 'Price 10 EUR'), '')) ELSE concat({PROSE}, chr(10), 'One more line') END FROM pages UNION ALL
 SELECT concat(url, ' ', CAST(page_id AS VARCHAR(9))), 3, 200, true, {PROSE} FROM pages"""
case("r02_page_findings", lambda v: j.page_findings(v.sql(CHECKS)).select("url", "version", "outcome", F.array_join("added", "|").alias("added"), F.array_join("removed", "|").alias("removed")),
     """WITH p AS (SELECT page_id % 8 AS k, concat(url, ' ', CAST(page_id AS VARCHAR)) AS url FROM pages) SELECT url, 1 AS version, 'baseline' AS outcome, '' AS added, '' AS removed FROM p UNION ALL
     SELECT url, 2, CASE k WHEN 0 THEN 'not modified' WHEN 1 THEN 'blocked: http_403' WHEN 2 THEN 'failed' WHEN 3 THEN 'low quality: too short' WHEN 4 THEN 'changed' WHEN 7 THEN 'changed' ELSE 'same' END, CASE k WHEN 4 THEN 'Price 11 EUR' WHEN 7 THEN 'One more line' ELSE '' END, CASE k WHEN 4 THEN 'Price 10 EUR' ELSE '' END FROM p UNION ALL
     SELECT url, 3, CASE WHEN k IN (4, 7) THEN 'changed' ELSE 'same' END, CASE k WHEN 4 THEN 'Price 10 EUR' ELSE '' END, CASE k WHEN 4 THEN 'Price 11 EUR' WHEN 7 THEN 'One more line' ELSE '' END FROM p""")
OBS = "SELECT CAST(user_id % 20 AS BIGINT) AS key, event_id * 10.0e0 AS at, value FROM events WHERE event_id % 3 = 0"
POLLS = "SELECT CAST(user_id % 20 AS BIGINT) AS key, event_id * 10.0e0 + 3 AS at FROM events WHERE event_id % 7 = 1"
case("r04_live_state", lambda v: j.live_state(v.sql(OBS), v.sql(POLLS), 60.0, 900.0).select("key", F.col("at").alias("moment"), F.round("value", 6).alias("value"), "state"),
     f"""WITH o AS ({OBS}), p AS ({POLLS}), m AS (SELECT p.key, p.moment, o.moment AS seen, o.value FROM p ASOF LEFT JOIN o ON p.key = o.key AND p.moment >= o.moment) SELECT key, moment, CASE WHEN moment - seen <= 900 THEN round(value, 6) END AS value, CASE WHEN moment - seen <= 60 THEN 'fresh' WHEN moment - seen <= 900 THEN 'stale' ELSE 'error' END AS state FROM m""".replace(" AS at", " AS moment"))


def stl_texts(v):
    """A text STL file for each box, and for every tenth one that isn't any."""
    corner = lambda p: F.concat(F.lit("vertex "), F.concat_ws(" ", *[F.col(f"{p}{c}").cast("string") for c in "xyz"]), F.lit("\n"))
    facets = boxes(v).select("model_id", F.concat(F.lit("facet normal 0 0 0\nouter loop\n"), corner("a"), corner("b"), corner("c"), F.lit("endloop\nendfacet\n")).alias("t"))
    files = facets.groupBy("model_id").agg(F.array_join(F.collect_list("t"), "").alias("t"))
    text = F.when(F.col("model_id") % 10 == 7, F.lit("no mesh")).otherwise(F.concat(F.lit("solid box\n"), "t", F.lit("endsolid\n")))
    return files.select(F.col("model_id").cast("string").alias("path"), F.encode(text, "UTF-8").alias("content"))


case("s05_read_stl", lambda v: f.read_stl(stl_texts(v)).groupBy(F.col("path").cast("long").alias("model_id")).agg(F.count("face").alias("faces"), F.max(F.greatest("ax", "bx", "cx")).alias("x"), F.max(F.greatest("az", "bz", "cz")).alias("z"), F.count("error").alias("errors")),
     "SELECT model_id, CASE WHEN model_id % 10 = 7 THEN 0 WHEN model_id % 5 = 0 THEN 11 ELSE 12 END AS faces, CASE WHEN model_id % 10 <> 7 THEN a END AS x, CASE WHEN model_id % 10 <> 7 THEN c END AS z, CASE WHEN model_id % 10 = 7 THEN 1 ELSE 0 END AS errors FROM box_faces_seed")


def ascii_grid(v):
    path = fresh_path(v.spark, "grid")
    lines = v.cells.groupBy("row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.coalesce("z", F.lit(-9999.0)).alias("z")))), lambda x: x["z"].cast("string")), " ").alias("line"), F.count("*").alias("n"))
    grid = lines.agg(F.concat(F.lit("ncols "), F.max("n").cast("string"), F.lit("\nnrows "), F.count("*").cast("string"), F.lit("\nxllcorner 100\nyllcorner 200\ncellsize 10\nNODATA_value -9999\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda x: x["line"]), "\n")).alias("value"))
    grid.write.text(path)
    return f.read_ascii_grid(v.spark, path).select("row", "col", "x", "y", "z")


case("s06_read_ascii_grid", ascii_grid, "SELECT row, col, 105.0e0 + col * 10 AS x, 205.0e0 + (24 - row) * 10 AS y, z FROM cells")
OUTLINES = """SELECT floor(id / 50) AS block, concat('{"type":"Feature","properties":{"id":', CAST(id AS VARCHAR(9)), ',"zoning":"', coalesce(zoning, 'none'), '"},"geometry":', CASE id % 10 WHEN 0 THEN 'null' WHEN 5 THEN '{"type":"Polygon","coordinates":[]}'
 ELSE concat('{"type":"Polygon","coordinates":[[[', CAST(CAST(x0 AS BIGINT) AS VARCHAR(20)), ',', CAST(CAST(y0 AS BIGINT) AS VARCHAR(20)), '],[', CAST(CAST(x1 AS BIGINT) AS VARCHAR(20)), ',', CAST(CAST(y1 AS BIGINT) AS VARCHAR(20)), ']]]}') END, '}') AS feature FROM parcels"""


def layer(v):
    path = fresh_path(v.spark, "layer")
    files = v.sql(OUTLINES).groupBy("block").agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("feature"), ","), F.lit("]}")).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return f.read_layer(v.spark, path, "parcels", "EPSG:25830", "survey", "2024-01-01").select(F.col("properties")["id"].cast("long").alias("id"), F.col("properties")["zoning"].alias("zoning"), "kind", "warning", "crs", "source")


case("s07_read_layer", layer, "SELECT id, coalesce(zoning, 'none') AS zoning, CASE WHEN id % 10 <> 0 THEN 'Polygon' END AS kind, CASE id % 10 WHEN 0 THEN 'no geometry' WHEN 5 THEN 'empty geometry' END AS warning, 'EPSG:25830' AS crs, 'survey' AS source FROM parcels")


def hashed_files(v):
    path = fresh_path(v.spark, "files")
    v.pages.select("html").write.option("maxRecordsPerFile", 1).text(path)
    listed = v.spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("size_bytes"))
    return f.fingerprint(v.spark, listed, path).groupBy("sha256").agg(F.count("*").alias("n"), F.max("size_bytes").alias("size_bytes"))


case("s02_fingerprint", hashed_files, "SELECT sha256(concat(html, chr(10))) AS sha256, count(*) AS n, CAST(max(strlen(html)) + 1 AS BIGINT) AS size_bytes FROM pages GROUP BY 1")


def tracks(v):
    path = fresh_path(v.spark, "tracks")
    body = v.sql("SELECT user_id, event_id, concat(CAST(event_id % 360 - 180 AS VARCHAR(9)), ',', CAST(event_id % 180 - 90 AS VARCHAR(9)), CASE WHEN event_id % 3 = 0 THEN '' ELSE concat(',', CAST(event_id AS VARCHAR(9))) END) AS p FROM events")
    line = body.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "p"))), lambda x: x["p"]), " ").alias("c"))
    line.select(F.concat(F.lit("<kml><Placemark><LineString><coordinates>"), "c", F.lit("</coordinates></LineString></Placemark></kml>")).alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return f.read_tracks(v.spark, path, "kml").select("n", "lon", "lat", "ele")


case("s08_read_tracks", tracks, "SELECT CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INT) AS n, CAST(event_id % 360 - 180 AS DOUBLE) AS lon, CAST(event_id % 180 - 90 AS DOUBLE) AS lat, CASE WHEN event_id % 3 <> 0 THEN CAST(event_id AS DOUBLE) END AS ele FROM events")


def feed(v):
    path = fresh_path(v.spark, "feeds")
    item = v.sql("SELECT user_id % 5 AS feed, concat('<item><guid>g', CAST(event_id AS VARCHAR(9)), '</guid><title> T </title><link>http://x/', CAST(event_id AS VARCHAR(9)), '</link><description>', event_type, '</description><pubDate>Mon, ', lpad(CAST(1 + event_id % 28 AS VARCHAR(9)), 2, '0'), ' Jan 2024 10:00:00 +0100</pubDate></item>') AS item FROM events WHERE event_type <> 'error'")
    item.groupBy("feed").agg(F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list("item"), ""), F.lit("</channel></rss>")).alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return f.read_feed_items(v.spark, path, 1_000_000).select("id", "title", "link", F.date_format("published", "yyyy-MM-dd HH:mm").alias("published"), "summary")


case("s09_read_feed_items", feed, "SELECT concat('g', event_id) AS id, 'T' AS title, concat('http://x/', event_id) AS link, concat('2024-01-', lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0'), ' 09:00') AS published, event_type AS summary FROM events WHERE event_type <> 'error'")


def streamed(v, job, rows, table):
    """What a job has written once the rows, in several files, have passed through it."""
    source = fresh_path(v.spark, "arrivals")
    rows.repartition(4).write.json(source)
    stream = v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).json(source)
    job(stream, table).option("checkpointLocation", f"{table}-progress").trigger(availableNow=True).start().awaitTermination()


def journal_kept(v):
    table = fresh_path(v.spark, "journal-table")
    lines = v.journal.select("seq", "id", "kind", "ok", "undoes")
    streamed(v, j.journal_stream, lines.unionAll(lines.where("seq % 9 = 0")), table)
    return j.journal_now(v.spark, table).select("seq", "id", "kind", "undone")


case("r05_journal_stream", journal_kept, "WITH u AS (SELECT j.id FROM journal j JOIN journal u ON u.undoes = j.id AND u.kind = 'undo' AND u.ok WHERE u.seq > j.seq GROUP BY j.id) SELECT seq, id, kind, kind = 'write' AND id IN (SELECT id FROM u) AS undone FROM journal")


#: The library after three arrivals: all assets; those of every 13th id grown, with another hash and place, and every 11th gone; every 22nd back.
LATER = """SELECT root_id, rel_path, id, CASE WHEN id % 13 = 0 AND id % 11 <> 0 THEN size_bytes + 7 ELSE size_bytes END AS size_bytes, triangles, status, watertight,
 CASE WHEN id % 13 = 0 AND id % 11 <> 0 THEN md5(concat(name, 'later')) ELSE sha256 END AS sha256, format, CASE WHEN id % 13 = 0 AND id % 11 <> 0 THEN 'moved' ELSE collection END AS collection, tag1, tag2
 FROM assets WHERE id % 11 <> 0 OR id % 22 = 0"""
KEPT: dict = {}


def kept_up(v):
    """The tables that the stream has kept up over the arrivals; once for each folder and session."""
    key = (v.spark.sparkContext.applicationId, v.dir)
    if key not in KEPT:
        columns = ["root_id", "rel_path", "id", "size_bytes", "triangles", "status", "watertight", "sha256", "format", "collection", "tags", "removed", "at"]
        tags = F.array("tag1", "tag2")
        first = v.assets.withColumns({"tags": tags, "removed": F.lit(False), "at": F.lit(1)})
        changed = v.sql(LATER).where("id % 13 = 0 and id % 11 <> 0").withColumns({"tags": tags, "removed": F.lit(False), "at": F.lit(2)})
        gone = v.assets.where("id % 11 = 0").withColumns({"tags": tags, "removed": F.lit(True), "at": F.lit(2)})
        back = v.assets.where("id % 22 = 0").withColumns({"tags": tags, "removed": F.lit(False), "at": F.lit(3)})
        source, table = fresh_path(v.spark, "arrivals"), fresh_path(v.spark, "catalog")
        for arrival in (first, changed.select(columns).unionAll(gone.select(columns)), back):
            arrival.select(columns).repartition(2).write.mode("append").json(source)
        stream = v.spark.readStream.schema(f"{upkeep.FILE}, removed boolean, at long").option("maxFilesPerTrigger", 2).json(source)
        upkeep.catalog_stream(stream, table, buckets=8).option("checkpointLocation", f"{table}-progress").trigger(availableNow=True).start().awaitTermination()
        KEPT[key] = table
    return KEPT[key]


case("r06_catalog_stream", lambda v: upkeep.catalog_table(v.spark, kept_up(v), "files").select("rel_path", "size_bytes", "sha256", F.array_join("tags", ",").alias("tags")), f"SELECT rel_path, size_bytes, sha256, concat(tag1, ',', tag2) AS tags FROM ({LATER}) l")
case("r06_catalog_totals", lambda v: upkeep.catalog_totals(v.spark, kept_up(v)),
     f"""WITH d AS (SELECT *, min(id) OVER (PARTITION BY sha256) AS lowest FROM ({LATER}) l) SELECT count(*) AS models, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(triangles) AS BIGINT) AS triangles, count_if(status = 'error') AS errors, count_if(status = 'skipped') AS skipped,
     count_if(watertight) AS closed, count_if(NOT watertight) AS open, count_if(watertight IS NULL) AS unknown, count_if(id <> lowest) AS duplicates, count(DISTINCT format) AS formats FROM d""")
case("r06_catalog_facets", lambda v: upkeep.catalog_facets(v.spark, kept_up(v), 20),
     f"""WITH l AS ({LATER}), t AS (SELECT tag1 AS value FROM l UNION ALL SELECT tag2 FROM l) SELECT 'format' AS facet, format AS value, count(*) AS n FROM l GROUP BY format UNION ALL SELECT * FROM (SELECT 'tag' AS facet, value, count(*) AS n FROM t GROUP BY value ORDER BY n DESC, value LIMIT 20)
     UNION ALL SELECT 'collection', collection, count(*) FROM l WHERE collection <> '' GROUP BY collection""")
case("r06_catalog_copies", lambda v: upkeep.catalog_copies(v.spark, kept_up(v)), f"SELECT sha256, min(id) AS lowest, count(*) AS n FROM ({LATER}) l GROUP BY sha256 HAVING count(*) > 1")

#: Each event is a poll of its user's value; errors are polls that the source doesn't answer, and every 50th is forced.
LIVE_POLLS = "SELECT CAST(user_id AS VARCHAR(20)) AS key, event_id AS seq, ts AS asked, event_type <> 'error' AS ok, value, event_id % 50 = 0 AS force FROM events"
case("r04_live_answers", lambda v: j.live_answers(v.sql(LIVE_POLLS).withColumnRenamed("asked", "at"), 3600, 14400).select("key", "seq", "state", "value", F.round("age", 3).alias("age")),
     f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY asked, seq) AS n, epoch_us(asked) / 1e6 AS s FROM ({LIVE_POLLS}) q),
     a(key, n, seq, state, fetched, value, age) AS (
       SELECT key, n, seq, CASE WHEN ok THEN 'fresh' ELSE 'error' END, CASE WHEN ok THEN s END, CASE WHEN ok THEN value END, CASE WHEN ok THEN 0.0e0 END FROM p WHERE n = 1
       UNION ALL
       SELECT key, n, seq, state, CASE WHEN state = 'fresh' THEN s ELSE fetched END, CASE WHEN state = 'fresh' THEN now ELSE value END, CASE state WHEN 'fresh' THEN 0.0e0 WHEN 'error' THEN NULL ELSE s - fetched END
       FROM (SELECT p.key, p.n, p.seq, p.s, a.fetched, p.value AS now, a.value,
                    CASE WHEN p.s - a.fetched < 3600 AND NOT p.force THEN 'cached' WHEN p.ok THEN 'fresh' WHEN p.s - a.fetched <= 14400 THEN 'stale' ELSE 'error' END AS state
             FROM a JOIN p ON p.key = a.key AND p.n = a.n + 1) x)
     SELECT key, seq, state, CASE WHEN state <> 'error' THEN value END AS value, round(age, 3) AS age FROM a""")


def sql_functions(v):
    register_functions(v.spark)
    return v.sql(MESSY).select("page_id", F.expr("url_key(url)").alias("key"))


case("f01_url_key", sql_functions, f"WITH {CLEAN} SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', '') AS key FROM c")


def folded(v):
    register_functions(v.spark)
    return v.documents.select("doc_id", F.expr("md5(fold(text))").alias("folded"), F.expr("parse_amount(concat('EUR ', replace(format_number(n_chars, 0), ',', '.'), '.', CAST(doc_id % 900 + 100 AS STRING), ',5'), ',')").alias("cents"))


case("f01_fold_and_amount", folded, f"SELECT doc_id, md5({FOLD.format('text')}) AS folded, (n_chars * 1000 + doc_id % 900 + 100) * 100 + 50 AS cents FROM documents")


def table_functions(v):
    register_table_functions(v.spark)
    return v.spark.sql("SELECT doc_id, start, cents, currency FROM {receipts}, LATERAL find_prices(text)", receipts=v.receipts)


case("f02_find_prices", table_functions, "SELECT doc_id, CAST(strpos(text, 'Total: ') + 6 AS INT) AS start, CAST(regexp_extract(text, 'Total: (\\d+)', 1) AS BIGINT) * 100 + 50 AS cents, 'EUR' AS currency FROM receipts")
