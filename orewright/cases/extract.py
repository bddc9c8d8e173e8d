from pyspark.sql import functions as F

from orewright.cases import case
from orewright.cases.entities import CORNERS, TRIANGLES, boxes
from orewright.cases.spatial import AREA, MEET, edges
from orewright.operators import extract as x
from orewright.operators import network as n
from orewright.operators import spatial as s

case("t10_chunk_corpus", lambda v: x.chunk_corpus(v.documents, "doc_id", "text", 800, 0).groupBy("doc").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum(F.length("chunk")).alias("chars"), (F.max(F.col("end") - F.col("start")) <= 960).alias("fits")),
     "SELECT doc_id AS doc, CAST(0 AS BIGINT) AS start, CAST(length(text) AS BIGINT) AS end, CAST(length(text) AS BIGINT) AS chars, true AS fits FROM documents")
case("t11_chunk_markdown", lambda v: x.chunk_markdown(v.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("---\na: b\n---\n# Conversation "), F.col("conv_id").cast("string"), F.lit("\n## "), "role", F.lit("\n"), "text").alias("body")), "id", "body", 100_000).select("doc", "path", F.length("chunk").alias("chars")),
     "SELECT conv_id * 1000 + turn AS doc, concat('Conversation ', conv_id, ' § ', role) AS path, CAST(length(trim(text, concat(' ', chr(10), chr(9)))) AS INT) AS chars FROM conversations WHERE trim(text) <> ''")
case("t13_extract_pages", lambda v: x.extract_pages(v.pages).select("page_id", "title", (F.length("text") > 0).alias("has_text"), F.contains("text", F.lit("track(")).alias("has_script")), "SELECT page_id, trim(regexp_replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&#x27;', chr(39)), '&amp;', '&'), '\\s+', ' ', 'g')) AS title, true AS has_text, false AS has_script FROM pages")
case("t04_snippets", lambda v: x.snippets(v.documents.select(F.col("doc_id").alias("doc"), F.lit("pathetic").alias("term")), v.documents.select(F.col("doc_id").alias("doc"), "text")).select("doc", F.contains("snippet", F.lit("[")).alias("marked")).where("marked").agg(F.count("*").alias("n")), "SELECT count(*) AS n FROM documents WHERE regexp_matches(lower(text), '\\bpathetic')")
PLANTED = "SELECT doc_id, source, concat(text, ' mail a.b', doc_id, '@mail.example.org or 12345678Z, ES9121000418450200051332 and ES0021000418450200051332, host 10.0.', doc_id % 400, '.7') AS text FROM documents"
case("a13_pii_census", lambda v: x.pii_census(v.sql(PLANTED.replace("doc_id, '@mail", "CAST(doc_id AS STRING), '@mail").replace("doc_id % 400, '", "CAST(doc_id % 400 AS STRING), '")), "text", "source").where("kind IN ('iban', 'dni')"),
     f"WITH p AS ({PLANTED}), h AS (SELECT source, len(regexp_extract_all(text, '\\bES9121000418450200051332\\b')) AS iban, list_filter(regexp_extract_all(text, '\\b\\d{{8}}[A-Z]\\b'), lambda d: substr('TRWAGMYFPDXBNJZSQVHLCKE', CAST(substr(d, 1, 8) AS INT) % 23 + 1, 1) = substr(d, 9, 1)) AS dni FROM p) SELECT source, 'iban' AS kind, CAST(sum(iban) AS BIGINT) AS n, count(*) AS docs FROM h GROUP BY source UNION ALL SELECT source, 'dni', CAST(sum(len(dni)) AS BIGINT), count_if(len(dni) > 0) FROM h GROUP BY source")
case("p11_mask_columns", lambda v: x.mask_columns(v.documents.select("doc_id", "text", F.array("source", F.lit("x@y.org")).alias("more")), ("email",)).select("doc_id", F.md5("text").alias("text"), F.array_join("more", "|").alias("more")),
     r"SELECT doc_id, md5(regexp_replace(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9\-]+(\.[A-Za-z0-9\-]+)+', '<email>', 'g')) AS text, concat(source, '|<email>') AS more FROM documents")
#: Captions that grow, repeat and change; two thirds of an event's cues say what one before them said.
ROLLING = "SELECT user_id AS file, event_id AS n, event_id * 1.0e0 AS start, event_id + 1.5e0 AS end_, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, CASE WHEN event_id % 5 = 0 THEN 's' ELSE '  more ' END, CAST(event_id % 2 AS VARCHAR(9))) ELSE '' END AS text FROM events"
case("w10_dedupe_rolling", lambda v: x.dedupe_rolling(v.sql(ROLLING).withColumnRenamed("end_", "end")),
     f"""WITH c AS (SELECT file, list({{'n': n, 'text': regexp_replace(text, '\\s+', ' ', 'g'), 'e': end_, 'kept': CAST([] AS STRUCT(n BIGINT, text VARCHAR, e DOUBLE)[])}} ORDER BY n) AS l FROM ({ROLLING}) GROUP BY file),
     r AS (SELECT file, list_reduce(l, lambda s, x: {{'n': x.n, 'text': x.text, 'e': x.e, 'kept': CASE
       WHEN len(list_filter(s.kept[-3:], lambda k: k.text = x.text)) > 0 THEN list_transform(s.kept, lambda k, i: {{'n': k.n, 'text': k.text, 'e': CASE WHEN k.text = x.text AND i > len(s.kept) - 3 THEN greatest(k.e, x.e) ELSE k.e END}})
       WHEN len(s.kept) > 0 AND starts_with(x.text, s.kept[-1].text || ' ') THEN list_append(s.kept[:-2], {{'n': s.kept[-1].n, 'text': x.text, 'e': x.e}})
       WHEN x.text <> '' THEN list_append(s.kept, {{'n': x.n, 'text': x.text, 'e': x.e}}) ELSE s.kept END}}, {{'n': CAST(0 AS BIGINT), 'text': '', 'e': 0.0e0, 'kept': CAST([] AS STRUCT(n BIGINT, text VARCHAR, e DOUBLE)[])}}).kept AS kept FROM c),
     u AS (SELECT file, unnest(kept) AS k FROM r) SELECT file, k.n AS n, k.text AS text, k.e AS "end" FROM u""")
OTHERS = "SELECT id, x0, y0, x1, y1, id % 6 = 0 AS special FROM parcels WHERE id % 2 = 0"
case("j16_conflate_prefer", lambda v: s.conflate_prefer(v.sql(OTHERS), v.parcels.where("id % 2 = 1")).select("id", "origin"),
     f"WITH b AS (SELECT * FROM ({OTHERS}) WHERE special) SELECT id, 'base' AS origin FROM b UNION ALL SELECT id, 'other' FROM parcels o WHERE id % 2 = 1 AND NOT EXISTS (SELECT 1 FROM b WHERE (o.x0 + o.x1) / 2 >= b.x0 AND (o.x0 + o.x1) / 2 < b.x1 AND (o.y0 + o.y1) / 2 >= b.y0 AND (o.y0 + o.y1) / 2 < b.y1)")
PARTS = "SELECT id, x0, y0, x1, y1, id % 3 <> 0 AS part FROM parcels"
case("j17_drop_covered_outlines", lambda v: s.drop_covered_outlines(v.sql(PARTS), 0.1).select("id"),
     f"WITH p AS ({PARTS}), g AS (SELECT a.id, sum({AREA}) AS area, any_value((a.x1 - a.x0) * (a.y1 - a.y0)) AS whole FROM p a JOIN p b ON NOT a.part AND b.part AND {MEET} GROUP BY a.id) SELECT id FROM p WHERE id NOT IN (SELECT id FROM g WHERE area >= 0.1 * whole)")
FEATURES = "SELECT id, CASE WHEN id % 3 = 0 THEN 4.5e0 END AS height, id % 4 = 0 AS estimated, id % 10 = 0 AS bridge, id % 11 = 0 AS tunnel, (x1 - x0) * (y1 - y0) AS area, coalesce(zoning, 'none') AS kind FROM parcels"
case("a10_layer_summary", lambda v: s.layer_summary(v.sql(FEATURES)), f"SELECT kind, count(*) AS n, count(height) AS with_height, count_if(estimated) AS estimated, count_if(bridge) AS bridges, count_if(tunnel) AS tunnels, round(sum(area), 3) AS area FROM ({FEATURES}) GROUP BY kind")
FACTS = "SELECT id, (x1 - x0) * (y1 - y0) AS area, CASE WHEN id % 9 = 0 THEN NULL ELSE CAST(id % 30 AS DOUBLE) END AS slope, CAST(id % 5 AS DOUBLE) * 10 AS share, concat('zone ', CAST(id % 7 AS VARCHAR(9))) AS names, CAST(id * 37 % 900 AS DOUBLE) AS access, zoning FROM parcels"
LIMITS = {"min_area_m2": 5000.0, "max_slope_pct": 20.0, "max_access_distance_m": 600.0, "exclusion_max_overlap_pct": 25.0}


def screened(v):
    return s.screen_parcels(v.sql(FACTS), LIMITS, (("zoning", "in", ["industrial", "logistics"]),))


def told(rule, measured, threshold, unit, when, detail="NULL"):
    return f"CASE WHEN {when} THEN concat('{rule}', ' ', coalesce(CAST({measured} AS VARCHAR), '?'), ' {threshold} {unit} ', coalesce({detail}, '')) END"


CHECKS = f"""f AS ({FACTS}), r AS (SELECT id, list_filter([{told("min_area_m2", "round(area, 2)", "5000", "m²", "area < 5000")}, {told("max_slope_pct", "slope", "20", "%", "slope > 20 OR slope IS NULL", "CASE WHEN slope IS NULL THEN 'can''t be checked' END")}, {told("max_access_distance_m", "access", "600", "m", "access > 600")}, {told("exclusion_max_overlap_pct", "share", "25", "%", "share > 25", "concat('overlaps: ', names)")},
 {told("attribute:zoning in", "zoning", "industrial, logistics", "", "zoning IS NULL OR zoning NOT IN ('industrial', 'logistics')", "CASE WHEN zoning IS NULL THEN 'can''t be checked' END")}], lambda x: x IS NOT NULL) AS reasons FROM f)"""
case("g09_screen_parcels", lambda v: screened(v).select("id", "accepted", F.array_join(F.transform("reasons", lambda r: F.concat_ws(" ", r["rule"], F.coalesce(r["measured"], F.lit("?")), r["threshold"], r["unit"], F.coalesce(r["detail"], F.lit("")))), ";").alias("reasons")), f"WITH {CHECKS} SELECT id, len(reasons) = 0 AS accepted, array_to_string(reasons, ';') AS reasons FROM r")
case("a12_screening_summary", lambda v: s.screening_summary(screened(v)), f"WITH {CHECKS}, u AS (SELECT unnest(reasons) AS r FROM r) SELECT regexp_extract(r, '^(attribute:[a-z]+ in|[a-z0-9_]+)', 1) AS rule, count(*) AS n FROM u GROUP BY 1")
CORNER = lambda t, j, p: "concat(" + ", '-', ".join(f"CAST(floor({CORNERS[t[p]][i]} * {'abc'[i]} / 7) AS INT)" for i in range(3)) + ")"
CLUSTERED = " UNION ALL ".join(f"SELECT model_id, {', '.join(f'{CORNER(t, j, p)} AS k{p}' for p in range(3))} FROM box_faces_seed WHERE NOT (model_id % 5 = 0 AND {j} = 3)" for j, t in enumerate(TRIANGLES))
case("g12_cluster_mesh", lambda v: s.cluster_mesh(boxes(v), 7.0).groupBy("model_id").agg(F.count("*").alias("faces")),
     f"WITH f AS ({CLUSTERED}) SELECT model_id, count(DISTINCT list_sort([k0, k1, k2])) AS faces FROM f WHERE k0 <> k1 AND k1 <> k2 AND k0 <> k2 GROUP BY model_id")
SPOTS = "SELECT s_suppkey AS id, s_suppkey * 22.0e0 AS x0, s_suppkey * 29 % 80 * 1.0e0 AS y0, s_suppkey * 22.0e0 + 12 AS x1, s_suppkey * 29 % 80 + 9.0e0 AS y1 FROM supplier UNION ALL SELECT 1000000 + s_suppkey, s_suppkey * 22.0e0 + 13, s_suppkey * 29 % 80 * 1.0e0, s_suppkey * 22.0e0 + 20, s_suppkey * 29 % 80 + 40.0e0 FROM supplier WHERE s_suppkey % 4 = 0"
case("a08_footprint_heights", lambda v: s.footprint_heights(v.sql(SPOTS), v.cells, 4.0, 2.0, 5.0),
     f"""WITH b AS ({SPOTS}), c AS (SELECT row, col, z, col * 4.0e0 AS x, row * 4.0e0 AS y FROM cells WHERE z IS NOT NULL), i AS (SELECT id, row, col, z FROM b JOIN c ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1), far AS (SELECT id, z, sqrt(power(greatest(x0 - x, 0, x - x1), 2) + power(greatest(y0 - y, 0, y - y1), 2)) AS d FROM b JOIN c ON x BETWEEN x0 - 12.5 AND x1 + 12.5 AND y BETWEEN y0 - 12.5 AND y1 + 12.5 WHERE (row, col) NOT IN (SELECT (row, col) FROM i)),
     g1 AS (SELECT id, quantile_cont(z, 0.2) AS ground FROM far WHERE d > 2 AND d <= 5 GROUP BY id HAVING count(*) >= 8), g2 AS (SELECT id, quantile_cont(z, 0.2) AS ground FROM far WHERE d > 2 AND d <= 12.5 AND id NOT IN (SELECT id FROM g1) GROUP BY id HAVING count(*) >= 8), g AS (SELECT * FROM g1 UNION ALL SELECT * FROM g2), q AS (SELECT id, quantile_cont(z, 0.25) AS e, quantile_cont(z, 0.9) AS r, quantile_cont(z, 0.995) AS t FROM i GROUP BY id) SELECT id, round(ground, 6) AS ground, round(greatest(e - ground, 0), 6) AS eaves, round(greatest(r - ground, 0), 6) AS roof, round(greatest(t - ground, 0), 6) AS top FROM g JOIN q USING (id)""")


#: The node of each candidate site.
STARTS = "SELECT DISTINCT CAST(s_suppkey * 19 % (SELECT count(*) FROM part) AS INT) AS node FROM supplier"


def paths(v):
    nodes = n.reach_nodes(edges(v), v.sql(STARTS).select(F.col("node").cast("long").alias("site"), "node", F.lit(0.0).alias("seconds")), 500.0)
    walked = n.shortest_paths(nodes, nodes.select("site", "node"))
    steps = walked.select("site", "target", "step", F.col("node").alias("dst")).join(walked.select("site", "target", (F.col("step") - 1).alias("step"), F.col("node").alias("src")), ["site", "target", "step"])
    length = steps.join(edges(v).select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"), "seconds"), ["src", "dst"]).groupBy("site", "target").agg(F.sum("seconds").alias("s"))
    return length.select("site", F.col("target").cast("long").alias("target"), F.round("s", 6).alias("seconds"))


case("g03_shortest_paths", paths,
     """WITH RECURSIVE e AS (SELECT src, dst, min(seconds) AS seconds FROM (SELECT a AS src, b AS dst, 1000 / (speed_kmh / 3.6e0) AS seconds FROM geo_lines UNION ALL SELECT b, a, 1000 / (speed_kmh / 3.6e0) FROM geo_lines WHERE NOT oneway) GROUP BY src, dst), w(site, node, s) AS (SELECT node, node, 0.0e0 FROM (STARTS) UNION SELECT w.site, e.dst, round(w.s + e.seconds, 7) FROM w JOIN e ON e.src = w.node WHERE w.s + e.seconds <= 500)
     SELECT CAST(site AS BIGINT) AS site, CAST(node AS BIGINT) AS target, round(min(s), 6) AS seconds FROM w WHERE node <> site GROUP BY site, node""".replace("STARTS", STARTS))
