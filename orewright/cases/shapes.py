from pyspark.sql import functions as F

from orewright.cases import case
from orewright.cases.entities import FOUND, HEADED, boxes
from orewright.operators import entities as e
from orewright.operators import shapes as sh
from orewright.operators import text as t


def twins(v):
    faces = boxes(v).where("model_id % 5 <> 0")
    turn = faces.select("model_id", *[(F.col(f"{p}{c}") + (1000 if c == "x" else 0)).alias(f"{q}{c}") for p, q in zip("abc", "acb", strict=True) for c in "xyz"])
    return faces.unionByName(turn)


def twins_and_shells(v):
    """Boxes and their mirror images; boxes that lack a face stay as shells."""
    return twins(v).unionByName(boxes(v).where("model_id % 5 = 0"))


case("a06_mesh_bodies", lambda v: sh.mesh_bodies(twins_and_shells(v)).drop("body"),
     """SELECT model_id, CAST(CASE WHEN model_id % 5 = 0 THEN 11 ELSE 12 END AS BIGINT) AS triangles, model_id % 5 <> 0 AS closed, CASE WHEN model_id % 5 <> 0 THEN round(a * b * c, 6) END AS volume, twin = 1 AS inverted, 1000.0e0 * twin AS x0, a + 1000 * twin AS x1, 0.0e0 AS y0, b AS y1, 0.0e0 AS z0, c AS z1,
     round(a / 2 + 1000 * twin, 4) AS cx, round(b / 2, 4) AS cy, round(c / 2, 4) AS cz FROM box_faces_seed, (VALUES (0), (1)) AS t(twin) WHERE model_id % 5 <> 0 OR twin = 0""")
case("a06_open_loops", lambda v: sh.open_loops(boxes(v)).select("model_id", "loops", "edges"), "SELECT model_id, CAST(1 AS BIGINT) AS loops, CAST(3 AS BIGINT) AS edges FROM box_faces_seed WHERE model_id % 5 = 0")
VOXELS = "SELECT p_partkey AS model_id, a.n_nationkey % 5 AS vx, a.n_nationkey / 5 AS vy, b.n_nationkey AS vz FROM part JOIN nation a ON a.n_nationkey % 5 < 2 + p_partkey % 3 JOIN nation b ON b.n_nationkey < 2 + p_partkey % 4 WHERE a.n_nationkey < 5 * (1 + p_partkey % 2) OR b.n_nationkey = 0 AND a.n_nationkey < 15"
INTEGER = VOXELS.replace("a.n_nationkey / 5", "CAST(floor(a.n_nationkey / 5) AS INT)")
TURNED = ", ".join(f"({k}, {', '.join(str(x) for axis, sign in rot for x in (axis, sign))})" for k, rot in enumerate(sh.rotations()))
PAIRS = "SELECT a, a + step AS b FROM (SELECT p_partkey AS a FROM part) p CROSS JOIN (SELECT * FROM (VALUES (1), (2), (4), (12), (13)) AS t(step)) s WHERE a + step < (SELECT count(*) FROM part)"
case("j06_shape_similarity", lambda v: sh.shape_similarity(v.sql(INTEGER), v.sql(PAIRS), 0.75),
     f"""WITH v AS ({INTEGER}), pp AS ({PAIRS}), w AS (SELECT model_id, vx, vy, vz, [vx, vy, vz] AS p FROM v), rot(r, a0, s0, a1, s1, a2, s2) AS (VALUES {TURNED}), u AS (SELECT model_id, r, p[a0 + 1] * s0 AS x, p[a1 + 1] * s1 AS y, p[a2 + 1] * s2 AS z FROM w, rot),
     n AS (SELECT model_id, r, x - min(x) OVER k AS x, y - min(y) OVER k AS y, z - min(z) OVER k AS z FROM u WINDOW k AS (PARTITION BY model_id, r)), o AS (SELECT model_id, vx - min(vx) OVER k AS x, vy - min(vy) OVER k AS y, vz - min(vz) OVER k AS z, count(*) OVER k AS c FROM v WINDOW k AS (PARTITION BY model_id)),
     m AS (SELECT n.model_id AS a, o.model_id AS b, r, count(*) AS k FROM pp JOIN n ON n.model_id = pp.a JOIN o ON o.model_id = pp.b AND o.x = n.x AND o.y = n.y AND o.z = n.z GROUP BY ALL), q AS (SELECT a, b, max(k) AS k FROM m GROUP BY a, b), c AS (SELECT model_id, any_value(c) AS c FROM o GROUP BY model_id)
     SELECT a, b, round(k / (ca.c + cb.c - k), 6) AS score FROM q JOIN c ca ON ca.model_id = a JOIN c cb ON cb.model_id = b WHERE k / (ca.c + cb.c - k) >= 0.75""")
HITS = "SELECT page_id % 3 AS engine, page_id AS rank, CASE WHEN page_id % 4 = 0 AND NOT contains(url, '://www.') THEN replace(url, '://', '://www.') ELSE url END AS url FROM pages UNION ALL SELECT 3, 1000 - page_id, url FROM pages WHERE page_id % 2 = 0"
case("t05_rrf_urls", lambda v: t.rrf_urls(v.sql(HITS)).select("key", F.round("score", 9).alias("score"), "engines"),
     """WITH h AS (HITS), k AS (SELECT engine, rank, regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^https?://(www\\.)?', ''), '[?&]utm_source=[^&]*', '') AS u FROM h), n AS (SELECT engine, rank, regexp_replace(regexp_replace(u, '^www\\.', ''), '/+$', '') AS key FROM k), b AS (SELECT key, engine, min(rank) AS rank FROM n GROUP BY key, engine)
     SELECT key, round(sum(1.0e0 / (60 + rank)), 9) AS score, string_agg(CAST(engine AS VARCHAR), ',' ORDER BY engine) AS engines FROM b GROUP BY key""".replace("HITS", HITS))
case("t16_fill_rates", lambda v: e.fill_rates(e.page_metadata(v.sql(HEADED))), f"SELECT regexp_extract(url, '://(?:[^/?#]*\\.)?([^./?#]+\\.[^./?#]+)', 1) AS domain, count(*) AS pages, count(title) AS title, count(lang) AS lang, count(description) AS description, count(canonical) AS canonical, count(author) AS author, count(published) AS published, count(image) AS image, count(site) AS site, count(keywords) AS keywords FROM ({FOUND}) GROUP BY 1")
