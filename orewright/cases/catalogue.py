from pyspark.sql import functions as F

from orewright.cases import case
from orewright.operators import catalogue as c

COPIES = "(SELECT sha256 FROM assets WHERE sha256 <> '' GROUP BY sha256 HAVING count(*) > 1)"
CANON = "canon AS (SELECT *, greatest(bbox_x, bbox_y, bbox_z) AS big, least(bbox_x, bbox_y, bbox_z) AS small, bbox_x + bbox_y + bbox_z AS total FROM assets WHERE bbox_x IS NOT NULL AND id IN (SELECT min(id) FROM assets GROUP BY sha256))"
PAIRS = f"""{CANON}, pairs AS (SELECT a.id AS a, b.id AS b FROM canon a JOIN canon b ON a.triangles = b.triangles AND a.id < b.id AND a.sha256 <> b.sha256
 AND abs(a.volume_cm3 - b.volume_cm3) <= 0.01e0 * greatest(abs(a.volume_cm3), abs(b.volume_cm3)) AND abs(a.big - b.big) <= 0.01e0 * a.big AND abs(a.small - b.small) <= 0.01e0 * a.small AND abs(a.total - b.total) <= 0.01e0 * a.total)"""


def tagged(v):
    return v.assets.withColumn("tags", F.array("tag1", "tag2"))


case("p01_filter_assets", lambda v: c.filter_assets(tagged(v), v.listings, v.album_models, c.Filters(root_id=1, formats=["obj", "glb"], watertight=True, min_extent=20.0, max_extent=120.0, min_triangles=24, has_listing=False, status="ok")).select("id", "name", "size_bytes"),
     "SELECT id, name, size_bytes FROM assets WHERE root_id = 1 AND format IN ('obj', 'glb') AND watertight AND bbox_x IS NOT NULL AND greatest(bbox_x, bbox_y, bbox_z) BETWEEN 20 AND 120 AND triangles >= 24 AND status = 'ok' AND id NOT IN (SELECT model_id FROM listings)")
case("p01_dupes_only", lambda v: c.filter_assets(tagged(v), v.listings, v.album_models, c.Filters(dupes_only=True, album_id=3)).select("id", "sha256"),
     "WITH own AS (SELECT * FROM assets WHERE id IN (SELECT model_id FROM album_models WHERE album_id = 3)) SELECT id, sha256 FROM own WHERE EXISTS (SELECT 1 FROM assets o WHERE o.sha256 = own.sha256 AND o.id <> own.id)")


def two_tags(v):
    """Two tags that one asset at least has together."""
    return list(v.sql("SELECT tag1, tag2 FROM assets WHERE id = (SELECT max(id) FROM assets)").first())


case("p02_tag_containment", lambda v: tagged(v).where(c.has_tags(F.col("tags"), two_tags(v))).select("id", "tag1", "tag2"),
     "WITH w AS (SELECT tag1 AS t1, tag2 AS t2 FROM assets WHERE id = (SELECT max(id) FROM assets)) SELECT id, tag1, tag2 FROM assets, w WHERE (tag1 = t1 OR tag2 = t1) AND (tag1 = t2 OR tag2 = t2)")
case("p03_in_album", lambda v: c.in_album(v.assets, v.album_models, 4).select("id", "name"), "SELECT id, name FROM assets WHERE id IN (SELECT model_id FROM album_models WHERE album_id = 4)")
case("p04_with_listing_flag", lambda v: c.with_listing_flag(v.assets, v.listings).select("id", "has_listing"), "SELECT id, id IN (SELECT model_id FROM listings) AS has_listing FROM assets")
case("p08_normalise_tags", lambda v: v.assets.select("id", F.array_join(c.normalise_tags(F.array(F.concat(F.lit("  "), F.upper("tag1")), F.lit(" "), "tag2", F.concat(F.regexp_replace("tag1", " ", "   ")), "tag2")), "|").alias("tags")),
     "SELECT id, CASE WHEN tag1 = tag2 THEN tag1 ELSE concat(tag1, '|', tag2) END AS tags FROM assets")
case("p09_catalog_columns", lambda v: c.catalog_columns(v.assets).select("id", "pretty", "folder", "unit_guess"),
     r"""SELECT id, trim(regexp_replace(regexp_replace(split_part(rel_path, '/', 2), '\.[^.]*$', ''), '[_\-]+', ' ', 'g')) AS pretty, split_part(rel_path, '/', 1) AS folder,
     CASE WHEN bbox_x IS NULL OR greatest(bbox_x, bbox_y, bbox_z) <= 0 THEN NULL WHEN greatest(bbox_x, bbox_y, bbox_z) < 0.5 THEN 'm' WHEN greatest(bbox_x, bbox_y, bbox_z) < 20 THEN 'inch' ELSE 'mm' END AS unit_guess FROM assets""")
case("j01_exact_dupes", lambda v: c.exact_dupes(v.assets), f"SELECT sha256, min(id) AS lowest, count(*) AS n FROM assets WHERE sha256 IN {COPIES} GROUP BY sha256")
case("j01_assign_dupe_of", lambda v: c.assign_dupe_of(v.assets).select("id", "dupe_of"), "SELECT id, nullif(min(id) OVER (PARTITION BY sha256), id) AS dupe_of FROM assets")
case("j02_near_pairs", lambda v: c.near_pairs(v.assets), f"WITH {PAIRS} SELECT a, b FROM pairs")
case("j03_near_groups", lambda v: c.near_groups(v.assets), f"""WITH RECURSIVE {PAIRS}, both_ways AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs), reach(node, other) AS (SELECT a, a FROM both_ways UNION SELECT r.node, w.b FROM reach r JOIN both_ways w ON r.other = w.a)
 SELECT node, min(other) AS label FROM reach GROUP BY node""")
#: The lowest id of the hash that most measured assets share.
MANY = "SELECT id FROM (SELECT min(id) AS id, count(*) AS n FROM assets WHERE bbox_x IS NOT NULL GROUP BY sha256) x ORDER BY n DESC, id LIMIT 1"
case("j04_dupes_for", lambda v: c.dupes_for(v.assets, v.sql(MANY).first()["id"]),
     f"WITH {PAIRS}, m AS ({MANY}), e AS (SELECT a.id FROM assets a JOIN assets o USING (sha256), m WHERE o.id = m.id AND a.id <> m.id), n AS (SELECT CASE WHEN a = m.id THEN b ELSE a END AS id FROM pairs, m WHERE a = m.id OR b = m.id) SELECT id, 'exact' AS kind FROM e UNION ALL SELECT id, 'near' FROM n WHERE id NOT IN (SELECT id FROM e)")
case("j05_shape_candidates", lambda v: c.shape_candidates(v.assets.withColumn("bbox_y", F.col("bbox_y") + F.col("id") % 13).withColumn("bbox_z", F.col("bbox_z") + F.col("id") % 7), v.assets.where("id % 50 = 1"), 0.05, 20),
     """WITH w AS (SELECT *, nullif(min(id) OVER (PARTITION BY sha256), id) AS dupe_of FROM assets), x AS (SELECT id, sha256, watertight, dupe_of, list_sort([bbox_x, bbox_y + id % 13, bbox_z + id % 7]) AS e FROM w WHERE bbox_x IS NOT NULL),
     y AS (SELECT *, e[1] / e[3] AS p, e[2] / e[3] AS q FROM x WHERE e[3] > 0), z AS (SELECT a.id AS query, b.id, abs(a.p - b.p) + abs(a.q - b.q) AS distance FROM y a JOIN y b ON a.id <> b.id AND a.sha256 <> b.sha256 AND a.id % 50 = 1 AND b.watertight AND b.dupe_of IS NULL),
     r AS (SELECT query, id, round(distance, 6) AS distance, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM z WHERE distance <= 0.05e0) SELECT * FROM r WHERE rank <= 20""")
case("j23_root_summary", lambda v: c.root_summary(v.roots, v.assets), "SELECT r.id, r.name, count(a.id) AS n, CAST(coalesce(sum(size_bytes), 0) AS BIGINT) AS bytes FROM roots r LEFT JOIN assets a ON a.root_id = r.id GROUP BY r.id, r.name")
case("j25_asset_detail", lambda v: c.asset_detail(v.assets, v.listings, v.album_models),
     f"""WITH {PAIRS}, n AS (SELECT id, count(*) AS near FROM (SELECT a AS id FROM pairs UNION ALL SELECT b FROM pairs) GROUP BY id), m AS (SELECT model_id AS id, string_agg(CAST(album_id AS VARCHAR), ',' ORDER BY album_id) AS albums FROM album_models GROUP BY model_id)
     SELECT a.id, a.name, l.title, coalesce(albums, '') AS albums, count(*) OVER (PARTITION BY sha256) - 1 AS copies, coalesce(near, 0) AS near FROM assets a LEFT JOIN listings l ON l.model_id = a.id LEFT JOIN m ON m.id = a.id LEFT JOIN n ON n.id = a.id""")
case("a01_library_totals", lambda v: c.library_totals(v.assets),
     """WITH d AS (SELECT *, min(id) OVER (PARTITION BY sha256) AS lowest FROM assets) SELECT count(*) AS models, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(triangles) AS BIGINT) AS triangles, count_if(status = 'error') AS errors, count_if(status = 'skipped') AS skipped,
     count_if(watertight) AS closed, count_if(NOT watertight) AS open, count_if(watertight IS NULL) AS unknown, count_if(id <> lowest) AS duplicates, count(DISTINCT format) AS formats FROM d""")
case("a02_facets", lambda v: c.facets(tagged(v), 20),
     """WITH t AS (SELECT tag1 AS value FROM assets UNION ALL SELECT tag2 FROM assets) SELECT 'format' AS facet, format AS value, count(*) AS n FROM assets GROUP BY format UNION ALL SELECT * FROM (SELECT 'tag' AS facet, value, count(*) AS n FROM t GROUP BY value ORDER BY n DESC, value LIMIT 20)
     UNION ALL SELECT 'collection', collection, count(*) FROM assets WHERE collection <> '' GROUP BY collection""")
case("a03_rollups", lambda v: c.rollups(v.assets), "SELECT format, collection, CAST(grouping(format) AS INT) AS by_collection, count(*) AS n, CAST(sum(size_bytes) AS BIGINT) AS bytes, CAST(sum(triangles) AS BIGINT) AS triangles FROM assets GROUP BY GROUPING SETS ((format), (collection))")
case("a04_folder_sheets", lambda v: c.folder_sheets(tagged(v)),
     """WITH x AS (SELECT *, split_part(rel_path, '/', 1) AS folder FROM assets), r AS (SELECT *, row_number() OVER (PARTITION BY root_id, folder ORDER BY rel_path) AS k, row_number() OVER (PARTITION BY root_id, folder ORDER BY triangles DESC, id) AS big FROM x),
     t AS (SELECT root_id, folder, string_agg(tag, ',' ORDER BY tag) AS tag_candidates FROM (SELECT DISTINCT root_id, folder, tag1 AS tag FROM x UNION SELECT DISTINCT root_id, folder, tag2 FROM x) GROUP BY ALL)
     SELECT root_id, folder, count(*) AS n, string_agg(DISTINCT format, ',' ORDER BY format) AS formats, max(CASE WHEN big = 1 THEN id END) AS largest, CAST(sum(triangles) AS BIGINT) AS triangles, count_if(watertight) AS closed, count(volume_cm3) AS measured,
     string_agg(CASE WHEN k <= 15 THEN rel_path END, ',' ORDER BY rel_path) AS files, any_value(tag_candidates) AS tag_candidates FROM r JOIN t USING (root_id, folder) GROUP BY root_id, folder""")
case("a21_album_overview", lambda v: c.album_overview(v.albums, v.album_models),
     """SELECT a.id, a.name, count(model_id) AS n, coalesce(string_agg(CAST(model_id AS VARCHAR), ',' ORDER BY added_at, model_id), '') AS members, row_number() OVER (ORDER BY lower(a.name), a.id) AS position FROM albums a LEFT JOIN album_models m ON m.album_id = a.id GROUP BY a.id, a.name""")
case("w01_fold_distinct", lambda v: c.fold_distinct(v.assets, "-size", 30, 5).select("id", "copies", "size_bytes"),
     """WITH r AS (SELECT id, size_bytes, row_number() OVER (PARTITION BY sha256 ORDER BY size_bytes DESC NULLS LAST, id) AS k, count(*) OVER (PARTITION BY sha256) - 1 AS copies FROM assets) SELECT id, copies, size_bytes FROM r WHERE k = 1 ORDER BY size_bytes DESC NULLS LAST, id LIMIT 30 OFFSET 5""")
case("o01_sort_assets", lambda v: c.sort_assets(v.assets, "volume").select("id", "volume_cm3").limit(40), "SELECT id, volume_cm3 FROM assets ORDER BY volume_cm3 ASC NULLS FIRST, id LIMIT 40")
case("o02_page", lambda v: c.page(v.assets.where("format = 'stl'"), "name", 10, 20).select("id", "name", "total"), "SELECT id, name, (SELECT count(*) FROM assets WHERE format = 'stl') AS total FROM assets WHERE format = 'stl' ORDER BY lower(name) NULLS FIRST, id LIMIT 10 OFFSET 20")
case("o03_recent_largest", lambda v: c.recent(v.assets, 7).select("id", F.lit("recent").alias("kind")).unionAll(c.largest(v.assets).select("id", F.lit("largest").alias("kind"))),
     "(SELECT id, 'recent' AS kind FROM assets ORDER BY file_modified_at DESC NULLS LAST, id LIMIT 7) UNION ALL (SELECT id, 'largest' AS kind FROM assets ORDER BY triangles DESC NULLS LAST, id LIMIT 5)")
case("u03_edit_tags", lambda v: v.assets.select("id", F.array_join(c.edit_tags(F.array("tag1", "tag2"), F.array(F.lit("fresh tag"), F.col("tag1")), F.array(F.when(F.col("id") % 3 == 0, F.col("tag2")).otherwise("none"))), "|").alias("tags")),
     "SELECT id, CASE WHEN id % 3 = 0 THEN CASE WHEN tag1 = tag2 THEN 'fresh tag' ELSE concat(tag1, '|fresh tag') END WHEN tag1 = tag2 THEN concat(tag1, '|fresh tag') ELSE concat(tag1, '|', tag2, '|fresh tag') END AS tags FROM assets")
