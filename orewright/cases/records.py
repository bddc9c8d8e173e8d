from pyspark.sql import functions as F

from orewright.cases import case
from orewright.operators import amounts as am
from orewright.operators import ledger as g
from orewright.operators import listings as ls

case("p05_attribute_rules", lambda v: ls.apply_attribute_rules(v.parcels.withColumn("code", F.when(F.col("id") % 5 == 0, "n/a").otherwise(F.col("id").cast("string"))), [("zoning", "in", ["industrial", "logistics"]), ("code", "<", 150), ("x0", "!=", 37.0)], "accept").select("id", "verdict", F.array_join("failed", ";").alias("failed"), "accepted"),
     """WITH x AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE id END AS code FROM parcels), y AS (SELECT id, concat_ws(';', CASE WHEN NOT zoning IN ('industrial', 'logistics') THEN 'zoning in [''industrial'', ''logistics'']' END, CASE WHEN NOT code < 150 THEN 'code < 150' END, CASE WHEN NOT x0 <> 37 THEN 'x0 != 37.0' END) AS failed,
     zoning IS NULL OR code IS NULL AS missing FROM x) SELECT id, CASE WHEN failed <> '' THEN 'fail' WHEN missing THEN 'unknown' ELSE 'pass' END AS verdict, failed, failed = '' AS accepted FROM y""")
RULES = "SELECT * FROM (VALUES ('fits', 'extent', CAST(NULL AS DOUBLE), CAST(120 AS DOUBLE)), ('solid', 'volume', CAST(100 AS DOUBLE), CAST(NULL AS DOUBLE)), ('mesh', 'triangles', CAST(24 AS DOUBLE), CAST(96 AS DOUBLE))) AS r(rule, measure, low, high)"
LONG = "SELECT id, 'extent' AS measure, bbox_z AS value FROM assets UNION ALL SELECT id, 'volume', volume_cm3 FROM assets UNION ALL SELECT id, 'triangles', CAST(triangles AS DOUBLE) FROM assets"
case("p06_evaluate_profile", lambda v: ls.evaluate_profile(v.sql(LONG), v.sql(RULES)), f"WITH m AS ({LONG}), r AS ({RULES}) SELECT id, rule, measure, value, CASE WHEN value IS NULL THEN 'not_evaluated' WHEN (low IS NULL OR value >= low) AND (high IS NULL OR value <= high) THEN 'pass' ELSE 'fail' END AS outcome FROM m JOIN r USING (measure)")


def folders(v):
    return v.folder_listings.withColumn("tags", F.split("tags", r"\|"))


case("p07_validate_listings", lambda v: ls.validate_listings(folders(v), ls.Template(["T03"], ["brushed"], ["^Set"])).select("root_id", "folder", F.array_join("issues", "; ").alias("issues"), "checked_status"),
     """WITH x AS (SELECT *, length(tags) - length(replace(tags, '|', '')) + 1 AS n, row_number() OVER (PARTITION BY root_id, lower(trim(title)) ORDER BY folder) AS k FROM folder_listings),
     y AS (SELECT *, concat_ws('; ', CASE WHEN length(title) > 120 THEN 'title is too long' END, CASE WHEN length(description) < 200 THEN 'description is too short' END, CASE WHEN n <> 20 THEN 'tags are not exactly the wanted number of unique ones' END,
     CASE WHEN k > 1 THEN 'title is used twice' END, CASE WHEN contains(lower(concat(title, ' ', description)), 'brushed') THEN 'forbidden word brushed' END, CASE WHEN NOT starts_with(title, 'Set') THEN 'title matches no pattern' END) AS issues FROM x)
     SELECT root_id, folder, issues, CASE WHEN status = 'none' THEN 'none' WHEN status = 'approved' AND issues = '' THEN 'approved' ELSE 'checked' END AS checked_status FROM y""")
KEYS = "CASE root_id WHEN 0 THEN 'title|description|tags' WHEN 1 THEN 'title|tags|price|author' ELSE 'description' END"
case("p07_listing_keys", lambda v: ls.validate_listings(folders(v).withColumn("keys", F.split(F.expr(KEYS), r"\|")), keys="keys").select("root_id", "folder", F.array_join(F.filter("issues", lambda i: i.contains("keys")), "; ").alias("issues")),
     "SELECT root_id, folder, CASE root_id WHEN 0 THEN '' WHEN 1 THEN 'unexpected keys author, price; missing keys description' ELSE 'missing keys tags, title' END AS issues FROM folder_listings")
case("o04_listing_worklist", lambda v: ls.listing_worklist(v.folder_listings).select("root_id", "folder", "status", "step").limit(15),
     "SELECT root_id, folder, status, CAST(CASE status WHEN 'none' THEN 1 WHEN 'draft' THEN 2 WHEN 'checked' THEN 3 ELSE 4 END AS INT) AS step FROM folder_listings ORDER BY step, root_id, folder LIMIT 15")
case("w08_approved_examples", lambda v: ls.approved_examples(v.folder_listings),
     """WITH p AS (SELECT f.root_id, f.folder, e.folder AS example, row_number() OVER (PARTITION BY f.root_id, f.folder ORDER BY e.updated_at DESC, e.folder) AS rank FROM folder_listings f JOIN folder_listings e ON e.root_id = f.root_id AND e.folder <> f.folder AND e.status = 'approved') SELECT * FROM p WHERE rank <= 3""")
case("u01_export_catalog", lambda v: ls.export_catalog(v.folder_listings, v.listings, v.assets),
     """WITH m AS (SELECT root_id, split_part(rel_path, '/', 1) AS folder, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS members FROM assets GROUP BY ALL)
     SELECT 'folder' AS kind, concat(f.root_id, '/', f.folder) AS key, title, coalesce(members, '') AS members FROM folder_listings f LEFT JOIN m USING (root_id, folder) WHERE status <> 'none' UNION ALL SELECT 'asset', CAST(model_id AS VARCHAR), title, CAST(model_id AS VARCHAR) FROM listings""")
case("u04_prune", lambda v: ls.prune(v.folder_listings, v.assets.where("id % 11 <> 0 AND triangles > 100")).select("root_id", "folder"), "SELECT root_id, folder FROM folder_listings WHERE (root_id, folder) IN (SELECT (root_id, split_part(rel_path, '/', 1)) FROM assets WHERE id % 11 <> 0 AND triangles > 100)")
case("s03_scan_diff", lambda v: ls.scan_diff(v.assets_v1, v.assets_v2, 49),
     """SELECT coalesce(c.rel_path, k.rel_path) AS rel_path, CASE WHEN c.rel_path IS NULL THEN 'removed' WHEN c.size_bytes > 49 THEN 'skipped' WHEN k.rel_path IS NULL THEN 'new' WHEN k.status = 'error' THEN 'retry' WHEN k.size_bytes = c.size_bytes AND abs(k.mtime - c.mtime) < 0.000001e0 THEN 'unchanged'
     WHEN k.sha256 = c.sha256 THEN 'touched' ELSE 'changed' END AS change FROM assets_v1 k FULL JOIN assets_v2 c ON k.rel_path = c.rel_path""")
case("s04_upsert_snapshot", lambda v: ls.upsert_snapshot(v.assets_v1.withColumn("notes", F.concat(F.lit("note "), F.col("id").cast("string"))), v.assets_v2, ["notes"]).select("rel_path", "size_bytes", "mtime", "sha256", "notes"),
     "SELECT c.rel_path, c.size_bytes, c.mtime, c.sha256, CASE WHEN k.rel_path IS NOT NULL THEN concat('note ', k.id) END AS notes FROM assets_v2 c LEFT JOIN assets_v1 k ON k.rel_path = c.rel_path")
case("s14_json_or_default", lambda v: v.events.select("event_id", ls.json_or_default(F.when(F.col("event_id") % 7 == 0, "{broken").otherwise(F.col("props")), "struct<k: bigint>", F.struct(F.lit(-1).cast("long").alias("k")))["k"].alias("k")),
     "SELECT event_id, CASE WHEN event_id % 7 = 0 THEN -1 ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events")
case("s12_listing_markdown", lambda v: ls.listing_markdown(folders(v)), "SELECT root_id, folder, concat('# ', title, chr(10), chr(10), description, chr(10), chr(10), 'Tags: ', replace(tags, '|', ', ')) AS markdown FROM folder_listings")
case("p10_visible_messages", lambda v: g.visible_messages(v.messages.withColumn("audience", F.array("audience1")), "user", since=3000, limit=200).select("seq", "author_id", "visibility"),
     "SELECT seq, author_id, visibility FROM messages WHERE seq > 3000 AND (visibility = 'room' OR author_id = 'user' OR audience1 IN ('user', 'room')) ORDER BY seq LIMIT 200")
UNDONE = "undone AS (SELECT j.id, max(u.seq) AS undone_at FROM journal j JOIN journal u ON u.undoes = j.id AND u.kind = 'undo' AND u.ok WHERE u.seq > j.seq GROUP BY j.id)"
case("w13_journal_view", lambda v: g.journal_view(v.journal, kind="write", limit=150).select("seq", "id", "undone"), f"WITH {UNDONE} SELECT seq, j.id, undone_at IS NOT NULL AS undone FROM journal j LEFT JOIN undone USING (id) WHERE kind = 'write' ORDER BY seq DESC LIMIT 150")
case("u05_undo_plan", lambda v: g.undo_plan(v.journal, 5),
     f"""WITH {UNDONE}, live AS (SELECT * FROM journal WHERE kind = 'write' AND ok AND id NOT IN (SELECT id FROM undone)) SELECT row_number() OVER (ORDER BY seq DESC) AS step, seq, id, object,
     EXISTS (SELECT 1 FROM live o WHERE o.object = l.object AND o.session <> 5 AND o.seq > l.seq) AS conflict FROM live l WHERE session = 5""")
case("w07_latest_revisions", lambda v: g.latest_revisions(v.events, "user_id", [F.desc("ts"), F.desc("event_id")], 2).select("user_id", "event_id", "revision"), "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS revision FROM events) WHERE revision <= 2")
case("a19_ledger_stats", lambda v: g.ledger_stats({"messages": (v.messages, "visibility"), "journal": (v.journal, "kind"), "jobs": (v.events, "event_type")}),
     "SELECT 'messages' AS name, visibility AS state, count(*) AS n FROM messages GROUP BY visibility UNION ALL SELECT 'journal', kind, count(*) FROM journal GROUP BY kind UNION ALL SELECT 'jobs', event_type, count(*) FROM events GROUP BY event_type")
case("a20_scan_progress", lambda v: g.scan_progress(v.events.select((F.col("user_id") % 40).alias("root_id"), "ts", (F.col("event_type") != "error").alias("done"))),
     """WITH p AS (SELECT user_id % 40 AS root_id, count(*) AS total, count_if(event_type <> 'error') AS done, epoch_us(max(ts)) - epoch_us(min(ts)) AS us FROM events GROUP BY 1), r AS (SELECT *, CASE WHEN us > 0 AND done > 0 THEN done * 1e6 / us END AS rate FROM p)
     SELECT root_id, total, done, round(rate, 9) AS rate, round((total - done) / rate, 3) AS eta FROM r""")
case("w14_compare_runs", lambda v: g.compare_runs(v.orders.select(F.col("o_custkey").alias("build"), F.col("o_orderkey").alias("run"), F.round(F.col("o_totalprice") * 100).cast("long").alias("price"), F.length("o_orderpriority").alias("size"))),
     """WITH r AS (SELECT o_custkey AS build, o_orderkey AS run, CAST(round(o_totalprice * 100) AS BIGINT) AS price, CAST(length(o_orderpriority) AS INT) AS size FROM orders)
     SELECT *, price - lag(price) OVER w AS d_price, size - lag(size) OVER w AS d_size FROM r WINDOW w AS (PARTITION BY build ORDER BY run)""")
NET = "net AS (SELECT grp, member, CAST(sum(c) AS BIGINT) AS net FROM (SELECT grp, payer AS member, cents AS c FROM tx UNION ALL SELECT grp, payee, -cents FROM tx) GROUP BY grp, member)"
case("a17_net_balances", lambda v: g.net_balances(v.tx), f"WITH {NET} SELECT * FROM net")
case("a17_settle_groups", lambda v: g.settle_groups(g.net_balances(v.tx)),
     f"""WITH {NET}, r AS (SELECT *, net > 0 AS side, CAST(sum(abs(net)) OVER (PARTITION BY grp, net > 0 ORDER BY abs(net) DESC, member ROWS UNBOUNDED PRECEDING) AS BIGINT) AS upto FROM net WHERE net <> 0)
     SELECT d.grp, d.member AS debtor, c.member AS creditor, least(d.upto, c.upto) - greatest(d.upto - abs(d.net), c.upto - abs(c.net)) AS cents FROM r d JOIN r c ON d.grp = c.grp AND NOT d.side AND c.side AND d.upto - abs(d.net) < c.upto AND c.upto - abs(c.net) < d.upto""")
case("w09_allocate_cents", lambda v: g.allocate_cents(v.sql("SELECT l_orderkey AS o, l_linenumber AS n, CAST(1001 + l_orderkey % 97 AS BIGINT) AS total, CAST(l_quantity AS BIGINT) AS w FROM lineitem"), "o", "total", "w", ["n", "w"]),
     """WITH x AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(1001 + l_orderkey % 97 AS BIGINT) AS total, CAST(l_quantity AS BIGINT) AS w FROM lineitem), y AS (SELECT *, total * w // CAST(sum(w) OVER (PARTITION BY o) AS BIGINT) AS whole, total * w % CAST(sum(w) OVER (PARTITION BY o) AS BIGINT) AS rest FROM x),
     z AS (SELECT *, total - CAST(sum(whole) OVER (PARTITION BY o) AS BIGINT) AS remaining, row_number() OVER (PARTITION BY o ORDER BY rest DESC, n, w) AS k FROM y) SELECT o, n, total, w, whole + CASE WHEN k <= remaining THEN 1 ELSE 0 END AS share FROM z""")
#: Groups by their last digit: 0 to 2 vote for the comma, 3 to 5 for the point, 6 and 7 don't vote (one has a currency with a point), 8 and 9 hold signs and what is no amount.
AMOUNTS = """SELECT o_orderkey AS id, o_custkey % 10 AS grp, CASE WHEN o_custkey % 10 < 3 THEN concat(w, '.000,', t, ' EUR') WHEN o_custkey % 10 < 6 THEN concat('$', w, ',000.', t) WHEN o_custkey % 10 = 6 THEN concat(w, '.', h, ' €') WHEN o_custkey % 10 = 7 THEN concat('US$ ', w, '.', h)
 ELSE CASE o_orderkey % 8 WHEN 0 THEN concat('(', w, ',', t, ')') WHEN 1 THEN concat('−', w, ',', t) WHEN 2 THEN concat(w, ',', t, '-') WHEN 3 THEN concat('about ', w) WHEN 4 THEN concat('- ', w, ' euros') WHEN 5 THEN concat(w, '.000.000') WHEN 6 THEN concat(w, ',00,', t) ELSE concat('+', w, ',5 ', chr(8364)) END END AS amount
 FROM (SELECT o_orderkey, o_custkey, CAST(1 + o_orderkey % 899 AS VARCHAR(9)) AS w, CAST(10 + o_orderkey % 90 AS VARCHAR(9)) AS t, CAST(100 + o_orderkey % 900 AS VARCHAR(9)) AS h FROM orders) o"""
case("t22_parse_amounts", lambda v: am.parse_amounts(v.sql(AMOUNTS.replace("chr(8364)", "'€'")), "amount", "grp").select("id", "cents"),
     """SELECT o_orderkey AS id, CAST(CASE WHEN g < 6 THEN w * 100000 + t WHEN g = 6 THEN (w * 1000 + h) * 100 WHEN g = 7 THEN w * 100 + CAST(floor(h / 10.0e0 + 0.5e0) AS BIGINT)
     ELSE CASE o_orderkey % 8 WHEN 0 THEN -w * 100 - t WHEN 1 THEN -w * 100 - t WHEN 2 THEN -w * 100 - t WHEN 3 THEN NULL WHEN 4 THEN -w * 100 WHEN 5 THEN w * 100000000 WHEN 6 THEN NULL ELSE w * 100 + 50 END END AS BIGINT) AS cents
     FROM (SELECT o_orderkey, o_custkey % 10 AS g, 1 + o_orderkey % 899 AS w, 10 + o_orderkey % 90 AS t, 100 + o_orderkey % 900 AS h FROM orders)""")
