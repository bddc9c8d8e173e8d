import datetime as dt

from pyspark.sql import functions as F

from orewright.cases import case
from orewright.operators import entities as e
from orewright.operators import mentions as mn
from orewright.operators import names
from orewright.operators import references as rf

MEMBERS = "SELECT DISTINCT concat(split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2)) AS name FROM part WHERE p_partkey % 3 = 0"
NUMBERED = f"SELECT row_number() OVER (ORDER BY name) AS member, row_number() OVER (ORDER BY name) AS number, name FROM ({MEMBERS})"
ITEMS = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN concat('0', CAST(p_partkey AS VARCHAR(9)), ' - ', upper(p_name), '.stl') WHEN 1 THEN replace(p_name, ' ', '_') WHEN 2 THEN concat('my ', p_name, ' final') ELSE concat('alias ', CAST(p_partkey % 7 AS VARCHAR(9))) END AS name FROM part"
ALIASES = f"SELECT member, concat('Alias-', CAST(number % 6 AS VARCHAR(9))) AS alias FROM ({NUMBERED}) WHERE number <= 8"
MATCH = f"""m AS ({NUMBERED}), al AS (SELECT member, number % 6 AS k FROM m WHERE number <= 8), i AS (SELECT p_partkey AS id, p_partkey % 4 AS form, p_name, p_partkey % 7 AS k FROM part), named AS (SELECT id, form, member FROM i LEFT JOIN m ON m.name = i.p_name WHERE form < 3),
 aka AS (SELECT i.id, count(DISTINCT al.member) AS n, min(al.member) AS member FROM i LEFT JOIN al USING (k) WHERE form = 3 GROUP BY i.id), matched AS (SELECT id, member, CASE WHEN member IS NULL THEN 'none' WHEN form = 2 THEN 'span' ELSE 'exact' END AS how FROM named
 UNION ALL SELECT id, CASE WHEN n = 1 THEN member END, CASE WHEN n = 0 THEN 'none' WHEN n > 1 THEN 'ambiguous' ELSE 'alias' END FROM aka)"""


def matched(v):
    return names.match_names(v.sql(ITEMS), v.sql(NUMBERED), v.sql(ALIASES)).drop("candidates")


case("j07_match_names", matched, f"WITH {MATCH} SELECT id, member, how FROM matched")
OCCUPIED = f"SELECT concat(lpad(CAST(number AS VARCHAR(9)), 3, '0'), ' ', name) AS target FROM ({NUMBERED}) WHERE number % 10 = 0"
case("j08_organize_plan", lambda v: e.organize_plan(matched(v), v.sql(NUMBERED), v.sql(OCCUPIED)),
     f"WITH {MATCH}, t AS (SELECT id, concat(lpad(CAST(number AS VARCHAR), 3, '0'), ' ', name) AS target, number FROM matched JOIN m USING (member)) SELECT id, target, CASE WHEN count(*) OVER (PARTITION BY target) > 1 OR number % 10 = 0 THEN 'conflict' ELSE 'move' END AS state FROM t")
HOSTS = "SELECT page_id AS id, split_part(split_part(split_part(split_part(url, '://', 2), '/', 1), '?', 1), '#', 1) AS host FROM pages"
case("j18_resolve_merchants", lambda v: e.resolve_merchants(v.sql(HOSTS), "host", v.sql("SELECT * FROM (VALUES ('example.org', 'Org'), ('www.therti.example.org', 'Therti'), ('example.net', 'Net')) AS m(domain, merchant)"), v.sql("SELECT * FROM (VALUES ('^blog', 2, 'Blog'), ('th', 1, 'Th')) AS p(pattern, priority, merchant)")),
     f"""WITH h AS ({HOSTS}) SELECT id, host, CASE WHEN host = 'www.therti.example.org' THEN 'Therti' WHEN host LIKE '%.example.org' THEN 'Org' WHEN host LIKE '%.example.net' THEN 'Net' WHEN contains(host, 'th') THEN 'Th' WHEN host LIKE 'blog%' THEN 'Blog' END AS merchant,
     CASE WHEN host LIKE '%.example.org' OR host LIKE '%.example.net' THEN 'domain' WHEN contains(host, 'th') OR host LIKE 'blog%' THEN 'pattern' END AS by FROM h""")
NAMES = "SELECT p_partkey AS id, concat(p_name, CASE p_partkey % 3 WHEN 0 THEN ' Deluxe' WHEN 1 THEN 'ish' ELSE '' END) AS name FROM part"
case("j19_similar_names", lambda v: e.similar_names(v.sql(NAMES), v.sql("SELECT s_suppkey AS id, concat(p_name, ' ', p_type) AS name FROM supplier JOIN part ON p_partkey = s_suppkey + 40")),
     f"""WITH a AS (SELECT id AS a, list_distinct(string_split(lower(name), ' ')) AS w FROM ({NAMES})), b AS (SELECT s_suppkey AS b, list_distinct(regexp_extract_all(lower(concat(p_name, ' ', p_type)), '[a-z0-9]+')) AS w FROM supplier JOIN part ON p_partkey = s_suppkey + 40),
     j AS (SELECT a, b, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb, len(list_filter(a.w, lambda t: len(list_filter(b.w, lambda u: t <> u AND least(length(t), length(u)) >= 4 AND (contains(u, t) OR contains(t, u)))) > 0)) > 0 AS glued FROM a, b) SELECT a, b, round(k / (na + nb - k), 6) AS jaccard FROM j WHERE (k > 0 AND k = least(na, nb)) OR k / (na + nb - k) >= 0.5 OR glued""")
PERSONS = "SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'Ann M. Bell' WHEN 1 THEN 'BELL, Ann Maria' WHEN 2 THEN 'A. Bell' ELSE 'Carl' END AS x, CASE c_custkey % 3 WHEN 0 THEN 'Ann Maria Bell' WHEN 1 THEN 'Bell Ann' ELSE '' END AS y FROM customer"
case("j19_person_similarity", lambda v: v.sql(PERSONS).select("id", e.person_similarity(F.col("x"), F.col("y")).alias("s")),
     f"SELECT id, CASE WHEN y = '' THEN 0.0e0 ELSE CASE concat(id % 4, id % 3) WHEN '00' THEN 0.625e0 WHEN '10' THEN 1.0e0 WHEN '20' THEN 0.375e0 WHEN '30' THEN 0.0e0 WHEN '01' THEN 0.6667e0 WHEN '11' THEN 0.6667e0 WHEN '21' THEN 0.5e0 ELSE 0.0e0 END END AS s FROM ({PERSONS})")
ROBOTS = "SELECT * FROM (VALUES ('a', '*', true, '/'), ('a', '*', false, '/en'), ('a', '*', true, '/en/1*'), ('a', '*', false, '/*.html$'), ('b', 'Crawler', false, '/'), ('b', 'crawler', true, '/es/'), ('b', '*', true, '/')) AS r(host, agent, allow, pattern)"
PATHS = "SELECT DISTINCT CASE page_id % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS host, concat('/', split_part(split_part(split_part(split_part(url, '://', 2), '/', 2), '?', 1), '#', 1), '/', split_part(split_part(split_part(split_part(url, '://', 2), '/', 3), '?', 1), '#', 1)) AS path FROM pages"
case("j21_robots_allowed", lambda v: e.robots_allowed(v.sql(PATHS), v.sql(ROBOTS), "crawler"),
     f"SELECT host, path, CASE host WHEN 'a' THEN CASE WHEN path LIKE '%.html' AND NOT path LIKE '/en/1%' THEN false WHEN path LIKE '/en/1%.html' THEN false WHEN path LIKE '/en/1%' THEN true WHEN path LIKE '/en%' THEN false ELSE true END WHEN 'b' THEN path LIKE '/es/%' ELSE true END AS allowed FROM ({PATHS})")
CONTACTS = "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN concat('User.', CAST(c_custkey % 40 AS VARCHAR(9)), '+x', CAST(c_custkey AS VARCHAR(9)), '@gmail.com') WHEN c_custkey % 3 = 1 THEN concat('A <u', CAST(c_custkey % 50 AS VARCHAR(9)), '@mail.es>') END AS email, CASE WHEN c_custkey % 4 = 0 THEN concat('+34 600 ', CAST(100000 + c_custkey % 60 AS VARCHAR(9))) WHEN c_custkey % 4 = 1 THEN concat('600', CAST(100000 + c_custkey % 60 AS VARCHAR(9))) END AS phone FROM customer"
case("t20_dedupe_contacts", lambda v: e.dedupe_contacts(v.sql(CONTACTS)),
     """WITH RECURSIVE k AS (SELECT c_custkey AS id, concat('e', c_custkey % 3, '-', CASE c_custkey % 3 WHEN 0 THEN c_custkey % 40 ELSE c_custkey % 50 END) AS k FROM customer WHERE c_custkey % 3 < 2 UNION ALL SELECT c_custkey, concat('p', c_custkey % 60) FROM customer WHERE c_custkey % 4 < 2),
     l AS (SELECT k, min(id) AS a FROM k GROUP BY k), e AS (SELECT DISTINCT a, id AS b FROM k JOIN l USING (k)), w AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, o) AS (SELECT c_custkey, c_custkey FROM customer UNION SELECT r.id, w.b FROM r JOIN w ON w.a = r.o) SELECT id, min(o) AS contact FROM r GROUP BY id""")
LINKS = "SELECT page_id AS id, url, CASE page_id % 3 WHEN 0 THEN concat('https://go.example.com/click?x=1&url=https%3A%2F%2Fshop.example.org%2Fp', CAST(page_id AS VARCHAR(9))) WHEN 1 THEN concat('https://t.example.com/out?u=https://go.example.com/r%3Ftarget=https%253A%252F%252Fdeep.example.org%252F', CAST(page_id AS VARCHAR(9))) ELSE url END AS link FROM pages"
case("t18_clean_links", lambda v: e.clean_links(v.sql(LINKS), "link").select("id", "clean", "changed"),
     f"SELECT id, CASE id % 3 WHEN 0 THEN concat('https://shop.example.org/p', id) WHEN 1 THEN concat('https://deep.example.org/', id) ELSE url END AS clean, id % 3 < 2 AS changed FROM ({LINKS})")
EAN = "SELECT o_orderkey AS id, concat('40063813', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0'), CAST(o_custkey % 10 AS VARCHAR(9))) AS code FROM orders"
DNIS = "SELECT CASE o_orderkey % 3 WHEN 0 THEN concat(lpad(CAST(12345678 + o_orderkey AS VARCHAR(9)), 8, '0'), l) WHEN 1 THEN concat(substring(CAST(12345678 + o_orderkey AS VARCHAR(9)), 1, 2), '.', substring(CAST(12345678 + o_orderkey AS VARCHAR(9)), 3, 3), '.', substring(CAST(12345678 + o_orderkey AS VARCHAR(9)), 6, 3), '-', lower(l)) ELSE concat(CAST(2345678 + o_orderkey AS VARCHAR(9)), ' ', l) END AS c FROM (SELECT o_orderkey, substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(1 + o_custkey % 23 AS INT), 1) AS l FROM orders) o"
case("t21_id_validity", lambda v: e.id_validity(v.sql(EAN), "code", "ean13").unionAll(e.id_validity(v.sql(DNIS), "c", "dni")).unionAll(e.id_validity(v.sql("SELECT concat(CASE WHEN o_orderkey % 4 = 3 THEN 'FR' ELSE 'es' END, lpad(CAST(o_custkey % 98 AS VARCHAR(9)), 2, '0'), ' 2100-0418 4502 0005 ', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0')) AS c FROM orders"), "c", "iban")),
     f"""WITH x AS (SELECT code, list_transform(range(1, 14), lambda i: CAST(substr(code, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) AS d FROM ({EAN})) SELECT 'ean13' AS kind, count(*) AS n, count_if(list_sum(d) % 10 = 0) AS valid FROM x
     UNION ALL SELECT 'dni', count(*), count_if((CASE WHEN o_orderkey % 3 = 2 THEN 2345678 ELSE 12345678 END + o_orderkey) % 23 = o_custkey % 23) FROM orders UNION ALL SELECT 'iban', count(*), count_if(CAST(concat('2100041845020005', lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0'), '1428', lpad(CAST(o_custkey % 98 AS VARCHAR), 2, '0')) AS HUGEINT) % 97 = 1 AND o_orderkey % 4 <> 3) FROM orders""")
NIES = "SELECT o_orderkey AS k, o_custkey % 23 AS r, concat(substring('XYZ', CAST(1 + o_orderkey % 3 AS INT), 1), '-', lpad(CAST(o_orderkey AS VARCHAR(9)), 7, '0'), '-', substring('TRWAGMYFPDXBNJZSQVHLCKE', CAST(1 + o_custkey % 23 AS INT), 1)) AS c FROM orders"
CIFS = "SELECT o_orderkey AS k, o_custkey % 10 AS r, lpad(CAST(o_orderkey * 37 AS VARCHAR(9)), 7, '0') AS body, substring('BPC', CAST(1 + o_orderkey % 3 AS INT), 1) AS kind, CASE WHEN o_custkey % 2 = 0 THEN CAST(o_custkey % 10 AS VARCHAR(9)) ELSE substring('JABCDEFGHI', CAST(1 + o_custkey % 10 AS INT), 1) END AS control FROM orders"
ISBNS = "SELECT concat('03064', lpad(CAST(o_orderkey % 10000 AS VARCHAR(9)), 4, '0')) AS body, o_custkey % 11 AS r FROM orders"
EIGHTS = "SELECT concat(lpad(CAST(o_orderkey AS VARCHAR(9)), 7, '0'), CAST(o_custkey % 10 AS VARCHAR(9))) AS c FROM orders"
case("t21_tax_and_book_ids", lambda v: e.id_validity(v.sql(NIES), "c", "nie").unionAll(e.id_validity(v.sql(CIFS).withColumn("c", F.concat("kind", "body", "control")), "c", "cif")).unionAll(e.id_validity(v.sql(ISBNS).withColumn("c", F.concat("body", F.when(F.col("r") == 10, "X").otherwise(F.col("r").cast("string")))), "c", "isbn")).unionAll(e.id_validity(v.sql(EIGHTS), "c", "ean")),
     f"""WITH c AS (SELECT kind, control, list_transform(range(1, 8), lambda i: CASE WHEN i % 2 = 0 THEN CAST(substr(body, i, 1) AS INT) ELSE CAST(substr(body, i, 1) AS INT) * 2 // 10 + CAST(substr(body, i, 1) AS INT) * 2 % 10 END) AS d FROM ({CIFS})), k AS (SELECT kind, control, (10 - CAST(list_sum(d) AS INT) % 10) % 10 AS digit FROM c),
     b AS (SELECT r, list_transform(range(1, 10), lambda i: CAST(substr(body, i, 1) AS INT) * (11 - i)) AS d FROM ({ISBNS})), g AS (SELECT list_transform(range(1, 9), lambda i: CAST(substr(c, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) AS d FROM ({EIGHTS}))
     SELECT 'nie' AS kind, count(*) AS n, count_if((k % 3 * 10000000 + k) % 23 = r) AS valid FROM ({NIES}) UNION ALL SELECT 'cif', count(*), count_if(CASE kind WHEN 'B' THEN control = CAST(digit AS VARCHAR) WHEN 'P' THEN control = substr('JABCDEFGHI', digit + 1, 1) ELSE control = CAST(digit AS VARCHAR) OR control = substr('JABCDEFGHI', digit + 1, 1) END) FROM k
     UNION ALL SELECT 'isbn', count(*), count_if((list_sum(d) + r) % 11 = 0) FROM b UNION ALL SELECT 'ean', count(*), count_if(list_sum(d) % 10 = 0) FROM g""")
DATES = "SELECT DISTINCT CAST(o_orderdate AS DATE) AS date FROM orders"
case("t23_business_days", lambda v: (lambda d: e.add_business_days(d, e.business_calendar(d), 5).select(F.col("date").cast("string").alias("date"), F.col("due").cast("string").alias("due")))(v.sql(DATES)),
     f"""WITH y AS (SELECT year(min(date)) AS a, year(max(date)) AS b FROM ({DATES})), d AS (SELECT CAST(unnest(generate_series(make_date(a, 1, 1), make_date(b, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM y), k AS (SELECT DISTINCT year(date) AS y FROM d), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM k),
     e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1), e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS m FROM e2), e4 AS (SELECT y, h + m - 7 * ((a + 11 * h + 22 * m) // 451) + 114 AS t FROM e3), g AS (SELECT make_date(y, t // 31, t % 31 + 1) - 2 AS friday FROM e4),
     c AS (SELECT date, isodow(date) < 6 AND strftime(date, '%m-%d') NOT IN ('01-01', '01-06', '05-01', '08-15', '10-12', '11-01', '12-06', '12-08', '12-25') AND date NOT IN (SELECT friday FROM g) AS business FROM d), i AS (SELECT *, sum(CAST(business AS INT)) OVER (ORDER BY date) AS i FROM c)
     SELECT CAST(x.date AS VARCHAR) AS date, CAST(u.date AS VARCHAR) AS due FROM ({DATES}) x JOIN i ON i.date = x.date LEFT JOIN i u ON u.business AND u.i = i.i + 5""")
NOW = dt.datetime(2024, 1, 20, 12)
case("t24_since", lambda v: v.sql("SELECT 1 AS one").limit(0).select(F.lit("").alias("phrase"), F.lit(0).cast("long").alias("n")).unionAll(e.since(v.events, "ts", "this month", NOW).agg(F.count("*").alias("n")).select(F.lit("this month").alias("phrase"), "n")).unionAll(e.since(v.events, "ts", "2d", NOW).agg(F.count("*").alias("n")).select(F.lit("2d").alias("phrase"), "n")),
     "SELECT 'this month' AS phrase, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-01' UNION ALL SELECT '2d', count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-18 12:00:00'")
case("t25_ulid_time", lambda v: v.events.select("event_id", F.unix_millis(e.ulid_time(F.concat(F.lit("01H"), F.lpad(F.upper(F.conv(F.col("event_id").cast("string"), 10, 10)), 7, "0"), F.lit("ABCDEFGHJKMNPQRS")))).alias("ms")),
     "WITH d AS (SELECT event_id, lpad(CAST(event_id AS VARCHAR), 7, '0') AS t FROM events) SELECT event_id, 1 * CAST(power(32, 8) AS BIGINT) + 17 * CAST(power(32, 7) AS BIGINT) + CAST(list_sum(list_transform(range(1, 8), lambda i: CAST(substr(t, i, 1) AS BIGINT) * CAST(power(32, 7 - i) AS BIGINT))) AS BIGINT) AS ms FROM d")
CUES = "SELECT user_id AS file, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, event_id * 1.0e0 AS start, event_id + CASE WHEN event_id % 3 = 0 THEN 5.0e0 ELSE 900.0e0 END AS end_, concat('said ', event_type, CASE WHEN event_id % 4 = 0 THEN '.' ELSE '' END) AS text FROM events"
case("w11_cues_to_text", lambda v: e.cues_to_text(v.sql(CUES).withColumnRenamed("end_", "end")),
     f"""WITH c AS ({CUES}), s AS (SELECT *, coalesce(start - lag(end_) OVER w > 1.2e0 OR lag(text) OVER w LIKE '%.', true) AS new FROM c WINDOW w AS (PARTITION BY file ORDER BY n)), p AS (SELECT *, CAST(sum(CAST(new AS INT)) OVER (PARTITION BY file ORDER BY n) AS BIGINT) AS paragraph FROM s)
     SELECT file, paragraph, string_agg(text, ' ' ORDER BY n) AS text FROM p GROUP BY file, paragraph""")
LINES = "SELECT conv_id, turn, concat(CASE WHEN turn % 5 = 4 THEN '```' WHEN turn % 3 = 0 THEN '# ' WHEN turn % 3 = 1 THEN '## ' ELSE '' END, split_part(text, ' ', 1)) AS line FROM conversations"
case("w12_heading_path", lambda v: e.heading_path(v.sql(LINES), "conv_id", "turn").select("conv_id", "turn", "path"),
     f"""WITH l AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) % 2 AS inside FROM ({LINES})), h AS (SELECT *, CASE WHEN inside = 1 THEN NULL WHEN regexp_matches(line, '^# \\S') THEN 1 WHEN regexp_matches(line, '^## \\S') THEN 2 END AS level FROM l),
     g AS (SELECT *, last_value(CASE WHEN level = 1 THEN substr(line, 3) END IGNORE NULLS) OVER w AS h1, last_value(CASE WHEN level = 2 THEN substr(line, 4) WHEN level = 1 THEN '' END IGNORE NULLS) OVER w AS h2 FROM h WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
     SELECT conv_id, turn, array_to_string(list_filter([coalesce(h1, ''), coalesce(h2, '')], lambda x: x <> ''), ' § ') AS path FROM g""")
RESPONSES = """SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, CASE WHEN page_id % 17 = 0 THEN concat('https://', split_part(split_part(url, '://', 2), '/', 1), '/account/login?next=1') ELSE url END AS url,
 CAST(CASE page_id % 9 WHEN 0 THEN 429 WHEN 1 THEN 403 WHEN 2 THEN 401 WHEN 3 THEN 503 ELSE 200 END AS INT) AS status,
 CASE page_id % 13 WHEN 0 THEN concat('<title>Just a moment...</title><p>Cloudflare</p>', html) WHEN 1 THEN concat('<title>Access Denied</title>Reference #18.', html) WHEN 2 THEN '<html><div class="g-recaptcha" data-sitekey="k"></div></html>' WHEN 3 THEN concat('<div id="px-captcha"></div>', html) WHEN 4 THEN '<title>Sign in | Shop</title>' WHEN 5 THEN 'please press &amp; hold'
  WHEN 6 THEN concat('<script src="https://geo.captcha-delivery.com/c.js"></script>', repeat('x', 60000)) ELSE html END AS html FROM pages"""
HEADERS = "CASE page_id % 11 WHEN 0 THEN map('cf-mitigated', 'challenge') WHEN 1 THEN map('set-cookie', 'DataDome=1; a=b') ELSE map('server', 'AkamaiGHost') END"
case("t15_block_census", lambda v: e.block_census(v.sql(RESPONSES).withColumn("headers", F.expr(HEADERS))),
     f"""SELECT host, CASE WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN 'cloudflare' WHEN page_id % 13 = 1 THEN 'akamai' WHEN page_id % 11 > 1 AND status IN (403, 429) AND length(html) < 12000 THEN 'akamai' WHEN page_id % 11 = 1 AND (status IN (403, 429) OR length(html) < 12000) THEN 'datadome'
     WHEN page_id % 13 IN (3, 5) THEN 'perimeterx' WHEN page_id % 13 = 2 THEN 'captcha' WHEN page_id % 17 = 0 OR page_id % 13 = 4 OR status = 401 THEN 'login' WHEN status = 403 THEN 'http_403' WHEN status = 429 THEN 'http_429' WHEN status >= 500 THEN 'http_5xx' ELSE 'ok' END AS verdict, count(*) AS n FROM ({RESPONSES}) GROUP BY 1, 2""")
#: Meta elements in several orders and quotes in front of each page.
HEADED = """SELECT page_id, url, concat('<html LANG=', CASE page_id % 2 WHEN 0 THEN '"EN"' ELSE 'es-ES' END, '>', CASE WHEN page_id % 3 = 0 THEN '<meta content="Ann &amp; Bo" name="author">' WHEN page_id % 3 = 1 THEN '<META property=article:author content=Cy>' ELSE '' END,
 '<link href="/c', CAST(page_id AS VARCHAR(9)), '" rel="nofollow canonical">', CASE WHEN page_id % 4 = 0 THEN concat('<meta property=', chr(39), 'article:published_time', chr(39), ' content=', chr(39), '2024-01-02', chr(39), '>') ELSE '' END, '<meta name="description" content="">',
 '<meta property="og:description" content=" two  words ">', CASE WHEN page_id % 5 = 0 THEN '<meta content="http://x/i.png" property="og:image"/>' ELSE '' END, '<meta name="keywords" content="a, b"><title>Page ', CAST(page_id AS VARCHAR(9)), '</title>') AS html FROM pages"""
FOUND = f"SELECT page_id, url, concat('Page ', page_id) AS title, CASE page_id % 2 WHEN 0 THEN 'en' ELSE 'es-es' END AS lang, 'two words' AS description, concat('/c', page_id) AS canonical, CASE page_id % 3 WHEN 0 THEN 'Ann & Bo' WHEN 1 THEN 'Cy' END AS author, CASE WHEN page_id % 4 = 0 THEN '2024-01-02' END AS published, CASE WHEN page_id % 5 = 0 THEN 'http://x/i.png' END AS image, CAST(NULL AS VARCHAR) AS site, 'a, b' AS keywords FROM pages"
case("t16_page_metadata", lambda v: e.page_metadata(v.sql(HEADED)), FOUND)
case("t16_titles", lambda v: e.page_metadata(v.pages).select("page_id", F.length("title").alias("n"), "lang"), "SELECT page_id, CAST(length(trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 's'), '&#x27;', chr(39)), '&quot;', chr(34)), '&amp;', '&'), '\\s+', ' ', 'g'))) AS INT) AS n, lower(nullif(regexp_extract(html, '<html[^>]*\\slang=\"([^\"]*)\"', 1), '')) AS lang FROM pages")
CITED = "SELECT p_partkey AS id, CASE p_partkey % 8 WHEN 0 THEN 'doc' WHEN 1 THEN 'page' WHEN 2 THEN 'book' WHEN 3 THEN 'chat' WHEN 4 THEN 'link' WHEN 5 THEN 'mail' WHEN 6 THEN 'code' ELSE 'other' END AS kind, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN p_size END AS page, CASE WHEN p_partkey % 5 < 2 THEN p_type ELSE ' ' END AS section, CASE WHEN p_partkey % 7 = 0 THEN p_size END AS line, CASE WHEN p_partkey % 2 = 1 THEN '2024-01-02' END AS date, CASE WHEN p_partkey % 4 = 3 THEN p_size END AS turn, CASE WHEN p_partkey % 3 = 1 THEN p_brand END AS site FROM part"
BOUNDS = "SELECT 'network' AS role, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM geo_nodes UNION ALL SELECT 'demand', min(x), min(y), max(x), max(y) FROM geo_demand UNION ALL SELECT 'candidates', min(x) + 90000, min(y), max(x) + 90000, max(y) FROM geo_candidates UNION ALL SELECT 'parcels', min(x0), min(y0) - 99000000, max(x1), max(y1) - 99000000 FROM parcels"
PLACED = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'epsg:4326' ELSE 'EPSG:25830' END AS crs, 'survey' AS source, CAST('2023-12-01' AS DATE) AS date, CASE WHEN s_suppkey % 5 = 0 THEN -181.0e0 ELSE 1.0e0 END AS x0, 1.0e0 AS y0, 2.0e0 AS x1, CASE WHEN s_suppkey % 5 = 1 THEN 90.5e0 ELSE 2.0e0 END AS y1 FROM supplier"
case("t26_cite_hits", lambda v: e.cite_hits(v.sql(CITED)).select("id", "citation").unionAll(e.cite_hits(v.sql(CITED), "en").select((-F.col("id")).alias("id"), "citation")),
     f"""WITH w(l, o, c, p, ch, li, t, ck, lk, m) AS (VALUES (1, '«', '»', 'p.', 'cap.', 'l.', 'turno', 'chat', 'enlace', 'correo'), (-1, '“', '”', 'p.', 'ch.', 'line', 'turn', 'chat', 'link', 'mail')), h AS (SELECT * REPLACE (nullif(trim(section), '') AS section) FROM ({CITED})), x AS (SELECT *, concat(o, title, c) AS q FROM h, w)
     SELECT id * l AS id, CASE kind WHEN 'doc' THEN CASE WHEN page IS NOT NULL THEN concat(q, ', ', p, ' ', page, coalesce(' · ' || section, '')) WHEN section IS NOT NULL THEN concat(title, ' § ', section) ELSE concat(title, coalesce(', ' || li || ' ' || line, '')) END WHEN 'page' THEN concat(q, coalesce(', ' || p || ' ' || page, '')) WHEN 'book' THEN concat(q, coalesce(', ' || ch || ' ' || section, ''))
     WHEN 'chat' THEN concat('[', ck, ' ', concat_ws(' · ', q, date, section, t || ' ' || turn), ']') WHEN 'link' THEN concat('[', lk, ' ', concat_ws(' · ', q, site), ']') WHEN 'mail' THEN concat('[', m, ' ', concat_ws(' · ', q, site, date), ']') WHEN 'code' THEN concat(title, coalesce(' § ' || section, ''), coalesce(':' || line, '')) END AS citation FROM x""")
case("g10_disjoint_layers", lambda v: e.disjoint_layers(v.sql(BOUNDS)), f"WITH b AS ({BOUNDS}), p(a, b) AS (VALUES ('demand', 'network'), ('candidates', 'network'), ('parcels', 'network'), ('demand', 'candidates')) SELECT p.a, p.b FROM p JOIN b x ON x.role = p.a JOIN b y ON y.role = p.b WHERE x.x1 + 1000 < y.x0 OR y.x1 + 1000 < x.x0 OR x.y1 + 1000 < y.y0 OR y.y1 + 1000 < x.y0")
case("g10_degrees", lambda v: e.check_layers(v.sql(PLACED), dt.date(2024, 1, 1)).select("id", "issues"), "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey % 5 < 2 THEN 'outside longitude and latitude' ELSE '' END AS issues FROM supplier")
case("a15_price_totals", lambda v: mn.price_totals(v.receipts, "doc_id", "text"), "SELECT o_orderkey AS doc, 'EUR' AS currency, CAST(1 AS BIGINT) AS n, c AS low, c AS high, c AS total, c AS labelled FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) * 100 + 50 AS c FROM orders)")
case("a14_reference_census", lambda v: e.reference_census(v.sql("SELECT r.doc_id, concat(r.text, ' code ', e.code) AS text FROM receipts r JOIN (" + EAN + ") e ON e.id = r.doc_id"), "doc_id", "text"),
     f"WITH x AS (SELECT list_transform(range(1, 14), lambda i: CAST(substr(code, i, 1) AS INT) * CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) AS d FROM ({EAN})) SELECT 'order' AS kind, count(*) AS n, count(*) AS docs FROM orders UNION ALL SELECT 'ean13', count(*), count(*) FROM x WHERE list_sum(d) % 10 = 0")
#: Orders with a parcel of one of five forms, some with a wrong check digit, and a product.
SENT = """SELECT o_orderkey AS id, concat('Parcel ', CASE o_orderkey % 5 WHEN 0 THEN concat('1Z', lpad(CAST(o_orderkey AS VARCHAR(9)), 15, '0'), CAST(o_custkey % 10 AS VARCHAR(9))) WHEN 1 THEN concat('RR', lpad(CAST(o_orderkey AS VARCHAR(9)), 8, '0'), CAST(o_custkey % 10 AS VARCHAR(9)), 'ES')
 WHEN 2 THEN concat('TBA', lpad(CAST(o_orderkey AS VARCHAR(9)), 9, '0')) WHEN 3 THEN concat('YT', lpad(CAST(o_orderkey AS VARCHAR(9)), 16, '0')) ELSE 'none' END, ', at https://shop.example.com/dp/B0', lpad(CAST(o_custkey AS VARCHAR(9)), 8, 'A'), '?sku=s', lpad(CAST(o_orderkey AS VARCHAR(9)), 6, 'x')) AS text FROM orders"""
case("a14_reference_kinds", lambda v: rf.reference_kinds(v.sql(SENT), "id", "text"),
     """WITH o AS (SELECT o_orderkey AS k, o_custkey % 10 AS c, list_transform(range(1, 16), lambda i: CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), 15, '0'), i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END) AS u, list_transform([8, 6, 4, 2, 3, 5, 9, 7], lambda w, i: w * CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), i, 1) AS INT)) AS s FROM orders),
     x AS (SELECT k, c, (10 - CAST(list_sum(u) AS INT) % 10) % 10 AS ups, 11 - CAST(list_sum(s) AS INT) % 11 AS r FROM o)
     SELECT 'parcel' AS kind, 'ups' AS carrier, count(*) AS n, count(*) AS docs FROM x WHERE k % 5 = 0 UNION ALL SELECT 'parcel', 'correos', count(*), count(*) FROM x WHERE k % 5 = 1 AND c = CASE r WHEN 10 THEN 0 WHEN 11 THEN 5 ELSE r END
     UNION ALL SELECT 'parcel', 'amazon', count(*), count(*) FROM x WHERE k % 5 = 2 UNION ALL SELECT 'parcel', 'yunexpress', count(*), count(*) FROM x WHERE k % 5 = 3 UNION ALL SELECT 'asin', '', count(*), count(*) FROM x UNION ALL SELECT 'sku', '', count(*), count(*) FROM x""")
case("a14_tracking_numbers", lambda v: rf.tracking_numbers(v.sql(SENT), "id", "text").where("carrier = 'ups'").select("doc", "confidence"),
     """SELECT o_orderkey AS doc, CASE WHEN (10 - CAST(list_sum(list_transform(range(1, 16), lambda i: CAST(substr(lpad(CAST(o_orderkey AS VARCHAR), 15, '0'), i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END)) AS INT) % 10) % 10 = o_custkey % 10 THEN 98 ELSE 70 END AS confidence FROM orders WHERE o_orderkey % 5 = 0""")
case("a16_date_mentions", lambda v: mn.date_mentions(v.receipts, "doc_id", "text", dt.date(2024, 6, 1)).where("role = 'issued'").select("doc", "n", "first"), "SELECT o_orderkey AS doc, CAST(1 AS BIGINT) AS n, CAST(o_orderdate AS DATE) AS first FROM orders")
TODAY = dt.date(2024, 6, 1)
DAY = "CAST(1 + o_orderkey % 28 AS VARCHAR(9))"
#: A price and a date in one of several shapes.
SHAPES = f"""SELECT o_orderkey AS id, CAST(1 + o_orderkey % 28 AS INT) AS d, 1 + o_orderkey % 900 AS k, o_orderkey % 6 AS shape, concat(
 CASE o_orderkey % 6 WHEN 0 THEN concat('Importe total: ', CAST(1 + o_orderkey % 900 AS VARCHAR(9)), '.345,60 EUR') WHEN 1 THEN concat('Subtotal $', CAST(1 + o_orderkey % 900 AS VARCHAR(9)), ',345.60') WHEN 2 THEN concat('price: £', CAST(1 + o_orderkey % 900 AS VARCHAR(9)), '.5 paid') WHEN 3 THEN concat('SEK ', CAST(1 + o_orderkey % 900 AS VARCHAR(9)), ' 200,00')
  WHEN 4 THEN concat('Total a pagar -', CAST(1 + o_orderkey % 900 AS VARCHAR(9)), '.345 €') ELSE concat('total due: ', CAST(1 + o_orderkey % 900 AS VARCHAR(9)), '.345 dollars') END, '. ',
 CASE o_orderkey % 6 WHEN 0 THEN concat('Fecha de emisión: ', {DAY}, ' de octubre de 2023') WHEN 1 THEN concat('due on March ', {DAY}, 'th, 2024') WHEN 2 THEN concat('caduca el ', {DAY}, '/04/25') WHEN 3 THEN concat('entrega ', {DAY}, ' nov') WHEN 4 THEN concat('emitida el ', {DAY}, ' dic.') ELSE concat('31/02/2024 and ', {DAY}, ' juni') END) AS text FROM orders"""
case("a15_price_shapes", lambda v: mn.price_totals(v.sql(SHAPES), "id", "text"),
     f"""WITH s AS ({SHAPES}), c AS (SELECT id AS doc, CASE shape WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' WHEN 2 THEN 'GBP' WHEN 3 THEN 'SEK' WHEN 4 THEN 'EUR' ELSE 'USD' END AS currency, CASE shape WHEN 0 THEN k * 100000 + 34560 WHEN 1 THEN k * 100000 + 34560 WHEN 2 THEN k * 100 + 50 WHEN 3 THEN k * 100000 + 20000 WHEN 4 THEN -(k * 100000 + 34500) ELSE k * 100 + 35 END AS c, shape IN (0, 4, 5) AS t FROM s)
     SELECT doc, currency, CAST(1 AS BIGINT) AS n, c AS low, c AS high, c AS total, CASE WHEN t THEN c ELSE 0 END AS labelled FROM c""")
case("a16_date_shapes", lambda v: mn.date_mentions(v.sql(SHAPES), "id", "text", TODAY),
     f"""WITH s AS ({SHAPES}) SELECT id AS doc, CASE shape WHEN 0 THEN 'issued' WHEN 1 THEN 'due' WHEN 2 THEN 'expires' WHEN 3 THEN 'delivery' WHEN 4 THEN 'issued' ELSE 'other' END AS role, CAST(1 AS BIGINT) AS n, x AS first, x AS last FROM (SELECT *, CASE shape WHEN 0 THEN make_date(2023, 10, d) WHEN 1 THEN make_date(2024, 3, d) WHEN 2 THEN make_date(2025, 4, d) WHEN 3 THEN make_date(2024, 11, d) WHEN 4 THEN make_date(2023, 12, d) ELSE make_date(2024, 6, d) END AS x FROM s)""")
TAGS = """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN map('height', concat(CAST(p_size AS STRING), ',5 m'), 'min_height', '3') WHEN 1 THEN map('height', concat(CAST(p_size AS STRING), ' ft'), 'roof:shape', 'Gabled', 'roof:levels', '2') WHEN 2 THEN map('building:levels', CAST(p_size AS STRING), 'roof:levels', '1', 'building:min_level', '2', 'roof:orientation', 'across')
 WHEN 3 THEN map('height', 'tall', 'building', CASE WHEN p_size % 2 = 0 THEN 'church' ELSE 'shed' END, 'roof:shape', 'half_hipped') WHEN 4 THEN map('building:height', concat(CAST(p_size AS STRING), '; 4'), 'roof:shape', 'sawtooth', 'roof:height', '2.5m') ELSE map('building', 'yes', 'roof:shape', 'spire') END AS tags FROM {part}"""
case("p12_building_attributes", lambda v: e.building_attributes(v.spark.sql(TAGS, part=v.part)),
     """WITH h AS (SELECT p_partkey AS id, p_partkey % 6 AS k, CAST(greatest(2, least(900, CASE p_partkey % 6 WHEN 0 THEN p_size + 0.5e0 WHEN 1 THEN p_size * 0.3048e0 WHEN 2 THEN (p_size + 0.5e0) * 3.1e0 + 1 WHEN 3 THEN CASE WHEN p_size % 2 = 0 THEN 18 ELSE 3 END WHEN 4 THEN p_size ELSE 7 END)) AS DOUBLE) AS h FROM part)
     SELECT id, round(h, 4) AS height, round(greatest(0, least(CASE k WHEN 0 THEN 3 WHEN 2 THEN 6.2e0 ELSE 0 END, h - 1)), 4) AS min_height, k IN (3, 5) AS estimated, CASE k WHEN 1 THEN 'gabled' WHEN 3 THEN 'half-hipped' WHEN 4 THEN 'gabled' WHEN 5 THEN 'cone' ELSE '' END AS roof,
     CASE k WHEN 1 THEN 6.2e0 WHEN 2 THEN 3.1e0 WHEN 4 THEN 2.5e0 END AS roof_height, k = 2 AS across FROM h""")
CORNERS = [(x, y, z) for x in (0, 1) for y in (0, 1) for z in (0, 1)]
QUADS = [(0, 1, 3, 2), (4, 6, 7, 5), (0, 4, 5, 1), (2, 3, 7, 6), (0, 2, 6, 4), (1, 5, 7, 3)]
TRIANGLES = [(q[0], q[1], q[2]) for q in QUADS] + [(q[0], q[2], q[3]) for q in QUADS]


def boxes(v):
    corners = ", ".join("(" + ", ".join(str(CORNERS[k][i]) for k in t for i in range(3)) + f", {j})" for j, t in enumerate(TRIANGLES))
    names = [f"{p}{i}" for p in "abc" for i in "xyz"]
    scale = {"x": "s.a", "y": "s.b", "z": "s.c"}
    return v.sql(f"SELECT s.model_id, {', '.join(f't.{n} * {scale[n[1]]} AS {n}' for n in names)} FROM box_faces_seed s CROSS JOIN (SELECT * FROM (VALUES {corners}) AS t({', '.join(names)}, k)) t WHERE NOT (s.model_id % 5 = 0 AND t.k = 3)")


case("a05_mesh_metrics", lambda v: e.mesh_metrics(boxes(v)).where("model_id % 5 <> 0"), "SELECT model_id, CAST(12 AS BIGINT) AS triangles, 2 * (a * b + b * c + a * c) AS area, a * b * c AS volume, CAST(0 AS BIGINT) AS open_edges, CAST(0 AS BIGINT) AS crowded_edges, true AS watertight FROM box_faces_seed WHERE model_id % 5 <> 0")
case("a05_open_meshes", lambda v: e.mesh_metrics(boxes(v)).where("not watertight").select("model_id", "triangles", "open_edges"), "SELECT model_id, CAST(11 AS BIGINT) AS triangles, CAST(3 AS BIGINT) AS open_edges FROM box_faces_seed WHERE model_id % 5 = 0")
LAYERS = "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'survey' END AS source, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST('2024-01-01' AS DATE) + CAST((s_suppkey % 13 - 9) * 60 AS INT) END AS date FROM supplier"
case("g10_check_layers", lambda v: e.check_layers(v.sql(LAYERS.replace("CAST('2024-01-01' AS DATE) + CAST((s_suppkey % 13 - 9) * 60 AS INT)", "date_add(DATE '2024-01-01', CAST((s_suppkey % 13 - 9) * 60 AS INT))")), dt.date(2024, 1, 1)).select("id", "age", "issues"),
     f"SELECT id, CAST(DATE '2024-01-01' - date AS INT) AS age, concat_ws('; ', CASE WHEN source = '' THEN 'no source' END, CASE WHEN date IS NULL THEN 'no date' END, CASE WHEN DATE '2024-01-01' - date > 365 THEN 'stale' END, CASE WHEN DATE '2024-01-01' - date < 0 THEN 'future date' END) AS issues FROM ({LAYERS})")
case("p06_build_volume", lambda v: e.build_volume_check(v.assets, 90.0, 40.0, 60.0), "SELECT id, CASE WHEN bbox_x IS NULL THEN 'not_evaluated' WHEN list_sort([bbox_x, bbox_y, bbox_z])[1] <= 40 AND list_sort([bbox_x, bbox_y, bbox_z])[2] <= 60 AND list_sort([bbox_x, bbox_y, bbox_z])[3] <= 90 THEN 'pass' ELSE 'fail' END AS outcome FROM assets")
case("t16_jsonld_rows", lambda v: e.jsonld_rows(v.sql("SELECT page_id, concat('<script type=', chr(34), 'application/ld+json', chr(34), '>', replace(CASE page_id % 4 WHEN 0 THEN '{~@type~:~Article~,~headline~:~H~}' WHEN 1 THEN '[{~@type~:~A~,~name~:~x~},{~@type~:~B~}]' WHEN 2 THEN '{~@graph~:[{~@type~:~C~,~name~:~y~}]}' ELSE '{broken' END, '~', chr(34)), '</script>', html) AS html FROM pages")).select("page_id", "n", "type", "name"),
     "SELECT page_id, 0 AS n, 'Article' AS type, 'H' AS name FROM pages WHERE page_id % 4 = 0 UNION ALL SELECT page_id, 0, 'A', 'x' FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 1, 'B', NULL FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT page_id, 0, 'C', 'y' FROM pages WHERE page_id % 4 = 2")
case("t16_feed_links", lambda v: e.feed_links(v.sql("SELECT page_id, concat('<link rel=alternate type=', chr(34), CASE WHEN page_id % 2 = 0 THEN 'application/rss+xml' ELSE 'text/css' END, chr(34), ' href=', chr(34), '/f', CAST(page_id AS VARCHAR(9)), chr(34), '>', html) AS html FROM pages")), "SELECT page_id, concat('/f', page_id) AS href FROM pages WHERE page_id % 2 = 0")
