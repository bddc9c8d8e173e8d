from pyspark.sql import functions as F

from orewright.cases import case
from orewright.operators import names
from orewright.operators import text as t
from orewright.operators import vectors as vec
from orewright.plans.shared import materialize

FOLD = "lower(strip_accents({0}))"
WORDS = "regexp_extract_all(" + FOLD.format("coalesce(text, '')") + r", '[\p{L}\p{N}]+')"
TOKENS = f"wd AS MATERIALIZED (SELECT doc_id AS doc, {WORDS} AS w FROM documents), tok AS (SELECT doc, unnest(w) AS term, CAST(len(w) AS BIGINT) AS length FROM wd)"
POSTINGS = f"{TOKENS}, post AS (SELECT doc, term, count(*) AS tf, any_value(length) AS length FROM tok GROUP BY doc, term)"
QUERIES = "SELECT * FROM (VALUES (1, 'the thtions and ereds'), (2, 'Apache License Version'), (3, 'the of'), (4, 'sein Pathetic zu')) AS q(query, text)"
TERMS = "terms(query, term, stem) AS (VALUES (1, 'thtions', 'thtion'), (1, 'ereds', 'ered'), (2, 'apache', 'apache'), (2, 'license', 'license'), (2, 'version', 'version'), (3, 'the', 'the'), (3, 'of', NULL), (4, 'sein', 'sein'), (4, 'pathetic', 'pathetic'), (4, 'zu', NULL))"


def postings(v):
    return t.build_postings(v.documents, "doc_id", ["text"])


case("t01_build_postings", postings, f"WITH {POSTINGS} SELECT doc, 'text' AS \"column\", term, tf, length FROM post")
case("t02_search_docs", lambda v: t.search_docs(materialize(postings(v), "postings"), v.sql(QUERIES)),
     f"""WITH {POSTINGS}, {TERMS}, n AS (SELECT query, count(*) AS n FROM terms GROUP BY query), h AS (SELECT query, doc, count(DISTINCT CASE WHEN p.term = t.term THEN t.term END) AS whole, count(DISTINCT t.term) AS part FROM post p JOIN terms t ON p.term = t.term OR starts_with(p.term, t.stem) GROUP BY query, doc),
     r AS (SELECT query, doc, CAST(CASE WHEN whole = n THEN 1 WHEN part = n THEN 2 ELSE 3 END AS INT) AS rung FROM h JOIN n USING (query)) SELECT * FROM r WHERE rung = (SELECT min(rung) FROM r o WHERE o.query = r.query)""")
BM = "SELECT * FROM (VALUES (1, 'thtion', true), (1, 'ered', false), (2, 'license', false), (2, 'apach', true)) AS q(query, term, prefix)"


def scores(v):
    kept = materialize(postings(v), "postings")
    return t.bm25(kept, v.sql(BM), t.document_lengths(v.documents, "doc_id", kept, "text"), {"text": 1.0}, "text")


BM_SQL = f"""{POSTINGS}, q AS ({BM}), d AS (SELECT doc_id AS doc, len({WORDS}) AS length FROM documents), tot AS (SELECT count(*) AS total, avg(length) AS mean FROM d),
 h AS (SELECT query, q.term, prefix, doc, sum(tf) AS tf FROM post p JOIN q ON p.term = q.term OR (prefix AND starts_with(p.term, q.term)) GROUP BY ALL), i AS (SELECT query, term, prefix, greatest(0.1e0, ln(1 + (any_value(total) - count(*) + 0.5e0) / (count(*) + 0.5e0))) AS idf FROM h, tot GROUP BY ALL),
 s AS (SELECT query, doc, sum(idf * tf * 2.2e0 / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / mean))) AS score FROM h JOIN i USING (query, term, prefix) JOIN d USING (doc), tot GROUP BY query, doc)"""
case("t03_bm25", lambda v: scores(v).select("query", "doc", F.round("score", 6).alias("score")), f"WITH {BM_SQL} SELECT query, doc, round(score, 6) AS score FROM s")
LISTS = "SELECT 'cheap' AS list, p_partkey AS id, row_number() OVER (ORDER BY p_retailprice, p_partkey) AS rank, 1.0e0 AS weight, p_retailprice AS score FROM part WHERE p_size < 20 UNION ALL SELECT 'big', p_partkey, row_number() OVER (ORDER BY p_size DESC, p_partkey), 0.5e0, CAST(p_size AS DOUBLE) FROM part WHERE p_size > 10 UNION ALL SELECT 'flat', p_partkey, 1, 0.25e0, 7.0e0 FROM part WHERE p_partkey % 5 = 0"
case("t05_rrf", lambda v: t.rrf(v.sql(LISTS)).withColumn("score", F.round("score", 9)), f"WITH l AS ({LISTS}) SELECT id, round(sum(weight / (60 + rank)), 9) AS score, string_agg(list, ',' ORDER BY list) AS lists FROM l GROUP BY id")
case("t06_minmax_fuse", lambda v: t.minmax_fuse(v.sql(LISTS)).withColumn("score", F.round("score", 9)),
     f"WITH l AS ({LISTS}), b AS (SELECT list, min(score) AS lo, max(score) AS hi FROM l GROUP BY list) SELECT id, round(sum(weight * CASE WHEN hi = lo THEN 1.0e0 ELSE (score - lo) / (hi - lo) END), 9) AS score FROM l JOIN b USING (list) GROUP BY id")
VECTOR = "SELECT vec_id AS id, embedding AS v FROM embeddings"


def nearest(v, k=10):
    vectors = v.sql(VECTOR)
    return vec.vector_topk(vectors, vectors.where("id % 20 = 0"), k, 0.0)


TOPK = """n AS (SELECT b.vec_id AS query, a.vec_id AS id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a JOIN embeddings b ON b.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
 top AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM n WHERE score >= 0)"""
case("o05_vector_topk", nearest, f"WITH {TOPK} SELECT query, id, score, rank FROM top WHERE rank <= 10")
#: The vectors that stand for the queries of words.
VECTOR_OF = "SELECT * FROM (VALUES (1, CAST(0 AS BIGINT)), (2, CAST(20 AS BIGINT))) AS w(query, vec)"
case("t07_hybrid_search", lambda v: t.hybrid_search(scores(v), nearest(v, 50).withColumnRenamed("query", "vec").join(v.sql(VECTOR_OF), "vec")).withColumn("score", F.round("score", 9)),
     f"WITH {BM_SQL}, {TOPK}, w AS ({VECTOR_OF}), l AS (SELECT * FROM (SELECT query, 'words' AS list, doc AS id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, doc) AS rank FROM s) WHERE rank <= 200 UNION ALL SELECT w.query, 'vectors', id, rank FROM top JOIN w ON w.vec = top.query WHERE rank <= 50) SELECT query, id, round(sum(1.0e0 / (60 + rank)), 9) AS score, string_agg(list, ',' ORDER BY list) AS lists FROM l GROUP BY query, id")
DIRTY = "SELECT doc_id, concat(CASE WHEN doc_id % 5 = 0 THEN replace(text, ' ', chr(10)) ELSE replace(text, '. ', concat('. ', chr(160), chr(13), chr(10), chr(10), chr(10), chr(10))) END, chr(8203), '   end-', chr(10), 'ing') AS text FROM documents"
case("t08_clean_corpus", lambda v: t.clean_corpus(v.sql(DIRTY.replace("chr(160)", "decode(unhex('C2A0'), 'UTF-8')").replace("chr(8203)", "decode(unhex('E2808B'), 'UTF-8')"))).select("doc_id", F.md5("clean").alias("clean"), "before", "after"),
     rf"""WITH d AS ({DIRTY}), a AS (SELECT doc_id, text, regexp_replace(text, '\r\n?', chr(10), 'g') AS x FROM d), b AS (SELECT doc_id, text, regexp_replace(replace(x, chr(8203), ''), concat('[ \t', chr(160), ']+'), ' ', 'g') AS x FROM a), c AS (SELECT doc_id, text, regexp_replace(x, '(\p{{L}})-\n(\p{{Ll}})', '\1\2', 'g') AS x FROM b),
     e AS (SELECT doc_id, text, regexp_replace(regexp_replace(regexp_replace(x, ' *\n *', chr(10), 'g'), '\n{{3,}}', concat(chr(10), chr(10)), 'g'), '^\s+|\s+$', '', 'g') AS x FROM c), f AS (SELECT *, list_filter(string_split(x, chr(10)), lambda l: trim(l) <> '') AS ls FROM e),
     g AS (SELECT doc_id, text, CASE WHEN len(ls) >= 20 AND len(list_filter(ls, lambda l: NOT contains(trim(l), ' '))) / len(ls) > 0.6 AND list_sort(list_transform(ls, lambda l: length(l)))[len(ls) // 2 + 1] <= 14 THEN regexp_replace(x, '\s*\n+\s*', ' ', 'g') ELSE x END AS x FROM f)
     SELECT doc_id, md5(x) AS clean, length(text) AS before, length(x) AS after FROM g""")
case("t09_strip_repeated_lines", lambda v: t.strip_repeated_lines(v.sql("SELECT source, doc_id, concat(CASE WHEN doc_id % 2 = 0 THEN 'PAGE ' ELSE 'Page ' END, doc_id, chr(10), text, chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'All rights reserved' END) AS text FROM documents"), "source", "doc_id").select("doc_id", F.md5("text").alias("text")),
     r"""WITH d AS (SELECT source, doc_id, string_split(concat(CASE WHEN doc_id % 2 = 0 THEN 'PAGE ' ELSE 'Page ' END, doc_id, chr(10), text, chr(10), CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'All rights reserved' END), chr(10)) AS ls FROM documents), l AS (SELECT source, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
     k AS (SELECT *, regexp_replace(lower(trim(line)), '\d+', '#', 'g') AS key FROM l), n AS (SELECT source, count(*) AS pages FROM documents GROUP BY source), c AS (SELECT source, key FROM k JOIN n USING (source) WHERE key <> '' AND length(key) <= 160 AND pages >= 3 GROUP BY source, key HAVING count(DISTINCT doc_id) > 0.5 * any_value(pages)),
     r AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM k WHERE (source, key) NOT IN (SELECT (source, key) FROM c) GROUP BY doc_id) SELECT doc_id, md5(coalesce(text, '')) AS text FROM documents LEFT JOIN r USING (doc_id) WHERE true""".replace("coalesce(text, '')", "coalesce(r.text, '')"))
NEWER = "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN concat(text, chr(10), 'A new  line ', doc_id) WHEN doc_id % 3 = 1 THEN replace(text, 'the', 'THE') ELSE text END AS text FROM documents"
case("u02_diff_lines", lambda v: t.diff_lines(v.documents.select("doc_id", "text"), v.sql(NEWER), "doc_id").select("doc_id", "change", F.md5("line").alias("line")),
     rf"""WITH o AS (SELECT DISTINCT doc_id, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)), nn AS ({NEWER}), n AS (SELECT DISTINCT doc_id, trim(regexp_replace(l, '\s+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM nn)),
     a AS (SELECT * FROM n EXCEPT SELECT * FROM o), r AS (SELECT * FROM o EXCEPT SELECT * FROM n) SELECT doc_id, 'added' AS change, md5(line) AS line FROM a WHERE line <> '' UNION ALL SELECT doc_id, 'removed', md5(line) FROM r WHERE line <> ''""")
NAMES = "(1, 'The'), (2, 'of the'), (3, 'the of the'), (4, 'Apache License'), (5, 'license'), (6, 'de la'), (7, 'Licensed under the Apache License Version 2.0'), (4, 'the apache'), (8, 'under the')"
DICTIONARY = f"SELECT * FROM (VALUES {NAMES}) AS x(entity, name)"
MENTIONS = rf"""w AS (SELECT doc_id AS doc, source, {WORDS} AS w FROM documents), d AS (SELECT entity, regexp_extract_all(lower(name), '[\p{{L}}\p{{N}}]+') AS k FROM (VALUES {NAMES}) AS x(entity, name)), g AS (SELECT doc, source, w, unnest(range(1, len(w) + 1)) AS pos FROM w),
     f AS (SELECT doc, source, entity, pos, len(k) AS n FROM g JOIN d ON g.w[pos] = d.k[1] AND g.w[pos:pos + len(k) - 1] = d.k),
     one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc, entity ORDER BY pos, n DESC) = 1), m AS (SELECT * FROM one f WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.doc = f.doc AND o.n > f.n AND o.pos <= f.pos AND f.pos + f.n <= o.pos + o.n))"""
case("t12_mention_counts", lambda v: names.mention_counts(v.documents, v.sql(DICTIONARY), "doc_id", by=("source",)), f"WITH {MENTIONS} SELECT entity, source, count(DISTINCT doc) AS docs FROM m GROUP BY entity, source")
case("t12_find_mentions", lambda v: names.find_mentions(v.documents, v.sql(DICTIONARY), "doc_id"), f"WITH {MENTIONS} SELECT doc, entity, pos - 1 AS at_, n FROM m".replace("at_", '"at"'))
#: Documents, and every third as a menu, a blocked page or lines of two words.
LOOKS = """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN concat('Please Enable JavaScript', chr(10), substring(text, 1, 300)) WHEN 3 THEN concat('Home', chr(10), 'Your Cart', chr(10), 'Help', chr(10), repeat(concat('Shipping and Returns', chr(10)), 20))
 WHEN 6 THEN repeat(concat('two words', chr(10)), CAST(doc_id % 300 AS INT)) ELSE text END AS text FROM documents"""
case("t14_page_quality", lambda v: t.page_quality(v.sql(LOOKS)).select("doc_id", "words", "short_lines", "chrome", "quality"),
     rf"""WITH x AS ({LOOKS}), d AS (SELECT doc_id, text, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS words, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS ls FROM x),
     s AS (SELECT *, CASE WHEN len(ls) > 0 THEN round(len(list_filter(ls, lambda x: len(regexp_extract_all(x, '\S+')) <= 3)) / len(ls), 6) ELSE 0.0e0 END AS short_lines, list_transform(ls, lambda x: regexp_extract_all(lower(x), '[\p{{L}}\p{{Nl}}\p{{No}}]+')) AS ws FROM d),
     m AS (SELECT *, CASE WHEN len(flatten(ws)) > 0 THEN round(len(flatten(list_filter(ws, lambda w: len(w) <= 4 AND list_has_any(w, string_split('{' '.join(t.MENU_WORDS)}', ' '))))) / len(flatten(ws)), 6) ELSE 1.0e0 END AS chrome FROM s)
     SELECT doc_id, words, short_lines, chrome, CASE WHEN words < 150 AND regexp_matches(lower(substr(text, 1, 800)), '{'|'.join(t.BLOCK_PHRASES)}') THEN 'blocked page' WHEN words < 40 THEN 'too short' WHEN short_lines > 0.85e0 AND words < 400 OR chrome >= 0.6e0 THEN 'mostly navigation' ELSE 'ok' END AS quality FROM m""")
#: Texts that differ in what passes by itself, in a price, or in a letter of another script.
PASSING = """SELECT page_id, concat(CASE page_id % 3 WHEN 0 THEN 'Price  10 EUR' WHEN 1 THEN 'Price 99 EUR' ELSE 'Цена 10' END, chr(10), CASE page_id % 7 WHEN 0 THEN 'Updated 3 mins ago' WHEN 1 THEN concat('© ', CAST(page_id AS VARCHAR(9))) WHEN 2 THEN 'Last updated: just now' ELSE 'HOY ES lunes' END, chr(10),
 'seen at ', CAST(10 + page_id % 10 AS VARCHAR(9)), ':30 pm, 2024-01-0', CAST(1 + page_id % 9 AS VARCHAR(9)), 'T10:00:00Z or hace ', CAST(page_id % 50 AS VARCHAR(9)), ' minutos as ', md5(CAST(page_id AS VARCHAR(9))), chr(10), split_part(url, '/', 3)) AS text FROM pages"""
case("a18_content_groups", lambda v: t.content_groups(v.sql(PASSING), "page_id", "text"),
     """SELECT sha256(lower(concat(CASE page_id % 3 WHEN 0 THEN 'price 10 eur' WHEN 1 THEN 'price 99 eur' ELSE 'цена 10' END, chr(10), 'seen at , or as', chr(10), trim(regexp_replace(split_part(url, '/', 3), '\\s+', ' ', 'g'))))) AS digest, count(*) AS n, min(page_id) AS first FROM pages GROUP BY 1""")
case("a18_raw_pages", lambda v: t.content_groups(v.pages.select("page_id", F.regexp_replace("html", r"[^\p{L}\n ]+", " ").alias("text")), "page_id", "text"),
     r"""WITH l AS (SELECT page_id, unnest(string_split(lower(regexp_replace(html, '[^\p{L}\n ]+', ' ', 'g')), chr(10))) AS line, generate_subscripts(string_split(html, chr(10)), 1) AS pos FROM pages),
     k AS (SELECT page_id, pos, trim(regexp_replace(regexp_replace(regexp_replace(line, '\s+', ' ', 'g'), '^ | $', '', 'g'), '\b[0-9a-f]{16,}\b', ' ', 'g')) AS line FROM l)
     SELECT sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE line <> '' AND NOT regexp_matches(line, '^(copyright\b|hoy es\b)')), '')) AS digest, count(*) AS n, min(page_id) AS first FROM k GROUP BY page_id""".replace("GROUP BY page_id", "GROUP BY page_id").replace("SELECT sha256", "SELECT digest, count(*) AS n, min(first) AS first FROM (SELECT sha256").replace("AS digest, count(*) AS n, min(page_id) AS first FROM k GROUP BY page_id", "AS digest, page_id AS first FROM k GROUP BY page_id) GROUP BY digest"))
MESSY = "SELECT page_id, CASE page_id % 6 WHEN 0 THEN concat(url, '#frag') WHEN 1 THEN replace(url, '://', '://user:pw@') WHEN 2 THEN replace(url, 'http://', 'HTTP://') WHEN 3 THEN replace(replace(url, 'http://', ''), 'https://', '') WHEN 4 THEN concat(replace(split_part(url, '?', 1), '#top', ''), '?b=2&utm_medium=x&a=1&gclid=9') ELSE url END AS url FROM pages"
CLEAN = r"""m AS (MESSY), a AS (SELECT page_id, regexp_replace(CASE WHEN contains(url, '://') THEN url ELSE concat('https://', url) END, '#.*$', '') AS u FROM m), b AS (SELECT page_id, lower(split_part(u, '://', 1)) AS scheme, regexp_replace(split_part(split_part(u, '://', 2), '/', 1), '^.*@', '') AS host,
 regexp_replace(regexp_replace(split_part(substr(u, strpos(u, '://') + 3), '?', 1), '^[^/]*', ''), '/+$', '') AS path, list_sort(list_filter(string_split(split_part(u, '?', 2), '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'gclid='))) AS params FROM a),
 c AS (SELECT page_id, concat(scheme, '://', lower(host), path, CASE WHEN len(params) > 0 THEN concat('?', array_to_string(params, '&')) ELSE '' END) AS url FROM b)""".replace("MESSY", MESSY)
case("t17_normalize_url", lambda v: v.sql(MESSY).select("page_id", t.normalize_url(F.col("url")).alias("url")), f"WITH {CLEAN} SELECT page_id, url FROM c")
case("t17_dedupe_urls", lambda v: t.dedupe_urls(v.sql(MESSY), "url", "page_id").select("page_id", "key", "copies"),
     f"WITH {CLEAN}, k AS (SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', ''), '^www\\.', '') AS key FROM c) SELECT min(page_id) AS page_id, key, count(*) - 1 + 1 AS copies FROM k GROUP BY key")
NAMED = "SELECT page_id, CASE page_id % 7 WHEN 0 THEN 'https://www.hacienda.gob.es/x' WHEN 1 THEN 'http://10.0.0.7/y' WHEN 2 THEN 'http://u:p@a.b.co.uk:8080?q' WHEN 3 THEN 'https://intranet/z' WHEN 4 THEN 'https://shop.example.co.jp.' ELSE url END AS url FROM pages"
case("t19_by_domain", lambda v: t.by_domain(v.sql(NAMED), "url"), rf"SELECT CASE page_id % 7 WHEN 0 THEN 'hacienda.gob.es' WHEN 1 THEN '10.0.0.7' WHEN 2 THEN 'b.co.uk' WHEN 3 THEN 'intranet' WHEN 4 THEN 'example.co.jp' ELSE regexp_extract(url, '://(?:[^/?#]*\.)?([^./?#]+\.[^./?#]+)', 1) END AS domain, count(*) AS n FROM ({NAMED}) GROUP BY 1")
SIGNS = "aggregate(transform(sequence(0, 62), i -> CASE WHEN embedding[i] > 0 THEN shiftleft(1L, i) ELSE 0L END), 0L, (a, b) -> a + b)"
#: Sign bits of the vectors, and for every third one a copy with up to seven of its bits turned.
HASHES = "SELECT vec_id AS id, SIGNS AS h FROM embeddings UNION ALL SELECT vec_id + 1000000, CAST(xor(SIGNS, CAST(power(2, vec_id % 8) AS BIGINT) * 4398046511104 - 4398046511104) AS BIGINT) FROM embeddings WHERE vec_id % 3 = 0"
case("j20_hash_near_pairs", lambda v: t.hash_near_pairs(v.sql(HASHES.replace("xor(SIGNS, ", "(SIGNS ^ ").replace("SIGNS", SIGNS))),
     f"""WITH h AS ({HASHES.replace("SIGNS", "CAST(list_sum(list_transform(range(0, 63), lambda i: CASE WHEN embedding[i + 1] > 0 THEN CAST(1 AS BIGINT) << i ELSE 0 END)) AS BIGINT)")}), d AS (SELECT h, min(id) AS id FROM h GROUP BY h)
     SELECT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b, CAST(bit_count(xor(a.h, b.h)) AS INT) AS bits FROM d a JOIN d b ON a.id < b.id AND bit_count(xor(a.h, b.h)) <= 6 UNION ALL SELECT d.id, h.id, 0 FROM h JOIN d USING (h) WHERE h.id <> d.id""")
