"""Search, fusion, cleaning, web pages and links."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.operators.amounts import quoted

#: Letters of the Latin, Greek and Cyrillic blocks that have accents, and the letter that each is without them, one character for one.
_BASES = {c: unicodedata.normalize("NFD", c)[0].lower() for c in map(chr, [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]) if len(unicodedata.normalize("NFD", c)) > 1 and unicodedata.normalize("NFD", c)[0].isalpha()}
ACCENTED, PLAIN = "".join(_BASES), "".join(_BASES.values())

#: Words that a query drops.
STOP_WORDS = (
    "de la el los las un una unos unas y o u e en del al a que con por para se su sus lo le les es son no ni como mas muy ya "
    "mi mis tu tus me te sobre acerca donde que cual cuales como cuando quien hay he ha lei escribi dice dijo del este esta esto "
    "the of an and or in on to is are was were for with that this about where what which how when who did i my"
).split()

#: Query parameters that only track, and what such names start with.
TRACKING_PARAMS = (
    "fbclid gclid gclsrc dclid msclkid mc_cid mc_eid igshid ref_src ref_url ref_ yclid twclid wbraid gbraid ttclid li_fat_id srsltid _gl _ga "
    "_hsenc _hsmi vero_id vero_conv s_cid spm snr ser eid c2id mkt_tok trackingid refid"
).split()
#: A host name with a path or none, and the parts of a URL: scheme, authority, path, query.
HOSTLIKE = r"^([A-Za-z0-9]([A-Za-z0-9\-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(:\d+)?([/?#]|$)"
URL_PARTS = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
TRACKING_PREFIXES = ("utm_", "mc_", "_hs", "vero_", "trk")


def fold(text: Column) -> Column:
    """Lower case without accents, one character for one; letters outside :data:`ACCENTED` keep theirs."""
    return F.lower(F.translate(text, ACCENTED, PLAIN))


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def stem(word: Column) -> Column:
    """A prefix for search: ``es`` off words over five letters, else ``s`` off those over four."""
    n = F.length(word)
    return F.when((n > 5) & word.endswith("es"), word.substr(F.lit(1), n - 2)).when((n > 4) & word.endswith("s"), word.substr(F.lit(1), n - 1)).otherwise(word)


def build_postings(docs: DataFrame, doc_id: str, columns: list[str]) -> DataFrame:
    """``doc, column, term, tf, length``: each word of each column of each document, and the words of that column."""
    parts = F.array(*[F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("words")) for c in columns])
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(parts).alias("p")).select("doc", "p.column", F.size("p.words").cast("long").alias("length"), F.explode("p.words").alias("term"))
    return rows.groupBy("doc", "column", "term").agg(F.count("*").alias("tf"), F.first("length").alias("length"))


def document_lengths(docs: DataFrame, doc_id: str, postings: DataFrame, column: str) -> DataFrame:
    """``doc, length`` of every document, from the postings alone: no text is read again. Documents without words have length 0."""
    known = postings.where(F.col("column") == column).groupBy("doc").agg(F.max("length").alias("length"))
    return docs.select(F.col(doc_id).alias("doc")).join(known, "doc", "left").select("doc", F.coalesce("length", F.lit(0)).alias("length"))


def query_terms(queries: DataFrame, most: int = 12) -> DataFrame:
    """``query, term, place``: the first ``most`` distinct words of each query without stop words and single letters, or all where nothing else is left."""
    words = tokens(F.col("text"))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    kept = F.filter(words, lambda w: ~F.array_contains(stop, w) & (F.length(w) > 1))
    chosen = F.slice(F.array_distinct(F.when(F.size(kept) > 0, kept).otherwise(words)), 1, most)
    return queries.select("query", F.posexplode(chosen).alias("place", "term"))


def _beginnings(rows: DataFrame, column: str, of: DataFrame, name: str) -> DataFrame:
    """Rows with each beginning of ``column``, as ``name``, that is as long as a ``name`` in ``of``."""
    sizes = of.agg(F.collect_set(F.length(name)).alias("_sizes"))  # one row, with a number for each length
    cut = F.transform(F.filter("_sizes", lambda n: n <= F.length(column)), lambda n: F.substring(F.col(column), F.lit(1), n))
    return rows.crossJoin(F.broadcast(sizes)).withColumn(name, F.explode(cut)).drop("_sizes")


def match_terms(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """``query, term, doc, column, tf, length, word, whole``: postings that a query's term meets as a whole word, or whose word starts with its stem (terms of three letters or more).

    A word is joined by those of its beginnings that are as long as a stem, an equality with few terms, so postings that no term meets aren't moved.
    """
    stems = terms.select("query", "term", stem(F.col("term")).alias("stem")).where(F.length("term") >= 3)
    words = postings.withColumnRenamed("term", "word")
    columns = ["query", "term", "doc", "column", "tf", "length", "word"]
    by_stem = _beginnings(words, "word", stems, "stem").join(stems, "stem").select(*columns)
    exact = words.join(terms.select("query", "term"), F.col("word") == F.col("term")).select(*columns)
    return by_stem.unionAll(exact).distinct().withColumn("whole", F.col("word") == F.col("term"))


def search_docs(postings: DataFrame, queries: DataFrame) -> DataFrame:
    """``query, doc, rung``: the first of three rungs with a hit wins: all terms as whole words, all terms by stem, any term. ``queries`` (``query, text``) are few."""
    terms = query_terms(queries)
    number = terms.groupBy("query").agg(F.count("*").alias("n"))
    hits = match_terms(postings, terms).groupBy("query", "doc").agg(F.count_distinct(F.when(F.col("whole"), F.col("term"))).alias("whole"), F.count_distinct("term").alias("some"))
    rung = F.when(F.col("whole") == F.col("n"), 1).when(F.col("some") == F.col("n"), 2).otherwise(3)
    ranked = hits.join(number, "query").select("query", "doc", rung.alias("rung"))
    best = ranked.groupBy("query").agg(F.min("rung").alias("rung"))
    return ranked.join(best, ["query", "rung"]).select("query", "doc", "rung")


def bm25(postings: DataFrame, terms: DataFrame, documents: DataFrame, weights: dict[str, float], length_column: str, k1: float = 1.2, b: float = 0.75, floor: float = 0.1) -> DataFrame:
    """``query, doc, score``. ``terms``: ``query, term, prefix`` (few); ``documents``: every ``doc`` with ``length`` of the one column whose length counts. ``postings`` are read more than
    once, so they should be a table (:func:`orewright.plans.shared.materialize`), not a plan that parts the texts each time.

    The inverse document frequency is ``max(floor, ln(1 + (N - n + 0.5) / (n + 0.5)))``; a prefix term meets all words that start with it.
    """
    weight = F.create_map(*[x for c, w in weights.items() for x in (F.lit(c), F.lit(float(w)))])
    exact = postings.join(terms.where("not prefix").select("query", F.col("term").alias("t")), F.col("term") == F.col("t"))
    starts = terms.where("prefix").select("query", F.col("term").alias("t"))
    prefix = _beginnings(postings, "term", starts, "t").join(starts, "t")
    cols = ["query", "t", "doc", "column", "tf"]
    hits = exact.select(*cols, F.lit(False).alias("prefix")).unionAll(prefix.select(*cols, F.lit(True).alias("prefix"))).where(F.col("column").isin(list(weights)))
    hits = hits.groupBy("query", "t", "prefix", "doc", "column").agg(F.sum("tf").alias("tf"))
    totals = documents.agg(F.count("*").alias("total"), F.avg("length").alias("mean"))
    idf = hits.groupBy("query", "t", "prefix").agg(F.count_distinct("doc").alias("n")).crossJoin(F.broadcast(totals)).withColumn("idf", F.greatest(F.lit(floor), F.log(1 + (F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5))))
    norm = F.when(F.col("column") == length_column, k1 * (1 - b + b * F.coalesce(F.col("length") / F.col("mean"), F.lit(1.0)))).otherwise(k1)
    part = F.col("idf") * weight[F.col("column")] * F.col("tf") * (k1 + 1) / (F.col("tf") + norm)
    return hits.join(idf, ["query", "t", "prefix"]).join(documents.select("doc", "length"), "doc").groupBy("query", "doc").agg(F.sum(part).alias("score"))


def _by_rank(weight: Column, place: Column) -> Column:
    """Weight over k + rank. A rank of -k, which no engine gives but a table may hold, is infinitely good, as in IEEE division."""
    return F.when(place == 0, weight * float("inf")).otherwise(F.try_divide(weight, place))


def rrf(rankings: DataFrame, k: int = 60, by: tuple[str, ...] = ()) -> DataFrame:
    """Reciprocal rank fusion of ``list, id, rank, weight``, of each value of ``by``: ``id`` and the sum of weight over k + rank."""
    return rankings.groupBy(*by, "id").agg(F.sum(_by_rank(F.col("weight").cast("double"), k + F.col("rank"))).alias("score"), F.array_join(F.array_sort(F.collect_set("list")), ",").alias("lists"))


def hybrid_search(words: DataFrame, nearest: DataFrame, k: int = 60, most_words: int = 200, most_vectors: int = 50, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """``query, id, score, lists``: the best ``most_words`` documents of each query by words (``query, doc, score``, as :func:`bm25` gives) and the best ``most_vectors`` by vectors
    (``query, id, rank``, as :func:`vector_topk` gives), fused by their ranks. Each list is cut before rows are moved."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    ranked = words.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_words).select("query", F.lit("words").alias("list"), F.col("doc").alias("id"), "rank", F.lit(weights[0]).alias("weight"))
    near = nearest.where(F.col("rank") <= most_vectors).select("query", F.lit("vectors").alias("list"), "id", "rank", F.lit(weights[1]).alias("weight"))
    return rrf(ranked.unionByName(near), k, ("query",))


def rrf_urls(hits: DataFrame, k: int = 60) -> DataFrame:
    """Fuse hits of several engines (``engine, rank, url``) by URL key: the best rank of each engine counts, the best-ranked copy gives ``url``, and ``engines`` names them."""
    keyed = hits.withColumn("key", F.when(url_key(F.col("url")) != "", url_key(F.col("url"))).otherwise(F.col("url")))
    best = keyed.groupBy("key", "engine").agg(F.min(F.struct("rank", "url")).alias("m"))
    return best.groupBy("key").agg(F.sum(_by_rank(F.lit(1.0), k + F.col("m.rank"))).alias("score"), F.min("m").getField("url").alias("url"), F.array_join(F.array_sort(F.collect_set("engine")), ",").alias("engines"))


def minmax_fuse(scores: DataFrame) -> DataFrame:
    """Fuse ``list, id, score, weight``: each list scaled to 0 to 1 (a flat list counts 1), then summed by weight. Bounds come from an aggregate, so a long list stays spread."""
    bounds = scores.groupBy("list").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    scaled = F.when(F.col("hi") == F.col("lo"), 1.0).otherwise((F.col("score") - F.col("lo")) / (F.col("hi") - F.col("lo")))
    return scores.join(bounds, "list").groupBy("id").agg(F.sum(scaled * F.col("weight")).alias("score"))


def clean_text(text: Column) -> Column:
    """Line feeds alone, no NUL or invisible characters, single plain blanks and none beside a line end, words joined over a hyphen and a line end where the next line is lower
    case, at most one empty line in a row. Texts of 20 lines or more, over three fifths of them one word and half of them up to 14 characters, become one line."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, "[\\x00\u200b\u200c\u200d\u2060\ufeff\u00ad]", "")
    text = F.regexp_replace(text, "[ \t\u00a0\u2000-\u200a\u202f\u205f\u3000]+", " ")
    text = F.regexp_replace(text, r"(\p{L})-\n(\p{Ll})", "$1$2")
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    sizes = F.array_sort(F.transform(lines, lambda x: F.length(x)))
    single = F.size(F.filter(lines, lambda x: ~F.contains(F.trim(x), F.lit(" "))))
    n = F.size(lines)
    stacked = (n >= 20) & (single / n > 0.6) & (F.get(sizes, F.floor(n / 2).cast("int")) <= 14)
    return F.when(stacked, F.regexp_replace(text, r"\s*\n+\s*", " ")).otherwise(text)


def clean_corpus(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``clean`` and its size beside the text's."""
    return docs.withColumn("clean", clean_text(F.col(text))).withColumn("before", F.length(text)).withColumn("after", F.length("clean"))


def strip_repeated_lines(pages: DataFrame, group: str, page: str, text: str = "text", share: float = 0.5, longest: int = 160, least: int = 3) -> DataFrame:
    """``group, page, text`` without the lines that, digits masked and case aside, stand on over ``share`` of the pages of a group of ``least`` pages or more."""
    lines = pages.select(group, page, F.posexplode(F.split(text, "\n")).alias("at", "line")).withColumn("key", F.regexp_replace(F.lower(F.trim("line")), r"\d+", "#"))
    number = pages.groupBy(group).agg(F.count_distinct(page).alias("pages"))
    common = lines.where((F.col("key") != "") & (F.length("key") <= longest)).groupBy(group, "key").agg(F.count_distinct(page).alias("on")).join(number, group).where((F.col("pages") >= least) & (F.col("on") > share * F.col("pages"))).select(group, "key")
    kept = lines.join(common, [group, "key"], "left_anti").groupBy(group, page).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return pages.select(group, page).join(kept, [group, page], "left").select(group, page, F.coalesce("text", F.lit("")).alias("text"))


def diff_lines(old: DataFrame, new: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``key, change, line``: lines that only the new (``added``) or the old version has (``removed``), blanks normalised, order and repetition aside."""
    def lines(df):
        split = df.select(key, F.explode(F.split(text, "\n")).alias("line"))
        return split.select(key, F.trim(F.regexp_replace("line", r"\s+", " ")).alias("line")).where("line <> ''").distinct()

    a, b = lines(old), lines(new)
    return b.join(a, [key, "line"], "left_anti").select(key, F.lit("added").alias("change"), "line").unionAll(a.join(b, [key, "line"], "left_anti").select(key, F.lit("removed").alias("change"), "line"))


#: Words of menus and footers.
MENU_WORDS = """
inicio home menú menu categorías categorias buscar búsqueda busqueda login registro registrarse cuenta
carrito cesta pedidos favoritos wishlist ayuda contacto contáctanos contactanos envíos envios devoluciones
cookies privacidad aviso legal términos terminos condiciones política politica mapa sitio newsletter suscríbete
suscribete síguenos siguenos facebook instagram twitter youtube tiktok pinterest whatsapp idioma país pais
ofertas novedades outlet tiendas blog trabaja sobre nosotros empresa prensa afiliados sign account cart search
help shipping returns terms privacy careers stores
""".split()
#: What a page says that lets nobody in.
BLOCK_PHRASES = [
    "enable javascript", "captcha", "access denied", "verify you are human", "just a moment", "acceso denegado",
    "activa javascript", "not a robot", "checking your browser", "unusual traffic",
]
#: Line ends of any kind, as an expression.
LINE_ENDS = r"\R|[\x1c-\x1e]"


def page_quality(texts: DataFrame, text: str = "text", min_words: int = 40) -> DataFrame:
    """Adds ``words``, ``short_lines`` (share of lines of at most three words), ``chrome`` (share of words in lines of at most four with a word of menus; 1 without words) and ``quality``.

    In this order: ``blocked page`` (under 150 words, and a phrase of such pages within the first 800 characters), ``too short`` (under ``min_words``),
    ``mostly navigation`` (over 0.85 of the lines short and under 400 words, or ``chrome`` of 0.6 at least), else ``ok``.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, LINE_ENDS), lambda x: x.rlike(r"(?U)\S"))
    long = F.size(F.filter(lines, lambda x: F.regexp_count(x, F.lit(r"(?U)\S+")) > 3))
    of = F.transform(lines, lambda x: F.regexp_extract_all(F.lower(x), F.lit(r"([\p{L}\p{Nl}\p{No}]+)"), F.lit(1)))
    menu = F.array(*[F.lit(w) for w in MENU_WORDS])
    count = lambda words: F.aggregate(words, F.lit(0), lambda s, w: s + F.size(w))
    whole, own = count(of), count(F.filter(of, lambda w: (F.size(w) <= 4) & F.arrays_overlap(w, menu)))
    out = texts.withColumns(
        {
            "words": F.regexp_count(body, F.lit(r"(?U)\S+")).cast("long"),
            "short_lines": F.when(F.size(lines) > 0, F.round(1 - long / F.size(lines), 6)).otherwise(0.0),
            "chrome": F.when(whole > 0, F.round(own / whole, 6)).otherwise(1.0),
        }
    )
    start = F.lower(F.substring(body, 1, 800))
    blocked = F.greatest(*[F.contains(start, F.lit(p)) for p in BLOCK_PHRASES])
    navigation = ((F.col("short_lines") > 0.85) & (F.col("words") < 400)) | (F.col("chrome") >= 0.6)
    return out.withColumn("quality", F.when((F.col("words") < 150) & blocked, "blocked page").when(F.col("words") < min_words, "too short").when(navigation, "mostly navigation").otherwise("ok"))


def quality_census(pages: DataFrame, url: str, text: str) -> DataFrame:
    """``domain, quality, n`` of pages by :func:`page_quality`."""
    return page_quality(pages, text).groupBy(registrable_domain(F.lower(F.regexp_extract(F.col(url), r"^[A-Za-z]+://(?:[^/@]*@)?([^/:?#]+)", 1))).alias("domain"), "quality").agg(F.count("*").alias("n"))


#: Letters and signs of other forms and the usual one for each, one character for one.
_USUAL = {c: unicodedata.normalize("NFKC", c) for c in map(chr, [*range(0xA0, 0x250), *range(0x2000, 0x3400), *range(0xF900, 0xFFF0)]) if len(unicodedata.normalize("NFKC", c)) == 1 and unicodedata.normalize("NFKC", c) != c}
FORMS, USUAL = "".join(_USUAL), "".join(_USUAL.values())
#: Units of time, and words around a time that passes.
UNITS = "segundo segundos seg segs minuto minutos min mins hora horas hr hrs h dia dias día días semana semanas mes meses second seconds sec secs minute minutes hour hours day days week weeks month months".split()
BEFORE_SPAN = "hace queda quedan falta faltan".split()
AFTER_SPAN = "ago left remaining".split()
MOMENTS = ["just now", "justo ahora", "ahora mismo", "hace un momento"]
PASSING_LINES = ["©", "(c)", "copyright", "hoy es", "actualizado hace"]


def _passing() -> tuple[str, list[str]]:
    """Expressions for lines that pass, and for what passes within lines: stamps, spans, clocks, tokens."""
    any_of = lambda words: "(?:" + "|".join(sorted(words, key=len, reverse=True)) + ")"
    whole = lambda form: rf"(?<![\p{{L}}\p{{N}}_]){form}"
    edge = r"(?![\p{L}\p{N}_])"
    ago = rf"[0-9]+ {any_of(UNITS)} ago{edge}"
    starts = any_of([re.sub(r"([()])", r"[\1]", w) + (edge if w[-1].isalpha() else "") for w in PASSING_LINES] + [rf"updated [0-9]+ [\p{{L}}\p{{N}}_]+ ago{edge}", rf"last updated:? ?(?:just now|[0-9]+ [\p{{L}}\p{{N}}_]+ ago){edge}"])
    day, clock = "[0-9]{4}-[0-9]{2}-[0-9]{2}", "[0-9]{2}:[0-9]{2}(?::[0-9]{2})?"
    within = [
        whole(rf"{day}[t ]{clock}(?:[.,][0-9]+)?(?:z|[+-][0-9]{{2}}:?[0-9]{{2}})?(?![0-9])"),
        whole(rf"(?:{any_of(BEFORE_SPAN)} [0-9]+ {any_of(UNITS)}{edge}|{ago.replace('ago', any_of(AFTER_SPAN))}|{any_of(MOMENTS)}{edge})"),
        whole(r"[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?(?: ?[ap][.]?m[.]?)?(?![0-9])"),
        whole(rf"[0-9a-f]{{16,}}{edge}"),
    ]
    return f"^{starts}", within


def steady_sql(text: str) -> str:
    """SQL for the text without what changes by itself: usual forms in lower case, blanks single; stamps, clock times, spans of time and long hexadecimal tokens go,
    and so do lines of copyright or of the last update. All other digits, and letters of all scripts, stay. Characters that are several in their usual form stay as they are."""
    lines, within = _passing()
    squeeze = lambda x: f"trim(regexp_replace({x}, '(?U)\\\\s+', ' '))"
    usual = f"lower(translate({text}, {quoted(FORMS)}, {quoted(USUAL)}))"
    plain = f"transform(split({usual}, {quoted(LINE_ENDS)}), x -> {squeeze('regexp_replace(x, ' + quoted('[' + chr(0x200B) + chr(0x200C) + chr(0xFEFF) + ']') + ', ' + quoted('') + ')')})"
    kept = f"filter({plain}, x -> x <> '' AND NOT rlike(x, {quoted(lines)}))"
    bare = "x"
    for form in within:
        bare = f"regexp_replace({bare}, {quoted(form)}, ' ')"
    return f"array_join(filter(transform({kept}, x -> {squeeze(bare)}), x -> x <> ''), '\n')"


def content_groups(pages: DataFrame, key: str, text: str) -> DataFrame:
    """``digest, n, first``: pages by a hash of :func:`steady_sql` of their text."""
    rows = pages.select(F.col(key).alias("_key"), F.coalesce(text, F.lit("")).alias("_text"))
    return rows.groupBy(F.sha2(F.expr(steady_sql("_text")), 256).alias("digest")).agg(F.count("*").alias("n"), F.min("_key").alias("first"))


def normalize_url(url: Column, strip_www: bool = False, drop: tuple[str, ...] = ()) -> Column:
    """The canonical form of an http(s) URL, else an empty string: lower-case scheme and host, no default port, credentials, fragment, tracking parameters or trailing slash, parameters in order."""
    bare = F.trim(url)
    bare = F.when(F.startswith(bare, F.lit("//")), F.concat(F.lit("https:"), bare)).when(~F.contains(bare, F.lit("://")) & bare.rlike(HOSTLIKE), F.concat(F.lit("https://"), bare)).otherwise(bare)
    part = lambda n: F.regexp_extract(bare, URL_PARTS, n)
    scheme, authority = F.lower(part(1)), F.regexp_replace(part(2), r"^.*@", "")
    host = F.lower(F.regexp_replace(F.regexp_replace(authority, r":\d*$", ""), r"\.$", ""))
    host = F.regexp_replace(host, r"^www\.", "") if strip_www else host
    port = F.regexp_replace(F.regexp_extract(authority, r":(\d+)$", 1), "^0+", "")
    port = F.when((port == "") | ((scheme == "http") & (port == "80")) | ((scheme == "https") & (port == "443")), "").otherwise(F.concat(F.lit(":"), port))
    path = F.regexp_replace(part(3), "/+$", "")
    name = lambda p: F.lower(F.split_part(p, F.lit("="), F.lit(1)))
    gone = F.array(*[F.lit(x) for x in (*TRACKING_PARAMS, *drop)])
    tracks = lambda p: F.array_contains(gone, name(p)) | name(p).rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")
    params = F.transform(F.array_sort(F.transform(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~tracks(p)), lambda p: F.struct(F.split_part(p, F.lit("="), F.lit(1)).alias("n"), p.alias("p")))), lambda x: x["p"])
    query = F.when(F.size(params) > 0, F.concat(F.lit("?"), F.array_join(params, "&"))).otherwise("")
    return F.when(scheme.isin("http", "https") & (host != ""), F.concat(scheme, F.lit("://"), host, port, path, query)).otherwise("")


def url_key(url: Column) -> Column:
    """The normalised URL without scheme and ``www.``."""
    return F.regexp_replace(normalize_url(url, strip_www=True), r"^https?://", "")


def dedupe_urls(rows: DataFrame, col: str, order: str) -> DataFrame:
    """The first row of each URL key, with ``copies``; rows whose URL doesn't normalise stand alone."""
    keyed = rows.withColumn("key", url_key(F.col(col)))
    own = Window.partitionBy(F.when(F.col("key") == "", F.concat(F.lit("row "), F.col(order).cast("string"))).otherwise(F.col("key")))
    return keyed.withColumn("_n", F.row_number().over(own.orderBy(order))).withColumn("copies", F.count("*").over(own)).where("_n = 1").drop("_n")


#: Public suffixes of two labels.
PUBLIC_SUFFIXES = """
com.es org.es nom.es gob.es edu.es
co.uk org.uk gov.uk ac.uk me.uk ltd.uk plc.uk net.uk sch.uk nhs.uk police.uk
com.au net.au org.au edu.au gov.au id.au asn.au
co.nz org.nz govt.nz ac.nz net.nz school.nz
com.br org.br gov.br net.br edu.br
com.mx org.mx gob.mx edu.mx net.mx
com.ar gob.ar org.ar net.ar edu.ar gov.ar
com.co org.co gov.co edu.co net.co
com.pe gob.pe org.pe edu.pe
com.ve com.uy com.ec com.bo com.py com.gt com.pa
co.jp or.jp ne.jp ac.jp go.jp
com.cn org.cn net.cn gov.cn edu.cn
co.in net.in org.in gov.in ac.in
co.za org.za gov.za ac.za net.za
com.tr org.tr gov.tr edu.tr
com.pl org.pl net.pl edu.pl gov.pl
com.pt org.pt gov.pt edu.pt
gouv.fr asso.fr com.fr
gov.it edu.it
co.kr or.kr go.kr ac.kr
com.hk org.hk gov.hk edu.hk
com.sg org.sg gov.sg edu.sg
com.my gov.my edu.my
co.id or.id go.id ac.id
co.th ac.th go.th
com.ph org.ph gov.ph edu.ph
com.vn gov.vn
co.il org.il gov.il ac.il
co.ae com.sa com.eg com.ng co.ke co.tz
com.ua org.ua
com.ru
""".split()


def registrable_domain(host: Column, extra: tuple[str, ...] = ()) -> Column:
    """The name that was registered: the public suffix and one label before it. Suffixes are one label, or one of :data:`PUBLIC_SUFFIXES`, or one of ``extra`` (two labels or three).

    Addresses and names of one label or two stay as they are; an empty host is null.
    """
    name = F.regexp_replace(F.lower(F.trim(host)), r"\.+$", "")
    labels = F.split(name, r"\.")
    n = F.size(labels)
    last = lambda k: F.array_join(F.slice(labels, F.greatest(n - k + 1, F.lit(1)), F.lit(k)), ".")
    address = name.rlike(r"^(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)$") | name.contains(":")
    out = F.when(name == "", None).when(address | (n <= 2), name)
    if extra:
        out = out.when((n > 3) & last(3).isin(list(extra)), last(4))
    return out.when(last(2).isin([*PUBLIC_SUFFIXES, *extra]), last(3)).otherwise(last(2))


def by_domain(rows: DataFrame, col: str) -> DataFrame:
    """``domain, n`` of the registrable domains of a column of URLs."""
    host = F.regexp_extract(F.col(col), r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return rows.groupBy(registrable_domain(host).alias("domain")).agg(F.count("*").alias("n"))


def hash_near_pairs(hashes: DataFrame, most: int = 6) -> DataFrame:
    """Links ``a < b`` of 64-bit hashes that differ in at most ``most`` bits, with ``bits``: each id to the least id of its hash (0 bits), and between the least ids of different hashes.

    So copies cost a link each, not a pair each. Hashes are cut into ``most // 2 + 1`` bands as even as can be; of two that are near, some band differs in one bit at most, so
    one side is joined by its bands and the other by its bands and each of them with one bit turned.
    """
    least = hashes.groupBy("h").agg(F.min("id").alias("least"))
    copies = hashes.hint("merge").join(least, "h").where("id <> least").select(F.col("least").alias("a"), F.col("id").alias("b"), F.lit(0).alias("bits"))
    bands = most // 2 + 1
    cuts = [64 * i // bands for i in range(bands + 1)]
    band = lambda i: F.shiftrightunsigned("h", cuts[i]).bitwiseAND(F.lit((1 << (cuts[i + 1] - cuts[i])) - 1).cast("long")) if bands > 1 else F.col("h")
    one = [F.struct(F.lit(i).alias("band"), band(i).alias("value")) for i in range(bands)]

    def turn(i: int):
        return lambda k: F.struct(F.lit(i).alias("band"), band(i).bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k)).alias("value"))

    turned = [F.transform(F.sequence(F.lit(0), F.lit(cuts[i + 1] - cuts[i] - 1)), turn(i)) for i in range(bands)]
    left = least.select(F.col("least").alias("x"), F.col("h").alias("hx"), F.explode(F.array(*one)).alias("k"))
    right = least.select(F.col("least").alias("y"), F.col("h").alias("hy"), F.explode(F.concat(F.array(*one), *turned)).alias("k")).hint("merge")  # 64 rows a hash and more, which Spark takes for one and would send to the driver
    bits = F.bit_count(F.col("hx").bitwiseXOR(F.col("hy")))
    near = left.join(right, "k").where(F.col("x") < F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b"), bits.alias("bits"))  # the band's distance is the same both ways
    return near.where(F.col("bits") <= most).distinct().unionAll(copies)
