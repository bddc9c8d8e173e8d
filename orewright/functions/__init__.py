"""Scalar helpers and table functions for use in SQL."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.operators.amounts import cents_sql, quoted
from orewright.operators.extract import cut_points, mask_string, scan_pii
from orewright.operators.mentions import find_dates, find_prices
from orewright.operators.text import ACCENTED, HOSTLIKE, PLAIN, TRACKING_PARAMS, TRACKING_PREFIXES, URL_PARTS, steady_sql


def _url_key(u: str) -> str:
    """The SQL of :func:`orewright.operators.text.url_key` for the expression ``u``."""
    names = ", ".join(quoted(x) for x in TRACKING_PARAMS)
    bare = f"trim({u})"
    bare = f"CASE WHEN startswith({bare}, '//') THEN concat('https:', {bare}) WHEN NOT contains({bare}, '://') AND rlike({bare}, {quoted(HOSTLIKE)}) THEN concat('https://', {bare}) ELSE {bare} END"
    part = lambda n: f"regexp_extract(b, {quoted(URL_PARTS)}, {n})"
    host = f"regexp_replace(lower(regexp_replace(regexp_replace(p.a, ':\\\\d*$', ''), '[.]$', '')), '^www[.]', '')"
    port = "regexp_replace(regexp_extract(p.a, ':(\\\\d+)$', 1), '^0+', '')"
    tracks = f"array_contains(array({names}), lower(split_part(x, '=', 1))) OR rlike(lower(split_part(x, '=', 1)), '^({'|'.join(TRACKING_PREFIXES)})')"
    kept = f"transform(array_sort(transform(filter(split(p.q, '&'), x -> x <> '' AND NOT ({tracks})), x -> struct(split_part(x, '=', 1) AS n, x AS p))), x -> x.p)"
    made = f"concat(p.h, CASE WHEN p.o = '' OR (p.s = 'http' AND p.o = '80') OR (p.s = 'https' AND p.o = '443') THEN '' ELSE concat(':', p.o) END, regexp_replace(p.p, '/+$', ''), CASE WHEN size(p.k) > 0 THEN concat('?', array_join(p.k, '&')) ELSE '' END)"
    # one step after another, each over an array of one, so that no step is written or done twice
    steps = f"transform(array({bare}), b -> struct(lower({part(1)}) AS s, regexp_replace({part(2)}, '^.*@', '') AS a, {part(3)} AS p, {part(4)} AS q))"
    steps = f"transform({steps}, p -> struct(p.s AS s, {host} AS h, {port} AS o, p.p AS p, {kept} AS k))"
    return f"transform({steps}, p -> CASE WHEN p.s IN ('http', 'https') AND p.h <> '' THEN {made} ELSE '' END)[0]"


def register_functions(spark: SparkSession) -> None:
    """SQL functions ``fold``, ``stem``, ``url_key``, ``content_hash``, ``mask_text`` and ``parse_amount`` (``text, decimal mark``: cents), null for null.

    All but ``mask_text``, whose checks need a loop, are SQL over built-in functions, so a query with them stays in one plan and in generated code; they say what the columns of the operators say.
    """
    bodies = {
        "fold(t STRING) RETURNS STRING": f"lower(translate(t, {quoted(ACCENTED)}, {quoted(PLAIN)}))",
        "stem(t STRING) RETURNS STRING": "CASE WHEN length(t) > 5 AND endswith(t, 'es') THEN left(t, length(t) - 2) WHEN length(t) > 4 AND endswith(t, 's') THEN left(t, length(t) - 1) ELSE t END",
        "content_hash(t STRING) RETURNS STRING": f"sha2({steady_sql('t')}, 256)",
        "url_key(t STRING) RETURNS STRING": _url_key("t"),
        "parse_amount(t STRING, mark STRING) RETURNS BIGINT": cents_sql("t", "mark"),
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
    spark.udf.register("mask_text", F.pandas_udf(lambda values: values.map(mask_string), T.StringType()))


class ChunkText:
    """``chunk_text(text, size, overlap)``: rows ``n, start, end, chunk``."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        for n, (a, b) in enumerate(cut_points(text or "", size, overlap)):
            yield n, a, b, text[a:b]


class ScanPii:
    """``scan_pii(text)``: rows ``kind, value`` of personal data that passes its checks."""

    def eval(self, text: str) -> Iterator[tuple]:
        for a, b, kind in scan_pii(text or ""):
            yield kind, text[a:b]


class FindDates:
    """``find_dates(text, today)``: rows ``start, value, role`` of dates, those without a year resolved by ``today``."""

    def eval(self, text: str, today: dt.date) -> Iterator[tuple]:
        for a, _, date, role in find_dates(text or "", today):
            yield a, date, role


class FindPrices:
    """``find_prices(text)``: rows ``start, cents, currency, label`` of prices."""

    def eval(self, text: str) -> Iterator[tuple]:
        for a, _, cents, currency, label in find_prices(text or ""):
            yield a, cents, currency, label


def register_table_functions(spark: SparkSession) -> None:
    """SQL table functions ``chunk_text``, ``scan_pii``, ``find_dates``, ``find_prices``, for ``LATERAL`` use."""
    for name, kind, schema in (("chunk_text", ChunkText, "n int, start int, end int, chunk string"), ("scan_pii", ScanPii, "kind string, value string"), ("find_dates", FindDates, "start int, value date, role string"), ("find_prices", FindPrices, "start int, cents bigint, currency string, label string")):
        spark.udtf.register(name, F.udtf(kind, returnType=schema))
