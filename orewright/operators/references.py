"""Numbers of parcels and products in texts: check digits and rules as column expressions, evidence in order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orewright.operators.entities import valid_ean, valid_isbn

#: Carriers of international numbers by country, weights of their check digit.
S10_CARRIERS = {"ES": "correos", "CN": "chinapost", "GB": "royalmail", "DE": "deutschepost", "NL": "postnl", "FR": "laposte"}
S10_WEIGHTS = [8, 6, 4, 2, 3, 5, 9, 7]
#: Forms of numbers in order: carrier, how sure it is, what stands first, the least and most digits behind it, what may follow.
FORMS = [
    ("postnl", 85, "3S[A-Z]{4}", 6, 29, ""),
    ("dhl", 88, "JJD", 15, 24, ""),
    ("dhl", 88, "JVGL", 8, 20, ""),
    ("dhl", 88, "GM", 16, 22, ""),
    ("dhl", 88, "00340", 15, 15, ""),
    ("yunexpress", 92, "YT", 16, 16, ""),
    ("cainiao", 75, "(LP|CN|CAINIAO)", 12, 20, "[A-Z]{0,2}"),
    ("amazon", 85, "TBA", 9, 14, ""),
]
#: What stands in front of product numbers in links.
ASIN_LINKS = ["/dp/", "/gp/product/", "/gp/aw/d/", "/product-reviews/", "/exec/obidos/asin/"]
SKU_LINKS = ["/p/", "/product/", "/producto/", "/ip/", "sku=", "pid=", "id="]


def _values(number: Column, first: int, n: int, letter: int) -> Column:
    """Digits of a part of a number; a letter counts as its code less ``letter``, by 10."""
    return F.transform(F.split(F.substring(number, first, n), ""), lambda c: F.coalesce(c.try_cast("int"), (F.ascii(c) - letter) % 10))


def bare_number(text: Column) -> Column:
    """Upper case without blanks and hyphens."""
    return F.upper(F.regexp_replace(text, r"[\s-]", ""))


def valid_ups(number: Column) -> Column:
    """``1Z``, 15 digits or letters and their check digit: every second one counts twice."""
    values = _values(number, 3, 15, 63)
    total = F.aggregate(F.transform(values, lambda v, i: v * (1 + i % 2)), F.lit(0), lambda s, v: s + v)
    return number.rlike("^1Z[0-9A-Z]{15}[0-9]$") & ((10 - total % 10) % 10 == F.coalesce(F.substring(number, 18, 1).try_cast("int"), F.lit(-1)))


def valid_s10(number: Column) -> Column:
    """Two letters, eight digits, their weighted sum by 11 as a check digit (10 is 0, 11 is 5), and a country."""
    values = _values(number, 3, 8, 0)
    total = F.aggregate(F.zip_with(values, F.array(*[F.lit(w) for w in S10_WEIGHTS]), lambda v, w: F.coalesce(v * w, F.lit(0))), F.lit(0), lambda s, v: s + v)
    rest = 11 - total % 11
    due = F.when(rest == 10, 0).when(rest == 11, 5).otherwise(rest)
    return number.rlike("^[A-Z]{2}[0-9]{9}[A-Z]{2}$") & (due == F.coalesce(F.substring(number, 11, 1).try_cast("int"), F.lit(-1)))


def classify_parcel(text: Column) -> Column:
    """``carrier, confidence`` of a number by its form alone; an empty carrier and 0 where it says nothing."""
    n = bare_number(text)
    country = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in S10_CARRIERS.items() for x in pair]), F.right(n, F.lit(2))), F.lit("other"))
    found = lambda carrier, sure: F.struct((carrier if isinstance(carrier, Column) else F.lit(carrier)).alias("carrier"), F.lit(sure).alias("confidence"))
    rules = [(valid_ups(n), found("ups", 98)), (n.rlike("^1Z[0-9A-Z]{16}$"), found("ups", 70)), (valid_s10(n), found(country, 92))]
    rules += [(n.rlike(f"^{lead}[0-9]{{{least},{most}}}{tail}$"), found(carrier, sure)) for carrier, sure, lead, least, most, tail in FORMS]
    rules.append((n.rlike("^P[A-Z0-9]{16,23}$") & n.rlike("[0-9]{5}"), found("correos", 72)))
    return reduce(lambda out, rule: F.when(rule[0], rule[1]).otherwise(out), reversed(rules), found("", 0))


def tracking_numbers(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, number, carrier, confidence``: each number in each text that its form says to be a parcel's. Numbers that only a word in front of them would tell are left out."""
    tokens = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![A-Za-z0-9])([A-Z0-9]{8,35})(?![A-Za-z0-9])"), F.lit(1)))
    rows = docs.select(F.col(doc_id).alias("doc"), F.explode(F.filter(tokens, lambda t: t.rlike("[0-9]{4}"))).alias("number"))
    return rows.withColumn("c", classify_parcel(F.col("number"))).select("doc", "number", "c.carrier", "c.confidence").where("confidence > 0")


def product_ids(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc, kind, value``, each once: ``ean`` (8, 12, 13 or 14 digits with a right check digit), ``isbn`` (such ones that begin with 978 or 979, and valid ones after the word), ``asin`` (behind its links, or bare from ``B0``), ``sku`` (behind links, with a digit)."""
    body = F.coalesce(F.col(text), F.lit(""))
    every = lambda form: F.regexp_extract_all(body, F.lit(form), F.lit(1))
    behind = lambda links: "(?:" + "|".join(x.replace("/", "[/]") for x in links) + ")"
    ean = F.filter(every("(?<![0-9])([0-9]{8,14})(?![0-9])"), valid_ean)
    told = F.filter(F.transform(every(r"(?i)isbn(?:-1[03])?[^0-9]{0,8}([0-9][0-9 -]{8,16}[0-9X])"), lambda v: F.upper(F.regexp_replace(v, "[ -]", ""))), valid_isbn)
    isbn = F.concat(F.filter(ean, lambda v: v.rlike("^97[89][0-9]{10}$")), told)
    asin = F.concat(F.transform(every(f"{behind(ASIN_LINKS)}([A-Za-z0-9]{{10}})(?![A-Za-z0-9])"), F.upper), every("(?<![A-Za-z0-9])(B0[A-Z0-9]{8})(?![A-Za-z0-9])"))
    sku = F.array_except(F.filter(F.transform(every(f"(?i){behind(SKU_LINKS)}([A-Za-z0-9_-]{{5,}})"), F.upper), lambda v: v.rlike("[0-9]")), asin)

    def as_kind(kind: str, values: Column) -> Column:
        return F.transform(F.array_distinct(values), lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    found = [as_kind(kind, values) for kind, values in (("ean", ean), ("isbn", isbn), ("asin", asin), ("sku", sku))]
    return docs.select(F.col(doc_id).alias("doc"), F.explode(F.concat(*found)).alias("r")).select("doc", "r.*")


def reference_kinds(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``kind, carrier, n, docs``: parcels by carrier and products by kind."""
    parcels = tracking_numbers(docs, doc_id, text).select("doc", F.lit("parcel").alias("kind"), "carrier")
    return parcels.unionByName(product_ids(docs, doc_id, text).select("doc", "kind", F.lit("").alias("carrier"))).groupBy("kind", "carrier").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))
