"""Names in other names and in texts: matching to a list, and mentions of a dictionary's entities.

Runs of words are made only of the lengths that names have, and meet them by equality, so names may have any number of words and a list any number of names.
"""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orewright.operators.text import tokens


@dataclass(frozen=True)
class MatchOptions:
    """What doesn't matter when names are compared, and whether a member's name within a longer one counts."""

    case: bool = True
    accents: bool = True
    separators: bool = True
    number_prefix: bool = True
    contains: bool = True


#: Signs that are words.
SIGNS = {"♀": " f ", "♂": " m "}
#: Marks that are dropped without a gap.
SILENT = "'’´`."


def split_name(name: str | None, options: MatchOptions = MatchOptions()) -> list[str]:
    """The words of a name that count; numbers in front of other words don't."""
    plain = unicodedata.normalize("NFKC", name or "")
    for sign, word in SIGNS.items():
        plain = plain.replace(sign, word)
    if options.accents:
        plain = "".join(c for c in unicodedata.normalize("NFKD", plain) if not unicodedata.combining(c))
    plain = plain.casefold() if options.case else plain
    if options.separators:
        words = re.findall(r"[^\W_]+", plain.translate(dict.fromkeys(map(ord, SILENT))))
    else:
        words = plain.split()
    first = next((i for i, w in enumerate(words) if not w.isdigit()), 0) if options.number_prefix else 0
    return words[first:]


def name_words(name: Column, options: MatchOptions = MatchOptions()) -> Column:
    """:func:`split_name` of a column, in Arrow batches."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def words(names: pd.Series) -> pd.Series:
        return names.map(lambda n: split_name(n, options))

    return words(name)


def _lengths(keys: DataFrame) -> list[int]:
    """The numbers of words that occur: at most as many as the longest name has words."""
    return sorted(r[0] for r in keys.select("n").distinct().collect())


def _runs(words: str, lengths: list[int]) -> Column:
    """All runs of the given lengths: ``at``, ``n``, ``key``."""

    def of(n: int) -> Column:
        run = lambda i: F.struct(i.alias("at"), F.lit(n).alias("n"), F.array_join(F.slice(words, i + 1, n), " ").alias("key"))
        return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(0), F.size(words) - n), run))

    return F.explode(F.flatten(F.array_compact(F.array(*[of(n) for n in lengths]))))


def match_names(items: DataFrame, members: DataFrame, aliases: DataFrame, options: MatchOptions = MatchOptions(), candidates: int = 8) -> DataFrame:
    """``id, member, how, candidates``: each item (``id, name``, and ``is_dir`` if only files have endings) to a member (``member, name``).

    ``exact``: its words are a member's, written together; ``alias``: those of an alias (``member, alias``); ``span``: the most words in a row that are a member's
    or an alias's (then ``alias``), of three letters at least. Equally good members are ``ambiguous``, with the first of them as ``candidates``; the rest is ``none``.
    """
    ending = F.regexp_replace("name", r"^(.+)\.[^.]+$", "$1")
    stem = F.when(F.col("is_dir"), F.col("name")).otherwise(ending) if "is_dir" in items.columns else ending
    own = items.select("id", name_words(stem, options).alias("w")).where(F.size("w") > 0)
    keys = members.select("member", name_words(F.col("name"), options).alias("w"), F.lit(1).alias("kind")).unionAll(aliases.select("member", name_words(F.col("alias"), options), F.lit(2)))
    keys = keys.where(F.size("w") > 0).select("member", "kind", F.size("w").alias("n"), F.array_join("w", "").alias("glued"), F.array_join("w", " ").alias("key"))

    glued = own.select("id", F.array_join("w", "").alias("glued")).join(keys.select("glued", "member", "kind"), "glued")
    exact = glued.groupBy("id", "member").agg(F.min("kind").alias("kind")).select("id", "member", "kind", F.lit("exact").alias("how"))
    hits = exact
    parts = keys.where(F.length("glued") >= 3).select("member", "kind", "n", "key")
    lengths = _lengths(parts) if options.contains else []
    if lengths:
        rest = own.join(exact.select("id").distinct(), "id", "left_anti")
        found = rest.select("id", _runs("w", lengths).alias("r")).select("id", "r.*").join(parts.drop("n"), "key")
        best = found.groupBy("id", "member").agg(F.min(F.struct((-F.col("n")).alias("n"), "at", "kind")).alias("b")).select("id", "member", F.col("b.n").alias("n"), F.col("b.kind").alias("kind"))
        most = best.groupBy("id").agg(F.min("n").alias("n"))
        hits = exact.unionByName(best.join(most, ["id", "n"]).select("id", "member", "kind", F.lit("span").alias("how")))
    top = hits.groupBy("id").agg(F.count("*").alias("k"), F.min("member").alias("member"), F.first("kind").alias("kind"), F.first("how").alias("how"), F.slice(F.array_sort(F.collect_list("member")), 1, candidates).alias("candidates"))
    how = F.when(F.col("k").isNull(), "none").when(F.col("k") > 1, "ambiguous").when(F.col("kind") == 2, "alias").otherwise(F.col("how"))
    return items.select("id").join(top, "id", "left").select("id", F.when(F.col("k") == 1, F.col("member")).alias("member"), how.alias("how"), F.when(F.col("k") > 1, F.col("candidates")).alias("candidates"))


def find_mentions(docs: DataFrame, dictionary: DataFrame, doc_id: str, text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``doc, entity, at, n``: the first mention of each entity (``entity, name``; it may have several names) in each text, in words; of names that begin at one word the longest.

    A first mention inside a longer one of another entity is dropped. ``keep`` are columns of the document that stay. Names without a word are never found.
    """
    names = dictionary.select("entity", tokens(F.col("name")).alias("w")).where(F.size("w") > 0).select("entity", F.size("w").alias("n"), F.array_join("w", " ").alias("key")).distinct()
    lengths = _lengths(names)
    words = docs.select(F.col(doc_id).alias("doc"), *keep, tokens(F.col(text)).alias("w"))
    if not lengths:
        return words.join(names.select("entity"), F.lit(False)).select("doc", *keep, "entity", F.lit(0).alias("at"), F.lit(0).alias("n"))
    found = words.select("doc", *keep, _runs("w", lengths).alias("r")).select("doc", *keep, "r.*").join(names.select("entity", "key"), "key")
    first = found.groupBy("doc", *keep, "entity").agg(F.min(F.struct("at", (-F.col("n")).alias("n"))).alias("b")).select("doc", *keep, "entity", F.col("b.at").alias("at"), (-F.col("b.n")).alias("n"))
    a, b = first.alias("a"), first.alias("b")
    same = reduce(Column.__and__, [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc", *keep)])
    inside = (F.col("b.n") > F.col("a.n")) & (F.col("b.at") <= F.col("a.at")) & (F.col("a.at") + F.col("a.n") <= F.col("b.at") + F.col("b.n"))
    return a.join(b, same & inside, "left_anti")


def mention_counts(docs: DataFrame, dictionary: DataFrame, doc_id: str, text: str = "text", by: tuple[str, ...] = ()) -> DataFrame:
    """``entity``, the columns in ``by`` and ``docs``: how many documents name each entity, as :func:`find_mentions` has it."""
    return find_mentions(docs, dictionary, doc_id, text, by).groupBy("entity", *by).agg(F.count_distinct("doc").alias("docs"))
