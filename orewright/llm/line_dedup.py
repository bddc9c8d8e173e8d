"""Lines that many documents share are dropped from all of them but one.

A line's key is the line without blanks at both ends and with A-Z in lower case. Keys meet by 128 bits of hash, as pairs of key and document that are
counted before they move, so a line that a third of all documents holds is a few rows of each task. Texts move once, to meet the places of their dropped lines.
"""

from __future__ import annotations

import string

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters that count as blanks at the ends of a line.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)


@F.pandas_udf(T.StringType())
def _without(texts: pd.Series, dropped: pd.Series) -> pd.Series:
    """Each text without the lines at the given places; null where no places are given."""

    def cut(text, places):
        if text is None or places is None:
            return None
        lines = text.split("\n")
        stays = np.ones(len(lines), bool)
        stays[places] = False
        return "\n".join(line for line, stay in zip(lines, stays, strict=True) if stay)

    return pd.Series([cut(t, d) for t, d in zip(texts, dropped, strict=True)], dtype=object)


def dedup_lines(docs: DataFrame, least_docs: int = 5, least_chars: int = 40, keep: list[str] | None = None) -> DataFrame:
    """``n_lines``, ``n_dropped`` and ``kept``, the text without its dropped lines, beside the columns in ``keep`` (all by default; of equal names the new ones stay).

    Keys of at least ``least_chars`` code points in at least ``least_docs`` documents lose all their lines but those in the document with the largest
    ``doc_id``. Rows of one ``doc_id`` are one document here, rows without one are one document before all others; a repeated row loses the same lines as its like.
    A null or empty text is one empty line; of a text whose lines all go, the empty text stays. An empty table gives an empty table.
    """
    kept = [c for c in (keep if keep is not None else docs.columns) if c.lower() not in ("n_lines", "n_dropped", "kept")]
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(docs["doc_id"].alias("_id"), F.xxhash64(text).alias("_x"), text.alias("_text"), F.struct(*[docs[f"`{c}`"] for c in kept]).alias("_row"))
    lines = rows.select("_id", "_x", F.posexplode(F.split("_text", "\n")).alias("_pos", "_line")).where(F.length("_line") >= least_chars)
    keys = lines.select("_id", "_x", "_pos", line_key(F.col("_line")).alias("_key")).where(F.length("_key") >= least_chars)
    keys = keys.select("_id", "_x", "_pos", F.xxhash64("_key").alias("_a"), F.xxhash64(F.lit(1), "_key").alias("_b"))
    shared = keys.select("_a", "_b", "_id").distinct().groupBy("_a", "_b").agg(F.count("*").alias("_n"), F.max("_id").alias("_top")).where(F.col("_n") >= least_docs)
    dropped = keys.join(shared, ["_a", "_b"]).where(~F.col("_id").eqNullSafe(F.col("_top"))).groupBy("_id", "_x").agg(F.collect_set("_pos").alias("_places"))
    dropped = dropped.withColumnsRenamed({"_id": "_id2", "_x": "_x2"})
    found = rows.join(dropped, F.col("_id").eqNullSafe(F.col("_id2")) & (F.col("_x") == F.col("_x2")), "left")
    hit = F.col("_places").isNotNull()
    return found.select(
        "_row.*",
        (F.length("_text") - F.length(F.replace("_text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(hit, F.size("_places")).otherwise(0).cast("long").alias("n_dropped"),
        F.when(hit, _without(F.when(hit, F.col("_text")), F.col("_places"))).otherwise(F.col("_text")).alias("kept"),
    )


#: DuckDB SQL for ``n_lines``, ``n_dropped`` and the hash of what is kept, by ``doc_id``.
LINES_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS key FROM lines
), shared AS (
  SELECT key AS shared_key, max(doc_id) AS top FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT doc_id, line, pos, coalesce(doc_id <> top, false) AS gone FROM keyed LEFT JOIN shared ON key = shared_key
)
SELECT doc_id, count(*) AS n_lines, count(CASE WHEN gone THEN 1 END) AS n_dropped,
       sha256(coalesce(string_agg(CASE WHEN NOT gone THEN line END, chr(10) ORDER BY pos), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
