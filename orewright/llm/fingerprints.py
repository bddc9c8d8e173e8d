"""Fingerprints of documents as homomorphic multiset hashes, with DataFrame functions only.

A text is a multiset of paragraphs: its lines, and the sentences in them. Each paragraph hashes, four times with a seed of its own, to a wide
vector: 128 lanes of one bit and 4 lanes of 32 bits. The fingerprint is the sum of the vectors and the number of paragraphs, modulo 2**32. So it
doesn't depend on order, and adding or removing a paragraph adds or subtracts its vector. Seen as +1 and -1, the bits of
different paragraphs are uncorrelated, so the scalar product of two fingerprints estimates how many paragraphs their texts share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orewright.plans.shared import materialize

PARAGRAPHS = r"\n+|(?<=[.!?])[ \t]+"
LANES = 128
_MOD = 0xFFFFFFFF
_LEAST = -(1 << 63)


def paragraphs(text: Column, pattern: str = PARAGRAPHS) -> Column:
    """The text's lines and sentences, without those of white space alone."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), pattern), lambda p: F.trim(p) != "")


def hashes(paragraph: Column) -> list[Column]:
    """Columns that :func:`lane_sums` adds up: four hashes of a paragraph, each with a seed of its own, and 1; all are 0 for a null paragraph."""
    there = lambda x: F.when(paragraph.isNotNull(), x).otherwise(F.lit(0).cast("long"))
    return [there(F.xxhash64(F.lit(k), paragraph)).alias(f"_h{k}") for k in range(4)] + [there(F.lit(1).cast("long")).alias("_one")]


def lane_sums() -> Column:
    """Aggregate over the columns of :func:`hashes`: the lanes of a group of paragraphs, as array<long>.

    A sum adds up two bits of a hash, 32 places apart, in the two halves of a long, so a group may have up to 2**31 paragraphs.
    """
    low = F.lit(_MOD).cast("long")
    halves = lambda x: [x.bitwiseAND(low), F.shiftrightunsigned(x, 32)]
    pair = F.lit((1 << 32) + 1).cast("long")
    lanes = [x for k in range(2) for j in range(32) for x in halves(F.sum(F.shiftrightunsigned(f"_h{k}", j).bitwiseAND(pair)))]
    lanes += [F.sum(x).bitwiseAND(low) for k in (2, 3) for x in halves(F.col(f"_h{k}"))]
    return F.array(*lanes, F.sum("_one").bitwiseAND(low))


def to_hex(lanes: Column) -> Column:
    """The fingerprint's string: 8 hex digits for each lane."""
    return F.array_join(F.transform(lanes, lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")), "")


def add(a: Column, b: Column, sign: int = 1) -> Column:
    """Lanes after the paragraphs of ``b`` are added (``sign`` 1) or removed (-1)."""
    return F.zip_with(a, b, lambda x, y: (x + sign * y).bitwiseAND(F.lit(_MOD).cast("long")))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: twice the estimated scalar product of two multisets over the sum of their squares; 1 for equal fingerprints."""
    n = lambda v: F.element_at(v, LANES + 5)
    signed = lambda v: F.transform(F.slice(v, 1, LANES), lambda x: (2 * x - n(v)).cast("double"))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x)
    both = total(F.zip_with(signed(a), signed(b), lambda x, y: 2 * x * y))
    squares = total(F.transform(signed(a), lambda x: x * x)) + total(F.transform(signed(b), lambda x: x * x))
    return F.when(a == b, 1.0).when(squares == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), both / squares)))


def fingerprint(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lanes`` and ``fingerprint`` of each distinct id: rows that share an id are one multiset, as if their texts were joined. Null and empty texts have none."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.explode_outer(paragraphs(F.col(text))).alias("_p"))
    return rows.select("doc_id", *hashes(F.col("_p"))).groupBy("doc_id").agg(lane_sums().alias("lanes")).withColumn("fingerprint", to_hex(F.col("lanes")))


def _bucket(key: Column, bounds: list[int], low: int = 0) -> Column:
    """How many of the sorted bounds are at or below the key, by halving."""
    if not bounds:
        return F.lit(low)
    m = len(bounds) // 2
    return F.when(key < bounds[m], _bucket(key, bounds[:m], low)).otherwise(_bucket(key, bounds[m + 1 :], low + m + 1))


def _ranges(rows: DataFrame, spark_partitions: int, range_bytes: int, widest: int = 512) -> DataFrame:
    """Adds ``_a`` and ``_b``: ranges of ``_k`` of about ``range_bytes`` of ``_text``, those of one ``_a`` side by side.

    Up to ``widest`` ranges are quantiles of all keys; where more are needed, each is parted by quantiles of its own, found by a group for each of them.
    """
    bytes_ = rows.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    wanted = max(spark_partitions, bytes_ // range_bytes + 1)
    n, m = min(widest, wanted), -(-wanted // widest)
    found = rows.agg(F.percentile_approx("_k", [i / n for i in range(1, n)] or [0.5], 10 * n).alias("b")).first()
    rows = rows.withColumn("_a", _bucket(F.col("_k"), sorted(set(found["b"] or [])) if n > 1 else []))  # at most ``widest`` numbers
    if m == 1:
        return rows.withColumn("_b", F.lit(0))
    inner = rows.groupBy("_a").agg(F.percentile_approx("_k", [i / m for i in range(1, m)], 10 * m).alias("_bounds"))
    return rows.join(F.broadcast(inner), "_a").withColumn("_b", F.size(F.filter(F.array_distinct("_bounds"), lambda x: x <= F.col("_k")))).drop("_bounds")  # at most 512 rows


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", range_bytes: int = 32 << 20, widest: int = 512) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter of code points is the start of the next document's text.

    Next is by ascending ``doc_id`` (null first, then by a hash of the text); after the last comes the first. A null text is empty. Documents are
    dealt out by ranges of ``doc_id`` of about ``range_bytes``, so a task doesn't grow with the table; each range also gets a copy of the first document of the
    next one, so no window spans ranges. Repeated ids and rows each keep their row; all rows of one id, or of none, are in one range and so in one task. A
    single document is its own next.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(_LEAST))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), key.alias("_k"))
    rows = _ranges(rows, int(spark.conf.get("spark.sql.shuffle.partitions")), range_bytes, widest).withColumn("_end", F.lit(0))
    # the first document of each range, once for the range before it; a row for each range
    firsts = materialize(rows.groupBy("_a", "_b").agg(F.min("_k").alias("_k")), "ranges")
    place = Window.orderBy("_a", "_b")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = firsts.select("_k", *[F.coalesce(F.lag(c).over(place), F.last(c).over(whole)).alias(f"_to{c}") for c in ("_a", "_b")])
    copies = rows.drop("_a", "_b").join(F.broadcast(ends), "_k").groupBy("_to_a", "_to_b").agg(F.min_by(F.struct("doc_id", "_text", "_k"), F.xxhash64("_text")).alias("r"))
    copies = copies.select("r.doc_id", "r._text", "r._k", F.col("_to_a").alias("_a"), F.col("_to_b").alias("_b"), F.lit(1).alias("_end"))
    order = Window.partitionBy("_a", "_b").orderBy("_end", "_k", F.xxhash64("_text"))
    rows = rows.unionByName(copies).withColumn("_n", F.row_number().over(order)).withColumn("_next", F.lead("_text").over(order))
    quarter = F.floor(F.length("_text") / 4).cast("int")
    rows = rows.withColumn("_edited", F.when(F.col("_end") == 0, F.concat(F.substring(F.col("_text"), F.lit(1), F.length("_text") - quarter), F.substring(F.col("_next"), F.lit(1), quarter))))
    rows = rows.select("_a", "_b", "_n", "_end", "doc_id", F.length("_text").cast("long").alias("n_chars"), F.sha2(F.col("_edited"), 256).alias("edited_sha256"), F.explode(F.filter(F.array(F.struct(F.lit(0).alias("w"), F.col("_text").alias("t")), F.struct(F.lit(1).alias("w"), F.col("_edited").alias("t"))), lambda x: x["t"].isNotNull())).alias("_x"))
    units = rows.select("_a", "_b", "_n", "_end", "doc_id", "n_chars", "edited_sha256", F.col("_x.w").alias("_w"), F.explode_outer(paragraphs(F.col("_x.t"))).alias("_p"))
    own = ["_a", "_b", "_n", "_end", "doc_id", "n_chars", "edited_sha256", "_w"]
    sums = units.select(*own, *hashes(F.col("_p"))).groupBy(*own).agg(lane_sums().alias("lanes"))
    follow = Window.partitionBy("_a", "_b").orderBy("_n", "_w")  # a document, its edited text, the next document
    pairs = sums.withColumn("_own", F.lead("lanes", 1).over(follow)).withColumn("_after", F.lead("lanes", 2).over(follow)).where("_w = 0 and _end = 0")
    return pairs.select("doc_id", "n_chars", "edited_sha256", to_hex(F.col("lanes")).alias("fingerprint"), to_hex(F.col("_own")).alias("edited_fingerprint"), likeness(F.col("lanes"), F.col("_own")).alias("near_edited"), likeness(F.col("lanes"), F.col("_after")).alias("near_next"))
