"""A catalogue kept up from a stream of changed and removed files by signed differences: nothing is counted again from all files.

Under one path there are four tables in buckets of their keys: the files, files by hash, facet values and the totals. A batch reads the buckets
that its changes meet, takes back what the old rows had added, adds what the new ones add, and writes those buckets anew under its own number. A small
manifest, written last, says which batch's version of each bucket counts; so a batch that runs again starts from the same tables and gives the same, and a reader opens one version of each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.plans.shared import release, scratch

KEYS = {"files": ["root_id", "rel_path"], "hashes": ["sha256"], "facets": ["facet", "value"], "totals": []}
FILE = "root_id long, rel_path string, id long, size_bytes long, triangles long, status string, watertight boolean, sha256 string, format string, collection string, tags array<string>"
SCHEMAS = {
    "files": FILE, "hashes": "sha256 string, n long, lowest long", "facets": "facet string, value string, n long",
    "totals": "models long, bytes long, triangles long, errors long, skipped long, closed long, open long, unknown long, duplicates long",
}
_FILE = [c.split()[0] for c in FILE.split(", ")]


def _folder(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []


def _committed(spark: SparkSession, table: str) -> list[int]:
    batches = [x for x in _folder(spark, f"{table}/manifest") if x.startswith("batch=")]
    return sorted(int(x[6:]) for x in batches if "_SUCCESS" in _folder(spark, f"{table}/manifest/{x}"))


def _manifest(spark: SparkSession, table: str, batch: int | None) -> dict[tuple[str, int], int]:
    """The batch whose version of a table's bucket counts."""
    if batch is None:
        return {}
    rows = spark.read.schema("kept string, bucket int, batch long").parquet(f"{table}/manifest/batch={batch}").collect()  # a row for each bucket
    return {(r["kept"], r["bucket"]): r["batch"] for r in rows}


def _read(spark: SparkSession, table: str, manifest: dict, kept: str, buckets: list[int] | None = None) -> DataFrame:
    paths = [f"{table}/{kept}/batch={b}/bucket={k}" for (name, k), b in sorted(manifest.items()) if name == kept and (buckets is None or k in buckets)]
    return spark.read.schema(SCHEMAS[kept]).parquet(*paths) if paths else spark.createDataFrame([], SCHEMAS[kept])


def _bucket(kept: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(0), *KEYS[kept]), F.lit(buckets)).cast("int") if KEYS[kept] else F.lit(0)


def _same(a: str, b: str, kept: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in KEYS[kept]])


class _Step:
    """One batch: what is read from the last manifest, and what is written for the next."""

    def __init__(self, spark: SparkSession, table: str, n: int, buckets: int):
        self.spark, self.table, self.n, self.buckets = spark, table, n, buckets
        earlier = [b for b in _committed(spark, table) if b < n]
        self.before = earlier[-1] if earlier else None
        self.old = _manifest(spark, table, self.before)
        self.new = dict(self.old)

    def touched(self, keys: DataFrame, kept: str) -> list[int]:
        return sorted(r[0] for r in keys.select(_bucket(kept, self.buckets)).distinct().collect())  # at most a number for each bucket

    def read(self, kept: str, buckets: list[int]) -> DataFrame:
        return _read(self.spark, self.table, self.old, kept, buckets)

    def write(self, kept: str, rows: DataFrame, touched: list[int]) -> None:
        """New versions of the touched buckets; one that is empty now is no more."""
        path = f"{self.table}/{kept}/batch={self.n}"
        rows.withColumn("bucket", _bucket(kept, self.buckets)).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        there = {int(x[7:]) for x in _folder(self.spark, path) if x.startswith("bucket=")}
        for k in touched:
            self.new.pop((kept, k), None)
        self.new |= {(kept, k): self.n for k in there}

    def commit(self) -> None:
        rows = [(kept, k, b) for (kept, k), b in sorted(self.new.items())]
        self.spark.createDataFrame(rows, "kept string, bucket int, batch long").coalesce(1).write.mode("overwrite").parquet(f"{self.table}/manifest/batch={self.n}")
        used = {(kept, b) for m in (self.old, self.new) for (kept, _), b in m.items()}  # readers of the last manifest may still be under way
        for kept in SCHEMAS:
            for name in _folder(self.spark, f"{self.table}/{kept}"):
                if (kept, int(name[6:])) not in used and int(name[6:]) < self.n:
                    release(self.spark, f"{self.table}/{kept}/{name}")
        for b in _committed(self.spark, self.table):
            if b < (self.n if self.before is None else self.before):
                release(self.spark, f"{self.table}/manifest/batch={b}")


def _totals(rows: DataFrame, sign: Column) -> DataFrame:
    """What signed files add to the totals; ``duplicates`` come from the hashes."""
    count = lambda c: F.coalesce(F.sum(F.when(F.expr(c), sign)), F.lit(0)).cast("long")
    return rows.agg(
        F.coalesce(F.sum(sign), F.lit(0)).cast("long").alias("models"), F.coalesce(F.sum(sign * F.col("size_bytes")), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum(sign * F.col("triangles")), F.lit(0)).cast("long").alias("triangles"),
        count("status = 'error'").alias("errors"), count("status = 'skipped'").alias("skipped"), count("watertight").alias("closed"), count("not watertight").alias("open"), count("watertight is null").alias("unknown"),
    )


def apply_changes(batch: DataFrame, n: int, table: str, buckets: int = 64) -> None:
    """Bring the tables under ``table`` from the last batch before ``n`` to after it.

    ``batch`` has the columns of :data:`FILE`, ``removed`` and ``at``: of a file (``root_id, rel_path``; a null root is one) the row with the greatest
    ``at`` counts, ties to a removal, then to the greater id. Rows without a path are left out. A removal of an unknown file changes nothing.
    """
    spark = batch.sparkSession
    step = _Step(spark, table, n, buckets)
    with scratch(spark, "upkeep") as own:
        order = F.struct("at", F.coalesce("removed", F.lit(False)).alias("removed"), "id")
        last = batch.where("rel_path is not null").groupBy("root_id", "rel_path").agg(F.max_by(F.struct(*[c for c in _FILE if c not in KEYS["files"]], F.coalesce("removed", F.lit(False)).alias("removed")), order).alias("row"))
        changes = own.keep(last.select("root_id", "rel_path", "row.*").select(*_FILE, "removed"), "changes")
        touched = step.touched(changes, "files")
        if not touched:
            return
        files = step.read("files", touched).alias("f")
        met = _same("f", "c", "files")
        added = changes.where("not removed").drop("removed")
        deltas = own.keep(files.join(changes.alias("c"), met, "left_semi").withColumn("sign", F.lit(-1)).unionByName(added.withColumn("sign", F.lit(1))), "deltas")
        step.write("files", files.join(changes.alias("c"), met, "left_anti").unionByName(added), touched)
        sign = F.col("sign")

        # facets: counts of values; one that nothing has any more goes
        values = [deltas.select(F.lit("format").alias("facet"), F.col("format").alias("value"), "sign"), deltas.where("coalesce(collection, '') <> ''").select(F.lit("collection").alias("facet"), "collection", "sign"), deltas.select(F.lit("tag").alias("facet"), F.explode("tags"), "sign")]
        counts = own.keep(reduce(DataFrame.unionAll, values).groupBy("facet", "value").agg(F.sum("sign").alias("n")).where("n <> 0"), "facets")
        met_values = step.touched(counts, "facets")
        step.write("facets", step.read("facets", met_values).unionByName(counts).groupBy("facet", "value").agg(F.sum("n").alias("n")).where("n <> 0"), met_values)

        # hashes: the number of files and the lowest id; only where the lowest is taken back, it is looked for again among the files
        hashed = deltas.where("coalesce(sha256, '') <> ''").groupBy("sha256").agg(F.sum("sign").alias("more"), F.min(F.when(sign > 0, F.col("id"))).alias("new"), F.min(F.when(sign < 0, F.col("id"))).alias("gone"))
        hashed = own.keep(hashed, "hashed")
        met_hashes = step.touched(hashed, "hashes")
        old = step.read("hashes", met_hashes)
        both = old.join(hashed, "sha256", "full").withColumn("now", F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0)))
        lost = F.coalesce(F.col("gone") == F.col("lowest"), F.lit(False)) & F.coalesce(F.col("new") > F.col("lowest"), F.lit(True))
        both = own.keep(both.withColumn("lost", lost & (F.col("now") > 0)), "both")
        sought = both.where("lost").select("sha256")
        again = _read(spark, table, step.new, "files").join(sought, "sha256", "left_semi").groupBy("sha256").agg(F.min("id").alias("found")) if sought.head() else None
        lowest = F.least("lowest", "new")
        rows = both.withColumn("found", F.lit(None).cast("long")) if again is None else both.join(again, "sha256", "left")
        step.write("hashes", rows.where("now > 0").select("sha256", F.col("now").alias("n"), F.when(F.col("lost"), F.col("found")).otherwise(lowest).alias("lowest")), met_hashes)

        copies = lambda c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - 1, F.lit(0))
        duplicates = both.agg(F.coalesce(F.sum(copies("now") - copies("n")), F.lit(0)).cast("long").alias("duplicates"))
        more = _totals(deltas, sign).crossJoin(duplicates)  # one row each
        names = [c.split()[0] for c in SCHEMAS["totals"].split(", ")]
        step.write("totals", step.read("totals", [0]).unionByName(more).agg(*[F.sum(c).cast("long").alias(c) for c in names]), [0])
    step.commit()


def catalog_stream(files: DataFrame, table: str, buckets: int = 64):
    """A query that keeps the tables under ``table`` (a path) up by batches; see :func:`apply_changes`. Choose ``buckets`` so that one holds some hundred MB of files."""
    return files.writeStream.foreachBatch(lambda batch, n: apply_changes(batch, n, table, buckets))


def catalog_table(spark: SparkSession, table: str, kept: str) -> DataFrame:
    """``files``, ``hashes``, ``facets`` or ``totals`` as the last whole batch left them."""
    batches = _committed(spark, table)
    return _read(spark, table, _manifest(spark, table, batches[-1] if batches else None), kept)


def catalog_totals(spark: SparkSession, table: str) -> DataFrame:
    """The row of :func:`orewright.operators.catalogue.library_totals`; no row before the first batch."""
    formats = catalog_table(spark, table, "facets").where("facet = 'format' and value is not null").agg(F.count("*").alias("formats"))
    return catalog_table(spark, table, "totals").crossJoin(formats)  # one row each


def catalog_facets(spark: SparkSession, table: str, most_tags: int = 200) -> DataFrame:
    """The rows of :func:`orewright.operators.catalogue.facets`."""
    rows = catalog_table(spark, table, "facets")
    return rows.where("facet <> 'tag'").unionAll(rows.where("facet = 'tag'").orderBy(F.desc("n"), "value").limit(most_tags))


def catalog_copies(spark: SparkSession, table: str) -> DataFrame:
    """The groups of :func:`orewright.operators.catalogue.exact_dupes`."""
    return catalog_table(spark, table, "hashes").where("n > 1").select("sha256", "lowest", "n")
