from pyspark.sql import functions as F

from orewright import registry
from orewright.functions import register_functions, register_table_functions
from orewright.operators import extract, text

DIR = "/root/testdata/sf0.001"


def test_sql_functions_equal_the_columns(spark):
    register_functions(spark)
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", F.substring("text", 1, 300).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(-1, None)], "doc_id long, text string"))
    both = docs.select(F.expr("fold(text)").alias("a"), text.fold(F.col("text")).alias("b"), F.expr("mask_text(text)").alias("c"), extract.mask_text(F.col("text")).alias("d"))
    assert both.where("NOT a <=> b OR NOT c <=> d").count() == 0
    pages = spark.read.parquet(f"{DIR}/pages.parquet").select("url")
    assert pages.select(F.expr("url_key(url)").alias("a"), text.url_key(F.col("url")).alias("b")).where("NOT a <=> b").count() == 0
    words = spark.createDataFrame([("casas",), ("ciudades",), ("mes",), (None,)], "w string")
    assert words.select(F.expr("stem(w)").alias("a"), text.stem(F.col("w")).alias("b")).where("NOT a <=> b").count() == 0
    rows = spark.createDataFrame([(1, "Page 12: Ünï!"), (2, None)], "id long, t string")
    groups = {r["first"]: r["digest"] for r in text.content_groups(rows, "id", "t").collect()}
    assert rows.where("id = 1").select(F.expr("content_hash(t)")).first()[0] == groups[1]


def test_table_functions(spark):
    register_table_functions(spark)
    spark.createDataFrame([(1, "due date 2024-01-05, total 1.234,50 EUR, mail a@b.org")], "id long, t string").createOrReplaceTempView("one_text")
    assert [tuple(r) for r in spark.sql("SELECT cents, currency FROM one_text, LATERAL find_prices(t)").collect()] == [(123450, "EUR")]
    assert [tuple(r) for r in spark.sql("SELECT CAST(value AS STRING), role FROM one_text, LATERAL find_dates(t, DATE '2024-02-01')").collect()] == [("2024-01-05", "due")]
    assert [tuple(r) for r in spark.sql("SELECT kind, value FROM one_text, LATERAL scan_pii(t)").collect()] == [("email", "a@b.org")]
    assert spark.sql("SELECT string_agg(chunk, '') WITHIN GROUP (ORDER BY n) FROM one_text, LATERAL chunk_text(t, 20, 0)").first()[0].startswith("due date 2024")


def test_amounts_have_all_of_their_groups(spark, tmp_path):
    sizes = [(1, 0), (2, 999), (3, 1000), (4, 20123), (5, 1234567), (6, None)]
    docs = spark.createDataFrame([(i, "Ünï", n) for i, n in sizes], "doc_id long, text string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["cents"] for r in registry.queries()["f01_fold_and_amount"](spark, str(tmp_path)).collect()}
    assert got == {i: None if n is None else (n * 1000 + i + 100) * 100 + 50 for i, n in sizes}
