"""The corpus pipeline: from raw documents to token ids, in stages that are each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orewright.llm import language as languages
from orewright.llm import mixing, neardup, sentencepiece_op
from orewright.llm import quality as qualities
from orewright.llm.tasks import small_batches
from orewright.plans.shared import materialize

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document goes if its language is ``und``, or its score is under those of all but this share of the documents that name the language predicted for them.
LANGUAGE_SHARE = 0.005


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranking of ``labels.quality`` doesn't reject: those over the quantile of its scores."""
    small_batches(spark)
    model = qualities.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return qualities.score_quality(docs, model).where("predicted = 1").select(*COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; where no document names one, all with a letter."""
    small_batches(spark)
    model = languages.train_language(docs)
    if not model.families:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    right = languages.predict_language(docs, model, keep=["lang"]).where("lang = lang_pred")
    cuts = {r["lang"]: r["cut"] for r in right.groupBy("lang").agg(F.percentile_approx("score", LANGUAGE_SHARE).alias("cut")).collect()}
    cut = F.coalesce(*[F.when(F.col("lang_pred") == lang, F.lit(v)) for lang, v in cuts.items()], F.lit(0.0))  # 0 for a language that no document is rightly in
    return languages.predict_language(docs, model).where((F.col("lang_pred") != "und") & (F.col("score") >= cut)).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates, the one with the least id; different texts of one id, or of none, are documents of their own."""
    small_batches(spark)
    kept = neardup.representatives(docs)
    key = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(neardup.NO_ID)).alias("id"), F.xxhash64("text").alias("x"), F.struct("doc_id", "lang", "source", "n_chars", "text").alias("row"))
    return key.groupBy("id", "x").agg(F.min("row").alias("row")).join(kept, ["id", "x"], "left_semi").select(*[F.col(f"row.{c}") for c in COLUMNS])


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    mixed = mixing.mix_sources(docs)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document's text."""
    import public_tokenizers

    small_batches(spark)
    return sentencepiece_op.encode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id", "source", "lang"])


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("mix", mix), ("tokens", tokens)]

#: SQL can express none of the learnt stages, so there is no SQL for all; tests/llm compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
