"""One query for each operator of this package, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from orewright.llm import chat, fingerprints, language, line_dedup, media, mixing, neardup, negatives, quality, repairs, sentencepiece_op, token_files
from orewright.llm.tasks import small_batches, tasks_for
from orewright.plans.shared import fresh_path, materialize


def _path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text, whether they decode back to it, and the Viterbi segmentation's length and score. Null and empty texts have no ids; repeated rows give repeated rows."""
    small_batches(spark)
    return sentencepiece_op.encode(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"), keep=["doc_id"], check=True)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document. Null texts have size 0; equal sizes go by id; a repeated row is a document of its own."""
    return mixing.mix_sources(_table(spark, sf_dir, "documents"), slim=True)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text; null and empty texts get one too, equal texts the same. Without labels nothing is rejected."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.train_quality(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text. Null texts are empty; repeated and null ids are ordered as :func:`orewright.llm.fingerprints.edited_fingerprints` says."""
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of every whole text; null texts and those without a letter are ``und``, equal texts get the same."""
    small_batches(spark)
    docs = _table(spark, sf_dir, "documents")
    found = language.predict_language(docs, language.train_language(docs), keep=["doc_id"])
    return found.select("doc_id", quality.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of every text as a picture, read back from the archives. Null texts are empty; repeated rows are members of their own."""
    small_batches(spark)
    root = fresh_path(spark, "media")
    media.write_archives(media.to_media(_table(spark, sf_dir, "documents")), root)
    return media.media_features(media.read_archives(spark, root))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all formatted conversations and of conversation -1. Null texts and roles are empty, a null id is a conversation, rows of one turn go by role and text."""
    small_batches(spark)
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    extra = rows.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    rows = rows.unionByName(extra)
    n = tasks_for(rows, "text")
    return chat.digest_chats(chat.format_chats(rows, partitions=n), n)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every document. Null and empty texts stand alone unless equal; repeated rows share a class."""
    small_batches(spark)
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every text, exact and by the unigram pass. Null and empty texts have none."""
    small_batches(spark)
    return sentencepiece_op.count_tokens(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"), keep=["doc_id", "source"])


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places, numbers and hashes of all ids, read back from the files. Null texts are empty, null ids come first, and rows of one id stand in any order."""
    small_batches(spark)
    return token_files.read_token_files(spark, token_files.write_token_files(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json")))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest edits and the hash of the repaired turns of each damaged conversation."""
    small_batches(spark)
    found, turns = repairs.repair_conversations(repairs.damage(_table(spark, sf_dir, "conversations")), materialize)
    digests = repairs.digest_turns(turns).withColumnRenamed("conv_id", "c")
    joined = found.join(digests, found["conv_id"].eqNullSafe(F.col("c")), "left")
    return joined.select(*found.columns, F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of at least 40 code points that five documents share stay in the last of them only."""
    small_batches(spark)
    found = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"), keep=["doc_id"])
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best negatives under each of the best positives of the anchors, whose ids 50 divides; labels of ids that 7 divides are moved on by one."""
    small_batches(spark)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = negatives.comparable(_table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))
    return negatives.mine_hard_negatives(rows, F.col("vec_id") % 50 == 0, materialize)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sentencepiece,
        op2_mix_sources,
        op3_quality,
        op4_fingerprints,
        op5_language,
        op6_media_columns,
        op7_chat_format,
        op8_near_duplicates,
        op9_token_counts,
        op10_token_files,
        op11_conversation_repair,
        op12_line_dedup,
        op13_hard_negatives,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLES: dict[str, str] = {"op13_hard_negatives": negatives.NEGATIVES_SQL, "op11_conversation_repair": repairs.REPAIR_SQL, "op12_line_dedup": line_dedup.LINES_SQL} | ({} if corpus_pipeline.ORACLE_SQL is None else {"pipeline": corpus_pipeline.ORACLE_SQL})
