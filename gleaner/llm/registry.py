"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import chat, digests, embedding_dedup, hard_negatives, knn, langid, licenses, packing, periodic, quality, sentencepieces, simhash, toxicity
from gleaner.llm.common import crc_mod, tables


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from those that are not held out."""
    (docs,) = tables(spark, sf_dir, "documents")
    model = langid.train(docs, eligible=crc_mod(F.col("doc_id"), 4) != 2)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out, "lang_pred", "score", "rejected", "margin"
    )


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest integer inner products of every fiftieth vector with all others."""
    (rows,) = tables(spark, sf_dir, "embeddings")
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    valid = rows.where(knn.finite(F.col("embedding").cast("array<double>")))
    return knn.top_k(valid.select("vec_id", whole.alias("v")), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)))


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors of equal label at cosine 0.93 or more."""
    (rows,) = tables(spark, sf_dir, "embeddings")
    return embedding_dedup.near_duplicates(rows)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one whose texts hold control strings, formatted and read back."""
    (rows,) = tables(spark, sf_dir, "conversations")
    tricky = [(-1, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    extra = spark.createDataFrame(tricky, "conv_id long, turn long, role string, text string")
    return chat.digest(chat.format_conversations(rows.select(extra.columns).unionByName(extra)))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    model = quality.train(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    return quality.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted"
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line, block or whole text of a document that is a known licence notice."""
    (docs,) = tables(spark, sf_dir, "documents")
    return licenses.scan(docs).select(
        F.col("id").alias("doc_id"), "unit", "unit_no", "license", F.round("dice", 6).alias("dice")
    )


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of every document, decoded again: sizes and checksums of ids and text."""
    (docs,) = tables(spark, sf_dir, "documents")
    return sentencepieces.digest(sentencepieces.encode(docs)).withColumnRenamed("id", "doc_id")


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    (docs,) = tables(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document with its nearest labelled examples."""
    docs, labels = tables(spark, sf_dir, "documents", "labels")
    model = toxicity.train(docs, labels, crc_mod(F.col("doc_id"), 5) != 0)
    held_out = F.coalesce(crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out")
    return toxicity.classify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out, "score", "predicted", "evidence", "similarity"
    )


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 1024 tokens."""
    (docs,) = tables(spark, sf_dir, "documents")
    return packing.pack(docs)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every hundredth vector and each of its five nearest of the same label the five hardest negatives within 80 to 100 % of the score."""
    (rows,) = tables(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(256 * x).cast("double"))
    valid = rows.where(knn.finite(F.col("embedding").cast("array<double>")))
    return hard_negatives.hard_negatives(valid.select("vec_id", label.alias("label"), whole.alias("v")), F.col("vec_id") % 100 == 0)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of periodic words in every document, the tail of every tenth replaced by repeats of its start."""
    (docs,) = tables(spark, sf_dir, "documents")
    # nothing but blanks counts as no words; a text's word number is that of the blanks that are followed by a word
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    n = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    begin = F.floor(h / 10) % n
    tail = F.when((h % 10 == 0) & (n > 0), F.struct(begin.alias("begin"), (1 + F.floor((n - begin) / (3 + F.floor(h / 10) % 8))).alias("period")))
    found = periodic.periodic_runs(docs.select("doc_id", "text", tail.alias("tail")), tail="tail")
    return periodic.longest(found).withColumnRenamed("id", "doc_id")


def op13_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its text with the last quarter replaced by the start of the next."""
    (docs,) = tables(spark, sf_dir, "documents")
    return digests.edited_chain(docs).withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op9_toxicity": op9_toxicity,
        "op10_best_fit_packing": op10_best_fit_packing,
        "op2_exact_top_k": op2_exact_top_k,
        "op4_embedding_near_dedup": op4_embedding_near_dedup,
        "op3_chat_formatting": op3_chat_formatting,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_license_scan": op6_license_scan,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_simhash_near_dedup": op8_simhash_near_dedup,
        "op11_hard_negatives": op11_hard_negatives,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_document_fingerprints": op13_document_fingerprints,
    }


def oracle_sql() -> dict[str, str]:
    return {"op6_license_scan": licenses.oracle(), "op11_hard_negatives": hard_negatives.oracle(), "op13_document_fingerprints": digests.oracle()}
