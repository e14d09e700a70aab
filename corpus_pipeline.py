"""The corpus pipeline: each stage reads what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftwork.llm import decontam, langid, sentencepiece_scan, simhash, substring_dedup
from weftwork.llm.common import Scratch
from weftwork.llm.registry import MODEL_FILE

#: Documents with a lower score are in none of the languages.
MIN_LANGUAGE_SCORE = 0.2


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: texts without a letter, null texts and texts that fit no profile go."""
    profiles = langid.learn_profiles(docs)
    found = langid.identify(docs, profiles)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: of each component of texts that are 0.8 alike in five-word shingles, one row stays.

    Blocks of wide SimHash fingerprints, with covering masks each, make the candidates; whole shingle sets decide.
    """
    return simhash.keep_one_of_near_copies(docs, words=5, least=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: repeated word windows are cut out of the texts, whose layout stays; documents that this empties go."""
    found = substring_dedup.dedup_substrings(docs, layout=True)
    kept = found.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))).withColumn("text", F.col("kept_text"))
    return kept.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a test item, edits allowed for, go."""
    found = decontam.find_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(F.size("matches") == 0).select(docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece encoding, checked by decoding: ids of each kept document."""
    found = sentencepiece_scan.encode(docs, MODEL_FILE, round_trip="round_trip")
    return found.select("doc_id", "lang", "source", "text", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
