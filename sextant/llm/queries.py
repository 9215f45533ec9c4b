"""The queries of this package: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sextant.llm import bytepairs, chat, decontaminate, fingerprints, langid, negatives, phrases, pieces, quality, simhash, toxicity, warc, wordpiece

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(_table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.with_token_counts(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_tokens")


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_of("fp").alias("fingerprint"), "component_id")


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.format_chats(chat.with_special(_table(spark, sf_dir, "conversations"))))


def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.token_summary(_table(spark, sf_dir, "documents"), pieces.load_pieces())


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predictions(_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepairs.digests(_table(spark, sf_dir, "documents"), bytepairs.load_vocabulary())


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(negatives.shifted(_table(spark, sf_dir, "embeddings")))


def phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.top_collocations(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {
    "op1_fingerprints": fingerprint,
    "op2_decontamination": decontamination,
    "op3_token_counts": token_counts,
    "op4_quality": quality_scores,
    "op5_simhash": near_duplicates,
    "op6_chat": chat_format,
    "op7_sentencepiece": sentence_pieces,
    "op8_language": language,
    "op9_toxicity": toxicity_scores,
    "op10_warc": warc_round_trip,
    "op11_byte_pairs": byte_pairs,
    "op12_hard_negatives": hard_negatives,
    "op13_phrases": phrase_collocations,
    "pipeline": pipeline,
}

ORACLES: dict[str, str] = {"op2_decontamination": decontaminate.ORACLE, "op6_chat": chat.ORACLE, "op12_hard_negatives": negatives.ORACLE, "op13_phrases": phrases.ORACLE}
