"""The registered queries of this subpackage, each over its whole table; none of the contracts is expressible in SQL, so ORACLE_SQL is empty and tests/llm holds them against brute force."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from lacuna.llm import alignment, bpe, decontaminate, html_extract, langid, lexical, quality, secret_scan, simhash, token_output, toxicity, warc, winnowing
from lacuna.llm.common import read_table


def tokenizer(name: str) -> str:
    """The place of a public tokenizer's file: under LACUNA_TOKENIZERS if that is set, else where the installed package has it."""
    if folder := os.environ.get("LACUNA_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_file_query(read_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip_digests(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_query(read_table(spark, sf_dir, "documents"))


def winnowing_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.edited_likeness_query(read_table(spark, sf_dir, "documents"))


def benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivative_query(read_table(spark, sf_dir, "pages"))


def secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_query(read_table(spark, sf_dir, "documents"))


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def language_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return langid.predict_documents(docs, langid.train(docs))


def lexical_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.link_statistics(read_table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


QUERIES = {
    "op1_token_files": token_files,
    "op2_bpe_round_trip": bpe_round_trip,
    "op3_simhash_groups": simhash_groups,
    "op4_winnowing_likeness": winnowing_likeness,
    "op5_benchmark_leaks": benchmark_leaks,
    "op6_page_text": page_text,
    "op7_warc_derivatives": warc_derivatives,
    "op8_secret_spans": secret_spans,
    "op9_toxicity_scores": toxicity_scores,
    "op10_language_predictions": language_predictions,
    "op11_lexical_top": lexical_top,
    "op12_quality_scores": quality_scores,
    "op13_token_alignment": token_alignment,
}
ORACLE_SQL: dict[str, str] = {}
