"""Registered queries of the corpus operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontam, lang_id, ngram_join, packing, suffix_dedup, topk, toxicity, url_filter, warc

SQL: dict[str, str] = {"op5_url_filters": url_filter.SQL, "op6_exact_top_k": topk.SQL, "op8_language_id": lang_id.SQL, "op9_suffix_array_dedup": suffix_dedup.SQL, "op10_chat_formatting": chat.SQL}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(_read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.linked(_read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _read(spark, sf_dir, "labels")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filtered(_read(spark, sf_dir, "pages"))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(_read(spark, sf_dir, "embeddings"))


def op7_warc_writer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.write(_read(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.language_rows(_read(spark, sf_dir, "documents"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeats(_read(spark, sf_dir, "documents"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.formatted(_read(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_decontamination, op3_ngram_jaccard_join, op4_toxicity, op5_url_filters, op6_exact_top_k, op7_warc_writer, op8_language_id, op9_suffix_array_dedup, op10_chat_formatting)}
