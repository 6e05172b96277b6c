"""The registered queries, one for each operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm import (
    ann, bpe, decontam, hmm, html_text, infill, phrases, quality, secrets, simhash, sketch, suffix, tokenfile,
)
from docketflow.llm.registry import ORACLES, QUERIES, query, table
from docketflow.session import scratch_path

__all__ = ["ORACLES", "QUERIES"]


@query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.groups(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        F.col("component").alias("component_id"))


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN)


@query("op8_quality")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return quality.classify(docs, quality.fit(docs, table(spark, sf_dir, "labels", "doc_id", "quality")))


@query("op10_decontamination", decontam.ORACLE)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents", "doc_id", "text"),
                                  table(spark, sf_dir, "benchmark", "item_id", "text"))


@query("op9_token_files")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "token-files")
    tokenizer = tokenfile.read_tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), folder, tokenizer)
    return tokenfile.read_digests(manifest, folder)


@query("op4_html_text")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.texts(table(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("op1_nearest_neighbours")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("id") % 50 == 0)


@query("op3_hidden_markov")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    return hmm.model_scores(docs.withColumn("held", held), "held")


@query("op7_suffix_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.removals(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op11_infill", infill.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op12_fingerprint")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.versions(table(spark, sf_dir, "documents", "doc_id", "text"))


@query("op13_phrases", phrases.ORACLE)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "collocations")
    with phrases.Mined(table(spark, sf_dir, "documents", "text", "lang")) as mined:
        phrases.collocations(mined).write.parquet(folder)
    return spark.read.parquet(folder)
