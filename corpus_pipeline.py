"""Corpus pipeline: quality, near-duplicates, benchmark contamination, secrets, token ids.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. The first four return the columns of
documents; extra columns pass through. Rows with null ids or texts pass every stage that does not reject them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm import bpe, decontam, quality, secrets, simhash
from docketflow.session import cut_lineage, scratch_path


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier does not reject; all of them if there is no label to learn from."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    machine = quality.fit(docs.select("doc_id", "text"), labels)
    if not machine.fitted:
        return docs
    return docs.where(quality.score(F.col("text"), machine) >= quality.THRESHOLD)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Rows without an id come after all others, and of rows that repeat the id the smallest content hash stays, once.
    """
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64("text").alias("mark")).alias("key")
    group = simhash.groups(docs.select(key, "text"), key="key")
    group = cut_lineage(group.select("key", "component"))
    others = group.where(~F.col("key").eqNullSafe(F.col("component"))).select("key").distinct()
    kept = _without(docs, others.select(F.col("key.doc_id").alias("k_id"), F.col("key.mark").alias("k_mark")))
    # Whole texts are shuffled for repeated rows only if there are any, which the narrow table tells.
    if not group.groupBy("key").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "mark"])
    return kept.select("row.*")


def _without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows (as ``row``, with ``id`` and ``mark``) whose id and content are not among ``keys`` (k_id, k_mark).

    The keys are narrow and mostly few, so Spark can keep the texts where they are.
    """
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    return rows.join(keys, F.col("id").eqNullSafe(F.col("k_id")) & F.col("mark").eqNullSafe(F.col("k_mark")), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule does not mark."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    keys = decontam.contaminated_keys(docs.select("doc_id", "text"), items)
    return _without(docs, keys.withColumnsRenamed({"h_key": "k_id", "h_mark": "k_mark"})).select("row.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret in the text replaced by its kind; n_chars follows the new text."""
    made = docs.withColumn("text", secrets.masked(F.col("text")))
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return made.select(*docs.columns)


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return bpe.encode_texts(docs, ranks, public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("token_ids", to_token_ids),
]

#: Classifier, fingerprints and tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
