"""Token-tagged corpora and annotation files.

A corpus is a DataFrame of sentences: ``sent_id, words array<string>, tags array<string>``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow import schemas

_DOCUMENT_MARK = "-DOCSTART-"


def _sentence_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Blocks of lines, known by their content: equal sentences share a key, and so a split, however files are packed."""
    blocks = spark.read.option("lineSep", "\n\n").text(path)
    return blocks.select(
        F.md5("value").alias("sent_id"),
        F.filter(F.split("value", "\n"), lambda line: (line != "") & ~F.contains(line, F.lit(_DOCUMENT_MARK)))
        .alias("lines"),
    ).where(F.size("lines") > 0)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``token TAB tag`` files; lines that use runs of blanks instead are read as well.

    The tag is the last field, the token everything before it.
    """
    pattern = r"^(.*?)\s+(\S+)$"
    return _sentence_blocks(spark, path).select(
        "sent_id",
        F.transform("lines", lambda line: F.regexp_extract(line, pattern, 1)).alias("words"),
        F.transform("lines", lambda line: F.regexp_extract(line, pattern, 2)).alias("tags"),
    )


def read_label_tool_export(spark: SparkSession, path: str) -> DataFrame:
    """``token -X- _ tag`` files whose tag keeps its inner blanks."""
    def field(line: Column, k: int) -> Column:
        return F.get(F.split(line, " ", 4), F.lit(k))

    return _sentence_blocks(spark, path).select(
        "sent_id", F.transform("lines", lambda line: field(line, 0)).alias("words"),
        F.transform("lines", lambda line: field(line, 3)).alias("tags"))


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotated examples with a key: their ``id``, or the hash of all they hold."""
    rows = spark.read.schema(schemas.ANNOTATION).json(path)
    content = F.md5(F.to_json(F.struct("text", "tokens", "spans", "answer")))
    return rows.select(F.coalesce("id", content).alias("sent_id"), "text", "tokens", "spans", "answer")


def sentence_text(words: Column, tags: Column) -> Column:
    """Sentence in ``token TAB tag`` lines."""
    return F.array_join(
        F.transform(F.arrays_zip(words.alias("w"), tags.alias("t")), lambda p: F.concat(p["w"], F.lit("\t"), p["t"])),
        "\n")


def write_corpus(sentences: DataFrame, path: str) -> None:
    """One folder ``split=<name>`` per split. No shuffle: sentences are rows already.

    Everything held there before goes, splits that have become empty included.
    """
    sentences.select(sentence_text(F.col("words"), F.col("tags")).alias("value"), "split") \
        .write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split") \
        .option("lineSep", "\n\n").text(path)


def token_rows(sentences: DataFrame, *keep: str) -> DataFrame:
    """Long form: one row per token with its position."""
    pairs = F.arrays_zip(F.col("words").alias("token"), F.col("tags").alias("tag"))
    return sentences.select(*keep, "sent_id", F.posexplode(pairs).alias("pos", "p")) \
        .select(*keep, "sent_id", F.col("pos").cast("bigint").alias("pos"), "p.token", "p.tag")
