"""Corpus build: annotations and label-tool exports → one tagged, split corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.fixed_values import MARKER, MARKER_REPLACEMENT
from docketflow.operators import corpus


def from_annotations(examples: DataFrame, key: str, labels: DataFrame, marker: tuple[str, str] = MARKER,
                     replacement: list[str] | None = None) -> DataFrame:
    """Accepted examples → tagged sentences with their marker variants, split by example.

    The split belongs to the example, drawn before any filter.
    """
    drawn = examples.withColumn("split", corpus.split_name(F.col(key)))
    labelled = corpus.lookup_span_labels(corpus.accepted(drawn), labels)
    tagged = corpus.tagged_sentences(labelled, F.col(key).alias("sent_id"), "split")
    return corpus.with_marker_variants(tagged, marker, replacement or MARKER_REPLACEMENT)


def from_export(sentences: DataFrame) -> DataFrame:
    """Label-tool sentences → repaired tags, split by sentence."""
    repaired = corpus.repaired_export(sentences.where(F.size("words") > 0))
    return repaired.select("sent_id", corpus.split_name(F.col("sent_id")).alias("split"),
                           F.lit(0).alias("variant"), "words", "tags")


def combined(annotated: DataFrame, exported: DataFrame) -> DataFrame:
    columns = ["sent_id", "split", "variant", "words", "tags"]
    return corpus.union_corpora(annotations=annotated.select(*columns), export=exported.select(*columns))
