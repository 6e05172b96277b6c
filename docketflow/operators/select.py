"""Choosing docket entries and documents that still have to be scored."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.fixed_values import (
    ARCHIVE_HOST, BARE_CASE_NAME, BARE_CASE_SENTENCE, CANDIDATE_WORDS, FEED_CLASS_TYPE, FEED_LOOKBACK_DAYS,
)
from docketflow.functions import parse
from docketflow.functions.text import strip_whitespace
from docketflow.schemas import DOCKET_KEY


def is_candidate(document_type: Column) -> Column:
    """The type names a warrant or an unsealing, in any case; a null type does not."""
    hit = F.lit(False)
    for word in CANDIDATE_WORDS:
        hit = hit | document_type.ilike(f"%{word}%")
    return hit


def lookback_start(run_date: dt.date, days: int = FEED_LOOKBACK_DAYS) -> dt.date:
    """Default lower bound of a run; the run date is always given, never the clock."""
    return run_date - dt.timedelta(days=days)


def is_since(time: Column, start: dt.date | str) -> Column:
    day = start if isinstance(start, str) else start.isoformat()
    return time > F.lit(f"{day} 00:00:00").cast("timestamp_ntz")


def is_blank(text: Column) -> Column:
    """Nothing but white space; a null is not blank, it is missing."""
    return strip_whitespace(text) == ""


def since(docket: DataFrame, start: dt.date | str) -> DataFrame:
    """Entries published strictly after midnight of ``start``; pruned by month where stored so."""
    day = start if isinstance(start, str) else start.isoformat()
    later = docket.where(is_since(F.col("pub_date"), start))
    return later.where(F.col("pub_month") >= day[:7]) if "pub_month" in docket.columns else later


def without_match(rows: DataFrame, log: DataFrame, on: list[str]) -> DataFrame:
    """Rows with no log row of the same key.

    The log's keys are made distinct first: the distinct shuffles by the same
    keys as the join, combines repeats of a hot key before that shuffle and
    leaves the join one row per key.
    """
    return rows.join(log.select(*on).distinct(), on, "left_anti")


def with_match(rows: DataFrame, log: DataFrame, on: list[str]) -> DataFrame:
    """Rows with at least one log row of the same key."""
    return rows.join(log.select(*on).distinct(), on, "left_semi")


def candidates(
    docket: DataFrame, predictions: DataFrame, start: dt.date | str, prediction_type: str | None = FEED_CLASS_TYPE
) -> DataFrame:
    """Candidate entries after ``start`` without a prediction of the type (None = any type)."""
    log = predictions if prediction_type is None else predictions.where(F.col("prediction_type") == prediction_type)
    return without_match(since(docket, start).where(is_candidate(F.col("document_type"))), log, DOCKET_KEY)


def addressed(results: DataFrame, host: str = ARCHIVE_HOST) -> DataFrame:
    """Search results with whole addresses."""
    return results.withColumn("absolute_url", parse.absolute_url(F.col("absolute_url"), host))


def unseen_documents(results: DataFrame, log: DataFrame, host: str = ARCHIVE_HOST) -> DataFrame:
    """Search results whose address is in the log under no prediction type."""
    return without_match(addressed(results, host), log, ["absolute_url"])


def classification_text(rows: DataFrame, name: str = "to_classify") -> DataFrame:
    """Adds ``case name | document type``; rows where either is null leave here."""
    text = F.concat("case_name", F.lit(" | "), "document_type")
    return rows.withColumn(name, text).where(F.col(name).isNotNull())


def to_alert_shape(rows: DataFrame, order_column: str, *keep: str, substring: bool = False) -> DataFrame:
    """Docket entries → the columns alerts are built from.

    A case name that is exactly the bare name becomes a full sentence for the
    tagger; ``substring=True`` replaces the bare name wherever it occurs.
    """
    name = F.col("case_name")
    sentence = F.replace(name, F.lit(BARE_CASE_NAME), F.lit(BARE_CASE_SENTENCE)) if substring \
        else F.when(name == BARE_CASE_NAME, F.lit(BARE_CASE_SENTENCE)).otherwise(name)
    return rows.select(
        *keep, F.col(order_column).alias("doc_order"), name.alias("case_name"), F.col("court").alias("court_id"),
        parse.entry_address(F.col("guid")).alias("absolute_url"), sentence.alias("description"), "document_type")


def counts(**steps: Column) -> list[Column]:
    """How many rows meet each condition: for an aggregation, or for metrics gathered beside a write."""
    return [F.count_if(condition).alias(name) for name, condition in steps.items()]


def funnel(rows: DataFrame, **steps: Column) -> DataFrame:
    """Counts of several conditions in one pass over the rows."""
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), *counts(**steps))
