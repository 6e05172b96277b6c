"""Feed alert: candidates → score → class log → tag → entity log → digest → messages."""

from __future__ import annotations

import dataclasses
import datetime as dt
from typing import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from docketflow import schemas
from docketflow.fixed_values import FEED_CLASS_TYPE, FEED_ENTITY_TYPE, FEED_INTRO
from docketflow.operators import digest, select, state, tagging
from docketflow.session import is_complete
from docketflow.sources.tables import Warehouse

Scorer = Callable[[DataFrame, str], DataFrame]
Tagger = Callable[[Column], Column]

KEYWORDS = ["warrant"]
GAZETTEER = {
    "black phone": "PHONE", "phone": "PHONE", "one parcel": "PACKAGE", "parcel": "PACKAGE", "silver car": "CAR",
    "car": "CAR",
}


@dataclasses.dataclass
class Alert:
    """Lazy results of one run."""

    scored: DataFrame
    class_log: DataFrame
    entities: DataFrame
    entity_log: DataFrame
    cases: DataFrame

    def blocks(self, intro: str | None) -> DataFrame:
        return digest.message_blocks(self.cases, intro)


def score_candidates(docket: DataFrame, predictions: DataFrame, start: dt.date | str, scorer: Scorer) -> DataFrame:
    found = select.candidates(docket, predictions, start)
    return scorer(select.classification_text(found), "to_classify")


def tag_positives(scored: DataFrame, order_column: str, tagger: Tagger) -> DataFrame:
    """Positive entries → one row per searched thing, in alert shape."""
    shaped = select.to_alert_shape(scored.where(F.col("predicted_class") == 1), order_column, *schemas.DOCKET_KEY)
    return tagging.entity_rows(shaped.withColumn("spans", tagger(F.col("description"))))


def from_scored(scored: DataFrame, order_column: str, tagger: Tagger) -> Alert:
    entities = tag_positives(scored, order_column, tagger)
    return Alert(
        scored=scored, class_log=state.class_log_rows(scored, schemas.DOCKET_KEY, FEED_CLASS_TYPE),
        entities=entities, entity_log=state.entity_log_rows(entities, schemas.DOCKET_KEY, FEED_ENTITY_TYPE),
        cases=digest.digest_cases(entities))


def run(docket: DataFrame, predictions: DataFrame, start: dt.date | str, order_column: str, scorer: Scorer,
        tagger: Tagger) -> Alert:
    """The whole alert as lazy DataFrames; not writing them is a dry run."""
    return from_scored(score_candidates(docket, predictions, start, scorer), order_column, tagger)


#: What a run notes of each batch below ``counts``: rows looked at, of these candidates, candidates after the start and
#: blank descriptions; rows scored, of these positive.
COUNTS = ["n_rows", "n_candidates", "n_recent", "n_blank", "n_scored", "n_positive"]


def _looked_at(start: dt.date | str) -> dict[str, Column]:
    wanted = select.is_candidate(F.col("document_type"))
    return {"n_rows": F.lit(True), "n_candidates": wanted, "n_recent": wanted & select.is_since(F.col("pub_date"), start),
            "n_blank": select.is_blank(F.col("description"))}


def publish(docket: DataFrame, warehouse: Warehouse, start: dt.date | str, order_column: str, scorer: Scorer,
            tagger: Tagger, root: str, run: str, batch_id: int, intro: str = FEED_INTRO,
            predictions: DataFrame | None = None) -> bool:
    """Score once, then write both logs and the outbox; False when there was nothing to score.

    Candidates are entries without a row in the class log (or in ``predictions``, a
    larger set that holds it). The scored rows are written first, under the run and
    the batch, and a replayed batch takes them up again; so it writes the same outbox,
    and the logs, to which only missing keys are added, stay as they are. The counts of
    the funnel are gathered while the scored rows are written, and written beside them.
    """
    spark = docket.sparkSession
    log = warehouse.table("predictions")
    place = f"run={run}/batch_id={batch_id}"
    folder = f"{root}/scored/{place}"
    if not is_complete(spark, folder):
        # Keys hold the publication time, so older rows of the log can match nothing, and their months are not opened.
        seen = select.since(log.read(), start) if predictions is None else predictions
        looked_at, kept = Observation(), Observation()
        found = score_candidates(docket.observe(looked_at, *select.counts(**_looked_at(start))), seen, start, scorer)
        found.observe(kept, *select.counts(n_scored=F.lit(True), n_positive=F.col("predicted_class") == 1)) \
            .write.mode("overwrite").parquet(folder)
        counts = {**looked_at.get, **kept.get}
        spark.createDataFrame([tuple(counts[c] for c in COUNTS)], ", ".join(f"{c} long" for c in COUNTS)).coalesce(1) \
            .write.mode("overwrite").parquet(f"{root}/counts/{place}")
    scored = spark.read.parquet(folder)
    if scored.isEmpty():
        return False
    alert = from_scored(scored, order_column, tagger)
    log.append(alert.class_log, "log_key")
    warehouse.table("ner_predictions").append(alert.entity_log, "log_key")
    digest.outbox(alert.blocks(intro)).write.mode("overwrite").parquet(f"{root}/outbox/{place}")
    return True
