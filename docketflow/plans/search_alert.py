"""Search alert: capped results → unseen → score the description → logs → digest → JSON report.

Differs from the feed alert in its key (the address, whatever the prediction
type), in the text that is scored, in carrying the description and in the report.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.fixed_values import (
    SEARCH_ALERT_CAP, SEARCH_CLASS_TYPE, SEARCH_ENTITY_TYPE, SEARCH_INTRO, SEARCH_LOOKBACK_DAYS, SEARCH_PHRASE,
)
from docketflow.operators import digest, select, state, tagging
from docketflow.operators.ordering import number_rows
from docketflow.plans.feed_alert import Alert, Scorer, Tagger
from docketflow.session import is_complete, remove_path
from docketflow.sources import search_results
from docketflow.sources.tables import Warehouse, staged

URL_KEY = ["absolute_url"]

GAZETTEER = {
    "hot plate": "ELECTRONIC_DEVICES_OTHER_THAN_PHONES", "plate": "CAR", "ring": "CLOTHES", "gizmo": "PHONE",
    "old gizmo": "ELECTRONIC_DEVICES_OTHER_THAN_PHONES", "red gear": "L-GEAR", "gear": "BAG", "bolt": "MONEY",
}


def from_scored(scored: DataFrame, tagger: Tagger) -> Alert:
    positives = scored.where(F.col("predicted_class") == 1)
    shaped = positives.select("doc_order", F.col("caseName").alias("case_name"), "court_id", "absolute_url",
                              "description")
    entities = tagging.entity_rows(shaped.withColumn("spans", tagger(F.col("description"))))
    return Alert(
        scored=scored, class_log=state.class_log_rows(scored, URL_KEY, SEARCH_CLASS_TYPE), entities=entities,
        entity_log=state.entity_log_rows(entities, URL_KEY, SEARCH_ENTITY_TYPE), cases=digest.digest_cases(entities))


def run(results: DataFrame, log: DataFrame, scorer: Scorer, tagger: Tagger, text_column: str = "description") -> Alert:
    """``results``: doc_order, absolute_url (path), caseName, court_id, description."""
    return from_scored(scorer(select.unseen_documents(results, log), text_column), tagger)


def landed_results(spark: SparkSession, path: str, run_date: dt.date, phrase: str = SEARCH_PHRASE,
                   lookback_days: int = SEARCH_LOOKBACK_DAYS, cap: int | None = SEARCH_ALERT_CAP) -> DataFrame:
    """What the alert's search finds in landed pages, with ``doc_order``.

    Documents that hold the phrase and were filed since the lookback, of the pages
    up to the one that brings their number beyond ``cap`` (None reads all).
    """
    found = search_results.search_by_description(
        search_results.explode_pages(search_results.read_search_pages(spark, path)).withColumnRenamed("dateFiled", "date_filed"),
        phrase, filed_after=select.lookback_start(run_date, lookback_days))
    found, _ = staged(found, "search")   # pages are opened and parsed once
    if cap is not None:
        sizes = found.groupBy("page_no", "page_path").agg(F.count(F.lit(1)).alias("n_records"))
        found = found.join(search_results.kept_pages(sizes, cap).select("page_no", "page_path"), ["page_no", "page_path"], "left_semi")
    # Pages are numbered anew, since several may have no number or share one. They hold far fewer than a million results.
    place = ["page_no", "page_path"]
    pages = number_rows(found.select(*place).distinct(), [], place, "page")
    return found.join(pages, place).withColumn("doc_order", F.col("page") * 1_000_000 + F.col("pos")).drop(*place, "page", "pos")


def publish(results: DataFrame, warehouse: Warehouse, scorer: Scorer, tagger: Tagger, root: str, run: str, batch_id: int,
            intro: str = SEARCH_INTRO) -> bool:
    """Score once, write logs, outbox and the JSON report; False when nothing was new."""
    spark = results.sparkSession
    log = warehouse.table("courtlistener_predictions")
    folder = f"{root}/scored/run={run}/batch_id={batch_id}"
    if not is_complete(spark, folder):
        found, path = staged(select.addressed(results), "found")   # the sketch asks for it several times
        unseen = log.sketch().unseen(found)
        scorer(unseen, "description").write.mode("overwrite").parquet(folder)
        remove_path(spark, path)
    scored = spark.read.parquet(folder)
    if scored.isEmpty():
        return False
    alert = from_scored(scored, tagger)
    log.append(alert.class_log, "log_key")
    warehouse.table("courtlistener_ner_predictions").append(alert.entity_log, "log_key")
    place = f"run={run}/batch_id={batch_id}"
    digest.outbox(alert.blocks(intro)).write.mode("overwrite").parquet(f"{root}/outbox/{place}")
    digest.json_report(alert.cases).write.mode("overwrite").json(f"{root}/report/{place}")
    return True
