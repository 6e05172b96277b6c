"""Streaming alerts: what a schedule runs is one ``availableNow`` pass."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docketflow import schemas
from docketflow.fixed_values import CANDIDATE_TYPE, FEED_CLASS_TYPE
from docketflow.operators import select, state
from docketflow.plans import feed_alert
from docketflow.session import file_names, read_text, remove_path, scratch_path, write_text
from docketflow.sources.tables import Warehouse, staged
from docketflow.streaming.ingest import _start, run_id, start_docket


def start_candidates(docket: DataFrame, known: DataFrame, start: dt.date, warehouse: Warehouse,
                     checkpoint: str) -> StreamingQuery:
    """Note every candidate once, under a type of its own: nothing is scored here.

    Candidates are entries without a known prediction; noted ones are not noted again. The
    known keys that a candidate can have, those after ``start``, are stored once, by month; a batch
    opens the months of its own candidates, and meets them once: what is left is stored for the log.
    """
    log = warehouse.table("predictions")
    keys = schemas.DOCKET_KEY
    months = "pub_month"
    path = scratch_path(docket.sparkSession, "known")
    select.since(known.where(F.col("prediction_type") == FEED_CLASS_TYPE).select(*keys), start).distinct() \
        .withColumn(months, F.date_format("pub_date", "yyyy-MM")) \
        .hint("rebalance", F.col(months)).write.partitionBy(months).parquet(path)
    spark = docket.sparkSession
    stored = T.StructType([*[known.schema[k] for k in keys], T.StructField(months, T.StringType())])

    def write(batch: DataFrame, batch_id: int) -> None:
        candidates = select.since(batch, start).where(select.is_candidate(F.col("document_type"))).select(*keys)
        rows, folder = staged(candidates, "candidates")
        touched = [r[0] for r in rows.select(F.date_format("pub_date", "yyyy-MM")).distinct().collect()]
        seen = spark.read.schema(stored).parquet(path).where(F.col(months).isin(touched))
        # Stored keys are distinct already. The log reads its new rows twice: for their partitions and for the rows.
        found, left = staged(rows.join(seen.select(*keys), keys, "left_anti"), "found")
        scored = found.withColumns({"predicted_class": F.lit(None).cast("int"), "likelihood": F.lit(None).cast("double")})
        log.append(state.class_log_rows(scored, keys, CANDIDATE_TYPE), "log_key")
        remove_path(spark, left)
        remove_path(spark, folder)

    return _start(docket, write, checkpoint)


def start_feed_alert(docket: DataFrame, start: dt.date, order_column: str, scorer, tagger, warehouse: Warehouse,
                     root: str, checkpoint: str) -> StreamingQuery:
    """Score, log and digest every micro-batch of docket rows; only the log's partitions of its keys are opened."""
    log = warehouse.table("predictions")

    def write(batch: DataFrame, batch_id: int) -> None:
        rows, folder = staged(batch, "batch")
        feed_alert.publish(rows, warehouse, start, order_column, scorer, tagger, root, run_id(batch), batch_id,
                           predictions=log.read(log.partitions_of(rows)))
        remove_path(batch.sparkSession, folder)

    return _start(docket, write, checkpoint)


def start_feed_run(entries: DataFrame, start: dt.date, scorer, tagger, warehouse: Warehouse, root: str,
                   checkpoint: str) -> StreamingQuery:
    """The feed run without its purge: upsert the docket, then alert on those of the batch's entries that are unscored.

    A batch reads the partitions of its own entries only, and notes them for :func:`purge_after_run`.
    """
    docket, log = warehouse.table("rss_docket_entries"), warehouse.table("predictions")

    def alert(batch: DataFrame, batch_id: int) -> None:
        touched = docket.partitions_of(batch.where(state.has_key(schemas.DOCKET_KEY)))
        rows = select.with_match(docket.read(touched), batch, schemas.DOCKET_KEY) \
            .withColumn("entry_order", F.concat_ws(" ", *reversed(schemas.DOCKET_KEY)))
        run = run_id(batch)
        scored = feed_alert.publish(rows, warehouse, start, "entry_order", scorer, tagger, root, run, batch_id,
                                    predictions=log.read(touched))
        write_text(batch.sparkSession, f"{root}/touched/{run}-{batch_id}.json", json.dumps({"scored": scored, "touched": touched}))

    return start_docket(entries, docket, checkpoint, alert)


def purge_after_run(warehouse: Warehouse, root: str) -> None:
    """Purge what was never a candidate from the partitions that were touched since the last purge.

    It follows a run that scored something; after an empty one nothing happens, and its partitions wait for the next.
    """
    spark, docket, log = warehouse.spark, warehouse.table("rss_docket_entries"), warehouse.table("predictions")
    names = [f"{root}/touched/{n}" for n in file_names(spark, f"{root}/touched") if n.endswith(".json")]
    notes = [json.loads(read_text(spark, n)) for n in names]
    if not any(n["scored"] for n in notes):
        return
    only = sorted({tuple(values) for n in notes for values in n["touched"]})
    # Docket and log have the same layout, and an entry's log rows lie in the partition of the same name.
    state.purge_docket(docket, log.read(only), only=only)
    for name in names:
        remove_path(spark, name)


def run_feed(entries: DataFrame, start: dt.date, scorer, tagger, warehouse: Warehouse, root: str, checkpoint: str) -> None:
    """One whole run over what has landed, with the purge at its end."""
    start_feed_run(entries, start, scorer, tagger, warehouse, root, checkpoint).awaitTermination()
    purge_after_run(warehouse, root)
