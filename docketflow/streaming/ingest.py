"""Streaming ingest: landed snapshots → docket table, keyed and replay-safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketflow.functions.text import html_unescape
from docketflow.operators import state
from docketflow.schemas import DOCKET_KEY
from docketflow.session import file_names, remove_path
from docketflow.sources.feeds import feed_quarantine, normalise_entries
from docketflow.sources.tables import Table, staged

POSITION = "batch_position"

#: Batches one run deals its backlog into: each rewrites the partitions it touches, so a number that grew with the backlog
#: would make the run quadratic.
RUN_BATCHES = 4


def files_per_batch(spark: SparkSession, path: str, least: int) -> int:
    """Files a batch takes from a landing folder: ``least``, or as many as give the run at most RUN_BATCHES batches."""
    landed = [name for name in file_names(spark, path) if not name.startswith(("_", "."))]
    return max(least, -(-len(landed) // RUN_BATCHES))


def run_id(batch: DataFrame) -> str:
    """Name of the stream a batch belongs to; it outlives restarts and changes with a new checkpoint."""
    return batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "batch"


def stored_batch(batch: DataFrame) -> tuple[DataFrame, str]:
    """The batch, parsed once and stored, with the order of its rows by file and place; and its path."""
    return staged(batch.withColumn(POSITION, F.monotonically_increasing_id()), "batch")


def start_ingest(entries: DataFrame, docket: Table, quarantine_path: str, checkpoint: str,
                 unescape=html_unescape) -> StreamingQuery:
    """Upsert feed entries as they land and set broken ones aside.

    A replayed batch leaves the same rows in the table and rewrites its own
    quarantine folder. Entries without a full key are quarantined by its rules.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        rows, path = stored_batch(batch)
        docketed, parsed = staged(normalise_entries(rows, unescape, keep=(POSITION,)), "entries")   # the upsert reads them twice
        state.upsert_docket(docket, docketed, POSITION)
        feed_quarantine(rows, unescape).write.mode("overwrite") \
            .parquet(f"{quarantine_path}/run={run_id(batch)}/batch_id={batch_id}")
        remove_path(batch.sparkSession, parsed)
        remove_path(batch.sparkSession, path)

    return _start(entries, write, checkpoint)


def start_upsert(rows: DataFrame, target: Table, keys: list[str], order: list[str], rejects_path: str,
                 checkpoint: str) -> StreamingQuery:
    """Keep the newest row of every key of a stream in a table; rows without a full key go to ``rejects_path``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        stored, path = stored_batch(batch)
        state.upsert(target, stored, keys, order, POSITION)
        state.rejected(stored, keys).drop(POSITION).write.mode("overwrite") \
            .parquet(f"{rejects_path}/run={run_id(batch)}/batch_id={batch_id}")
        remove_path(batch.sparkSession, path)

    return _start(rows, write, checkpoint)


def start_docket(entries: DataFrame, docket: Table, checkpoint: str, after=None) -> StreamingQuery:
    """Upsert docket rows; ``after(batch, batch_id)`` runs when the batch is in the table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        stored, path = stored_batch(batch)
        state.upsert(docket, stored, DOCKET_KEY, ["scrape_date"], POSITION)
        if after is not None:
            after(stored, batch_id)
        remove_path(batch.sparkSession, path)

    return _start(entries, write, checkpoint)


def _start(rows: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
