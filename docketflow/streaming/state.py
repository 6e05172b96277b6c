"""Streams that keep their state in Spark's state store.

Here a batch costs what its own rows cost: nothing that was written before is read again. For many keys set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider, which holds state on disk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docketflow.operators import state
from docketflow.session import file_names, is_complete, remove_path
from docketflow.sources.tables import Table, staged
from docketflow.streaming.ingest import POSITION


def latest_state(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The newest row of every key so far, as a stateful aggregation: one row of state for each key.

    Rows are compared by ``order``, a null below any value. Combined before the shuffle, so a hot key sends one row a
    task. The state never expires: a late row that is newer than what is held still counts.
    """
    others = [c for c in rows.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order))
    return rows.groupBy(*keys).agg(newest.alias("_row")).select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def start_latest(rows: DataFrame, target: Table, keys: list[str], order: list[str], checkpoint: str) -> StreamingQuery:
    """Keep a table of the newest row of every key, in update mode: a batch brings only the keys that it changed.

    The partition column has to follow from the key. Rows without a full key are left out; a replayed batch brings the
    same rows again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        changed, path = staged(batch.withColumn(POSITION, F.lit(0).cast("bigint")), "changed")
        state.upsert(target, changed, keys, order, POSITION)
        remove_path(batch.sparkSession, path)

    view = latest_state(rows.where(state.has_key(keys)), keys, order)
    return _start(view, "update", write, checkpoint)


def start_view(view: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write an aggregation over a stream as a whole after every batch, in complete mode; for results of bounded size.

    :func:`read_view` reads the last whole one. The one before it stays, so a reader in between loses nothing.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/{batch_id:012d}")
        for name in file_names(spark, path)[:-2]:
            remove_path(spark, f"{path}/{name}")

    return _start(view, "complete", write, checkpoint)


def read_view(spark: SparkSession, path: str) -> DataFrame:
    """The last whole result of :func:`start_view`."""
    whole = [name for name in file_names(spark, path) if is_complete(spark, f"{path}/{name}")]
    if not whole:
        raise ValueError(f"no result in {path}")
    return spark.read.parquet(f"{path}/{whole[-1]}")


def closed_windows(rows: DataFrame, event_time: str, length: str, delay: str, keys: list[str], **sums: Column) -> DataFrame:
    """Aggregates over windows of event time, given out once each, when the watermark has passed their end; then forgotten.

    Rows that come later than ``delay`` behind the newest are left out.
    """
    windows = rows.withWatermark(event_time, delay).groupBy(F.window(event_time, length).alias("_w"), *keys)
    return windows.agg(*[value.alias(name) for name, value in sums.items()]) \
        .select(F.col("_w.start").alias("window_start"), *keys, *sums)


def first_seen(rows: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose keys were not seen within ``delay``: the bounded form of the exact anti-join with a log.

    A key is held until the watermark, ``delay`` behind the newest event time of the batches before, reaches the event
    time of its first row plus ``delay``; then it is forgotten, and its next row counts as new. A repeat within ``delay``
    of the first row is never let through. Of equal keys in one batch one row stays. Rows without a full key all stay as
    one key.
    """
    return rows.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def start_append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what a stream gives out, a folder for each batch, which a replay replaces; read with ``spark.read.parquet``."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return _start(rows, "append", write, checkpoint)


def _start(rows: DataFrame, mode: str, write, checkpoint: str) -> StreamingQuery:
    return rows.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()
