"""Checks at the write: rows that break a key or a reference are set aside with the rule they break.

A gate marks every row of a batch with the first rule it breaks, in one pass:

* ``key is null``: a part of the key is missing,
* ``no parent``: the parent table has no row of the reference,
* ``key exists``: the table already holds the key,
* ``key repeats``: an earlier row of the batch, by ``order``, has the key and breaks no rule itself.

Accepted rows and violations together are the batch, row for row.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.operators.select import without_match
from docketflow.operators.state import has_key
from docketflow.session import is_complete, remove_path
from docketflow.sources.tables import Table, staged

NULL_KEY, NO_PARENT, EXISTS, REPEATS = "key is null", "no parent", "key exists", "key repeats"
RULE = "violation"


def _all(conditions: list[Column]) -> Column:
    return functools.reduce(lambda a, b: a & b, conditions)


def _flagged(rows: DataFrame, table: DataFrame, on: list[str], flag: str) -> DataFrame:
    """Adds whether the table holds the row's columns; its keys are made distinct first, so no row is doubled."""
    held = table.select(*[F.col(c).alias(f"_{flag}_{c}") for c in on]).distinct().withColumn(flag, F.lit(True))
    same = _all([F.col(c) == F.col(f"_{flag}_{c}") for c in on])
    return rows.join(held, same, "left").select(*rows.columns, F.coalesce(flag, F.lit(False)).alias(flag))


def gated(batch: DataFrame, held: DataFrame, keys: list[str], order: list[str], parent: DataFrame | None = None,
          reference: dict[str, str] | None = None) -> DataFrame:
    """The batch with ``violation``: null for a row that may be written, or the first rule it breaks.

    ``held`` is the table's content (its partitions of the batch are enough), ``reference`` maps columns of the batch to
    those of the parent. Of rows that share a key, the first by ``order``, which must tell them apart, of those that break
    no other rule is accepted; it is found by an aggregation that is combined before the shuffle.
    """
    rows = _flagged(batch, held, keys, "_held")
    if parent is not None:
        rows = _flagged(rows, parent.select(*[F.col(p).alias(c) for c, p in reference.items()]), list(reference), "_parent")
    else:
        rows = rows.withColumn("_parent", F.lit(True))
    broken = F.when(~has_key(keys), NULL_KEY).when(~F.col("_parent"), NO_PARENT).when(F.col("_held"), EXISTS)
    rows = rows.withColumn(RULE, broken).drop("_held", "_parent")
    place = F.struct(*order)
    first = rows.where(F.col(RULE).isNull()).groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.min(place).alias("_first"))
    joined = rows.join(first, _all([F.col(k) == F.col(f"_k_{k}") for k in keys]), "left")
    later = F.col(RULE).isNull() & (place > F.col("_first"))
    return joined.withColumn(RULE, F.when(later, REPEATS).otherwise(F.col(RULE))).select(*batch.columns, RULE)


def append_checked(table: Table, batch: DataFrame, keys: list[str], order: list[str], path: str,
                   parent: DataFrame | None = None, reference: dict[str, str] | None = None) -> DataFrame:
    """Append the rows that break no rule, and give the batch with its verdicts, which are kept below ``path``.

    The verdicts are stored before anything is written; a rerun after a stop takes them up again and adds only the
    accepted rows that are not in the table yet.
    """
    spark = batch.sparkSession
    if not is_complete(spark, path):
        only = table.touched(table.placed(batch.select(*table.schema.names)))
        gated(batch, table.read(only), keys, order, parent, reference).write.mode("overwrite").parquet(path)
    judged = spark.read.parquet(path)
    accepted, folder = staged(table.placed(judged.where(F.col(RULE).isNull())), "accepted")
    fresh = without_match(accepted, table.read(table.touched(accepted)), keys)
    fresh.select(*accepted.columns).write.insertInto(table.name)
    remove_path(spark, folder)
    return judged
