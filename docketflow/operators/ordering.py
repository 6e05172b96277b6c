"""Numbering and running totals without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docketflow.session import cut_lineage

_SLICE = "_slice"


def running_total(df: DataFrame, group: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including each row of its group.

    ``order`` must be unique inside a group. Rows are range-partitioned by group
    and order, so a group that holds most of the rows is spread over all tasks;
    the slices are materialised once (their bounds are sampled and must not move),
    summed separately, and joined to the totals of the slices before them. The
    table of slice totals has at most one row per group and slice.
    """
    ranged = df.repartitionByRange(*group, *order).withColumn(_SLICE, F.spark_partition_id())
    ranged = cut_lineage(ranged.withColumn(name, value.cast("bigint")))
    keys = [*group, _SLICE]
    before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys).agg(F.sum(name).alias("_total")) \
        .select(*[F.col(k).alias(f"_o{k}") for k in keys],
                F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    condition = F.lit(True)
    for key in keys:
        condition = condition & F.col(key).eqNullSafe(F.col(f"_o{key}"))
    joined = ranged.join(offsets, condition).select(*ranged.columns, "_before")
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn(name, F.sum(name).over(inside) + F.col("_before")).drop(_SLICE, "_before")


def number_rows(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Adds ``name``: 1, 2, .. inside each group, in ``order``."""
    return running_total(df, group, order, F.lit(1), name)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of every key.

    Spark keeps one row per key and task before the shuffle (WindowGroupLimit),
    so a hot key sends one row per task and not all of them.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group, numbered; pre-limited per task before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn(name, rank.cast("bigint")).where(F.col(name) <= k)
