"""Key and reference audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys held by more than one row; counted before the shuffle, so a hot key is one row per task."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where(F.col("n_rows") > 1)


def orphan_keys(child: DataFrame, parent: DataFrame, on: dict[str, str]) -> DataFrame:
    """Child keys without a parent row, with the number of child rows.

    Children are counted per key first: the join then sees one row per key.
    """
    counted = child.groupBy(*on).agg(F.count(F.lit(1)).alias("n_rows"))
    parents = parent.select(*[F.col(p).alias(c) for c, p in on.items()]).distinct()
    return counted.join(parents, list(on), "left_anti")
