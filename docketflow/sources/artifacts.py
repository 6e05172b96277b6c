"""Which listed files exist already, so that only missing ones are processed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below ``path``; the content column is pruned, so files are listed and not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def missing_artifacts(manifest: DataFrame, existing: DataFrame, on: str = "artifact") -> DataFrame:
    return manifest.join(existing.select(on).distinct(), on, "left_anti")


def missing_files(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Manifest entries without a file of that relative path below ``folder``."""
    relative = F.substring_index("path", folder.rstrip("/") + "/", -1)
    return missing_artifacts(manifest, list_files(spark, folder).select(relative.alias("artifact")))
