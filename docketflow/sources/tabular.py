"""CSV files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docketflow import schemas
from docketflow.functions.text import canonical_label


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Quoted CSV with a header; doubled quotes and line breaks inside quotes are kept."""
    return spark.read.csv(path, schema=schema, header=True, multiLine=True, quote='"', escape='"',
                          enforceSchema=True)


def read_press_releases(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.PRESS_RELEASE)


def read_labelled_dockets(spark: SparkSession, path: str) -> DataFrame:
    """Hand-labelled docket entries; the unnamed index column becomes ``row_no``."""
    return read_csv(spark, path, schemas.LABELLED_DOCKET)


def read_token_labels(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """Token → canonical label; of duplicate tokens the last row wins.

    ``numbered`` files have a third column ``row_no`` that gives the order, so they may be many; others are read in file order.
    """
    if numbered:
        rows = read_csv(spark, path, schemas.NUMBERED_TOKEN_LABEL)
    else:
        rows = read_csv(spark, path, schemas.TOKEN_LABEL).withColumn("row_no", F.monotonically_increasing_id())
    return rows.groupBy("token").agg(canonical_label(F.max_by("label", "row_no")).alias("label"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', ignoreLeadingWhiteSpace=False,
                                   ignoreTrailingWhiteSpace=False)
