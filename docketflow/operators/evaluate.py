"""Quality of classifiers and taggers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.round(a / b, 6)).otherwise(F.lit(0.0))


def confusion(scored: DataFrame, label: str = "label", predicted: str = "predicted_class") -> DataFrame:
    return scored.groupBy(F.col(label).alias("label"), F.col(predicted).alias("predicted_class")) \
        .agg(F.count(F.lit(1)).alias("n"))


def classifier_metrics(scored: DataFrame, label: str = "label", predicted: str = "predicted_class",
                       by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall and F1 from one aggregation."""
    y, p = F.col(label) == 1, F.col(predicted) == 1
    counts = scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    return counts.withColumns({
        "accuracy": _ratio(F.col("tp") + F.col("tn"), F.col("n")),
        "precision": _ratio(F.col("tp"), F.col("tp") + F.col("fp")),
        "recall": _ratio(F.col("tp"), F.col("tp") + F.col("fn")),
        "f1": _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")),
    })


def wrong_positives(scored: DataFrame, label: str = "label") -> DataFrame:
    """Rows scored positive against their label, for re-labelling."""
    return scored.where((F.col("predicted_class") == 1) & (F.col(label) == 0))


def span_counts(gold: DataFrame, predicted: DataFrame, key: str = "sent_id") -> DataFrame:
    """True positives, false positives and misses per class, of spans (key, start, end, tag) from two sources."""
    columns = [key, "start", "end", "tag"]
    return side_counts(gold.select(*columns, F.lit(True).alias("is_gold")).unionByName(
        predicted.select(*columns, F.lit(False).alias("is_gold"))), key)


def side_counts(both: DataFrame, key: str = "sent_id") -> DataFrame:
    """The same of one table of spans that says of each whether it is gold.

    Spans count as found when key, start, end and tag agree. One aggregation over
    both sides takes the place of a full outer join, and the table is read once.
    """
    g, p = F.max(F.col("is_gold").cast("int")).alias("g"), F.max((~F.col("is_gold")).cast("int")).alias("p")
    spans = both.groupBy(key, "start", "end", "tag").agg(g, p)
    return spans.groupBy("tag").agg(
        F.sum(F.col("g") * F.col("p")).alias("tp"), F.sum((1 - F.col("g")) * F.col("p")).alias("fp"),
        F.sum(F.col("g") * (1 - F.col("p"))).alias("fn"))


def span_f1_by_class(counts: DataFrame) -> DataFrame:
    return counts.withColumn("f1", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def span_f1(counts: DataFrame) -> DataFrame:
    """Micro F1 over pooled counts and macro F1 as the plain mean of the classes."""
    f1 = F.col("tp") * 2.0 / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0))
    return counts.agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.round(F.avg(F.coalesce(f1, F.lit(0.0))), 6).alias("f1_macro"),
    ).withColumn("f1_micro", _ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))
