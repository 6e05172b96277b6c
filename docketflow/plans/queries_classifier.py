"""Queries: a classifier trained from word counts, and how it does beside a baseline on texts it has not seen."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from docketflow.operators import corpus, evaluate, scoring, training
from docketflow.plans.adapters import table
from docketflow.plans.queries_alerts import _SQL_FORMS, _sql_ratio
from docketflow.plans.queries_corpus import _sql_split
from docketflow.plans.registry import query
from docketflow.session import scratch_path

_COUNTS = f"""
counts AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({_SQL_FORMS}) AS word FROM documents)
  WHERE word <> '' GROUP BY 1, 2),
labelled AS (SELECT doc_id, quality AS label, {_sql_split("doc_id::varchar")} AS split FROM labels),
by_class AS (SELECT word, sum(CASE WHEN label = 0 THEN n ELSE 0 END)::bigint AS n0,
  sum(CASE WHEN label = 1 THEN n ELSE 0 END)::bigint AS n1
  FROM counts JOIN labelled USING (doc_id) WHERE split = 'train' GROUP BY 1)"""
_SCORED = f"""{_COUNTS},
totals AS (SELECT sum(n0) AS t0, sum(n1) AS t1, count(*) AS v FROM by_class),
prior AS (SELECT ln((count(*) FILTER (label = 1) + 1.0) / (count(*) FILTER (label = 0) + 1.0)) AS p FROM labelled
  WHERE split = 'train'),
weights AS (SELECT word, ln((n1 + 1) / (t1 + v)::double) - ln((n0 + 1) / (t0 + v)::double) AS weight FROM by_class, totals),
scored AS (SELECT doc_id, (sum(n * weight) + any_value(p) > 0)::int AS predicted_class
  FROM counts JOIN weights USING (word), prior GROUP BY 1)"""


def _labels(spark, d):
    """Labels with the split of their document."""
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"),
                                            corpus.split_name(F.col("doc_id").cast("string")).alias("split"))


def _counts(spark, d, only=None):
    """Word counts of all documents, or of those in ``only``, which are picked before their words are cut."""
    documents = table(spark, d, "documents").select("doc_id", "text")
    if only is not None:
        documents = documents.join(only.select("doc_id").distinct(), "doc_id", "left_semi")
    return scoring.word_counts(documents, "doc_id", "text")


def _by_class(spark, d):
    train = _labels(spark, d).where(F.col("split") == "train")
    return scoring.class_counts(_counts(spark, d, train), train, "doc_id")


def _scored(spark, d, only=None):
    train = _labels(spark, d).where(F.col("split") == "train")
    seen = train.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    prior = math.log((seen[0] + 1.0) / (seen[1] + 1.0))
    return scoring.bayes_score(_counts(spark, d, only), scoring.bayes_weights(_by_class(spark, d)), "doc_id", prior)


@query("text_classifier_counts", f"WITH {_COUNTS} SELECT word, n0, n1 FROM by_class")
def text_classifier_counts(spark, d):
    """What the classifier is trained on: occurrences of words in the texts of either class."""
    return _by_class(spark, d)


@query("ml_text_classifier", f"WITH {_SCORED} SELECT doc_id, predicted_class FROM scored")
def ml_text_classifier(spark, d):
    """Trained on the labelled training split, applied to all documents."""
    return _scored(spark, d).select("doc_id", "predicted_class")


_METRICS = ", ".join(f"{expr} AS {name}" for name, expr in {
    "accuracy": _sql_ratio("tp + tn", "n"), "precision": _sql_ratio("tp", "(tp + fp)"), "recall": _sql_ratio("tp", "(tp + fn)"),
    "f1": _sql_ratio("2 * tp", "(2 * tp + fp + fn)")}.items())


@query("classifier_comparison", f"""
WITH {_SCORED},
both_scorers AS (SELECT 'model' AS scorer, split, label, predicted_class FROM scored JOIN labelled USING (doc_id)
  UNION ALL SELECT 'keyword', split, label, (NOT text ILIKE '%|%')::int FROM documents JOIN labelled USING (doc_id)),
c AS (SELECT scorer, CASE WHEN split = 'train' THEN 'train' ELSE 'held out' END AS part, count(*) AS n,
  count(*) FILTER (label = 1 AND predicted_class = 1) AS tp, count(*) FILTER (label <> 1 AND predicted_class = 1) AS fp,
  count(*) FILTER (label = 1 AND predicted_class <> 1) AS fn, count(*) FILTER (label <> 1 AND predicted_class <> 1) AS tn
  FROM both_scorers GROUP BY 1, 2)
SELECT scorer, part, n, tp, fp, fn, tn, {_METRICS} FROM c""")
def classifier_comparison(spark, d):
    """The model beside a keyword rule, on the texts it was trained on and on the others."""
    labels = _labels(spark, d)
    scored = _scored(spark, d, labels)
    rule = scoring.keyword_score(table(spark, d, "documents"), "text", ["|"]) \
        .select("doc_id", (1 - F.col("predicted_class")).alias("predicted_class"))
    both = scored.select(F.lit("model").alias("scorer"), "doc_id", "predicted_class") \
        .unionByName(rule.withColumn("scorer", F.lit("keyword"))).join(labels, "doc_id")
    part = F.when(F.col("split") == "train", "train").otherwise("held out")
    return evaluate.classifier_metrics(both.withColumn("part", part), by=["scorer", "part"])


# --- trained by iterations ----------------------------------------------------------------------------------------

def _trained(spark, d):
    """Fit on the labelled training split, save, load, and score every document."""
    path = scratch_path(spark, "classifier")
    documents = table(spark, d, "documents").select("doc_id", "text")
    train = documents.join(_labels(spark, d).where(F.col("split") == "train").select("doc_id", "label"), "doc_id")
    training.train(train, "text", path)
    return training.trained_score(spark, path, documents, "text")


@query("trained_classifier_scores", """
SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels) THEN 'labelled' ELSE 'not labelled' END AS kind,
  true AS has_class_of_likelihood FROM documents""")
def trained_classifier_scores(spark, d):
    """Every document has a likelihood, and the class that it means."""
    known = table(spark, d, "labels").select("doc_id").distinct().withColumn("kind", F.lit("labelled"))
    fits = (F.col("likelihood").between(0, 1)) & ((F.col("likelihood") > 0.5) == (F.col("predicted_class") == 1))
    return _trained(spark, d).join(known, "doc_id", "left").select(
        "doc_id", F.coalesce("kind", F.lit("not labelled")).alias("kind"), fits.alias("has_class_of_likelihood"))


@query("trained_classifier_report", f"""
WITH labelled AS (SELECT doc_id, quality AS label, {_sql_split("doc_id::varchar")} AS split FROM labels),
r AS (SELECT CASE WHEN split = 'train' THEN 'train' ELSE 'held out' END AS part, label, (NOT text ILIKE '%|%')::int AS rule
  FROM documents JOIN labelled USING (doc_id))
SELECT part, count(*) AS n, round(avg((rule = label)::int), 6) AS rule_accuracy, true AS beats_rule FROM r GROUP BY 1""")
def trained_classifier_report(spark, d):
    """Whether it is right more often than the keyword rule, on the texts it was fitted on and on the others."""
    rule = scoring.keyword_score(table(spark, d, "documents"), "text", ["|"]) \
        .select("doc_id", (1 - F.col("predicted_class")).alias("rule"))
    rows = _trained(spark, d).select("doc_id", "predicted_class").join(_labels(spark, d), "doc_id").join(rule, "doc_id")
    part = F.when(F.col("split") == "train", "train").otherwise("held out").alias("part")
    right = lambda c: F.avg((F.col(c) == F.col("label")).cast("int"))
    return rows.groupBy(part).agg(
        F.count(F.lit(1)).alias("n"), F.round(right("rule"), 6).alias("rule_accuracy"),
        (right("predicted_class") > right("rule")).alias("beats_rule"))
