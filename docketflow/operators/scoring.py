"""Scorers: keyword rule, linear model, Arrow harness for any model, naive Bayes from word counts.

Every scorer but the last adds ``predicted_class`` (0/1) and ``likelihood`` to a DataFrame,
reading one text column, and is narrow: no shuffle.
"""

from __future__ import annotations

from typing import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.fixed_values import CLS_ID, MAX_TOKENS, PAD_ID, SEP_ID
from docketflow.functions.text import let, match_form, words
from docketflow.sources.tables import staged

FIRST_WORD_ID = 1000
VOCABULARY = 29000


def class_and_likelihood(logit0: Column, logit1: Column) -> list[Column]:
    """Arg-max of two logits (a tie is class 0) and the soft-max share of class 1."""
    return [F.when(logit1 > logit0, 1).otherwise(0).alias("predicted_class"),
            (F.lit(1.0) / (F.lit(1.0) + F.exp(logit0 - logit1))).alias("likelihood")]


def keyword_score(df: DataFrame, text_column: str, keywords: list[str]) -> DataFrame:
    """Baseline: class 1 when any keyword occurs, in any case."""
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.col(text_column).ilike(f"%{word}%")
    positive = F.coalesce(hit, F.lit(False)).cast("int")
    return df.withColumns({"predicted_class": positive, "likelihood": positive.cast("double")})


def scored_words(text: Column, max_tokens: int | None) -> Column:
    forms = F.transform(words(text), match_form)
    return F.slice(forms, 1, max_tokens) if max_tokens else forms


def linear_score(
    df: DataFrame, text_column: str, weights: dict[str, float], bias: float = 0.0, max_tokens: int | None = None
) -> DataFrame:
    """Sum of word weights, as expressions only. ``max_tokens`` cuts the text as the encoder does."""
    forms = scored_words(F.col(text_column), max_tokens)
    table = F.create_map(*[F.lit(part) for pair in weights.items() for part in pair])
    known = F.filter(forms, lambda w: w.isin(list(weights)))
    total = F.aggregate(known, F.lit(float(bias)), lambda acc, w: acc + F.element_at(table, w))
    predicted, likelihood = class_and_likelihood(F.lit(0.0), total)
    return df.withColumns({"predicted_class": predicted, "likelihood": likelihood})


def encode(text: Column, max_len: int = MAX_TOKENS) -> Column:
    """Word ids between the two special ids, cut to ``max_len`` and padded to it.

    The cut comes last, so a long text loses its end mark. Ids are hashes of the
    words, so no vocabulary has to be shipped.
    """
    def word_id(word: Column) -> Column:
        return (F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("bigint") % VOCABULARY + FIRST_WORD_ID).cast("int")

    forms = F.transform(F.slice(words(text), 1, max_len), match_form)   # later words cannot reach the result
    ids = F.concat(F.array(F.lit(CLS_ID)), F.transform(forms, word_id), F.array(F.lit(SEP_ID)))
    return let(F.slice(ids, 1, max_len),
               lambda cut: F.concat(cut, F.array_repeat(F.lit(PAD_ID), F.lit(max_len) - F.size(cut))))


def attention_mask(ids: Column) -> Column:
    return F.transform(ids, lambda i: (i > PAD_ID).cast("int"))


# A scorer factory runs once per Python task and returns a function from a list
# of texts to an (n, 2) array of logits.
ScorerFactory = Callable[[], Callable[[list], np.ndarray]]


def score_with(df: DataFrame, text_column: str, factory: ScorerFactory, batch_size: int = 32) -> DataFrame:
    """Score a text column with any model, in Arrow batches.

    Only the text travels to Python; the other columns stay in the JVM. The model
    is built once per task; ``batch_size`` is the number of texts per model call.
    """
    @F.pandas_udf("predicted_class int, likelihood double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = factory()
        for texts in batches:
            values = texts.tolist()
            parts = [np.asarray(model(values[i:i + batch_size]), dtype=float).reshape(-1, 2)
                     for i in range(0, len(values), batch_size)]
            logits = np.concatenate(parts) if parts else np.zeros((0, 2))
            yield pd.DataFrame({
                "predicted_class": logits.argmax(axis=1).astype("int32"),
                "likelihood": 1.0 / (1.0 + np.exp(logits[:, 0] - logits[:, 1])),
            })

    scored = df.withColumn("_score", run(F.col(text_column)))
    return scored.withColumns({"predicted_class": F.col("_score.predicted_class"),
                               "likelihood": F.col("_score.likelihood")}).drop("_score")


def linear_factory(weights: dict[str, float], bias: float = 0.0, max_tokens: int | None = None) -> ScorerFactory:
    """The linear model as a batch scorer, for the Arrow harness.

    Words are cut as :func:`words` does. A batch is one list of word numbers; only
    its distinct words are brought into match form and weighed.
    """
    breaks, drop = str.maketrans("\n\t\r", "   "), str.maketrans("", "", ".,;:!?()")

    def build() -> Callable[[list], np.ndarray]:
        def logits(texts: list) -> np.ndarray:
            cut = [[w for w in (t or "").translate(breaks).split(" ") if w][:max_tokens] for t in texts]
            numbers, distinct = pd.factorize(np.array([w for row in cut for w in row], object))
            worth = np.array([weights.get(w.translate(drop).lower(), 0.0) for w in distinct], float)
            rows = np.repeat(np.arange(len(texts)), [len(row) for row in cut])
            totals = bias + np.bincount(rows, worth[numbers] if len(numbers) else None, len(texts))
            return np.column_stack([np.zeros(len(texts)), totals])
        return logits

    return build


def word_counts(documents: DataFrame, key: str, text_column: str) -> DataFrame:
    """(key, word, n): how often each word, in match form, occurs in each text.

    Texts are dealt out by their key before they are cut, so words are counted where they are and only texts travel.
    """
    cut = F.split(F.translate(text_column, "\n\t\r", "   "), " ")   # as `words` does, with its blanks left out below
    split = documents.select(key, text_column).repartition(key).select(key, F.explode(cut).alias("w")).select(key, match_form(F.col("w")).alias("word"))
    return split.where(F.col("word") != "").groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"))


def class_counts(counts: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """(word, n0, n1): occurrences of each word in the texts of either class. ``labels``: key and a 0/1 ``label``."""
    joined = counts.join(labels.select(key, "label"), key)
    return joined.groupBy("word").agg(F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("n0"),
                                      F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("n1"))


def bayes_weights(by_class: DataFrame) -> DataFrame:
    """(word, weight): log odds of class 1, counts raised by one; the totals are one row.

    The counts are kept in the shared folder, since both the totals and the weights read them. Their size is known there,
    so a vocabulary that Spark finds small enough goes to the texts, and no count is shuffled by its word.
    """
    by_class, _ = staged(by_class, "by_class")
    totals = by_class.agg(F.sum("n0").alias("t0"), F.sum("n1").alias("t1"), F.count(F.lit(1)).alias("v")).first()
    t0, t1, v = (float(x or 0) for x in totals)
    weight = F.log((F.col("n1") + 1) / F.lit(t1 + v)) - F.log((F.col("n0") + 1) / F.lit(t0 + v))
    return by_class.select("word", weight.alias("weight"))


def bayes_score(counts: DataFrame, weights: DataFrame, key: str, prior: float) -> DataFrame:
    """Multinomial naive Bayes: key, predicted_class, likelihood of every text that holds a known word."""
    total = counts.join(weights, "word").groupBy(key).agg((F.sum(F.col("n") * F.col("weight")) + F.lit(prior)).alias("total"))
    predicted, likelihood = class_and_likelihood(F.lit(0.0), F.col("total"))
    return total.select(key, predicted, likelihood)
