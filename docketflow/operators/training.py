"""A text classifier trained by iterations over hashed word vectors, as a saved pipeline.

Words are hashed into a vector of fixed size, weighed by how few texts hold them, and a logistic regression is fitted by
L-BFGS: each iteration is one pass over the stored vectors, whose gradients are added up in a tree, so neither the
vocabulary nor any count goes through the driver. Scoring is local to a row; nothing is joined or shuffled.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURES = 1 << 16
ITERATIONS = 30
REGULARISATION = 1e-4
_TEXT = "_text"


def text_pipeline(features: int = FEATURES, iterations: int = ITERATIONS, regularisation: float = REGULARISATION) -> Pipeline:
    """Words between white space in lower case, hashed counts, inverse document frequencies, logistic regression."""
    return Pipeline(stages=[
        RegexTokenizer(inputCol=_TEXT, outputCol="_words", pattern=r"[ \n\t\r]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=features),
        IDF(inputCol="_counts", outputCol="_features", minDocFreq=2),
        LogisticRegression(featuresCol="_features", labelCol="label", maxIter=iterations, regParam=regularisation, standardization=False)])


def train(labelled: DataFrame, text_column: str, path: str, **parameters) -> None:
    """Fit the pipeline on (text, label) rows and save it. Rows without a label are left out; a null text is empty."""
    rows = labelled.where("label is not null").select(F.coalesce(text_column, F.lit("")).alias(_TEXT), F.col("label").cast("double").alias("label"))
    text_pipeline(**parameters).fit(rows).write().overwrite().save(path)


def trained_score(spark: SparkSession, path: str, df: DataFrame, text_column: str) -> DataFrame:
    """All rows with ``predicted_class`` and ``likelihood`` of class 1, by a saved pipeline."""
    scored = PipelineModel.load(path).transform(df.withColumn(_TEXT, F.coalesce(text_column, F.lit(""))))
    return scored.select(*df.columns, F.col("prediction").cast("int").alias("predicted_class"),
                         vector_to_array("probability")[1].alias("likelihood"))
