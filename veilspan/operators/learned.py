"""Classifiers that are trained, and resampled intervals."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, CountVectorizer, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tfidf_classifier(train: DataFrame, text: str = "text", label: str = "binary_label", features: int = 20_000):
    """TF-IDF of words and word pairs with class-balanced logistic regression, on Spark ML.

    At most `features` terms of each kind reach the driver (their vocabulary and weights).
    """
    rows = train.where(F.col(label).isNotNull()).select(F.col(text).alias("text"), F.col(label).cast("double").alias("label"))
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for value, n in counts.items():
        weight = F.when(F.col("label") == value, F.lit(total / (len(counts) * n))).otherwise(weight)
    stages = [
        RegexTokenizer(inputCol="text", outputCol="_words", pattern=r"\w\w+", gaps=False),
        NGram(n=2, inputCol="_words", outputCol="_pairs"),
        CountVectorizer(inputCol="_words", outputCol="_tf1", vocabSize=features // 2),
        CountVectorizer(inputCol="_pairs", outputCol="_tf2", vocabSize=features // 2),
        VectorAssembler(inputCols=["_tf1", "_tf2"], outputCol="_tf"),
        IDF(inputCol="_tf", outputCol="_features"),
        LogisticRegression(featuresCol="_features", weightCol="_weight", regParam=1.0 / max(1, total), maxIter=50, standardization=False),
    ]
    return Pipeline(stages=stages).fit(rows.withColumn("_weight", weight))


def predict(model, rows: DataFrame, id_column: str = "row_id") -> DataFrame:
    return model.transform(rows).select(id_column, vector_to_array("probability")[1].alias("score"))


def bootstrap_interval(counts: DataFrame, keys: list[str], successes: str, total: str, rounds: int = 10_000, seed: int = 17) -> DataFrame:
    """keys, low, high: percentile interval (2.5 %, 97.5 %) of a share, from its counts alone.

    A resample of n yes/no rows has a binomial number of yes rows, so the rows themselves need
    not be drawn again: the work does not grow with the table.
    """
    schema = ", ".join(f"{k} {t}" for k, t in counts.dtypes if k in keys) + ", low double, high double"

    def resample(frame):
        import numpy as np

        n, k = int(frame[total].iloc[0]), int(frame[successes].iloc[0])
        draws = np.sort(np.random.default_rng(seed).binomial(n, k / n, rounds)) / n if n else np.full(rounds, np.nan)
        return frame[keys].head(1).assign(low=float(draws[int(0.025 * rounds)]), high=float(draws[int(0.975 * rounds)]))

    return counts.groupBy(*keys).applyInPandas(resample, schema)


