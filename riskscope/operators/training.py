"""Train and apply a 4-class text classifier with Spark ML.

A re-aim of the original transformer fine-tuning: hashed term
frequencies of the cleaned tokens -> IDF -> multinomial logistic
regression, with the regularisation picked by weighted F1 on the
validation split.  Training and scoring are distributed Spark ML jobs;
scores come back as ``array<double>`` probabilities for ``score_probs``.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean, model_tokens, tokenize


def with_model_tokens(df: DataFrame, text_col: str = "text", out_col: str = "__tokens",
                      max_tokens: int | None = None) -> DataFrame:
    """Cleaned whitespace tokens of the whole text; ``max_tokens`` (e.g.
    ``MODEL_MAX_TOKENS``) applies the original model's input cut (C12)."""
    tokens = tokenize(clean(text_col))
    return df.withColumn(out_col, model_tokens(tokens, max_tokens) if max_tokens else tokens)


def train_classifier(train: DataFrame, val: DataFrame, text_col: str = "text", label_col: str = "label",
                     reg_params: tuple[float, ...] = (0.0, 0.01, 0.1), max_iter: int = 50,
                     num_features: int = 1 << 16, max_tokens: int | None = None,
                     partitions: int | None = None) -> tuple[PipelineModel, float, float]:
    """Fit the features once and a regression per ``regParam``; return (best
    model, its regParam, its weighted F1 on ``val``).  Every iteration ships a
    gradient per partition: a caller with many small ones sets ``partitions``."""
    features = Pipeline(stages=[HashingTF(inputCol="__tokens", outputCol="__tf", numFeatures=num_features),
                                IDF(inputCol="__tf", outputCol="__features")])

    def tokens(df: DataFrame) -> DataFrame:
        return with_model_tokens(df, text_col, max_tokens=max_tokens).withColumn(
            "__y", F.col(label_col).cast("double")).select("__tokens", "__y")

    tr = tokens(train)
    tr = (tr.repartition(partitions) if partitions else tr).persist(StorageLevel.MEMORY_AND_DISK)
    va = tokens(val).persist(StorageLevel.MEMORY_AND_DISK)
    ev = MulticlassClassificationEvaluator(labelCol="__y", predictionCol="prediction", metricName="f1")
    best = None
    try:
        prepared = features.fit(tr)
        x, y = (prepared.transform(d).select("__features", "__y").persist(StorageLevel.MEMORY_AND_DISK) for d in (tr, va))
        for rp in reg_params:
            lr = LogisticRegression(featuresCol="__features", labelCol="__y", family="multinomial", regParam=rp,
                                    maxIter=max_iter).fit(x)
            f1 = ev.evaluate(lr.transform(y))
            if best is None or f1 > best[2]:
                best = (PipelineModel(stages=[*prepared.stages, lr]), rp, f1)
        x.unpersist()
        y.unpersist()
    finally:
        tr.unpersist()
        va.unpersist()
    return best


def save_classifier(model: PipelineModel, path: str) -> None:
    """Keep a trained model in shared storage."""
    model.write().overwrite().save(path)


def load_classifier(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def evaluate_classifier(model: PipelineModel, test: DataFrame, predictions: str, key: str = "doc_id",
                        text_col: str = "text", label_col: str = "label", k: int = 4) -> tuple[DataFrame, DataFrame, DataFrame]:
    """E6 joined to G13-G16: score ``test``, store ``(key, y_true, y_pred)`` at
    ``predictions``, and return the stored pairs, the metrics and the report."""
    from .metrics import eval_metrics, eval_report
    from .scoring import score_probs

    scored = score_probs(score_with_pipeline(model, test.select(key, text_col, label_col), text_col), "probs")
    scored.select(key, F.col(label_col).alias("y_true"), F.col("ml_label_id").alias("y_pred")).write.mode(
        "overwrite").parquet(predictions)
    pairs = test.sparkSession.read.parquet(predictions)
    return pairs, eval_metrics(pairs, k), eval_report(pairs, k)


def score_with_pipeline(model: PipelineModel, df: DataFrame, text_col: str = "text",
                        out_col: str = "probs", max_tokens: int | None = None) -> DataFrame:
    """Batched scoring of a whole table; probabilities as an array."""
    scored = model.transform(with_model_tokens(df, text_col, max_tokens=max_tokens))
    keep = [c for c in df.columns]
    return scored.select(*keep, vector_to_array("probability").alias(out_col))
