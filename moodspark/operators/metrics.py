"""Multi-label evaluation (D12) and the Spark ML classifier.

Metrics are sums of per-(item, label) indicator columns: one aggregate per
label, then one over labels, so any number of items costs one shuffle of
``n_labels`` partial rows per task.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..session import materialize


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def multilabel_metrics(rows: DataFrame, item: str = "item_id", label: str = "label",
                       truth: str = "y", logit: str = "logit") -> DataFrame:
    """Predict where sigmoid(logit) > 0.5 (strict); subset accuracy, Hamming
    loss, macro and micro precision / recall / F1; zero division gives 0.

    ``rows`` has one row per (item, label) with a 0/1 truth and a logit.
    """
    p = (F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(logit).cast("double")))) > fixed.SIGMOID_THRESHOLD
    y = F.col(truth).cast("double") > 0.5
    r = rows.select(item, label, y.alias("_y"), p.alias("_p"))
    per_label = r.groupBy(label).agg(
        F.count_if(F.col("_y") & F.col("_p")).alias("tp"),
        F.count_if(~F.col("_y") & F.col("_p")).alias("fp"),
        F.count_if(F.col("_y") & ~F.col("_p")).alias("fn"))
    per_label = per_label.select(
        "*",
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    macro = per_label.agg(
        (F.sum("precision") / F.count(F.lit(1))).alias("precision_macro"),
        (F.sum("recall") / F.count(F.lit(1))).alias("recall_macro"),
        (F.sum("f1") / F.count(F.lit(1))).alias("f1_macro"),
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
    per_item = r.groupBy(item).agg(F.count_if(F.col("_y") != F.col("_p")).alias("_wrong"),
                                   F.count(F.lit(1)).alias("_n"))
    items = per_item.agg(
        (F.count_if(F.col("_wrong") == 0) / F.count(F.lit(1))).alias("subset_accuracy"),
        (F.sum("_wrong") / F.sum("_n")).alias("hamming_loss"),
        F.count(F.lit(1)).alias("n_items"))
    # two one-row aggregates side by side: union, then one row by max per column
    both = macro.unionByName(items, allowMissingColumns=True)
    m = both.agg(*[F.max(c).alias(c) for c in macro.columns + items.columns])
    return m.select(
        "n_items", "subset_accuracy", "hamming_loss", "precision_macro", "recall_macro", "f1_macro",
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision_micro"),
        _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall_micro"),
        _div(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1_micro"))


def holdout_flag(key, seed: int = 42, test_pct: int = 20):
    """A5: stable hold-out membership from a hash of (key, seed); True = validation.

    ``randomSplit`` depends on partitioning, so a hash is used instead; the
    proportion is the same, the chosen rows are not the reference's.
    """
    k = F.col(key) if isinstance(key, str) else key
    h = F.conv(F.substring(F.md5(F.concat_ws(":", k.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10)
    return F.pmod(h.cast("long"), F.lit(100)) < test_pct


class LabelModel:
    """Shared features (tokens, hashed counts, IDF) and one logistic regression per label.

    For training, features are computed once and written to the shared folder,
    where every label's fit reads them; at prediction one pass over the texts
    gives the logits of all labels. The model is saved with its label list.
    """

    def __init__(self, features: PipelineModel, labels: list[str], models: list[LogisticRegressionModel]):
        self.features, self.labels = features, labels
        self.models = [m.setRawPredictionCol(f"_raw{k}").setProbabilityCol(f"_p{k}").setPredictionCol(f"_y{k}")
                       for k, m in enumerate(models)]

    @classmethod
    def fit(cls, train: DataFrame, label_cols: list[str], text_col: str = "text", num_features: int = 1 << 16,
            max_iter: int = 20) -> LabelModel:
        """Rows without a text or without a label take no part in the fits that need it."""
        train = train.where(F.col(text_col).isNotNull())
        features = Pipeline(stages=[
            RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]+", gaps=False, toLowercase=True),
            HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features),
            IDF(inputCol="_tf", outputCol="features"),
        ]).fit(train)
        rows = materialize(features.transform(train).select(
            "features", *[F.col(c).cast("double").alias(f"_label{k}") for k, c in enumerate(label_cols)]), "features")
        return cls(features, list(label_cols), [
            LogisticRegression(featuresCol="features", labelCol=f"_label{k}", maxIter=max_iter).fit(
                rows.where(F.col(f"_label{k}").isNotNull())) for k in range(len(label_cols))])

    def logits(self, df: DataFrame, item: str, text_col: str = "text") -> DataFrame:
        """(item, label, logit) rows: the margin of each label's model; a null text counts as empty."""
        out = self.features.transform(df.select(item, F.coalesce(F.col(text_col), F.lit("")).alias(text_col))).select(item, "features")
        for m in self.models:
            out = m.transform(out)
        return out.select(item, F.inline(F.array(*[F.struct(
            F.lit(label).alias("label"), vector_to_array(f"_raw{k}")[1].alias("logit")) for k, label in enumerate(self.labels)])))

    def save(self, spark: SparkSession, path: str) -> None:
        """``features``, one ``model_<k>`` a label and ``labels`` (k, label) under ``path``, which must not hold a model."""
        self.features.save(f"{path}/features")
        for k, m in enumerate(self.models):
            m.save(f"{path}/model_{k}")
        spark.createDataFrame(list(enumerate(self.labels)), "k int, label string").coalesce(1).write.json(f"{path}/labels")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LabelModel:
        found = spark.read.schema("k int, label string").json(f"{path}/labels").orderBy("k").collect()
        return cls(PipelineModel.load(f"{path}/features"), [r["label"] for r in found],
                   [LogisticRegressionModel.load(f"{path}/model_{r['k']}") for r in found])
