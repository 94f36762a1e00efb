"""A large teacher with categories and a small student that imitates it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortal.core.settle import discard, settle
from cohortal.functions.scalars import clip
from cohortal.models.base import positive_probability, stored_params
from cohortal.operators.metrics import evaluate, roc_auc
from cohortal.operators.target_stats import CategoryEncoder, fit_encoder, load_encoder, ordered_stats
from cohortal.sources.files import write_params

BINS = 64


@dataclass
class EncodedTrees:
    """Trees over numbers and over categories as ordered target statistics of their own label."""

    encoder: CategoryEncoder
    pipeline: PipelineModel
    ident: str = "row_id"

    def transform(self, df: DataFrame) -> DataFrame:
        """Statistics of all training rows, then the trees."""
        spread = self.ident if self.ident in df.columns else df.columns
        return self.pipeline.transform(self.encoder.apply(df, spread))

    def save(self, path: str) -> None:
        self.encoder.save(f"{path}/encoder")
        self.pipeline.write().overwrite().save(f"{path}/trees")


def load_encoded(spark: SparkSession, path: str) -> EncodedTrees:
    return EncodedTrees(load_encoder(spark, f"{path}/encoder"), PipelineModel.load(f"{path}/trees"))


def _fit(rows: DataFrame, numeric: Sequence[str], categories: Sequence[str], estimator: Any, label: str, prior: float, ident: str) -> EncodedTrees:
    """Training rows carry the statistics of the rows before them, so none sees its own label.

    Trees pass over their rows several times, so vectors and labels are written
    once, and the statistics get only the columns that the fit reads.
    """
    encoder = fit_encoder(rows, categories, label, prior)
    narrow = rows.select(*dict.fromkeys([ident, *numeric, *categories, label]))
    encoded = ordered_stats(narrow, categories, label, ident, prior)
    vector = VectorAssembler(inputCols=[*numeric, *encoder.names], outputCol="features", handleInvalid="keep")
    data = settle(vector.transform(encoded).select("features", label), "vectors")
    trees = PipelineModel([vector, estimator.fit(data)])
    discard(data)
    return EncodedTrees(encoder, trees, ident)


@dataclass
class Teacher:
    classifier: EncodedTrees
    regressor: EncodedTrees
    columns: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p_teacher_buy`` and ``rev_teacher_expected`` = p * expm1(max(log revenue, 0))."""
        keep = df.columns
        out = self.classifier.transform(df).select(*keep, positive_probability().alias("p_teacher_buy"))
        out = self.regressor.transform(out)
        expected = F.expm1(clip(F.col("prediction"), 0.0)) * F.col("p_teacher_buy")
        return out.select(*keep, "p_teacher_buy", expected.alias("rev_teacher_expected"))

    def save(self, path: str) -> None:
        self.classifier.save(f"{path}/classifier")
        self.regressor.save(f"{path}/regressor")
        write_params(SparkSession.active(), {"columns": self.columns}, f"{path}/params")


def train_teacher(
    df: DataFrame,
    buyers_log: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str],
    label: str = "buyer_d7",
    log_target: str = "iap_revenue_d7_log",
    rounds: int = 20,
    depth: int = 5,
    ident: str = "row_id",
) -> Teacher:
    """Classifier on all rows; regressor on (rebalanced) buyers against log1p revenue.

    Categories of any number of values become ordered target statistics, along
    a fixed pseudorandom order of the rows' ids.
    """
    size = dict(maxIter=rounds, maxDepth=depth, maxBins=BINS, seed=42)
    clf = GBTClassifier(featuresCol="features", labelCol=label, **size)
    reg = GBTRegressor(featuresCol="features", labelCol=log_target, **size)
    return Teacher(
        _fit(df.withColumn(label, F.col(label).cast("double")), numeric, categories, clf, label, 0.5, ident),
        _fit(buyers_log, numeric, categories, reg, log_target, 0.0, ident),
        [*numeric, *categories],
    )


@dataclass
class Student:
    classifier: EncodedTrees
    regressor: EncodedTrees

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``p_student_buy`` in [0, 1] and ``rev_student`` >= 0."""
        keep = df.columns
        out = self.classifier.transform(df).select(*keep, clip(F.col("prediction"), 0.0, 1.0).alias("p_student_buy"))
        out = self.regressor.transform(out)
        return out.select(*keep, "p_student_buy", clip(F.col("prediction"), 0.0).alias("rev_student"))

    def save(self, path: str) -> None:
        self.classifier.save(f"{path}/classifier")
        self.regressor.save(f"{path}/regressor")


def train_student(
    taught: DataFrame,
    numeric: Sequence[str],
    categories: Sequence[str],
    rounds: int = 20,
    depth: int = 4,
    ident: str = "row_id",
) -> Student:
    """Two small regressors on the teacher's soft targets."""
    size = dict(maxIter=rounds, maxDepth=depth, maxBins=BINS, seed=42)
    fit = lambda target, prior: _fit(
        taught, numeric, categories, GBTRegressor(featuresCol="features", labelCol=target, **size), target, prior, ident
    )
    return Student(fit("p_teacher_buy", 0.5), fit("rev_teacher_expected", 0.0))


def load_teacher(spark: SparkSession, path: str) -> Teacher:
    pair = (load_encoded(spark, f"{path}/{part}") for part in ("classifier", "regressor"))
    return Teacher(*pair, stored_params(spark, path)["columns"])


def load_student(spark: SparkSession, path: str) -> Student:
    return Student(*(load_encoded(spark, f"{path}/{part}") for part in ("classifier", "regressor")))


def student_report(scored: DataFrame, label: str = "buyer_d7") -> DataFrame:
    """(metric, value): mse of p and rmse of revenue against the teacher, AUC against the label."""
    named = lambda df, metric, value: df.select(F.lit(metric).alias("metric"), value.alias("value"))
    p = evaluate(scored, "p_teacher_buy", "p_student_buy")
    r = evaluate(scored, "rev_teacher_expected", "rev_student")
    auc = roc_auc(scored, label, "p_student_buy")
    return (
        named(p, "mse_p", F.col("rmse") * F.col("rmse"))
        .unionByName(named(r, "rmse_revenue", F.col("rmse")))
        .unionByName(named(auc, "auc_label", F.col("roc_auc")))
    )
