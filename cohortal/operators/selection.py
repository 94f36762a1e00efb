"""Feature selection: variance, correlation, importance, tests, elimination."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from typing import Any

from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cohortal.functions.scalars import bin_right_closed
from cohortal.core.ranks import quantile_table
from cohortal.operators.features import fit_quantile_bins, quantile_bin
from cohortal.core.settle import discard, settle
from cohortal.operators.missing import align_matrix
from cohortal.operators.moments import centres, lasso_path, outer_sums
from cohortal.operators.profiling import correlations, pair_correlation

IMPORTANCE_SCHEMA = "feature string, importance double"
# Feature sets compared with each other.
CORE_GROUP = (
    "avg_daily_sessions", "num_buys_bundle_mean", "iap_revenue_usd_bundle_mean",
    "whale_users_bundle_revenue_prank_mean", "last_buy_recency_weight",
)


def variances(df: DataFrame, columns: Sequence[str], sample: bool = False) -> dict[str, float]:
    """Variance of every column from one aggregation."""
    fn = F.var_samp if sample else F.var_pop
    row = df.agg(*[fn(F.col(c).cast("double")).alias(c) for c in columns]).first()
    return {c: row[c] or 0.0 for c in columns}


def keep_by_variance(df: DataFrame, columns: Sequence[str], threshold: float = 0.01) -> list[str]:
    """Columns whose population variance exceeds the threshold."""
    found = variances(df, columns)
    return [c for c in columns if found[c] > threshold]


def keep_by_correlation(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> list[str]:
    """From each column and the earlier ones it correlates with, keep the one of highest variance."""
    cols = list(columns)
    strong: dict[str, list[str]] = {c: [] for c in cols}
    for r in correlations(df, cols).where(F.abs("corr") > threshold).collect():
        strong[r["feature_b"]].append(r["feature_a"])
    spread = variances(df, cols, sample=True)
    gone: set[str] = set()
    for c in cols:
        group = [c, *sorted(strong[c], key=cols.index)]
        if len(group) > 1:
            best = max(group, key=lambda g: spread[g])
            gone.update(g for g in group if g != best)
    return [c for c in cols if c not in gone]


def _estimator(method: str, task: str, label: str, rounds: int, depth: int, seed: int) -> Any:
    common = dict(featuresCol="features", labelCol=label, seed=seed)
    if method == "boosting":
        make = GBTClassifier if task == "classification" else GBTRegressor
        return make(maxIter=rounds, maxDepth=depth, **common)
    if method == "forest":
        make = RandomForestClassifier if task == "classification" else RandomForestRegressor
        return make(numTrees=rounds, maxDepth=depth, **common)
    raise ValueError(f"unknown method: {method}")


def _assembled(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    matrix = align_matrix(df, columns, keep=[label]).withColumn(label, F.col(label).cast("double"))
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(matrix).select("features", label)


def lasso_weights(df: DataFrame, columns: Sequence[str], label: str, penalties: int = 10, folds: int = 5, seed: int = 42, ratio: float = 1e-3) -> list[float]:
    """Weights of a cross-validated lasso; missing features count as 0, rows without a label are left out.

    The rows are written once with their fold, each fold is one matrix of sums,
    and all penalties of all folds are solved from those matrices.
    """
    cols = list(columns)
    matrix = align_matrix(df, cols, keep=[label]).select(*[F.col(c).cast("double").alias(f"c{k}") for k, c in enumerate([*cols, label])])
    last = f"c{len(cols)}"
    rows = settle(matrix.where(F.col(last).isNotNull()).withColumn("fold", F.floor(F.rand(seed) * folds).cast("int")), "lasso")
    mean, spread = centres(rows, [f"c{k}" for k in range(len(cols))])
    scaled = [(F.col(f"c{k}") - float(m)) / float(s) for k, (m, s) in enumerate(zip(mean, spread))]
    sums = [outer_sums(rows.where(F.col("fold") == f), [F.lit(1.0), *scaled, F.col(last)]) for f in range(folds)]
    discard(rows)
    return (lasso_path(sums, penalties, ratio)[0] / spread).tolist()


def importances(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    method: str = "boosting",
    task: str = "classification",
    rounds: int = 20,
    depth: int = 5,
    seed: int = 42,
    penalties: int = 10,
) -> DataFrame:
    """(feature, importance), largest first, from boosted trees, a forest or a cross-validated lasso.

    The lasso tries ``penalties`` values from the smallest one that leaves no feature down to a thousandth of it.
    """
    cols = list(columns)
    if method == "lasso":
        weights = [abs(w) for w in lasso_weights(df, cols, label, penalties, seed=seed)]
    else:
        data = _assembled(df, cols, label).persist()
        try:
            weights = list(_estimator(method, task, label, rounds, depth, seed).fit(data).featureImportances.toArray())
        finally:
            data.unpersist()
    rows = [(c, float(w)) for c, w in zip(cols, weights)]
    made = df.sparkSession.createDataFrame(rows, IMPORTANCE_SCHEMA)
    return made.orderBy(F.desc("importance"), "feature")


def keep_by_importance(found: DataFrame, n_features: int | None = None, threshold: float = 0.005) -> list[str]:
    """The top n features, or those holding at least a share of the total importance."""
    rows = found.orderBy(F.desc("importance"), "feature").collect()
    if n_features is not None:
        return [r["feature"] for r in rows[:n_features]]
    total = sum(r["importance"] for r in rows)
    return [r["feature"] for r in rows if total > 0 and r["importance"] / total >= threshold]


def f_scores(df: DataFrame, columns: Sequence[str], label: str, task: str = "classification") -> DataFrame:
    """(feature, f_value): one-way ANOVA for classes, regression F from the correlation otherwise.

    Classes: one map-side combined aggregation of count, mean and variance per
    (feature, class). Regression: one aggregation of all correlations.
    """
    cols = list(columns)
    if task == "classification":
        long = df.select(label, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
            [label], cols, "feature", "value"
        )
        per = long.where(f"value IS NOT NULL AND `{label}` IS NOT NULL").groupBy("feature", label).agg(
            F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")
        )
        n, mean = F.sum("n"), F.sum(F.col("n") * F.col("m")) / F.sum("n")
        between = F.sum(F.col("n") * F.col("m") * F.col("m")) - n * mean * mean
        within = F.sum(F.col("n") * F.col("v"))
        k = F.count(F.lit(1))
        score = F.try_divide(between / F.nullif(k - 1, F.lit(0)), within / F.nullif(n - k, F.lit(0)))
        return per.groupBy("feature").agg(score.alias("f_value"))
    stats = [
        F.struct(
            F.lit(c).alias("feature"),
            pair_correlation(F.col(c).cast("double"), F.col(label).cast("double")).alias("r"),
            F.count_if(F.col(c).isNotNull() & F.col(label).isNotNull()).alias("n"),
        )
        for c in cols
    ]
    r2 = F.col("r") * F.col("r")
    return df.agg(F.array(*stats).alias("_s")).select(F.inline("_s")).select(
        "feature", F.try_divide(r2 * (F.col("n") - 2), F.lit(1.0) - r2).alias("f_value")
    )


def binned_mutual_information(
    df: DataFrame, columns: Sequence[str], label: str, bins: int = 10, task: str = "classification"
) -> DataFrame:
    """(feature, mutual_information) in nats over quantile bins of each feature.

    A plug-in estimate on bins, not a nearest-neighbour one. Edges of all
    features come from one long table; joint counts are at most
    features x bins x classes rows. A regression target is binned as well.
    """
    cols = list(columns)
    if task == "regression":
        df = df.withColumn(label, quantile_bin(label, fit_quantile_bins(df, label, bins)))
    long = align_matrix(df, cols, keep=[label]).unpivot([label], cols, "feature", "value")
    found = quantile_table(long, "value", [i / bins for i in range(bins + 1)], ["feature"]).collect()
    edges = {c: sorted({r["quantile"] for r in found if r["feature"] == c}) for c in cols}
    binned = align_matrix(df, cols, keep=[label]).select(
        label, *[bin_right_closed(F.col(c), edges[c]).alias(c) for c in cols]
    )
    joint = (
        binned.unpivot([label], cols, "feature", "bin")
        .groupBy("feature", "bin", label)
        .agg(F.count(F.lit(1)).alias("n"))
    )
    over = lambda *keys: F.sum("n").over(Window.partitionBy("feature", *keys))
    total = over().cast("double")
    lift = F.col("n") * total / (over("bin").cast("double") * over(label))
    return (
        joint.select("feature", (F.col("n") / total * F.ln(lift)).alias("_part"))
        .groupBy("feature")
        .agg(F.sum("_part").alias("mutual_information"))
    )


def keep_top_k(scores: DataFrame, score: str, k: int) -> list[str]:
    """Features with the k highest scores."""
    ranked = scores.where(F.col(score).isNotNull()).orderBy(F.desc(score), "feature").limit(k)
    return [r["feature"] for r in ranked.collect()]


def eliminate_recursively(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    n_features: int = 100,
    step: float = 0.1,
    task: str = "classification",
    rounds: int = 10,
    seed: int = 42,
) -> list[str]:
    """Refit boosted trees and drop the least important tenth until ``n_features`` remain."""
    left = list(columns)
    drop = max(1, int(step * len(left)))
    while len(left) > n_features:
        ranked = importances(df, left, label, "boosting", task, rounds=rounds, seed=seed).collect()
        weakest = [r["feature"] for r in reversed(ranked)][: min(drop, len(left) - n_features)]
        left = [c for c in left if c not in weakest]
    return left


def group_importance(found: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """(feature_group, n_features, total, mean, max importance, top_feature), strongest first."""
    pairs = [(g, f) for g, features in groups.items() for f in features]
    members = found.sparkSession.createDataFrame(pairs, "feature_group string, feature string")
    return (
        found.join(F.broadcast(members), "feature")
        .groupBy("feature_group")
        .agg(
            F.count(F.lit(1)).alias("n_features"),
            F.sum("importance").alias("total_importance"),
            F.avg("importance").alias("mean_importance"),
            F.max("importance").alias("max_importance"),
            F.max_by("feature", F.struct("importance", "feature")).alias("top_feature"),
        )
        .orderBy(F.desc("total_importance"))
    )


@dataclass
class SelectionReport:
    """What each stage of a selection left over."""

    initial_features: int
    final_features: int
    reduction_ratio: float
    stages: list[dict[str, Any]]
    selected_features: list[str]

    def to_params(self) -> dict[str, Any]:
        return asdict(self)

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, s["stage"], s["remaining"], s["removed"]) for i, s in enumerate(self.stages, 1)]
        return spark.createDataFrame(rows, "step int, stage string, remaining int, removed int")


def select_features(
    df: DataFrame,
    columns: Sequence[str],
    label: str,
    variance_threshold: float = 0.01,
    correlation_threshold: float = 0.95,
    method: str = "boosting",
    importance_threshold: float = 0.005,
    top_k: int | None = None,
    task: str = "classification",
    rounds: int = 20,
) -> tuple[list[str], SelectionReport]:
    """Variance, then correlation, then importance, with a report of each stage."""
    start = list(columns)
    stages: list[dict[str, Any]] = []

    def note(stage: str, before: list[str], after: list[str]) -> list[str]:
        stages.append({"stage": stage, "remaining": len(after), "removed": len(before) - len(after)})
        return after

    varied = note("low_variance", start, keep_by_variance(df, start, variance_threshold))
    apart = note("high_correlation", varied, keep_by_correlation(df, varied, correlation_threshold))
    found = importances(df, apart, label, method, task, rounds=rounds)
    chosen = note("importance", apart, keep_by_importance(found, top_k, importance_threshold))
    return chosen, SelectionReport(
        len(start), len(chosen), (len(start) - len(chosen)) / max(1, len(start)), stages, chosen
    )
