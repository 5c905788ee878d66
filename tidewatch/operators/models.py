"""Classifiers of Spark ML under the configuration's names, with class weights, tuning and threshold choice.

``lightgbm`` and ``xgboost`` are gradient-boosted trees of Spark ML with their own parameters (level-wise growth); scores differ
from those libraries. The network uses Spark's optimiser and sigmoid units.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Mapping

from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import average_precision, best_threshold, roc_auc
from .preprocess import Preprocessor, class_counts, resample
from .splits import first_share

SUPPORTED = ("random_forest", "lightgbm", "xgboost", "mlp", "logistic_regression")
SCALED = ("mlp", "logistic_regression")
#: Settings that Spark's classifiers follow. Others are named in a warning.
FOLLOWED = {
    "random_forest": {"n_estimators", "max_depth", "min_samples_leaf"},
    "lightgbm": {"n_estimators", "learning_rate", "num_leaves", "min_child_samples", "subsample", "colsample_bytree"},
    "xgboost": {"n_estimators", "learning_rate", "max_depth", "subsample", "colsample_bytree"},
    "mlp": {"hidden_layer_sizes", "max_iter", "batch_size"},
    "logistic_regression": {"C", "max_iter"},
}


def weight_policy(method: str, class_weight: str, allow_both: bool = False) -> str:
    """What the run says about weights; weights and resampling together must be allowed."""
    if class_weight == "none":
        return "none"
    if method == "none":
        return class_weight
    if not allow_both:
        raise ValueError(f"class_weight={class_weight} and balancing.method={method} compensate twice; choose one or allow_class_weight_with_resampling")
    return f"{class_weight}+{method} (explicitly allowed)"


def build_classifier(name: str, params: Mapping, seed: int, n_rows: int, n_features: int, weighted: bool = False):
    """An unfitted classifier on ``features`` and ``label``; the network knows no weights."""
    p = dict(params or {})
    unheard = sorted(set(p) - FOLLOWED.get(name, set(p)))
    if unheard:
        warnings.warn(f"{name}: Spark's classifier has no use for {', '.join(unheard)}", stacklevel=2)
    base = {"featuresCol": "features", "labelCol": "label"} | ({"weightCol": "_weight"} if weighted and name != "mlp" else {})
    if name == "random_forest":
        return RandomForestClassifier(
            numTrees=int(p.get("n_estimators", 200)), maxDepth=min(int(p.get("max_depth") or 15), 30), minInstancesPerNode=int(p.get("min_samples_leaf", 1)), seed=seed, **base
        )
    if name == "lightgbm":
        leaves = int(p.get("num_leaves", 31))
        return GBTClassifier(
            maxIter=int(p.get("n_estimators", 300)), stepSize=float(p.get("learning_rate", 0.05)), maxDepth=max(1, leaves.bit_length()), minInstancesPerNode=int(p.get("min_child_samples", 20)),
            subsamplingRate=float(p.get("subsample", 0.8)), featureSubsetStrategy=str(p.get("colsample_bytree", 0.8)), seed=seed, **base,
        )
    if name == "xgboost":
        return GBTClassifier(
            maxIter=int(p.get("n_estimators", 300)), stepSize=float(p.get("learning_rate", 0.1)), maxDepth=int(p.get("max_depth", 6)), subsamplingRate=float(p.get("subsample", 0.8)),
            featureSubsetStrategy=str(p.get("colsample_bytree", 0.8)), seed=seed, **base,
        )
    if name == "mlp":
        hidden = [int(x) for x in p.get("hidden_layer_sizes", (128, 64))]
        return MultilayerPerceptronClassifier(layers=[n_features, *hidden, 2], maxIter=int(p.get("max_iter", 200)), blockSize=int(p.get("batch_size", 256)), seed=seed, **base)
    if name == "logistic_regression":
        return LogisticRegression(regParam=1.0 / (float(p.get("C", 1.0)) * max(n_rows, 1)), elasticNetParam=0.0, standardization=False, maxIter=int(p.get("max_iter", 1000)), **base)
    raise ValueError(f"unknown model {name!r}")


class Fitted:
    """Preprocessor and classifier, fitted on train only; the sampler acts in fitting only."""

    def __init__(self, prep: Preprocessor, model, before: dict, after: dict):
        self.prep, self.model, self.counts_before, self.counts_after = prep, model, before, after

    @classmethod
    def fit(cls, train: DataFrame, name: str, groups, balancing: Mapping, params: Mapping, seed: int = 42) -> Fitted:
        continuous, binary, categorical = groups
        method, weight = balancing.get("method", "none"), balancing.get("class_weight", "none")
        weight_policy(method, weight, bool(balancing.get("allow_class_weight_with_resampling")))
        prep = Preprocessor.fit(train, continuous, binary, categorical, name in SCALED or method in ("smote", "smotenc"))
        keep = ["event_id", "label", *continuous, *binary, *categorical]
        matrix = prep.transform(train.select(*keep))
        before = class_counts(train)
        ready = prep.assemble(resample(matrix, method, balancing.get("sampling_strategy", "auto"), seed, continuous, binary, categorical, int(balancing.get("smote_k_neighbors", 5))))
        ready = ready.select("event_id", F.col("label").cast("double").alias("label"), "features")
        after = before if method == "none" else class_counts(ready)
        n = sum(after.values())
        weights = {k: n / (2 * v) for k, v in after.items()}
        if weight == "balanced":
            ready = ready.withColumn("_weight", F.when(F.col("label") == 1, weights.get(1, 1.0)).otherwise(weights.get(0, 1.0)))
        classifier = build_classifier(name, params, seed, n, len(prep.feature_names()), weight == "balanced")
        return cls(prep, classifier.fit(ready), before, after)

    def preprocessed(self, rows: DataFrame) -> DataFrame:
        return self.prep.assemble(self.prep.transform(rows))

    def score(self, rows: DataFrame) -> DataFrame:
        """Rows with ``score``, the probability of class 1."""
        out = self.model.transform(self.preprocessed(rows))
        return out.select(*rows.columns, F.element_at(vector_to_array("probability"), 2).alias("score"))

    def importances(self) -> list[tuple[str, float]]:
        """Feature and importance, largest first; empty for models without any."""
        names = self.prep.feature_names()
        if hasattr(self.model, "featureImportances"):
            values = self.model.featureImportances.toArray()
        elif hasattr(self.model, "coefficients"):
            values = abs(self.model.coefficients.toArray())
        else:
            return []
        return sorted(zip(names, map(float, values), strict=True), key=lambda x: (-x[1], x[0]))


def validation_split(train: DataFrame, share: float, seed: int) -> tuple[DataFrame, DataFrame]:
    key = F.pmod(F.xxhash64(F.lit(seed + 1), "event_id"), F.lit(1 << 52))
    taken = first_share(train, key, ["label"], lambda n: n - max(1, round(n * share)))
    return train.where(taken), train.where(~taken)


def stratified_folds(train: DataFrame, folds: int, seed: int) -> Column:
    """The fold of each row, 0 up to ``folds``: every label's rows in hash order, cut into equal parts."""
    key = F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(1 << 52))
    fold = F.lit(0)
    for k in range(1, folds):
        fold = fold + (~first_share(train, key, ["label"], lambda n, k=k: round(n * k / folds))).cast("int")
    return fold


def choose_threshold(train: DataFrame, name: str, groups, balancing, params, share: float, seed: int) -> tuple[float, dict]:
    """The threshold of the best F1 on a part of train that the model has not seen; the part is never resampled."""
    fit, check = validation_split(train, share, seed)
    scored = Fitted.fit(fit, name, groups, balancing, params, seed).score(check).select("label", "score")
    row = best_threshold(scored).first()
    return float(row["threshold"]), {"validation_f1": row["f1"], "n_validation": check.count()}


def tune(train: DataFrame, name: str, groups, balancing, params, grid: Mapping, n_iter: int = 6, folds: int = 3, scoring: str = "average_precision", seed: int = 42) -> tuple[dict, float]:
    """Best parameters of a seeded sample of the grid by mean score over stratified folds; resampling stays within each fold."""
    import random

    grid = {k.removeprefix("clf__"): v for k, v in grid.items()}
    cells = [dict(zip(grid, c, strict=True)) for c in itertools.product(*grid.values())]
    cells = random.Random(seed).sample(cells, min(int(n_iter), len(cells)))
    dealt = train.withColumn("_fold", stratified_folds(train, folds, seed)).persist()
    measure = {"average_precision": average_precision, "roc_auc": roc_auc}[scoring]
    best = None
    try:
        for cell in cells:
            scores = []
            for k in range(folds):
                fitted = Fitted.fit(dealt.where(F.col("_fold") != k).drop("_fold"), name, groups, balancing, dict(params) | cell, seed)
                scores.append(measure(fitted.score(dealt.where(F.col("_fold") == k)).select("label", "score")).first()[0] or 0.0)
            mean = sum(scores) / len(scores)
            if best is None or mean > best[1]:
                best = cell, mean
    finally:
        dealt.unpersist()
    return best
