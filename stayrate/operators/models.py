"""Classifiers on prepared vectors, candidate search and model tables."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators.metrics import evaluate
from stayrate.operators.preprocess import FEATURES
from stayrate.operators.quality import require_both_classes

WEIGHT = "_weight"

# The regularisation strengths and tree settings searched over.
LOGISTIC_STRENGTHS = (0.1, 1.0, 10.0)


@dataclass(frozen=True)
class BoostingSettings:
    """Boosted-tree settings; ``min_instances`` bounds rows per leaf."""

    rounds: int
    depth: int
    rate: float
    subsample: float = 0.8
    features: float = 0.8
    min_instances: int = 1
    seed: int = 42


# Cohort candidates and panel candidates.
COHORT_BOOSTING = {
    "depth 4, rate 0.05": BoostingSettings(400, 4, 0.05),
    "depth 6, rate 0.05": BoostingSettings(400, 6, 0.05),
    "depth 4, rate 0.1": BoostingSettings(400, 4, 0.1),
}
PANEL_BOOSTING = {
    "boosted shallow": BoostingSettings(250, 2, 0.04, 0.85, 0.85, 5),
    "boosted regularised": BoostingSettings(350, 3, 0.03, 0.8, 0.8, 10),
}


def class_ratio(counts: Mapping[int, int]) -> float:
    """Negatives per positive."""
    return counts[0] / max(counts[1], 1)


def balanced_weights(counts: Mapping[int, int]) -> dict[int, float]:
    """``n / (k * n_c)`` per class."""
    total = sum(counts.values())
    return {c: total / (len(counts) * n) for c, n in counts.items()}


def class_weight_table(df: DataFrame, label: str) -> DataFrame:
    """Per class: rows and balanced weight; and the negative/positive ratio."""
    counted = df.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    totals = counted.agg(
        F.struct(
            F.sum("rows").alias("n"),
            F.count(F.lit(1)).alias("k"),
            F.sum(F.when(F.col(label) == 0, F.col("rows"))).alias("neg"),
            F.sum(F.when(F.col(label) == 1, F.col("rows"))).alias("pos"),
        )
    ).scalar()
    return counted.select(
        label,
        "rows",
        (totals["n"] / (totals["k"] * F.col("rows"))).alias("balanced_weight"),
        (totals["neg"] / F.greatest(totals["pos"], F.lit(1))).alias("negatives_per_positive"),
    )


def weighted(df: DataFrame, label: str, weights: Mapping[int, float]) -> DataFrame:
    return df.withColumn(
        WEIGHT, F.when(F.col(label) == 1, F.lit(weights[1])).otherwise(F.lit(weights[0]))
    )


def fit_logistic(
    train: DataFrame,
    label: str,
    strength: float = 1.0,
    max_iter: int = 2000,
    tolerance: float = 1e-3,
    balanced: bool = True,
) -> LogisticRegressionModel:
    """L2 logistic regression where ``strength`` multiplies the summed loss.

    Spark averages the loss over the weights, so its penalty is
    ``1 / (strength * sum of weights)``. The intercept is not penalised.
    """
    counts = require_both_classes(train, label, "logistic regression")
    weights = balanced_weights(counts) if balanced else {0: 1.0, 1: 1.0}
    total = sum(weights[c] * n for c, n in counts.items())
    model = LogisticRegression(
        featuresCol=FEATURES,
        labelCol=label,
        weightCol=WEIGHT,
        regParam=1.0 / (strength * total),
        elasticNetParam=0.0,
        standardization=False,
        maxIter=max_iter,
        tol=tolerance,
    ).fit(weighted(train, label, weights))
    # The summary holds the session and the training rows; it would travel with every score.
    model._java_obj.setSummary(train.sparkSession._jvm.scala.Option.empty())
    return model


def fit_boosted(
    train: DataFrame, label: str, settings: BoostingSettings, checkpoint_interval: int = 10
) -> GBTClassificationModel:
    """Boosted trees with positives weighted by the class ratio."""
    counts = require_both_classes(train, label, "boosted trees")
    return GBTClassifier(
        featuresCol=FEATURES,
        labelCol=label,
        weightCol=WEIGHT,
        maxIter=settings.rounds,
        maxDepth=settings.depth,
        stepSize=settings.rate,
        subsamplingRate=settings.subsample,
        featureSubsetStrategy=str(settings.features),
        minInstancesPerNode=settings.min_instances,
        seed=settings.seed,
        checkpointInterval=checkpoint_interval,
    ).fit(weighted(train, label, {0: 1.0, 1: class_ratio(counts)}))


def fit_prior(train: DataFrame, label: str) -> float:
    """Share of positives: the score the dummy baseline gives every row."""
    return train.agg(F.avg(label)).first()[0]


def score(model, df: DataFrame, keep: Sequence[str], label: str) -> DataFrame:
    """``keep`` columns with ``y`` and the positive class's probability ``p``."""
    return model.transform(df).select(
        *keep,
        F.col(label).cast("int").alias("y"),
        vector_to_array("probability")[1].alias("p"),
    )


def score_prior(prior: float, df: DataFrame, keep: Sequence[str], label: str) -> DataFrame:
    return df.select(*keep, F.col(label).cast("int").alias("y"), F.lit(float(prior)).alias("p"))


@dataclass(frozen=True)
class Candidate:
    """A fitted candidate with its validation scores."""

    name: str
    model: object
    validation: DataFrame


def candidate_table(candidates: Sequence[Candidate]) -> DataFrame:
    """AP, ROC-AUC, Brier and prevalence of every candidate, best AP first.

    All candidates are evaluated in one job, grouped by name.
    """
    stacked = None
    for position, c in enumerate(candidates):
        part = c.validation.select(
            F.lit(position).alias("position"), F.lit(c.name).alias("model"), "y", "p"
        )
        stacked = part if stacked is None else stacked.unionByName(part)
    measured = evaluate(stacked, ["position", "model"], yhat=None)
    return measured.select(
        "position", "model", "average_precision", "roc_auc", "brier", "prevalence"
    ).orderBy(F.col("average_precision").desc(), "position")


def search(
    fits: Mapping[str, Callable[[], object]],
    validation: DataFrame,
    label: str,
    prior: float | None = None,
    eligible: Callable[[str], bool] = lambda name: True,
) -> tuple[Candidate, list]:
    """Fit every candidate and keep the best validation AP; the first of equals wins.

    ``prior`` adds the dummy baseline to the table; it is never selected.
    Returns the winner and the table's rows.
    """
    candidates = []
    for name, fit in fits.items():
        model = fit()
        candidates.append(Candidate(name, model, score(model, validation, [], label)))
    listed = list(candidates)
    if prior is not None:
        listed.append(Candidate("prior", None, score_prior(prior, validation, [], label)))
    rows = candidate_table(listed).collect()
    names = [r["model"] for r in rows if r["model"] in fits and eligible(r["model"])]
    if not names:
        raise ValueError("no eligible candidate was evaluated")
    return next(c for c in candidates if c.name == names[0]), rows


def coefficient_table(model: LogisticRegressionModel, names: Sequence[str]) -> DataFrame:
    """Coefficients by magnitude, ties by feature name."""
    rows = [(n, float(c), abs(float(c))) for n, c in zip(names, model.coefficients.toArray())]
    table = SparkSession.active().createDataFrame(
        rows, "feature string, coefficient double, magnitude double"
    )
    return table.orderBy(F.col("magnitude").desc(), "feature")


def importance_table(model: GBTClassificationModel, names: Sequence[str]) -> DataFrame:
    """Impurity-gain importances (summing to 1), largest first."""
    rows = [(n, float(v)) for n, v in zip(names, model.featureImportances.toArray())]
    table = SparkSession.active().createDataFrame(rows, "feature string, importance double")
    return table.orderBy(F.col("importance").desc(), "feature")
