"""Split, train, choose a threshold, evaluate, store."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from datetime import date

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.functions.cleaning import select_predictors
from stayrate.operators import metrics as M
from stayrate.operators import models
from stayrate.operators.comparison import cluster_bootstrap
from stayrate.operators.explain import permutation_importance
from stayrate.operators.joins import key_overlap
from stayrate.operators.preprocess import FEATURES, Preprocessor, fit_preprocessor
from stayrate.operators.quality import (
    bad_label,
    key_violations,
    one_per_key,
    require,
    require_absent,
    require_chronological,
    require_columns,
    require_numeric,
)
from stayrate.operators.splits import (
    SPLITS,
    check_split,
    chronological_split,
    label_counts_by_split,
    split_summary,
    stratified_split,
)
from stayrate.plans import panel as panel_plan
from stayrate.session import report, stage, staging
from stayrate.sources.sinks import save_model, write_csv, write_json, write_json_document, write_parquet

# Category columns of the cohort dataset.
COHORT_CATEGORIES = ["city", "gender", "registered_via", "registration_month"]


@dataclass(frozen=True)
class TrainingResult:
    """What one training flow decided and measured."""

    model_name: str
    threshold: float
    candidates: list
    validation: dict
    test: dict
    predictions: DataFrame


def split_flow(
    dataset: DataFrame, id_col: str, label: str, output: str, categorical: Sequence[str] = COHORT_CATEGORIES, seed: int = 42
) -> DataFrame:
    """Gate, split by class, check, and store assignments with their summary."""
    require_columns(dataset, [id_col, label, *categorical], "model dataset")
    keyed = one_per_key(dataset.select(id_col, label), [id_col], {"_bad": bad_label(label)})
    rules = {**key_violations([id_col]), "bad_labels": F.col("_bad") > 0}
    require(keyed, rules, "model dataset", allow_empty=False)
    numeric, named = select_predictors(dataset, [id_col, label, "split"], categorical)
    require_numeric(dataset, numeric, "model dataset")
    with staging(dataset.sparkSession):
        assigned = stage(stratified_split(dataset, id_col, label, seed), "split")
        check_split(assigned, dataset, id_col)
        write_parquet(assigned.select(id_col, "split"), f"{output}/split_assignments")
        summary = report(split_summary(assigned, "split", id_col, label))
        write_json(summary, f"{output}/split_summary")
    parts = {r["split"]: r for r in summary.collect()}
    rows = sum(r["rows"] for r in parts.values())
    positives = sum(r["positives"] for r in parts.values())
    write_json_document(
        dataset.sparkSession,
        {
            "seed": seed,
            "numeric": numeric,
            "categorical": named,
            "rows": rows,
            "labels": {
                "0": {"rows": rows - positives, "proportion": round(1 - positives / rows, 6)},
                "1": {"rows": positives, "proportion": round(positives / rows, 6)},
            },
            "splits": {
                n: {
                    "rows": r["rows"],
                    "positives": r["positives"],
                    "negatives": r["rows"] - r["positives"],
                    "positive_rate": round(r["positives"] / r["rows"], 6),
                }
                for n, r in parts.items()
            },
        },
        f"{output}/preprocessing_summary",
    )
    return summary


def attach_split(dataset: DataFrame, assignments: DataFrame, id_col: str) -> DataFrame:
    """Dataset with its stored split, one-to-one."""
    check_split(assignments, dataset, id_col)
    return dataset.join(assignments.select(id_col, "split"), id_col)


def _parts(df: DataFrame) -> dict[str, DataFrame]:
    return {name: df.where(F.col("split") == name) for name in SPLITS}


def _prepared(prep: Preprocessor, parts: Mapping[str, DataFrame], keep: Sequence[str]) -> dict[str, DataFrame]:
    """Vectors of every part, kept in memory and on disk: training reads them many times."""
    return {n: prep.transform(df).select(*keep, FEATURES).persist() for n, df in parts.items()}


def _finish(
    winner: models.Candidate,
    rows: Sequence,
    parts: Mapping[str, DataFrame],
    keep: Sequence[str],
    label: str,
    tie_break: str,
) -> TrainingResult:
    """Threshold on validation, metrics on validation and test, scored test rows."""
    validation = stage(models.score(winner.model, parts["validation"], keep, label), "validation-scores")
    threshold = M.choose_threshold(validation, tie_break=tie_break)
    test = stage(
        M.with_class(models.score(winner.model, parts["test"], keep, label), threshold), "test-scores"
    )
    measured = {
        name: M.evaluate(df).first().asDict()
        for name, df in (("validation", M.with_class(validation, threshold)), ("test", test))
    }
    return TrainingResult(
        winner.name,
        threshold,
        [r.asDict() for r in rows],
        measured["validation"],
        measured["test"],
        test,
    )


def predictions_table(result: TrainingResult, id_cols: Sequence[str], label: str) -> DataFrame:
    return result.predictions.select(
        *id_cols,
        F.col("y").alias(f"actual_{label}"),
        F.col("p").alias("predicted_probability"),
        F.col("yhat").alias(f"predicted_{label}"),
    )


def train_logistic(
    dataset: DataFrame,
    id_col: str,
    label: str,
    categorical: Sequence[str] = COHORT_CATEGORIES,
    strengths: Sequence[float] = models.LOGISTIC_STRENGTHS,
    output: str | None = None,
) -> TrainingResult:
    """Class-balanced logistic regression; ``dataset`` carries ``split``.

    The preprocessor is fitted once: it does not depend on the candidate.
    """
    numeric, named = select_predictors(dataset, [id_col, label, "split"], categorical)
    parts = _parts(dataset)
    prep = fit_preprocessor(parts["train"], numeric, named, scale_numeric=True)
    vectors = _prepared(prep, parts, [id_col, label])
    fits = {
        f"C={c}": (lambda c=c: models.fit_logistic(vectors["train"], label, c)) for c in strengths
    }
    winner, rows = models.search(fits, vectors["validation"], label)
    result = _finish(winner, rows, vectors, [id_col], label, "precision")
    if output is not None:
        _store(result, winner, prep, models.coefficient_table(winner.model, prep.feature_names), [id_col], label, output)
    _release(vectors)
    return result


def train_boosted(
    dataset: DataFrame,
    id_col: str,
    label: str,
    categorical: Sequence[str] = COHORT_CATEGORIES,
    settings: Mapping[str, models.BoostingSettings] = models.COHORT_BOOSTING,
    output: str | None = None,
) -> TrainingResult:
    """Boosted trees weighted by the class ratio; ``dataset`` carries ``split``."""
    numeric, named = select_predictors(dataset, [id_col, label, "split"], categorical)
    parts = _parts(dataset)
    prep = fit_preprocessor(parts["train"], numeric, named)
    vectors = _prepared(prep, parts, [id_col, label])
    fits = {
        name: (lambda s=s: models.fit_boosted(vectors["train"], label, s))
        for name, s in settings.items()
    }
    winner, rows = models.search(fits, vectors["validation"], label)
    result = _finish(winner, rows, vectors, [id_col], label, "precision")
    if output is not None:
        _store(result, winner, prep, models.importance_table(winner.model, prep.feature_names), [id_col], label, output)
    _release(vectors)
    return result


def _release(vectors: Mapping[str, DataFrame]) -> None:
    for df in vectors.values():
        df.unpersist()


def _store(
    result: TrainingResult,
    winner: models.Candidate,
    prep: Preprocessor,
    ranking: DataFrame,
    id_cols: Sequence[str],
    label: str,
    output: str,
) -> None:
    spark = ranking.sparkSession
    write_csv(predictions_table(result, id_cols, label), f"{output}/predictions")
    write_csv(ranking, f"{output}/features")
    write_json_document(
        spark,
        {
            "model": result.model_name,
            "threshold": result.threshold,
            "candidates": result.candidates,
            "validation": result.validation,
            "test": result.test,
        },
        f"{output}/metrics",
    )
    pipeline = PipelineModel([*prep.model.stages, winner.model])
    save_model(pipeline, f"{output}/model", result.threshold, prep.feature_names)


def panel_experiment(
    panel: DataFrame,
    output: str,
    settings: Mapping[str, models.BoostingSettings] = models.PANEL_BOOSTING,
    ranges: Mapping[str, tuple[date | None, date]] = panel_plan.SPLIT_RANGES,
    excluded: Sequence[str] = tuple(panel_plan.EXCLUDED),
    id_col: str = panel_plan.ID,
    label: str = panel_plan.TARGET,
    when: str = "index_date",
    replicates: int = 100,
) -> TrainingResult:
    """Chronological experiment on a stored panel, with every report written."""
    split = chronological_split(panel, when, ranges).where(F.col("split").isNotNull())
    require_chronological(split, "split", when, list(ranges))
    numeric, categorical = select_predictors(split, [*excluded, "split"])
    require_absent([*numeric, *categorical], excluded, "panel predictors")
    parts = _parts(split)
    prep = fit_preprocessor(
        parts["train"],
        numeric,
        categorical,
        indicators=True,
        keep_empty=False,
        category_fill="most_frequent",
        min_frequency=2,
    )
    keys = [id_col, when]
    vectors = _prepared(prep, parts, [*keys, label])
    fits = {
        name: (lambda s=s: models.fit_boosted(vectors["train"], label, s))
        for name, s in settings.items()
    }
    prior = models.fit_prior(vectors["train"], label)
    winner, rows = models.search(
        fits, vectors["validation"], label, prior, lambda name: name.startswith("boosted")
    )
    result = _finish(winner, rows, vectors, keys, label, "lowest")
    test = result.predictions

    write_csv(
        panel_plan.feature_dictionary(panel, [*numeric, *categorical]), f"{output}/feature_dictionary"
    )
    write_csv(split_summary(split, "split", id_col, label, when), f"{output}/split_summary")
    write_csv(label_counts_by_split(split, "split", label, list(ranges)), f"{output}/target_counts")
    write_csv(
        key_overlap(split, id_col, "split", [("train", "validation"), ("validation", "test"), ("train", "test")]),
        f"{output}/overlap",
    )
    write_csv(
        test.select(
            *keys,
            F.col("y").alias(label),
            F.col("p").alias("predicted_probability"),
            F.col("yhat").alias("predicted_label"),
            F.lit(result.threshold).alias("threshold"),
        ),
        f"{output}/test_predictions",
    )
    for name, df in {
        "test_metrics": M.evaluate(test),
        "class_report": M.class_report(test),
        "score_diagnostics": M.score_diagnostics(test),
        "label_error": M.label_error(test),
        "ap_lift": M.ap_lift(test),
        "pr_curve": M.pr_curve(test),
        "roc_curve": M.roc_curve(test),
        "cluster_bootstrap": cluster_bootstrap(test, id_col, replicates),
        "attribution": permutation_importance(
            winner.model,
            vectors["test"].withColumn("_row", F.concat_ws("|", F.col(id_col), F.col(when).cast("string"))),
            "_row",
            label,
            prep.feature_names,
        ),
    }.items():
        write_csv(df, f"{output}/{name}")
    _store(result, winner, prep, models.importance_table(winner.model, prep.feature_names), keys, label, output)
    write_json_document(
        panel.sparkSession,
        {
            "selected_model": result.model_name,
            "selected_threshold": result.threshold,
            "features": [*numeric, *categorical],
            "settings": {n: asdict(s) for n, s in settings.items()},
            "test_metrics": result.test,
        },
        f"{output}/experiment",
    )
    _release(vectors)
    return result
