"""Exact metrics of scored sets: ``y`` in {0, 1}, score ``p``, class ``yhat``.

All ranking metrics come from one table with a row per distinct score, so
the cost after the first (map-side combined) aggregation depends on the
number of distinct scores. Every function takes grouping columns, which is
how models, replicates and shuffled features are evaluated in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.cleaning import at_threshold
from stayrate.operators.ordering import exact_quantiles, running_totals

# Fixed value: spacing of doubles at 1, the clipping bound of the log loss.
EPSILON = 2.220446049250313e-16


def gated(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """``df`` that fails when it is read with a label other than 0 or 1, or a score that
    is NULL or NaN: such a row has no place in any ranking, whatever the size."""
    score = F.col(p).cast("double")
    label_ok = F.coalesce((F.col(y) == 1) | (F.col(y) == 0), F.lit(False))
    score_ok = score.isNotNull() & ~F.isnan(score)
    return df.withColumns(
        {
            y: F.when(label_ok, F.col(y)).otherwise(F.raise_error(F.lit(f"{y}: labels must be 0 or 1"))),
            p: F.when(score_ok, score).otherwise(F.raise_error(F.lit(f"{p}: scores must be numbers"))),
        }
    )


def score_table(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    yhat: str | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Per group and distinct score: positives, negatives, and those classed 1."""
    one = F.col(weight) if weight else F.lit(1)
    called = F.col(yhat) == 1 if yhat else F.lit(False)

    def total(condition: Column) -> Column:
        return F.sum(F.when(condition, one).otherwise(0).cast("bigint"))

    return gated(df, y, p).groupBy(*group_cols, F.col(p).alias("p")).agg(
        total(F.col(y) == 1).alias("pos"),
        total(F.col(y) == 0).alias("neg"),
        total((F.col(y) == 1) & called).alias("hit"),
        total((F.col(y) == 0) & called).alias("miss"),
    )


def curve_table(
    scores: DataFrame, group_cols: Sequence[str] = (), rows_per_bucket: int | None = None
) -> DataFrame:
    """Score table with true and false positives at every threshold, best score first."""
    return running_totals(
        scores,
        "p",
        ["pos", "neg"],
        group_cols,
        descending=True,
        carry=["hit", "miss"],
        rows_per_bucket=rows_per_bucket,
    )


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    return F.coalesce(numerator / F.nullif(denominator.cast("double"), F.lit(0.0)), F.lit(0.0))


def f1_from(precision: Column, recall: Column) -> Column:
    return ratio_or_zero(F.lit(2.0) * precision * recall, precision + recall)


def confusion_metrics(tn: Column, fp: Column, fn: Column, tp: Column) -> dict[str, Column]:
    """Precision, recall, F1 (0 when undefined) and balanced accuracy."""
    precision = ratio_or_zero(tp, tp + fp)
    recall = ratio_or_zero(tp, tp + fn)
    tpr = tp / F.nullif((tp + fn).cast("double"), F.lit(0.0))
    tnr = tn / F.nullif((tn + fp).cast("double"), F.lit(0.0))
    return {
        "precision": precision,
        "recall": recall,
        "f1": ratio_or_zero(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn),
        "balanced_accuracy": F.coalesce((tpr + tnr) / 2, tpr, tnr),
    }


def evaluate(
    df: DataFrame,
    group_cols: Sequence[str] = (),
    y: str = "y",
    p: str = "p",
    yhat: str | None = "yhat",
    weight: str | None = None,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Every metric of each group in one row.

    AP is the step-wise sum over distinct scores; ROC-AUC counts ties half and
    is NULL for a single class.
    """
    scores = score_table(df, group_cols, y, p, yhat, weight)
    return evaluate_scores(scores, group_cols, yhat is not None, rows_per_bucket)


def evaluate_scores(
    scores: DataFrame,
    group_cols: Sequence[str] = (),
    classed: bool = True,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """:func:`evaluate` from a table made by :func:`score_table`."""
    curve = curve_table(scores, group_cols, rows_per_bucket)
    pos, neg = F.col("pos").cast("double"), F.col("neg").cast("double")
    precision_here = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    positives, negatives = F.max("all_pos").cast("double"), F.max("all_neg").cast("double")
    clipped = F.least(F.greatest(F.col("p"), F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    loss = pos * F.ln(clipped) + neg * F.ln(F.lit(1.0) - clipped)
    squared = pos * F.pow(F.col("p") - 1.0, F.lit(2.0)) + neg * F.pow(F.col("p"), F.lit(2.0))
    summed = curve.groupBy(*group_cols).agg(
        F.max("all_pos").alias("positives"),
        F.max("all_neg").alias("negatives"),
        F.coalesce(
            F.sum(pos * precision_here) / F.nullif(positives, F.lit(0.0)), F.lit(0.0)
        ).alias("average_precision"),
        (
            F.sum(neg * (F.col("cum_pos") - pos / 2))
            / F.nullif(positives * negatives, F.lit(0.0))
        ).alias("roc_auc"),
        (-F.sum(loss) / (positives + negatives)).alias("log_loss"),
        (F.sum(squared) / (positives + negatives)).alias("brier"),
        F.sum("hit").alias("tp"),
        F.sum("miss").alias("fp"),
    )
    counted = summed.withColumns(
        {"fn": F.col("positives") - F.col("tp"), "tn": F.col("negatives") - F.col("fp")}
    )
    ranking = [
        "average_precision",
        "roc_auc",
        "log_loss",
        "brier",
        (F.col("positives") / (F.col("positives") + F.col("negatives"))).alias("prevalence"),
    ]
    if not classed:
        return counted.select(*group_cols, "positives", "negatives", *ranking)
    rates = confusion_metrics(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return counted.select(
        *group_cols,
        "positives",
        "negatives",
        *ranking,
        *[column.alias(name) for name, column in rates.items()],
        "tn",
        "fp",
        "fn",
        "tp",
    )


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    def cell(actual: int, called: int) -> Column:
        return F.count_if((F.col(y) == actual) & (F.col(yhat) == called))

    return df.agg(
        cell(0, 0).alias("tn"), cell(0, 1).alias("fp"), cell(1, 0).alias("fn"), cell(1, 1).alias("tp")
    )


def class_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    counts = confusion(df, y, yhat)
    columns = confusion_metrics(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    return counts.select("*", *[column.alias(name) for name, column in columns.items()])


def log_loss(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(EPSILON)), F.lit(1.0 - EPSILON))
    return gated(df, y, p).agg(
        (-F.avg(F.when(F.col(y) == 1, F.ln(clipped)).otherwise(F.ln(F.lit(1.0) - clipped)))).alias("log_loss")
    )


def brier(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    return gated(df, y, p).agg(F.avg(F.pow(F.col(p) - F.col(y), F.lit(2.0))).alias("brier"))


def pr_curve(
    df: DataFrame, y: str = "y", p: str = "p", end_point: bool = True, rows_per_bucket: int | None = None
) -> DataFrame:
    """Precision, recall and F1 at every distinct threshold.

    ``end_point`` adds the closing point (precision 1, recall 0) with no
    threshold. Without positives recall is 1 throughout.
    """
    curve = curve_table(score_table(df, (), y, p), (), rows_per_bucket)
    recall = F.when(F.col("all_pos") == 0, F.lit(1.0)).otherwise(
        F.col("cum_pos") / F.nullif("all_pos", F.lit(0)).cast("double")
    )
    points = curve.select(
        F.col("p").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        recall.alias("recall"),
    )
    if end_point:
        closing = df.sparkSession.range(1).select(
            F.lit(None).cast("double").alias("threshold"),
            F.lit(1.0).alias("precision"),
            F.lit(0.0).alias("recall"),
        )
        points = points.unionByName(closing)
    return points.withColumn("f1", f1_from(F.col("precision"), F.col("recall")))


def roc_curve(df: DataFrame, y: str = "y", p: str = "p", rows_per_bucket: int | None = None) -> DataFrame:
    """False and true positive rate at every distinct threshold, and the origin.

    All points are kept, also those on a straight line. A rate whose class is
    absent is NULL.
    """
    curve = curve_table(score_table(df, (), y, p), (), rows_per_bucket)
    points = curve.select(
        F.col("p").alias("threshold"),
        (F.col("cum_neg") / F.nullif("all_neg", F.lit(0)).cast("double")).alias("fpr"),
        (F.col("cum_pos") / F.nullif("all_pos", F.lit(0)).cast("double")).alias("tpr"),
    )
    origin = df.sparkSession.range(1).select(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.unionByName(origin)


# Relative and absolute tolerance within which two F1 values tie.
F1_RTOL = 1e-5
F1_ATOL = 1e-8


def best_f1_threshold(
    df: DataFrame,
    y: str = "y",
    p: str = "p",
    tie_break: str = "precision",
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """One row: the threshold of maximum F1 with its precision, recall and F1.

    ``precision``: among F1 values that tie within the tolerance, highest
    precision, then lowest threshold. ``lowest``: lowest threshold among the
    exact maxima.
    """
    if tie_break not in ("precision", "lowest"):
        raise ValueError(f"unknown tie_break: {tie_break}")
    points = pr_curve(df, y, p, end_point=False, rows_per_bucket=rows_per_bucket)
    values = ["threshold", "precision", "recall", "f1"]
    if tie_break == "precision":
        slack = F.lit(F1_ATOL) + F.lit(F1_RTOL) * F.max("f1")
        order = F.struct(F.col("precision"), -F.col("threshold"))
    else:
        slack = F.lit(0.0)
        order = -F.col("threshold")
    lowest = points.agg(F.max("f1") - slack).scalar()
    tied = points.where(F.col("f1") >= lowest)
    picked = tied.agg(F.max_by(F.struct(*values), order).alias("s"))
    return picked.select("s.*")


def choose_threshold(df: DataFrame, y: str = "y", p: str = "p", tie_break: str = "precision") -> float:
    """The threshold as a number. Without any score: an error, or 0.5 for ``lowest``."""
    row = best_f1_threshold(df, y, p, tie_break).first()
    if row is None or row["threshold"] is None:
        if tie_break == "lowest":
            return 0.5
        raise ValueError("no scores to choose a threshold from")
    return row["threshold"]


def class_report(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy, macro and weighted averages."""
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))
    classes = {
        "0": (ratio_or_zero(tn, tn + fn), ratio_or_zero(tn, tn + fp), tn + fp),
        "1": (ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, tp + fn), tp + fn),
    }

    def entry(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.cast("bigint").alias("support"),
        )

    rows = tn + fp + fn + tp
    f1 = {k: f1_from(p, r) for k, (p, r, _) in classes.items()}
    (p0, r0, s0), (p1, r1, s1) = classes["0"], classes["1"]
    accuracy = ratio_or_zero(tn + tp, rows)

    def weighted(a: Column, b: Column) -> Column:
        return ratio_or_zero(a * s0 + b * s1, rows)

    entries = [
        entry("0", p0, r0, f1["0"], s0),
        entry("1", p1, r1, f1["1"], s1),
        entry("accuracy", accuracy, accuracy, accuracy, rows),
        entry("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f1["0"] + f1["1"]) / 2, rows),
        entry("weighted avg", weighted(p0, p1), weighted(r0, r1), weighted(f1["0"], f1["1"]), rows),
    ]
    return confusion(df, y, yhat).select(F.inline(F.array(*entries)))


def label_error(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """One row: mean squared, mean and largest absolute difference of labels."""
    error = (F.col(y) - F.col(yhat)).cast("double")
    return df.agg(
        F.avg(error * error).alias("mse"),
        F.avg(error).alias("mean_error"),
        F.max(F.abs(error)).alias("max_abs_error"),
    )


def ap_lift(df: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    """One row: prevalence, average precision and their ratio."""
    return evaluate(df, y=y, p=p, yhat=None).select(
        "prevalence",
        "average_precision",
        (F.col("average_precision") / F.greatest(F.col("prevalence"), F.lit(1e-12))).alias("lift"),
    )


def score_diagnostics(
    df: DataFrame, y: str = "y", p: str = "p", rows_per_bucket: int | None = None
) -> DataFrame:
    """Per class: count, mean, exact median, sample deviation, smallest and largest score."""
    medians = exact_quantiles(df, p, {"median": 0.5}, [y], rows_per_bucket)
    moments = df.groupBy(y).agg(
        F.count(p).alias("count"),
        F.avg(p).alias("mean"),
        F.stddev_samp(p).alias("std"),
        F.min(p).alias("min"),
        F.max(p).alias("max"),
    )
    return moments.join(medians, y)


def with_class(df: DataFrame, threshold: float | Column, p: str = "p", name: str = "yhat") -> DataFrame:
    """Add the class at a threshold."""
    return df.withColumn(name, at_threshold(p, threshold))
