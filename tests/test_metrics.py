from __future__ import annotations

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stayrate.operators import metrics as M

SIX = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (1, 0.2), (0, 0.1)]


def scored(spark, rows, threshold=0.5):
    data = [(y, float(p), int(p >= threshold)) for y, p in rows]
    return spark.createDataFrame(data, "y int, p double, yhat int")


def brute(rows):
    """Average precision and ROC-AUC by their definitions."""
    pos = [p for y, p in rows if y == 1]
    neg = [p for y, p in rows if y == 0]
    ap, seen = 0.0, 0
    for t in sorted({p for _, p in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(p >= t for p in neg)
        ap += (tp - seen) / len(pos) * tp / (tp + fp) if pos else 0.0
        seen = tp
    pairs = [(a > b) + 0.5 * (a == b) for a in pos for b in neg]
    return ap, float(np.mean(pairs)) if pairs else None


def test_six_rows(spark):
    row = M.evaluate(scored(spark, SIX)).first()
    assert row.average_precision == pytest.approx(0.7, abs=1e-12)
    assert row.roc_auc == pytest.approx(0.6111, abs=1e-4)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9)), min_size=1, max_size=40))
def test_ranking_metrics_by_definition(spark, rows):
    rows = [(y, p / 10) for y, p in rows]
    got = M.evaluate(scored(spark, rows), rows_per_bucket=3).first()
    ap, auc = brute(rows)
    assert got.average_precision == pytest.approx(ap)
    assert got.roc_auc == (None if auc is None else pytest.approx(auc))


def test_row_order_does_not_matter(spark):
    a = M.evaluate(scored(spark, SIX)).first()
    b = M.evaluate(scored(spark, SIX[::-1]).repartition(3)).first()
    assert a == b


def test_one_class_and_extreme_scores(spark):
    row = M.evaluate(scored(spark, [(1, 1.0), (1, 0.0)])).first()
    assert row.roc_auc is None and row.average_precision == 1.0
    assert row.log_loss == pytest.approx(-np.log(2.220446049250313e-16) / 2)
    none = M.evaluate(scored(spark, [(0, 0.3), (0, 0.6)])).first()
    assert (none.average_precision, none.precision, none.recall, none.f1) == (0.0, 0.0, 0.0, 0.0)


def test_recorded_panel_confusion(spark):
    """Counts and rates of a recorded run: TN 5880, FP 887, FN 135, TP 15."""
    rows = [(0, 0)] * 5880 + [(0, 1)] * 887 + [(1, 0)] * 135 + [(1, 1)] * 15
    df = spark.createDataFrame(rows, "y int, yhat int")
    row = M.class_metrics(df).first()
    assert (row.tn, row.fp, row.fn, row.tp) == (5880, 887, 135, 15)
    assert row.precision == pytest.approx(0.016630, abs=1e-6)
    assert row.recall == pytest.approx(0.1)
    assert row.f1 == pytest.approx(0.028517, abs=1e-6)
    error = M.label_error(df).first()
    assert error.mse == pytest.approx(1022 / 6917) and round(error.mse, 4) == 0.1478
    assert error.max_abs_error == 1.0


@pytest.mark.parametrize(
    "tn, fp, fn, tp, precision, recall, f1, balanced",
    [
        (135916, 3504, 2746, 6774, 0.659078, 0.711555, 0.684312, 0.843211),
        (136260, 3160, 1473, 8047, 0.718033, 0.845273, 0.776475, 0.911304),
    ],
)
def test_recorded_cohort_confusions(spark, tn, fp, fn, tp, precision, recall, f1, balanced):
    counts = spark.createDataFrame([(tn, fp, fn, tp)], "tn long, fp long, fn long, tp long")
    from pyspark.sql import functions as F

    columns = M.confusion_metrics(*[F.col(c) for c in ("tn", "fp", "fn", "tp")])
    row = counts.select(*[c.alias(n) for n, c in columns.items()]).first()
    assert (row.precision, row.recall, row.f1, row.balanced_accuracy) == pytest.approx(
        (precision, recall, f1, balanced), abs=1e-6
    )


def test_curve_points(spark):
    points = M.pr_curve(scored(spark, SIX)).orderBy("threshold").collect()
    assert [(p.threshold, p.precision, p.recall) for p in points] == [
        (None, 1.0, 0.0),
        (0.1, 0.5, 1.0),
        (0.2, pytest.approx(0.6), 1.0),
        (0.7, 0.5, pytest.approx(2 / 3)),
        (0.8, 0.5, pytest.approx(1 / 3)),
        (0.9, 1.0, pytest.approx(1 / 3)),
    ]
    roc = M.roc_curve(scored(spark, SIX)).orderBy("threshold").collect()
    assert (roc[-1].fpr, roc[-1].tpr, roc[0].fpr, roc[0].tpr) == (0.0, 0.0, 1.0, 1.0)


def test_threshold_tie_rules(spark):
    """F1 is 2/3 at both 0.9 (precision 1) and 0.2 (precision 1/2)."""
    rows = [(1, 0.9), (0, 0.5), (0, 0.4), (1, 0.2)]
    assert M.choose_threshold(scored(spark, rows)) == 0.9
    assert M.choose_threshold(scored(spark, rows), tie_break="lowest") == 0.2


def test_threshold_without_scores(spark):
    empty = scored(spark, [])
    assert M.choose_threshold(empty, tie_break="lowest") == 0.5
    with pytest.raises(ValueError):
        M.choose_threshold(empty)


def test_near_ties_go_to_precision(spark):
    """F1 values within 1e-5 of the maximum tie; outside they do not."""
    near = [(1, 0.9)] * 50000 + [(0, 0.5)] * 50000 + [(1, 0.4)] * 50000
    points = {r.threshold: r.f1 for r in M.pr_curve(scored(spark, near), end_point=False).collect()}
    assert points[0.4] > points[0.9]
    assert M.choose_threshold(scored(spark, near)) == 0.4
    tied = [(1, 0.9)] * 100000 + [(0, 0.5)] * 100001 + [(1, 0.4)] * 100000
    points = {r.threshold: r.f1 for r in M.pr_curve(scored(spark, tied), end_point=False).collect()}
    gap = max(points.values()) - points[0.9]
    expected = 0.9 if gap <= 1e-8 + 1e-5 * max(points.values()) else 0.4
    assert M.choose_threshold(scored(spark, tied)) == expected


def test_class_report(spark):
    df = spark.createDataFrame([(0, 0)] * 3 + [(0, 1)] + [(1, 1)] * 2, "y int, yhat int")
    report = {r.label: r for r in M.class_report(df).collect()}
    assert (report["0"].precision, report["0"].recall, report["0"].support) == (1.0, 0.75, 4)
    assert report["1"].precision == pytest.approx(2 / 3)
    assert report["accuracy"].f1 == pytest.approx(5 / 6)
    assert report["weighted avg"].recall == pytest.approx((0.75 * 4 + 2) / 6)


def test_diagnostics(spark):
    got = {r.y: r for r in M.score_diagnostics(scored(spark, SIX)).collect()}
    assert got[1].median == pytest.approx(0.7) and got[0]["count"] == 3
    assert got[0].std == pytest.approx(np.std([0.8, 0.7, 0.1], ddof=1))


@pytest.mark.parametrize("per_bucket", [2, None])
@pytest.mark.parametrize("bad", [(1, float("nan")), (0, None), (None, 0.95), (2, 0.5)])
def test_a_row_without_score_or_label_fails_at_every_size(spark, per_bucket, bad):
    """The same refusal with one bucket and with several, wherever the row would rank."""
    df = spark.createDataFrame([*SIX, bad], "y int, p double").withColumn("yhat", F.lit(1))
    for apply in (
        lambda: M.evaluate(df, rows_per_bucket=per_bucket),
        lambda: M.pr_curve(df, rows_per_bucket=per_bucket),
        lambda: M.roc_curve(df, rows_per_bucket=per_bucket),
        lambda: M.log_loss(df),
        lambda: M.brier(df),
    ):
        with pytest.raises(Exception, match="labels must be 0 or 1|scores must be numbers"):
            apply().collect()


@pytest.mark.parametrize("per_bucket", [1, 2, 3, None])
def test_infinite_scores_rank_first_and_last(spark, per_bucket):
    rows = [(1, float("inf")), (0, 0.3), (1, 0.3), (0, float("-inf"))]
    df = spark.createDataFrame(rows, "y int, p double")
    points = {r.threshold: (r.fpr, r.tpr) for r in M.roc_curve(df, rows_per_bucket=per_bucket).where("tpr > 0").collect()}
    assert points == {float("inf"): (0.0, 0.5), 0.3: (0.5, 1.0), float("-inf"): (1.0, 1.0)}
