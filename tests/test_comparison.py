"""Bootstraps against the same draws in plain Python."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from stayrate.operators import comparison as K


def order_key(text, seed):
    return hashlib.md5(f"{text}|{seed}".encode()).hexdigest()


def draw(replicate, stratum, slot, seed, size):
    text = f"{replicate}|{stratum}|{slot}|{seed}"
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16) % size


def average_precision(y, p):
    total, hits, seen = y.sum(), 0, 0
    result = 0.0
    for t in sorted(set(p), reverse=True):
        at = p == t
        hits += y[at].sum()
        seen += at.sum()
        result += y[at].sum() / total * hits / seen
    return result


def roc_auc(y, p):
    pos, neg = p[y == 1], p[y == 0]
    return float(np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg)))


def f1(y, c):
    hits = (y * c).sum()
    return 2 * hits / (y.sum() + c.sum()) if y.sum() + c.sum() else 0.0


@pytest.fixture(scope="module")
def pair():
    rng = np.random.default_rng(9)
    y = (rng.random(60) < 0.3).astype(int)
    a, b = np.round(rng.random(60), 1), np.round(np.clip(rng.random(60) + 0.2 * y, 0, 1), 2)
    return y, a, b


def pair_frame(spark, pair):
    y, a, b = pair
    rows = [
        (f"r{i}", int(y[i]), float(a[i]), int(a[i] >= 0.5), float(b[i]), int(b[i] >= 0.5))
        for i in range(len(y))
    ]
    return spark.createDataFrame(rows, "id string, y int, p_a double, yhat_a int, p_b double, yhat_b int")


@pytest.mark.parametrize("per_bucket", [100, 250_000])
def test_paired_replicates(spark, pair, per_bucket):
    y, a, b = pair
    got = {
        r.replicate: (r.average_precision, r.roc_auc, r.f1)
        for r in K.paired_bootstrap_replicates(pair_frame(spark, pair), 100, 42, per_bucket).collect()
    }
    by_class = {
        c: sorted((i for i in range(len(y)) if y[i] == c), key=lambda i: order_key(f"r{i}", 42)) for c in (0, 1)
    }
    assert len(got) == 100
    for replicate in (1, 2, 37, 100):
        picked = np.array(
            [
                rows[draw(replicate, c, slot, 42, len(rows))]
                for c, rows in by_class.items()
                for slot in range(len(rows))
            ]
        )
        yy, pa, pb = y[picked], a[picked], b[picked]
        assert yy.sum() == y.sum()
        expected = (
            average_precision(yy, pb) - average_precision(yy, pa),
            roc_auc(yy, pb) - roc_auc(yy, pa),
            f1(yy, (pb >= 0.5) * 1) - f1(yy, (pa >= 0.5) * 1),
        )
        assert got[replicate] == pytest.approx(expected, abs=1e-9)


def test_paired_interval(spark, pair):
    df = pair_frame(spark, pair)
    values = K.paired_bootstrap_replicates(df, 100).toPandas()
    summary = {r.metric: r for r in K.paired_bootstrap(df, 100).collect()}
    for metric in K.BOOTSTRAP_METRICS:
        row = summary[metric]
        assert (row.ci_lower, row.ci_upper) == pytest.approx(np.quantile(values[metric], [0.025, 0.975]))
        assert row.mean_difference == pytest.approx(values[metric].mean()) and row.replicates == 100
    y, a, b = pair
    assert summary["roc_auc"].observed_difference == pytest.approx(roc_auc(y, b) - roc_auc(y, a))


def test_too_few_replicates(spark, pair):
    with pytest.raises(ValueError):
        K.paired_bootstrap(pair_frame(spark, pair), 99)


def cluster_rows(clusters, one_class=False):
    """Clusters of 1 to 4 rows; the first holds a third of all."""
    rng = np.random.default_rng(5)
    rows = []
    for c in range(clusters):
        for _ in range(1 + c % 4 if c else 2 * clusters // 2):
            rows.append((f"c{c}", 0 if one_class else int(rng.random() < 0.4), float(np.round(rng.random(), 1))))
    return rows


@pytest.mark.parametrize("salts, hot_rows", [(32, 100_000), (8, 0)])
def test_cluster_replicates(spark, salts, hot_rows):
    rows = cluster_rows(12)
    df = spark.createDataFrame(rows, "c string, y int, p double")
    got = {r.replicate: r.average_precision for r in K.cluster_bootstrap_replicates(df, "c", 100, 42, salts, hot_rows).collect()}
    names = sorted({r[0] for r in rows}, key=lambda n: order_key(n, 42))
    for replicate in range(1, 101):
        picked = [
            r for slot in range(12) for r in rows if r[0] == names[draw(replicate, "c", slot, 42, 12)]
        ]
        y, p = np.array([r[1] for r in picked]), np.array([r[2] for r in picked])
        if 0 < y.sum() < len(y):
            assert got[replicate] == pytest.approx(average_precision(y, p), abs=1e-9)
        else:
            assert replicate not in got


def test_cluster_interval_needs_ten_clusters_and_two_classes(spark):
    schema = "c string, y int, p double"
    assert K.cluster_bootstrap(spark.createDataFrame(cluster_rows(12), schema), "c").count() == 1
    assert K.cluster_bootstrap(spark.createDataFrame(cluster_rows(9), schema), "c").count() == 0
    assert K.cluster_bootstrap(spark.createDataFrame(cluster_rows(12, True), schema), "c").count() == 0


def test_comparison_table(spark, pair):
    y, a, b = pair
    table = {r.metric: r for r in K.model_comparison(pair_frame(spark, pair)).collect()}
    assert set(table) == set(K.METRICS)
    row = table["average_precision"]
    assert row.model_a == pytest.approx(average_precision(y, a))
    assert row.difference == pytest.approx(average_precision(y, b) - average_precision(y, a))


def test_weights_collapse_however_many_tasks(spark, pair, monkeypatch):
    """A score comes out once per range and block, not once per task that holds some of its rows."""
    from stayrate.operators import draws as D

    counted, real = [], K.weighted_scores

    def watched(*args):
        scores = real(*args)
        counted.append(scores.count())
        return scores

    monkeypatch.setattr(K, "weighted_scores", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        got = K.paired_bootstrap_replicates(pair_frame(spark, pair), 100, 42, method="weights").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    y, a, b = pair
    keys = len({(p, c) for p, c in zip(a, y)}) + len({(p, c) for p, c in zip(b, y)})
    assert len(got) == 100 and counted[0] <= keys * -(-100 // D.WIDTH)


def test_weights_over_ranges_and_parts(spark, pair, monkeypatch):
    from bisect import bisect_right
    from collections import Counter

    from stayrate.operators import draws as D

    for module in (D, K):
        monkeypatch.setattr(module, "RANGE", 25)
    monkeypatch.setattr(K, "PART_BLOCKS", 2)
    df, steps = pair_frame(spark, pair), D.poisson_steps()
    total, expected = Counter(), Counter()
    for row in K.weighted_scores(df, 60, 100, 42).collect():
        for j in range(D.WIDTH):
            total[row.block * D.WIDTH + j + 1, row.model, row.p, row.y, row.yhat] += row[f"w{j}"]
    for r in df.collect():
        for replicate in range(1, 101):
            number = int(hashlib.md5(f"{replicate}|{r.id}|42".encode()).hexdigest()[:13], 16)
            for m in "ab":
                expected[replicate, m, r[f"p_{m}"], r.y, r[f"yhat_{m}"]] += bisect_right(steps, number)
    assert {k: v for k, v in total.items() if v} == {k: v for k, v in expected.items() if v}


def test_draws_are_not_exchanged(spark, pair, monkeypatch):
    """What the draws of all replicates shuffle and store follows the rows and scores, not the draws."""
    from collections import Counter

    from stayrate.operators import draws as D

    for module in (D, K):
        monkeypatch.setattr(module, "RANGE", 8)
    for module in (D, K):
        monkeypatch.setattr(module, "SLOTS", 4)
    monkeypatch.setattr(K, "TASK_SLOTS", 16)
    monkeypatch.setattr(D, "BITS", 3)
    y, a, b = pair
    by_class = {c: sorted((i for i in range(60) if y[i] == c), key=lambda i: order_key(f"r{i}", 42)) for c in (0, 1)}
    sizes = {c: len(rows) for c, rows in by_class.items()}
    scores = K.drawn_scores(pair_frame(spark, pair), sizes, 40, 42)
    # No exchange stands between the draws and their sums by score.
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    total, expected = Counter(), Counter()
    for row in scores.collect():
        for j in range(D.WIDTH):
            total[row.block * D.WIDTH + j + 1, row.model, row.p, row.y, row.yhat] += row[f"w{j}"]
    for replicate in range(1, 41):
        for c, rows in by_class.items():
            for slot in range(len(rows)):
                i = rows[draw(replicate, c, slot, 42, len(rows))]
                for m, p in (("a", a), ("b", b)):
                    expected[replicate, m, p[i], c, int(p[i] >= 0.5)] += 1
    assert {k: v for k, v in total.items() if v} == expected
