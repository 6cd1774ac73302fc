"""Preprocessing, classifiers, attribution."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from stayrate.errors import DataQualityError
from stayrate.operators import explain as E
from stayrate.operators import metrics as M
from stayrate.operators import models as L
from stayrate.operators import preprocess as P
from stayrate.sources.sinks import load_model, save_model

SCHEMA = "id int, a double, b double, c double, d double, k string, m int"
NAN, INF = float("nan"), float("inf")
TRAIN = [
    (1, 1.0, None, 5.0, 2.0, "x", 1),
    (2, 2.0, None, 5.0, NAN, "x", 1),
    (3, 3.0, None, 5.0, 4.0, "y", 2),
    (4, 4.0, None, 5.0, INF, "y", 2),
    (5, None, None, 5.0, 6.0, "only once", None),
    (6, None, None, 5.0, 8.0, None, None),
]


def matrix(prep, df):
    rows = prep.transform(df).select("id", vector_to_array("features").alias("x")).orderBy("id").collect()
    return prep.feature_names, np.array([r.x for r in rows])


def test_cohort_preprocessing(spark):
    train = spark.createDataFrame(TRAIN, SCHEMA)
    prep = P.fit_preprocessor(train, ["a", "b", "c", "d"], ["k", "m"], scale_numeric=True)
    names, x = matrix(prep, train)
    assert names == [
        "a", "b", "c", "d", "k=__MISSING__", "k=only once", "k=x", "k=y", "m=1", "m=2", "m=__MISSING__",
    ]
    a = np.array([1, 2, 3, 4, 2.5, 2.5])
    assert x[:, 0] == pytest.approx(a / a.std())
    assert (x[:, 1] == 0).all()  # no value at all: kept and filled with 0
    assert (x[:, 2] == 5).all()  # constant: scale 1
    d = np.array([2, 5, 4, 5, 6, 8])
    assert x[:, 3] == pytest.approx(d / d.std())
    assert x[:, 4:8].sum(axis=1).tolist() == [1.0] * 6 and x[5, 4] == 1.0
    unseen = spark.createDataFrame([(9, 1.0, 1.0, 1.0, 1.0, "new", 7)], SCHEMA)
    assert matrix(prep, unseen)[1][0, 4:].tolist() == [0.0] * 7


def test_panel_preprocessing(spark):
    train = spark.createDataFrame(TRAIN, SCHEMA)
    prep = P.fit_preprocessor(
        train, ["a", "b", "c", "d"], ["k"], indicators=True, keep_empty=False,
        category_fill="most_frequent", min_frequency=2,
    )
    names, x = matrix(prep, train)
    assert names == [
        "a", "c", "d", "missing_a", "missing_b", "missing_d", "k=__infrequent__", "k=x", "k=y",
    ]
    assert x[:, 3].tolist() == [0, 0, 0, 0, 1, 1] and x[:, 5].tolist() == [0, 1, 0, 1, 0, 0]
    # x and y tie: the missing value becomes x; the rare one is pooled, an unseen one is nothing
    assert x[5, 6:].tolist() == [0, 1, 0] and x[4, 6:].tolist() == [1, 0, 0]
    unseen = spark.createDataFrame([(9, 1.0, 1.0, 1.0, 1.0, "new", 7)], SCHEMA)
    assert matrix(prep, unseen)[1][0, 6:].tolist() == [0, 0, 0]


def test_quoted_categories(spark):
    rows = [(1, "it's"), (2, "it's"), (3, 'a "b" \\c'), (4, None)]
    df = spark.createDataFrame(rows, "id int, k string")
    prep = P.fit_preprocessor(df, [], ["k"], category_fill="most_frequent", min_frequency=2)
    assert prep.feature_names == ["k=__infrequent__", "k=it's"]
    assert matrix(prep, df)[1].tolist() == [[0, 1], [0, 1], [1, 0], [0, 1]]


def test_more_values_than_fit_in_a_plan(spark):
    """120,000 kept values and as many rare ones: slots by rank, none listed anywhere."""
    df = spark.range(360_000).select("id", F.when(F.col("id") < 240_000, F.concat(F.lit("k"), F.col("id") % 120_000)).otherwise(F.concat(F.lit("r"), F.col("id"))).alias("k"))
    prep = P.fit_preprocessor(df, [], ["k"], min_frequency=2)
    assert all(len(s.getStatement()) < 1000 for s in prep.model.stages if hasattr(s, "getStatement"))
    names = prep.feature_names
    assert len(names) == 120_001 and names[0] == "k=__infrequent__" and names[1:] == sorted(names[1:])
    place = {n: i for i, n in enumerate(names)}
    few = spark.createDataFrame([(1, "k7"), (2, "r300000"), (3, "new"), (4, "k119999")], "id long, k string")
    rows = {r["id"]: r["features"] for r in prep.transform(few).select("id", "features").collect()}
    assert all(v.size == 120_001 for v in rows.values())
    found = {i: [int(x) for x in v.indices] for i, v in rows.items()}
    assert found == {1: [place["k=k7"]], 2: [0], 3: [], 4: [place["k=k119999"]]}
    rare = P.rare_categories(df, ["k"], 2)
    assert rare.count() == 120_000
    pooled = P.pool_rare(df, rare, ["k"])
    assert pooled.where("k = '__infrequent__'").count() == 120_000 and pooled.count() == 360_000


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [2.0, -1.0, 0.0] - 1.5)))).astype(int)
    rows = [(i, [float(v) for v in r], int(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, x array<double>, y int")
    df = df.withColumn("features", array_to_vector("x")).persist()
    yield df, x, y
    df.unpersist()


def newton(x, y, strength, weights):
    """Minimiser of strength * weighted loss + half the squared norm."""
    design = np.c_[np.ones(len(x)), x]
    beta = np.zeros(design.shape[1])
    ridge = np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-design @ beta))
        gradient = strength * design.T @ (weights * (p - y)) + ridge @ beta
        hessian = strength * (design * (weights * p * (1 - p))[:, None]).T @ design + ridge
        beta -= np.linalg.solve(hessian, gradient)
    return beta


@pytest.mark.parametrize("strength", [0.1, 1.0, 10.0])
def test_logistic_is_the_balanced_optimum(vectors, strength):
    df, x, y = vectors
    weights = L.balanced_weights({0: int((y == 0).sum()), 1: int((y == 1).sum())})
    expected = newton(x, y, strength, np.where(y == 1, weights[1], weights[0]))
    model = L.fit_logistic(df, "y", strength, tolerance=1e-9)
    assert [model.intercept, *model.coefficients.toArray()] == pytest.approx(expected, abs=1e-4)
    loose = L.fit_logistic(df, "y", strength)
    assert [loose.intercept, *loose.coefficients.toArray()] == pytest.approx(expected, abs=0.05)


def test_weights(spark):
    assert L.balanced_weights({0: 90, 1: 10}) == {0: pytest.approx(100 / 180), 1: 5.0}
    assert L.class_ratio({0: 929460, 1: 63471}) == pytest.approx(14.643853, abs=1e-5)
    df = spark.createDataFrame([(0,)] * 9 + [(1,)], "y int")
    table = {r.y: (r.balanced_weight, r.negatives_per_positive) for r in L.class_weight_table(df, "y").collect()}
    assert table == {0: (pytest.approx(10 / 18), 9.0), 1: (5.0, 9.0)}


def test_one_class_is_refused(spark, vectors):
    df, _, _ = vectors
    with pytest.raises(DataQualityError):
        L.fit_logistic(df.where("y = 0"), "y")


def test_search_prefers_the_better_candidate(vectors):
    df, _, y = vectors
    fits = {
        "C=1": lambda: L.fit_logistic(df, "y", 1.0),
        "C=1 again": lambda: L.fit_logistic(df, "y", 1.0),
        "boosted": lambda: L.fit_boosted(df, "y", L.BoostingSettings(2, 1, 0.1)),
    }
    winner, rows = L.search(fits, df, "y", prior=float(y.mean()))
    assert winner.name == "C=1" and [r["model"] for r in rows][:2] == ["C=1", "C=1 again"]
    prior = next(r for r in rows if r["model"] == "prior")
    assert prior["roc_auc"] == 0.5 and prior["average_precision"] == pytest.approx(y.mean())
    with pytest.raises(ValueError):
        L.search(fits, df, "y", eligible=lambda n: False)


def test_tables(vectors):
    df, _, _ = vectors
    model = L.fit_logistic(df, "y")
    coefficients = L.coefficient_table(model, ["p", "q", "r"]).collect()
    assert [r.feature for r in coefficients] == ["p", "q", "r"]
    importances = L.importance_table(L.fit_boosted(df, "y", L.BoostingSettings(3, 2, 0.1)), ["p", "q", "r"])
    assert importances.first().feature == "p"
    assert sum(r.importance for r in importances.collect()) == pytest.approx(1.0)


def test_linear_contributions(vectors):
    df, x, _ = vectors
    model = L.fit_logistic(df, "y")
    names = ["p", "q", "r"]
    means = E.feature_means(df)
    assert means == pytest.approx(x.mean(axis=0))
    parts = E.linear_contributions(model, df, means, names, ["id"])
    expected = model.coefficients.toArray() * (x - x.mean(axis=0))
    world = {r.feature: r.mean_abs_contribution for r in E.mean_abs_contribution(parts).collect()}
    assert [world[n] for n in names] == pytest.approx(np.abs(expected).mean(axis=0))
    local = E.top_contributions(parts, F.col("id") == 7, 2).collect()
    order = np.argsort(-np.abs(expected[7]))[:2]
    assert [r.feature for r in local] == [names[i] for i in order]
    assert [r.contribution for r in local] == pytest.approx(expected[7][order])


def test_permutation_importance(vectors):
    """Equal to replacing each feature along the same seeded cycle by hand."""
    import hashlib

    df, x, y = vectors
    model = L.fit_logistic(df, "y")
    got = {r.feature: r.importance for r in E.permutation_importance(model, df, "id", "y", ["p", "q", "r"], 11, 50).collect()}
    order = sorted(range(len(x)), key=lambda i: hashlib.md5(f"{i}|11".encode()).hexdigest())
    donor = np.empty(len(x), dtype=int)
    for rank, i in enumerate(order):
        donor[i] = order[rank - 1]
    beta, intercept = model.coefficients.toArray(), model.intercept

    def ap(values):
        p = 1 / (1 + np.exp(-(values @ beta + intercept)))
        rank = np.argsort(-p)
        hits = y[rank].cumsum()
        return float((hits / np.arange(1, len(y) + 1))[y[rank] == 1].mean())

    for j, name in enumerate(["p", "q", "r"]):
        changed = x.copy()
        changed[:, j] = x[donor, j]
        assert got[name] == pytest.approx(ap(x) - ap(changed), abs=1e-9)


def test_seeded_sample(spark):
    df = spark.range(1000)
    one = [r.id for r in E.seeded_sample(df, "id", 250).collect()]
    two = [r.id for r in E.seeded_sample(df.repartition(7), "id", 250).collect()]
    assert one == two and len(set(one)) == 250
    assert E.seeded_sample(spark.range(10), "id", 250).count() == 10


def test_saved_pipeline_scores_the_same(spark, tmp_path):
    from pyspark.ml import PipelineModel

    rows = [(r[0], r[1], r[5], r[0] % 2) for r in TRAIN]
    df = spark.createDataFrame(rows, "id int, a double, k string, y int")
    prep = P.fit_preprocessor(df, ["a"], ["k"], scale_numeric=True)
    model = L.fit_logistic(prep.transform(df), "y")
    save_model(PipelineModel([*prep.model.stages, model]), str(tmp_path / "m"), 0.4, prep.feature_names)
    loaded, settings = load_model(str(tmp_path / "m"))
    read = [s.getStatement() for s in loaded.stages if hasattr(s, "getStatement") and "parquet." in s.getStatement()]
    assert len(read) == 1 and f"parquet.`{tmp_path}/m/" in read[0]  # its dictionary lies with it
    assert settings == {"threshold": 0.4, "columns": prep.feature_names}
    before = L.score(model, prep.transform(df), ["id"], "y").orderBy("id").collect()
    after = L.score(loaded, df, ["id"], "y").orderBy("id").collect()
    assert before == after
    assert M.with_class(L.score(loaded, df, ["id"], "y"), 0.4).where("yhat = int(p >= 0.4)").count() == 6
