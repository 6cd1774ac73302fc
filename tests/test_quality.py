"""One violating table per gate."""

from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from stayrate.errors import DataQualityError, MissingInputError
from stayrate.operators import quality as Q
from stayrate.operators.joins import align_scored, left_one_to_one
from stayrate.sources.readers import load_predictions, require_inputs
from stayrate.sources.sinks import publish


def cohort(spark, rows):
    return spark.createDataFrame(rows, "id string, y int")


def test_good_cohort(spark):
    assert Q.cohort_gate(cohort(spark, [("a", 0), ("b", 1)]), "id", "y") == 2


@pytest.mark.parametrize(
    "rows, counter",
    [
        ([("a", 0), ("a", 1)], "repeated_rows"),
        ([("a", 0), (None, 1)], "missing_keys"),
        ([("a", 0), ("b", 2)], "bad_labels"),
        ([("a", 0), ("b", None)], "bad_labels"),
        ([], "empty"),
    ],
)
def test_bad_cohorts(spark, rows, counter):
    with pytest.raises(DataQualityError) as caught:
        Q.cohort_gate(cohort(spark, rows), "id", "y")
    assert caught.value.counters == {counter: 1}


def test_key_report_counts(spark):
    df = cohort(spark, [("a", 0), ("a", 1), ("a", 1), (None, 1), ("b", 0)])
    assert Q.key_report(df, ["id"]).first().asDict() == {
        "rows": 5, "distinct_keys": 2, "missing_keys": 1, "repeated_rows": 2,
    }


def test_column_gates(spark):
    df = cohort(spark, [("a", 0)])
    with pytest.raises(DataQualityError, match="z"):
        Q.require_columns(df, ["id", "z"], "table")
    with pytest.raises(DataQualityError):
        Q.require_numeric(df, ["id"], "table")
    with pytest.raises(DataQualityError):
        Q.require_absent(["x", "churn_indicator"], ["churn_indicator"], "predictors")


def test_range_gates(spark):
    df = spark.createDataFrame([(1.0, -1, 0.5), (None, 0, 1.5)], "a double, n int, r double")
    report = Q.audit(
        df,
        {
            "negative": Q.any_negative(["n"]),
            "outside": Q.any_outside(["r"], 0, 1),
            "present": Q.any_present(["a"]),
        },
    ).first()
    assert (report.rows, report.negative, report.outside, report.present) == (2, 1, 1, 1)


def test_set_and_class_gates(spark):
    a, b = cohort(spark, [("a", 0), ("b", 0)]), cohort(spark, [("a", 0), ("c", 0)])
    with pytest.raises(DataQualityError) as caught:
        Q.require_same_keys(a, b, "id", "ids")
    assert caught.value.counters == {"only_left": 1, "only_right": 1}
    with pytest.raises(DataQualityError):
        Q.require_both_classes(a, "y", "labels")


def test_chronological_gate(spark):
    rows = [("train", date(2020, 1, 1)), ("validation", date(2020, 2, 1)), ("test", date(2020, 3, 1))]
    order = ["train", "validation", "test"]
    Q.require_chronological(spark.createDataFrame(rows, "split string, d date"), "split", "d", order)
    bad = spark.createDataFrame([*rows, ("train", date(2020, 2, 1))], "split string, d date")
    with pytest.raises(DataQualityError):
        Q.require_chronological(bad, "split", "d", order)
    with pytest.raises(DataQualityError):
        Q.require_chronological(spark.createDataFrame(rows[:2], "split string, d date"), "split", "d", order)


def test_one_to_one(spark):
    a, twice = cohort(spark, [("a", 0)]), cohort(spark, [("a", 0), ("a", 1)])
    assert left_one_to_one(a, a.withColumnRenamed("y", "z"), "id", "x").count() == 1
    with pytest.raises(DataQualityError):
        left_one_to_one(a, twice, "id", "x")


def predictions(spark, rows):
    df = spark.createDataFrame(rows, "c string, a string, p string, k string")
    return load_predictions(df, "c", "a", "p", "k")


def test_predictions_load_typed(spark):
    df = predictions(spark, [("x", "1", "0.25", "0")])
    assert [tuple(r) for r in df.collect()] == [("x", 1, 0.25, 0)]


@pytest.mark.parametrize(
    "row", [("x", "2", "0.5", "0"), ("x", "1", "1.5", "0"), ("x", "1", "0.5", "3"), (None, "1", "0.5", "0")]
)
def test_bad_predictions(spark, row):
    with pytest.raises(DataQualityError):
        predictions(spark, [row])


def test_empty_predictions(spark):
    with pytest.raises(DataQualityError):
        predictions(spark, [])


def test_alignment(spark):
    good = predictions(spark, [("x", "1", "0.5", "0"), ("y", "0", "0.1", "0")])
    assert align_scored(good, good).count() == 2
    for other in (
        [("x", "1", "0.5", "0")],
        [("x", "0", "0.5", "0"), ("y", "0", "0.1", "0")],
        [("x", "1", "0.5", "0"), ("x", "1", "0.5", "0"), ("y", "0", "0.1", "0")],
    ):
        with pytest.raises(DataQualityError):
            align_scored(good, predictions(spark, other))


def test_missing_inputs_are_all_named(spark, tmp_path):
    (tmp_path / "here.csv").write_text("a\n1\n")
    require_inputs(spark, [str(tmp_path / "here.csv"), str(tmp_path / "*.csv")])
    with pytest.raises(MissingInputError) as caught:
        require_inputs(spark, [str(tmp_path / "here.csv"), str(tmp_path / "no.csv"), str(tmp_path / "*.pq")])
    assert len(caught.value.paths) == 2


def test_violations_pass_when_none(spark):
    assert Q.require(cohort(spark, [("a", 0)]), {"bad": F.col("y") > 5}, "table") == 1


def executions(spark, run):
    """Number of queries with jobs that ``run`` starts."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    result = run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    listed = store.executionsList(int(before), int(store.executionsCount() - before))
    return result, sum(1 for i in range(listed.size()) if not listed.apply(i).jobs().isEmpty())


def test_watch_counts_in_the_job_that_writes(spark, tmp_path):
    df = spark.range(1000).withColumn("y", (F.col("id") % 2).cast("int"))
    watch = Q.Watch("rows", {"negative": F.col("id") < 0, "bad": Q.bad_label("y")})
    rows, jobs = executions(spark, lambda: publish(watch.over(df), watch, f"{tmp_path}/out", 1000))
    assert (rows, jobs) == (1000, 1) and spark.read.parquet(f"{tmp_path}/out").count() == 1000


@pytest.mark.parametrize("table", [None, "published_rows"])
def test_a_violated_rule_leaves_no_output(spark, tmp_path, table):
    df = spark.range(100)
    for rules, rows in (({"large": F.col("id") > 98}, None), ({"large": F.col("id") > 200}, 99)):
        watch = Q.Watch("rows", rules)
        with pytest.raises(DataQualityError):
            publish(watch.over(df), watch, f"{tmp_path}/out", rows, table, "id")
        assert list(tmp_path.iterdir()) == [] and (table is None or not spark.catalog.tableExists(table))
    good = Q.Watch("rows", {"large": F.col("id") > 200})
    publish(good.over(df), good, f"{tmp_path}/out", 100, table, "id")
    bad = Q.Watch("rows", {"large": F.col("id") > 5})
    with pytest.raises(DataQualityError):
        publish(bad.over(df.limit(10)), bad, f"{tmp_path}/out", None, table, "id")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 100
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    if table:
        assert spark.table(table).count() == 100
        spark.sql(f"DROP TABLE {table}")


def test_watch_of_nothing(spark, tmp_path):
    watch = Q.Watch("rows", {}, allow_empty=False)
    with pytest.raises(DataQualityError):
        publish(watch.over(spark.range(0)), watch, f"{tmp_path}/out")
    watch = Q.Watch("rows", {})
    assert publish(watch.over(spark.range(0)), watch, f"{tmp_path}/out") == 0


def test_one_per_key_tells_what_is_wrong(spark):
    df = spark.createDataFrame([("a", 0), ("a", 1), ("b", 2), (None, 1), (None, 1)], "id string, y int")
    keyed = Q.one_per_key(df, ["id"], {"bad": Q.bad_label("y")})
    found = Q.audit(keyed, {**Q.key_violations(["id"]), "bad": F.col("bad") > 0}).first()
    assert tuple(found) == (3, 1, 1, 1)
