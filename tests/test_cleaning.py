from __future__ import annotations

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from stayrate.functions import cleaning as C
from stayrate.functions.calendar import elapsed_days


def applied(spark, values, expression, schema="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_date_text(spark):
    texts = ["20170228", "20170230", "", "abc", " 20170228 ", "2017022", "201702281", None]
    assert applied(spark, texts, C.parse_yyyymmdd("v")) == [
        date(2017, 2, 28), None, None, None, date(2017, 2, 28), None, None, None,
    ]


def test_timestamps_in_two_formats(spark):
    parsed = C.parse_timestamp("v", ["yyyy-MM-dd HH:mm:ss", "yyyy/MM/dd"])
    texts = ["2024-01-31 10:20:30", "2024/02/29", "2023/02/29", "soon", None]
    assert applied(spark, texts, parsed) == [
        datetime(2024, 1, 31, 10, 20, 30), datetime(2024, 2, 29), None, None, None,
    ]


def test_number_text(spark):
    texts = ["3", " 3 ", "3.0", "3.7", "", "x", None, "99999999999"]
    assert applied(spark, texts, C.tolerant_int("v")) == [3, 3, 3, 4, None, None, None, None]
    assert applied(spark, texts, C.tolerant_long("v")) == [3, 3, 3, 4, None, None, None, 99999999999]
    assert applied(spark, texts[:4], C.tolerant_double("v")) == [3.0, 3.0, 3.0, 3.7]


def test_long_text_keeps_all_digits(spark):
    assert applied(spark, ["9007199254740993"], C.tolerant_long("v")) == [9007199254740993]


def test_age_range(spark):
    ages = [4, 5, 99, 100, -1, None]
    assert applied(spark, ages, C.keep_between("v", 5, 99), "v int") == [None, 5, 99, None, None, None]


def test_categories(spark):
    texts = [" mass  value ", "MASS VALUE", "at-risk", "", "   ", "a\tb", "x  y", None, "o'neil 3rd"]
    assert applied(spark, texts, C.normalise_category("v")) == [
        "Mass Value", "Mass Value", "At-Risk", None, None, "A B", "X Y", None, "O'Neil 3Rd",
    ]
    assert applied(spark, [" x ", "", "  ", None], C.blank_to_null("v")) == ["x", None, None, None]


def test_boolean_text(spark):
    assert applied(spark, [" True", "FALSE", "", "yes", None], C.boolean_text("v")) == [
        1.0, 0.0, None, None, None,
    ]


def test_finite(spark):
    values = [1.5, float("nan"), float("inf"), float("-inf"), None]
    assert applied(spark, values, C.finite_or_null("v"), "v double") == [1.5, None, None, None, None]


def test_strict_cast_fails_on_bad_text(spark):
    assert applied(spark, ["1", None], C.strict_cast("v", "int")) == [1, None]
    with pytest.raises(Exception, match="cannot cast"):
        applied(spark, ["1", "x"], C.strict_cast("v", "int"))


def test_safe_ratio(spark):
    assert applied(spark, [0, 2, None], C.safe_ratio(F.lit(1), "v"), "v int") == [None, 0.5, None]


def test_elapsed_days_is_exact_to_the_microsecond(spark):
    df = spark.sql(
        "SELECT timestamp_ntz'2024-03-31 00:00:00' AS a, timestamp_ntz'2024-03-29 12:00:00.000001' AS b"
    )
    forward, back = df.select(elapsed_days("a", "b"), elapsed_days("b", "a")).first()
    assert forward == pytest.approx(1.5 - 1e-6 / 86400, abs=1e-15)
    assert back == -forward


def test_predictor_selection(spark):
    df = spark.createDataFrame(
        [(1, 2.0, "a", date(2020, 1, 1), True, 0)], "id int, x double, c string, d date, b boolean, y int"
    )
    assert C.select_predictors(df, ["id", "y"]) == (["x", "b"], ["c"])
    assert C.select_predictors(df, ["id", "y", "d"], ["c"]) == (["x", "b"], ["c"])
    with pytest.raises(TypeError):
        C.select_predictors(df, ["id", "y", "d"], [])
