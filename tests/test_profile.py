"""Cross tabulation keeps every value."""

from __future__ import annotations

import pytest
from conftest import rows_of

from stayrate.operators.profile import crosstab


def test_unlisted_values_and_null_are_counted(spark):
    rows = [("a", "x"), ("a", "y"), ("a", "z"), ("a", None), (None, "x"), ("b", "missing"), ("missing", "x")]
    got = rows_of(crosstab(spark.createDataFrame(rows, "r string, c string"), "r", "c", ["x", "y"]))
    assert got == [("a", 1, 1, 1, 1), ("b", 0, 0, 0, 1), ("missing", 1, 0, 0, 0), ("missing", 1, 0, 0, 0)]
    with pytest.raises(ValueError):
        crosstab(spark.createDataFrame(rows, "r string, c string"), "r", "c", ["x", "missing"])
