"""Column expressions that parse, normalise and guard raw values.

Everything returns a ``Column`` built from built-in functions, so it stays
inside whole-stage code generation and works with ANSI mode on or off.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_CATEGORY = "__MISSING__"
INFREQUENT_CATEGORY = "__infrequent__"


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strict_cast(value: Column | str, data_type: str) -> Column:
    """Cast that fails the job on bad input, whatever the session's ANSI setting."""
    source = as_column(value)
    tolerant = source.try_cast(data_type)
    message = F.concat(F.lit(f"cannot cast to {data_type}: "), source.cast("string"))
    bad = source.isNotNull() & tolerant.isNull()
    return F.when(bad, F.raise_error(message).cast(data_type)).otherwise(tolerant)


def tolerant_double(value: Column | str) -> Column:
    """Text to double; anything unparsable becomes NULL."""
    return F.trim(as_column(value)).try_cast("double")


def tolerant_int(value: Column | str) -> Column:
    """Text to int, rounding text with a decimal point; bad or out-of-range is NULL."""
    return F.round(tolerant_double(value)).try_cast("int")


def tolerant_long(value: Column | str) -> Column:
    """Text to long. Whole numbers parse exactly, decimals are rounded."""
    text = F.trim(as_column(value))
    return F.coalesce(text.try_cast("bigint"), F.round(text.try_cast("double")).try_cast("bigint"))


def parse_yyyymmdd(value: Column | str) -> Column:
    """Eight-digit date text (or a number of that form) to a date, else NULL."""
    text = F.trim(as_column(value).cast("string"))
    return F.try_to_date(text, "yyyyMMdd")


def parse_timestamp(value: Column | str, formats: Sequence[str]) -> Column:
    """First of ``formats`` that fits, as a timestamp without time zone, else NULL."""
    text = F.trim(as_column(value))
    attempts = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    return F.coalesce(*attempts)


def blank_to_null(value: Column | str) -> Column:
    """Trim spaces; an empty remainder is NULL."""
    return F.nullif(F.trim(as_column(value)), F.lit(""))


def title_case(value: Column | str) -> Column:
    """Upper-case a letter that starts the text or follows a non-letter.

    ``initcap`` starts words at spaces only; here ``at-risk`` becomes
    ``At-Risk``. Runs of letters are cut apart by a marker, capitalised, and
    joined again.
    """
    marker = "\u0001"
    text = F.lower(as_column(value))
    pieces = F.split(
        F.regexp_replace(text, r"(\p{L}+)", marker + "$1" + marker), marker
    )
    return F.array_join(F.transform(pieces, F.initcap), "")


def normalise_category(value: Column | str) -> Column:
    """Strip, collapse inner whitespace, title-case; blank is NULL."""
    collapsed = F.regexp_replace(as_column(value), r"(?U)\s+", " ")
    return F.nullif(title_case(F.trim(collapsed)), F.lit(""))


def normalise_categories(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Apply :func:`normalise_category` to those of ``columns`` the table has."""
    present = [c for c in columns if c in df.columns]
    return df.withColumns({c: normalise_category(c) for c in present}) if present else df


def boolean_text(value: Column | str) -> Column:
    """``true``/``false`` text in any case to 1.0/0.0; all else NULL."""
    text = F.lower(F.trim(as_column(value).cast("string")))
    return F.when(text == "true", F.lit(1.0)).when(text == "false", F.lit(0.0))


def keep_between(value: Column | str, low, high) -> Column:
    """The value inside the closed range, NULL outside."""
    column = as_column(value)
    return F.when(column.between(low, high), column)


def zero_if_null(value: Column | str, data_type: str | None = None) -> Column:
    zero = F.lit(0) if data_type is None else F.lit(0).cast(data_type)
    return F.coalesce(as_column(value), zero)


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient as double; NULL when the denominator is 0 or NULL."""
    return as_column(numerator).cast("double") / F.nullif(
        as_column(denominator).cast("double"), F.lit(0.0)
    )


def row_sum(*values: Column | str) -> Column:
    """Plain sum of columns, NULL when any is NULL."""
    return reduce(lambda left, right: left + right, [as_column(v) for v in values])


def flag(condition: Column) -> Column:
    """Condition as int 0/1; an unknown condition is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def is_observed(value: Column | str) -> Column:
    """1 when the value is present, else 0."""
    return as_column(value).isNotNull().cast("int")


def finite_or_null(value: Column | str) -> Column:
    """Double with NaN and infinities turned into NULL."""
    number = as_column(value).try_cast("double")
    infinite = F.abs(number) == F.lit(float("inf"))
    return F.when(~(F.isnan(number) | infinite), number)


def category_text(value: Column | str) -> Column:
    """Category code as text; missing becomes a category of its own."""
    return F.coalesce(as_column(value).cast("string"), F.lit(MISSING_CATEGORY))


def at_threshold(probability: Column | str, threshold: Column | float) -> Column:
    """1 when the probability reaches the threshold, else 0."""
    return (as_column(probability) >= threshold).cast("int")


def outside(value: Column | str, low, high) -> Column:
    """True outside the closed range; unknown for NULL."""
    column = as_column(value)
    return (column < low) | (column > high)


def in_half_open(value: Column | str, start, end) -> Column:
    """``start <= value < end``."""
    column = as_column(value)
    return (column >= start) & (column < end)


def is_numeric(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType | T.BooleanType)


def is_temporal(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.DateType | T.TimestampType | T.TimestampNTZType)


def select_predictors(
    df: DataFrame, exclude: Iterable[str], categorical: Iterable[str] | None = None
) -> tuple[list[str], list[str]]:
    """Numeric and categorical predictors by exclusion and type.

    With ``categorical`` named, every other kept column has to be numeric.
    Without it, strings are the categories and dates are dropped.
    """
    excluded = set(exclude)
    kept = [f for f in df.schema.fields if f.name not in excluded]
    if categorical is not None:
        named = [c for c in categorical if c in df.columns]
        numeric = [f for f in kept if f.name not in named]
        wrong = [f.name for f in numeric if not is_numeric(f.dataType)]
        if wrong:
            raise TypeError(f"predictors must be numeric: {wrong}")
        return [f.name for f in numeric], named
    kept = [f for f in kept if not is_temporal(f.dataType)]
    numeric_names = [f.name for f in kept if is_numeric(f.dataType)]
    return numeric_names, [f.name for f in kept if f.name not in set(numeric_names)]
