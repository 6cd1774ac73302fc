"""Fitted preprocessing as a plain Spark ML ``PipelineModel``.

Statistics are learned from the training rows and written into
``SQLTransformer`` statements as literals, so the fitted pipeline consists of
built-in stages only, runs in generated code and is saved natively. Categories are not
literals: a stored dictionary gives each value its slot, and the statement joins it, so
neither the driver nor the plan grows with the number of categories.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.cleaning import (
    INFREQUENT_CATEGORY,
    MISSING_CATEGORY,
    category_text,
    finite_or_null,
)
from stayrate.operators.ordering import exact_medians, running_totals
from stayrate.session import work_path

FEATURES = "features"


@dataclass(frozen=True)
class Preprocessor:
    """Fitted pipeline, the names of its numeric slots, and the categories' slots.

    ``labels`` has ``column``, ``label`` and ``slot`` (within the column); the encoded
    columns follow the numeric ones in the order of ``categorical``.
    """

    model: PipelineModel
    numeric_names: list[str]
    categorical: list[str]
    labels: DataFrame | None

    @cached_property
    def feature_names(self) -> list[str]:
        """Name of every slot of the vector; as long as the vector, so ask where that fits."""
        if self.labels is None:
            return list(self.numeric_names)
        named = {c: [] for c in self.categorical}
        for r in self.labels.orderBy("column", "slot").collect():
            named[r["column"]].append(f"{r['column']}={r['label']}")
        return [*self.numeric_names, *(n for c in self.categorical for n in named[c])]

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)


def missing_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count_if(finite_or_null(c).isNull()).alias(c) for c in columns]).first()
    return row.asDict()


def learn_medians(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Exact median of each column's finite values."""
    return exact_medians(df.select(*[finite_or_null(c).alias(c) for c in columns]), columns)


def impute(df: DataFrame, fills: dict[str, float]) -> DataFrame:
    """Fill missing and non-finite values of each column."""
    return df.withColumns({c: F.coalesce(finite_or_null(c), F.lit(float(v))) for c, v in fills.items()})


def learn_scales(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """(mean, population deviation) per column; a constant column has scale 1."""
    row = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)],
    ).first()
    return {
        c: (row[f"m{i}"] or 0.0, row[f"s{i}"] if row[f"s{i}"] else 1.0)
        for i, c in enumerate(columns)
    }


def scale(df: DataFrame, scales: dict[str, tuple[float, float]], centre: bool = False) -> DataFrame:
    return df.withColumns(
        {
            c: ((F.col(c) - F.lit(mean)) if centre else F.col(c)) / F.lit(deviation)
            for c, (mean, deviation) in scales.items()
        }
    )


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column, value, n)`` for all categorical columns in one aggregation."""
    entries = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    return (
        df.select(F.inline(entries))
        .groupBy("column", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def learn_modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str | None]:
    """Most frequent value per column; ties go to the smallest value."""
    if not columns:
        return {}
    counted = category_counts(df, columns).where(F.col("value").isNotNull())
    best = counted.groupBy("column").agg(F.max("n").alias("best"))
    tied = counted.join(best, "column").where(F.col("n") == F.col("best"))
    found = {r["column"]: r["v"] for r in tied.groupBy("column").agg(F.min("value").alias("v")).collect()}
    return {c: found.get(c) for c in columns}


def rare_categories(df: DataFrame, columns: Sequence[str], min_frequency: int) -> DataFrame:
    """Values seen fewer than ``min_frequency`` times: (column, value), however many."""
    counted = category_counts(df, columns).where(F.col("value").isNotNull())
    return counted.where(F.col("n") < min_frequency).select("column", "value")


def pool_rare(df: DataFrame, rare: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df`` with each rare value of ``columns`` replaced by the common rest category.

    ``rare`` (column, value) is joined; Catalyst broadcasts it if it is small.
    """
    out = df
    for i, c in enumerate(columns):
        own = rare.where(F.col("column") == c).select(F.col("value").alias(f"_rare{i}"))
        out = out.join(own, F.col(c).cast("string") == F.col(f"_rare{i}"), "left")
        value = F.when(F.col(f"_rare{i}").isNotNull(), F.lit(INFREQUENT_CATEGORY)).otherwise(F.col(c))
        out = out.withColumn(c, value).drop(f"_rare{i}")
    return out


@dataclass(frozen=True)
class Categories:
    """Stored dictionary of category slots: ``path`` has (column, value, slot), one row per
    value, rare values with the slot of the rest category; ``labels`` are the slots' names
    and ``sizes`` the number of slots of each column."""

    path: str
    labels: DataFrame
    sizes: dict[str, int]


def learn_categories(df: DataFrame, columns: Sequence[str], min_frequency: int | None = None) -> Categories:
    """Slots of the values of ``columns`` in text order, rare ones pooled.

    Values are counted once; their dense ranks come from range partitions, so a column may
    have any number of them, and only its size reaches the driver.
    """
    spark = df.sparkSession
    counted = category_counts(df, columns).where(F.col("value").isNotNull())
    path = work_path(spark, "category-counts")
    counted.write.parquet(path)
    counted = spark.read.parquet(path)
    is_rare = F.col("n") < (min_frequency or 0)
    label = F.when(is_rare, F.lit(INFREQUENT_CATEGORY)).otherwise(F.col("value"))
    distinct = counted.groupBy("column", label.alias("label")).agg(F.lit(1).cast("bigint").alias("one"))
    ranked = running_totals(distinct, "label", ["one"], ["column"]).select(
        "column", "label", (F.col("cum_one") - 1).alias("slot"), F.col("all_one").alias("size")
    )
    label_path = work_path(spark, "category-labels")
    ranked.write.parquet(label_path)
    labels = spark.read.parquet(label_path)
    rest = F.max(F.when(F.col("label") == INFREQUENT_CATEGORY, F.col("slot")))
    known = {r["column"]: (r["size"], r["rest"]) for r in labels.groupBy("column").agg(F.max("size").alias("size"), rest.alias("rest")).collect()}
    entries = labels.select("column", F.col("label").alias("value"), "slot")
    pooled = {c: slot for c, (_, slot) in known.items() if slot is not None}
    if min_frequency and pooled:
        slot_of = reduce(lambda e, c: e.when(F.col("column") == c, F.lit(pooled[c])), pooled, F.when(F.lit(False), F.lit(0)))
        rare = counted.where(is_rare & (F.col("value") != INFREQUENT_CATEGORY))
        entries = entries.unionByName(rare.select("column", "value", slot_of.cast("bigint").alias("slot")))
    path = work_path(spark, "categories")
    entries.write.parquet(path)
    return Categories(path, labels.select("column", "label", "slot"), {c: known[c][0] if c in known else 0 for c in columns})


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _finite_sql(name: str) -> str:
    number = f"try_cast({_quoted(name)} AS DOUBLE)"
    return f"CASE WHEN isnan({number}) OR abs({number}) = double('Infinity') THEN NULL ELSE {number} END"


def _statement(projections: Sequence[str]) -> SQLTransformer:
    return SQLTransformer(statement=f"SELECT *, {', '.join(projections)} FROM __THIS__")


def _lookup(learned: Categories, columns: Sequence[str]) -> SQLTransformer:
    """Each category's slot as ``idx_<column>``, one past the last for an unseen value."""
    slots, joins = [], []
    for i, c in enumerate(columns):
        slots.append(f"CAST(coalesce(d{i}.slot, {learned.sizes[c]}) AS DOUBLE) AS {_quoted('idx_' + c)}")
        joins.append(
            f"LEFT JOIN (SELECT value, slot FROM parquet.`{learned.path}` WHERE `column` = {_text(c)}) d{i} "
            f"ON t.{_quoted('cat_' + c)} = d{i}.value"
        )
    return SQLTransformer(statement=f"SELECT t.*, {', '.join(slots)} FROM __THIS__ t {' '.join(joins)}")


def fit_preprocessor(
    train: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    scale_numeric: bool = False,
    centre: bool = False,
    indicators: bool = False,
    keep_empty: bool = True,
    category_fill: str = "constant",
    min_frequency: int | None = None,
) -> Preprocessor:
    """Learn imputation, scaling and encoding from ``train``.

    Numeric columns: exact median (0 for a column without values, which is
    dropped when ``keep_empty`` is off), optional missing flags for columns
    with gaps in ``train``, optional division by the population deviation.
    Categories: a ``__MISSING__`` category or the most frequent value, values
    below ``min_frequency`` pooled, one-hot with unseen values all zero. A column without
    training rows has no slot.
    """
    if category_fill not in ("constant", "most_frequent"):
        raise ValueError(f"unknown category_fill: {category_fill}")
    medians = learn_medians(train, numeric)
    flagged = []
    if indicators and numeric:
        gaps = missing_counts(train, numeric)
        flagged = [c for c in numeric if gaps[c]]
    kept = [c for c in numeric if keep_empty or medians[c] is not None]

    projections, inputs, names = [], [], []
    for c in kept:
        fill = medians[c] if medians[c] is not None else 0.0
        projections.append(f"coalesce({_finite_sql(c)}, {float(fill)!r}D) AS {_quoted('num_' + c)}")
        inputs.append("num_" + c)
        names.append(c)
    for c in flagged:
        projections.append(f"CASE WHEN {_finite_sql(c)} IS NULL THEN 1D ELSE 0D END AS {_quoted('missing_' + c)}")
        inputs.append("missing_" + c)
        names.append("missing_" + c)

    if category_fill == "constant":
        fills = {c: MISSING_CATEGORY for c in categorical}
    else:
        modes = learn_modes(train, categorical)
        fills = {c: modes[c] if modes[c] is not None else MISSING_CATEGORY for c in categorical}
    filled: dict[str, Column] = {
        c: F.coalesce(F.col(c).cast("string"), F.lit(fills[c])) for c in categorical
    }
    for c in categorical:
        projections.append(f"coalesce(cast({_quoted(c)} AS STRING), {_text(fills[c])}) AS {_quoted('cat_' + c)}")

    stages = [_statement(projections)]
    current = stages[0].transform(train)
    if scale_numeric and inputs:
        scales = learn_scales(current, inputs)
        scaling = _statement(
            [
                f"({_quoted(c)} - {(m if centre else 0.0)!r}D) / {s!r}D AS {_quoted('scaled_' + c)}"
                for c, (m, s) in scales.items()
            ]
        )
        stages.append(scaling)
        current = scaling.transform(current)
        inputs = ["scaled_" + c for c in inputs]
    labels = None
    if categorical:
        learned = learn_categories(train.select(*[e.alias(c) for c, e in filled.items()]), categorical, min_frequency)
        labels, encoded = learned.labels, [c for c in categorical if learned.sizes[c]]
        looking = _lookup(learned, encoded)
        stages.append(looking)
        current = looking.transform(current)
        # The slot behind the last stands for unseen values; "keep" with dropLast drops it.
        encoder = OneHotEncoder(
            inputCols=[f"idx_{c}" for c in encoded],
            outputCols=[f"hot_{c}" for c in encoded],
            handleInvalid="keep",
            dropLast=True,
        ).fit(current)
        stages.append(encoder)
        inputs += [f"hot_{c}" for c in encoded]
    stages.append(VectorAssembler(inputCols=inputs, outputCol=FEATURES))
    return Preprocessor(PipelineModel(stages), names, list(categorical), labels)


def prepare_predictors(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Deterministic typing only: finite doubles and category text."""
    return df.withColumns(
        {
            **{c: finite_or_null(c) for c in numeric},
            **{c: category_text(c) for c in categorical},
        }
    )
