"""Feature attribution of fitted models, over whole tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.operators.metrics import evaluate
from stayrate.operators.ordering import hash_key, hash_rank
from stayrate.operators.preprocess import FEATURES
from stayrate.session import spread, stage


def seeded_sample(df: DataFrame, id_cols: Sequence[str] | str, n: int = 250, seed: int = 42) -> DataFrame:
    """``min(n, rows)`` rows without replacement, the same ones on every run."""
    names = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    return df.orderBy(hash_key(names, seed), *names).limit(n)


def _names(names: Sequence[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def feature_means(train: DataFrame) -> list[float]:
    return [float(v) for v in train.select(Summarizer.mean(F.col(FEATURES))).first()[0].toArray()]


def linear_contributions(
    model: LogisticRegressionModel, df: DataFrame, means: Sequence[float], names: Sequence[str], keep: Sequence[str]
) -> DataFrame:
    """One row per (row, feature): ``coefficient * (value - training mean)``.

    For a linear model with independent features this is the exact Shapley
    value on the log-odds scale.
    """
    coefficients = F.array(*[F.lit(float(c)) for c in model.coefficients.toArray()])
    centres = F.array(*[F.lit(float(m)) for m in means])
    parts = F.arrays_zip(
        _names(names).alias("feature"),
        vector_to_array(FEATURES).alias("value"),
        coefficients.alias("coefficient"),
        centres.alias("mean"),
    )
    return df.select(*keep, F.inline(parts)).select(
        *keep,
        "feature",
        (F.col("coefficient") * (F.col("value") - F.col("mean"))).alias("contribution"),
    )


def mean_abs_contribution(contributions: DataFrame) -> DataFrame:
    """Global attribution: mean absolute contribution per feature, largest first."""
    return (
        contributions.groupBy("feature")
        .agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))
        .orderBy(F.col("mean_abs_contribution").desc(), "feature")
    )


def top_contributions(contributions: DataFrame, condition: Column, k: int = 12) -> DataFrame:
    """Local attribution: the ``k`` strongest contributions of one row."""
    return (
        contributions.where(condition)
        .withColumn("magnitude", F.abs("contribution"))
        .orderBy(F.col("magnitude").desc(), "feature")
        .limit(k)
    )


def permutation_importance(
    model,
    df: DataFrame,
    id_col: str,
    label: str,
    names: Sequence[str],
    seed: int = 42,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Drop in average precision when one feature is shuffled, per feature.

    All features share one random cyclic permutation of the rows: each row is
    paired once with its successor in seeded hash order (an equi-join on dense
    ranks), then takes one feature at a time from it. The model scores the
    variants and one grouped evaluation yields every feature's AP.
    """
    ranked = stage(
        hash_rank(
            df.select(id_col, F.col(label).cast("int").alias("y"), FEATURES), id_col, seed, name="r"
        ).select("r", "y", vector_to_array(FEATURES).alias("x")),
        "permutation",
    )
    rows = ranked.count()
    donors = ranked.select(
        F.pmod(F.col("r") + 1, F.lit(rows)).alias("r"), F.col("x").alias("donor")
    )
    paired = spread(ranked.join(donors, "r"), "r")
    slots = F.sequence(F.lit(0), F.lit(len(names)))
    # Slot 0 is the unchanged row; slot k takes feature k - 1 from the donor.
    variants = paired.select("y", "x", "donor", F.explode(slots).alias("slot")).select(
        "y",
        "slot",
        F.transform(
            "x",
            lambda value, i: F.when(i == F.col("slot") - 1, F.get("donor", i)).otherwise(value),
        ).alias("x"),
    )
    scored = model.transform(variants.withColumn(FEATURES, array_to_vector("x"))).select(
        "slot", "y", vector_to_array("probability")[1].alias("p")
    )
    measured = evaluate(scored, ["slot"], yhat=None, rows_per_bucket=rows_per_bucket)
    base = measured.where(F.col("slot") == 0).agg(F.max("average_precision")).scalar()
    return (
        measured.where(F.col("slot") > 0)
        .select(
            F.element_at(_names(names), F.col("slot")).alias("feature"),
            (base - F.col("average_precision")).alias("importance"),
        )
        .orderBy(F.col("importance").desc(), "feature")
    )
