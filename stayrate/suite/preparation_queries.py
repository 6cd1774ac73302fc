"""Splits and fitted preprocessing on customers and labelled documents."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators import preprocess as P
from stayrate.operators.explain import seeded_sample
from stayrate.operators.models import class_weight_table
from stayrate.operators.ordering import hash_rank
from stayrate.operators.splits import split_summary, stratified_split
from stayrate.session import stage
from stayrate.suite import inputs as I

NUMERIC = ["n_chars", "toxic", "source_length"]
CATEGORICAL = ["lang", "source"]


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stratified_split(I.cohort(spark, sf_dir), "c_custkey", "is_churn", 42)


def split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = split_summary(split_rows(spark, sf_dir), "split", "c_custkey", "is_churn")
    return I.rounded(df, ["prevalence_pct"], 9)


def random_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = I.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return hash_rank(orders, "o_orderkey", 7, ["o_orderstatus"])


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeded_sample(I.table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 250, 42)


def impute_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric column's gaps filled with its exact median."""
    df = I.training(spark, sf_dir).select("doc_id", *NUMERIC)
    return P.impute(df, P.learn_medians(df, NUMERIC))


def order_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of wide money columns, attached to each status as a check of one value."""
    lines = I.table(spark, sf_dir, "lineitem")
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    medians = P.learn_medians(lines, columns)
    counted = lines.agg(*[F.count(c).alias(c) for c in columns])
    value = F.create_map(*[F.lit(x) for c in columns for x in (c, medians[c])])
    return counted.unpivot([], columns, "column_name", "n").withColumn(
        "median", F.round(value[F.col("column_name")], 7)
    )


def missing_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.training(spark, sf_dir)
    gaps = P.missing_counts(df, NUMERIC)
    flags = [F.col(c).isNull().cast("double").alias(f"missing_{c}") for c in NUMERIC if gaps[c]]
    return df.select("doc_id", *flags)


def scale_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.training(spark, sf_dir).select("doc_id", "toxic", "source_length")
    columns = ["toxic", "source_length"]
    scaled = P.scale(df, P.learn_scales(df, columns), centre=True)
    return I.rounded(scaled, columns, 9)


def impute_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = I.training(spark, sf_dir).select("doc_id", *CATEGORICAL)
    return df.na.fill(P.learn_modes(df, CATEGORICAL))


def pool_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources seen less often than the threshold pooled into one."""
    df = I.training(spark, sf_dir).select("doc_id", *CATEGORICAL)
    return P.pool_rare(df, P.rare_categories(df, CATEGORICAL, 20), CATEGORICAL)


def _long_matrix(prep: P.Preprocessor, df: DataFrame, keep: str) -> DataFrame:
    """Non-zero entries of the feature matrix by name."""
    names = F.array(*[F.lit(n) for n in prep.feature_names])
    entries = F.arrays_zip(names.alias("feature"), vector_to_array(P.FEATURES).alias("value"))
    return (
        prep.transform(df)
        .select(keep, F.inline(entries))
        .where(F.col("value") != 0)
        .withColumn("value", F.round("value", 9))
    )


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, scaling, missing category and one-hot as the linear model sees them."""
    df = stage(I.training(spark, sf_dir), "training")
    prep = P.fit_preprocessor(df, NUMERIC, CATEGORICAL, scale_numeric=True)
    return _long_matrix(prep, df, "doc_id")


def panel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median with missing flags, modes, pooled rare categories, as the panel model sees them."""
    df = stage(I.training(spark, sf_dir), "training")
    prep = P.fit_preprocessor(
        df, NUMERIC, CATEGORICAL, indicators=True, keep_empty=False,
        category_fill="most_frequent", min_frequency=20,
    )
    return _long_matrix(prep, df, "doc_id")


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = class_weight_table(I.cohort(spark, sf_dir), "is_churn")
    return I.rounded(df, ["balanced_weight", "negatives_per_positive"], 9)


QUERIES = {
    "stratified_split": split_rows,
    "split_summary": split_report,
    "random_ranks": random_ranks,
    "seeded_sample": sampled,
    "impute_median": impute_median,
    "column_medians": order_medians,
    "missing_flags": missing_flags,
    "scale_pop": scale_population,
    "impute_mode": impute_mode,
    "pool_rare": pool_rare,
    "feature_matrix": feature_matrix,
    "panel_matrix": panel_matrix,
    "class_weights": class_weights,
}

# Exact class sizes: floors, then the largest remainders, ties to the larger label.
def split_sql(source: str, key: str, label: str) -> str:
    """CTEs ending in ``split`` with the part of every row of ``source``."""
    return f"""c AS (SELECT {label} AS label, count(*) AS n_c FROM {source} GROUP BY {label}),
t AS (SELECT *, CAST(sum(n_c) OVER () AS BIGINT) AS n FROM c),
t2 AS (SELECT *, CAST(ceil(n * (1 - 0.7::DOUBLE)) AS BIGINT) AS rest FROM t),
a AS (SELECT *, (n - rest) * n_c // n AS base, (n - rest) * n_c % n AS rem FROM t2),
a2 AS (SELECT *, base + CAST(row_number() OVER (ORDER BY rem DESC, label DESC)
         <= (n - rest) - sum(base) OVER () AS INTEGER) AS train_c FROM a),
b AS (SELECT *, n_c - train_c AS rest_c, rest - CAST(ceil(0.5 * rest) AS BIGINT) AS val FROM a2),
b2 AS (SELECT *, val * rest_c // rest AS base2, val * rest_c % rest AS rem2 FROM b),
sizes AS (SELECT label, train_c, base2 + CAST(row_number() OVER (ORDER BY rem2 DESC, label DESC)
         <= val - sum(base2) OVER () AS INTEGER) AS val_c FROM b2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {label} ORDER BY md5(concat({key}, '|42')), {key}) - 1 AS r
  FROM {source}),
split AS (SELECT {key}, ranked.{label}, CASE WHEN r < train_c THEN 'train'
    WHEN r < train_c + val_c THEN 'validation' ELSE 'test' END AS split
  FROM ranked JOIN sizes ON ranked.{label} = sizes.label)"""


SPLIT_SQL = f"{I.COHORT_SQL},\n{split_sql('cohort', 'c_custkey', 'is_churn')}"

_MODES = """modes AS (
  SELECT (SELECT lang FROM training WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1) AS lang,
         (SELECT source FROM training WHERE source IS NOT NULL GROUP BY source ORDER BY count(*) DESC, source LIMIT 1) AS source)"""
_MEDIANS = "med AS (SELECT " + ", ".join(f"quantile_cont({c}, 0.5) AS {c}" for c in NUMERIC) + " FROM training)"
_FILLED = "filled AS (SELECT doc_id, " + ", ".join(
    f"coalesce(t.{c}, med.{c}) AS {c}" for c in NUMERIC
) + ", t.lang, t.source FROM training t, med)"

ORACLES = {
    "stratified_split": I.with_ctes(SPLIT_SQL, select="SELECT * FROM split"),
    "split_summary": I.with_ctes(
        SPLIT_SQL,
        select="""SELECT split, count(*) AS rows, count(DISTINCT c_custkey) AS entities,
  CAST(sum(is_churn) AS BIGINT) AS positives, round(100.0::DOUBLE * sum(is_churn) / count(*), 9) AS prevalence_pct
FROM split GROUP BY split""",
    ),
    "random_ranks": """SELECT o_orderkey, o_orderstatus,
  row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(concat(o_orderkey, '|7')), o_orderkey) - 1 AS rank FROM orders""",
    "seeded_sample": "SELECT o_orderkey FROM orders ORDER BY md5(concat(o_orderkey, '|42')), o_orderkey LIMIT 250",
    "impute_median": I.with_ctes(
        I.TRAINING_SQL, _MEDIANS, _FILLED, select="SELECT doc_id, n_chars, toxic, source_length FROM filled"
    ),
    "column_medians": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, round(quantile_cont({c}, 0.5), 7) AS median FROM lineitem"
        for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
    ),
    "missing_flags": I.with_ctes(
        I.TRAINING_SQL,
        select="SELECT doc_id, CAST(n_chars IS NULL AS INTEGER)::DOUBLE AS missing_n_chars FROM training",
    ),
    "scale_pop": I.with_ctes(
        I.TRAINING_SQL,
        """s AS (SELECT avg(toxic) AS m1, stddev_pop(toxic) AS s1, avg(source_length) AS m2,
  stddev_pop(source_length) AS s2 FROM training)""",
        select="""SELECT doc_id, round((toxic - m1) / s1, 9) AS toxic,
  round((source_length - m2) / s2, 9) AS source_length FROM training, s""",
    ),
    "impute_mode": I.with_ctes(
        I.TRAINING_SQL,
        _MODES,
        select="""SELECT doc_id, coalesce(t.lang, modes.lang) AS lang, coalesce(t.source, modes.source) AS source
FROM training t, modes""",
    ),
    "pool_rare": I.with_ctes(
        I.TRAINING_SQL,
        select="""SELECT doc_id,
  CASE WHEN lang IS NOT NULL AND count(*) OVER (PARTITION BY lang) < 20 THEN '__infrequent__' ELSE lang END AS lang,
  CASE WHEN source IS NOT NULL AND count(*) OVER (PARTITION BY source) < 20 THEN '__infrequent__' ELSE source END AS source
FROM training""",
    ),
    "feature_matrix": I.with_ctes(
        I.TRAINING_SQL,
        _MEDIANS,
        _FILLED,
        "sd AS (SELECT " + ", ".join(f"stddev_pop({c}) AS {c}" for c in NUMERIC) + " FROM filled)",
        "long AS ("
        + " UNION ALL ".join(
            f"SELECT doc_id, '{c}' AS feature, round(f.{c} / CASE WHEN sd.{c} = 0 THEN 1 ELSE sd.{c} END, 9) AS value FROM filled f, sd"
            for c in NUMERIC
        )
        + """ UNION ALL SELECT doc_id, concat('lang=', coalesce(lang, '__MISSING__')), 1.0::DOUBLE FROM filled
 UNION ALL SELECT doc_id, concat('source=', coalesce(source, '__MISSING__')), 1.0::DOUBLE FROM filled)""",
        select="SELECT * FROM long WHERE value <> 0",
    ),
    "panel_matrix": I.with_ctes(
        I.TRAINING_SQL,
        _MEDIANS,
        _FILLED,
        _MODES,
        """cats AS (SELECT doc_id, coalesce(t.lang, modes.lang) AS lang, coalesce(t.source, modes.source) AS source
  FROM training t, modes)""",
        """pooled AS (SELECT doc_id,
    CASE WHEN count(*) OVER (PARTITION BY lang) < 20 THEN '__infrequent__' ELSE lang END AS lang,
    CASE WHEN count(*) OVER (PARTITION BY source) < 20 THEN '__infrequent__' ELSE source END AS source FROM cats)""",
        "long AS ("
        + " UNION ALL ".join(
            f"SELECT doc_id, '{c}' AS feature, round({c}, 9) AS value FROM filled" for c in NUMERIC
        )
        + """ UNION ALL SELECT doc_id, 'missing_n_chars', CAST(n_chars IS NULL AS INTEGER)::DOUBLE FROM training
 UNION ALL SELECT doc_id, concat('lang=', lang), 1.0::DOUBLE FROM pooled
 UNION ALL SELECT doc_id, concat('source=', source), 1.0::DOUBLE FROM pooled)""",
        select="SELECT * FROM long WHERE value <> 0",
    ),
    "class_weights": I.with_ctes(
        I.COHORT_SQL,
        select="""SELECT is_churn, count(*) AS rows,
  round((SELECT count(*) FROM cohort) / (2.0::DOUBLE * count(*)), 9) AS balanced_weight,
  round((SELECT count(*) FILTER (WHERE is_churn = 0)::DOUBLE / count(*) FILTER (WHERE is_churn = 1) FROM cohort), 9)
    AS negatives_per_positive
FROM cohort GROUP BY is_churn""",
    ),
}
