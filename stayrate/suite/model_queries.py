"""Fitted models on labelled documents: candidates, tables and attributions."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators import explain as E
from stayrate.operators import metrics as M
from stayrate.operators import models as L
from stayrate.operators.preprocess import FEATURES, Preprocessor, fit_preprocessor
from stayrate.operators.quality import require_both_classes
from stayrate.operators.splits import SPLITS, stratified_split
from stayrate.session import stage, work_path
from stayrate.sources.sinks import load_model, save_model
from stayrate.suite import inputs as I
from stayrate.suite.metric_queries import AP_SQL, AUC_SQL, curve_sql
from stayrate.suite.preparation_queries import CATEGORICAL, NUMERIC, split_sql

BOOSTING = L.BoostingSettings(rounds=10, depth=3, rate=0.1)
SHALLOW = L.BoostingSettings(rounds=5, depth=2, rate=0.1)
ID, LABEL = "doc_id", "quality"


def _prepared(spark: SparkSession, sf_dir: str, scale: bool) -> tuple[Preprocessor, dict[str, DataFrame]]:
    """Split documents and their vectors, stored so that fits do not redo the joins."""
    base = stage(I.training(spark, sf_dir), "training")
    split = stage(base.join(stratified_split(base, ID, LABEL).drop(LABEL), ID), "training-split")
    prep = fit_preprocessor(split.where("split = 'train'"), NUMERIC, CATEGORICAL, scale_numeric=scale)
    vectors = stage(prep.transform(split).select(ID, LABEL, "split", "features"), "vectors")
    return prep, {s: vectors.where(F.col("split") == s) for s in SPLITS}


def lr_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, parts = _prepared(spark, sf_dir, True)
    return L.coefficient_table(L.fit_logistic(parts["train"], LABEL, 1.0), prep.feature_names)


def lr_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature, whether the fitted objective's slope is flat.

    The slope of the balanced, penalised loss is computed from the scored
    training rows; at the optimum every component is zero.
    """
    prep, parts = _prepared(spark, sf_dir, True)
    train, strength = parts["train"], 1.0
    model = L.fit_logistic(train, LABEL, strength, tolerance=1e-10)
    weights = L.balanced_weights(require_both_classes(train, LABEL, "training rows"))
    scored = L.weighted(model.transform(train), LABEL, weights)
    residual = F.col(L.WEIGHT) * (vector_to_array("probability")[1] - F.col(LABEL))
    entries = F.arrays_zip(
        F.array(*[F.lit(n) for n in prep.feature_names]).alias("feature"),
        F.array(*[F.lit(float(c)) for c in model.coefficients.toArray()]).alias("coefficient"),
        vector_to_array("features").alias("value"),
    )
    slopes = (
        scored.select(residual.alias("residual"), F.inline(entries))
        .groupBy("feature", "coefficient")
        .agg(F.sum(F.lit(strength) * F.col("residual") * F.col("value")).alias("loss_slope"))
    )
    flat = F.abs(F.col("loss_slope") + F.col("coefficient")) < 1e-2
    return slopes.select("feature", flat.alias("flat"))


def lr_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Test rows scored, classed at the validation threshold."""
    _, parts = _prepared(spark, sf_dir, True)
    model = L.fit_logistic(parts["train"], LABEL, 1.0)
    threshold = M.choose_threshold(L.score(model, parts["validation"], [ID], LABEL))
    return M.with_class(L.score(model, parts["test"], [ID], LABEL), threshold)


def gbt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, parts = _prepared(spark, sf_dir, False)
    return L.importance_table(L.fit_boosted(parts["train"], LABEL, BOOSTING), prep.feature_names)


def dummy_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored with the training prior."""
    df = I.training(spark, sf_dir)
    scored = L.score_prior(L.fit_prior(df, LABEL), df, [ID], LABEL)
    return I.rounded(scored, ["p"], 9)


def candidate_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search over two boosted and three linear candidates and the prior."""
    _, parts = _prepared(spark, sf_dir, True)
    train, validation = parts["train"], parts["validation"]
    fits = {
        "boosted shallow": lambda: L.fit_boosted(train, LABEL, SHALLOW),
        "boosted deeper": lambda: L.fit_boosted(train, LABEL, BOOSTING),
    }
    for strength in (0.1, 1.0, 10.0):
        fits[f"C={strength:g}"] = lambda c=strength: L.fit_logistic(train, LABEL, c)
    _, rows = L.search(fits, validation, LABEL, L.fit_prior(train, LABEL))
    return spark.createDataFrame(rows)


def linear_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, parts = _prepared(spark, sf_dir, True)
    model = L.fit_logistic(parts["train"], LABEL, 1.0)
    means = E.feature_means(parts["train"])
    return E.mean_abs_contribution(
        E.linear_contributions(model, parts["test"], means, prep.feature_names, [ID])
    )


def local_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest contributions of the test document with the smallest id."""
    prep, parts = _prepared(spark, sf_dir, True)
    model = L.fit_logistic(parts["train"], LABEL, 1.0)
    contributions = E.linear_contributions(
        model, parts["test"], E.feature_means(parts["train"]), prep.feature_names, [ID, LABEL]
    )
    first = parts["test"].agg(F.min(ID)).scalar()
    return E.top_contributions(contributions, F.col(ID) == first)


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    prep, parts = _prepared(spark, sf_dir, False)
    model = L.fit_boosted(parts["train"], LABEL, BOOSTING)
    return E.permutation_importance(model, parts["test"], ID, LABEL, prep.feature_names)


# Orders with one two-valued predictor and one constant: the fits have a closed form there,
# so SQL can state them. The tolerance and strength leave the optimum to five digits.
BINARY = ["dear", "constant"]
STUMP = L.BoostingSettings(rounds=1, depth=1, rate=0.1, subsample=1.0, features=1.0)


def _binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = (F.col("o_totalprice") >= 250000).cast("double")
    return stage(
        I.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("id"),
            (F.col("o_orderpriority") < "3").cast("int").alias("y"),
            dear.alias("dear"),
            array_to_vector(F.array(dear, F.lit(0.0))).alias(FEATURES),
        ),
        "binary",
    )


def _closed_logistic(df: DataFrame):
    return L.fit_logistic(df, "y", 1e6, tolerance=1e-12)


def lr_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coefficients of the weighted fit and its intercept: log-odds and their difference."""
    model = _closed_logistic(_binary(spark, sf_dir))
    table = L.coefficient_table(model, BINARY).withColumn("intercept", F.lit(float(model.intercept)))
    return I.rounded(table, ["coefficient", "magnitude", "intercept"], 4)


def lr_binary_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order scored by the fitted model: rows and score of each value."""
    df = _binary(spark, sf_dir)
    scored = L.score(_closed_logistic(df), df, ["id", "dear"], "y")
    return I.rounded(scored.groupBy("dear", "y").agg(F.count("id").alias("rows"), F.avg("p").alias("p")), ["p"], 5)


def gbt_stump_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One boosting round of depth one: the weighted mean of the labels on each side."""
    df = _binary(spark, sf_dir)
    scored = L.score(L.fit_boosted(df, "y", STUMP), df, ["id", "dear"], "y")
    return I.rounded(scored.groupBy("dear", "y").agg(F.count("id").alias("rows"), F.avg("p").alias("p")), ["p"], 9)


def gbt_stump_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.importance_table(L.fit_boosted(_binary(spark, sf_dir), "y", STUMP), BINARY)


def search_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The search itself: both fits order the rows alike, so the first wins."""
    df = _binary(spark, sf_dir)
    fits = {"stump": lambda: L.fit_boosted(df, "y", STUMP), "logistic": lambda: _closed_logistic(df)}
    winner, rows = L.search(fits, df, "y", L.fit_prior(df, "y"))
    table = spark.createDataFrame(rows).withColumn("selected", F.col("model") == winner.name)
    return I.rounded(table, ["average_precision", "roc_auc", "brier", "prevalence"], 5)


def perm_importance_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision lost when the predictor comes from the row before in hash order."""
    df = _binary(spark, sf_dir)
    return I.rounded(E.permutation_importance(_closed_logistic(df), df, "id", "y", BINARY), ["importance"], 9)


def linear_contrib_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _binary(spark, sf_dir)
    parts = E.linear_contributions(_closed_logistic(df), df, E.feature_means(df), BINARY, ["id"])
    return I.rounded(E.mean_abs_contribution(parts), ["mean_abs_contribution"], 4)


def local_contrib_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions to the score of the order with the smallest key."""
    df = _binary(spark, sf_dir)
    parts = E.linear_contributions(_closed_logistic(df), df, E.feature_means(df), BINARY, ["id"])
    strongest = E.top_contributions(parts, F.col("id") == df.agg(F.min("id")).scalar())
    return I.rounded(strongest, ["contribution", "magnitude"], 4)


def saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted pipeline stored with its settings and read back: the stored decision, and
    how many rows the model in memory and the one read score differently."""
    split = stage(I.training(spark, sf_dir), "training")
    prep = fit_preprocessor(split, NUMERIC, CATEGORICAL, scale_numeric=True)
    model = L.fit_logistic(prep.transform(split), LABEL, 1.0)
    path = work_path(spark, "saved-model")
    save_model(PipelineModel([*prep.model.stages, model]), path, 0.4, NUMERIC)
    loaded, settings = load_model(path)
    first = L.score(model, prep.transform(split), [ID], LABEL)
    second = L.score(loaded, split, [ID], LABEL).withColumnsRenamed({"y": "y2", "p": "p2"})
    compared = first.join(second, ID, "full")
    return compared.agg(
        F.count("*").alias("rows"),
        F.count_if(~(F.col("p").eqNullSafe(F.col("p2")) & F.col("y").eqNullSafe(F.col("y2")))).alias("differing"),
        F.lit(float(settings["threshold"])).alias("threshold"),
        F.lit(len(settings["columns"])).alias("columns"),
    )


QUERIES = {
    "lr_binary": lr_binary,
    "lr_binary_scores": lr_binary_scores,
    "gbt_stump_scores": gbt_stump_scores,
    "gbt_stump_importance": gbt_stump_importance,
    "search_binary": search_binary,
    "perm_importance_binary": perm_importance_binary,
    "linear_contrib_binary": linear_contrib_binary,
    "local_contrib_binary": local_contrib_binary,
    "saved_model_scores": saved_model_scores,
    "lr_fit": lr_fit,
    "lr_optimality": lr_optimality,
    "lr_scores": lr_scores,
    "gbt_fit": gbt_fit,
    "dummy_fit": dummy_fit,
    "candidate_table": candidate_table,
    "linear_contrib": linear_contributions,
    "local_contrib": local_contributions,
    "perm_importance": permutation_importance,
}

_BINARY_SQL = """paired AS (
  SELECT o_orderkey AS id, CAST(o_orderpriority < '3' AS INTEGER) AS y, CAST(o_totalprice >= 250000 AS INTEGER)::DOUBLE AS dear
  FROM orders),
cells AS (
  SELECT count(*)::DOUBLE AS n, sum(y)::DOUBLE AS ones,
         sum(y * dear)::DOUBLE AS ones_dear, sum((1 - y) * dear)::DOUBLE AS zeros_dear, avg(dear) AS mean FROM paired),
odds AS (
  SELECT *, (n - ones) / ones AS ratio,
         ((ones - ones_dear) / ones) / ((n - ones - zeros_dear) / (n - ones)) AS low,
         (ones_dear / ones) / (zeros_dear / (n - ones)) AS high FROM cells),
fitted AS (SELECT *, ln(low) AS intercept, ln(high) - ln(low) AS coefficient FROM odds),
leaves AS (
  SELECT *, (ratio * ones_dear - zeros_dear) / (ratio * ones_dear + zeros_dear) AS leaf_high,
         (ratio * (ones - ones_dear) - (n - ones - zeros_dear)) / (ratio * (ones - ones_dear) + (n - ones - zeros_dear)) AS leaf_low
  FROM fitted),
scored AS (
  SELECT b.*, CASE WHEN dear = 1 THEN high / (1 + high) ELSE low / (1 + low) END AS p_lr,
         1 / (1 + exp(-2 * CASE WHEN dear = 1 THEN leaf_high ELSE leaf_low END)) AS p_gbt, ones / n AS p_prior, coefficient, mean
  FROM paired b, leaves)"""
_BOTH = "SELECT 0 AS position, 'stump' AS model, y, p_gbt AS p, 1 AS w FROM scored UNION ALL SELECT 1, 'logistic', y, p_lr, 1 FROM scored UNION ALL SELECT 2, 'prior', y, p_prior, 1 FROM scored"
_SHUFFLED = """ranked AS (SELECT *, row_number() OVER (ORDER BY md5(concat(id, '|42')), id) - 1 AS r, count(*) OVER () AS n FROM scored),
shuffled AS (
  SELECT 0 AS slot, y, p_lr AS p, 1 AS w FROM scored
  UNION ALL SELECT 1, a.y, b.p_lr, 1 FROM ranked a JOIN ranked b ON a.r = (b.r + 1) % b.n)"""

ORACLES = {
    "lr_binary": I.with_ctes(
        _BINARY_SQL,
        select="""SELECT 'dear' AS feature, round(coefficient, 4) AS coefficient, round(abs(coefficient), 4) AS magnitude,
  round(intercept, 4) AS intercept FROM fitted
UNION ALL SELECT 'constant', 0.0::DOUBLE, 0.0::DOUBLE, round(intercept, 4) FROM fitted""",
    ),
    "lr_binary_scores": I.with_ctes(
        _BINARY_SQL, select="SELECT dear, y, count(*) AS rows, round(avg(p_lr), 5) AS p FROM scored GROUP BY dear, y"
    ),
    "gbt_stump_scores": I.with_ctes(
        _BINARY_SQL, select="SELECT dear, y, count(*) AS rows, round(avg(p_gbt), 9) AS p FROM scored GROUP BY dear, y"
    ),
    "gbt_stump_importance": I.with_ctes(
        _BINARY_SQL,
        select="""SELECT 'dear' AS feature, CASE WHEN leaf_high <> leaf_low THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS importance FROM leaves
UNION ALL SELECT 'constant', 0.0::DOUBLE""",
    ),
    "search_binary": I.with_ctes(
        _BINARY_SQL,
        f"candidates AS ({_BOTH})",
        curve_sql("candidates", "position, model"),
        f"""ranking AS (SELECT position, model, {AP_SQL} AS average_precision, {AUC_SQL} AS roc_auc FROM curve GROUP BY position, model),
losses AS (SELECT position, avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence FROM candidates GROUP BY position)""",
        select="""SELECT CAST(position AS BIGINT) AS position, model, round(average_precision, 5) AS average_precision, round(roc_auc, 5) AS roc_auc,
  round(brier, 5) AS brier, round(prevalence, 5) AS prevalence, position = 0 AS selected FROM ranking JOIN losses USING (position)""",
    ),
    "perm_importance_binary": I.with_ctes(
        _BINARY_SQL,
        _SHUFFLED,
        curve_sql("shuffled", "slot"),
        f"ranking AS (SELECT slot, {AP_SQL} AS ap FROM curve GROUP BY slot)",
        select="""SELECT 'dear' AS feature, round(a.ap - b.ap, 9) AS importance FROM ranking a, ranking b WHERE a.slot = 0 AND b.slot = 1
UNION ALL SELECT 'constant', 0.0::DOUBLE""",
    ),
    "linear_contrib_binary": I.with_ctes(
        _BINARY_SQL,
        select="""SELECT 'dear' AS feature, round(avg(abs(coefficient * (dear - mean))), 4) AS mean_abs_contribution FROM scored
UNION ALL SELECT 'constant', 0.0::DOUBLE""",
    ),
    "local_contrib_binary": I.with_ctes(
        _BINARY_SQL,
        "first AS (SELECT id, coefficient * (dear - mean) AS c FROM scored ORDER BY id LIMIT 1)",
        select="""SELECT id, 'dear' AS feature, round(c, 4) AS contribution, round(abs(c), 4) AS magnitude FROM first
UNION ALL SELECT id, 'constant', 0.0::DOUBLE, 0.0::DOUBLE FROM first""",
    ),
    "saved_model_scores": I.with_ctes(
        I.TRAINING_SQL,
        select="SELECT count(*) AS rows, CAST(0 AS BIGINT) AS differing, 0.4::DOUBLE AS threshold, 3 AS columns FROM training",
    ),
    "lr_optimality": I.with_ctes(
        I.TRAINING_SQL,
        split_sql("training", "doc_id", "quality"),
        "fitted AS (SELECT training.* FROM training JOIN split USING (doc_id) WHERE split = 'train')",
        select="""SELECT 'n_chars' AS feature, TRUE AS flat
UNION ALL SELECT 'toxic', TRUE UNION ALL SELECT 'source_length', TRUE
UNION ALL SELECT DISTINCT concat('lang=', coalesce(lang, '__MISSING__')), TRUE FROM fitted
UNION ALL SELECT DISTINCT concat('source=', coalesce(source, '__MISSING__')), TRUE FROM fitted""",
    ),
    "dummy_fit": I.with_ctes(
        I.TRAINING_SQL,
        select="SELECT doc_id, quality AS y, (SELECT round(avg(quality), 9) FROM training) AS p FROM training",
    ),
}
