"""Metrics, thresholds, comparisons and bootstraps of scored sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators import comparison as K
from stayrate.operators import metrics as M
from stayrate.operators.joins import align_scored
from stayrate.session import stage
from stayrate.suite import inputs as I

RATIOS = ["precision", "recall", "f1", "balanced_accuracy"]
PAIRED_REPLICATES = 2000
CLUSTER_REPLICATES = 100


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion(I.scored(spark, sf_dir))


def class_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rounded(M.class_metrics(I.scored(spark, sf_dir)), RATIOS, 9)


def all_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric of both models and of each order priority's share at once."""
    stacked = K.stack_models(I.scored_pair(I.scored(spark, sf_dir)))
    df = M.evaluate(stacked, ["model"])
    names = ["average_precision", "roc_auc", "log_loss", "brier", "prevalence", *RATIOS]
    return I.rounded(df, names, 9)


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.evaluate(I.scored(spark, sf_dir), yhat=None).select("roc_auc")
    return I.rounded(df, ["roc_auc"], 9)


def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.evaluate(I.scored(spark, sf_dir), p="p2", yhat=None).select("average_precision")
    return I.rounded(df, ["average_precision"], 9)


def log_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rounded(M.log_loss(I.scored(spark, sf_dir)), ["log_loss"], 9)


def brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rounded(M.brier(I.scored(spark, sf_dir)), ["brier"], 9)


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.pr_curve(I.scored(spark, sf_dir), p="p2")
    return I.rounded(df, ["precision", "recall", "f1"], 9)


def roc_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.roc_curve(I.scored(spark, sf_dir), p="p2")
    finite = F.when(F.col("threshold") < 2, F.col("threshold"))
    return I.rounded(df.withColumn("threshold", finite), ["fpr", "tpr"], 9)


def f1_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.best_f1_threshold(I.scored(spark, sf_dir), p="p2")
    return I.rounded(df, ["precision", "recall", "f1"], 9)


def f1_threshold_lowest(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.best_f1_threshold(I.scored(spark, sf_dir), p="p2", tie_break="lowest")
    return I.rounded(df, ["precision", "recall", "f1"], 9)


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rounded(M.class_report(I.scored(spark, sf_dir), yhat="yhat2"), RATIOS[:3], 9)


def label_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.rounded(M.label_error(I.scored(spark, sf_dir)), ["mse", "mean_error"], 9)


def ap_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.ap_lift(I.scored(spark, sf_dir), p="p2")
    return I.rounded(df, ["prevalence", "average_precision", "lift"], 9)


def score_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = M.score_diagnostics(I.scored(spark, sf_dir), p="p2")
    return I.rounded(df, ["mean", "median", "std"], 9)


def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scored sets aligned on id, every metric side by side."""
    df = I.scored(spark, sf_dir)
    first = df.select("id", F.col("y").alias("actual"), F.col("p").alias("probability"), F.col("yhat").alias("prediction"))
    second = df.select("id", F.col("y").alias("actual"), F.col("p2").alias("probability"), F.col("yhat2").alias("prediction"))
    compared = K.model_comparison(align_scored(first, second))
    return I.rounded(compared, ["model_a", "model_b", "difference"], 9)


def paired_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = stage(I.scored_pair(I.scored(spark, sf_dir)), "pair")
    df = K.paired_bootstrap(pair, PAIRED_REPLICATES, 42)
    return I.rounded(df, ["ci_lower", "ci_upper", "mean_difference", "observed_difference"], 9)


def paired_bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form without draws, over the same orders."""
    pair = stage(I.scored_pair(I.scored(spark, sf_dir)), "pair")
    df = K.paired_bootstrap(pair, PAIRED_REPLICATES, 42, method="weights")
    return I.rounded(df, ["ci_lower", "ci_upper", "mean_difference", "observed_difference"], 9)


def cluster_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resampling customers, each with all their scored orders."""
    df = K.cluster_bootstrap(I.scored(spark, sf_dir), "o_custkey", CLUSTER_REPLICATES, 42)
    return I.rounded(df, ["ci_lower", "ci_upper", "mean_value"], 9)


QUERIES = {
    "confusion": confusion,
    "class_metrics": class_metrics,
    "all_metrics": all_metrics,
    "roc_auc": roc_auc,
    "avg_precision": avg_precision,
    "log_loss": log_loss,
    "brier": brier,
    "pr_curve": pr_curve,
    "roc_curve": roc_curve,
    "f1_threshold": f1_threshold,
    "f1_threshold_lowest": f1_threshold_lowest,
    "class_report": class_report,
    "label_error": label_error,
    "ap_lift": ap_lift,
    "score_diagnostics": score_diagnostics,
    "model_comparison": model_comparison,
    "paired_bootstrap": paired_bootstrap,
    "paired_bootstrap_weights": paired_bootstrap_weights,
    "cluster_bootstrap": cluster_bootstrap,
}


def curve_sql(source: str, groups: str = "") -> str:
    """Counts per distinct score with running totals, best score first."""
    lead = f"{groups}, " if groups else ""
    part = f"PARTITION BY {groups} " if groups else ""
    return f"""counted AS (
  SELECT {lead}p, sum(w * y) AS pos, sum(w * (1 - y)) AS neg FROM {source} GROUP BY {lead}p),
curve AS (
  SELECT *, sum(pos) OVER ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cp,
         sum(neg) OVER ({part}ORDER BY p DESC ROWS UNBOUNDED PRECEDING) AS cn,
         sum(pos) OVER ({part}) AS ap, sum(neg) OVER ({part}) AS an
  FROM counted)"""


AP_SQL = "coalesce(sum(pos * (cp / (cp + cn)::DOUBLE)) / NULLIF(max(ap), 0), 0)"
AUC_SQL = "sum(neg * (cp - pos / 2.0::DOUBLE)) / NULLIF(max(ap)::DOUBLE * max(an), 0)"
_SINGLE = "single AS (SELECT y, p2 AS p, 1 AS w FROM classed)"
_FIRST = "single AS (SELECT y, p, 1 AS w FROM classed)"
_STACKED = """stacked AS (SELECT 'a' AS model, y, p, yhat, 1 AS w FROM classed
  UNION ALL SELECT 'b', y, p2, yhat2, 1 FROM classed)"""
_POINTS = """points AS (
  SELECT p AS threshold, cp / (cp + cn)::DOUBLE AS precision, cp / ap::DOUBLE AS recall,
         coalesce(2 * (cp / (cp + cn)::DOUBLE) * (cp / ap::DOUBLE)
           / NULLIF(cp / (cp + cn)::DOUBLE + cp / ap::DOUBLE, 0), 0) AS f1 FROM curve)"""
CELLS_SQL = """cells AS (SELECT {group} count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn,
    count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn,
    count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp FROM {source} {tail})"""
RATES_SQL = {
    "precision": "coalesce(tp::DOUBLE / NULLIF(tp + fp, 0), 0)",
    "recall": "coalesce(tp::DOUBLE / NULLIF(tp + fn, 0), 0)",
    "f1": "coalesce(2.0::DOUBLE * tp / NULLIF(2 * tp + fp + fn, 0), 0)",
    "balanced_accuracy": "(tp::DOUBLE / (tp + fn) + tn::DOUBLE / (tn + fp)) / 2",
}
_CLIP = "least(greatest(p, 2.220446049250313e-16), 1.0::DOUBLE - 2.220446049250313e-16)"
_LOSS = f"-avg(CASE WHEN y = 1 THEN ln({_CLIP}) ELSE ln(1.0::DOUBLE - {_CLIP}) END)"
_ALL = ["average_precision", "roc_auc", "precision", "recall", "f1", "balanced_accuracy", "log_loss"]
_MEASURED = [
    _STACKED,
    curve_sql("stacked", "model"),
    f"ranking AS (SELECT model, {AP_SQL} AS average_precision, {AUC_SQL} AS roc_auc FROM curve GROUP BY model)",
    f"""losses AS (SELECT model, {_LOSS} AS log_loss, avg((p - y) * (p - y)) AS brier, avg(y) AS prevalence,
  CAST(sum(y) AS BIGINT) AS positives, CAST(sum(1 - y) AS BIGINT) AS negatives FROM stacked GROUP BY model)""",
    CELLS_SQL.format(group="model,", source="stacked", tail="GROUP BY model"),
    "measured AS (SELECT *, "
    + ", ".join(f"{sql} AS {name}" for name, sql in RATES_SQL.items())
    + " FROM ranking JOIN losses USING (model) JOIN cells USING (model))",
]
_REPORT = """f AS (SELECT tn::DOUBLE AS tn, fp::DOUBLE AS fp, fn::DOUBLE AS fn, tp::DOUBLE AS tp FROM cells),
per AS (
  SELECT tn / (tn + fn) AS p0, tn / (tn + fp) AS r0, tp / (tp + fp) AS p1, tp / (tp + fn) AS r1,
         tn + fp AS s0, tp + fn AS s1, tn + tp AS right_ones FROM f),
per2 AS (SELECT *, 2 * p0 * r0 / (p0 + r0) AS f0, 2 * p1 * r1 / (p1 + r1) AS f1, s0 + s1 AS s FROM per),
report AS (
  SELECT '0' AS label, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM per2
  UNION ALL SELECT '1', p1, r1, f1, s1 FROM per2
  UNION ALL SELECT 'accuracy', right_ones / s, right_ones / s, right_ones / s, s FROM per2
  UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s FROM per2
  UNION ALL SELECT 'weighted avg', (p0 * s0 + p1 * s1) / s, (r0 * s0 + r1 * s1) / s, (f0 * s0 + f1 * s1) / s, s FROM per2)"""

# 13 leading hex digits of the md5 as a number, modulo the size.
_DRAW = "CAST(concat('0x', substr(md5({text}), 1, 13)) AS BIGINT) % {size}"
_DIFFERENCES = f"""{curve_sql("both_models", "replicate, model")},
ranking AS (SELECT replicate, model, {AP_SQL} AS average_precision, {AUC_SQL} AS roc_auc FROM curve GROUP BY ALL),
cells AS (SELECT replicate, model, 2.0::DOUBLE * sum(w * y * yhat) AS num, sum(w * (y + yhat)) AS den FROM both_models GROUP BY ALL),
measured AS (SELECT *, coalesce(num / NULLIF(den, 0), 0) AS f1 FROM ranking JOIN cells USING (replicate, model)),
long AS (UNPIVOT (SELECT replicate, model, average_precision, roc_auc, f1 FROM measured)
  ON average_precision, roc_auc, f1 INTO NAME metric VALUE v),
diffs AS (SELECT replicate, metric, sum(CASE WHEN model = 'b' THEN v ELSE -v END) AS d FROM long GROUP BY ALL)"""
_PAIRED = f"""{I.SCORED_SQL},
indexed AS (
  SELECT *, row_number() OVER (PARTITION BY y ORDER BY md5(concat(id, '|42')), id) - 1 AS idx,
         count(*) OVER (PARTITION BY y) AS n_c FROM classed),
draws AS (
  SELECT r AS replicate, y, {_DRAW.format(text="concat(r, '|', y, '|', idx, '|42')", size="n_c")} AS idx
  FROM indexed, range(1, {PAIRED_REPLICATES + 1}) t(r)),
sampled AS (SELECT d.replicate, i.* FROM draws d JOIN indexed i ON d.y = i.y AND d.idx = i.idx),
both_models AS (
  SELECT replicate, 'a' AS model, y, p, yhat, 1 AS w FROM sampled
  UNION ALL SELECT replicate, 'b', y, p2, yhat2, 1 FROM sampled
  UNION ALL SELECT 0, 'a', y, p, yhat, 1 FROM classed
  UNION ALL SELECT 0, 'b', y, p2, yhat2, 1 FROM classed),
{_DIFFERENCES}"""

_NUMBER = "CAST(concat('0x', substr(md5(concat(r, '|', id, '|42')), 1, 13)) AS BIGINT)"
_WEIGHT = "CASE " + " ".join(f"WHEN k < {step} THEN {w}" for w, step in enumerate(K.poisson_steps()))
_WEIGHTED = f"""{I.SCORED_SQL},
numbers AS (SELECT r AS replicate, y, p, p2, yhat, yhat2, {_NUMBER} AS k FROM classed, range(1, {PAIRED_REPLICATES + 1}) t(r)),
taken AS (SELECT *, {_WEIGHT} ELSE {len(K.poisson_steps())} END AS w FROM numbers),
both_models AS (
  SELECT replicate, 'a' AS model, y, p, yhat, w FROM taken WHERE w > 0
  UNION ALL SELECT replicate, 'b', y, p2, yhat2, w FROM taken WHERE w > 0
  UNION ALL SELECT 0, 'a', y, p, yhat, 1 FROM classed
  UNION ALL SELECT 0, 'b', y, p2, yhat2, 1 FROM classed),
{_DIFFERENCES}"""

_CLUSTER = f"""{I.SCORED_SQL},
clusters AS (
  SELECT o_custkey, row_number() OVER (ORDER BY md5(concat(o_custkey, '|42')), o_custkey) - 1 AS idx
  FROM (SELECT DISTINCT o_custkey FROM classed)),
size AS (SELECT count(*) AS n FROM clusters),
draws AS (
  SELECT r AS replicate, {_DRAW.format(text="concat(r, '|c|', idx, '|42')", size="n")} AS idx
  FROM clusters, size, range(1, {CLUSTER_REPLICATES + 1}) t(r)),
weights AS (SELECT replicate, o_custkey, count(*) AS w FROM draws JOIN clusters USING (idx) GROUP BY ALL),
sampled AS (SELECT replicate, y, p, w FROM classed JOIN weights USING (o_custkey)),
{curve_sql("sampled", "replicate")},
ranking AS (SELECT replicate, {AP_SQL} AS v FROM curve GROUP BY replicate HAVING max(ap) > 0 AND max(an) > 0)"""


def _rounded(names: list[str]) -> str:
    return ", ".join(f"round({n}, 9) AS {n}" for n in names)


ORACLES = {
    "confusion": I.with_ctes(
        I.SCORED_SQL, CELLS_SQL.format(group="", source="classed", tail=""), select="SELECT * FROM cells"
    ),
    "class_metrics": I.with_ctes(
        I.SCORED_SQL,
        CELLS_SQL.format(group="", source="classed", tail=""),
        select="SELECT *, " + ", ".join(f"round({sql}, 9) AS {name}" for name, sql in RATES_SQL.items()) + " FROM cells",
    ),
    "all_metrics": I.with_ctes(
        I.SCORED_SQL,
        *_MEASURED,
        select="SELECT model, positives, negatives, tn, fp, fn, tp, "
        + _rounded([*_ALL, "brier", "prevalence"])
        + " FROM measured",
    ),
    "roc_auc": I.with_ctes(
        I.SCORED_SQL, _FIRST, curve_sql("single"), select=f"SELECT round({AUC_SQL}, 9) AS roc_auc FROM curve"
    ),
    "avg_precision": I.with_ctes(
        I.SCORED_SQL, _SINGLE, curve_sql("single"), select=f"SELECT round({AP_SQL}, 9) AS average_precision FROM curve"
    ),
    "log_loss": I.with_ctes(I.SCORED_SQL, select=f"SELECT round({_LOSS}, 9) AS log_loss FROM classed"),
    "brier": I.with_ctes(I.SCORED_SQL, select="SELECT round(avg((p - y) * (p - y)), 9) AS brier FROM classed"),
    "pr_curve": I.with_ctes(
        I.SCORED_SQL,
        _SINGLE,
        curve_sql("single"),
        _POINTS,
        select=f"""SELECT threshold, {_rounded(['precision', 'recall', 'f1'])} FROM points
UNION ALL SELECT NULL, 1.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    ),
    "roc_curve": I.with_ctes(
        I.SCORED_SQL,
        _SINGLE,
        curve_sql("single"),
        select="""SELECT p AS threshold, round(cn / an::DOUBLE, 9) AS fpr, round(cp / ap::DOUBLE, 9) AS tpr FROM curve
UNION ALL SELECT NULL, 0.0::DOUBLE, 0.0::DOUBLE""",
    ),
    "f1_threshold": I.with_ctes(
        I.SCORED_SQL,
        _SINGLE,
        curve_sql("single"),
        _POINTS,
        "top AS (SELECT max(f1) AS m FROM points)",
        select=f"""SELECT threshold, {_rounded(['precision', 'recall', 'f1'])} FROM points, top
WHERE points.f1 >= m - (1e-8::DOUBLE + 1e-5::DOUBLE * m) ORDER BY points.precision DESC, threshold LIMIT 1""",
    ),
    "f1_threshold_lowest": I.with_ctes(
        I.SCORED_SQL,
        _SINGLE,
        curve_sql("single"),
        _POINTS,
        select=f"SELECT threshold, {_rounded(['precision', 'recall', 'f1'])} FROM points ORDER BY points.f1 DESC, threshold LIMIT 1",
    ),
    "class_report": I.with_ctes(
        I.SCORED_SQL,
        "second AS (SELECT y, yhat2 AS yhat FROM classed)",
        CELLS_SQL.format(group="", source="second", tail=""),
        _REPORT,
        select=f"SELECT label, {_rounded(['precision', 'recall', 'f1'])}, CAST(support AS BIGINT) AS support FROM report",
    ),
    "label_error": I.with_ctes(
        I.SCORED_SQL,
        select="""SELECT round(avg((y - yhat) * (y - yhat)), 9) AS mse, round(avg(y - yhat), 9) AS mean_error,
  max(abs(y - yhat))::DOUBLE AS max_abs_error FROM classed""",
    ),
    "ap_lift": I.with_ctes(
        I.SCORED_SQL,
        _SINGLE,
        curve_sql("single"),
        f"a AS (SELECT {AP_SQL} AS ap1, max(ap) / (max(ap) + max(an))::DOUBLE AS prev FROM curve)",
        select="""SELECT round(prev, 9) AS prevalence, round(ap1, 9) AS average_precision,
  round(ap1 / greatest(prev, 1e-12), 9) AS lift FROM a""",
    ),
    "score_diagnostics": I.with_ctes(
        I.SCORED_SQL,
        select="""SELECT y, count(*) AS count, round(avg(p2), 9) AS mean, round(quantile_cont(p2, 0.5), 9) AS median,
  round(stddev_samp(p2), 9) AS std, min(p2) AS min, max(p2) AS max FROM classed GROUP BY y""",
    ),
    "model_comparison": I.with_ctes(
        I.SCORED_SQL,
        *_MEASURED,
        f"long AS (UNPIVOT (SELECT model, {', '.join(_ALL)} FROM measured) ON {', '.join(_ALL)} INTO NAME metric VALUE v)",
        """wide AS (SELECT metric, max(v) FILTER (WHERE model = 'a') AS model_a, max(v) FILTER (WHERE model = 'b') AS model_b
  FROM long GROUP BY metric)""",
        select="""SELECT metric, round(model_a, 9) AS model_a, round(model_b, 9) AS model_b,
  round(model_b - model_a, 9) AS difference FROM wide""",
    ),
    "paired_bootstrap": I.with_ctes(
        _PAIRED,
        select="""SELECT metric, count(*) FILTER (WHERE replicate > 0) AS replicates,
  round(quantile_cont(d, 0.025) FILTER (WHERE replicate > 0), 9) AS ci_lower,
  round(quantile_cont(d, 0.975) FILTER (WHERE replicate > 0), 9) AS ci_upper,
  round(avg(d) FILTER (WHERE replicate > 0), 9) AS mean_difference,
  round(max(d) FILTER (WHERE replicate = 0), 9) AS observed_difference FROM diffs GROUP BY metric""",
    ),
    "paired_bootstrap_weights": I.with_ctes(
        _WEIGHTED,
        select="""SELECT metric, count(*) FILTER (WHERE replicate > 0) AS replicates,
  round(quantile_cont(d, 0.025) FILTER (WHERE replicate > 0), 9) AS ci_lower,
  round(quantile_cont(d, 0.975) FILTER (WHERE replicate > 0), 9) AS ci_upper,
  round(avg(d) FILTER (WHERE replicate > 0), 9) AS mean_difference,
  round(max(d) FILTER (WHERE replicate = 0), 9) AS observed_difference FROM diffs GROUP BY metric""",
    ),
    "cluster_bootstrap": I.with_ctes(
        _CLUSTER,
        select="""SELECT 'average_precision' AS metric, count(*) AS replicates, round(quantile_cont(v, 0.025), 9) AS ci_lower,
  round(quantile_cont(v, 0.975), 9) AS ci_upper, round(avg(v), 9) AS mean_value FROM ranking""",
    ),
}
