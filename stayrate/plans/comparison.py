"""Compare two stored prediction sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stayrate.operators.comparison import model_comparison, paired_bootstrap, stack_models
from stayrate.operators.joins import align_scored
from stayrate.operators.metrics import evaluate
from stayrate.session import report, staging
from stayrate.sources.sinks import write_csv, write_json, write_json_document


def compare_predictions(
    first: DataFrame, second: DataFrame, output: str, replicates: int = 2000, seed: int = 42
) -> dict[str, DataFrame]:
    """Align, measure and bootstrap two sets from ``load_predictions``; store the reports."""
    with staging(first.sparkSession):
        pair = align_scored(first, second)
        metrics = report(evaluate(stack_models(pair), ["model"]))
        differences = report(model_comparison(pair))
        intervals = report(paired_bootstrap(pair, replicates, seed))
        observations = pair.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("positives")).first()
    write_csv(differences, f"{output}/comparison")
    write_json(metrics, f"{output}/metrics")
    write_json(intervals, f"{output}/bootstrap")
    write_json_document(
        first.sparkSession,
        {
            "comparison": "second minus first",
            "observations": observations["n"],
            "positives": observations["positives"],
            "replicates": replicates,
            "seed": seed,
        },
        f"{output}/settings",
    )
    return {"metrics": metrics, "differences": differences, "intervals": intervals}
