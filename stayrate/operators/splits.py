"""Train / validation / test partitions and their summaries."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stayrate.errors import DataQualityError
from stayrate.operators.ordering import hash_digits, hash_key
from stayrate.operators.quality import audit, one_per_key
from stayrate.session import stage

SPLITS = ("train", "validation", "test")


def _allocate(draws: int, counts: Mapping[object, int]) -> dict[object, int]:
    """Share ``draws`` out in proportion to ``counts``: floors, then the largest
    remainders; equal remainders go to the larger label."""
    total = sum(counts.values())
    shares = {k: draws * n // total for k, n in counts.items()}
    by_remainder = sorted(counts, key=lambda k: (draws * counts[k] % total, k), reverse=True)
    for k in by_remainder[: draws - sum(shares.values())]:
        shares[k] += 1
    return shares


def split_sizes(counts: Mapping[object, int], train_share: float = 0.70) -> dict[object, tuple[int, int, int]]:
    """Rows per class in (train, validation, test): the rest is halved in a second draw."""
    total = sum(counts.values())
    rest = math.ceil(total * (1 - train_share))
    train = _allocate(total - rest, counts)
    left = {k: counts[k] - train[k] for k in counts}
    validation = _allocate(rest - math.ceil(0.5 * rest), left)
    return {k: (train[k], validation[k], left[k] - validation[k]) for k in counts}


def stratified_split(
    df: DataFrame,
    id_col: str,
    label: str,
    seed: int = 42,
    train_share: float = 0.70,
    digits: int | None = None,
) -> DataFrame:
    """``(id, label, split)`` with exact class sizes, in seeded hash order.

    The hash order of a class is cut by counting rows per leading hash digits.
    Only the one bucket each cut falls into is ranked row by row; all other
    rows are placed by their bucket; the cuts are a small table, broadcast only
    if it turns out small. Labels must be 0 or 1. Reads ``df``'s two columns
    four times, so pass a stored table.
    """
    bad = df.select(label).where(F.col(label).isNull() | ~F.col(label).isin(0, 1)).count()
    if bad:
        raise DataQualityError("stratified split", {"bad_labels": bad})
    digits = digits or hash_digits(df.count())
    keyed = df.select(id_col, label, hash_key(id_col, seed).alias("_h")).withColumn(
        "_bucket", F.substring("_h", 1, digits)
    )
    counts = stage(keyed.groupBy(label, "_bucket").agg(F.count(F.lit(1)).alias("_n")), "split-counts")
    totals = {r[label]: r["n"] for r in counts.groupBy(label).agg(F.sum("_n").alias("n")).collect()}
    sizes = split_sizes(totals, train_share)

    def per_class(pick):
        column = F.lit(None).cast("bigint")
        for k, cut in sizes.items():
            column = F.when(F.col(label) == F.lit(k), F.lit(pick(cut))).otherwise(column)
        return column

    before = Window.partitionBy(label).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = counts.select(
        label,
        "_bucket",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
        "_n",
        per_class(lambda c: c[0]).alias("_cut1"),
        per_class(lambda c: c[0] + c[1]).alias("_cut2"),
    )
    after = F.col("_before") + F.col("_n")
    crossed = ((F.col("_cut1") > F.col("_before")) & (F.col("_cut1") < after)) | (
        (F.col("_cut2") > F.col("_before")) & (F.col("_cut2") < after)
    )
    placed = keyed.join(cuts.withColumn("_crossed", crossed).drop("_n"), [label, "_bucket"])
    ranked = Window.partitionBy(label, "_bucket").orderBy("_h", id_col)
    settled = placed.where(~F.col("_crossed")).withColumn("_at", F.col("_before"))
    border = placed.where("_crossed").withColumn(
        "_at", F.col("_before") + F.row_number().over(ranked) - 1
    )
    split = (
        F.when(F.col("_at") < F.col("_cut1"), SPLITS[0])
        .when(F.col("_at") < F.col("_cut2"), SPLITS[1])
        .otherwise(SPLITS[2])
    )
    return settled.unionByName(border).select(id_col, label, split.alias("split"))


def check_split(assignments: DataFrame, cohort: DataFrame, id_col: str) -> None:
    """Each cohort member is assigned once and no one else is."""
    keyed = one_per_key(assignments.select(id_col, "split"), [id_col], times="_assigned")
    wanted = cohort.select(id_col).distinct().withColumn("_wanted", F.lit(1))
    assigned = F.col("_assigned").isNotNull()
    known = F.coalesce(F.col("split").isin(*SPLITS), F.lit(False))
    counts = {
        "missing_keys": assigned & F.col(id_col).isNull(),
        "repeated_keys": F.col("_assigned") > 1,
        "unassigned": ~assigned & F.col(id_col).isNotNull(),
        "outsiders": assigned & F.col("_wanted").isNull() & F.col(id_col).isNotNull(),
        "unknown_splits": assigned & ~known,
    }
    row = audit(keyed.join(wanted, id_col, "full"), {**counts, **{f"in_{s}": F.col("split") == s for s in SPLITS}})
    found = row.first().asDict()
    failing = {name: found[name] for name in counts if found[name]}
    failing |= {f"empty_{s}": 1 for s in SPLITS if not found[f"in_{s}"]}
    if failing:
        raise DataQualityError("split assignments", failing)


def chronological_split(
    df: DataFrame, when: str, ranges: Mapping[str, tuple[date | None, date]], name: str = "split"
) -> DataFrame:
    """Split by inclusive date ranges; rows in no range are NULL."""
    column = F.lit(None).cast("string")
    for split, (first, last) in reversed(list(ranges.items())):
        inside = F.col(when) <= F.lit(last).cast("timestamp_ntz")
        if first is not None:
            inside = inside & (F.col(when) >= F.lit(first).cast("timestamp_ntz"))
        column = F.when(inside, split).otherwise(column)
    return df.withColumn(name, column)


def split_summary(
    df: DataFrame, split: str, entity: str, label: str, when: str | None = None
) -> DataFrame:
    """Per split: rows, entities, positives, prevalence % and date span.

    Rows are counted per (split, entity) first, so counting entities needs no
    DISTINCT and a frequent entity is pre-aggregated.
    """
    span = [F.min(when).alias("start"), F.max(when).alias("end")] if when else []
    per_entity = df.groupBy(split, entity).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(label).alias("positives"), *span
    )
    outer = [F.min("start").alias("start_date"), F.max("end").alias("end_date")] if when else []
    return (
        per_entity.groupBy(split)
        .agg(
            F.sum("rows").alias("rows"),
            F.count(entity).alias("entities"),
            F.sum("positives").alias("positives"),
            *outer,
        )
        .withColumn("prevalence_pct", F.lit(100.0) * F.col("positives") / F.col("rows"))
    )


def label_counts_by_split(df: DataFrame, split: str, label: str, order: Sequence[str] = SPLITS) -> DataFrame:
    """Rows per label with one column per split, zero where there are none."""
    return df.groupBy(label).pivot(split, list(order)).agg(F.count(F.lit(1))).na.fill(0, list(order))
