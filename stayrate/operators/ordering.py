"""Exact running totals and ranks without pulling a group into one task.

A window over the whole table (or over one class holding most rows) sorts
everything in a single task. Here a group is cut into buckets that follow the
sort order: totals per bucket give each bucket's offset, and only rows inside
one bucket are sorted together.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.session import stage

ROWS_PER_BUCKET = 250_000
MAX_HASH_DIGITS = 8


def hash_digits(rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Leading hex digits that cut ``rows`` rows into buckets of about the wanted size."""
    digits = 1
    while digits < MAX_HASH_DIGITS and 16**digits * rows_per_bucket < rows:
        digits += 1
    return digits


def _accumulate(
    rows: DataFrame,
    buckets: DataFrame,
    group_cols: Sequence[str],
    bucket_order: Column,
    row_order: Sequence[Column],
    measures: Sequence[str],
) -> DataFrame:
    """Inclusive running sums over ``(group, _bucket)`` in order.

    ``buckets`` holds each bucket's sums. Every bucket gets one header row
    that sorts first and carries the sum of the buckets before it, so the
    running sum inside the bucket is already the global one: no join, and
    the rows are exchanged once. Adds ``cum_<m>`` and ``all_<m>``.
    """
    groups = list(group_cols)
    # A few rows per group: a window over a whole group is safe here only.
    whole = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(1))
    before = whole.orderBy(bucket_order).rowsBetween(Window.unboundedPreceding, -1)
    headers = buckets.select(
        *groups,
        "_bucket",
        F.lit(0).alias("_row"),
        *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(m) for m in measures],
        *[F.sum(m).over(whole).alias(f"all_{m}") for m in measures],
    )
    both = rows.withColumn("_row", F.lit(1)).unionByName(headers, allowMissingColumns=True)
    running = (
        Window.partitionBy(*groups, "_bucket")
        .orderBy("_row", *row_order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = both.select(
        *[c for c in both.columns if not c.startswith("all_")],
        *[F.sum(m).over(running).alias(f"cum_{m}") for m in measures],
        *[F.first(f"all_{m}", ignorenulls=True).over(running).alias(f"all_{m}") for m in measures],
    )
    return summed.where(F.col("_row") == 1)


def running_totals(
    df: DataFrame,
    value: str,
    measures: Sequence[str],
    group_cols: Sequence[str] = (),
    descending: bool = False,
    carry: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Per group, inclusive running sums of ``measures`` in ``value`` order.

    ``df`` holds one row per (group, value), so aggregate first. Adds
    ``cum_<m>`` and the group total ``all_<m>`` for every measure; ``carry``
    columns pass through. The rows are dealt by range of (group, value), and the
    partitions are the buckets: one way at every size, a group gets as many
    buckets as it fills. Spark sizes the ranges (``spark.sql.shuffle.partitions``,
    small ones merged) unless ``rows_per_bucket`` asks for another number. The
    dealt table is written once to the shared folder, because it is read for the
    bucket sums and for the result and must be the same both times.
    """
    groups = list(group_cols)
    kept = [*groups, value, *measures, *carry]
    rows = df.select(*kept)
    if rows_per_bucket is None:
        ranged = rows.repartitionByRange(*groups, value)
    else:
        ranged = rows.repartitionByRange(max(1, -(-rows.count() // rows_per_bucket)), *groups, value)
    table = stage(ranged.withColumn("_bucket", F.spark_partition_id()), "running-totals")
    order = F.col(value).desc() if descending else F.col(value).asc()
    buckets = table.groupBy(*groups, "_bucket").agg(*[F.sum(m).alias(m) for m in measures])
    bucket_order = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    summed = _accumulate(table, buckets, groups, bucket_order, [order], measures)
    return summed.select(
        *kept, *[f"cum_{m}" for m in measures], *[f"all_{m}" for m in measures]
    )


def hash_key(id_cols: Sequence[str] | str, seed: int | str) -> Column:
    """Seeded pseudo-random sort key: md5 of the id parts and the seed, as hex text."""
    names = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    parts = [F.coalesce(F.col(n).cast("string"), F.lit("")) for n in names]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def hash_rank(
    df: DataFrame,
    id_cols: Sequence[str] | str,
    seed: int | str,
    group_cols: Sequence[str] = (),
    name: str = "rank",
    digits: int | None = None,
) -> DataFrame:
    """Dense 0-based rank of each row in seeded random order, per group.

    The leading hash digits spread any group, however large, over
    ``16 ** digits`` equal buckets, as many as the rows need if not given; ties
    on the hash break by id.
    """
    names = [id_cols] if isinstance(id_cols, str) else list(id_cols)
    digits = digits or hash_digits(df.count())
    groups = list(group_cols)
    keyed = df.withColumns({"_h": hash_key(names, seed), "_one": F.lit(1).cast("bigint")}).withColumn(
        "_bucket", F.substring("_h", 1, digits)
    )
    buckets = keyed.groupBy(*groups, "_bucket").agg(F.sum("_one").alias("_one"))
    row_order = [F.col("_h"), *[F.col(n) for n in names]]
    ranked = _accumulate(keyed, buckets, groups, F.col("_bucket").asc(), row_order, ["_one"])
    return ranked.select(*df.columns, (F.col("cum__one") - 1).alias(name))


def exact_quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    group_cols: Sequence[str] = (),
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Linear-interpolation quantiles per group, one output column per name.

    Values are counted before they are ordered; NULL and NaN are ignored.
    """
    groups = list(group_cols)
    counted = (
        df.select(*groups, F.col(value).cast("double").alias("_value"))
        .where(F.col("_value").isNotNull() & ~F.isnan("_value"))
        .groupBy(*groups, "_value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = running_totals(counted, "_value", ["n"], groups, rows_per_bucket=rows_per_bucket)
    position = {name: (F.col("all_n") - 1) * F.lit(float(q)) for name, q in probabilities.items()}
    picks = []
    for name, at in position.items():
        picks.append(F.min(F.when(F.col("cum_n") > F.floor(at), F.col("_value"))).alias(f"{name}_lo"))
        picks.append(F.min(F.when(F.col("cum_n") > F.ceil(at), F.col("_value"))).alias(f"{name}_hi"))
        picks.append(F.max(at - F.floor(at)).alias(f"{name}_t"))
    picked = ordered.groupBy(*groups).agg(*picks) if groups else ordered.agg(*picks)
    return picked.select(
        *groups,
        *[
            (F.col(f"{n}_lo") + (F.col(f"{n}_hi") - F.col(f"{n}_lo")) * F.col(f"{n}_t")).alias(n)
            for n in probabilities
        ],
    )


def exact_medians(
    df: DataFrame,
    columns: Sequence[str],
    accuracy: int = 10_000,
    rows_per_bucket: int | None = None,
) -> dict[str, float | None]:
    """Exact interpolated median of every column; None for a column without values.

    Three scans and no full sort: mergeable sketches first bracket the middle
    ranks of all columns, one aggregate row counts what lies below each
    bracket, and only values inside a bracket are emitted and counted. A
    bracket that misses its rank (the sketch bound failed) is redone over the
    whole range.
    """
    columns = list(columns)
    if not columns:
        return {}
    margin = min(0.05, 2.0 / accuracy)
    values = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    clean = values.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in columns])
    sketches = clean.agg(
        *[F.count(c).alias(f"n{i}") for i, c in enumerate(columns)],
        *[
            F.percentile_approx(
                c, F.array(F.lit(0.5 - margin), F.lit(0.5 + margin)), F.lit(accuracy)
            ).alias(f"b{i}")
            for i, c in enumerate(columns)
        ],
    ).first()
    counts = {c: sketches[f"n{i}"] for i, c in enumerate(columns)}
    brackets = {c: tuple(sketches[f"b{i}"]) for i, c in enumerate(columns) if counts[c]}
    medians: dict[str, float | None] = {c: None for c in columns}

    def resolve(bounds: dict[str, tuple[float, float]]) -> dict[str, float | None]:
        below = clean.agg(
            *[F.count_if(F.col(c) < lo).alias(c) for c, (lo, _) in bounds.items()]
        ).first().asDict()
        within = {c: F.col(c).between(lo, hi) for c, (lo, hi) in bounds.items()}
        entries = F.array(
            *[
                F.when(hit, F.struct(F.lit(c).alias("column"), F.col(c).alias("value")))
                for c, hit in within.items()
            ]
        )
        counted = (
            clean.where(reduce(lambda a, b: a | b, within.values()))
            .select(F.explode(F.filter(entries, lambda e: e.isNotNull())).alias("e"))
            .groupBy("e.column", "e.value")
            .agg(F.count(F.lit(1)).alias("n"))
        )
        inside = running_totals(
            counted, "value", ["n"], ["column"], rows_per_bucket=rows_per_bucket
        )
        lower = upper = F.lit(None).cast("bigint")
        for c in bounds:
            lower = F.when(F.col("column") == c, F.lit((counts[c] - 1) // 2 - below[c])).otherwise(lower)
            upper = F.when(F.col("column") == c, F.lit(counts[c] // 2 - below[c])).otherwise(upper)
        rows = (
            inside.withColumn("lower", lower)
            .withColumn("upper", upper)
            .groupBy("column")
            .agg(
                F.min("lower").alias("lower"),
                F.min(F.when(F.col("cum_n") > F.col("lower"), F.col("value"))).alias("lo"),
                F.min(F.when(F.col("cum_n") > F.col("upper"), F.col("value"))).alias("hi"),
            )
            .collect()
        )
        found = {}
        for r in rows:
            reached = r["lower"] >= 0 and r["lo"] is not None and r["hi"] is not None
            found[r["column"]] = (r["lo"] + r["hi"]) / 2 if reached else None
        return found

    if brackets:
        medians.update(resolve(brackets))
        missed = {c: (float("-inf"), float("inf")) for c in brackets if medians[c] is None}
        if missed:
            medians.update(resolve(missed))
    return medians
