"""Profiles: counts, ranges, distributions, shares, inventories."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.operators.joins import broadcast_if_small, members_only, union_all
from stayrate.operators.ordering import exact_quantiles
from stayrate.session import stage


def row_profile(df: DataFrame, id_col: str) -> DataFrame:
    """One row: rows, distinct ids, rows without id (exact)."""
    per_id = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.count(id_col).alias("distinct_ids"),
        F.coalesce(F.sum(F.when(F.col(id_col).isNull(), F.col("n"))), F.lit(0)).alias("null_ids"),
    )


def approximate_distinct(df: DataFrame, columns: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """Approximate distinct counts of many columns in one scan; profiling only."""
    return df.agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in columns])


def ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with ``min_<c>`` and ``max_<c>`` per column."""
    return df.agg(
        *[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))]
    )


def distribution(df: DataFrame, columns: Sequence[str], name: str = "records") -> DataFrame:
    """Rows per value combination; NULL is a group of its own."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias(name))


def share_of_total(df: DataFrame, columns: Sequence[str], name: str = "records", digits: int = 2) -> DataFrame:
    """Distribution with each group's percentage of all rows.

    The total is a scalar subquery over the groups, not a window without
    partition, so the groups never meet in one task.
    """
    counted = distribution(df, columns, name)
    total = counted.agg(F.sum(name)).scalar()
    share = F.round(F.lit(100.0) * F.col(name) / total, digits).cast("double")
    return counted.withColumn("percentage", share)


def top_values(df: DataFrame, column: str, k: int = 20, name: str = "records") -> DataFrame:
    """The ``k`` most frequent values; equal counts in value order, NULL last."""
    counted = distribution(df, [column], name)
    return counted.orderBy(F.col(name).desc(), F.col(column).asc_nulls_last()).limit(k)


def null_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column: type, missing count, missing percentage; one scan."""
    names = list(columns or df.columns)
    types = dict(df.dtypes)
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in names],
    )
    long = counted.unpivot(["_rows"], names, "column_name", "missing")
    type_of = F.create_map(*[F.lit(x) for c in names for x in (c, types[c])])
    return long.select(
        "column_name",
        type_of[F.col("column_name")].alias("column_type"),
        "missing",
        F.round(F.lit(100.0) * F.col("missing") / F.nullif("_rows", F.lit(0)), 2).alias("missing_pct"),
    )


def table_inventory(tables: Mapping[str, DataFrame], id_cols: Mapping[str, str]) -> DataFrame:
    """One row per table: rows, columns, distinct ids (NULL without an id column)."""
    parts = []
    for name, table in tables.items():
        id_col = id_cols.get(name)
        if id_col:
            counted = row_profile(table, id_col).select("rows", "distinct_ids")
        else:
            counted = table.agg(
                F.count(F.lit(1)).alias("rows"), F.max(F.lit(None).cast("bigint")).alias("distinct_ids")
            )
        parts.append(
            counted.select(
                F.lit(name).alias("table_name"),
                "rows",
                F.lit(len(table.columns)).alias("columns"),
                "distinct_ids",
            )
        )
    return union_all(parts)


def duplicate_profile(df: DataFrame, keys: Sequence[str], id_col: str | None = None) -> DataFrame:
    """One row: rows, repeated full rows, repeated keys, rows without id.

    Full rows are counted first, then rolled up to keys; each step is a plain
    aggregation, where two DISTINCT counts would double the rows.
    """
    full = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    no_id = F.when(F.col(id_col).isNull(), F.col("_n")).otherwise(0) if id_col else F.lit(0)
    per_key = full.groupBy(*keys).agg(
        F.sum("_n").alias("_rows"),
        F.count(F.lit(1)).alias("_distinct"),
        F.sum(no_id.cast("bigint")).alias("_no_id"),
    )
    return per_key.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_distinct")), F.lit(0)).alias("duplicate_rows"),
        F.coalesce(F.sum(F.col("_rows") - 1), F.lit(0)).alias("duplicate_keys"),
        F.coalesce(F.sum("_no_id"), F.lit(0)).alias("missing_ids"),
    )


def date_quality(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per date column: parsed rows, total rows, earliest, latest."""
    parts = df.agg(
        F.count(F.lit(1)).alias("total"),
        *[
            F.struct(
                F.count(c).alias("parsed"),
                F.min(c).cast("timestamp_ntz").alias("earliest"),
                F.max(c).cast("timestamp_ntz").alias("latest"),
            ).alias(c)
            for c in columns
        ],
    )
    rows = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("s")) for c in columns]
    )
    exploded = parts.select("total", F.explode(rows).alias("r"))
    return exploded.select(
        "r.column_name", "r.s.parsed", "total", "r.s.earliest", "r.s.latest"
    )


def crosstab(
    df: DataFrame, row: str, column: str, values: Sequence, missing: str = "missing", other: str = "other"
) -> DataFrame:
    """Counts of ``row`` by ``column`` with NULL kept as a category on both axes.

    ``values`` names the column categories, so no extra scan finds them; what they
    do not name is counted in ``other``. The names of the NULL and the other column
    may not be among them.
    """
    names = [str(v) for v in values]
    if {missing, other} & set(names):
        raise ValueError(f"{missing} and {other} name the NULL and the unlisted values")
    cell = F.col(column).cast("string")
    cells = {v: cell == v for v in names}
    cells[missing] = cell.isNull()
    cells[other] = cell.isNotNull() & ~cell.isin(names)
    counted = df.groupBy(F.col(row).cast("string").alias(row)).agg(*[F.count_if(c).alias(n) for n, c in cells.items()])
    return counted.withColumn(row, F.coalesce(F.col(row), F.lit(missing)))


def monthly_counts(sources: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Records per source and calendar month; rows without a date are left out."""
    parts = [
        df.where(F.col(ts).isNotNull())
        .groupBy(F.to_date(F.trunc(ts, "month")).alias("month"))
        .agg(F.count(F.lit(1)).alias("records"))
        .select(F.lit(name).alias("source"), "month", "records")
        for name, (df, ts) in sources.items()
    ]
    return union_all(parts)


def box_summary(
    df: DataFrame, value: str, group: str, rows_per_bucket: int | None = None
) -> DataFrame:
    """Per group: quartiles, median and the whisker ends within 1.5 IQR."""
    quartiles = stage(
        exact_quantiles(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [group], rows_per_bucket),
        "quartiles",
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    fences = quartiles.select(
        F.col(group).alias("_g"), "q1", "median", "q3",
        (F.col("q1") - reach).alias("_low"), (F.col("q3") + reach).alias("_high"),
    )
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    # A few groups as a rule: then each row finds its fences without a shuffle.
    matched = rows.join(broadcast_if_small(fences), F.col(group).eqNullSafe(F.col("_g")))
    inside = matched.groupBy(group, "q1", "median", "q3")
    within = F.col(value).between(F.col("_low"), F.col("_high"))
    return inside.agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.when(within, F.col(value))).alias("whisker_low"),
        F.max(F.when(within, F.col(value))).alias("whisker_high"),
    )


def counters(df: DataFrame, conditions: Mapping[str, Column]) -> DataFrame:
    """Per named condition: how many rows meet it, as report rows."""
    counted = df.agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])
    return counted.unpivot([], list(conditions), "check_name", "rows_found")


def label_timeline(
    cohort: DataFrame, facts: DataFrame, key: str, label: str, when: str, expiry: str
) -> DataFrame:
    """Per label: entities with facts and the span of their last dates.

    Facts are reduced to one row per entity before the join.
    """
    per_entity = facts.groupBy(key).agg(
        F.max(when).alias("last_when"), F.max(expiry).alias("last_expiry")
    )
    return (
        cohort.join(per_entity, key, "inner")
        .groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.min("last_when").alias("min_last_when"),
            F.max("last_when").alias("max_last_when"),
            F.min("last_expiry").alias("min_last_expiry"),
            F.max("last_expiry").alias("max_last_expiry"),
        )
    )


def entity_timeline(cohort: DataFrame, facts: DataFrame, key: str, when: str, expiry: str) -> DataFrame:
    """Per entity with facts: first and last dates and the number of facts."""
    per_entity = facts.groupBy(key).agg(
        F.min(when).alias("first_when"),
        F.max(when).alias("last_when"),
        F.min(expiry).alias("first_expiry"),
        F.max(expiry).alias("last_expiry"),
        F.count(F.lit(1)).alias("facts"),
    )
    return cohort.join(per_entity, key, "inner")


def last_valid(facts: DataFrame, key: str, expiry: str, earliest) -> DataFrame:
    """Per entity the latest value not below ``earliest``."""
    return (
        facts.where(F.col(expiry) >= earliest)
        .groupBy(key)
        .agg(F.max(expiry).alias("last_valid"))
    )


def label_last_valid(cohort: DataFrame, facts: DataFrame, key: str, label: str, expiry: str, earliest) -> DataFrame:
    """Per label: entities with a valid date and the span of their last one."""
    joined = cohort.join(last_valid(facts, key, expiry, earliest), key, "inner")
    return joined.groupBy(label).agg(
        F.count(F.lit(1)).alias("entities"),
        F.min("last_valid").alias("min_last_valid"),
        F.max("last_valid").alias("max_last_valid"),
    )


def last_valid_distribution(cohort: DataFrame, facts: DataFrame, key: str, expiry: str, earliest) -> DataFrame:
    """Entities per last valid date."""
    joined = cohort.join(last_valid(facts, key, expiry, earliest), key, "inner")
    return distribution(joined, ["last_valid"], "entities")


def labels_of_members(cohort: DataFrame, facts: DataFrame, key: str, label: str, condition: Column) -> DataFrame:
    """Label counts of the entities with at least one fact meeting the condition."""
    hit = facts.where(condition)
    return distribution(members_only(cohort, hit, key), [label], "entities")


def anomaly_report(
    facts: DataFrame, cohort: DataFrame, key: str, condition: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Anomalous records, their entities and how many of those are labelled.

    Records are counted per entity before the join, so the join carries one
    row per entity (and ``by`` value), and no DISTINCT is needed after it.
    """
    per_entity = facts.where(condition).groupBy(*by, key).agg(F.count(F.lit(1)).alias("_n"))
    labelled = cohort.select(F.col(key).alias("_id")).distinct()
    joined = per_entity.join(labelled, F.col(key) == F.col("_id"), "left")
    summary = [
        F.coalesce(F.sum("_n"), F.lit(0)).alias("records"),
        F.count(key).alias("entities"),
        F.count("_id").alias("labelled_entities"),
    ]
    return joined.groupBy(*by).agg(*summary) if by else joined.agg(*summary)


def expiry_quality(facts: DataFrame, expiry: str, earliest) -> DataFrame:
    """One row: records, records below ``earliest``, smallest and largest value."""
    return facts.agg(
        F.count(F.lit(1)).alias("records"),
        F.coalesce(F.sum(F.when(F.col(expiry) < earliest, 1).otherwise(0)), F.lit(0)).alias("suspicious"),
        F.min(expiry).alias("min_value"),
        F.max(expiry).alias("max_value"),
    )


def sample_rows(df: DataFrame, n: int) -> DataFrame:
    """Any ``n`` rows."""
    return df.limit(n)
