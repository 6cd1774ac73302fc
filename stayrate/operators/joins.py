"""Join shapes: enrichment, membership, set comparison, alignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stayrate.functions.cleaning import is_observed
from stayrate.operators.quality import Watch, one_per_key, require_unique_key
from stayrate.session import stage_checked


def left_one_to_one(left: DataFrame, right: DataFrame, key: str | Sequence[str], subject: str) -> DataFrame:
    """LEFT JOIN after checking the key is unique on both sides."""
    keys = [key] if isinstance(key, str) else list(key)
    require_unique_key(left, keys, f"{subject} (left)")
    require_unique_key(right, keys, f"{subject} (right)")
    return left.join(right, keys, "left")


def inner_all(tables: Sequence[DataFrame], key: str) -> DataFrame:
    """Inner join of feature groups on one key: each is exchanged once, on that key."""
    result = tables[0]
    for table in tables[1:]:
        result = result.join(table, key, "inner")
    return result


# Keys of at most this many rows are broadcast; their number is counted first.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS, rows: int | None = None) -> DataFrame:
    """Broadcast hint when the table has at most ``limit`` rows, else the table as it is.

    ``rows`` saves the count when it is already known.
    """
    size = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if size <= limit else df


def members_only(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key occurs in ``keys``.

    The keys are made distinct first: a key that repeats millions of times is
    combined before its shuffle, which the semi-join then reuses.
    """
    return df.join(keys.select(key).distinct(), key, "left_semi")


def non_members(df: DataFrame, keys: DataFrame, key: str | Sequence[str]) -> DataFrame:
    """Rows whose key does not occur in ``keys``; a NULL key is kept."""
    names = [key] if isinstance(key, str) else list(key)
    return df.join(keys.select(*names).distinct(), names, "left_anti")


def drop_outsiders(
    df: DataFrame, keys: DataFrame, key: str, rows: int | None = None, limit: int = BROADCAST_ROWS
) -> DataFrame:
    """Drop rows of other entities early, where that costs no shuffle.

    For fact tables about to be aggregated and left-joined to ``keys``: the
    result is the same either way. A small key set is broadcast into the
    scan; for a large one the facts stay as they are, because shuffling raw
    facts by a skewed key costs more than combining them first.
    """
    size = keys.limit(limit + 1).count() if rows is None else rows
    if size > limit:
        return df
    return df.join(F.broadcast(keys.select(key)), key, "left_semi")


def membership_flag(df: DataFrame, keys: DataFrame, key: str | Sequence[str], name: str) -> DataFrame:
    """0/1 column: does the row's key occur in ``keys``."""
    names = [key] if isinstance(key, str) else list(key)
    marked = keys.select(*names).distinct().withColumn("_hit", F.lit(1))
    joined = df.join(marked, names, "left")
    return joined.withColumn(name, is_observed("_hit")).drop("_hit")


def hot_keys(df: DataFrame, key: str, share: float = 0.001, min_rows: int = 100_000) -> DataFrame:
    """Keys holding more than ``share`` of all rows: at most ``1 / share`` of them."""
    counted = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = counted.agg(F.sum("_n")).scalar()
    return counted.where((F.col("_n") > share * total) & (F.col("_n") > min_rows)).select(key)


def salted_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    salts: int = 32,
    share: float = 0.001,
    min_rows: int = 100_000,
) -> DataFrame:
    """Inner join where the frequent keys of ``left`` are spread over ``salts`` tasks.

    Rows of a hot key take a salt from their content; the right row of that
    key is repeated once per salt. All other keys join as they are. The hot
    keys are broadcast: there are at most ``1 / share``.
    """
    hot = F.broadcast(hot_keys(left, key, share, min_rows).withColumn("_hot", F.lit(True)))
    # A hash of the row, not a random number: a recomputed task gives the same salt.
    spread = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), F.lit(salts)).cast("int")
    salted = left.join(hot, key, "left").withColumn(
        "_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))
    )
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    repeated = right.join(hot, key, "left").withColumn("_salt", F.explode(copies))
    return salted.drop("_hot").join(repeated.drop("_hot"), [key, "_salt"]).drop("_salt")


def orphan_count(df: DataFrame, key: str, reference: DataFrame, reference_key: str) -> DataFrame:
    """One row: rows and distinct keys of ``df`` that ``reference`` does not hold.

    Missing keys count as unmatched rows but not as keys.
    """
    per_key = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n"))
    known = reference.select(F.col(reference_key).alias("_key")).distinct()
    missing = per_key.join(known, "_key", "left_anti")
    return missing.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("unmatched_rows"),
        F.count("_key").alias("unmatched_keys"),
    )


def keys_without(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct non-null keys of ``left`` absent from ``right``."""
    present = left.select(key).where(F.col(key).isNotNull()).distinct()
    return present.join(right.select(key).distinct(), key, "left_anti")


def key_union(frames: Sequence[DataFrame]) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result.distinct()


def key_overlap(df: DataFrame, key: str, part: str, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Number of keys two partitions share, per pair.

    One aggregation marks the partitions each key occurs in; the pairs are
    counted from the marks, so no pairwise intersections are needed.
    """
    names = sorted({p for pair in pairs for p in pair})
    marks = df.groupBy(key).agg(
        *[F.max(F.when(F.col(part) == n, 1).otherwise(0)).alias(f"in_{i}") for i, n in enumerate(names)]
    )
    position = {n: i for i, n in enumerate(names)}
    counted = marks.where(F.col(key).isNotNull()).agg(
        *[
            F.count_if((F.col(f"in_{position[a]}") == 1) & (F.col(f"in_{position[b]}") == 1)).alias(f"{a}|{b}")
            for a, b in pairs
        ]
    )
    long = counted.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "shared")
    return long.select(
        F.split_part("pair", F.lit("|"), F.lit(1)).alias("left_part"),
        F.split_part("pair", F.lit("|"), F.lit(2)).alias("right_part"),
        "shared",
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def drop_exact_duplicates(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def coverage(population: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys, how many have facts, and the percentage."""
    keys = population.select(key).distinct()
    marked = membership_flag(keys, facts, key, "covered")
    return marked.agg(
        F.count(F.lit(1)).alias("entities"),
        F.coalesce(F.sum("covered"), F.lit(0)).alias("with_facts"),
    ).select(
        "entities",
        "with_facts",
        (F.col("entities") - F.col("with_facts")).alias("without_facts"),
        F.round(F.lit(100.0) * F.col("with_facts") / F.nullif("entities", F.lit(0)), 2).alias("pct_with_facts"),
    )


def label_disagreements(tables: Sequence[DataFrame], key: str, label: str) -> DataFrame:
    """One row: joined rows whose label differs from the first source's or is missing."""
    renamed = [t.select(key, F.col(label).alias(f"_l{i}")) for i, t in enumerate(tables)]
    joined = inner_all(renamed, key)
    bad: Column = F.lit(False)
    for i in range(1, len(tables)):
        bad = bad | (F.col("_l0") != F.col(f"_l{i}"))
    for i in range(len(tables)):
        bad = bad | F.col(f"_l{i}").isNull()
    return joined.agg(F.count_if(bad).alias("disagreements"))


def align_scored(left: DataFrame, right: DataFrame, subject: str = "scored sets") -> DataFrame:
    """Two scored sets side by side: ``(id, y, p_a, yhat_a, p_b, yhat_b)``.

    Full outer join with a side check: both sets must hold the same ids, once
    each, with the same actual labels. Each side is combined by id before the join, which
    needs it dealt by id anyway, and all rules are counted by the job that stores the join.
    """
    a = left.select(
        "id",
        F.col("actual").alias("y"),
        F.col("probability").alias("p_a"),
        F.col("prediction").alias("yhat_a"),
    )
    b = right.select(
        "id",
        F.col("actual").alias("_y_b"),
        F.col("probability").alias("p_b"),
        F.col("prediction").alias("yhat_b"),
    )
    joined = one_per_key(a, ["id"], times="_n_a").join(one_per_key(b, ["id"], times="_n_b"), "id", "full")
    rules = {
        "missing_keys": F.col("id").isNull(),
        "repeated_first": F.col("_n_a") > 1,
        "repeated_second": F.col("_n_b") > 1,
        "only_first": F.col("_n_b").isNull(),
        "only_second": F.col("_n_a").isNull(),
        "labels_missing": F.col("y").isNull() | F.col("_y_b").isNull(),
        "labels_differ": F.col("y") != F.col("_y_b"),
    }
    watch = Watch(subject, rules, allow_empty=False)
    return stage_checked(watch.over(joined).select("id", "y", "p_a", "yhat_a", "p_b", "yhat_b"), "aligned", watch.check)
