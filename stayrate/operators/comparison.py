"""Two scored sets side by side: differences and resampled intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stayrate.operators.draws import (
    PACKED,
    PACKED_SCHEMA,
    RANGE,
    SCORE_SCHEMA,
    SCORED,
    SLOTS,
    UNIT,
    WIDTH,
    add_up_weights,
    count_draws,
    pack_ranges,
    poisson_steps,
)
from stayrate.operators.joins import salted_join
from stayrate.operators.metrics import evaluate, gated, ratio_or_zero
from stayrate.operators.ordering import hash_rank, running_totals
from stayrate.operators.quality import require_both_classes
from stayrate.session import spread, stage

METRICS = (
    "average_precision",
    "roc_auc",
    "precision",
    "recall",
    "f1",
    "balanced_accuracy",
    "log_loss",
)
BOOTSTRAP_METRICS = ("average_precision", "roc_auc", "f1")
MIN_REPLICATES = 100
MIN_CLUSTERS = 10
# Blocks of replicates for which a range of rows is sent once.
PART_BLOCKS = 8
# Units of weights (some blocks of replicates for a range) in a task.
UNITS = 16
# Slots of a block whose draws a task holds, 32 bytes each, and tasks for a core.
TASK_SLOTS = 1 << 21
CORE_TASKS = 4
# Ranges of packed rows in a file.
FILE_RANGES = 8


def stack_models(pair: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per (row, model) with the model's score and class."""
    models = F.array(
        F.struct(F.lit("a").alias("model"), F.col("p_a").alias("p"), F.col("yhat_a").alias("yhat")),
        F.struct(F.lit("b").alias("model"), F.col("p_b").alias("p"), F.col("yhat_b").alias("yhat")),
    )
    return pair.select(*keep, "y", F.inline(models))


def model_comparison(pair: DataFrame, rows_per_bucket: int | None = None) -> DataFrame:
    """``(metric, model_a, model_b, difference)`` for every metric; difference is b - a."""
    measured = evaluate(stack_models(pair), ["model"], rows_per_bucket=rows_per_bucket)
    long = measured.unpivot(["model"], list(METRICS), "metric", "value")
    return (
        long.groupBy("metric")
        .agg(
            F.max(F.when(F.col("model") == "a", F.col("value"))).alias("model_a"),
            F.max(F.when(F.col("model") == "b", F.col("value"))).alias("model_b"),
        )
        .withColumn("difference", F.col("model_b") - F.col("model_a"))
    )


def drawn_index(replicate: Column, stratum: Column, slot: Column, seed: int, size: Column) -> Column:
    """Seeded uniform draw from ``0 .. size - 1`` for one slot of one replicate."""
    text = F.concat_ws("|", replicate.cast("string"), stratum.cast("string"), slot.cast("string"), F.lit(str(seed)))
    # 13 hex digits are 52 bits, so the modulo is uniform to 1 in 2**52 / size.
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") % size


def _slots() -> list[str]:
    return [f"w{j}" for j in range(WIDTH)]


def weighted_scores(pair: DataFrame, size: int, replicates: int, seed: int) -> DataFrame:
    """Weights added up by score: block, model, p, y, yhat, w0, w1, ...

    Replicate ``block * WIDTH + j + 1`` has the weights ``wj``. No draw is exchanged. A score
    may come in several rows, one per range of rows it is in, however many tasks there are:
    a unit of work is a range and some blocks, and the rows of a range are sent to each.
    """
    conf, parallel = pair.sparkSession.conf, pair.sparkSession.sparkContext.defaultParallelism
    ranges, parts = -(-size // RANGE), -(-replicates // (WIDTH * PART_BLOCKS))
    tail = F.concat_ws("|", F.col("id").cast("string"), F.lit(str(seed)))
    # With the scores, so that rows without an id are dealt as well.
    rows = pair.select(tail.alias("tail"), *SCORED, F.pmod(F.xxhash64(tail, *SCORED), F.lit(ranges)).cast("int").alias("range"))
    units = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    tasks = min(ranges * parts, max(int(conf.get("spark.sql.shuffle.partitions")), parallel, ranges * parts // UNITS))
    task = ((F.col("range").cast("long") * parts + F.col("part")) % tasks).cast("int")
    dealt = units.repartitionById(tasks, task).sortWithinPartitions("range", "part")
    return dealt.mapInArrow(add_up_weights(replicates, PART_BLOCKS), SCORE_SCHEMA)


def draw_units(spark: SparkSession, sizes: dict[int, int], blocks: int) -> DataFrame:
    """Draws by task: the slots from ``first`` to ``stop`` of class y, in the blocks of replicates
    from ``block`` to ``until``.

    A whole class for some blocks if it is small enough, else some slots for one block; less if
    there would be few tasks.
    """
    tasks, units = CORE_TASKS * spark.sparkContext.defaultParallelism, []
    most = min(TASK_SLOTS, -(-sum(sizes.values()) * blocks // tasks))
    for y, size in sizes.items():
        slots = -(-size // -(-size // most) // SLOTS) * SLOTS
        groups = -(-blocks // max(1, most // size))
        group, n = -(-blocks // groups), groups * -(-size // slots)
        first, block = F.floor(F.col("id") / groups) * slots, F.col("id") % groups * group
        ends = F.least(first + slots, F.lit(size)).alias("stop"), F.least(block + group, F.lit(blocks)).alias("until")
        units.append(spark.range(0, n, 1, n).select(F.lit(y).alias("y"), first.alias("first"), block.alias("block"), *ends))
    return reduce(DataFrame.unionByName, units)


def drawn_scores(pair: DataFrame, sizes: dict[int, int], replicates: int, seed: int) -> DataFrame:
    """The same form from draws: each class is resampled to its own size.

    Rows get dense indexes in hash order; every row stands for one slot per replicate, whose
    draw points at an index. Rows are packed by range of indexes, a few bytes each. A task makes
    the draws of some slots for some replicates, then reads the ranges of the class one by
    one and counts its draws there; only sums by score leave it. No draw is exchanged or stored,
    and what a task holds does not depend on the size of a class.
    """
    spark = pair.sparkSession
    kind, blocks, (one, other) = pair.schema["y"].dataType, -(-replicates // WIDTH), sizes
    labels = spark.range(1).select(*[F.lit(y).cast(kind).cast("string").alias(str(y)) for y in sizes]).first().asDict()
    ranges = {y: -(-size // RANGE) for y, size in sizes.items()}
    indexed = hash_rank(pair, "id", seed, ["y"], name="idx").select(
        F.col("y").cast("int").alias("y"), F.floor(F.col("idx") / RANGE).alias("range"), "idx", *SCORED[1:]
    )
    # Few files, as each task opens all.
    file = (F.col("range") + F.when(F.col("y") == other, ranges[one]).otherwise(0)) / FILE_RANGES
    dealt = indexed.repartitionById(-(-sum(ranges.values()) // FILE_RANGES), F.floor(file).cast("int"))
    packed = stage(dealt.sortWithinPartitions("y", "range").mapInArrow(pack_ranges, PACKED_SCHEMA), "bootstrap-rows")
    # Each task reads the packed rows by itself, so that they are not sent to it.
    met = packed.coalesce(1).hint("shuffle_replicate_nl").join(draw_units(spark, sizes, blocks), "y")
    counted = count_draws(sizes, {int(y): text for y, text in labels.items()}, replicates, seed)
    return met.select("y", "range", *PACKED, *UNIT).mapInArrow(counted, SCORE_SCHEMA)


def replicate_rankings(scores: DataFrame, keys: Sequence[str], replicates: int, rows_per_bucket: int | None = None) -> DataFrame:
    """Per (replicate, key): positives, negatives, average precision, ROC-AUC.

    ``scores`` has one row per (block, key, p) with the weight of positives and negatives in
    each replicate of the block: pos0, neg0, pos1, ... The scores are ordered once for a
    block, and the replicates are added up side by side.
    """
    groups = ["block", *keys]
    measures = [f"{m}{j}" for j in range(WIDTH) for m in ("pos", "neg")]
    curve = running_totals(scores, "p", measures, groups, descending=True, rows_per_bucket=rows_per_bucket)
    sums = []
    for j in range(WIDTH):
        pos, neg = F.col(f"pos{j}").cast("double"), F.col(f"neg{j}").cast("double")
        above, below = F.col(f"cum_pos{j}"), F.col(f"cum_neg{j}")
        precision = above / F.nullif((above + below).cast("double"), F.lit(0.0))
        sums += [
            F.max(f"all_pos{j}").alias(f"positives{j}"),
            F.max(f"all_neg{j}").alias(f"negatives{j}"),
            F.sum(pos * precision).alias(f"steps{j}"),
            F.sum(neg * (above - pos / 2)).alias(f"pairs{j}"),
        ]
    summed = curve.groupBy(*groups).agg(*sums)
    slots = F.array(
        *[
            F.struct(
                (F.col("block") * WIDTH + 1 + j).cast("int").alias("replicate"),
                *[F.col(f"{c}{j}").alias(c) for c in ("positives", "negatives", "steps", "pairs")],
            )
            for j in range(WIDTH)
        ]
    )
    positives, negatives = F.col("positives").cast("double"), F.col("negatives").cast("double")
    return (
        summed.select(*keys, F.inline(slots))
        .where(F.col("replicate") <= replicates)
        .select(
            "replicate",
            *keys,
            "positives",
            "negatives",
            F.coalesce(F.col("steps") / F.nullif(positives, F.lit(0.0)), F.lit(0.0)).alias("average_precision"),
            (F.col("pairs") / F.nullif(positives * negatives, F.lit(0.0))).alias("roc_auc"),
        )
    )


def _replicate_hits(stacked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per (replicate, key): F1 of the given classes."""
    hit, called = (F.col("y") == 1) & (F.col("yhat") == 1), F.col("yhat") == 1
    sums = []
    for j, name in enumerate(_slots()):
        for label, condition in (("tp", hit), ("called", called), ("actual", F.col("y") == 1)):
            sums.append(F.sum(F.when(condition, F.col(name)).otherwise(0)).alias(f"{label}{j}"))
    summed = stacked.groupBy("block", *keys).agg(*sums)
    slots = F.array(
        *[
            F.struct(
                (F.col("block") * WIDTH + 1 + j).cast("int").alias("replicate"),
                ratio_or_zero(F.lit(2.0) * F.col(f"tp{j}"), F.col(f"called{j}") + F.col(f"actual{j}")).alias("f1"),
            )
            for j in range(WIDTH)
        ]
    )
    return summed.select(*keys, F.inline(slots))


def paired_bootstrap_replicates(
    pair: DataFrame,
    replicates: int,
    seed: int = 42,
    rows_per_bucket: int | None = None,
    method: str = "draws",
) -> DataFrame:
    """Per replicate, b - a of each bootstrap metric.

    ``weights`` gives every row an independent Poisson(1) weight, which is how often
    a draw would take it in a large table; class sizes then vary from replicate to
    replicate. ``draws``: each class is resampled to its own size. Either way the weights
    of a block of replicates lie side by side, and rows collapse to one per (block, model,
    score) where they are weighted, before anything else is exchanged or ordered.
    """
    if method not in ("draws", "weights"):
        raise ValueError(f"unknown method: {method}")
    if replicates < MIN_REPLICATES:
        raise ValueError(f"use at least {MIN_REPLICATES} replicates")
    sizes = require_both_classes(pair, "y", "paired bootstrap")
    called = {c: F.coalesce(F.col(c) == 1, F.lit(False)).cast("int") for c in ("yhat_a", "yhat_b")}
    rows = gated(gated(pair.select("id", *SCORED), "y", "p_a"), "y", "p_b").withColumns(called)
    if method == "weights":
        weighted = weighted_scores(rows.withColumn("y", F.col("y").cast("int")), sum(sizes.values()), replicates, seed)
    else:
        weighted = drawn_scores(rows, sizes, replicates, seed)
    sums = [
        F.sum(F.when(F.col("y") == label, F.col(name)).otherwise(0)).alias(f"{kind}{j}")
        for j, name in enumerate(_slots())
        for kind, label in (("pos", 1), ("neg", 0))
    ]
    # Hits are counted with the scores, so that rows are weighted in one pass.
    combined = stage(weighted.groupBy("block", "model", "p", "y", "yhat").agg(*[F.sum(n).alias(n) for n in _slots()]), "replicate-scores")
    rankings = replicate_rankings(combined.groupBy("block", "model", "p").agg(*sums), ["model"], replicates, rows_per_bucket)
    measured = rankings.join(_replicate_hits(combined, ["model"]), ["replicate", "model"])
    return measured.groupBy("replicate").agg(
        *[
            F.sum(F.when(F.col("model") == "b", F.col(m)).otherwise(-F.col(m))).alias(m)
            for m in BOOTSTRAP_METRICS
        ]
    )


def percentile_interval(values: DataFrame, metrics: Sequence[str], level: float = 0.95) -> DataFrame:
    """Per metric: number, mean and percentile interval of the replicates.

    The input is one row per replicate, so the exact percentile is small.
    """
    tail = (1.0 - level) / 2
    long = values.unpivot([], list(metrics), "metric", "value")
    return long.groupBy("metric").agg(
        F.count("value").alias("replicates"),
        F.percentile("value", F.lit(tail)).alias("ci_lower"),
        F.percentile("value", F.lit(1.0 - tail)).alias("ci_upper"),
        F.avg("value").alias("mean_difference"),
    )


def paired_bootstrap(
    pair: DataFrame,
    replicates: int = 2000,
    seed: int = 42,
    rows_per_bucket: int | None = None,
    method: str = "draws",
) -> DataFrame:
    """Observed difference (b - a) and its 95 % percentile interval, per metric."""
    drawn = paired_bootstrap_replicates(pair, replicates, seed, rows_per_bucket, method)
    observed = model_comparison(pair, rows_per_bucket).select(
        "metric", F.col("difference").alias("observed_difference")
    )
    return percentile_interval(drawn, BOOTSTRAP_METRICS).join(observed, "metric")


def cluster_bootstrap_replicates(
    scored: DataFrame,
    cluster: str,
    replicates: int = 100,
    seed: int = 42,
    salts: int = 32,
    hot_rows: int = 100_000,
    rows_per_bucket: int | None = None,
) -> DataFrame:
    """Average precision per replicate, resampling whole clusters.

    A cluster's rows are first reduced to counts per score; a cluster still
    holding much of the table is then spread over ``salts`` tasks. The draws
    of a cluster travel as blocks of ``WIDTH`` weights side by side, so a row is read once
    per block. One-class replicates are left out.
    """
    rows = stage(
        scored.groupBy(cluster, F.col("p").cast("double").alias("p")).agg(
            F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg")
        ),
        "cluster-rows",
    )
    clusters = stage(
        hash_rank(rows.select(cluster).distinct(), cluster, seed, name="idx"), "clusters"
    )
    size = clusters.count()
    draws = spread(clusters.select("idx"), "idx").select(
        "idx", F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate")
    ).select(
        F.floor((F.col("replicate") - 1) / WIDTH).cast("int").alias("block"),
        ((F.col("replicate") - 1) % WIDTH).cast("int").alias("slot"),
        drawn_index(F.col("replicate"), F.lit("c"), F.col("idx"), seed, F.lit(size)).alias("idx"),
    )
    counted = spread(draws, "idx").groupBy("idx", "block").agg(
        *[F.count_if(F.col("slot") == j).alias(name) for j, name in enumerate(_slots())]
    )
    blocks = counted.groupBy("idx").agg(F.collect_list(F.struct("block", *_slots())).alias("weights"))
    drawn = clusters.join(blocks, "idx").select(cluster, "weights")
    # Skew is counted on the stored rows; only hot clusters are moved for it.
    joined = salted_join(rows, drawn, cluster, salts, min_rows=hot_rows)
    sampled = joined.select("p", "pos", "neg", F.inline("weights"))
    scores = sampled.groupBy("block", "p").agg(
        *[F.sum(F.col(kind) * F.col(name)).alias(f"{kind}{j}") for j, name in enumerate(_slots()) for kind in ("pos", "neg")]
    )
    measured = replicate_rankings(scores, [], replicates, rows_per_bucket)
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return measured.where(both).select("replicate", "average_precision")


def cluster_bootstrap(
    scored: DataFrame, cluster: str, replicates: int = 100, seed: int = 42
) -> DataFrame:
    """Mean and 95 % interval of average precision over resampled clusters.

    With fewer than ten clusters or one class there is no interval: 0 replicates.
    """
    row = (
        scored.groupBy(cluster)
        .agg(F.max("y").alias("hi"), F.min("y").alias("lo"))
        .agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
        .first()
    )
    if row["n"] < MIN_CLUSTERS or row["hi"] == row["lo"]:
        empty = scored.sparkSession.createDataFrame([], "average_precision double")
        interval = percentile_interval(empty, ["average_precision"])
    else:
        drawn = cluster_bootstrap_replicates(scored, cluster, replicates, seed)
        interval = percentile_interval(drawn, ["average_precision"])
    return interval.withColumnRenamed("mean_difference", "mean_value")
