"""Best-fit packing of documents into sequences of several permitted lengths.

Pieces are placed in decreasing length, each into the open bin that it fills best. If
none has room, a bin is opened whose length costs least for each token it can be
expected to hold: its piece, and then each time the longest of the pieces still to come
that fits, so a length into which they go badly is not opened. In the end every bin is cut
down to the smallest permitted length that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CAPACITIES = (512, 1024, 2048, 4096)
BIN_COST = 32
SHARD_ROWS = 50_000


def word_count(text: Column) -> Column:
    """Words of a text and one end mark."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long") + 1


def expected_fill(room: int, at: int, negated: Sequence[int]) -> int:
    """What a room is filled with by the longest piece that fits, from place ``at`` on, again
    and again. ``negated`` are the lengths in decreasing order, below zero."""
    filled = 0
    while room > filled:
        at = bisect_left(negated, filled - room, at)
        if at == len(negated) or negated[at] == 0:
            break
        length = -negated[at]
        # As many of this length as there are and fit are taken at once.
        count = min(bisect_left(negated, 1 - length, at) - at, (room - filled) // length)
        filled += count * length
        at += count
    return filled


def pack_lengths(lengths: Sequence[int], capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST):
    """Bin and place of each piece, and each bin's final capacity.

    ``lengths`` must be in decreasing order and none above the largest capacity.
    """
    sizes = sorted(capacities)
    negated = [-n for n in lengths]
    free: list[list[int]] = [[] for _ in range(sizes[-1] + 1)]
    open_rooms, used, bins, places = 0, [], [], []
    for i, length in enumerate(lengths):
        fitting = open_rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1
            at = free[room].pop()
            if not free[room]:
                open_rooms &= ~(1 << room)
        else:
            size = min(
                (c for c in sizes if c >= length),
                key=lambda c: ((c + bin_cost) / max(1, length + expected_fill(c - length, i + 1, negated)), c),
            )
            at, room = len(used), size
            used.append(0)
        bins.append(at)
        places.append(used[at])
        used[at] += length
        free[room - length].append(at)
        open_rooms |= 1 << (room - length)
    return bins, places, [next(c for c in sizes if c >= u) for u in used]


def pieces(lengths: DataFrame, id_col: str, length_col: str, largest: int) -> DataFrame:
    """Rows longer than the largest capacity cut into full pieces and a rest."""
    length = F.greatest(F.coalesce(F.col(length_col), F.lit(0)).cast("long"), F.lit(0).cast("long"))
    count = F.greatest(F.ceil(length / largest), F.lit(1))
    return (
        lengths.select(F.col(id_col), length.alias("__length"), count.alias("__count"))
        .select(id_col, "__length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__count") - 1)).alias("piece"))
        .select(
            id_col,
            "piece",
            (F.col("piece") * largest).alias("start"),
            F.least(F.col("__length") - F.col("piece") * largest, F.lit(largest)).cast("int").alias("length"),
        )
    )


def pack(lengths: DataFrame, id_col: str = "doc_id", length_col: str = "length", capacities: Sequence[int] = CAPACITIES, bin_cost: int = BIN_COST, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per piece: id, piece, start, length, bin_id, place, capacity.

    Pieces are dealt by a hash to shards of about ``shard_rows`` which are packed on
    their own; their number follows the number of pieces. NULL or negative lengths
    count as 0 and take no room, but their rows are placed too; repeated rows (and NULL
    ids) are counted, numbered and placed one by one, in any shard; an empty table gives
    no rows; other columns are ignored.
    """
    cut = pieces(lengths, id_col, length_col, max(capacities))
    shards = max(1, -(-cut.count() // shard_rows))
    numbered = cut.groupBy(*cut.columns).agg(F.count("*").alias("__times"))
    copies = numbered.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__times"))))
    shard = F.pmod(F.xxhash64(F.col(id_col), "piece", "length", "__copy"), F.lit(shards)).cast("int")
    dealt = copies.select(*cut.columns, shard.alias("__shard"))
    names = [f.name for f in cut.schema.fields]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        shard = int(group["__shard"].iloc[0])
        ordered = group.sort_values(["length", id_col, "piece"], ascending=[False, True, True], kind="stable")
        bins, places, final = pack_lengths(ordered["length"].tolist(), capacities, bin_cost)
        bins = np.array(bins, np.int64)
        return ordered[names].assign(
            bin_id=shard * (1 << 32) + bins, place=np.array(places, np.int64), capacity=np.array(final, np.int64)[bins]
        )

    further = [T.StructField(n, T.LongType()) for n in ("bin_id", "place", "capacity")]
    return dealt.groupBy("__shard").applyInPandas(run, T.StructType([*cut.schema.fields, *further]))


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Documents packed by their number of words and one end mark each.

    NULL and empty texts are the end mark alone; very long ones are cut into pieces of the
    largest capacity; repeated rows are packed one by one; other columns are ignored.
    """
    return pack(docs.select(F.col(id_col), word_count(F.col(text_col)).alias("__words")), id_col, "__words", capacities)
