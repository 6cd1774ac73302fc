"""SimHash near-duplicates by covering locality-sensitive hashing.

Every bit position gets one of the 2^(r+1) - 1 nonzero vectors of r + 1 bits; table
``v`` keeps the positions whose vector has an odd inner product with ``v``. The
positions in which two fingerprints differ, at most r, give r linear conditions on
r + 1 unknowns, so some nonzero ``v`` keeps none of them and the pair collides in
that table: no pair within the radius is missed (Pagh, "Locality-sensitive hashing
without false negatives", 2016).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.components import components
from stayrate.llm.words import text_bytes, words_of
from stayrate.session import stage

SEED = 42
BUCKET_ROWS = 20_000
CHUNK = 1 << 15


def fingerprint(data: bytes, shingle: int = 4) -> int:
    """64-bit SimHash of a UTF-8 text; 0 without words."""
    words = words_of(data)
    if not words:
        return 0
    text = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    starts, ends = starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        part = list(zip(starts[at : at + CHUNK], ends[at : at + CHUNK]))
        hashes = np.fromiter((digest(text[s:e], SEED) for s, e in part), np.dtype("<u8"), len(part))
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text_col: str, name: str = "__fp", shingle: int = 4) -> DataFrame:
    """``docs`` with a 64-bit fingerprint (as a signed long) in a further column."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = np.fromiter(
                (fingerprint(x, shingle) for x in text_bytes(batch.column(place))), np.uint64, batch.num_rows
            )
            columns = [*batch.columns, pa.array(marks.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def covering_masks(radius: int) -> list[int]:
    """One mask of kept bits for each of the 2^(radius+1) - 1 tables."""
    tables = 2 ** (radius + 1) - 1
    vectors = [1 + i % tables for i in range(64)]
    return [sum(((vectors[i] & v).bit_count() & 1) << i for i in range(64)) for v in range(1, tables + 1)]


def spanning_links(values: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of the values that differ in at most ``radius`` bits.

    A value is compared only with those not reached yet, so a dense group costs a
    few passes; never more than one link per value comes out.
    """
    rest, links = np.unique(values), []
    queue: list = []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        seed = queue.pop()
        near = np.bitwise_count(rest ^ seed) <= radius
        if near.any():
            found = rest[near]
            links += [(int(seed), int(x)) for x in found]
            queue += list(found)
            rest = rest[~near]
    return links


def near_links(values: DataFrame, radius: int = 4, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links (a, b) that connect all distinct ``fp`` within ``radius`` bits of each other.

    A bucket with more than ``bucket_rows`` values is cut into blocks, and each two
    blocks meet in a group of their own, so no group grows with the data.
    """
    masks = F.array(
        *[F.struct(F.lit(v).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("k")) for v, m in enumerate(covering_masks(radius))]
    )
    placed = values.select("fp", F.explode(masks).alias("m")).select("fp", "m.t", "m.k")
    large = stage(
        placed.groupBy("t", "k").agg(F.count("*").alias("n")).where(F.col("n") > bucket_rows), "large-buckets"
    )
    parts = F.coalesce(F.ceil(2 * F.col("n") / bucket_rows), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    spread = (
        placed.join(large, ["t", "k"], "left")
        .withColumn("parts", parts)
        .select("fp", "t", "k", own.alias("own"), other.alias("other"))
    )
    groups = (
        spread.groupBy("t", "k", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .agg(F.collect_list("fp").alias("fps"))
        .where(F.size("fps") > 1)
        .select("fps")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in batch.column(0):
                found += spanning_links(row.values.to_numpy(zero_copy_only=False).view(np.uint64), radius)
            links = np.array(sorted(set(found)), np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])

    return groups.mapInArrow(run, "a long, b long").distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def classes(marks: DataFrame, id_col: str, radius: int = 4, links: DataFrame | None = None) -> DataFrame:
    """Class of each distinct fingerprint: (fp, component_id, keep_fp).

    ``links`` (a, b) connect fingerprints; if not given, all within ``radius`` bits are.
    ``component_id`` is the smallest id reachable (NULL only if no member has one)
    and ``keep_fp`` the fingerprint under which that row is found.
    """
    each = stage(
        marks.groupBy("fp").agg(F.min(F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"))).alias("best")),
        "fingerprints",
    )
    roots = components(near_links(each.select("fp"), radius) if links is None else links)
    rooted = each.join(roots, each["fp"] == roots["node"], "left").select(
        "fp", "best", F.coalesce("root", "fp").alias("root")
    )
    smallest = rooted.groupBy("root").agg(
        F.min(F.struct("best.no_id", "best.id", "fp")).alias("first")
    )
    return stage(
        rooted.join(smallest, "root").select("fp", F.col("first.id").alias("component_id"), F.col("first.fp").alias("keep_fp")),
        "classes",
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4) -> DataFrame:
    """One row per document: id, fingerprint (16 hex digits), component_id.

    NULL and empty texts have fingerprint 0 and are linked like any other; repeated
    rows give repeated results; a NULL id keeps its row and never names a component
    with other ids; other columns of ``docs`` are ignored.
    """
    marks = stage(with_fingerprints(docs.select(id_col, text_col), text_col, "fp").select(id_col, "fp"), "marks")
    found = classes(marks, id_col, radius)
    return marks.join(found, "fp").select(
        F.col(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
