"""Merkle manifest of a dataset: a hash tree over the rows of each group and over the groups.

Every node is labelled with the interval of leaf ranks it covers. A node is an ancestor of
a leaf if its interval contains the leaf's rank, and what a parent's interval holds besides
a child's are the child's siblings; no pointers are kept. Levels fall into bands of
``HEIGHT`` levels, and within a band the intervals into buckets of ``FAN ** HEIGHT`` nodes,
so a containment join meets each node in the one bucket that can contain it.

The tree is built upward band by band: each bucket becomes the node that covers it, so
rows shrink by 4096 from band to band. Then ancestors are attached downward: the path of a
bucket's node is joined with the nodes the bucket contains. Only digests move; a task holds
one bucket, whatever group or id is frequent, and rows that repeat are ranked as one with a
number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.session import stage

FAN = 2
HEIGHT = 12


def hashed(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(column: Column) -> Column:
    """``-`` for NULL, else the number of UTF-8 bytes, ``:`` and the value."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


@dataclass
class Level:
    """Nodes of one level of a bucket: node i covers the ranks ``lows[i]`` to ``highs[i]``."""

    lows: np.ndarray
    highs: np.ndarray
    digests: list[str]


def levels_of(lows: np.ndarray, highs: np.ndarray, digests: list[str], whole: bool, fan: int, height: int) -> list[Level]:
    """Levels over the nodes of a bucket, lowest first: up to one node if the bucket is a
    ``whole`` tree, else ``height`` levels more."""
    levels = [Level(lows, highs, digests)]
    while len(levels[-1].digests) > 1 if whole else len(levels) <= height:
        last = levels[-1]
        firsts = np.arange(0, len(last.digests), fan)
        lasts = np.minimum(firsts + fan, len(last.digests)) - 1
        found = [hashed("".join(last.digests[i : i + fan])) for i in firsts]
        levels.append(Level(last.lows[firsts], last.highs[lasts], found))
    return levels


def siblings(levels: list[Level]) -> list[list[str]]:
    """For each node of the lowest level, what stands before and after it or its ancestor
    within the parent, level by level: before, after, before, after, ..."""
    ranks = levels[0].lows
    paths: list[list[str]] = [[] for _ in ranks]
    for low, high in zip(levels, levels[1:]):
        own = np.searchsorted(low.lows, ranks, "right") - 1
        parent = np.searchsorted(high.lows, ranks, "right") - 1
        starts = np.searchsorted(low.lows, high.lows[parent])
        stops = np.searchsorted(low.lows, high.highs[parent])
        for path, i, start, stop in zip(paths, own.tolist(), starts.tolist(), stops.tolist()):
            path += ["".join(low.digests[start:i]), "".join(low.digests[i + 1 : stop])]
    return paths


def fold(digest: str, path: list[str]) -> str:
    """Root that follows from a leaf and the siblings on its path."""
    for before, after in zip(path[::2], path[1::2]):
        digest = hashed(before + digest + after)
    return digest


def ranked(items: DataFrame, order: Sequence[str]) -> DataFrame:
    """``items`` (g, times, ...) with ``low``, ``high``: the ranks they cover in their group
    by ``order``, NULL first, and ``size``, the number of ranks of the group.

    Rows are sorted by range, each partition adds up ``times``, and one row for each
    partition and group carries the sum over the partitions before it.
    """
    keys = [F.asc_nulls_first(c) for c in ("g", *order)]
    ordered = items.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())
    place = ordered.columns.index("times")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            times = batch.column(place).to_numpy()
            sums = total + np.cumsum(times)
            total = int(sums[-1]) if len(sums) else total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums - times)], [*batch.schema.names, "before"])

    schema = T.StructType([*ordered.schema.fields, T.StructField("before", T.LongType())])
    placed = stage(ordered.mapInArrow(run, schema), "ranked")
    runs = placed.groupBy("g", "part").agg(F.min("before").alias("base"), F.sum("times").alias("held"))
    earlier = Window.partitionBy("g").orderBy("part")
    offsets = runs.select(
        "g", "part", (F.sum("held").over(earlier) - F.col("held") - F.col("base")).alias("shift"),
        F.sum("held").over(Window.partitionBy("g")).alias("size"),
    )
    low = F.col("before") + F.col("shift")
    return placed.join(offsets, ["g", "part"]).withColumn("low", low).withColumn("high", low + F.col("times")).drop("part", "before", "shift")


def _bucket(band: int) -> Column:
    return F.floor(F.col("low") / F.lit(FAN ** (HEIGHT * (band + 1)))).cast("long").alias("bucket")


def _single(items: DataFrame) -> DataFrame:
    """One row for each rank."""
    rank = F.explode(F.sequence("low", F.col("high") - 1)).alias("low")
    return items.select(*[c for c in items.columns if c not in ("low", "high", "times")], rank).withColumn("high", F.col("low") + 1)


def _sorted_levels(table: pa.Table, band: int) -> tuple[pa.Table, list[Level]]:
    table = table.sort_by("low")
    whole = table.column("size")[0].as_py() <= FAN ** (HEIGHT * (band + 1))
    return table, levels_of(table.column("low").to_numpy(), table.column("high").to_numpy(), table.column("digest").to_pylist(), whole, FAN, HEIGHT)


NODE = "g string, low long, high long, size long, digest string"
PATH = "g string, bucket long, low long, high long, path array<string>, subroot string, root string"


def _cover(nodes: DataFrame, band: int) -> DataFrame:
    """The node that covers each bucket of a band."""

    def run(table: pa.Table) -> pa.Table:
        table, levels = _sorted_levels(table, band)
        top = levels[-1]
        return pa.table({"g": table.column("g")[:1], "low": top.lows[:1], "high": top.highs[:1], "size": table.column("size")[:1], "digest": top.digests[:1]})

    return nodes.groupBy("g", _bucket(band)).applyInArrow(run, NODE)


def _bands(nodes: DataFrame) -> list[DataFrame]:
    """Nodes at the bottom of each band: (g, low, high, size, digest). The last has one
    node for each group that is that high; no group is higher."""
    largest = nodes.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
    found, width = [nodes], 1
    while True:
        band = len(found) - 1
        found.append(stage(_cover(found[-1].where(F.col("size") > width) if band else found[-1], band), f"band-{band}"))
        width *= FAN**HEIGHT
        if width >= largest:
            return found


def _tops(bands: list[DataFrame]) -> DataFrame:
    """Root of each group: (g, size, digest)."""
    tops = None
    for band, nodes in enumerate(bands[1:], 1):
        done = nodes.where(F.col("size") <= FAN ** (HEIGHT * band)).select("g", "size", "digest")
        tops = done if tops is None else tops.unionByName(done)
    return tops


def _attached(nodes: DataFrame, above: DataFrame, band: int) -> DataFrame:
    """Path of each node of a band up to the root, from that of the node that contains it."""

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, levels = _sorted_levels(table, band)
        low, high = (upper.column(c)[0].as_py() for c in ("low", "high"))
        inside = [low <= x < high for x in levels[0].lows.tolist()]
        if not all(inside):
            raise ValueError("a node outside the bucket that should contain it")
        rest, count = upper.column("path")[0].as_py(), len(inside)
        return pa.table(
            {
                "g": table.column("g"),
                "bucket": pa.array(levels[0].lows // FAN ** (HEIGHT * band)),
                "low": pa.array(levels[0].lows),
                "high": pa.array(levels[0].highs),
                "path": pa.array([path + rest for path in siblings(levels)], pa.list_(pa.string())),
                "subroot": pa.array([upper.column("subroot")[0].as_py()] * count, pa.string()),
                "root": pa.array([upper.column("root")[0].as_py()] * count, pa.string()),
            }
        )

    return nodes.groupBy("g", _bucket(band)).cogroup(above.groupBy("g", "bucket")).applyInArrow(run, PATH)


def _above(bands: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Path of the node that covers each bucket of the lowest band (columns of ``PATH``);
    ``tops`` (g, size, path, subroot, root) say how a group's own root goes on."""
    reached = tops.select("g", "size", F.lit(0).cast("long").alias("bucket"), F.lit(0).cast("long").alias("low"), F.col("size").alias("high"), "path", "subroot", "root")
    above = None
    for band in range(len(bands) - 2, -1, -1):
        low, high = (FAN ** (HEIGHT * b) if b else 0 for b in (band, band + 1))
        ends = reached.where((F.col("size") > low) & (F.col("size") <= high)).drop("size")
        above = ends if above is None else above.unionByName(ends)
        if band:
            above = stage(_attached(bands[band].where(F.col("size") > low), above, band), f"paths-{band}")
    return above


def leaves(docs: DataFrame, fields: Sequence[Column], id_col: str, group_col: str, changed: Sequence[Column] | None = None, touched: Column | None = None) -> DataFrame:
    """Of each row: g (the group as text, NULL first in order), id, digest, and the digest
    of the ``changed`` fields where ``touched`` holds. Equal rows are one, ``times`` tells
    how often."""
    other = F.when(touched, leaf_digest(changed)) if changed is not None and touched is not None else F.lit(None).cast("string")
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    each = docs.select(group.alias("g"), F.col(id_col).alias("id"), leaf_digest(fields).alias("digest"), other.alias("changed"))
    return each.groupBy("g", "id", "digest", "changed").agg(F.count("*").alias("times"))


def nodes(docs: DataFrame, fields: Sequence[Column], id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """The trees of all groups: (g, level, low, high, digest), leaves at level 0.

    ``g`` is ``=`` and the group, or empty for NULL; [low, high) are the leaf ranks covered.
    """
    bands = _bands(_single(ranked(leaves(docs, fields, id_col, group_col), ["id", "digest"])))

    def listed(band: int):
        def run(table: pa.Table) -> pa.Table:
            table, levels = _sorted_levels(table, band)
            rows = [(table.column("g")[0].as_py(), band * HEIGHT + j, int(a), int(b), d) for j, x in enumerate(levels) if j or not band for a, b, d in zip(x.lows, x.highs, x.digests)]
            return pa.table(dict(zip(("g", "level", "low", "high", "digest"), map(list, zip(*rows)))))

        return run

    out = None
    for band, base in enumerate(bands[:-1]):
        given = base.where(F.col("size") > FAN ** (HEIGHT * band)) if band else base
        found = given.groupBy("g", _bucket(band)).applyInArrow(listed(band), "g string, level long, low long, high long, digest string")
        out = found if out is None else out.unionByName(found)
    return out


def manifest(docs: DataFrame, fields: Sequence[Column], id_col: str = "doc_id", group_col: str = "lang", changed: Sequence[Column] | None = None, touched: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``fields`` are hashed into the leaf. In a group (NULL is one) leaves ascend by id, NULL
    first; rows with equal ids by their digest, so equal rows are neighbours in any order.
    Each two nodes in a row become one by the hash of their digests, a last single one by
    its own, until one is left: the subroot. Subroots in order of the groups make the root
    likewise. The proof is the digest of all siblings from the leaf to the root. The root
    is folded again from the leaf, or where ``touched`` holds from that of the ``changed``
    fields, and ``verified`` tells whether it is the same. NULL fields are told from empty
    ones; an empty table has no rows; other columns have no influence.
    """
    base = _single(ranked(leaves(docs, fields, id_col, group_col, changed, touched), ["id", "digest"]))
    bands = _bands(base.select("g", "low", "high", "size", "digest"))
    subroots = stage(_tops(bands).select(F.lit("").alias("g"), F.col("g").alias("id"), F.lit(1).cast("long").alias("times"), "digest"), "subroots")
    over = _single(ranked(subroots, ["id"]))
    over_bands = _bands(over.select("g", "low", "high", "size", "digest"))
    none = F.array().cast("array<string>")
    root = _tops(over_bands).select("g", "size", none.alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    tops = over.select("g", "low", "id", "digest").join(_attached(over, _above(over_bands, root), 0).drop("bucket", "subroot"), ["g", "low"])
    tops = tops.select(F.col("id").alias("g"), "path", F.col("digest").alias("subroot"), "root")
    tops = stage(tops.join(_tops(bands).select("g", "size"), "g"), "tops")
    above = _above(bands, tops)

    def run(table: pa.Table, upper: pa.Table) -> pa.Table:
        table, levels = _sorted_levels(table, 0)
        low, high, rest, subroot, top = (upper.column(c)[0].as_py() for c in ("low", "high", "path", "subroot", "root"))
        if not low <= levels[0].lows[0] or not levels[0].highs[-1] <= high:
            raise ValueError("a leaf outside the bucket that should contain it")
        leaf, other = table.column("digest").to_pylist(), table.column("changed").to_pylist()
        paths = [path + rest for path in siblings(levels)]
        folded = [fold(b or a, path) for a, b, path in zip(leaf, other, paths)]
        count = len(leaf)
        return pa.table(
            {
                id_col: table.column("id"),
                "leaf": table.column("digest"),
                "subroot": pa.array([subroot] * count, pa.string()),
                "root": pa.array([top] * count, pa.string()),
                "proof_sha256": pa.array([hashed("".join(path)) for path in paths], pa.string()),
                "folded_root": pa.array(folded, pa.string()),
                "verified": pa.array([x == top for x in folded], pa.bool_()),
            }
        )

    texts = [T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *texts, T.StructField("verified", T.BooleanType())])
    return base.groupBy("g", _bucket(0)).cogroup(above.groupBy("g", "bucket")).applyInArrow(run, schema)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """Manifest of ``documents`` by language, in which every seventh row by the checksum of
    its id is read back with one character more than it was stored with."""
    first, last = [F.col(c) for c in ("doc_id", "source", "lang")], F.col("text")
    more = F.expr("try_add(n_chars, 1)")
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return manifest(docs, [*first, F.col("n_chars"), last], changed=[*first, more, last], touched=touched)


MANIFEST_SQL = """
WITH RECURSIVE fields AS (
    SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id::VARCHAR, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS before,
        coalesce(strlen(text) || ':' || text, '-') AS after,
        xor(4294967295, list_reduce(
            list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ord(c)::BIGINT)),
            lambda sum, byte: list_reduce(
                list_prepend(xor(sum, byte), range(8)),
                lambda rest, bit: CASE WHEN rest % 2 = 1 THEN xor(rest // 2, 3988292384) ELSE rest // 2 END)
        )) % 7 = 0 AS touched
    FROM documents
), leaves AS (
    SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf,
        CASE WHEN touched THEN sha256(before || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1)::VARCHAR, '-') || after) ELSE leaf END AS given
    FROM (SELECT *, sha256(before || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars::VARCHAR, '-') || after) AS leaf FROM fields)
), nodes AS (
    SELECT lang, 0 AS level, pos, leaf AS digest FROM leaves
    UNION ALL
    SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) WHERE n > 1
    GROUP BY lang, level, pos // 2
), subroots AS (
    SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place
    FROM (SELECT lang, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY lang)
), over_nodes AS (
    SELECT 0 AS level, place AS pos, subroot AS digest FROM subroots
    UNION ALL
    SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos))
    FROM (SELECT *, count(*) OVER () AS n FROM over_nodes) WHERE n > 1
    GROUP BY level, pos // 2
), tops AS (
    SELECT max(level) AS over_height, arg_max(digest, level) AS root FROM over_nodes
), steps AS (
    SELECT l.lang, l.pos, n.level, n.pos AS own, s.digest, s.pos AS at
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
    JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.pos = l.pos // (1 << n.level)::BIGINT AND n.level < r.height
    LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM n.lang AND s.level = n.level AND s.pos = xor(n.pos, 1)
    UNION ALL
    SELECT l.lang, l.pos, r.height + n.level, n.pos, s.digest, s.pos
    FROM leaves l JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang CROSS JOIN tops
    JOIN over_nodes n ON n.pos = r.place // (1 << n.level)::BIGINT AND n.level < over_height
    LEFT JOIN over_nodes s ON s.level = n.level AND s.pos = xor(n.pos, 1)
), proofs AS (
    SELECT lang, pos, sha256(coalesce(string_agg(digest, '' ORDER BY level), '')) AS proof_sha256 FROM steps GROUP BY lang, pos
), folded AS (
    SELECT lang, pos, 0 AS level, given AS digest FROM leaves
    UNION ALL
    SELECT f.lang, f.pos, f.level + 1,
        sha256(CASE WHEN s.at < s.own THEN s.digest ELSE '' END || f.digest || CASE WHEN s.at > s.own THEN s.digest ELSE '' END)
    FROM folded f JOIN steps s ON s.lang IS NOT DISTINCT FROM f.lang AND s.pos = f.pos AND s.level = f.level
)
SELECT l.doc_id, l.leaf, r.subroot, t.root, coalesce(p.proof_sha256, sha256('')) AS proof_sha256,
    f.digest AS folded_root, f.digest = t.root AS verified
FROM leaves l
JOIN subroots r ON r.lang IS NOT DISTINCT FROM l.lang
CROSS JOIN tops t
LEFT JOIN proofs p ON p.lang IS NOT DISTINCT FROM l.lang AND p.pos = l.pos
JOIN folded f ON f.lang IS NOT DISTINCT FROM l.lang AND f.pos = l.pos AND f.level = r.height + t.over_height
"""
