"""Approximate nearest neighbours: a navigable small-world graph for each shard.

Equal vectors are one node that carries their smallest ids, so thousands of copies are a
single place in the graph. Nodes are dealt to shards of bounded size by a hash. A task
builds the hierarchical graph of its shard (Malkov & Yashunin, 2018): a node reaches up to
a random level, is linked on each level to close and mutually distant nodes, and a search
descends from the top level and follows a beam on the lowest. The graph is written as flat
neighbour arrays, one row for each shard; queries meet every shard in groups, and the
shards' results are merged by the exact cosine of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.words import mix
from stayrate.session import spread, stage

LINKS = 16
BUILD_BEAM = 64
SEARCH_BEAM = 128
SHARD_ROWS = 8192
QUERY_ROWS = 16384
BATCH = 256
WIDE = 4


def beam_search(queries: np.ndarray, entries: np.ndarray, vectors: np.ndarray, links: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes found for each query, nearest first: (ids, similarities), -1 where fewer.

    All queries walk one level side by side: each step expands the WIDE best nodes of a
    query's beam that were not expanded yet, until there are none.
    """
    count, size = len(queries), len(vectors)
    rows = np.arange(count)[:, None]
    seen = np.zeros((count, size + 1), bool)
    seen[rows, entries] = True
    seen[:, -1] = True
    ids = np.full((count, beam), -1, np.int64)
    near = np.full((count, beam), -np.inf, np.float32)
    width = min(beam, entries.shape[1])
    first = np.where(entries < 0, -np.inf, np.einsum("qd,qed->qe", queries, vectors[entries]))
    order = np.argsort(-first, axis=1, kind="stable")[:, :width]
    ids[:, :width], near[:, :width] = entries[rows, order], first[rows, order]
    done = ids < 0
    active = np.arange(count)
    while len(active):
        waiting = np.where(done[active], -np.inf, near[active])
        chosen = np.argsort(-waiting, axis=1, kind="stable")[:, :WIDE]
        part = np.arange(len(active))[:, None]
        open_nodes = np.isfinite(waiting[part, chosen])
        alive = open_nodes.any(axis=1)
        active, chosen, open_nodes = active[alive], chosen[alive], open_nodes[alive]
        if not len(active):
            break
        own = active[:, None]
        done[own, chosen] = True
        nodes = np.where(open_nodes, ids[own, chosen], -1)
        found = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
        found = np.where(seen[own, found], -1, found)
        found = np.sort(found, axis=1)
        found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
        seen[own, found] = True
        fresh = np.einsum("qd,qed->qe", queries[active], vectors[found])
        fresh[found < 0] = -np.inf
        all_ids = np.concatenate([ids[active], found], axis=1)
        all_near = np.concatenate([near[active], fresh], axis=1)
        all_done = np.concatenate([done[active], found < 0], axis=1)
        best = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
        part = np.arange(len(active))[:, None]
        ids[active], near[active], done[active] = all_ids[part, best], all_near[part, best], all_done[part, best]
    return ids, near


def spread_links(ids: np.ndarray, near: np.ndarray, vectors: np.ndarray, wanted: int) -> np.ndarray:
    """Of each row's candidates, nearest first, up to ``wanted`` that are nearer to the
    row's node than to any chosen one; what room is left goes to the nearest others."""
    between = np.einsum("qad,qbd->qab", vectors[ids], vectors[ids])
    count, size = ids.shape
    chosen = np.zeros((count, size), bool)
    for i in range(size):
        closest = np.where(chosen[:, :i], between[:, i, :i], -np.inf).max(axis=1, initial=-np.inf)
        chosen[:, i] = (ids[:, i] >= 0) & (near[:, i] > closest) & (chosen.sum(axis=1) < wanted)
    order = np.argsort(np.where(ids < 0, 2, np.where(chosen, 0, 1)), axis=1, kind="stable")[:, :wanted]
    rows = np.arange(count)[:, None]
    out = np.full((count, wanted), -1, np.int64)
    out[:, : order.shape[1]] = ids[rows, order]
    return out


class Graph:
    """Flat neighbour arrays of one shard, a (nodes, links) array for each level."""

    def __init__(self, vectors: np.ndarray, levels: list[np.ndarray], heights: np.ndarray, entry: int):
        self.vectors, self.levels, self.heights, self.entry = vectors, levels, heights, entry

    @classmethod
    def build(cls, vectors: np.ndarray, marks: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> Graph:
        """``vectors`` of length one; ``marks`` are hashes that draw each node's height."""
        size = len(vectors)
        share = (mix(marks) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        heights = np.floor(-np.log(np.maximum(share, 1e-300)) / np.log(links)).astype(np.int64)
        heights = np.minimum(heights, 6)
        levels = [np.full((size, links * (2 if h == 0 else 1)), -1, np.int64) for h in range(int(heights.max(initial=0)) + 1)]
        graph = cls(vectors, levels, heights, 0)
        top, at = int(heights[0]), 1
        while at < size:
            batch = np.arange(at, min(size, at + min(BATCH, max(1, at))))
            graph._insert(batch, top, beam)
            highest = int(batch[np.argmax(heights[batch])])
            if heights[highest] > top:
                graph.entry, top = highest, int(heights[highest])
            at += len(batch)
        return graph

    def _insert(self, batch: np.ndarray, top: int, beam: int) -> None:
        queries = self.vectors[batch]
        entries = np.full((len(batch), 1), self.entry, np.int64)
        for level in range(top, -1, -1):
            here = self.heights[batch] >= level
            ids, near = beam_search(queries, entries, self.vectors, self.levels[level], beam if here.any() else WIDE)
            if here.any():
                self._connect(level, batch[here], ids[here], near[here])
            entries = ids[:, :WIDE]

    def _connect(self, level: int, nodes: np.ndarray, ids: np.ndarray, near: np.ndarray) -> None:
        links = self.levels[level]
        width = links.shape[1]
        chosen = spread_links(ids, near, self.vectors, min(LINKS, width))
        links[nodes, : chosen.shape[1]] = chosen
        back, new = chosen.ravel(), np.repeat(nodes, chosen.shape[1])
        back, new = back[back >= 0], new[back >= 0]
        order = np.lexsort((new, back))
        back, new = back[order], new[order]
        owners, starts, counts = np.unique(back, return_index=True, return_counts=True)
        offer = np.full((len(owners), width + int(counts.max(initial=0))), -1, np.int64)
        offer[:, :width] = links[owners]
        offer[np.repeat(np.arange(len(owners)), counts), width + np.arange(len(back)) - np.repeat(starts, counts)] = new
        for low in range(0, len(owners), BATCH):
            own, found = owners[low : low + BATCH], offer[low : low + BATCH]
            close = np.einsum("qd,qed->qe", self.vectors[own], self.vectors[found])
            close[found < 0] = -np.inf
            best = np.argsort(-close, axis=1, kind="stable")[:, : 2 * width]
            part = np.arange(len(own))[:, None]
            links[own] = spread_links(found[part, best], close[part, best], self.vectors, width)

    def search(self, queries: np.ndarray, wanted: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Nodes near each query, nearest first, -1 where fewer."""
        out = []
        for low in range(0, len(queries), BATCH):
            part = queries[low : low + BATCH]
            entries = np.full((len(part), 1), self.entry, np.int64)
            for level in range(int(self.heights[self.entry]), -1, -1):
                ids, _ = beam_search(part, entries, self.vectors, self.levels[level], max(beam, wanted) if level == 0 else WIDE)
                entries = ids[:, :WIDE]
            out.append(ids[:, :wanted])
        return np.concatenate(out) if out else np.zeros((0, wanted), np.int64)


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length one, scaled by the largest component first so that no square
    is lost."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))).astype(np.float32)


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of the rows, scaled by powers of two, which rounds nothing and keeps the
    squares of very small or large components."""
    a, b = (np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1]) for x in (a, b))
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def usable(vector: Column) -> Column:
    """Whether a vector takes part: components all finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def prepared(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    return table.where(usable(vector)).select(F.col(id_col).alias("id"), vector.alias("vector"), F.size(vector).alias("dim"))


def nodes(rows: DataFrame, kept_ids: int) -> DataFrame:
    """Distinct vectors with their ``kept_ids`` smallest ids: (dim, vector, ids, mark).

    The limit on the rank is applied before the exchange too, so a vector that a third of
    all rows share sends a few rows from each task.
    """
    by_vector = Window.partitionBy("dim", "vector").orderBy(F.col("id").asc_nulls_last())
    few = rows.withColumn("__rank", F.dense_rank().over(by_vector)).where(F.col("__rank") <= kept_ids)
    return few.groupBy("dim", "vector").agg(F.sort_array(F.collect_set("id")).alias("ids")).withColumn("mark", F.xxhash64("vector"))


def build_index(rows: DataFrame, kept_ids: int, shard_rows: int = SHARD_ROWS, links: int = LINKS, beam: int = BUILD_BEAM) -> DataFrame:
    """One stored row per shard: dim, shard, shards, vectors, ids, heights, entry, links."""
    found = stage(nodes(rows, kept_ids), "nodes")
    sizes = found.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).alias("shards"))
    # Dealt to a fixed number of tasks: merged by their bytes, all shards would fall to one.
    dealt = spread(found.join(sizes, "dim").withColumn("shard", F.pmod(F.col("mark"), F.col("shards"))), "dim", "shard")

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("mark")
        dim = table.column("dim")[0].as_py()
        vectors = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        marks = table.column("mark").to_numpy().view(np.uint64)
        # Insertion in an order that has nothing to do with the vectors' values.
        graph = Graph.build(unit(vectors), marks, links, beam)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "shard": [table.column("shard")[0].as_py()],
                "shards": [table.column("shards")[0].as_py()],
                "vectors": [vectors.tobytes()],
                "ids": [table.column("ids").to_pylist()],
                "heights": [graph.heights.astype(np.int8).tobytes()],
                "entry": [graph.entry],
                "links": [[x.astype(np.int32).tobytes() for x in graph.levels]],
            }
        )

    ids = rows.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("dim", T.IntegerType()),
            T.StructField("shard", T.LongType()),
            T.StructField("shards", T.LongType()),
            T.StructField("vectors", T.BinaryType()),
            T.StructField("ids", T.ArrayType(T.ArrayType(ids))),
            T.StructField("heights", T.BinaryType()),
            T.StructField("entry", T.LongType()),
            T.StructField("links", T.ArrayType(T.BinaryType())),
        ]
    )
    return stage(dealt.groupBy("dim", "shard").applyInArrow(run, schema), "graph")


def search_index(index: DataFrame, queries: DataFrame, wanted: int, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS) -> DataFrame:
    """Nodes found in every shard for (id, vector, dim) queries: query_id, ids, score.

    A shard meets the queries in groups of about ``query_rows``; each returns its
    ``wanted`` nearest nodes with the exact cosine in double precision.
    """
    groups = max(1, -(-queries.count() // query_rows))
    own = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shards = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    asked = (
        queries.join(shards, "dim")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
        .select("dim", "shard", F.pmod(F.xxhash64("id", "vector"), F.lit(groups)).cast("int").alias("part"), "id", "vector")
    )

    def run(stored: pa.Table, table: pa.Table) -> pa.Table:
        kind = table.column("id").type
        if not table.num_rows or not stored.num_rows:
            return pa.table([pa.array([], kind), pa.array([], pa.list_(kind)), pa.array([], pa.float64())], ["query_id", "ids", "score"])
        row = stored.to_pylist()[0]
        dim = row["dim"]
        vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, dim)
        size = len(vectors)
        levels = [np.frombuffer(x, np.int32).reshape(size, -1).astype(np.int64) for x in row["links"]]
        graph = Graph(unit(vectors), levels, np.frombuffer(row["heights"], np.int8).astype(np.int64), row["entry"])
        asked = table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        found = graph.search(unit(asked), min(wanted, size), beam)
        at, place = np.nonzero(found >= 0)
        score = cosine(asked[at], vectors[found[at, place]])
        ids = pa.array([row["ids"][i] for i in found[at, place]], pa.list_(kind))
        return pa.table([table.column("id").take(pa.array(at)), ids, pa.array(score)], ["query_id", "ids", "score"])

    id_type = queries.schema["id"].dataType
    schema = T.StructType([T.StructField("query_id", id_type), T.StructField("ids", T.ArrayType(id_type)), T.StructField("score", T.DoubleType())])
    keys = ["dim", "shard", "part"]
    return spread(asked, *keys).groupBy(*keys).cogroup(spread(own, *keys).groupBy(*keys)).applyInArrow(lambda q, s: run(s, q), schema)


def nearest(table: DataFrame, queries: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, shard_rows: int = SHARD_ROWS, links: int = LINKS, build_beam: int = BUILD_BEAM, beam: int = SEARCH_BEAM) -> DataFrame:
    """Each query's ``k`` nearest other rows: query_id, rank, vec_id, score.

    ``queries`` tells which rows ask (all with a number divisible by 50 if not given). Vectors
    that are NULL, zero, or hold NULL or non-finite components take no part; vectors of
    different lengths are never compared. Ties go to the smaller id. Rows that repeat an
    id and vector count once; an empty table gives no rows.
    """
    asking = F.coalesce(queries if queries is not None else F.col(id_col) % 50 == 0, F.lit(False))
    rows = prepared(table, id_col, vector_col)
    index = build_index(rows, k + 1, shard_rows, links, build_beam)
    asked = prepared(table.where(asking), id_col, vector_col).distinct()
    found = search_index(index, asked, k + 1, beam)
    pairs = found.select("query_id", F.explode("ids").alias("id"), "score").where(F.col("id") != F.col("query_id")).distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("id"))
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
