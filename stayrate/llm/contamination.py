"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short and documents long, so the Jaccard similarity of the two is close
to nothing and equal sketches of both would miss. The sketch is therefore one-sided:
items are partitioned by their number of shingles, and an item keeps its ``m`` smallest
shingles under a random order (a bottom-m MinHash sketch), where ``m`` is one more than
the shingles that an item of the partition may lack. Every document that holds the wanted
share of an item holds at least one shingle of its sketch, so looking up each shingle of
the document finds all of them. What is found is verified on the words themselves. An item
of fewer words than a shingle is one shingle of its own length, and documents are cut at
that length too, so it is found inside any text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.words import mix, pieces, plain_words, hashed, shingle_hashes, text_bytes, word_hashes
from stayrate.session import stage

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_BYTES = 16 << 20
FOUND = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item", "matched", "size")]))


def shingles(words: list[bytes], size: int = SHINGLE) -> list[bytes]:
    """Runs of ``size`` words; the whole sequence if it is shorter."""
    if not words:
        return []
    size = min(size, len(words))
    return [b" ".join(words[i : i + size]) for i in range(len(words) - size + 1)]


def least_matches(size: int, containment: float) -> int:
    """Shingles of an item that a document must hold."""
    return max(1, math.ceil(containment * size - 1e-9))


class Index:
    """Sketches of a block of items, looked up by shingle hash."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, containment: float):
        self.size, self.containment = size, containment
        self.items = {key: frozenset(shingles(text.split(), size)) for key, text in items}
        self.length = {key: min(size, len(text.split())) for key, text in items}
        self.lengths = sorted(set(self.length.values()))
        partitions: dict[int, list[tuple[int, np.ndarray]]] = {}
        for key, text in items:
            own = np.unique(shingle_hashes(hashed(text.split()), size))
            if len(own):
                partitions.setdefault(len(own).bit_length(), []).append((key, own))
        keys, owners = [], []
        for part in partitions.values():
            lacking = max(len(own) - least_matches(len(own), containment) for _, own in part)
            for key, own in part:
                order = np.argsort(mix(own))[: lacking + 1]
                keys.append(own[order])
                owners.append(np.full(len(order), key, np.int64))
        keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.zeros(0, np.int64)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[by_key], owners[by_key]
        bits = max(16, (16 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.present = np.zeros(1 << bits, bool)
        self.present[self.keys >> self.shift] = True

    def candidates(self, hashes: np.ndarray) -> set[int]:
        hashes = np.unique(hashes[self.present[hashes >> self.shift]])
        lows, highs = np.searchsorted(self.keys, hashes, "left"), np.searchsorted(self.keys, hashes, "right")
        found: set[int] = set()
        for low, high in zip(lows[highs > lows].tolist(), highs[highs > lows].tolist()):
            found.update(self.owners[low:high].tolist())
        return found

    def search(self, text: bytes) -> list[dict]:
        """Items of which the text holds the wanted share of shingles."""
        words = word_hashes(text, plain_words)
        found: set[int] = set()
        for length in self.lengths:
            if len(words) >= length:
                found |= self.candidates(shingle_hashes(words, length))
        if not found:
            return []
        wanted = frozenset().union(*(self.items[k] for k in found))
        lengths = {self.length[k] for k in found}
        held: set[bytes] = set()
        tail: list[bytes] = []
        for part in pieces(text):
            tail += plain_words(part)
            for length in lengths:
                held.update(s for s in shingles(tail, length) if s in wanted)
            tail = tail[-(self.size - 1) :] if self.size > 1 else []
        out = []
        for key in sorted(found):
            size, matched = len(self.items[key]), len(self.items[key] & held)
            if matched >= least_matches(size, self.containment):
                out.append({"item": key, "matched": matched, "size": size})
        return out


def item_classes(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items with the same words as one class: (key, item_id, n_items, words).

    ``item_id`` is the smallest id of the class. Items without words are left out: no
    document holds them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [b" ".join(plain_words(x)) for x in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.binary())], ["item_id", "words"])

    schema = T.StructType([T.StructField("item_id", items.schema[id_col].dataType), T.StructField("words", T.BinaryType())])
    classes = (
        items.select(id_col, text_col)
        .mapInArrow(run, schema)
        .where(F.length("words") > 0)
        .groupBy("words")
        .agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"))
    )
    return stage(classes.select(F.monotonically_increasing_id().alias("key"), "item_id", "n_items", "words"), "items")


def item_indexes(classes: DataFrame, shingle: int, containment: float, block_bytes: int) -> Iterator[Index]:
    """An index for each block of about ``block_bytes`` of item words, one at a time."""
    total = classes.agg(F.coalesce(F.sum(F.length("words") + 64), F.lit(0))).first()[0]
    blocks = -(-total // block_bytes)
    for block in range(blocks):
        rows = classes.where(F.pmod(F.xxhash64("key"), F.lit(blocks)) == block).select("key", "words").collect()
        yield Index(sorted((r["key"], bytes(r["words"])) for r in rows), shingle, containment)


def found_in(index: Index, text: Column) -> Column:
    """Item classes of the index that each text holds: (item, matched, size)."""
    arrow = pa.list_(pa.struct([(n, pa.int64()) for n in ("item", "matched", "size")]))

    @F.arrow_udf(FOUND)
    def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in columns:
            yield pa.array([index.search(x) for x in text_bytes(texts)], arrow)

    return search(text)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", shingle: int = SHINGLE, containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Pairs (id, item_id, n_items, matched, n_shingles, containment) at or above the share.

    Words are runs of letters and digits in lower case. An item of under ``shingle`` words
    has one shingle, its whole sequence, and is found wherever a text holds it. Items with
    the same words are one class, named by its smallest id and counted in ``n_items`` (see
    :func:`item_classes` for the members). NULL and empty texts match nothing; very long
    ones are read in pieces; repeated documents give repeated pairs; an empty table on
    either side gives no pairs; other columns are ignored.

    Items go to the executors in blocks of about ``block_bytes``; each block is a pass of
    its own over the documents, so no more than one block is ever in memory.
    """
    classes = item_classes(items, item_id, item_text)
    small = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    none = docs.sparkSession.createDataFrame([], T.StructType([T.StructField("__id", docs.schema[id_col].dataType), T.StructField("f", FOUND.elementType)]))
    pairs = none
    for index in item_indexes(classes, shingle, containment, block_bytes):
        own = small.select("__id", found_in(index, F.col("__text")).alias("found")).select("__id", F.explode("found").alias("f"))
        pairs = own if pairs is none else stage(pairs, "pairs").unionByName(own)
    return pairs.join(classes, pairs["f.item"] == classes["key"]).select(
        F.col("__id").alias(id_col),
        F.col("item_id").alias(item_id),
        "n_items",
        "f.matched",
        F.col("f.size").alias("n_shingles"),
        (F.col("f.matched") / F.col("f.size")).alias("containment"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without the rows that hold the wanted share of any item's shingles.

    NULL and empty texts stay, as do all without items; repeated rows stay or go together;
    very long texts are read in pieces. With several blocks of items, what one block left is
    stored and read for the next. Columns are those of ``docs``, whatever their names.
    """
    kept = docs
    for i, index in enumerate(item_indexes(item_classes(items, item_id, item_text), SHINGLE, containment, block_bytes)):
        kept = (stage(kept, "kept") if i else kept).where(F.size(found_in(index, F.col(text_col))) == 0)
    return kept


_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
    "'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z\\x{80}-\\x{10FFFF}]+'), lambda x: x != '')"
)
_GRAMS = "unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' ')))"
PAIRS_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
classes AS (SELECT min(item_id) AS item_id, count(*) AS n_items, w FROM item_words WHERE len(w) > 0 GROUP BY w),
item_grams AS (SELECT DISTINCT item_id, {_GRAMS} AS g FROM (SELECT *, least(5, len(w)) AS k FROM classes)),
lengths AS (SELECT DISTINCT least(5, len(w)) AS k FROM classes),
sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id),
doc_words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
doc_grams AS (SELECT DISTINCT doc_id, {_GRAMS} AS g FROM doc_words, lengths WHERE len(w) >= k),
found AS (SELECT doc_id, item_id, count(*) AS matched FROM doc_grams JOIN item_grams USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, f.item_id, n_items, matched, n AS n_shingles, matched / n::DOUBLE AS containment
FROM found f JOIN sizes s ON f.item_id = s.item_id JOIN classes c ON f.item_id = c.item_id
WHERE matched >= ceil(0.8 * n - 1e-9)"""
