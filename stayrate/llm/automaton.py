"""Language-model scores by a weighted backoff automaton.

A state is a known context of up to ``order - 1`` words. Its arcs are the words seen
after it, weighted by their smoothed probability; a word without an arc follows the
failure arc to the context shortened by its first word, at the weight of what the
state leaves to shorter contexts. A text is read once from left to right: the state is
carried on and the log10 weights of the arcs taken are added up.

    p_k(w | h) = (1 - backoff) c(h w) / c(h) + backoff p_(k-1)(w | shorter h)
    p_1(w)     = (c(w) + 0.1) / (N + 0.1 (V + 1))

which sums to 1 over the V known words and one unknown. No task holds the automaton of
the corpus: documents are dealt to blocks of bounded size, each block asks for the
counts of its distinct n-grams, buckets of n-grams add the counts of all blocks up and
answer, and each block builds the part of the automaton its own texts can reach. A
frequent n-gram is one entry for each block, so no bucket follows a hot word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.words import mix, packed_keys, read_keys, text_bytes, word_hashes

ADDED = 0.1
START, END, SALT = np.uint64(0xA5A5), np.uint64(0x5A5A), np.uint64(0x9E3779B97F4A7C15)
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 64 << 20


def small_numbers(values: np.ndarray) -> bytes:
    """Counts in a byte each, larger ones in a list behind."""
    low = np.minimum(values, 255).astype(np.uint8)
    return low.tobytes() + values[low == 255].astype(np.int64).tobytes()


def read_numbers(data: bytes, count: int) -> np.ndarray:
    values = np.frombuffer(data, np.uint8, count).astype(np.int64)
    values[values == 255] = np.frombuffer(data, np.int64, offset=count)
    return values


@dataclass
class Tokens:
    """Words of several texts, each closed by an end mark."""

    hashes: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Tokens:
        texts = [np.append(word_hashes(x), END) for x in text_bytes(column)]
        lengths = np.array([len(x) for x in texts], np.int64)
        return cls(np.concatenate(texts), np.cumsum(lengths) - lengths, lengths)

    def keys(self, order: int) -> list[np.ndarray]:
        """Key of the k-gram that ends at each place, for k = 1..order; the mark before
        the first word is part of k-grams, and places with too few words repeat the
        key of the order below."""
        found = [mix(self.hashes ^ SALT)]
        for k in range(2, order + 1):
            before = np.roll(found[-1], 1)
            first = START_KEY if k == 2 else np.uint64(0)
            before[self.starts] = first
            key = mix(before * SALT + self.hashes)
            if k > 2:
                key[self.starts] = found[-1][self.starts]
            found.append(key)
        return found

    def asked(self, order: int) -> tuple[np.ndarray, np.ndarray]:
        """All distinct keys, sorted, and where each place's keys are among them
        (``order`` rows, then the place of the start mark)."""
        keys = self.keys(order)
        return np.unique(np.concatenate([*keys, [START_KEY]]), return_inverse=True)


START_KEY = mix(np.array([START], np.uint64) ^ SALT)[0]


@dataclass
class Automaton:
    """Arcs that the texts of one block can take, laid out by place.

    ``known[i]`` is the largest order of a known n-gram that ends at place i and
    ``arcs[k][i]`` the weight of the arc from the context of order k - 1 (row 0: of an
    unknown word, from the empty context).
    """

    arcs: np.ndarray
    known: np.ndarray
    failure: float

    @classmethod
    def build(cls, counts: np.ndarray, places: np.ndarray, tokens: Tokens, order: int, total: int, words: int, backoff: float) -> Automaton:
        size = len(tokens.hashes)
        own = counts[places[:-1]].reshape(order, size)
        start = counts[places[-1]]
        depth = np.arange(size) - np.repeat(tokens.starts, tokens.lengths)
        weight = (own[0] + ADDED) / (total + ADDED * (words + 1))
        arcs, known = np.empty((order + 1, size)), (own[0] > 0).astype(np.int8)
        arcs[0] = arcs[1] = np.log10(weight)
        for k in range(2, order + 1):
            context = np.roll(own[k - 2], 1)
            if k == 2:
                context[tokens.starts] = start
            there = (context > 0) & (depth >= k - 2)
            share = np.where(there, own[k - 1] / np.maximum(context, 1), 0)
            weight = np.where(there, (1 - backoff) * share + backoff * weight, weight)
            arcs[k] = np.log10(weight)
            known[there & (own[k - 1] > 0)] = k
        return cls(arcs, known, float(np.log10(backoff)))

    def traverse(self, tokens: Tokens, start_known: bool) -> np.ndarray:
        """Log10 weight of each text, all texts of the block read side by side."""
        order, count = len(self.arcs) - 1, len(tokens.starts)
        by_length = np.argsort(-tokens.lengths, kind="stable")
        rank = np.empty(count, np.int64)
        rank[by_length] = np.arange(count)
        longest = int(tokens.lengths.max(initial=0))
        active = count - np.cumsum(np.bincount(tokens.lengths, minlength=longest + 1))[:longest]
        offset = np.cumsum(active) - active
        step = np.arange(len(tokens.hashes)) - np.repeat(tokens.starts, tokens.lengths)
        place = offset[step] + np.repeat(rank, tokens.lengths)
        known = np.empty_like(self.known)
        known[place] = self.known
        arcs = np.empty_like(self.arcs)
        arcs[:, place] = self.arcs
        state = np.full(count, int(start_known and order > 1), np.int8)
        score = np.zeros(count)
        for low, n in zip(offset.tolist(), active.tolist()):
            here, column = state[:n], np.arange(low, low + n)
            taken = np.minimum(known[low : low + n], here + 1)
            failures = here - np.maximum(taken - 1, 0)
            score[:n] += arcs[taken, column] + failures * self.failure
            state[:n] = np.minimum(taken, order - 1)
        out = np.empty(count)
        out[by_length] = score
        return out


def id_hash(column: Column) -> Column:
    """crc32 of the id as text, a NULL id as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def vocabulary(texts: DataFrame) -> tuple[int, int]:
    """Number of tokens and of distinct tokens of the only column, end marks included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, counts = np.unique(Tokens.of(batch.column(0)).hashes, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(counts)], ["word", "n"])

    found = texts.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    row = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("*").alias("words")).first()
    return int(row["total"]), int(row["words"])


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: Column | None = None, order: int = 2, backoff: float = 0.5, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Counts come from the rows that are not ``held_out`` (NULL: held out); ``base_score``
    uses single words only. NULL and empty texts have one token, the end; repeated rows
    count and are scored each; without training rows every word is unknown.
    """
    if held_out is None:
        held_out = id_hash(F.col(id_col)) % 10 == 0
    small = docs.select(
        F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    size = small.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    total, words = vocabulary(small.where("NOT held_out").select("text"))
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, (size * order // bucket_bytes).bit_length())
    dealt = small.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def ask(table: pa.Table) -> pa.Table:
        tokens = Tokens.of(table.column("text").combine_chunks())
        keys, places = tokens.asked(order)
        counted = ~table.column("held_out").to_numpy()
        weight = np.append(np.tile(np.repeat(counted, tokens.lengths), order), counted.sum())
        counted_places = np.arange(len(tokens.hashes)) - np.repeat(tokens.starts, tokens.lengths)
        for k in range(3, order + 1):  # places that only repeat a lower order's key
            weight[(k - 1) * len(tokens.hashes) : k * len(tokens.hashes)][counted_places < k - 2] = 0
        counts = np.bincount(places, weight, len(keys)).astype(np.int64)
        cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)) if bits else []
        block = table.column("block")[0].as_py()
        rows = [
            (bucket, block, packed_keys(k), small_numbers(c))
            for bucket, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts)))
            if len(k)
        ]
        return pa.table(dict(zip(("bucket", "block", "keys", "counts"), map(list, zip(*rows)))), ASKED)

    def answer(table: pa.Table) -> pa.Table:
        keys = [read_keys(x.as_py()) for x in table.column("keys")]
        counts = [read_numbers(x.as_py(), len(k)) for x, k in zip(table.column("counts"), keys)]
        unique, places = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.zeros(len(unique), np.int64)
        np.add.at(totals, places, np.concatenate(counts))
        ends = np.cumsum([len(k) for k in keys])[:-1]
        told = [small_numbers(totals[p]) for p in np.split(places, ends)]
        sizes = [len(k) for k in keys]
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n": sizes, "totals": told}, TOLD)

    def score(table: pa.Table, told: pa.Table) -> pa.Table:
        tokens = Tokens.of(table.column("text").combine_chunks())
        keys, places = tokens.asked(order)
        told = told.sort_by("bucket")
        counts = np.concatenate([read_numbers(t.as_py(), n.as_py()) for t, n in zip(told.column("totals"), told.column("n"))])
        graph = Automaton.build(counts, places, tokens, order, total, words, backoff)
        single = counts[places[: len(tokens.hashes)]]
        base = np.log10((single + ADDED) / (total + ADDED * (words + 1)))
        return pa.table(
            {
                id_col: table.column("id"),
                "held_out": table.column("held_out"),
                "n_tokens": tokens.lengths,
                "n_known": np.add.reduceat((single > 0).astype(np.int64), tokens.starts),
                "train_tokens": np.full(len(tokens.lengths), total, np.int64),
                "base_score": np.add.reduceat(base, tokens.starts),
                "score": graph.traverse(tokens, bool(counts[places[-1]] > 0)),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket long, block long, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, n long, totals binary")
    fields = [("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType())]
    fields += [("base_score", T.DoubleType()), ("score", T.DoubleType())]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, schema)


ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("totals", pa.binary())])
