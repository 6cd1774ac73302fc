"""Collocations of a corpus: phrases whose words stand together more often than their parts.

Frequent phrases are found in two passes. In the first, documents are dealt to blocks of
bounded size; a block counts the word sequences it holds and sends hashed keys with counts
to hash partitions. A partition merges these in a Misra-Gries summary: it keeps at most
``capacity`` counters, and when there are more, takes the largest count that does not fit
off every counter. Whatever is taken off is at most ``mass / (capacity + 1)``, so with a
capacity above ``mass / threshold`` every sequence that occurs ``threshold`` times keeps a
counter. Each block is told, by one bit for each of its keys, what survived, and in the
second pass counts the survivors by their words. So hashes only choose what is counted:
two sequences that share a key cost a needless count and never change a result.

Equal texts are one text with a number, counts are added up before they are exchanged,
and no task holds more than one block or one partition of keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stayrate.llm.words import mix, packed_keys, pieces, read_keys
from stayrate.session import stage

BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 24 << 20
TOKENS = 1 << 18
PARTS = 8
KEY_BITS = 48
FACTOR = np.uint64(0x9E3779B97F4A7C15)
# A byte that UTF-8 never holds marks where a piece ends.
MARK = b"\xff"
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
TO_MARKS = bytes(0xFF if b in SEPARATORS else b for b in range(256))


def tokens_of(text: bytes) -> Iterator[list[bytes]]:
    """Words of a text, A-Z in lower case, and a mark at each end of a piece."""
    marked = text.lower().translate(TO_MARKS).replace(MARK, b" \xff ")
    for part in pieces(marked):
        yield part.split()
    yield [MARK]


class Sequences:
    """Distinct sequences of 1 to ``longest`` words in the texts of one language.

    ``codes[k]`` are the distinct sequences of k + 1 words: the place of the shorter
    sequence among those of k words, times the number of words, plus the last word.
    ``counts[k]`` are their occurrences, an occurrence in a text weighing the text's number.
    """

    def __init__(self, texts: list[bytes], numbers: np.ndarray, longest: int):
        parts, waiting, sizes = [], [], []
        for text in texts:
            size = 0
            for tokens in tokens_of(text):
                waiting += tokens
                size += len(tokens)
                if len(waiting) >= TOKENS:
                    parts.append(pa.array(waiting, pa.binary()).dictionary_encode())
                    waiting = []
            sizes.append(size)
        parts.append(pa.array(waiting, pa.binary()).dictionary_encode())
        coded = pa.chunked_array(parts).unify_dictionaries()
        self.words = coded.chunk(0).dictionary
        own = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]).astype(np.int64)
        weights = np.repeat(numbers, sizes)
        mark = pc.index(self.words, pa.scalar(MARK, pa.binary())).as_py()
        inside = own != mark
        self.total = int(weights[inside].sum())
        self.codes, self.counts = [], []
        places, before = np.flatnonzero(inside), np.zeros(len(own), np.int64)
        for k in range(longest):
            if k:
                places = places[(places + k < len(own))]
                places = places[inside[places + k]]
            code = before[places] * len(self.words) + own[places + k]
            found, at = np.unique(code, return_inverse=True)
            self.codes.append(found)
            self.counts.append(np.bincount(at, weights[places], len(found)).astype(np.int64))
            before[places] = at

    def keys(self, seed: int) -> list[np.ndarray]:
        """Hash of each distinct sequence, by number of words."""
        hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_py(), seed) for w in self.words), np.uint64, len(self.words))
        out: list[np.ndarray] = []
        for codes in self.codes:
            shorter = out[-1][codes // len(self.words)] if out else np.uint64(0)
            out.append(mix(shorter * FACTOR + hashes[codes % len(self.words)]))
        return out

    def phrases(self, k: int, chosen: np.ndarray) -> pa.Array:
        """Words of the ``chosen`` sequences of k + 1 words, joined by a blank."""
        columns, places = [], chosen
        for j in range(k, -1, -1):
            code = self.codes[j][places]
            columns.append(self.words.take(pa.array(code % len(self.words))).cast(pa.string()))
            places = code // len(self.words)
        return pc.binary_join_element_wise(*reversed(columns), " ")


def by_language(table: pa.Table, longest: int) -> list[tuple[str, Sequences]]:
    out = []
    for lang in sorted(table.column("lang").unique().to_pylist()):
        part = table.filter(pc.equal(table.column("lang"), lang))
        texts = [t.as_py() for t in part.column("text").cast(pa.binary())]
        out.append((lang, Sequences(texts, part.column("number").to_numpy(), longest)))
    return out


def all_keys(found: list[tuple[str, Sequences]]) -> np.ndarray:
    """Keys of all sequences of a block, language by language and by number of words."""
    keys = [k for lang, own in found for k in own.keys(xxhash.xxh64_intdigest(lang))]
    return np.concatenate(keys) >> np.uint64(64 - KEY_BITS)


class Summary:
    """Misra-Gries counters of the most frequent keys, sorted by key."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.keys, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds counters, in any order and with repeated keys."""
        self.keys, places = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        counts = np.concatenate([self.counts, counts])
        self.counts = np.bincount(places, counts, len(self.keys)).astype(np.int64)
        if len(self.keys) > self.capacity:
            beyond = len(self.keys) - self.capacity - 1
            self.counts -= np.partition(self.counts, beyond)[beyond]
            self.keys, self.counts = self.keys[self.counts > 0], self.counts[self.counts > 0]


def survivors(partials: list[tuple[np.ndarray, np.ndarray]], threshold: int) -> np.ndarray:
    """Keys that may occur ``threshold`` times, in ascending order; those that surely do not
    are among them only if another sequence shares their key."""
    mass = sum(int(counts.sum()) for _, counts in partials)
    summary = Summary(mass // threshold + 1)
    for keys, counts in partials:
        summary.merge(keys, counts)
    totals = np.zeros(len(summary.keys), np.int64)
    for keys, counts in partials:
        places = np.searchsorted(summary.keys, keys)
        places[places == len(summary.keys)] = 0
        there = summary.keys[places] == keys if len(summary.keys) else np.zeros(len(keys), bool)
        np.add.at(totals, places[there], counts[there])
    return summary.keys[totals >= threshold]


def counted_phrases(docs: DataFrame, text_col: str, lang_col: str, longest: int, threshold: int, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Every phrase of up to ``longest`` words with at least ``threshold`` occurrences, and
    with ``words`` = 0 the number of all words of a language: (lang, words, phrase, f)."""
    small = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text")
    ).where("text <> ''")
    size = small.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, (size * longest // bucket_bytes).bit_length())
    distinct = small.groupBy("lang", "text").agg(F.count("*").alias("number"))
    dealt = distinct.withColumn("block", F.pmod(F.xxhash64("lang", "text"), F.lit(blocks)))

    def ask(table: pa.Table) -> pa.Table:
        found = by_language(table, longest)
        keys = all_keys(found)
        order = np.argsort(keys, kind="stable")
        keys = keys[order]
        counts = np.concatenate([c for _, own in found for c in own.counts])[order]
        cuts = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(KEY_BITS - bits)) if bits else []
        parts = [(b, k, c) for b, (k, c) in enumerate(zip(np.split(keys, cuts), np.split(counts, cuts))) if len(k)]
        low = [np.minimum(c, 255).astype(np.uint8) for _, _, c in parts]
        return pa.table(
            {
                "bucket": pa.array([b for b, _, _ in parts], pa.int64()),
                "block": pa.array([table.column("block")[0].as_py()] * len(parts), pa.int64()),
                "keys": pa.array([packed_keys(k) for _, k, _ in parts], pa.binary()),
                "counts": pa.array([x.tobytes() + c[x == 255].tobytes() for x, (_, _, c) in zip(low, parts)], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        partials = []
        for keys, counts in zip(table.column("keys"), table.column("counts")):
            own, data = read_keys(keys.as_py()), counts.as_py()
            number = np.frombuffer(data, np.uint8, len(own)).astype(np.int64)
            number[number == 255] = np.frombuffer(data, np.int64, offset=len(own))
            partials.append((own, number))
        kept = survivors(partials, threshold)
        bits = [np.packbits(np.isin(own, kept)).tobytes() for own, _ in partials]
        sizes = pa.array([len(own) for own, _ in partials], pa.int64())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "size": sizes, "kept": pa.array(bits, pa.binary())})

    def count(table: pa.Table, told: pa.Table) -> pa.Table:
        found = by_language(table, longest)
        keys = all_keys(found)
        told = told.sort_by("bucket")
        parts = [np.unpackbits(np.frombuffer(b.as_py(), np.uint8), count=n.as_py()) for n, b in zip(told.column("size"), told.column("kept"))]
        kept = np.empty(len(keys), bool)
        kept[np.argsort(keys, kind="stable")] = np.concatenate([np.empty(0, np.uint8), *parts]).astype(bool)
        out, at = [], 0
        for lang, own in found:
            rows = [(0, pa.array([""]), np.array([own.total]))]
            for k, counts in enumerate(own.counts):
                chosen = np.flatnonzero(kept[at : at + len(counts)])
                rows.append((k + 1, own.phrases(k, chosen), counts[chosen]))
                at += len(counts)
            for k, phrases, counts in rows:
                out.append(pa.table([pa.array([lang] * len(counts), pa.string()), pa.array([k] * len(counts), pa.int32()), phrases, pa.array(counts)], COUNTED))
        return pa.concat_tables(out)

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket long, block long, keys binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, size long, kept binary")
    local = dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(count, "lang string, words int, phrase string, f long")
    return local.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).where(f"words = 0 OR f >= {int(threshold)}")


COUNTED = ["lang", "words", "phrase", "f"]


def part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def score_of(a: Column, left: Column, right: Column, scale: int) -> Column:
    """floor(scale a^2 / (l r)) in exact whole numbers (counts below 10^15)."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(scale).cast("decimal(7,0)") * (whole(a) * whole(a)), whole(left) * whole(right))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, threshold: int = 10, top: int = 2000, scale: int = 1_000_000, contained_percent: int = 50, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score, cut.

    Phrases have 2 to ``longest`` words of one piece of a text and occur ``threshold`` times
    at least. Of the ways to cut a phrase in two, that of the lowest score counts (ties: the
    shortest first part). A phrase within a longer candidate that has
    ``contained_percent`` of its occurrences is dropped. NULL and empty texts have no words;
    repeated rows count each; a NULL language is ``und``; ties in score go to the larger
    count, then to the phrase that is first in UTF-8 order; other columns are ignored.
    """
    counted = stage(counted_phrases(docs, text_col, lang_col, longest, threshold, block_bytes, bucket_bytes), "phrases")
    totals = counted.where("words = 0").select("lang", F.col("f").alias("n"))
    phrases = counted.where("words > 0")
    candidates = phrases.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    cuts = candidates.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1))).select(
        "lang", "phrase", "a", "cut",
        part(F.col("w"), F.lit(1), F.col("cut")).alias("first"),
        part(F.col("w"), F.col("cut") + 1, F.col("words") - F.col("cut")).alias("rest"),
    )
    firsts = phrases.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = (
        cuts.join(firsts, ["lang", "first"])
        .join(rests, ["lang", "rest"])
        .withColumn("score", score_of(F.col("a"), F.col("l"), F.col("r"), scale))
        .groupBy("lang", "phrase")
        .agg(F.first("a").alias("a"), F.min(F.struct("score", "cut", "l", "r")).alias("low"))
    )
    within = (
        candidates.where("words > 2")
        .withColumn("length", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)))
        .groupBy("lang", part(F.col("w"), F.col("start"), F.col("length")).alias("phrase"))
        .agg(F.max("a").alias("longer"))
    )
    free = scored.join(within, ["lang", "phrase"], "left").where(f"longer IS NULL OR 100 * longer < {int(contained_percent)} * a")
    order = [F.desc("low.score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so the last sort of a language has PARTS x top rows at most.
    part_of = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    near = free.withColumn("rank", F.row_number().over(Window.partitionBy("lang", part_of).orderBy(*order))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "low.l", "low.r", "n", "low.score", F.col("low.cut").cast("long").alias("cut")
    )


COLLOCATIONS_SQL = """
WITH texts AS (
    SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
    FROM documents
), pieces AS (
    SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w
    FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM texts)
), grams AS (
    SELECT lang, k AS words, array_to_string(w[i:i + k - 1], ' ') AS phrase
    FROM (
        SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM pieces, (SELECT unnest([1, 2, 3]) AS k)
        WHERE len(w) >= k
    )
), totals AS (
    SELECT lang, count(*) AS n FROM grams WHERE words = 1 GROUP BY lang
), phrases AS (
    SELECT lang, words, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 10
), candidates AS (
    SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM phrases WHERE words > 1
), cuts AS (
    SELECT lang, phrase, a, cut, array_to_string(w[1:cut], ' ') AS first, array_to_string(w[cut + 1:], ' ') AS rest
    FROM (SELECT *, unnest(range(1, words)) AS cut FROM candidates)
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.cut, x.f AS l, y.f AS r,
        ((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
    FROM cuts c
    JOIN phrases x ON x.lang = c.lang AND x.phrase = c.first
    JOIN phrases y ON y.lang = c.lang AND y.phrase = c.rest
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), within AS (
    SELECT lang, phrase, max(a) AS longer
    FROM (
        SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase
        FROM candidates WHERE words = 3
    )
    GROUP BY lang, phrase
)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY b.score DESC, b.a DESC, b.phrase) AS rank,
    b.phrase, b.a, b.l, b.r, t.n, b.score, b.cut::BIGINT AS cut
FROM lowest b
JOIN totals t ON t.lang = b.lang
LEFT JOIN within w ON w.lang = b.lang AND w.phrase = b.phrase
WHERE w.longer IS NULL OR 100 * w.longer < 50 * b.a
QUALIFY rank <= 2000
"""
