"""Repeated lines and passages, kept where they occur first.

Units of a text are its lines and, so that a passage repeated inside longer lines is a
unit too, runs of words between content-defined cuts: a cut follows a word whose hash is
divisible by CUT and each line end, and from every cut a run goes on to the first cut that
is at least ``min_words`` away. Where the same words stand, the same cuts do. Units are
normalised to lower-case words, hashed, and their digests grouped over all documents; the
earliest occurrence by (rank, place) stays, the others go, with their original offsets.

Documents are dealt to blocks of bounded size. A block asks once for each of its distinct
digests, with the smallest rank it has; a bucket of digests answers which block holds the
earliest. A very common unit is one entry for each block, so no group follows it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stayrate.llm.words import hashed, mix, packed_keys, pieces, plain_words, read_keys, text_bytes

CUT = 2
MIN_WORDS = 10
BLOCK_BYTES = 8 << 20
BUCKET_BYTES = 32 << 20
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
BASE = 0x9E3779B97F4A7C15
LAST = (1 << 63) - 1
SINGLE, EARLIEST, LATER = 0, 1, 2


def hashed_lines(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, and whether a line ends after it."""
    hashes, counts, open_line = [], [], 0
    for part in pieces(text):
        for i, line in enumerate(part.split(b"\n")):
            if i:
                counts.append(open_line)
                open_line = 0
            words = plain_words(line)
            hashes.append(hashed(words))
            open_line += len(words)
    counts.append(open_line)
    all_words = np.concatenate(hashes)
    ends = np.zeros(len(all_words), bool)
    places = np.cumsum(counts) - 1
    ends[places[np.array(counts) > 0]] = True
    return all_words, ends


@dataclass
class Units:
    """Units of a block's texts: words ``low`` to ``high`` (inclusive) of all its words."""

    starts: np.ndarray
    lengths: np.ndarray
    row: np.ndarray
    low: np.ndarray
    high: np.ndarray
    digest: np.ndarray

    @classmethod
    def of(cls, column: pa.Array, min_words: int) -> Units:
        read = [hashed_lines(x) for x in text_bytes(column)]
        lengths = np.array([len(h) for h, _ in read], np.int64)
        starts = np.cumsum(lengths) - lengths
        hashes = np.concatenate([h for h, _ in read])
        line_end = np.concatenate([e for _, e in read])
        size = len(hashes)
        owner = np.repeat(np.arange(len(read)), lengths)
        cut = line_end | (hashes % np.uint64(CUT) == 0)
        line_low = np.flatnonzero(np.concatenate([[True], line_end[:-1]])) if size else np.zeros(0, np.int64)
        line_high = np.flatnonzero(line_end)
        long_enough = line_high - line_low + 1 >= min_words
        cuts = np.flatnonzero(cut)
        low = np.concatenate([[0], cuts[:-1] + 1]) if size else cuts
        at = np.searchsorted(cuts, low + min_words - 1)
        low, at = low[at < len(cuts)], at[at < len(cuts)]
        high = cuts[at]
        inside = owner[low] == owner[high] if size else np.zeros(0, bool)
        both = np.unique(np.stack([np.concatenate([line_low[long_enough], low[inside]]), np.concatenate([line_high[long_enough], high[inside]])], axis=1), axis=0)
        low, high = both[:, 0], both[:, 1]
        # Polynomial over the words, brought to the same power wherever the unit stands.
        powers = np.ones(size + 1, np.uint64)
        powers[1:] = np.uint64(BASE)
        powers = np.cumprod(powers, dtype=np.uint64)
        inverse = np.full(size + 1, np.uint64(pow(BASE, -1, 1 << 64)))
        inverse[0] = 1
        inverse = np.cumprod(inverse, dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes) * powers[:size], dtype=np.uint64)])
        digest = mix((sums[high + 1] - sums[low]) * inverse[low] + (high - low + 1).astype(np.uint64))
        return cls(starts, lengths, owner[low] if size else low, low, high, digest)


def in_order(table: pa.Table) -> pa.Table:
    """Rows by rank, then text: the same order whenever the block is read."""
    return table.sort_by([("rank", "ascending"), ("text", "ascending")])


def removed_words(units: Units, codes: np.ndarray, unique: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Words of every unit that is not the earliest of its digest.

    Only the earliest occurrence itself is spared where a later one of the same digest
    overlaps it. ``codes`` tells of each of the ``unique`` digests whether it is single,
    earliest here or found earlier in another block; ``places`` is the unique digest of
    each unit.
    """
    first = np.full(len(unique), len(places), np.int64)
    np.minimum.at(first, places, np.arange(len(places)))
    here, own = codes[places] != LATER, first[places]
    later = ~here | (own != np.arange(len(places)))
    low = np.where(here, np.maximum(units.low, units.high[own] + 1), units.low)
    chosen = later & (low <= units.high)
    change = np.zeros(int(units.lengths.sum()) + 1, np.int64)
    np.add.at(change, low[chosen], 1)
    np.add.at(change, units.high[chosen] + 1, -1)
    return np.cumsum(change[:-1]) > 0


def cut_out(text: bytes, removed: np.ndarray) -> tuple[str, list[dict]]:
    """The text without the marked words, and the character spans taken out."""
    spans, run = [], None
    for i, match in enumerate(WORD.finditer(text)):
        if removed[i]:
            run = (run[0] if run else match.start(), match.end())
        elif run:
            spans.append(run)
            run = None
    if run:
        spans.append(run)
    kept, out, at, chars = [], [], 0, 0
    for low, high in spans:
        between, gone = text[at:low].decode(), text[low:high].decode()
        kept.append(between)
        chars += len(between)
        out.append({"start": chars, "end": chars + len(gone)})
        chars += len(gone)
        at = high
    kept.append(text[at:].decode())
    return "".join(kept), out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rank_col: str | None = None, min_words: int = MIN_WORDS, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """One row per document: id, text without repeats, n_words, n_removed, spans.

    ``rank_col`` (a whole number, the id if not given) ranks the documents, NULL last;
    ties go to the smaller block of a hash, then to the smaller text. ``spans`` are
    characters [start, end) of the original text. A unit has at least ``min_words``
    words. NULL texts stay NULL, empty ones empty; of repeated rows one keeps its text.
    """
    rank = F.coalesce(F.col(rank_col or id_col).try_cast("long"), F.lit(LAST))
    small = docs.select(F.col(id_col).alias("id"), rank.alias("rank"), F.col(text_col).alias("text"))
    size = small.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    blocks = max(1, -(-size // block_bytes))
    bits = max(0, (size // bucket_bytes).bit_length() + 1)
    dealt = small.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks)))

    def ask(table: pa.Table) -> pa.Table:
        table = in_order(table)
        units = Units.of(table.column("text").combine_chunks(), min_words)
        ranks = table.column("rank").to_numpy()
        unique, first = np.unique(units.digest, return_index=True)
        cuts = np.searchsorted(unique, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
        block = table.column("block")[0].as_py()
        own = ranks[units.row[first]]
        rows = [
            (bucket, block, packed_keys(k), r.tobytes())
            for bucket, (k, r) in enumerate(zip(np.split(unique, cuts), np.split(own, cuts)))
            if len(k)
        ]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 4, ASKED.types)], ASKED)

    def answer(table: pa.Table) -> pa.Table:
        keys = [read_keys(x.as_py()) for x in table.column("keys")]
        sizes = np.array([len(k) for k in keys])
        digests = np.concatenate(keys)
        ranks = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table.column("ranks")])
        owners = np.repeat(table.column("block").to_numpy(), sizes)
        order = np.lexsort((owners, ranks, digests))
        ranked = digests[order]
        first = np.concatenate([[True], ranked[1:] != ranked[:-1]])
        single = first & np.concatenate([first[1:], [True]])
        codes = np.empty(len(order), np.uint8)
        codes[order] = np.where(single, SINGLE, np.where(first, EARLIEST, LATER))
        told = [c.tobytes() for c in np.split(codes, np.cumsum(sizes)[:-1])]
        return pa.table([table.column("block"), table.column("bucket"), pa.array(told, pa.binary())], TOLD)

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        table = in_order(table)
        texts = table.column("text").combine_chunks()
        units = Units.of(texts, min_words)
        unique, places = np.unique(units.digest, return_inverse=True)
        told = told.sort_by("bucket")
        codes = np.frombuffer(b"".join(x.as_py() for x in told.column("codes")), np.uint8)
        gone = removed_words(units, codes, unique, places)
        counts = np.add.reduceat(np.append(gone, False).astype(np.int64), units.starts) * (units.lengths > 0)
        kept, spans = [], []
        for row, (text, start, length, count) in enumerate(zip(text_bytes(texts), units.starts, units.lengths, counts)):
            new, cut = cut_out(text, gone[start : start + length]) if count else (text.decode(), [])
            kept.append(new if texts[row].is_valid else None)
            spans.append(cut)
        columns = [table.column("id"), pa.array(kept, pa.string()), pa.array(units.lengths), pa.array(counts), pa.array(spans, SPANS)]
        return pa.table(columns, [id_col, text_col, "n_words", "n_removed", "spans"])

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket long, block long, keys binary, ranks binary")
    told = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket long, codes binary")
    span = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))
    fields = [(text_col, T.StringType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", span)]
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in fields)])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(finish, schema)


ASKED = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("keys", pa.binary()), ("ranks", pa.binary())])
TOLD = pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("codes", pa.binary())])
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
