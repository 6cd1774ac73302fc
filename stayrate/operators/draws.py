"""Seeded draws of whole batches: MD5 of many short texts at once, and weights added up.

A bootstrap needs one MD5 per row and replicate; here a column of texts is hashed in
array operations and its draws stay packed, two bytes each, until they are counted.
Functions that run on executors travel with their task.
"""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Replicates whose weights travel side by side in one row.
WIDTH = 16
# Rows of a class whose weights are added up together; a place among them takes two bytes.
BITS = 16
RANGE = 1 << BITS
# Slots of a class whose draws are made together.
SLOTS = 1 << 15
# Texts hashed at a time: enough that a step's call costs little beside its work.
CHUNK = 1 << 15
# Bytes of a text that MD5 takes in one block.
ONE_BLOCK = 55
SHIFTS = [7, 12, 17, 22] * 4 + [5, 9, 14, 20] * 4 + [4, 11, 16, 23] * 4 + [6, 10, 15, 21] * 4
SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
# The same as arrays without dimensions, which meet a column faster than numbers do.
LEFT, RIGHT = ([np.array(abs(x - s), np.uint32) for s in SHIFTS] for x in (0, 32))
ADDED = [np.array(x, np.uint32) for x in SINES]
START = [0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476]


def _leading(words: Sequence[np.ndarray | int], bits: np.ndarray | int) -> np.ndarray:
    """First 52 bits of the MD5 of texts of one padded block each, from its first words and the
    length in bits; what all texts share is a number."""
    n = next(len(w) for w in words if isinstance(w, np.ndarray))
    a, b, c, d = (np.full(n, x, np.uint32) for x in START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f)
            np.bitwise_and(f, b, out=f)
            np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_and(f, d, out=f)
            np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f)
            np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f)
            np.bitwise_or(f, b, out=f)
            np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        word = words[g] if g < len(words) else bits if g == 14 else 0
        if isinstance(word, np.ndarray):
            np.add(f, word, out=f)
            word = 0
        np.add(f, np.array((SINES[i] + word) & 0xFFFFFFFF, np.uint32) if word else ADDED[i], out=f)
        np.left_shift(f, LEFT[i], out=t)
        np.right_shift(f, RIGHT[i], out=f)
        np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        # What was a is free to take the next step's sum.
        a, b, c, d, f = d, f, b, c, a
    first, second = (a + np.uint32(START[0])).byteswap(), (b + np.uint32(START[1])).byteswap()
    return (first.astype(np.int64) << 20) | (second >> np.uint32(12))


def _tail_words(own: Sequence[bytes], sizes: np.ndarray, at: int) -> list[np.ndarray]:
    """Words of padded blocks in which each text has ``at`` zero bytes before it."""
    longest = int(sizes.max())
    block = np.zeros((len(own), 4 * ((at + longest) // 4 + 1)), np.uint8)
    # Text arrays fill up with zeros, as a block does.
    block[:, at : at + longest] = np.array(own, f"S{max(longest, 1)}").view(np.uint8).reshape(len(own), -1)[:, :longest]
    block[np.arange(len(own)), at + sizes] = 0x80
    return list(np.ascontiguousarray(block.view("<u4").T))


def numbers(prefixes: Sequence[bytes], tails: Sequence[bytes]) -> np.ndarray:
    """First 13 hex digits of the MD5 of each prefix + tail: one row per prefix."""
    found = np.empty((len(prefixes), len(tails)), np.int64)
    for at in range(0, len(tails), CHUNK):
        own = tails[at : at + CHUNK]
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        far = np.flatnonzero(sizes + max(map(len, prefixes)) > ONE_BLOCK).tolist()
        short = list(own)
        for i in far:
            short[i] = b""
        sizes[far] = 0
        shared = None
        for j, prefix in enumerate(prefixes):
            # Prefixes of one length differ in the first words only.
            if shared is None or shared[0] != len(prefix):
                bits = (8 * (sizes + len(prefix))).astype(np.uint32)
                shared = len(prefix), _tail_words(short, sizes, len(prefix)), bits if bits.min() < bits.max() else int(bits[0])
            whole = len(prefix) // 4
            words = [int.from_bytes(prefix[4 * i : 4 * i + 4], "little") for i in range(whole)] + shared[1][whole:]
            if len(prefix) % 4:
                words[whole] = words[whole] | np.uint32(int.from_bytes(prefix[4 * whole :], "little"))
            found[j, at : at + len(own)] = _leading(words, shared[2])
            for i in far:
                found[j, at + i] = int(hashlib.md5(prefix + own[i]).hexdigest()[:13], 16)
    return found


def poisson_steps(bits: int = 52) -> list[int]:
    """Where the weight grows by one on a scale of ``2 ** bits``: the distribution
    function of a Poisson variable of mean 1, as far as the scale can tell."""
    steps, total, term, k = [], 0.0, math.exp(-1), 0
    while not steps or steps[-1] < 2**bits - 1:
        total += term
        k += 1
        term /= k
        steps.append(min(int(total * 2**bits), 2**bits - 1))
    return steps


def block_prefixes(block: int, replicates: int) -> list[bytes]:
    """How the texts of a block's replicates begin."""
    first = block * WIDTH + 1
    return [b"%d|" % r for r in range(first, min(first + WIDTH, replicates + 1))]


def drawn_places(sizes: dict[int, int], labels: dict[int, str], replicates: int, seed: int) -> Callable:
    """For ``mapInArrow`` over (y, block, first): the draws of ``SLOTS`` slots from ``first`` on.

    Out come (y, range, block, draws), one row per range of ``RANGE`` indexes that is hit:
    how many draws each replicate has there, then their places in the range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, tails = None, []
        for batch in batches:
            for y, block, first in zip(*(column.to_pylist() for column in batch.columns)):
                # The blocks of the same slots follow each other.
                if (y, first) != owner:
                    owner, form = (y, first), f"{labels[y]}|%d|{seed}".encode()
                    tails = [form % slot for slot in range(first, min(first + SLOTS, sizes[y]))]
                index = numbers(block_prefixes(block, replicates), tails).view(np.uint64)
                # A quotient by one number is taken in columns, a remainder is not.
                index -= index // np.uint64(sizes[y]) * np.uint64(sizes[y])
                ranges = -(-sizes[y] // RANGE)
                index = index.astype(np.uint32 if ranges * WIDTH * RANGE < 1 << 32 else np.uint64)
                # Range, replicate and place, from the highest bits to the lowest.
                index += (index >> BITS << BITS) * (WIDTH - 1) + (np.arange(len(index), dtype=index.dtype) << BITS)[:, None]
                found = np.sort(index, axis=None)
                ends = np.searchsorted(found, np.arange(ranges * WIDTH + 1, dtype=index.dtype) * RANGE)
                counts = np.diff(ends).astype(np.uint32).reshape(ranges, WIDTH)
                places = (found & (RANGE - 1)).astype(np.uint16)
                hit = np.flatnonzero(counts.any(axis=1))
                bounds = ends[::WIDTH]
                packed = [counts[r].tobytes() + places[bounds[r] : bounds[r + 1]].tobytes() for r in hit]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(hit), y), pa.int32()),
                        pa.array(hit, pa.int64()),
                        pa.array(np.full(len(hit), block), pa.int32()),
                        pa.array(packed, pa.binary()),
                    ],
                    ["y", "range", "block", "draws"],
                )

    return run


class Scores:
    """Rows by model, class, score and given class, to which their weights are added up."""

    def __init__(self, y: np.ndarray, models: dict[str, tuple[np.ndarray, np.ndarray]]) -> None:
        self.models = []
        for name, (p, yhat) in models.items():
            order = np.lexsort((yhat, p, y))
            keys = [column[order] for column in (p, y, yhat)]
            new = np.ones(len(order), bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            place = np.empty(len(order), np.intp)
            place[order] = np.cumsum(new) - 1
            self.models.append((name, place, [k[new] for k in keys]))

    @classmethod
    def read(cls, y: int, packed: Sequence[bytes]) -> Scores:
        """The scores of one class from what ``packed`` made of them."""
        scores = cls.__new__(cls)
        scores.models = []
        for name, place, p, yhat in zip("ab", packed[::3], packed[1::3], packed[2::3]):
            keys = [np.frombuffer(p), np.frombuffer(yhat, np.int32)]
            place = np.frombuffer(place, np.uint16).astype(np.intp)
            scores.models.append((name, place, [keys[0], np.full(len(keys[0]), y, np.int32), keys[1]]))
        return scores

    def packed(self) -> list[bytes]:
        """Of each model: the place of each row among its scores, two bytes each, the scores and given classes."""
        own = ((place.astype(np.uint16), p.astype(np.float64), yhat.astype(np.int32)) for _, place, (p, _, yhat) in self.models)
        return [column.tobytes() for columns in own for column in columns]

    def batch(self, block: int, weights: Sequence[np.ndarray]) -> pa.RecordBatch:
        """One row per (model, p, y, yhat) with the weights of its rows, one column a replicate."""
        doubles = [w.astype(np.float64) for w in weights]
        # Doubles hold sums of whole weights exactly.
        return self._added(block, lambda place, n: [np.bincount(place, w, n) for w in doubles])

    def drawn(self, block: int, places: Iterable[np.ndarray]) -> pa.RecordBatch:
        """The same from the places of the rows that each replicate draws."""
        rows = [own.astype(np.intp) for own in places]
        return self._added(block, lambda place, n: [np.bincount(place[own], minlength=n) for own in rows])

    def _added(self, block: int, sums_of: Callable) -> pa.RecordBatch:
        parts = []
        for name, place, keys in self.models:
            sums = np.array(sums_of(place, len(keys[0]))).astype(np.int64)
            met = sums.any(axis=0)
            n = int(met.sum())
            p, y, yhat = (k[met] for k in keys)
            columns = [np.full(n, block, np.int32), pa.repeat(name, n), p, y, yhat, *sums[:, met]]
            types = [pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.int32(), *[pa.int64()] * WIDTH]
            parts.append(pa.table([pa.array(c, t) for c, t in zip(columns, types)], names=SCORE_COLUMNS))
        return pa.concat_tables(parts).combine_chunks()


SCORED = ["y", "p_a", "yhat_a", "p_b", "yhat_b"]
SCORE_COLUMNS = ["block", "model", "p", "y", "yhat", *(f"w{j}" for j in range(WIDTH))]
SCORE_SCHEMA = "block int, model string, p double, y int, yhat int, " + ", ".join(f"w{j} long" for j in range(WIDTH))
PACKED = [f"{column}_{m}" for m in "ab" for column in ("places", "scores", "called")]
PACKED_SCHEMA = "y int, range long, " + ", ".join(f"{name} binary" for name in PACKED)


def range_scores(y: int, table: pa.Table) -> Scores:
    """Scores of the rows (idx, p_a, yhat_a, p_b, yhat_b) of a range, by their place in it."""
    at = np.argsort(np.asarray(table["idx"]) % RANGE)
    columns = {c: np.asarray(table[c])[at] for c in SCORED[1:]}
    return Scores(np.full(len(at), y, np.int32), {m: (columns[f"p_{m}"], columns[f"yhat_{m}"]) for m in "ab"})


def pack_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For ``mapInArrow`` over (y, range, idx, p_a, yhat_a, p_b, yhat_b), sorted by y and range:
    one row a range with its packed scores."""
    owner: tuple | None = None
    rows: list[pa.RecordBatch] = []

    def packed() -> pa.RecordBatch:
        own = range_scores(owner[0], pa.Table.from_batches(rows)).packed()
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * len(PACKED)]
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip([*owner, *own], kinds)], ["y", "range", *PACKED])

    for batch in batches:
        keys = np.stack([np.asarray(batch.column(i)) for i in range(2)])
        ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, end in zip([0, *ends], ends):
            if start == end:
                continue
            group = tuple(keys[:, start].tolist())
            if rows and group != owner:
                yield packed()
                rows = []
            owner = group
            rows.append(batch.slice(start, end - start))
    if rows:
        yield packed()


def count_draws(sizes: dict[int, int], labels: dict[int, str], replicates: int, seed: int) -> Callable:
    """For ``mapInArrow`` over (y, range, packed scores, first, stop, block, until): all ranges
    of a class meet the draws of its slots from ``first`` to ``stop`` in these blocks.

    Draws are made where they are counted and stay in their task, two bytes each.
    """
    made = drawn_places(sizes, labels, replicates, seed)

    def drawn(y: int, first: int, stop: int, block: int, until: int) -> dict[int, list[tuple[int, bytes]]]:
        """By range: block and draws, in the order of blocks."""
        wanted = [(y, now, start) for start in range(first, stop, SLOTS) for now in range(block, until)]
        found: dict[int, list[tuple[int, bytes]]] = {}
        for out in made(iter([pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*wanted)], ["y", "block", "first"])])):
            for place, now, draws in zip(*(out[c].to_pylist() for c in ("range", "block", "draws"))):
                found.setdefault(place, []).append((now, draws))
        return {place: sorted(draws, key=lambda x: x[0]) for place, draws in found.items()}

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units: dict[tuple, dict[int, list[tuple[int, bytes]]]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                y, place, *rest = (row[c][0].as_py() for c in ("y", "range", *UNIT))
                unit = (y, *rest)
                if unit not in units:
                    units[unit] = drawn(*unit)
                blocks, draws = zip(*units[unit].pop(place)) if place in units[unit] else ((), ())
                own = [pa.array([x] * (1 + len(blocks))) for x in (y, place, rest[0])]
                keys = [*own, pa.array([-1, *blocks]), pa.array([None, *draws], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(k[:1] for k in keys), *row.select(PACKED).columns], [*MET, *PACKED])
                yield pa.RecordBatch.from_arrays([k[1:] for k in keys], MET)
        if any(units.values()):
            raise ValueError("draws without their rows")

    return lambda batches: add_up_draws(met(batches))


MET = ["y", "range", "part", "block", "draws"]
UNIT = ["first", "stop", "block", "until"]


def add_up_draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (y, range, part, block, draws) and, where block is -1, the rows of the range: idx, p_a,
    yhat_a, p_b, yhat_b, or all packed in one.

    By y, range and part, the rows of the range come first; the draws follow by block. Their
    places are counted, a block at a time.
    """
    owner: tuple | None = None
    rows: list[pa.RecordBatch] = []
    scores: Scores | None = None
    block, held = -1, []

    def counted() -> pa.Table:
        nonlocal held
        packed = [np.frombuffer(draws, np.uint16, offset=4 * WIDTH) for draws in held]
        ends = [[0, *np.frombuffer(draws, np.uint32, WIDTH).cumsum().tolist()] for draws in held]
        held = []
        drawn = (np.concatenate([p[e[j] : e[j + 1]] for p, e in zip(packed, ends)]) for j in range(WIDTH))
        return scores.drawn(block, drawn)

    for batch in batches:
        keys = [np.asarray(batch.column(i)) for i in range(4)]
        changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        for start, end in zip(np.r_[0, np.flatnonzero(changes) + 1], np.r_[np.flatnonzero(changes) + 1, batch.num_rows]):
            if start == end:
                continue
            *group, now = (int(k[start]) for k in keys)
            if held and (tuple(group) != owner or now != block):
                yield from counted().to_batches()
            part = batch.slice(start, end - start)
            if tuple(group) != owner:
                owner, rows, scores = tuple(group), [], None
            block = now
            if now < 0:
                rows.append(part)
                continue
            if scores is None:
                table = pa.Table.from_batches(rows)
                if PACKED[0] in table.column_names:
                    scores = Scores.read(owner[0], [table[c][0].as_py() for c in PACKED])
                else:
                    scores = range_scores(owner[0], table)
                rows = []
            held += [draws.as_py() for draws in part.column(4)]
    if held:
        yield from counted().to_batches()


def poisson_weights() -> Callable:
    """Function from 52-bit numbers to Poisson(1) weights, by the leading bits where they tell."""
    steps, shift = np.array(poisson_steps()), 52 - BITS
    first = np.arange(1 << BITS) << shift
    lowest, highest = (np.searchsorted(steps, x, side="right") for x in (first, first + (1 << shift) - 1))
    leading = np.where(lowest == highest, lowest, -1).astype(np.int8)

    def weights(found: np.ndarray) -> np.ndarray:
        taken = leading[found >> shift]
        unclear = taken < 0
        taken[unclear] = np.searchsorted(steps, found[unclear], side="right")
        return taken

    return weights


def add_up_weights(replicates: int, part_blocks: int | None = None) -> Callable:
    """For ``mapInArrow`` over (tail, y, p_a, yhat_a, p_b, yhat_b): seeded Poisson(1) weights of
    the rows, added up by score for some ``RANGE`` rows at a time.

    With ``part_blocks``, (range, part) follow and rows come in their order: a part is so many
    blocks of replicates, and the rows of a range are added up together for it.
    """
    weights, blocks = poisson_weights(), -(-replicates // WIDTH)

    def summed(rows: list[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(rows)
        tails = [tail.encode() for tail in table["tail"].to_pylist()]
        columns = {c: np.asarray(table[c]) for c in SCORED}
        scores = Scores(columns["y"], {m: (columns[f"p_{m}"], columns[f"yhat_{m}"]) for m in "ab"})
        first = part * (part_blocks or blocks)
        for block in range(first, min(first + (part_blocks or blocks), blocks)):
            drawn = weights(numbers(block_prefixes(block, replicates), tails))
            # The last block may have fewer replicates.
            yield from scores.batch(block, [*drawn, *np.zeros((WIDTH - len(drawn), len(tails)))]).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, rows = (0, 0), []
        for batch in batches:
            keys = np.zeros((2, batch.num_rows), np.int64)
            if part_blocks:
                keys[:] = [np.asarray(batch[c]) for c in ("range", "part")]
            ends = [*(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for start, end in zip([0, *ends], ends):
                if start == end:
                    continue
                group = tuple(keys[:, start].tolist())
                if rows and (group != owner or sum(r.num_rows for r in rows) >= 2 * RANGE):
                    yield from summed(rows, owner[1])
                    rows = []
                owner = group
                rows.append(batch.slice(start, end - start))
        if rows:
            yield from summed(rows, owner[1])

    return run
