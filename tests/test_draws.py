"""Batches of draws against hashlib, with small ranges and blocks of slots."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from stayrate.operators import draws as D


def number(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:13], 16)


def test_numbers_of_texts_of_any_length():
    prefixes = [f"{r}|" for r in (1, 9, 10, 999, 2000)]
    tails = ["", "42", "é|42", *(f"1|{i}|42" for i in range(0, 3000, 7)), *("x" * n for n in range(48, 70))]
    found = D.numbers([p.encode() for p in prefixes], [t.encode() for t in tails])
    assert found.tolist() == [[number(p + t) for t in tails] for p in prefixes]


def added(batches):
    """(replicate, model, p, y, yhat) to its weight."""
    total = Counter()
    for batch in batches:
        for row in batch.to_pylist():
            for j in range(D.WIDTH):
                total[row["block"] * D.WIDTH + j + 1, row["model"], row["p"], row["y"], row["yhat"]] += row[f"w{j}"]
    return {k: v for k, v in total.items() if v}


def rows_of(n):
    rng = np.random.default_rng(3)
    p = {m: np.round(rng.random(n), 1) for m in "ab"}
    return p, {m: (p[m] >= 0.5).astype(np.int32) for m in "ab"}


@pytest.mark.parametrize("bits, slots", [(3, 16), (5, 7), (16, 1 << 15)])
def test_draws_are_counted_by_range(monkeypatch, bits, slots):
    monkeypatch.setattr(D, "BITS", bits)
    monkeypatch.setattr(D, "RANGE", 1 << bits)
    monkeypatch.setattr(D, "SLOTS", slots)
    sizes, replicates = {0: 45, 1: 70}, 20
    data = {y: rows_of(n) for y, n in sizes.items()}
    units = [(y, block, first) for y, n in sizes.items() for block in (0, 1) for first in range(0, n, slots)]
    batch = pa.table([pa.array(c) for c in zip(*units)], names=["y", "block", "first"]).to_batches()
    made = D.drawn_places(sizes, {0: "0", 1: "1"}, replicates, 42)(iter(batch))
    blank = dict.fromkeys(("draws", "idx", "p_a", "yhat_a", "p_b", "yhat_b"))
    met = [{"part": 0, **blank, **row} for b in made for row in b.to_pylist()]
    for y, (p, yhat) in data.items():
        scored = lambda i: {f"{k}_{m}": v[m][i].item() for m in "ab" for k, v in (("p", p), ("yhat", yhat))}
        met += [{**blank, "y": y, "range": i >> bits, "part": 0, "block": -1, "idx": i, **scored(i)} for i in reversed(range(sizes[y]))]
    names = ["y", "range", "part", "block", *blank]
    met.sort(key=lambda r: [r[n] for n in names[:4]])
    table = pa.table({n: [r[n] for r in met] for n in names})
    expected = Counter()
    for replicate in range(1, replicates + 1):
        for y, n in sizes.items():
            for slot in range(n):
                i = number(f"{replicate}|{y}|{slot}|42") % n
                for m in "ab":
                    expected[replicate, m, data[y][0][m][i], y, data[y][1][m][i]] += 1
    for size in (3, 1000):
        assert added(D.add_up_draws(table.to_batches(max_chunksize=size))) == expected


def test_weights_are_those_of_each_row(monkeypatch):
    monkeypatch.setattr(D, "RANGE", 25)
    p, yhat = rows_of(60)
    y = np.arange(60, dtype=np.int32) % 2
    # The tail of a row without id is the seed alone.
    tails = ["42", *(f"{'long' * i}r{i}|42" for i in range(1, 60))]
    table = pa.table({"tail": tails, "y": y, "p_a": p["a"], "yhat_a": yhat["a"], "p_b": p["b"], "yhat_b": yhat["b"]})
    expected = Counter()
    for replicate in range(1, 21):
        for i, tail in enumerate(tails):
            weight = sum(step <= number(f"{replicate}|{tail}") for step in D.poisson_steps())
            for m in "ab":
                expected[replicate, m, p[m][i], y[i], yhat[m][i]] += weight
    assert added(D.add_up_weights(20)(iter(table.to_batches(max_chunksize=10)))) == {k: v for k, v in expected.items() if v}


def test_texts_of_all_lengths_are_hashed_together(monkeypatch):
    calls, real = [], D._leading

    def counted(*args):
        calls.append(1)
        return real(*args)

    monkeypatch.setattr(D, "_leading", counted)
    tails = [b"%d|42" % 10 ** (i % 9) for i in range(90)]
    found = D.numbers([b"1|", b"20|", b"21|"], tails)
    assert len(calls) == 3
    assert found.tolist() == [[number(p + t.decode()) for t in tails] for p in ("1|", "20|", "21|")]


def test_draws_meet_packed_ranges_in_their_task(monkeypatch):
    """A task draws some slots for some blocks; the ranges come in any order, one row each."""
    monkeypatch.setattr(D, "BITS", 4)
    monkeypatch.setattr(D, "RANGE", 16)
    monkeypatch.setattr(D, "SLOTS", 7)
    sizes, replicates = {0: 45, 1: 70}, 40
    data = {y: rows_of(n) for y, n in sizes.items()}
    tables = []
    for y, (p, yhat) in data.items():
        scored = {f"{k}_{m}": v[m] for m in "ab" for k, v in (("p", p), ("yhat", yhat))}
        index = np.arange(sizes[y])[::-1]
        tables.append(pa.table({"y": np.full(sizes[y], y), "range": index // 16, "idx": index} | {c: scored[c][index] for c in D.SCORED[1:]}))
    rows = pa.concat_tables(tables).sort_by([("y", "ascending"), ("range", "ascending")])
    packed = [row for b in D.pack_ranges(iter(rows.to_batches(max_chunksize=9))) for row in b.to_pylist()]
    assert [(r["y"], r["range"]) for r in packed] == [(y, i) for y, n in sizes.items() for i in range(-(-n // 16))]
    expected = Counter()
    for replicate in range(1, replicates + 1):
        for y, n in sizes.items():
            for slot in range(n):
                i = number(f"{replicate}|{y}|{slot}|42") % n
                for m in "ab":
                    expected[replicate, m, data[y][0][m][i], y, data[y][1][m][i]] += 1
    counted, batches = D.count_draws(sizes, {0: "0", 1: "1"}, replicates, 42), []
    units = [(0, 0, 45, 0, 3), *((1, first, min(first + 28, 70), block, until) for first in (0, 28, 56) for block, until in ((0, 1), (1, 3)))]
    for y, *unit in units:
        met = [{**row, **dict(zip(D.UNIT, unit))} for row in reversed(packed) if row["y"] == y]
        batches += counted(iter(pa.Table.from_pylist(met).to_batches(max_chunksize=2)))
    assert added(batches) == expected
    with pytest.raises(ValueError):
        list(counted(iter(pa.Table.from_pylist(met[1:]).to_batches())))
