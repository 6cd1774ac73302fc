"""Repeated units against a plain search with dictionaries, and offsets that restore texts."""

from __future__ import annotations

import random
import re

import pytest
import xxhash

from stayrate.llm import repeats

MIN = 6


def units_of(text):
    """(low, high, key) of each unit, and the words with their character spans."""
    spans = [(m.start(), m.end()) for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]
    low = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
    words = [low(text[a:b]) for a, b in spans]
    ends = [
        i for i in range(len(words)) if i + 1 == len(words) or "\n" in text[spans[i][1] : spans[i + 1][0]]
    ]
    cuts = [i for i in range(len(words)) if i in set(ends) or xxhash.xxh64_intdigest(words[i].encode()) % repeats.CUT == 0]
    found, start = set(), 0
    for end in ends:
        if end - start + 1 >= MIN:
            found.add((start, end))
        start = end + 1
    for at in [0, *(c + 1 for c in cuts)]:
        end = next((c for c in cuts if c >= at + MIN - 1), None)
        if at < len(words) and end is not None:
            found.add((at, end))
    return [(a, b, tuple(words[a : b + 1])) for a, b in sorted(found)], words, spans


def brute(rows):
    """Kept words of each row by (rank, place): a unit that is not the earliest of its words
    goes, but for the words it shares with that earliest one. Rows have distinct ids."""
    order = sorted(rows, key=lambda r: r[0])
    first = {}
    for i, text in order:
        for a, b, key in units_of(text)[0]:
            first.setdefault(key, (i, a))
    out = {}
    for i, text in rows:
        units, words, spans = units_of(text)
        gone = set()
        for a, b, key in units:
            where, at = first[key]
            if (where, at) != (i, a):
                gone |= set(range(a, b + 1)) - (set(range(at, at + len(key))) if where == i else set())
        out[i] = [w not in gone for w in range(len(words))]
    return out


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(2000)] + ["Été", "ÑU"]
    passages = [rng.choices(vocabulary, k=60) for _ in range(4)]
    lines = [" ".join(rng.choices(vocabulary, k=rng.choice([2, 5, 9, 20]))) for _ in range(6)]
    rows = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([0, 10, 150]))
        if rng.random() < 0.5:
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        text = " ".join(w + rng.choice(["", "", ".", ","]) for w in words)
        if rng.random() < 0.5:
            text += "\n" + rng.choice(lines) + "\n" + rng.choice(lines)
        rows.append((i, text))
    rows.append((60, "lyon " * 120))
    rows.append((61, rows[3][1]))
    return rows, passages


@pytest.mark.parametrize("block_bytes,bucket_bytes", [(8 << 20, 128 << 20), (1500, 2000)])
def test_kept_words_equal_brute_force(spark, block_bytes, bucket_bytes):
    rows, passages = corpus()
    df = spark.createDataFrame([(i, t, 1, "r") for i, t in rows], "doc_id long, text string, block int, rank string")
    got = repeats.remove_repeats(df, min_words=MIN, block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
    wanted, texts = brute(rows), dict(rows)
    assert len(got) == len(rows)
    for r in got:
        text, keep = texts[r["doc_id"]], wanted[r["doc_id"]]
        spans = [(s["start"], s["end"]) for s in r["spans"]]
        rest, at = "", 0
        for a, b in spans:
            rest += text[at:a]
            at = b
        assert r["text"] == rest + text[at:]
        words = units_of(text)[2]
        assert [not any(a <= w[0] and w[1] <= b for a, b in spans) for w in words] == keep
        assert r["n_removed"] == keep.count(False) and r["n_words"] == len(keep)
    assert sum(r["n_removed"] for r in got) > 300


def test_passages_inside_lines_go_from_all_but_the_first(spark):
    rng = random.Random(8)
    words = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    passage = words(55)
    rows = [(i, " ".join([*words(40), *passage, *words(40)])) for i in range(40)]
    clean = [(100 + i, " ".join(words(100))) for i in range(40)]
    got = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows + clean, "doc_id long, text string")).collect()}
    assert got[0]["n_removed"] == 0
    assert all(35 <= got[i]["n_removed"] <= 55 for i in range(1, 40))
    assert all(got[100 + i]["n_removed"] == 0 and got[100 + i]["spans"] == [] for i in range(40))


def test_a_copy_does_not_shield_what_stands_earlier_elsewhere(spark):
    """P is in A; B holds P inside a line; C copies B: B loses P whether C is there or not."""
    rng = random.Random(12)
    words = lambda n: [f"q{rng.getrandbits(40)}" for _ in range(n)]
    passage = words(30)
    b = " ".join([*words(12), *passage, *words(12)])
    rows = [(1, " ".join(passage)), (2, b), (3, b)]
    for given in (rows, rows[:2]):
        got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(spark.createDataFrame(given, "doc_id long, text string")).collect()}
        assert got[1] == 0 and 26 <= got[2] <= 30 and got.get(3, 54) == 54
    assert {i: k.count(False) for i, k in brute(rows).items()}[2] > 0


def test_edges_of_the_table(spark):
    schema = "doc_id long, text string"
    assert repeats.remove_repeats(spark.createDataFrame([], schema)).collect() == []
    same = " ".join(f"v{i}" for i in range(30))
    rows = [(1, None), (2, ""), (None, same), (5, same), (5, same), (3, "short line\nshort line\nshort line")]
    got = [tuple(r)[:4] for r in repeats.remove_repeats(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(n for i, t, w, n in got if i == 5) == [0, 30]
    assert [n for i, t, w, n in got if i is None] == [30]
    assert (1, None, 0, 0) in got and (2, "", 0, 0) in got and (3, rows[5][1], 6, 0) in got
    ranked = spark.createDataFrame([(1, same, 9), (2, same, 3), (3, same, None)], schema + ", score int")
    got = {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(ranked, rank_col="score").collect()}
    assert got == {1: 30, 2: 0, 3: 30}
    long_text = " ".join(f"z{i}" for i in range(300_000))
    got = repeats.remove_repeats(spark.createDataFrame([(1, long_text), (2, long_text)], schema)).collect()
    assert {r["doc_id"]: r["n_removed"] for r in got} == {1: 0, 2: 300_000}
