"""Fingerprints and covering components against brute force over all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stayrate.llm import simhash
from stayrate.llm.components import components


def slow_fingerprint(text) -> int:
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in low).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def slow_components(marks: dict, radius: int) -> dict:
    """Smallest key reachable; marks: key -> fingerprint."""
    root = {k: k for k in marks}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(marks)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if (marks[a] ^ marks[b]).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: find(k) for k in keys}


def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)] + ["ÄRGER", "naïve", "A", "Z.z"]
    found = {}
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 4, 30, 200]))
        found[len(found)] = " ".join(words)
        for _ in range(rng.choice([0, 0, 1, 4])):
            near = list(words)
            near[rng.randrange(len(near))] = "changed"
            found[len(found)] = "\t".join(near).upper() if rng.random() < 0.3 else "  \n".join(near)
    found[len(found)] = None
    found[len(found)] = ""
    found[len(found)] = " \n\t "
    found[len(found)] = found[0]
    return found


def test_near_duplicates_equal_brute_force(spark):
    docs = texts()
    df = spark.createDataFrame([(i, t, "x", 1.5) for i, t in docs.items()], "doc_id long, text string, fp string, component_id double")
    marks = {i: slow_fingerprint(t) for i, t in docs.items()}
    wanted = slow_components(marks, 4)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df).collect()}
    assert {i: r["fingerprint"] for i, r in got.items()} == {i: f"{m:016x}" for i, m in marks.items()}
    assert {i: r["component_id"] for i, r in got.items()} == wanted


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_masks_cover_every_pair_within_the_radius(radius):
    masks = simhash.covering_masks(radius)
    assert len(masks) == 2 ** (radius + 1) - 1
    rng = random.Random(radius)
    for _ in range(3000):
        change = sum(1 << b for b in rng.sample(range(64), radius))
        assert any(change & m == 0 for m in masks)


@pytest.mark.parametrize("bucket_rows", [3, 10, 100_000])
def test_links_connect_dense_groups_in_blocks(spark, bucket_rows):
    """A chain, a ball around one value and strangers; small buckets are cut into blocks."""
    rng = random.Random(1)
    values = {0}
    for a in range(0, 40):
        values.add(1 << a)
    chain = 0xF0F0F0F0F0F0F0F0
    for _ in range(30):
        for b in rng.sample(range(64), 3):
            chain ^= 1 << b
        values.add(chain)
    values |= {rng.getrandbits(64) for _ in range(100)}
    wanted = slow_components({v: v for v in values}, 4)
    signed = [(np.uint64(v).astype(np.int64).item(),) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fp long"), 4, bucket_rows)
    for a, b in links.collect():
        assert ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 4
    roots = {r["node"] & ((1 << 64) - 1): r["root"] & ((1 << 64) - 1) for r in components(links).collect()}
    group = lambda table, v: table.get(v, v)
    by_wanted, by_got = {}, {}
    for v in values:
        by_wanted.setdefault(group(wanted, v), set()).add(v)
        by_got.setdefault(group(roots, v), set()).add(v)
    assert sorted(map(sorted, by_wanted.values())) == sorted(map(sorted, by_got.values()))


def test_edges_of_the_table(spark):
    schema = "doc_id long, text string"
    assert simhash.near_duplicates(spark.createDataFrame([], schema)).collect() == []
    rows = [(None, "same words in a row here"), (7, "same words in a row here"), (7, "same words in a row here"), (None, None), (None, "")]
    df = spark.createDataFrame(rows, schema)
    got = sorted((r["doc_id"] or -1, r["component_id"] or -1) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 7), (7, 7), (7, 7)]
    long_text = " ".join(f"v{i % 977}" for i in range(150_000))
    got = simhash.near_duplicates(spark.createDataFrame([(1, long_text)], schema)).first()
    assert got["fingerprint"] == f"{slow_fingerprint(long_text):016x}"


def test_components_of_a_long_path(spark):
    n = 300
    path = spark.range(n).select((F.col("id") * 7919 % 1000).alias("a"), ((F.col("id") + 1) * 7919 % 1000).alias("b"))
    roots = components(path).collect()
    nodes = {(i * 7919) % 1000 for i in range(n + 1)}
    assert {r["node"] for r in roots} == nodes - {min(nodes)} and {r["root"] for r in roots} == {min(nodes)}
