"""Containment search against sets of shingles of all pairs."""

from __future__ import annotations

import random
import re

import duckdb
import pytest

from stayrate.llm import contamination


def plain(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", low)


def shingle_set(text, size=5):
    words = plain(text)
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def brute(docs, items, share=0.8):
    found = set()
    for d, t in docs:
        for i, s in items:
            size = min(5, len(plain(s)))
            own, wanted = (shingle_set(x, size) if size else set() for x in (t, s))
            if wanted and len(wanted & own) / len(wanted) >= share - 1e-12:
                found.add((d, i, len(wanted & own), len(wanted)))
    return found


def cases():
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)] + ["É", "ß"]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([2, 3, 4, 5, 6, 9, 15, 40, 120])))) for i in range(30)]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.choice([3, 50, 400]))
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(items)[1].split()
            if rng.random() < 0.5:  # some words changed: near the threshold on either side
                for at in rng.sample(range(len(part)), max(1, len(part) // 25)):
                    part[at] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part]
        docs.append((d, " ".join(words)))
    scattered = items[7][1].split()
    half = len(scattered) // 2
    docs.append((500, " ".join(scattered[: half + 2] + ["between"] * 30 + scattered[half - 2 :])))
    return docs, items


@pytest.mark.parametrize("block_bytes", [16 << 20, 700])
def test_pairs_equal_brute_force(spark, block_bytes):
    docs, items = cases()
    left = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, item int, key string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.contaminated(left, right, block_bytes=block_bytes).collect()
    wanted = brute(docs, items)
    assert {(r["doc_id"], r["item_id"], r["matched"], r["n_shingles"]) for r in got} == wanted
    assert len(got) == len(wanted) > 40
    kept = contamination.drop_contaminated(left, right, block_bytes=block_bytes)
    assert kept.columns == left.columns
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {w[0] for w in wanted}


def test_short_items_are_found_inside_long_texts(spark):
    docs = spark.createDataFrame([(1, "x y z alpha beta gamma w v u q r s"), (2, "alpha beta"), (3, "beta gamma alpha"), (4, "Alpha, beta: GAMMA!")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "alpha beta gamma"), (8, "u")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in contamination.contaminated(docs, items).collect()}
    assert got == {(1, 7), (1, 8), (4, 7)}


def test_the_query_equals_its_sql_with_short_items(spark, tmp_path):
    docs, items = cases()
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame([*items, (90, "Two, words"), (91, "two words"), (92, None)], "item_id long, text string")
    with duckdb.connect() as db:
        for name, df in (("documents", left), ("benchmark", right)):
            df.write.parquet(f"{tmp_path}/{name}")
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}/*.parquet'")
        wanted = {(r[0], r[1], r[2], r[3], r[4]) for r in db.execute(contamination.PAIRS_SQL).fetchall()}
    got = {tuple(r)[:5] for r in contamination.contaminated(left, right).collect()}
    assert got == wanted and len(got) > 40


def test_edges_of_the_tables(spark):
    docs = [(1, None), (2, ""), (3, "two words"), (None, "one two three four five"), (4, "two words more than five in all"), (4, "two words more than five in all")]
    items = [(10, "Two, words!"), (11, None), (12, ""), (13, "one two three four five"), (9, "ONE two three four five"), (None, "two words")]
    left = spark.createDataFrame(docs, "doc_id long, text string")
    right = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_items"]) for r in contamination.contaminated(left, right).collect()}
    assert got == {(3, 10, 2), (4, 10, 2), (None, 9, 2)}
    assert contamination.contaminated(left.where("false"), right).collect() == []
    assert contamination.contaminated(left, right.where("false")).collect() == []
    assert contamination.drop_contaminated(left, right.where("false")).count() == 6
    long_item = " ".join(f"x{i}" for i in range(60))
    long_text = " ".join(f"y{i % 991}" for i in range(400_000)) + " " + long_item
    got = contamination.contaminated(spark.createDataFrame([(1, long_text)], "doc_id long, text string"), spark.createDataFrame([(1, long_item)], "item_id long, text string"))
    assert got.first()["matched"] == 56
