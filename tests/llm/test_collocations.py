"""Collocations against counting in plain Python, and the summaries' guarantee."""

from __future__ import annotations

import re
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from conftest import rows_of
from stayrate.llm import collocations
from stayrate.llm.queries import op12_collocations


def brute(rows, longest=3, threshold=10, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    f[lang, tuple(words[i : i + k])] += 1
    candidates = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= threshold}
    out = {}
    for (lang, phrase), a in candidates.items():
        longer = [b for (other, more), b in candidates.items() if other == lang and len(more) > len(phrase) and any(more[i : i + len(phrase)] == phrase for i in range(len(more)))]
        if any(100 * b >= 50 * a for b in longer):
            continue
        low = min(
            (1_000_000 * a * a // (f[lang, phrase[:k]] * f[lang, phrase[k:]]), k, f[lang, phrase[:k]], f[lang, phrase[k:]])
            for k in range(1, len(phrase))
        )
        out.setdefault(lang, []).append((-low[0], -a, " ".join(phrase).encode(), low))
    return sorted(
        (lang, rank, p.decode(), -a, low[2], low[3], n[lang], low[0], low[1])
        for lang, found in out.items()
        for rank, (_, a, p, low) in enumerate(sorted(found)[:top], 1)
    )


SENTENCES = [
    ("New York City is big. New York, New York City!", "en"),
    ("the of the of the of the", "en"),
    ("New\tYork \t City", "en"),
    ("deep   learning: deep learning models; deep\nlearning", "en"),
    ("É tudo É tudo bem É tudo", None),
    ("ab\x0bab ab\x0cab ab\rab ab", "de"),
    (None, "de"),
    ("", None),
    (" .,;:!? ", "fr"),
]


def found(spark, rows, **settings):
    docs = spark.createDataFrame([(i, t, lang, "x", "y") for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string, block string, number string")
    return rows_of(collocations.collocations(docs, **settings), "lang", "rank")


@pytest.mark.parametrize("settings", [{}, {"block_bytes": 200, "bucket_bytes": 100}])
def test_against_counting(spark, settings):
    rows = SENTENCES * 6 + [("New York City " * 3000, "en"), ("x y " * 5000, "xx")]
    assert found(spark, rows, **settings) == brute(rows)
    assert found(spark, rows, threshold=2, top=5, **settings) == brute(rows, threshold=2, top=5)


def test_longer_phrases(spark):
    rows = SENTENCES * 4
    assert found(spark, rows, longest=4, threshold=4, block_bytes=300) == brute(rows, longest=4, threshold=4)


def test_no_documents(spark):
    assert found(spark, [(None, "en")]) == []
    assert found(spark, [("alone", None)]) == []


def test_blocks_and_the_order_of_rows_do_not_matter(spark):
    rows = [(f"word{i % 7} follows word{i % 3} and goes on", "en" if i % 3 else "de") for i in range(400)]
    wanted = brute(rows)
    assert wanted and found(spark, rows, block_bytes=500, bucket_bytes=300) == wanted == found(spark, rows[::-1])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 30), max_size=40), max_size=8), st.integers(1, 6))
def test_no_frequent_key_is_lost_and_counters_are_bounded(parts, threshold):
    mass = sum(map(len, parts))
    summary = collocations.Summary(mass // threshold + 1)
    for part in parts:
        keys, counts = np.unique(np.array(part, np.uint64), return_counts=True)
        summary.merge(keys, counts)
        assert len(summary.keys) <= mass // threshold + 1
    totals = Counter(x for part in parts for x in part)
    assert {k for k, c in totals.items() if c >= threshold} <= set(summary.keys.tolist())
    partials = [np.unique(np.array(part, np.uint64), return_counts=True) for part in parts]
    assert collocations.survivors(partials, threshold).tolist() == sorted(k for k, c in totals.items() if c >= threshold)


def test_shared_keys_change_nothing(spark, monkeypatch):
    """With keys of six bits nearly all sequences collide; the result is the same."""
    rows = SENTENCES * 6
    monkeypatch.setattr(collocations, "KEY_BITS", 6)
    assert found(spark, rows, block_bytes=400) == brute(rows)


def test_scores_are_exact_beyond_64_bits(spark):
    cases = [(10**14 + 7, 10**14 + 9, 3 * 10**14 + 1), (10, 10, 10), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (10, 7_000_000_003, 11)]
    df = spark.createDataFrame(cases, "a long, l long, r long")
    scored = df.select("a", "l", "r", collocations.score_of(df.a, df.l, df.r, 1_000_000).alias("s")).collect()
    for a, left, right, s in scored:
        assert s == Fraction(1_000_000 * a * a, left * right).__floor__()


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        wanted = sorted(db.execute(collocations.COLLOCATIONS_SQL).fetchall())
    assert wanted and rows_of(op12_collocations(spark, folder), "lang", "rank") == wanted
