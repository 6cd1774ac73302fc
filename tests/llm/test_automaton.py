"""Backoff automaton against a dictionary automaton walked word by word."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from stayrate.llm import automaton

TEXTS = [
    (1, "The cat sat on the mat"),
    (2, "the cat\tsat on the hat\nthe end"),
    (3, None),
    (4, ""),
    (5, "unseen words only here"),
    (6, "the the the the"),
    (7, "É accent É accent"),
    (8, "the cat sat on the mat"),
    (10, "cat"),
    (10, "cat"),
    (None, "the cat sat"),
    (19, "on the mat the cat sat " * 40),
]


def train_row(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 != 0


def words(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in (text or ""))
    return [w for w in lowered.replace("\t", " ").replace("\n", " ").split(" ") if w] + ["</s>"]


def walk(rows, order, backoff):
    grams = Counter()
    for doc_id, text in rows:
        if train_row(doc_id):
            seq = ["<s>", *words(text)]
            for i in range(len(seq)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        grams[tuple(seq[i - k + 1 : i + 1])] += 1
    single = {g[0]: c for g, c in grams.items() if len(g) == 1 and g[0] != "<s>"}
    total, size = sum(single.values()), len(single)

    def prob(context, word):
        low = (single.get(word, 0) + 0.1) / (total + 0.1 * (size + 1))
        for k in range(1, len(context) + 1):
            held = context[len(context) - k :]
            if grams[held]:
                low = (1 - backoff) * grams[(*held, word)] / grams[held] + backoff * low
        return low

    out = []
    for _, text in rows:
        state, score, base, known = (("<s>",) if grams[("<s>",)] and order > 1 else ()), 0.0, 0.0, 0
        for w in words(text):
            base += math.log10((single.get(w, 0) + 0.1) / (total + 0.1 * (size + 1)))
            known += single.get(w, 0) > 0
            while state and not grams[(*state, w)]:
                score += math.log10(backoff)
                state = state[1:]
            score += math.log10(prob(state, w))
            state = (*state, w) if single.get(w) else ()
            state = state[max(0, len(state) - order + 1) :] if order > 1 else ()
        out.append((len(words(text)), known, total, base, score))
    return out


@pytest.mark.parametrize("order,block_bytes,bucket_bytes", [(2, 1 << 20, 1 << 20), (2, 200, 300), (3, 400, 500), (1, 1 << 20, 100)])
def test_scores_equal_a_dictionary_walk(spark, order, block_bytes, bucket_bytes):
    docs = spark.createDataFrame([(i, t, "x", 7) for i, t in TEXTS], "doc_id long, text string, block string, score int")
    found = automaton.scores(docs, order=order, backoff=0.4, block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    wanted = sorted(
        ((i, *w) for (i, _), w in zip(TEXTS, walk(TEXTS, order, 0.4))), key=key
    )
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in found), key=key)
    assert len(got) == len(wanted)
    for g, w in zip(got, wanted):
        assert g[:4] == w[:4]
        assert np.allclose(g[4:], w[4:], atol=1e-9)
    assert all(r["held_out"] == (not train_row(r["doc_id"])) for r in found)


def test_probabilities_of_a_state_sum_to_one(spark):
    """All words after one context, and one unknown word."""
    base = [(1, "a b a c a b"), (2, "b a c")]
    assert all(train_row(i) for i, _ in base)
    probes = [(9000 + i, f"a {w}") for i, w in enumerate(["a", "b", "c", "zzz"])]
    docs = spark.createDataFrame([*base, *probes], "doc_id long, text string")
    from pyspark.sql import functions as F

    rows = {r["doc_id"]: r for r in automaton.scores(docs, held_out=F.col("doc_id") >= 9000).collect()}
    only_a = spark.createDataFrame([*base, (9009, "a")], "doc_id long, text string")
    alone = automaton.scores(only_a, held_out=F.col("doc_id") >= 9000).where("doc_id = 9009").first()["score"]
    # p(w | a) = p(a w </s>) / (p(a) p(</s> | w)); sum over w and the end mark
    n, v = 11, 4
    p_end = (2 + 0.1) / (n + 0.1 * (v + 1))
    counts = {"b": 3, "a": 4, "c": 2}
    ends = {"b": 1, "c": 1}
    first = (1 - 0.5) * 1 / 2 + 0.5 * (4 + 0.1) / (n + 0.1 * (v + 1))
    shares = 10**alone / first
    for i, w in enumerate(["a", "b", "c", "zzz"]):
        after = (0.5 * ends.get(w, 0) / counts[w] + 0.5 * p_end) if w in counts else p_end
        shares += 10 ** rows[9000 + i]["score"] / first / after
    assert shares == pytest.approx(1, abs=1e-9)


def test_empty_table_and_no_training_rows(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert automaton.scores(none).collect() == []
    from pyspark.sql import functions as F

    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = automaton.scores(one, held_out=F.lit(True)).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 3)
    assert row["score"] == row["base_score"] == 0
