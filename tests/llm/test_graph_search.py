"""Graph search: recall against brute force, copies, ties and unusable vectors."""

from __future__ import annotations

import math

import numpy as np

from stayrate.llm import graph_search


def brute(rows, k=5, every=50):
    """Rows that take part, as id -> nearest (score, id) by exact cosine."""
    good = {i: np.array(v, float) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, v in good.items():
        if q % every == 0:
            found = [(-float((v * w).sum() / (np.sqrt((v * v).sum()) * np.sqrt((w * w).sum()))), i) for i, w in good.items() if i != q and len(w) == len(v)]
            out[q] = sorted(found)[:k]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<double>, rank int, score double")


def test_recall_and_exact_scores(spark):
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((20, 24))
    rows = [(i, (centres[i % 20] + rng.standard_normal(24) * 0.8).tolist()) for i in range(3000)]
    wanted = brute(rows)
    got = {}
    for r in graph_search.nearest(frame(spark, rows), shard_rows=800).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    vectors = {i: np.array(v) for i, v in rows}
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == [1, 2, 3, 4, 5]
        assert all(abs(s - vectors[q] @ vectors[i] / np.linalg.norm(vectors[q]) / np.linalg.norm(vectors[i])) < 1e-12 for _, i, s in found)
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in wanted[q]})
    assert set(got) == set(wanted) and hits >= 0.95 * 5 * len(wanted)


def test_copies_ties_and_unusable_vectors(spark):
    same = [1.0, 2.0, 3.0]
    rows = [(i, same) for i in range(0, 400)] + [(i, [1.0, 2.0, 3.0 + i]) for i in range(400, 420)]
    rows += [(450, None), (500, []), (550, [0.0, 0.0, 0.0]), (600, [1.0, None, 2.0]), (650, [float("nan"), 1.0, 1.0]), (700, [float("inf"), 1.0, 1.0])]
    rows += [(750, [1.0, 0.0]), (751, [0.0, 1.0]), (800, [1e-200, 1e-200, 0.0]), (850, [5.0])]
    got = {}
    for r in graph_search.nearest(frame(spark, rows), shard_rows=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(got) == {0, 50, 100, 150, 200, 250, 300, 350, 400, 750, 800}
    assert sorted(got[0]) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    assert sorted(got[50]) == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    assert sorted(got[750]) == [(1, 751)]


def test_few_rows_and_none(spark):
    assert graph_search.nearest(frame(spark, []).limit(0)).collect() == []
    got = graph_search.nearest(frame(spark, [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])])).collect()
    assert sorted((r["rank"], r["vec_id"]) for r in got) == [(1, 1), (2, 2)]
    assert graph_search.nearest(frame(spark, [(0, [1.0])])).collect() == []
