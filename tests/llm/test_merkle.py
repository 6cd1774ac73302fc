"""Merkle manifest against a plain tree, and its SQL."""

from __future__ import annotations

import hashlib
import zlib

import duckdb
import pytest

from conftest import rows_of
from pyspark.sql import functions as F
from stayrate.llm import merkle
from stayrate.llm.queries import op13_merkle

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, g string, id string, low long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row):
    doc_id, text, lang, source, n_chars = row
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append(("before" if other < i else "after", level[other] if other < len(level) else ""))
        i //= 2
    return out


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(r))
    trees = {g: climb([leaf(r) for r in sorted(groups[g], key=key)]) for g in order}
    top = climb([trees[g][-1][0] for g in order])
    out = []
    for place, g in enumerate(order):
        for i, row in enumerate(sorted(groups[g], key=key)):
            steps = path(trees[g], i) + path(top, place)
            doc_id, text, lang, source, n_chars = row
            touched = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
            digest = leaf((doc_id, text, lang, source, n_chars + 1)) if touched and n_chars is not None else leaf(row)
            for side, other in steps:
                digest = sha(other + digest if side == "before" else digest + other)
            root = top[-1][0]
            out.append((doc_id, leaf(row), trees[g][-1][0], root, sha("".join(d for _, d in steps)), digest, digest == root))
    return sorted(out, key=str)


def found(spark, rows):
    docs = spark.createDataFrame([(*r, "q", "w", 1) for r in rows], COLUMNS)
    return sorted((tuple(r) for r in merkle.documents_manifest(docs).collect()), key=str)


HARD = [
    (1, "a text", "en", "web", 6), (2, None, "en", None, None), (3, "", "en", "", 0), (None, "no id", "en", "web", 5), (None, None, None, None, None),
    (4, "é 中", "de", "x", 3), (4, "é 中", "de", "x", 3), (4, "other", "de", "x", 5), (5, "alone", "", "x", 5), (7, "long " * 100000, "fr", "x", 500000),
    (10**15, "big", "fr", "x", 2**62), (-3, "minus", "fr", "x", 1),
]


def test_hard_rows(spark):
    assert found(spark, HARD) == brute(HARD)


@pytest.mark.parametrize("height", [1, 2, 3])
def test_bands(spark, monkeypatch, height):
    """Small buckets: several bands in the groups and over the groups."""
    monkeypatch.setattr(merkle, "HEIGHT", height)
    rows = [(i, f"text {i}", f"l{i % 3}" if i % 4 else "l0", "s", i) for i in range(61)]
    rows += [(100 + i, "x", f"g{i}", "s", 1) for i in range(9)] + HARD
    assert found(spark, rows) == brute(rows)


def test_single_rows(spark):
    one = [(1, "t", None, None, None)]
    assert found(spark, one) == brute(one)
    assert found(spark, []) == []


def test_repeated_rows_and_one_hot_group(spark):
    rows = [(1, "same", "en", "s", 4)] * 5000 + [(i, "t", "en", "s", 1) for i in range(300)]
    assert found(spark, rows) == brute(rows)


def test_a_change_of_any_field_is_found(spark):
    rows = [(i, f"t{i}", "en", "s", i) for i in range(40)]
    before = found(spark, rows)
    assert {r[6] for r in before} == {True, False}
    for place in range(5):
        changed = [list(r) for r in rows]
        changed[11][place] = {0: 99, 1: "x", 2: "de", 3: None, 4: 1}[place]
        assert found(spark, [tuple(r) for r in changed])[0][3] != before[0][3]


def test_nodes_cover_all_ranks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    rows = [(i, f"t{i}", "en" if i % 3 else None, "s", i) for i in range(50)]
    docs = spark.createDataFrame([(*r, "q", "w", 1) for r in rows], COLUMNS)
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    nodes = rows_of(merkle.nodes(docs, fields), "g", "level", "low")
    for g, lang in (("=en", "en"), ("", None)):
        levels = climb([leaf(r) for r in rows if r[2] == lang])
        wanted = [
            (g, j, i * 2**j, min((i + 1) * 2**j, len(levels[0])), digest)
            for j, level in enumerate(levels)
            for i, digest in enumerate(level)
        ]
        assert [n for n in nodes if n[0] == g] == wanted


def test_the_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.001"
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        wanted = sorted(db.execute(merkle.MANIFEST_SQL).fetchall())
    assert wanted and sorted(tuple(r) for r in op13_merkle(spark, folder).collect()) == wanted
