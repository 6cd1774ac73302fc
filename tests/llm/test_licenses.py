"""License scan against a plain search of all windows, and the anchors' guarantee."""

from __future__ import annotations

import random
import re

import pytest

from stayrate.llm import licenses


def plain(text):
    return [w for w in re.split(r"[^0-9a-z\x80-\U0010ffff]+", (text or "").lower()) if w]


def grams(words, size=5):
    return {" ".join(words[i : i + size]) for i in range(len(words) - size + 1)}


def class_of(classes, template):
    """Class of a template, the words of its shingles, and the shingles."""
    size = min(5, len(plain(template)))
    wanted = grams(plain(template), size) if size else set()
    return next((c for c in classes if (c.shingle, c.number % 100) == (size, len(wanted).bit_length())), None), size, wanted


def brute(rows, templates, share=0.8):
    """Largest share in any window of the template's class, for each pair."""
    classes = licenses.size_classes(templates)
    found = {}
    for i, text in rows:
        words = plain(text)
        for name, template in templates:
            c, size, wanted = class_of(classes, template)
            if not wanted:
                continue
            best = max((len(grams(words[s : s + c.window + size - 1], size) & wanted) / len(wanted) for s in range(0, max(1, len(words)), c.stride)), default=0)
            if best >= share - 1e-9:
                found[(i, name)] = max(best, found.get((i, name), 0))
    return found


def corpus():
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)] + ["license", "software", "the", "É"]
    rows = []
    for i in range(150):
        words = rng.choices(vocabulary, k=rng.choice([0, 4, 60, 300]))
        for _ in range(rng.choice([0, 1, 2])):
            part = rng.choice(licenses.TEMPLATES)[1].split()
            change = rng.random()
            if change < 0.3:
                part[rng.randrange(len(part))] = "changed"
            elif change < 0.5:
                at = rng.randrange(len(part))
                part[at:at] = rng.choices(vocabulary, k=2)
            at = rng.randint(0, len(words))
            words[at:at] = part
        sep = rng.choice([" ", "\n", " -- "])
        rows.append((i, sep.join(w.upper() if rng.random() < 0.2 else w for w in words)))
    return rows


def test_scan_equals_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(i, t, 1, "c") for i, t in rows], "doc_id long, text string, class int, license_id string")
    got = licenses.scan(df).collect()
    wanted = brute(rows, licenses.TEMPLATES)
    assert {(r["doc_id"], r["license_id"]): pytest.approx(r["containment"]) for r in got} == wanted
    assert len(got) == len(wanted) > 60
    for r in got:
        words = plain(dict(rows)[r["doc_id"]])
        c, size, wanted_grams = class_of(licenses.size_classes(licenses.TEMPLATES), dict(licenses.TEMPLATES)[r["license_id"]])
        own = grams(words[r["start_word"] : r["start_word"] + c.window + size - 1], size)
        assert len(own & wanted_grams) / len(wanted_grams) == pytest.approx(r["containment"])


def test_no_match_is_possible_without_an_anchor():
    for _, text in licenses.TEMPLATES:
        shingles = licenses.template_shingles(text)
        chosen = licenses.anchors(shingles, 0.8)
        without = [s for s in shingles if not set(s.split()) & chosen]
        assert len(without) < licenses.least_matches(len(shingles), 0.8)


def test_bands_reach_the_promised_chance():
    for c in licenses.size_classes(licenses.TEMPLATES):
        for _, text in licenses.TEMPLATES:
            shingles = licenses.template_shingles(text)
            size = len(shingles)
            if licenses.class_number(shingles) == c.number:
                m = licenses.least_matches(size, 0.8)
                assert (1 - m / (size + c.window - m)) ** c.bands <= licenses.MISS * 1.0001


def test_edges_of_the_tables(spark):
    schema = "doc_id long, text string"
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (None, f"x {mit} y"), (3, mit), (3, mit), (4, "all rights"), (5, "word " * 100_000 + mit)]
    df = spark.createDataFrame(rows, schema)
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(df).collect()}
    assert got == {(None, "MIT-short"), (3, "MIT-short"), (5, "MIT-short")}
    assert licenses.scan(df.where("false")).collect() == []
    assert licenses.scan(df, templates=[]).collect() == []
    few = [("short", "All rights!"), ("none", " . "), ("same", mit), ("again", mit)]
    got = {(r["doc_id"], r["license_id"]) for r in licenses.scan(df, templates=few).collect()}
    assert got == {(4, "short")} | {(i, n) for i in (None, 3, 5) for n in ("same", "again")}


def test_short_templates_are_found_inside_texts(spark):
    rows = [(1, "long text before. All rights reserved. And after it more words."), (2, "// SPDX-License-Identifier: MIT\nint main() { return 0; }"),
            (3, "all rights are reserved"), (4, "x SPDX-License-Identifier: GPL-3.0-or-later y z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r["doc_id"], r["license_id"]) for r in licenses.scan(df).collect()}
    assert found == set(brute(rows, licenses.TEMPLATES)) and {(1, "All-rights-reserved"), (2, "SPDX:MIT"), (4, "SPDX:GPL-3.0-or-later")} <= found
    assert not any(i == 3 for i, _ in found)


def test_every_reserved_line_of_the_documents_is_reported(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    wanted = {r["doc_id"] for r in docs.where("text LIKE '%All rights reserved.%'").collect()}
    found = {r["doc_id"] for r in licenses.scan(docs).where("license_id = 'All-rights-reserved'").collect()}
    assert wanted and wanted <= found
