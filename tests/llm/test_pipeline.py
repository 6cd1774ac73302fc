"""The pipeline stage by stage against plain versions of each decision."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from stayrate.llm import contamination, packing, toxicity
from stayrate.session import stage
from test_contamination import brute as contaminated
from test_near_copies import brute_kept

SF_DIR = "/root/testdata/sf0.001"
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def steps(spark):
    """What each stage was given and what it kept."""
    docs, found = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, apply in corpus_pipeline.STAGES:
        out = stage(apply(spark, docs, SF_DIR), name)
        found[name] = (docs, out)
        docs = out
    return found


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_all_but_the_last_return_documents(steps):
    names = list(steps)
    assert names == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    for name in names[:-1]:
        given, kept = steps[name]
        assert kept.columns == DOCUMENTS and kept.dtypes == given.dtypes


def test_toxic_documents_go_and_clean_ones_stay(spark, steps):
    given, kept = steps["toxicity"]
    model = toxicity.fit(given, spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    rows = toxicity.with_scores(given, model).collect()  # in a column "__score"
    limit = lambda lang: model.thresholds.get(lang, model.thresholds[""])
    assert set(texts(kept)) == {r["doc_id"] for r in rows if r["__score"] < limit(r["lang"])}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    clean = {i for i in texts(given) if labels.get(i) == 0}
    assert len(clean & set(texts(kept))) >= 0.95 * len(clean)


def test_one_document_of_each_class_stays(steps):
    given, kept = (texts(df) for df in steps["near_duplicates"])
    assert len(kept) < len(given) and set(kept) == brute_kept(given)
    assert all(kept[i] == given[i] for i in kept)


def test_documents_with_benchmark_items_go(spark, steps):
    given, kept = (texts(df) for df in steps["decontamination"])
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    hit = {d for d, *_ in contaminated(list(given.items()), items)}
    assert hit and set(kept) == set(given) - hit


def test_personal_values_change_and_nothing_else(steps):
    given, kept = (texts(df) for df in steps["personal_data"])
    assert set(given) == set(kept)
    changed = {i for i in given if given[i] != kept[i]}
    assert changed and all(any(c.isdigit() or c == "@" for c in given[i]) for i in changed)
    for i in changed:
        assert len(given[i].split()) == len(kept[i].split())


def test_every_word_is_packed_once(steps):
    given, bins = steps["packing"]
    wanted = {i: len(t.split()) + 1 for i, t in texts(given).items()}
    placed = {}
    for r in bins.collect():
        placed[r["doc_id"]] = placed.get(r["doc_id"], 0) + r["length"]
        assert r["capacity"] in packing.CAPACITIES
    assert placed == wanted


def test_run_equals_its_stages(spark, steps):
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"]) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF_DIR)) == key(steps["packing"][1])
    assert corpus_pipeline.ORACLE_SQL is None and entry.queries()["pipeline"] is corpus_pipeline.run
    assert {f"op{n}" for n in range(1, 11)} <= {q.split("_")[0] for q in entry.queries()}


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, apply in corpus_pipeline.STAGES:
        docs = stage(apply(spark, docs, SF_DIR), "empty")
    assert docs.count() == 0


def test_item_blocks_are_the_same_as_one(spark, steps):
    given, _ = steps["decontamination"]
    items = spark.read.parquet(f"{SF_DIR}/benchmark.parquet")
    one = contamination.contaminated(given, items).select("doc_id", "item_id")
    many = contamination.contaminated(given, items, block_bytes=1000).select("doc_id", "item_id")
    assert one.exceptAll(many).count() == 0 == many.exceptAll(one).count()
