"""The operators of this package as queries over the test tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from stayrate.llm import archive, automaton, collocations, contamination, graph_search, licenses, merkle, packing, pseudonyms, repeats, sentence_pieces, simhash, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automaton.scores(_table(spark, sf_dir, "documents"))


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.pseudonymise(_table(spark, sf_dir, "documents"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.nearest(_table(spark, sf_dir, "embeddings"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.archive_round_trip(_table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.documents_manifest(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_lm_scores": op1_lm_scores,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_nearest": op3_nearest,
    "op4_decontamination": op4_decontamination,
    "op5_warc": op5_warc,
    "op6_toxicity": op6_toxicity,
    "op7_simhash": op7_simhash,
    "op8_repeats": op8_repeats,
    "op9_packing": op9_packing,
    "op10_licenses": op10_licenses,
    "op11_sentence_pieces": op11_sentence_pieces,
    "op12_collocations": op12_collocations,
    "op13_merkle": op13_merkle,
}
ORACLES = {
    "op4_decontamination": contamination.PAIRS_SQL,
    "op5_warc": archive.ROUND_TRIP_SQL,
    "op12_collocations": collocations.COLLOCATIONS_SQL,
    "op13_merkle": merkle.MANIFEST_SQL,
}
