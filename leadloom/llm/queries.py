"""The queries of this package's operators, each over its whole table, and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.llm import (
    bpe_rounds, graph_search, imatch, merkle, oracles, packing, parity_join, periodic, pfor, prefix_free, separators, toxicity,
    url_filter, zquality)
from leadloom.llm.common import table, texts


def _classified(scored: DataFrame, fold: int, folds: int) -> DataFrame:
    return scored.select("doc_id", F.coalesce(toxicity.held_out(fold, folds), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op1_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), "toxic", fold=1, folds=3)
    return _classified(toxicity.score(texts(docs), model), 1, 3)


def op2_parity_join(spark, sf_dir):
    return parity_join.similar_classes(table(spark, sf_dir, "documents"), words=3, percent=90)


def op3_imatch(spark, sf_dir):
    return imatch.fingerprint_edits(table(spark, sf_dir, "documents"))


def op4_pfor_files(spark, sf_dir):
    return pfor.encode_to_files(table(spark, sf_dir, "documents"), end_id=2)


def op5_separator_scan(spark, sf_dir):
    return separators.count_tokens(table(spark, sf_dir, "documents"))


def op6_graph_search(spark, sf_dir):
    return graph_search.nearest(table(spark, sf_dir, "embeddings"), k=10, query_step=100)


def op7_zstd_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = zquality.fit(docs, table(spark, sf_dir, "labels"), "quality", fold=2, folds=4)
    return _classified(zquality.score(texts(docs), model), 2, 4)


def op8_prefix_free(spark, sf_dir):
    return prefix_free.removal_digest(table(spark, sf_dir, "documents"), length=100)


def op9_packing(spark, sf_dir):
    return packing.pack_digest(table(spark, sf_dir, "documents"), end_id=0)


def op10_bpe_rounds(spark, sf_dir):
    return bpe_rounds.round_trip_digest(table(spark, sf_dir, "documents"))


def op11_url_filter(spark, sf_dir):
    model = url_filter.fit(url_filter.labelled_table(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op12_merkle_witness(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    return merkle.verified_manifest(table(spark, sf_dir, "documents"), tampered)


def op13_periodic_runs(spark, sf_dir):
    return periodic.run_digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), edit=periodic.plant_period))


QUERIES = {q.__name__: q for q in (
    op1_toxicity, op2_parity_join, op3_imatch, op4_pfor_files, op5_separator_scan, op6_graph_search, op7_zstd_quality,
    op8_prefix_free, op9_packing, op10_bpe_rounds, op11_url_filter, op12_merkle_witness, op13_periodic_runs)}

ORACLES: dict[str, str] = oracles.ORACLES
