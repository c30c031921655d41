"""The stages of the corpus pipeline, each against its own input."""

import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from leadloom.llm import queries
from leadloom.llm.graph import written
from test_corpus import jaccard_classes, repeats

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are absent")


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out, _ = written(stage(spark, docs, FOLDER), name)
        kept[name] = (docs, out)
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    for name, label, good in (("quality", "quality", 1), ("toxicity", "toxic", 0)):
        before, after = kept[name]
        known = before.join(labels, "doc_id").join(after.select("doc_id", F.lit(1).alias("stays")), "doc_id", "left").collect()
        right = sum((r.stays == 1) == (r[label] == good) for r in known)
        assert right / len(known) > 0.85
    before, after = kept["near_duplicates"]
    classes = jaccard_classes({r.doc_id: r.text for r in before.collect()}, 5, 80)
    assert {r.doc_id for r in after.collect()} == {i for i, (_, c) in classes.items() if c == i}
    before, after = kept["repeated_passages"]
    removed = repeats({r.doc_id: r.text for r in before.collect()}, 100)
    for r in after.collect():
        assert r.n_chars == len(r.text) and 0 <= removed[r.doc_id][0] - removed[r.doc_id][1] - len(r.text.encode()) < 4 * (removed[r.doc_id][2] + 1)
    before, after = kept["packing"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


def test_rows_without_an_id_and_repeated_rows(spark):
    said = [" ".join(f"{name}{i}" for i in range(60)) for name in "abcde"]
    near = said[0] + " more"
    rows = [(None, said[0])] * 40 + [(None, near)] * 3 + [(7, said[1])] * 40 + [(7, said[2]), (3, said[3]), (2, said[3]), (None, said[3])]
    rows += [(9, near), (8, said[0]), (None, said[4]), (None, said[4]), (None, None), (None, ""), (1, "")]
    docs = spark.createDataFrame([(i, t, len(t or "")) for i, t in rows], "doc_id long, text string, n_chars int").repartition(5)
    out = corpus_pipeline.one_of_each(spark, docs, FOLDER)
    assert out.dtypes == docs.dtypes
    got = sorted(((r.doc_id or 0), r.text or "", r.n_chars) for r in out.collect())
    want = [(8, said[0]), (7, said[1]), (7, said[2]), (2, said[3]), (0, said[4]), (1, "")]
    assert got == sorted((i, t, len(t)) for i, t in want)


def test_odd_tables(spark):
    """No rows; columns with names that the operators use inside; a long text; nulls in every column."""
    rng = random.Random(3)
    long = " ".join(f"w{rng.randrange(2000)}" for _ in range(120_000))
    rows = [(1, "one two three four five six"), (2, long), (None, None), (3, ""), (4, long[:5000])]
    docs = spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("key", "node", "part", "at", "kept", "carried", "component_id", "n_shingles", "score", "_corpus_extra", "digest", "name"):
        docs = docs.withColumn(c, F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        for table in (docs.limit(0), docs):
            out = stage(spark, table, FOLDER)
            if name != "packing":
                assert out.dtypes == docs.dtypes, name
            got = out.select("doc_id").collect()
            assert len(got) == 0 if table is not docs else {r.doc_id for r in got} <= {1, 2, 3, 4, None}, name
    kept = {r.doc_id: r.text for r in corpus_pipeline.no_repeats(spark, docs, FOLDER).collect()}
    assert kept[2] == long and len(kept[4]) == 0 and corpus_pipeline.one_of_each(spark, docs, FOLDER).count() == 4


def test_run(spark):
    rows = corpus_pipeline.run(spark, FOLDER)
    assert rows.count() > 0 and set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}


def test_names():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
