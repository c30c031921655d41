"""What the corpus operators leave on disk while they run."""

import time

from pyspark.sql import functions as F

from leadloom.llm import parity_join
from leadloom.llm.graph import CLEAN, discard, written


def shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {f for f in files.split("\n") if "/shuffle_" in f}


def test_shuffle_files_go_with_the_job(spark):
    before, set_before = shuffled(spark), spark.conf.get(CLEAN, None)
    out, path = written(spark.range(20_000).groupBy((F.col("id") % 500).alias("k")).count(), "counts")
    until = time.time() + 20
    while shuffled(spark) - before and time.time() < until:      # executors delete them on their own
        time.sleep(0.2)
    assert not shuffled(spark) - before
    assert spark.conf.get(CLEAN, None) == set_before
    assert out.agg(F.sum("count")).first()[0] == 20_000
    discard(spark, path)


def test_only_texts_of_a_pair_are_verified(spark):
    ids = spark.createDataFrame([(i,) for i in (-5, 0, 7, 1 << 40)], "id long")
    member = parity_join._among(ids)
    asked = spark.range(-3000, 3000).unionAll(ids).distinct()
    kept = {r.id for r in asked.where(member(F.col("id"))).collect()}
    assert {-5, 0, 7, 1 << 40} <= kept and len(kept) < 600
    assert asked.where(parity_join._among(ids.limit(0))(F.col("id"))).count() == 0
