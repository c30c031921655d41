"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadloom.session import scratch_path


CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` written to the shared folder and read back, with its path for ``discard``.

    What the job shuffled is deleted with it; else it stays until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEAN) if before is None else spark.conf.set(CLEAN, before)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _pull(edges: DataFrame, smaller_only: bool) -> DataFrame:
    """Every node's neighbours are linked to the least of them (and the node itself)."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if not smaller_only else edges.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    joined = both.join(least, "a").withColumn("least", F.least("least", "a"))
    out = joined.where(F.col("b") > F.col("a")) if not smaller_only else joined
    moved = out.select(F.col("b").alias("a"), F.col("least").alias("b"))
    if smaller_only:
        moved = moved.unionAll(least.select("a", F.col("least").alias("b")))
    return moved.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (its smallest node) of every node in ``links`` (``a``, ``b``).

    Each round is two joins of the links, written to the shared folder; the number of
    rounds grows with the logarithm of the longest path. No link leaves the executors.
    """
    spark = links.sparkSession
    edges, path = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        after, fresh = written(_pull(_pull(edges, False), True), "links")
        told = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(spark, path)
        edges, path = after, fresh
        if told == state:
            break
        state = told
    return edges.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
