import random

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.functions.columns import grid_floor, normal_quantile, order_hash
from leadloom.operators.ranks import RangeBuckets, exact_quantiles, hash_cutoffs, row_index, running_totals


@pytest.fixture(scope="module")
def values(spark):
    """A third of all rows share one value; the rest is spread unevenly."""
    rng = random.Random(5)
    data = [(i, 7.25 if i % 3 == 0 else round(rng.expovariate(0.1), 3)) for i in range(3000)]
    return spark.createDataFrame(data, "id bigint, x double").repartition(5).cache()


@pytest.mark.parametrize("per_bucket", [None, 40])
@pytest.mark.parametrize("points", [2, 3, 11, 100, 1000])
def test_quantiles_equal_numpy(values, points, per_bucket):
    got = sorted(exact_quantiles(values, "x", points, per_bucket).collect())
    x = np.array([r["x"] for r in values.select("x").collect()])
    want = np.percentile(x, np.linspace(0, 1, points) * 100)
    assert [r["k"] for r in got] == list(range(points))
    assert np.allclose([r["value"] for r in got], want, atol=1e-9)
    assert got[0]["n"] == len(x)


def test_quantiles_of_few_values(spark):
    one = spark.createDataFrame([(3.0,)], "x double")
    assert [r["value"] for r in sorted(exact_quantiles(one, "x", 3).collect())] == [3.0] * 3
    none = spark.createDataFrame([(None,), (float("nan"),)], "x double")
    assert exact_quantiles(none, "x", 3).count() == 0
    two = spark.createDataFrame([(1.0,), (3.0,), (None,)], "x double")
    assert [r["value"] for r in sorted(exact_quantiles(two, "x", 3).collect())] == [1.0, 2.0, 3.0]


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_in_buckets_equal_one_window(values, descending):
    counts = values.groupBy("x").agg(F.count("*").alias("c"), F.sum("id").alias("t"))
    buckets = RangeBuckets.fit(values, "x", 30)
    assert buckets.count > 10
    one = running_totals(counts, "x", ["c", "t"], RangeBuckets(), descending, ["c"])
    many = running_totals(counts, "x", ["c", "t"], buckets, descending, ["c"])
    assert rows(one) == rows(many)


def test_row_index_is_dense_and_ordered(spark, values):
    for buckets in (RangeBuckets(), RangeBuckets.fit(values, "id", 100)):
        got = rows(row_index(values, "n", "id", buckets), "id", "n")
        assert got == [(i, i) for i in range(3000)]
    shuffled = row_index(values.groupBy("x").count(), "n")
    assert [r["n"] for r in shuffled.orderBy("n").collect()] == list(range(values.select("x").distinct().count()))
    scan = row_index(spark.range(0, 1000, 1, 7), "n")
    assert rows(scan, "id", "n") == [(i, i) for i in range(1000)]


def test_hash_cutoffs_pick_the_first_rows_per_group(values):
    tagged = values.select((F.col("id") % 3 == 0).alias("g"), order_hash("id", 1).alias("h"))
    got = {(r["g"], r["cut"]): r["cutoff"] for r in
           hash_cutoffs(tagged, ["g"], "h", lambda n: [F.lit(10), F.ceil(n / 2)]).collect()}
    for g in (True, False):
        hashes = sorted(r["h"] for r in tagged.where(F.col("g") == g).collect())
        assert got[(g, 0)] == hashes[9]
        assert got[(g, 1)] == hashes[-(-len(hashes) // 2) - 1]


def test_hash_cutoffs_keep_copies_together(spark):
    copies = spark.createDataFrame([("k",)] * 50 + [(f"u{i}",) for i in range(50)], "key string")
    tagged = copies.select(F.lit(1).alias("g"), order_hash("key").alias("h"))
    cut = hash_cutoffs(tagged, ["g"], "h", lambda n: [F.lit(30)]).first()["cutoff"]
    below = tagged.where(F.col("h") <= cut).count()
    assert below >= 30 and tagged.where(F.col("h") < cut).count() < 30


def test_grid_floor_is_the_last_grid_point_not_above(spark):
    points = [i / 1000 for i in range(0, 1001)] + [0.57, 0.5699999999999999, 0.1234, 0.9999, 17.0005]
    got = spark.createDataFrame([(p,) for p in points], "p double").select("p", grid_floor(F.col("p")).alias("g")).collect()
    for r in got:
        assert r["g"] / 1000 <= r["p"] < (r["g"] + 1) / 1000


def test_normal_quantile(spark):
    from statistics import NormalDist
    points = [1e-9, 1e-7, 0.001, 0.02, 0.075, 0.3, 0.5, 0.6, 0.925, 0.99, 1 - 1e-7]
    got = spark.createDataFrame([(p,) for p in points], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for r in got.collect():
        assert r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=1e-9)
