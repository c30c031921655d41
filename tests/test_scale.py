"""Shapes that larger tables depend on: files and splits per task, jobs per fit, bytes per row of a state."""

import glob
import hashlib
import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

import __spark_entry__ as entry
from leadloom.plans import boosting as B
from leadloom.plans import trees as T
from leadloom.session import shared_folder


def written(spark, name):
    """Data files of each scratch folder of that name."""
    folder = shared_folder(spark).removeprefix("file://")
    return {d: sorted(f for f in glob.glob(f"{d}/part-*") if os.path.getsize(f)) for d in glob.glob(f"{folder}/{name}-*")}


def new_files(spark, name, run):
    before = set(written(spark, name))
    told = run()
    [files] = [f for d, f in written(spark, name).items() if d not in before]
    return told, files


def test_quoted_breaks_are_written_by_the_tasks_that_read(spark, tmp_path):
    texts = {i: f'a "quoted"{i}\n\nline,\t{"x" * (i % 7)}' for i in range(60)}
    spark.createDataFrame([(i, t, len(t)) for i, t in texts.items()], "doc_id long, text string, n_chars long").repartition(
        3).write.parquet(f"{tmp_path}/documents.parquet")
    split_bytes = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))     # a task per file
    try:
        got, files = new_files(spark, "quoted-breaks", lambda: entry.q_quoted_breaks(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", split_bytes)
    assert len(files) == 3
    want = [(i, len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in texts.items()] + [(None, None, None)] * 6
    assert sorted(map(str, want)) == sorted(str((r["id"], r["n"], r["digest"])) for r in got)


def test_file_chunks_are_sorted_by_several_tasks(spark, tmp_path):
    # keys come in no order, some of them often, one is null
    keys = [(i * 7919) % 2600 if i % 3 else 1000 for i in range(4000)] + [None]
    spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "o_orderkey long, o_custkey long").coalesce(1).write.parquet(
        f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, files = new_files(spark, "orders-file", lambda: entry.q_file_chunks(spark, str(tmp_path)).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [os.path.getsize(f) for f in files]
    assert len(files) > 1 and max(sizes) < 0.6 * sum(sizes)
    order = sorted(range(len(keys)), key=lambda i: (keys[i] is not None, keys[i] or 0, i))
    assert sorted((r["n"], r["o_orderkey"], r["o_custkey"], r["chunk"]) for r in got) == [
        (n, keys[i], i, n // 1000) for n, i in enumerate(order) if n >= 2000]


@pytest.fixture(scope="module")
def long_table(spark):
    x = F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double")
    out = spark.range(B.BLOCK_ROWS + 5000).select(
        F.col("id").cast("string").alias("key"), (x > 400 + F.pmod("id", F.lit(200))).cast("double").alias("y"),
        array_to_vector(F.array(x, F.pmod("id", F.lit(17)).cast("double"))).alias("features"),
        F.pmod("id", F.lit(3)).cast("int").alias("f")).cache()
    out.count()
    yield out
    out.unpersist()


def test_jobs_of_a_fit_do_not_grow_with_its_steps(spark, long_table):
    def jobs(rounds):
        group = f"fit-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            boosted = B.fit_boosters(long_table, [B.ModelSpec(B.TreeParams(0.3, rounds, 2, 4), 0, 0)], "key", "y", "features", ["f"])
            assert boosted.margins.count() == B.BLOCK_ROWS + 5000
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(4) <= jobs(1) + 2


def test_rows_of_the_state_do_not_grow_with_the_models(spark, long_table, monkeypatch):
    rows = long_table.limit(900).cache()
    specs = [B.ModelSpec(B.TreeParams(0.1 * (1 + m % 5), 2, 2, 3 + m // 5), 0, m % 3) for m in range(20)]
    monkeypatch.setattr(B, "STATE_BYTES", 8 * 300 * 8)      # eight models of a block, raising= fails where there is no bound
    monkeypatch.setattr(B, "STEPS_PER_STATE", 2)

    def fit(**sizes):
        out = B.fit_boosters(rows, specs, "key", "y", "features", ["f"], keep_trees=True, together=4, **sizes)
        margins = {(r["key"], m): x for r in out.margins.collect() for m, x in zip(r["models"], r["margins"])}
        assert len(margins) == 900 * 20 and all(len(r["models"]) % 4 == 0 for r in out.margins.select("models").collect())
        return out.trees(), margins

    before = set(written(spark, "boosting-state"))
    steps = fit(block_rows=300)
    states = [f for d, fs in written(spark, "boosting-state").items() if d not in before for f in fs]
    assert states and spark.read.parquet(*states).agg(F.max(F.length("margins"))).first()[0] <= B.STATE_BYTES
    # in one task over several blocks, and over one block
    assert steps == fit(block_rows=300, apart_rows=900) == fit(block_rows=1000)
    rows.unpersist()


def test_margins_are_stored_row_by_row(spark, long_table):
    """What a reader holds at a time does not grow with the block or the models."""
    rows = long_table.limit(700).withColumn("key", F.when(F.col("key") != "5", F.col("key"))).cache()
    specs = [B.ModelSpec(B.TreeParams(0.3, 2, 2, 3), 0, m % 3) for m in range(4)]
    before = set(written(spark, "boosted"))
    boosted = B.fit_boosters(rows, specs, "key", "y", "features", ["f"], keep_trees=True, together=2, apart_rows=1000)
    [files] = [f for d, f in written(spark, "boosted").items() if d not in before]
    stored = spark.read.parquet(*files).where("trees is null")
    assert stored.count() == 700 * 2 and stored.agg(F.max(F.size("margins"))).first()[0] == 2
    got = boosted.margins.collect()
    assert sorted((str(r["key"]), r["y"], *r["folds"], *r["models"]) for r in got) == sorted(
        (str(r["key"]), r["y"], r["f"], m, m + 1) for r in rows.collect() for m in (0, 2))
    assert sorted(boosted.trees()) == [0, 1, 2, 3]
    rows.unpersist()


def test_models_are_calibrated_where_they_are_trained(spark, long_table, monkeypatch):
    """No pass over stored margins per Newton step; sigmoids, metrics and held-out rows as by the passes."""
    rows = long_table.limit(2000).select(F.md5("key").alias("_id"), F.col("y").alias("_label"), "features").cache()
    rows.count()

    def fitted(**sizes):
        factory = T.CalibratedTreesFactory(k=3, scoring=["roc_auc", "neg_log_loss"], n_optimization_rounds=2,
                                           space={"maxIter": ("integer", 2, 4), "maxLeaves": ("log2", 2, 8)}, **sizes)
        model = factory.optimize(rows)
        unseen = {r["_id"]: r["probability"] for r in factory.out_of_fold_probability(rows, model).collect()}
        assert len(unseen) == 2000 and None not in unseen
        return factory.trials, model.sigmoids, unseen

    trials, sigmoids, unseen = fitted(block_rows=700)        # in lockstep
    monkeypatch.setattr(T, "fit_sigmoids", None)
    here = fitted()
    for was, now in zip(trials, here[0]):
        assert was["params"] == now["params"]
        for name in ("roc_auc", "neg_log_loss"):
            assert now["scores"][name] == pytest.approx(was["scores"][name], abs=1e-7)
    for was, now in zip(sigmoids, here[1]):
        assert now == pytest.approx(was, rel=1e-4)
    assert here[2] == pytest.approx(unseen, abs=1e-6)
    rows.unpersist()


def test_sums_of_hot_bins():
    """Histograms are exact where rows and hessians are summed as one, at its bound and beyond."""
    n = B.SHARED_ROWS - 1
    codes = np.zeros((3 * n, 2), np.uint16)
    codes[:, 0] = np.arange(3 * n) % 3                       # as many rows in a bin as may be
    codes[: n + 5, 1] = 1                                    # more than that
    bins = B.Bins(B.Layout(4, ((0, 1), (2, 3))), [np.array([0.0, 1.0]), np.array([0.0])])
    rng = np.random.default_rng(1)
    g, h = rng.integers(-(1 << 24), 1 << 24, 3 * n).astype(float), np.full(3 * n, float(1 << 22))
    rows = B.Rows(bins, codes, np.zeros(3 * n), np.zeros((3 * n, 1), np.int8))
    counts = rows.counts()
    assert max(counts[0]) == n < max(counts[1])
    for parts in ([np.arange(3 * n)], [np.arange(3 * n - 1)], [np.arange(0, 3 * n, 2), np.arange(1, 3 * n, 2)]):
        got = rows.sums(parts, g, h, counts)
        assert np.array_equal(got, rows.sums(parts, g, h))
        for k, part in enumerate(parts):
            for f in range(2):
                for b in range(2):
                    at = part[codes[part, f] == b]
                    assert got[k, :, bins.starts[f] + b].tolist() == [len(at), g[at].sum(), h[at].sum()]
