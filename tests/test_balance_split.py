import pytest
from conftest import rows
from pyspark.sql import functions as F

from leadloom.operators.balance import balance_fill_rates, fill_rates
from leadloom.operators.split import balanced_sample, fit_folds, fit_holdout, stratified_folds, stratified_split
from leadloom.plans.jobs import collect


@pytest.fixture(scope="module")
def table(spark):
    """1000 rows, 30 % positive; ``a`` is fuller for positives, ``b`` nearly even, ``c`` always filled."""
    i = F.col("id")
    return spark.range(1000).select(
        i.alias("key"), F.when(i % 10 < 3, "yes").when(i % 10 < 9, "no").alias("label"),
        F.when((i % 10 < 3) | (i % 2 == 0), i).alias("a"),
        F.when(i % 20 != 0, i).alias("b"), F.lit(1).alias("c")).repartition(7).cache()


def test_fill_rates(table):
    got = {r["field"]: r for r in fill_rates(table, "label", "yes", ["a", "c"]).collect()}
    assert (got["a"]["rate_positive"], got["c"]["rate_negative"]) == (1.0, 1.0)
    assert got["a"]["n_negative"] == 700        # null labels count as the rest


def test_balance_levels_the_fuller_class(table):
    before = {r["field"]: r for r in fill_rates(table, "label", "yes", ["a", "b"]).collect()}
    out = balance_fill_rates(table, "key", "label", "yes", ["a", "b", "c"])
    after = {r["field"]: r for r in fill_rates(out, "label", "yes", ["a", "b", "c"]).collect()}
    gap = before["a"]["rate_positive"] - before["a"]["rate_negative"]
    assert after["a"]["filled_positive"] == 300 - int(gap * 300)
    assert after["a"]["filled_negative"] == before["a"]["filled_negative"]
    assert after["b"]["filled_positive"] == before["b"]["filled_positive"]
    assert out.count() == 1000
    again = balance_fill_rates(table.repartition(3), "key", "label", "yes", ["a", "b", "c"])
    assert rows(out) == rows(again)
    other = balance_fill_rates(table, "key", "label", "yes", ["a"], seed=9)
    assert rows(other, "key", "a") != rows(out, "key", "a")


def test_balance_guards(spark, table):
    with pytest.raises(ValueError):
        balance_fill_rates(table, "key", None, "yes", ["a"])
    with pytest.raises(ValueError):
        balance_fill_rates(table, "key", "label", "yes", ["nope"])
    assert balance_fill_rates(table, "key", "label", "absent class", ["a"]) is table
    assert balance_fill_rates(table, "key", "label", "yes", ["a"], tolerance=None) is table
    stream = spark.readStream.format("rate").load()
    with pytest.raises(RuntimeError):
        balance_fill_rates(stream, "value", "value", 1, ["value"])
    with pytest.raises(ValueError):
        collect(table, has_label=True)
    out = collect(table, label="label", positive="yes", has_label=True, balance_fields=["a"], key="key", required=["a"])
    assert dict(out.dtypes)["label"] == "boolean" and out.where("label").count() == 300


def test_split_is_stratified_and_stable(table):
    got = stratified_split(table, "key", "label", positive="yes")
    counts = {(r["label"], r["split"]): r["count"] for r in got.groupBy("label", "split").count().collect()}
    assert counts[("yes", "test")] == 60
    assert sum(v for (lab, s), v in counts.items() if lab != "yes" and s == "test") == 140
    again = stratified_split(table.repartition(3), "key", "label", positive="yes")
    assert rows(got, "key", "split") == rows(again, "key", "split")
    other = stratified_split(table, "key", "label", positive="yes", seed=5)
    assert rows(got, "key", "split") != rows(other, "key", "split")


def test_split_plan_has_no_shuffle(table):
    cut = fit_holdout(table, "key", "label", positive="yes")
    plan = table.sparkSession.range(5).selectExpr("id as key", "'yes' as label").where(cut.inside())
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_whole_row_as_key(table):
    cut = fit_holdout(table, tuple(table.columns), "label", positive="yes")
    assert table.where(cut.inside()).count() == 200


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds(table, k):
    got = stratified_folds(table, "key", "label", k, positive="yes")
    sizes = {}
    for r in got.groupBy(F.coalesce(F.col("label") == "yes", F.lit(False)).alias("p"),
                         "fold").count().collect():
        sizes.setdefault(r["p"], []).append(r["count"])
    for s in sizes.values():
        assert len(s) == k and max(s) - min(s) <= 1


def test_more_folds_than_rows(spark):
    df = spark.createDataFrame([(i, 1 if i < 2 else 0) for i in range(9)], "key int, y int")
    assert stratified_folds(df, "key", "y", 5).where("fold between 0 and 4").count() == 9
    assert len(fit_folds(df, "key", "y", 5).positives) == 4


def test_balanced_sample(table):
    got = balanced_sample(table, "key", "label", 50, positive="yes")
    counts = [r["count"] for r in got.groupBy(F.coalesce(F.col("label") == "yes", F.lit(False))).count().collect()]
    assert counts == [50, 50]
    assert balanced_sample(table, "key", "label", 5000, positive="yes").count() == 600
    assert balanced_sample(table, "key", "label", 50, positive="absent").count() == 0


@pytest.fixture(scope="module")
def copies(spark):
    """1000 rows, 600 of them with one key, without any other way to tell rows apart."""
    i = F.col("id")
    return spark.range(1000).select(
        F.when(i % 5 < 3, 0).otherwise(i).alias("key"), F.when(i % 2 == 0, "yes").otherwise("no").alias("label"),
        F.when(i % 2 == 0, 1).when(i % 4 == 1, 1).alias("v")).repartition(5).cache()


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 5])
def test_draws_are_exact_when_keys_repeat(copies, seed):
    split = stratified_split(copies, "key", "label", positive="yes", seed=seed)
    assert {(r["label"], r["split"]): r["count"] for r in split.groupBy("label", "split").count().collect()} == {
        (c, s): n for c in ("yes", "no") for s, n in (("test", 100), ("train", 400))}
    folds = stratified_folds(copies, "key", "label", 5, positive="yes", seed=seed)
    assert {r["count"] for r in folds.groupBy("label", "fold").count().collect()} == {100}
    assert balanced_sample(copies, "key", "label", 50, positive="yes", seed=seed).count() == 100
    out = balance_fill_rates(copies, "key", "label", "yes", ["v"], seed=seed)
    assert out.where("label = 'yes'").agg(F.count("v")).first()[0] == 250
    assert out.count() == 1000 and out.columns == copies.columns


def test_grouped_split_keeps_copies_together(copies):
    split = stratified_split(copies, "key", "label", positive="yes", grouped=True)
    assert split.groupBy("label", "key").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_whole_row_key_with_copies(spark):
    df = spark.createDataFrame([(1, "yes")] * 30 + [(1, "no")] * 50, "a int, label string")
    split = stratified_split(df, df.columns, "label", positive="yes")
    assert split.where("split = 'test'").groupBy("label").count().count() == 2
    assert split.where("split = 'test'").count() == 16
