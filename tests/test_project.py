import pytest
from conftest import rows

from leadloom.operators.project import (
    affix, booleanize_label, cast_features, choose_fields, consolidate_missing, feature_columns, field_remap,
    output_name, request_map, require_columns, score_output)

FIELDS = ["age", "age_group", "income", "zip", "label"]


def test_choose_fields():
    assert choose_fields(FIELDS) == FIELDS
    assert choose_fields(FIELDS, include=["zip", "age", "nope"]) == ["age", "zip"]
    assert choose_fields(FIELDS, include_regex=["age"]) == ["age"]            # whole name
    assert choose_fields(FIELDS, exclude_regex=["age"]) == ["income", "zip", "label"]   # beginning
    assert choose_fields(FIELDS, include=["age", "zip"], exclude=["zip"]) == ["age"]
    with pytest.warns(UserWarning):
        assert choose_fields(FIELDS, include_regex=["x.*"]) == FIELDS


def test_required_and_feature_columns(spark):
    df = spark.createDataFrame([(1, 2, 0)], "a int, b int, y int")
    assert require_columns(df, ["a"]) is df
    with pytest.raises(RuntimeError, match="c"):
        require_columns(df, ["a", "c"])
    assert feature_columns(df, "y") == ["a", "b"]
    assert feature_columns(df, "y", include=["b", "y"], exclude=["a"]) == ["b"]
    with pytest.raises(ValueError):
        feature_columns(df, "y", include=["nope"])


def test_missing_only_in_strings(spark):
    df = spark.createDataFrame([("NA", 1), ("x", None)], "`a.b` string, n int")
    assert rows(consolidate_missing(df, ["NA"])) == [("x", None), (None, 1)]


def test_remap_and_affix(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert field_remap(df, {"a": "x", "c": "y"}).columns == ["x", "b"]
    assert affix(df, "p_", "_s", keep=["a"]).columns == ["a", "p_b_s"]


def test_request_map_prefers_the_record(spark):
    df = spark.createDataFrame([("A", None), (None, "z")], "first string, zip string")
    got = df.select(request_map({"first": "name", "zip": "zip"}, {"zip": "any", "cfg": 1}).alias("m")).collect()
    assert [r["m"] for r in got] == [{"name": "A", "zip": "any", "cfg": "1"}, {"zip": "z", "cfg": "1"}]


def test_label(spark):
    df = spark.createDataFrame([("yes",), ("no",), (None,)], "y string")
    out = booleanize_label(df, "y", "yes")
    assert [r["y"] for r in out.collect()] == [True, False, False]
    assert booleanize_label(out, "y", "other") is out


def test_casts(spark):
    df = spark.createDataFrame([("1.5", 7), ("x", 8)], "n string, c int")
    lenient = cast_features(df, ["n"], ["c"], strict=False)
    assert dict(lenient.dtypes) == {"n": "double", "c": "string"}
    assert rows(lenient, "n", "c") == [(1.5, "7"), (None, "8")]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_features(df, ["n"], ["c"]).collect()
    suffixed = spark.createDataFrame([("1d", 7), ("2f", 8), ("", 9), (" 3 ", 10), ("-1e3", 11), (None, 12)], "n string, c int")
    assert [r["n"] for r in cast_features(suffixed, ["n"], [], strict=False).collect()] == [None, None, None, 3.0, -1000.0, None]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        cast_features(suffixed.limit(1), ["n"], []).collect()


def test_score_column_steps_aside(spark):
    df = spark.createDataFrame([(1, 99.0)], "Score int, raw double")
    assert output_name(["a"], "Score") == "Score"
    assert score_output(df, "raw", ["Score"]).columns == ["Score", "Score_SCORED"]
    assert score_output(df, "raw").collect()[0]["Score"] == 99
    assert dict(score_output(df, "raw", whole=False).dtypes)["Score"] == "double"
