"""Projection, renaming, casting and validation."""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadloom.functions.columns import is_positive, looks_number, quoted


def choose_fields(fields: Sequence[str], include: Iterable[str] = (), exclude: Iterable[str] = (),
                  include_regex: Iterable[str] = (), exclude_regex: Iterable[str] = ()) -> list[str]:
    """Field names kept by inclusion and exclusion rules, in input order.

    Include patterns must match the whole name, exclude patterns its beginning.
    Nothing included by name or pattern means all fields; exclusion wins.
    """
    include, include_regex = set(include), [re.compile(p) for p in include_regex]
    exclude, exclude_regex = set(exclude), [re.compile(p) for p in exclude_regex]
    wanted = include | {f for f in fields if any(p.fullmatch(f) for p in include_regex)}
    if include_regex and not wanted:
        warnings.warn("no field matches the include patterns: all fields are used", stacklevel=2)
    return [
        f for f in fields
        if (not wanted or f in wanted) and f not in exclude and not any(p.match(f) for p in exclude_regex)
    ]


def project(df: DataFrame, **rules) -> DataFrame:
    """``select`` of :func:`choose_fields`; pruned at the scan."""
    return df.select(*[quoted(c) for c in choose_fields(df.columns, **rules)])


def require_columns(df: DataFrame, required: Iterable[str], error: type[Exception] = RuntimeError) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise error(f"data is missing required fields: {missing}")
    return df


def feature_columns(df: DataFrame, label: str | None, include: Sequence[str] = (),
                    exclude: Iterable[str] = ()) -> list[str]:
    """Model fields: the included ones (or all), less the excluded and the label."""
    drop = set(exclude) | ({label} if label else set())
    names = [c for c in (include or df.columns) if c not in drop]
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise ValueError(f"fields to include are not in the data: {missing}")
    return names


def consolidate_missing(df: DataFrame, tokens: Iterable[str]) -> DataFrame:
    """Null for every missing token, over all string columns, in one projection."""
    tokens = sorted(set(tokens))
    strings = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return df.select(*[
        F.when(~quoted(c).isin(tokens), quoted(c)).alias(c) if c in strings else quoted(c)
        for c in df.columns
    ])


def field_remap(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename the columns of ``mapping`` that are present."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def affix(df: DataFrame, prefix: str = "", suffix: str = "", keep: Iterable[str] = ()) -> DataFrame:
    """Prefix and suffix on all columns but ``keep``."""
    keep = set(keep)
    return df.select(*[quoted(c).alias(c if c in keep else f"{prefix}{c}{suffix}") for c in df.columns])


def all_present(columns: Sequence[str]) -> Column:
    """True where every one of ``columns`` is non-null."""
    test = F.lit(True)
    for c in columns:
        test = test & quoted(c).isNotNull()
    return test


def request_map(columns: Mapping[str, str] | Sequence[str], params: Mapping[str, str] | None = None) -> Column:
    """The flat request of a record as ``map<string,string>``.

    Null fields are left out; constant ``params`` fill in keys that the record
    does not carry. ``columns`` maps column name to request name.
    """
    names = dict(columns) if isinstance(columns, Mapping) else {c: c for c in columns}
    pairs = [F.struct(F.lit(request).alias("key"), quoted(c).cast("string").alias("value"))
             for c, request in names.items()]
    for key, value in (params or {}).items():
        from_record = [c for c, request in names.items() if request == key]
        keep = F.lit(str(value))
        if from_record:      # only where the record has no value of its own
            keep = F.when(quoted(from_record[0]).isNull(), keep)
        pairs.append(F.struct(F.lit(key).alias("key"), keep.alias("value")))
    return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull()))


def booleanize_label(df: DataFrame, label: str, positive) -> DataFrame:
    """The label as a boolean; null is False; a boolean label is left alone."""
    if isinstance(df.schema[label].dataType, T.BooleanType):
        return df
    return df.withColumn(label, is_positive(label, positive))


def cast_features(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                  keep: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Categorical columns as text, numeric ones as double.

    ``strict`` raises on text that is not a number, otherwise it becomes null. Text with a
    type suffix (``1d``, ``2f``), which a cast alone would take, is not a number.
    """
    kinds = dict(df.dtypes)
    texts, numbers, rest = set(categorical), set(numeric), set(keep)

    def typed(c: str) -> Column:
        if c in texts:
            return quoted(c).cast("string").alias(c)
        if c in numbers:
            value = quoted(c)
            if kinds[c] == "string":
                known = looks_number(F.trim(value)) | (F.lower(F.trim(value)) == "nan")
                value = F.when(known, value).otherwise(F.concat(F.lit("not a number: "), value))
            return (value.cast("double") if strict else value.try_cast("double")).alias(c)
        return quoted(c)

    return df.select(*[typed(c) for c in df.columns if c in texts | numbers | rest])


def output_name(existing: Iterable[str], name: str) -> str:
    """The name of the score column next to kept fields."""
    return f"{name}_SCORED" if name in set(existing) else name


def score_output(df: DataFrame, score: str, keep: Sequence[str] = (), name: str = "Score",
                 whole: bool = True) -> DataFrame:
    """Kept fields plus the score, as an integer when scores are ``whole``."""
    value = quoted(score).cast("bigint") if whole else quoted(score)
    return df.select(*[quoted(c) for c in keep], value.alias(output_name(keep, name)))
