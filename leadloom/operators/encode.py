"""Encoding of categories and missing numbers for tree training."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import StringIndexer, StringIndexerModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadloom.functions.columns import quoted
from leadloom.functions.fixed import MAX_CATEGORIES
from leadloom.operators.ranks import quantile_list


def fit_ordinal(df: DataFrame, columns: Sequence[str], suffix: str = "_code") -> StringIndexerModel:
    """Sorted categories per column; unseen and null share the code after the last.

    Meant for categorical columns of a feature profile (at most 255 values).
    """
    text = df.select(*[quoted(c).cast("string").alias(c) for c in columns])
    # The indexer brings every value to the driver: a column with far more than is allowed must not get there.
    seen = text.agg(*[F.approx_count_distinct(quoted(c)).alias(c) for c in columns]).first()
    if any(seen[c] > 2 * MAX_CATEGORIES for c in columns):
        raise ValueError(f"more than {MAX_CATEGORIES} categories: not a categorical feature")
    return StringIndexer(inputCols=list(columns), outputCols=[f"{c}{suffix}" for c in columns],
                         stringOrderType="alphabetAsc", handleInvalid="keep").fit(text)


def ordinal_encode(df: DataFrame, columns: Sequence[str], model: StringIndexerModel | None = None,
                   suffix: str = "_code") -> DataFrame:
    """Adds ``<column>_code``: position among the sorted categories, null for unseen and missing."""
    model = model or fit_ordinal(df, columns, suffix)
    sizes = [len(labels) for labels in model.labelsArray]
    if max(sizes) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} categories: not a categorical feature")
    coded = model.transform(df)
    return coded.withColumns({
        f"{c}{suffix}": F.when(quoted(f"{c}{suffix}") < float(n), quoted(f"{c}{suffix}").cast("bigint"))
        for c, n in zip(columns, sizes)})


def fit_medians(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, float]:
    """Median per numeric column (0 when a column has no value).

    Exact interpolated medians take a range-bucketed pass per column. ``exact=False`` gets all
    of them from one scan with bounded sketches.
    """
    if not columns:
        return {}
    if exact:
        with ThreadPoolExecutor(min(8, len(columns))) as pool:      # independent jobs
            found = list(pool.map(lambda c: quantile_list(df, c, 3), columns))
        return {c: values[1] if values else 0.0 for c, values in zip(columns, found)}
    row = df.agg(*[F.percentile_approx(quoted(c).cast("double"), 0.5, 10_000).alias(f"m{i}")
                   for i, c in enumerate(columns)]).first()
    return {c: float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}


def impute_indicator(df: DataFrame, columns: Sequence[str], medians: Mapping[str, float] | None = None,
                     suffix: str = "_missing") -> DataFrame:
    """Fill nulls with the training median and add a 0/1 column that marks them."""
    medians = medians if medians is not None else fit_medians(df, columns)
    filled = {c: F.coalesce(F.nanvl(quoted(c).cast("double"), F.lit(None).cast("double")), F.lit(float(medians[c])))
              for c in columns}
    marks = {f"{c}{suffix}": (quoted(c).isNull() | F.isnan(quoted(c).cast("double"))).cast("int") for c in columns}
    return df.withColumns({**filled, **marks})
